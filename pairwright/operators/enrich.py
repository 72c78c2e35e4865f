"""Statement and formula to a full sample row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions import formula as fx
from pairwright.functions import identity as ident


def sample_columns(
    nl: Column,
    formula: Column,
    template_id: Column | None = None,
    provider: Column | None = None,
    paraphrase_of: Column | None = None,
    critique_ok: Column | None = None,
    issues: Column | None = None,
    confidence: Column | None = None,
) -> list[Column]:
    """All sample columns of a generated pair.

    The id is taken from the ASCII form, so both spellings of a formula give
    the same id. The confidence is null when the critique failed.
    """
    text = F.lit(None).cast("string")
    ok = F.lit(True) if critique_ok is None else critique_ok
    ascii_form = fx.to_ascii(formula)
    return [
        ident.content_id(nl, ascii_form).alias("id"),
        nl.alias("nl_statement"),
        ascii_form.alias("atl_formula"),
        fx.to_printed(ascii_form).alias("atl_unicode"),
        ident.domain_of(nl, formula).alias("domain"),
        (text if template_id is None else template_id).alias("template_id"),
        fx.agents(formula).alias("agents"),
        fx.temporal_operators(formula).alias("operators"),
        fx.atoms(formula).alias("atoms"),
        F.struct(
            (F.lit("none") if provider is None else provider).alias("provider"),
            (text if paraphrase_of is None else paraphrase_of).alias("paraphrase_of"),
        ).alias("generation"),
        ok.alias("syntax_valid"),
        F.when(ok, F.lit(1.0) if confidence is None else confidence).alias("confidence"),
        (F.array().cast("array<string>") if issues is None else issues).alias("verification_notes"),
    ]


def enrich(df: DataFrame, nl: str, formula: str, keep: list[str] | None = None, **kw) -> DataFrame:
    return df.select(*(keep or []), *sample_columns(F.col(nl), F.col(formula), **kw))


def with_components(df: DataFrame, formula: str, mode: str = "boundary") -> DataFrame:
    """Component columns of a translated row: printed form, agents, operators, atoms, pattern."""
    f = F.col(formula)
    return df.select(
        "*",
        fx.to_printed(f).alias("atl_unicode"),
        fx.first_coalition(f).alias("agents"),
        fx.operators(f, mode).alias("operators"),
        fx.identifiers(f, lowered=True).alias("atoms"),
        fx.pattern(f).alias("pattern"),
    )
