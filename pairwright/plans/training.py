"""Filter, validate, split and export training records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright import vocab
from pairwright.functions import prompts, rules
from pairwright.operators.choose import split_by_hash, split_exact
from pairwright.operators.keep import keep_where


def mark_rows(
    rows: DataFrame,
    min_confidence: float = 0.0,
    wanted_status: str = "verified",
    domains: list[str] | None = None,
) -> DataFrame:
    """Adds failed_filter and field_error; a row trains when both are null."""
    reason = rules.failing_filter(
        F.col("verification_confidence"), F.col("verification_status"), F.col("domain"), min_confidence, wanted_status, domains
    )
    return rows.withColumn("failed_filter", reason).withColumn(
        "field_error", rules.field_error(F.col("nl_statement"), F.col("atl_formula"))
    )


def trainable(
    rows: DataFrame,
    min_confidence: float = 0.0,
    wanted_status: str = "verified",
    domains: list[str] | None = None,
) -> DataFrame:
    """Rows that pass the filters of ``mark_rows``, by plain conditions on stored columns, which reach the scan.

    For an export that needs no counts of what was left out.
    """
    out = rows
    if min_confidence > 0:
        c = F.col("verification_confidence")
        out = out.filter(c.isNull() | (c >= min_confidence) if min_confidence <= 1.0 else c >= min_confidence)
    if wanted_status != "all":
        s = F.col("verification_status")
        out = out.filter(s.isNull() | (s == wanted_status) if wanted_status == "verified" else s == wanted_status)
    return out.filter(F.col("domain").isin(domains)) if domains else out


def filter_counts(marked: DataFrame) -> DataFrame:
    """Rows by the first filter they fail; ``passed`` for the rest."""
    return marked.groupBy(F.coalesce("failed_filter", F.lit("passed")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def usable(marked: DataFrame) -> DataFrame:
    return keep_where(marked, F.col("failed_filter").isNull() & F.col("field_error").isNull())


def training_split(marked: DataFrame, key: str, seed: int, fraction: float = 0.1, exact: bool = True) -> DataFrame:
    """Usable rows with their split. The exact split needs a counting pass, the hash split none."""
    rows = usable(marked)
    return split_exact(rows, key, seed, fraction) if exact else split_by_hash(rows, key, seed, fraction)


def chat_records(
    rows: DataFrame, include_domain: bool = True, include_agents: bool = True, system: str = vocab.TRAINING_SYSTEM
) -> DataFrame:
    return rows.withColumn(
        "messages",
        prompts.chat_messages(
            F.col("nl_statement"),
            F.col("atl_formula"),
            F.col("domain") if include_domain else None,
            F.col("agents") if include_agents else None,
            system,
        ),
    )
