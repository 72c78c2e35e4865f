"""Inference recipes and the three ways to create a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions import answers, prompts
from pairwright.functions import formula as fx
from pairwright.functions.identity import statement_hash, statement_id
from pairwright.functions.profile import formula_profile
from pairwright.functions.rules import formula_errors
from pairwright.operators.choose import first_successes, take_random
from pairwright.operators.enrich import sample_columns, with_components
from pairwright.operators.generate import base_pairs, with_paraphrases
from pairwright.operators.identity import first_seen
from pairwright.operators.inference import Stage
from pairwright.operators.keep import keep_where
from pairwright.plans.verify import critique_outcomes, critique_pairs, critiqued
from pairwright.session import cut_lineage


def candidates(rows: DataFrame, ask: Stage, nl: str = "nl_statement") -> DataFrame:
    """Translation answers as one row per candidate formula: candidate_no, atl_formula."""
    asked = ask(rows.withColumn("_q", prompts.translation(F.col(nl))), "_q", "_a")
    return asked.select(
        *rows.columns, F.posexplode(answers.formula_candidates(F.col("_a.text"))).alias("candidate_no", "atl_formula")
    )


def valid_candidates(found: DataFrame, max_depth: int = 4, max_coalition_size: int = 5) -> DataFrame:
    """Candidates within the depth and coalition limits, with their profile."""
    marked = found.withColumn("profile", formula_profile(F.col("atl_formula"), max_depth, max_coalition_size))
    return keep_where(marked, F.col("profile.valid"))


def translate(rows: DataFrame, ask: Stage, key: str, nl: str = "nl_statement") -> DataFrame:
    """Rows with their first valid candidate; rows without one drop out."""
    good = valid_candidates(candidates(rows, ask, nl))
    return first_seen(good, key, F.col("candidate_no"))


def translate_with_metrics(rows: DataFrame, ask: Stage, nl: str = "nl_statement") -> DataFrame:
    """Candidates as an array with their number, response time and tokens."""
    asked = ask(rows.withColumn("_q", prompts.translation(F.col(nl))), "_q", "_a")
    return asked.select(
        *rows.columns,
        answers.formula_candidates(F.col("_a.text")).alias("formulas"),
        F.size(answers.formula_candidates(F.col("_a.text"))).alias("candidates_found"),
        (F.col("_a.latency_ms") / 1000).alias("response_time"),
        (F.col("_a.prompt_tokens") + F.col("_a.completion_tokens")).alias("tokens_used"),
        F.col("_a.error").alias("error"),
    )


def paraphrase(pairs: DataFrame, ask: Stage, n: int = 3) -> DataFrame:
    """Pairs (nl, formula, ..) and their paraphrases."""
    asked = ask(pairs.withColumn("_q", prompts.paraphrase(F.col("nl"), n)), "_q", "_a")
    items = answers.list_items(F.col("_a.text"), original=F.col("nl"), first=n)
    return with_paraphrases(asked.withColumn("_items", F.coalesce(items, F.array().cast("array<string>"))).drop("_q", "_a"), "_items")


def generate_statements(requests: DataFrame, ask: Stage, n: int = 10, request: str | None = None) -> DataFrame:
    """Statement rows from requests (domain, agents, atoms, pattern, ..).

    ``request`` names a column that tells attempts apart: equal prompts of different attempts are asked each.
    """
    q = prompts.statements(F.col("domain"), F.col("agents"), F.col("atoms"), F.col("pattern"), n)
    asked = ask(requests.withColumn("_q", q), "_q", "_a", request=request)
    items = answers.list_items(F.col("_a.text"), quotes=True, first=n)
    return asked.select(*requests.columns, F.posexplode(items).alias("item_no", "nl_statement"))


def unique_statements(statements: DataFrame, order: Column) -> DataFrame:
    """First occurrence of each normalised statement, with its id."""
    hashed = statements.withColumn("_h", statement_hash(F.col("nl_statement")))
    return first_seen(hashed, "_h", order).withColumn("id", statement_id(F.col("nl_statement"))).drop("_h")


def translated_rows(rows: DataFrame, formula: str = "atl_formula") -> DataFrame:
    """Component columns, errors and validity next to a translated statement."""
    errors = formula_errors(F.col(formula), temporal="boundary", square=False)
    return with_components(rows, formula).withColumn("syntax_errors", errors).withColumn(
        "syntax_valid", F.size("syntax_errors") == 0
    )


def template_dataset(draws: DataFrame, draw: str, seed: int, **kw) -> DataFrame:
    """Pairs from templates only."""
    pairs = base_pairs(draws, draw, seed, **kw)
    return pairs.select(*sample_columns(F.col("nl"), F.col("formula"), F.col("template_id"), F.lit("none")))


def model_dataset(attempts: DataFrame, ask: Stage, n: int, groups: list[str], provider: str, critique: Stage | None = None) -> DataFrame:
    """Statement and formula from a model. ``attempts`` carry attempt numbers per group;
    the first n successful ones of the first 3n count, and only these 3n are asked, each on its own."""
    tries = attempts.filter(F.col("attempt") < 3 * n).withColumn("_key", F.concat_ws("/", *groups, F.col("attempt").cast("string")))
    made = generate_statements(tries, ask, 1, request="_key")
    good = translate(made, ask, "_key")
    kept = first_successes(good, "attempt", F.lit(True), n, groups)
    name = F.concat(F.lit("llm_"), F.col("domain"), F.lit("_"), F.col("pattern"))
    rows = kept.select(
        *sample_columns(F.col("nl_statement"), F.col("atl_formula"), F.coalesce(name, F.lit("llm_generated")), F.lit(provider))
    )
    return critique_pairs(rows, critique) if critique else rows


def hybrid_dataset(
    draws: DataFrame, draw: str, seed: int, n: int, ask: Stage, critique: Stage | None, provider: str, paraphrases: int = 3, **kw
) -> DataFrame:
    """Template pairs, paraphrased, critiqued, trimmed to n by seeded choice.

    All pairs are paraphrased and critiqued; sample columns, which follow from a pair alone, are made of those that are taken.
    """
    pairs = base_pairs(draws, draw, seed, **kw).withColumn("atl_formula", fx.to_ascii(F.col("formula")))
    pairs = paraphrase(pairs, ask, paraphrases)
    key = F.concat_ws("/", F.col(draw).cast("string"), F.md5("nl")).alias("row_key")
    rows = pairs.select(key, F.col("nl").alias("nl_statement"), "atl_formula", "formula", "template_id", "paraphrase_of")
    if critique:
        rows = critique_outcomes(rows, critique)
    # what models answered is written once, then counted and trimmed
    taken = take_random(cut_lineage(rows, "hybrid"), "row_key", seed, n)
    by = F.when(F.col("paraphrase_of").isNull(), "none").otherwise(F.lit(provider))
    columns = sample_columns(F.col("nl_statement"), F.col("formula"), F.col("template_id"), by, F.col("paraphrase_of"))
    judged = ["outcome", "_fix", "_err"] if critique else []
    taken = taken.select(*columns, *judged)
    return critiqued(taken) if critique else taken
