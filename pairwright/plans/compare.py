"""Model comparison, re-translation and retry jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions import answers, prompts
from pairwright.functions import formula as fx
from pairwright.functions.rules import formula_errors, is_retryable
from pairwright.operators.changes import retry_merge
from pairwright.operators.inference import Stage
from pairwright.plans.verify import judge


def per_model(statements: DataFrame, models: list[str]) -> DataFrame:
    """Each statement once per model: the model list is a literal, so rows multiply in place."""
    return statements.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def ascii_errors(f: Column) -> Column:
    return formula_errors(fx.to_ascii(f), temporal="boundary", square=False)


def compare_models(statements: DataFrame, models: list[str], ask: Stage, mode: str = "single_colon") -> DataFrame:
    """Long comparison rows: statement columns, model, formula, time, tokens, validity, error."""
    asked = per_model(statements, models).withColumn("_q", prompts.translation(F.col("nl_statement")))
    asked = ask(asked, "_q", "_a", model="model")
    answered = F.col("_a.error").isNull()
    f = F.when(answered, answers.clean_answer(F.col("_a.text"), mode)).otherwise("")
    # a column of its own, outside any condition: there common parts are computed once
    asked = asked.withColumn("_f", f).withColumn("_err", ascii_errors(F.col("_f")))
    errors = F.when(answered, F.col("_err")).otherwise(F.array().cast("array<string>"))
    return asked.select(
        *[c for c in asked.columns if not c.startswith("_")],
        F.col("_f").alias("atl_formula"),
        (F.col("_a.latency_ms") / 1000).alias("response_time"),
        (F.col("_a.prompt_tokens") + F.col("_a.completion_tokens")).alias("tokens_used"),
        (F.col("_a.error").isNull() & (F.size(errors) == 0)).alias("syntax_valid"),
        errors.alias("syntax_errors"),
        F.col("_a.error").alias("error"),
    )


def review_rows(long: DataFrame) -> DataFrame:
    """Review projection: times to 3 places, correctness open."""
    return long.withColumn("response_time", F.bround("response_time", 3)).withColumn(
        "correct", F.lit(None).cast("boolean")
    )


def review_map(translations: Column) -> Column:
    """The same on the map form of a comparison row."""
    return F.transform_values(
        translations, lambda _, t: t.withField("response_time", F.bround(t["response_time"], 3))
    )


def retranslate(rejected: DataFrame, translate: Stage, verify: Stage | None) -> DataFrame:
    """Rejected pairs translated again and judged: improved, same, syntax_error, pending or error."""
    usable = rejected.filter((F.col("nl_statement") != "") & (F.col("atl_formula") != ""))
    asked = usable.withColumn(
        "_q", prompts.training_request(F.col("nl_statement"), F.col("domain"), F.col("agents"))
    )
    got = translate(asked, "_q", "_a")
    failed = F.col("_a.error").isNotNull()
    rows = got.select(
        F.col("id").alias("sample_id"), "nl_statement", "domain", "agents",
        F.col("atl_formula").alias("original_atl"), F.col("atl_generator").alias("original_generator"),
        F.col("rejection_reasons").alias("original_rejection_reasons"),
        F.coalesce(F.trim(F.col("_a.text")), F.lit("")).alias("finetuned_atl"),
        F.col("_a.error").alias("_error"),
    )
    f, failed = F.col("finetuned_atl"), F.col("_error").isNotNull()
    rows = rows.withColumn("_err", ascii_errors(f))
    rows = rows.withColumn("finetuned_syntax_errors", F.when(failed, F.array("_error")).otherwise(F.col("_err")))
    rows = rows.withColumn("finetuned_syntax_valid", F.size("finetuned_syntax_errors") == 0)
    valid = F.col("finetuned_syntax_valid")
    if verify is None:
        rows = rows.withColumn("_v", F.lit(None).cast("struct<verdict:string,confidence:double,issues:array<string>,explanation:string>"))
    else:
        # only valid formulas are judged
        q = F.when(valid, prompts.verdict(F.col("nl_statement"), f, F.col("domain")))
        rows = verify(rows.withColumn("_q", q), "_q", "_a").withColumn("_t", F.col("_a.text")).drop("_q", "_a")
        rows = rows.withColumn("_v", F.when(valid, answers.verdict(F.col("_t"), "UNKNOWN"))).drop("_t")
    v = F.col("_v")
    status = retranslation_status(failed, valid, v["verdict"])
    return rows.select(
        *[c for c in rows.columns if not c.startswith("_")],
        v["verdict"].alias("finetuned_verdict"),
        v["confidence"].alias("finetuned_confidence"),
        v["issues"].alias("finetuned_issues"),
        v["explanation"].alias("finetuned_notes"),
        status.alias("status"),
        (status == "improved").alias("improved"),
    )


def retranslation_status(failed: Column, valid: Column, verdict: Column) -> Column:
    return (
        F.when(failed, "error")
        .when(~valid, "syntax_error")
        .when(verdict.isNull(), "pending")
        .when(verdict == "ACCEPT", "improved")
        .otherwise("same")
    )


def retry_rejections(verified: DataFrame, rejected: DataFrame, ask: Stage, default_verifier: str = "anthropic") -> tuple[DataFrame, DataFrame]:
    """(all rows after the retry, the retried rows). The verifier of a row stays the same and is the model that is asked."""
    again = rejected.filter(is_retryable(F.col("rejection_reasons"), F.col("verification_notes")))
    again = again.withColumn("verifier", F.coalesce("verifier", F.lit(default_verifier)))
    retried = judge(again, ask).withColumn("retry_attempt", F.lit(True))
    return retry_merge(verified, rejected, retried), retried

