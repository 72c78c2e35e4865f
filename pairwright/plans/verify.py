"""Verification of a table: rules, verdict, independent translation, decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright import vocab
from pairwright.functions import answers, prompts, rules
from pairwright.functions import formula as fx
from pairwright.operators.choose import halves
from pairwright.operators.inference import Stage
from pairwright.operators.keep import keep_where


def verify_table(rows: DataFrame, ask: Stage, threshold: float = 0.7, cross_check: bool = True) -> DataFrame:
    """rows: sample_id, nl_statement, atl_formula.

    Rows that fail the rules have no prompt, so the model never sees them; all
    rows go through in one pass.
    """
    nl, f = F.col("nl_statement"), F.col("atl_formula")
    valid = F.col("syntax_check.valid")
    out = rows.withColumn("syntax_check", rules.check_structure(f))
    out = ask(out.withColumn("_q", F.when(valid, prompts.verification(nl, f))), "_q", "_a")
    out = out.withColumn("_t", F.col("_a.text")).withColumn("_e", F.col("_a.error").isNotNull()).drop("_q", "_a")
    out = out.withColumn("semantic_check", F.when(valid, answers.semantic_check(F.col("_t")))).drop("_t")
    if cross_check:
        out = ask(out.withColumn("_q", F.when(valid, prompts.cross_translation(nl))), "_q", "_a")
        out = out.withColumn("cross_model_atl", F.trim(F.col("_a.text"))).drop("_q", "_a")
        out = out.withColumn("cross_model_agreement", fx.same_formula(f, F.col("cross_model_atl")))
    else:
        none = F.lit(None)
        out = out.withColumn("cross_model_atl", none.cast("string")).withColumn("cross_model_agreement", none.cast("boolean"))
    sem = F.col("semantic_check")
    status = rules.status_by_confidence(
        valid, sem["matches"], sem["confidence"], F.col("cross_model_agreement"), F.col("_e"), threshold
    )
    return out.withColumn("status", status).withColumn("corrected_atl", rules.corrected(sem["suggested_fix"])).drop("_e")


def auto_reject(rows: DataFrame) -> DataFrame:
    """Rows with status, verifier, reasons and notes filled where syntax_valid is false, null elsewhere."""
    bad = ~F.col("syntax_valid")
    return rows.select(
        "*",
        F.when(bad, "rejected").alias("verification_status"),
        F.when(bad, "syntax_check").alias("verifier"),
        F.when(bad, F.col("syntax_errors")).alias("rejection_reasons"),
        F.when(bad, F.array(F.lit(vocab.NOTE_AUTO_REJECTED))).alias("verification_notes"),
    )


JUDGED = {
    "verification_verdict", "verification_confidence", "verification_notes", "verification_status", "rejection_reasons",
}


def judge(rows: DataFrame, ask: Stage, accept_only: bool = True, fallback: str = "REJECT") -> DataFrame:
    """Verdict columns and status; rows: nl_statement, atl_formula, domain, verifier.

    ``verifier`` names the model that judges a row.
    """
    asked = rows.withColumn("_q", prompts.verdict(F.col("nl_statement"), F.col("atl_formula"), F.col("domain")))
    asked = ask(asked, "_q", "_a", model="verifier" if "verifier" in rows.columns else None)
    v = answers.verdict(F.col("_a.text"), fallback)
    failed = F.col("_a.error").isNotNull()
    asked = asked.withColumn("_v", v)
    verdict = F.when(failed, "ERROR").otherwise(F.col("_v.verdict"))
    status = rules.status_accept_only(verdict) if accept_only else rules.status_by_verdict(verdict)
    out = asked.select(
        *[c for c in rows.columns if c not in JUDGED],
        verdict.alias("verification_verdict"),
        F.when(failed, 0.0).otherwise(F.col("_v.confidence")).alias("verification_confidence"),
        F.array(F.when(failed, "Verification failed").otherwise(F.col("_v.explanation"))).alias("verification_notes"),
        status.alias("verification_status"),
        F.when(failed, F.array("_a.error")).otherwise(F.col("_v.issues")).alias("_issues"),
    )
    reasons = F.when(F.col("verification_status") == "rejected", F.col("_issues"))
    return out.withColumn("rejection_reasons", reasons).drop("_issues")


def assign_verifiers(valid: DataFrame, key: str, seed: int, names: tuple[str, str]) -> DataFrame:
    """Half of each generator's rows go to its own model, the other half to the other one."""
    me = F.col("atl_generator")
    other = F.when(me == names[0], names[1]).otherwise(names[0])
    return halves(valid, key, seed, "verifier", me, other, ["atl_generator"])


def critique_pairs(rows: DataFrame, ask: Stage) -> DataFrame:
    """Rows that pass a critique, are fixed by it, or could not be checked; failed ones are dropped."""
    return critiqued(critique_outcomes(rows, ask))


def critique_outcomes(rows: DataFrame, ask: Stage) -> DataFrame:
    """Rows that a critique does not drop, as they were, with the outcome, the formula it suggests and its error.

    ``critiqued`` makes the columns of such rows; a plan that keeps few of them can do so last.
    """
    asked = ask(rows.withColumn("_q", prompts.critique(F.col("nl_statement"), F.col("atl_formula"))), "_q", "_a")
    return _with_outcome(asked, F.col("_a.text"), F.col("_a.error")).drop("_q", "_a")


def apply_critique(rows: DataFrame, answer, error) -> DataFrame:
    return critiqued(_with_outcome(rows, answer, error))


def _with_outcome(rows: DataFrame, answer, error) -> DataFrame:
    # the object is a column of its own, so that it is read once and in generated code
    c = rows.withColumn("_read", answers.critique_object(answer)).withColumn("_err", error)
    c = c.withColumn("_c", answers.critique_fields(F.col("_read"), answer))
    c = c.withColumn("_ok", F.col("_c.ok")).withColumn("_fix", F.col("_c.suggested_fix")).drop("_c", "_read")
    fix = F.col("_fix")
    fix_ok = F.when(fix.isNotNull(), rules.check_structure(fix)["valid"]).otherwise(False)
    c = c.withColumn("outcome", rules.critique_outcome(F.col("_ok"), fix, fix_ok, F.col("_err").isNotNull())).drop("_ok")
    return keep_where(c, F.col("outcome") != "drop")


def critiqued(rows: DataFrame) -> DataFrame:
    """Formula, validity, confidence and notes of rows from ``critique_outcomes``."""
    o, fix = F.col("outcome"), F.col("_fix")
    drop = {"atl_formula", "atl_unicode", "syntax_valid", "confidence", "verification_notes", "outcome", "_fix", "_err"}
    formula = F.when(o == "fixed", fx.to_ascii(fix)).otherwise(F.col("atl_formula"))
    return rows.select(
        *[x for x in rows.columns if x not in drop],
        formula.alias("atl_formula"),
        fx.to_printed(formula).alias("atl_unicode"),
        (o != "unchecked").alias("syntax_valid"),
        F.when(o == "keep", 1.0).when(o == "fixed", 0.8).otherwise(0.5).alias("confidence"),
        F.when(o == "fixed", F.array(F.lit(vocab.NOTE_FIXED)))
        .when(o == "unchecked", F.array(F.concat(F.lit("Critique error: "), F.col("_err"))))
        .otherwise(F.array().cast("array<string>"))
        .alias("verification_notes"),
        "outcome",
    )
