"""Before/after comparison and retry merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.rules import is_retryable
from pairwright.operators.identity import last_seen


def before_after(before: DataFrame, after: DataFrame, before_order: Column, after_order: Column) -> DataFrame:
    """Rows present on both sides with their correction and status change.

    before: id, nl_statement, atl_formula, verified; after: id, atl_formula,
    corrected_atl, status, explanation. The last row of an id counts.
    """
    b = last_seen(before.select("id", "nl_statement", "atl_formula", "verified", before_order.alias("_o")), "id", F.col("_o"))
    a = last_seen(
        after.select("id", "atl_formula", "corrected_atl", "status", "explanation", after_order.alias("_o")), "id", F.col("_o")
    ).withColumnRenamed("atl_formula", "translated")
    fixed = F.coalesce(F.col("corrected_atl"), F.lit("")) != ""
    new = F.when(fixed, F.col("corrected_atl")).otherwise(F.coalesce(F.col("translated"), F.lit("")))
    now = F.coalesce(F.col("status"), F.lit("unknown"))
    return b.drop("_o").join(a.drop("_o"), "id").select(
        "id",
        "nl_statement",
        F.col("atl_formula").alias("before_atl"),
        new.alias("after_atl"),
        F.coalesce("explanation", F.lit("N/A")).alias("reason"),
        (fixed & ~F.col("atl_formula").eqNullSafe(new)).alias("is_correction"),
        (~F.col("verified").eqNullSafe(now == "verified")).alias("is_status_change"),
        F.when(F.col("verified"), "verified").otherwise("unverified").alias("before_status"),
        now.alias("after_status"),
    )


def change_counts(before: DataFrame, after: DataFrame, compared: DataFrame) -> DataFrame:
    """One row: sizes, corrections, status changes."""
    return compared.agg(
        F.count_if("is_correction").alias("corrections_applied"),
        F.count_if("is_status_change").alias("status_changes"),
    ).select(
        before.agg(F.count(F.lit(1))).scalar().alias("total_before"),
        after.agg(F.count(F.lit(1))).scalar().alias("total_after"),
        "corrections_applied",
        "status_changes",
    )


def retry_merge(verified: DataFrame, rejected: DataFrame, retried: DataFrame) -> DataFrame:
    """Both output sets after a retry.

    Retried rows replace the retryable ones by their own status. What counts as
    retryable is a predicate of the row, so nothing is joined.
    """
    kept = rejected.filter(~is_retryable(F.col("rejection_reasons"), F.col("verification_notes")))
    return verified.unionByName(kept, allowMissingColumns=True).unionByName(retried, allowMissingColumns=True)
