"""Filtering and exploding by costly computed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition, with the condition computed where it stands.

    A plain filter is pushed below the columns it is built from, which copies
    their whole expressions into the condition, once per use. For a condition
    on columns such as a rule check, plans and generated code grow out of
    bounds; a generator is not moved.
    """
    marked = df.withColumn("_ok", condition)
    return marked.withColumn("_hit", F.explode(F.when(F.col("_ok"), F.array(F.lit(True))))).drop("_ok", "_hit")


def explode_computed(name: str) -> Column:
    """explode() of a computed array column, without the size filter that would compute the array a second time."""
    return F.explode(F.when(F.size(name) > 0, F.col(name)))
