"""Splits, samples and assignments; every random choice is a seeded hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwright.functions.identity import seeded
from pairwright.operators.ranking import mark_first, measured, with_columns_of


def halves(df: DataFrame, key: str, seed: int, name: str, first: Column, rest: Column, groups: list[str] | None = None) -> DataFrame:
    """Exact halves (per group): floor(n/2) rows get ``first``, the others ``rest``."""
    marked = mark_first(df, key, seed, lambda n: F.floor(n / 2), groups, "_first")
    return marked.withColumn(name, F.when(F.col("_first"), first).otherwise(rest)).drop("_first")


def split_exact(df: DataFrame, key: str, seed: int, fraction: float) -> DataFrame:
    """Column ``split``: max(1, floor(n * fraction)) rows are validation, the others train."""
    size = lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(fraction)))
    marked = mark_first(df, key, seed, size, name="_val")
    return marked.withColumn("split", F.when(F.col("_val"), "validation").otherwise("train")).drop("_val")


def split_by_hash(df: DataFrame, key: str, seed: int, fraction: float) -> DataFrame:
    """Column ``split`` by hash threshold: no counting pass, sizes hold in expectation."""
    level = F.conv(F.substring(seeded(F.col(key), seed), 1, 8), 16, 10).cast("bigint") % 10_000
    return df.withColumn("split", F.when(level < int(fraction * 10_000), "validation").otherwise("train"))


def take_random(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """Exactly n rows (all, when there are fewer)."""
    return mark_first(df, key, seed, lambda _: F.lit(n), name="_in").filter("_in").drop("_in")


def take_per_group(df: DataFrame, key: str, seed: int, k: int | Callable[[Column], Column], groups: list[str]) -> DataFrame:
    """k rows of every group."""
    quota = k if callable(k) else (lambda _: F.lit(k))
    return mark_first(df, key, seed, quota, groups, "_in").filter("_in").drop("_in")


def stratified_quotas(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """Rows to draw per stratum: max(1, floor(n * share)), the last stratum takes what is left.

    Strata come in name order; a quota never exceeds the stratum or the remainder.
    """
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    # one row per stratum from here on
    every, along = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy(stratum)
    before = along.rowsBetween(W.unboundedPreceding, -1)
    sizes = (
        sizes.withColumn("total", F.sum("size").over(every))
        .withColumn("n", F.least(F.lit(n), F.col("total")))
        .withColumn("last", F.lead(stratum).over(along).isNull())
        .withColumn("share", F.greatest(F.lit(1), F.floor(F.col("n") * (F.col("size") / F.col("total")))))
        # what a stratum before took is its share, cut to its size
        .withColumn("taken", F.least(F.col("share"), F.col("size")))
        .withColumn("used", F.coalesce(F.sum("taken").over(before), F.lit(0)))
    )
    left = F.greatest(F.lit(0), F.col("n") - F.col("used"))
    wanted = F.when(F.col("last"), left).otherwise(F.col("share"))
    return sizes.select(stratum, "size", F.least(wanted, F.col("size"), left).cast("bigint").alias("quota"))


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, seed: int) -> DataFrame:
    """Exact stratified sample with the quotas above."""
    quotas = measured(stratified_quotas(df, stratum, n).select(stratum, "quota"))
    with_quota = with_columns_of(df, quotas, [stratum])
    marked = mark_first_by(with_quota, key, seed, stratum)
    return marked.filter("_in").drop("_in", "quota")


def mark_first_by(df: DataFrame, key: str, seed: int, stratum: str) -> DataFrame:
    """mark_first with a quota column that is constant within the stratum."""
    return mark_first(df, key, seed, lambda _: F.col("quota"), [stratum, "quota"], "_in")


def round_robin(df: DataFrame, index: str, lists: dict[str, list[str]]) -> DataFrame:
    """Columns that cycle through fixed lists by the row's index."""
    out = df
    for name, values in lists.items():
        arr = F.array(*[F.lit(v) for v in values])
        out = out.withColumn(name, F.element_at(arr, (F.pmod(F.col(index), F.lit(len(values))) + 1).cast("int")))
    return out


def generator_quota(df: DataFrame, index: str, total: Column | int, names: tuple[str, str], width: int = 3) -> DataFrame:
    """First floor(n/2) of n statements come from one generator, the rest from the other; ids count from 1."""
    total = F.lit(total) if isinstance(total, int) else total
    first = F.col(index) < F.floor(total / 2)
    return df.withColumn("generator", F.when(first, names[0]).otherwise(names[1])).withColumn(
        "sample_id", F.format_string(f"sample_%0{width}d", F.col(index).cast("bigint") + 1)
    )


def first_successes(df: DataFrame, attempt: str, ok: Column, n: int, groups: list[str]) -> DataFrame:
    """Of at most 3n attempts per group, the first n successful ones.

    A group holds at most 3n rows after the attempt bound, so the window is bounded.
    """
    by_attempt = W.partitionBy(*groups).orderBy(attempt)
    return (
        df.filter(F.col(attempt) < 3 * n)
        .filter(ok)
        .withColumn("kept_no", F.row_number().over(by_attempt))
        .filter(F.col("kept_no") <= n)
    )
