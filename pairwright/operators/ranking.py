"""Ranks and prefix sums over whole tables without a single-task window.

A plain window without partition columns (or with a hot partition) sorts all
its rows in one task. Here rows are first put into many order-preserving
buckets, the buckets are counted, and only rows of one bucket are ever sorted
together. Nulls are values like others: a null group is a group, a null order
value comes first.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwright.functions.identity import seeded
from pairwright.session import cut_lineage

HASH_DIGITS = 4  # 65,536 buckets of equal expected size
ROWS_PER_BUCKET = 2_000_000
#: Rows and bytes up to which a small table may pass through the driver.
FEW_ROWS, FEW_BYTES = 10_000, 1 << 20
#: Bins of a range in the search for an order statistic, rows of a range that are sorted; the largest double.
BINS, ROWS_SORTED, LARGEST = 4096, 100_000, sys.float_info.max


def measured(df: DataFrame, rows: int = FEW_ROWS, size: int = FEW_BYTES) -> DataFrame:
    """Compute a table that is expected to be small once, and let its real size be known.

    Up to ``rows`` rows of ``size`` bytes come back as a local relation; a larger
    table is written to the shared folder. Either way Catalyst knows the size,
    broadcasts it below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it
    otherwise.
    """
    first = df.limit(rows + 1).toArrow()
    if first.num_rows <= rows and first.nbytes <= size:
        return df.sparkSession.createDataFrame(first, df.schema)
    return cut_lineage(df, "measured")


def with_columns_of(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys of ``rows`` stay."""
    renamed = side.select(*[F.col(k).alias(f"_key_{k}") if k in keys else F.col(k) for k in side.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return rows.join(renamed, on, how).drop(*[f"_key_{k}" for k in keys])


def running_total(
    df: DataFrame,
    order: str,
    weight: Column,
    name: str,
    groups: list[str] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Adds the sum of ``weight`` over all earlier rows (of the group).

    ``order`` is unique within a group, but for nulls, which come first in any
    order. Rows are dealt by ranges of (group, order), as many as their number
    asks for, and written with the number of their range, so that offsets and
    rows agree whatever happens to a task.
    """
    groups = groups or []
    parts = max(1, -(-df.count() // rows_per_bucket))
    rows = df.withColumn("_w", weight)
    if parts == 1:
        rows = rows.withColumn("_b", F.lit(0))
    else:
        # rows that share an order value, as those without one may, are split by what else they hold
        tie = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])
        rows = cut_lineage(rows.repartitionByRange(parts, *groups, order, tie).withColumn("_b", F.spark_partition_id()), "ranges")
    sums = rows.groupBy(*groups, "_b").agg(F.sum("_w").alias("_sum"))
    # one row per group and range
    upto = W.partitionBy(*groups).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*groups, "_b", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_off"))
    inner = W.partitionBy(*groups, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum("_w").over(inner), F.lit(0)))
    if parts == 1:
        return placed.withColumn(name, F.col("_in")).drop("_w", "_b", "_in")
    joined = with_columns_of(placed, measured(offsets), [*groups, "_b"])
    return joined.withColumn(name, F.col("_off") + F.col("_in")).drop("_w", "_b", "_off", "_in")


def dense_index(df: DataFrame, order: str, name: str, groups: list[str] | None = None, **kw) -> DataFrame:
    """Adds the 0-based position of a row in the order (of its group)."""
    return running_total(df, order, F.lit(1).cast("bigint"), name, groups, **kw)


def _beside(rows: DataFrame, side: DataFrame, groups: list[str], how: str = "inner") -> DataFrame:
    """Adds the columns of a table with one row per group; without groups that is one row, whose values are literals."""
    if groups:
        return with_columns_of(rows, side, groups, how)
    row = side.first()
    return rows.withColumns({f.name: F.lit(row[f.name] if row else None).cast(f.dataType) for f in side.schema})


def value_at(
    df: DataFrame,
    value: str,
    groups: list[str],
    position: Callable[[Column], Column],
    name: str,
    rows_per_bucket: int = ROWS_SORTED,
    bins: int = BINS,
) -> DataFrame:
    """Exact order statistic per group of a number: the value at a 0-based position given the group size.

    Each round counts the rows of a group's range in ``bins`` bins of equal
    width and goes on with the bin that has the position, from its least to its
    greatest value. A range of one value is found; what is left once no range
    has more than ``rows_per_bucket`` rows is sorted. So no round keeps more
    than ``bins`` rows for a group, and a value that a third of all rows share
    is one bin. Values and groups are written once, without a shuffle, as rounds
    would compute them anew. Nulls are not counted; a group of nulls alone has
    no row.
    """
    v = F.col(value)
    rows = cut_lineage(df.filter(v.isNotNull()).select(*groups, value), "values")
    span = [F.count(F.lit(1)).alias("_n"), F.min(v).alias("_lo"), F.max(v).alias("_hi")]
    sizes = rows.groupBy(*groups).agg(*span).filter("_n > 0")
    at = measured(sizes.select(*groups, position(F.col("_n")).cast("bigint").alias("_at"), "_n", "_lo", "_hi"))
    at = at.filter((F.col("_at") >= 0) & (F.col("_at") < F.col("_n")))
    # Rounds end when ranges are small, of one value, or of values that are one double.
    wide = (F.col("_n") > rows_per_bucket) & (F.col("_lo").cast("double") / 2 < F.col("_hi").cast("double") / 2)
    while not at.filter(wide).isEmpty():
        at = measured(_refined(rows, at, wide, value, groups, bins).unionByName(at.filter(~wide)))
    same = F.col("_lo") == F.col("_hi")
    found = at.filter(same).select(*groups, F.col("_lo").alias(name))
    rest = at.filter(~same)
    if rest.isEmpty():
        return found
    inside = _beside(rows, rest, groups).filter((v >= F.col("_lo")) & (v <= F.col("_hi")))
    counts = inside.groupBy(*groups, "_at", value).agg(F.count(F.lit(1)).alias("_n"))
    # at most ``rows_per_bucket`` rows of a group, or the values that are one double
    upto = W.partitionBy(*(groups or [F.lit(0)])).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    placed = counts.withColumn("_upto", F.sum("_n").over(upto))
    hit = (F.col("_upto") - F.col("_n") <= F.col("_at")) & (F.col("_at") < F.col("_upto"))
    return placed.filter(hit).select(*groups, F.col(value).alias(name)).unionByName(found)


def _refined(rows: DataFrame, at: DataFrame, wide: Column, value: str, groups: list[str], bins: int) -> DataFrame:
    """One round of ``value_at``: the bin of each wide range that has the position, as the next range."""
    v, x = F.col(value), F.col(value).cast("double")
    far = F.lit(float("inf"))
    # Ends that are infinite or not a number have bins of their own; halves keep the width finite.
    lo, hi = (F.least(F.greatest(F.col(c).cast("double"), F.lit(-LARGEST)), F.lit(LARGEST)) / 2 for c in ("_lo", "_hi"))
    share = F.floor((x / 2 - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins)
    bin_ = F.when(F.isnan(x), bins + 2).when(x == far, bins + 1).when(x == -far, -1).otherwise(F.coalesce(F.least(share, F.lit(bins - 1)), F.lit(0)))
    inside = _beside(rows, at.filter(wide), groups).filter((v >= F.col("_lo")) & (v <= F.col("_hi")))
    span = [F.count(F.lit(1)).alias("_n"), F.min(v).alias("_lo"), F.max(v).alias("_hi")]
    counts = inside.select(*groups, "_at", v, bin_.alias("_bin")).groupBy(*groups, "_at", "_bin").agg(*span)
    upto = W.partitionBy(*(groups or [F.lit(0)])).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    placed = counts.withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
    hit = (F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_n"))
    return placed.filter(hit).select(*groups, (F.col("_at") - F.col("_before")).alias("_at"), "_n", "_lo", "_hi")


def mark_first(
    df: DataFrame,
    key: str,
    seed: int,
    quota: Callable[[Column], Column],
    groups: list[str] | None = None,
    name: str = "taken",
    digits: int = HASH_DIGITS,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Marks an exact number of rows (per group), chosen by the seeded hash of a unique key.

    Rows without a key are told apart by all that they hold; of rows that hold
    the same, or repeat a key, any are taken.

    ``quota`` gives the number from the group size. Rows are counted per hash
    prefix, and only those of the prefix where the quota is reached are put in
    order, to find the last hash that is in. Both passes read the key and the
    groups alone; the rows themselves are compared with that hash and neither
    sorted nor shuffled. Groups of any size are spread over all prefixes.
    """
    groups = groups or []
    own = seeded(F.col(key), seed)
    rows = df.withColumn("_h", own)
    edges = _edges(rows, quota, groups, digits)
    if not edges.filter("_unkeyed").isEmpty():
        rows = df.withColumn("_h", F.coalesce(own, seeded(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])), seed)))
        edges = _edges(rows, quota, groups, digits)
    last = _last_hashes(rows, edges, groups, digits)
    marked = _beside(rows, last, groups).withColumn(name, F.coalesce(F.col("_h") <= F.col("_last"), F.lit(False)))
    shared = last.filter("_take < _same")
    if shared.isEmpty():
        return marked.drop("_h", "_last", "_take", "_same")
    # The quota ends within rows of one hash: they are dealt to ranges, written, and counted off.
    split = F.coalesce((F.col("_h") == F.col("_last")) & (F.col("_take") < F.col("_same")), F.lit(False))
    parts = -(-shared.agg(F.sum("_same")).first()[0] // rows_per_bucket)
    tied = cut_lineage(marked.filter(split).repartition(parts).withColumn("_b", F.spark_partition_id()), "ties")
    sums = tied.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy(*(groups or [F.lit(0)])).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    offsets = measured(sums.select(*groups, F.col("_b").alias("_range"), (F.sum("_n").over(upto) - F.col("_n")).alias("_off")))
    inner = F.row_number().over(W.partitionBy(*groups, "_b").orderBy("_h"))
    placed = with_columns_of(tied.withColumn("_in", inner), offsets.withColumnRenamed("_range", "_b"), [*groups, "_b"])
    counted = placed.withColumn(name, F.col("_off") + F.col("_in") <= F.col("_take"))
    return marked.filter(~split).drop("_h", "_last", "_take", "_same").unionByName(counted.drop("_h", "_last", "_take", "_same", "_b", "_in", "_off"))


def _edges(rows: DataFrame, quota: Callable[[Column], Column], groups: list[str], digits: int) -> DataFrame:
    """Per group: the hash prefix where the quota is reached (null: never), how many rows it gives, and whether a row has no hash."""
    counts = rows.groupBy(*groups, F.substring("_h", 1, digits).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    every = W.partitionBy(*(groups or [F.lit(0)]))
    upto = F.sum("_n").over(every.orderBy("_b").rowsBetween(W.unboundedPreceding, 0))
    steps = counts.select(*groups, "_b", (upto - F.col("_n")).alias("_before"), upto.alias("_upto"), quota(F.sum("_n").over(every)).cast("bigint").alias("_quota"))
    reached = F.when(F.col("_upto") >= F.col("_quota"), F.col("_b"))
    edges = steps.groupBy(*groups).agg(
        F.min(reached).alias("_edge"),
        F.max_by(F.col("_quota") - F.col("_before"), F.when(F.col("_upto") >= F.col("_quota"), -F.col("_upto"))).alias("_left"),
        F.coalesce(F.bool_or(F.col("_b").isNull()), F.lit(False)).alias("_unkeyed"),
    )
    return measured(edges)


def _last_hashes(rows: DataFrame, edges: DataFrame, groups: list[str], digits: int) -> DataFrame:
    """Per group: the last hash that is in, how many of its rows are taken, and how many it has."""
    near = _beside(rows.select(*groups, "_h"), edges.select(*groups, "_edge", "_left"), groups)
    near = near.filter(F.substring("_h", 1, digits) == F.col("_edge"))
    equal = near.groupBy(*groups, "_left", "_h").agg(F.count(F.lit(1)).alias("_same"))
    before = F.sum("_same").over(W.partitionBy(*(groups or [F.lit(0)])).orderBy("_h").rowsBetween(W.unboundedPreceding, 0)) - F.col("_same")
    placed = equal.withColumn("_take", F.col("_left") - before)
    hit = placed.filter((F.col("_take") > 0) & (F.col("_take") <= F.col("_same"))).select(*groups, F.col("_h").alias("_hit"), "_take", "_same")
    # A quota beyond the group takes all hashes, one of nothing takes none.
    found = _beside(edges.select(*groups, "_edge"), hit, groups, "left")
    last = F.coalesce("_hit", F.when(F.col("_edge").isNull(), "g").otherwise(""))
    return measured(found.select(*groups, last.alias("_last"), "_take", "_same"))


def upper_half_median(df: DataFrame, value: str, groups: list[str], name: str, **kw) -> DataFrame:
    """Element at position n // 2 of the sorted values."""
    return value_at(df, value, groups, lambda n: F.floor(n / 2), name, **kw)
