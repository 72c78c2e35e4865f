"""Daily statistics that are kept as sketches and merged, so no day is read twice.

A table of sketches has one row per group and period. Distinct counts are HLL
sketches, order statistics KLL sketches, both built in map-side combined
aggregates; merging reads sketches alone. A sketch has a few KB whatever it saw,
and gives the same figure in whatever order sketches are merged, within its error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: lgK of HLL sketches (relative standard error 1.04 / sqrt(2^lgK), 0.8 %), K of KLL sketches (rank error below 1 %).
HLL_BITS, KLL_SIZE = 14, 400


def hll_error(bits: int = HLL_BITS) -> float:
    """Relative standard error of a distinct count."""
    return 1.04 / 2 ** (bits / 2)


def sketches(
    rows: DataFrame,
    by: list[str],
    distinct: dict[str, str],
    quantiles: dict[str, Column] | None = None,
    bits: int = HLL_BITS,
    size: int = KLL_SIZE,
) -> DataFrame:
    """One row per group: ``rows``, a distinct sketch of each column, and an order sketch of each number.

    ``distinct`` names columns, of which arrays count element by element; an
    array never multiplies the rows of the others, as each is sketched in an
    aggregate of its own over narrow columns. Nulls, and numbers that are none, are not
    counted; what has no value has a null sketch.
    """
    kinds = dict(rows.dtypes)
    plain = {k: c for k, c in distinct.items() if not kinds[c].startswith("array")}
    lists = {k: c for k, c in distinct.items() if k not in plain}
    number = {k: F.when(~F.isnan(c.cast("double")), c.cast("double")) for k, c in (quantiles or {}).items()}
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.when(F.count(c) > 0, F.hll_sketch_agg(F.col(c).cast("string"), bits)).alias(f"distinct_{k}") for k, c in plain.items()]
    aggs += [F.when(F.count(c) > 0, F.kll_sketch_agg_double(c, size)).alias(f"order_{k}") for k, c in number.items()]
    out = rows.groupBy(*by).agg(*aggs)
    for k, c in lists.items():
        one = rows.select(*by, F.explode(c).alias("_x")).filter("_x is not null")
        part = one.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.hll_sketch_agg(F.col("_x").cast("string"), bits).alias(f"distinct_{k}"))
        on = reduce(lambda a, b: a & F.col(b).eqNullSafe(F.col(f"_{b}")), by, F.lit(True))
        out = out.join(part, on, "left").drop(*[f"_{b}" for b in by])
    return out


def merged(table: DataFrame, by: list[str], size: int = KLL_SIZE) -> DataFrame:
    """Sketches of several periods as one per group of ``by``."""
    aggs = [F.sum("rows").alias("rows")]
    for c in table.columns:
        some = F.count(c) > 0
        if c.startswith("distinct_"):
            aggs.append(F.when(some, F.hll_union_agg(c)).alias(c))
        elif c.startswith("order_"):
            aggs.append(F.when(some, F.kll_merge_agg_double(c, size)).alias(c))
    return table.groupBy(*by).agg(*aggs)


def estimates(table: DataFrame, ranks: dict[str, float] | None = None) -> DataFrame:
    """Figures of a table of sketches: ``distinct_*`` as longs, and ``order_*`` as one double for each rank, by its name."""
    ranks = ranks or {"median": 0.5}
    out = []
    for c in table.columns:
        if c.startswith("distinct_"):
            out.append(F.coalesce(F.hll_sketch_estimate(c), F.lit(0)).cast("long").alias(c))
        elif c.startswith("order_"):
            out += [F.kll_sketch_get_quantile_double(c, F.lit(r)).alias(f"{c[6:]}_{k}") for k, r in ranks.items()]
        else:
            out.append(F.col(c))
    return table.select(*out)
