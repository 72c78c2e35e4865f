"""The next row of a sequence, also where one sequence holds most of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_next(df: DataFrame, keys: list[str], order: str, chunk: Column, carry: list[str]) -> DataFrame:
    """Adds ``next_<column>`` for every column of ``carry``: ``lead()`` over keys by order.

    A sequence is cut into chunks (``chunk`` must not decrease along the
    order). Each chunk is sorted on its own, with the first row of the chunk
    after it appended; only these first rows are ordered per sequence.
    """
    rows = df.withColumn("_chunk", chunk)
    head = F.min_by(F.struct(order, *[c for c in carry if c != order]), order).alias("_head")
    heads = rows.groupBy(*keys, "_chunk").agg(head)
    before = F.lag("_chunk").over(W.partitionBy(*keys).orderBy("_chunk"))
    follow = (
        heads.withColumn("_to", before)
        .filter(F.col("_to").isNotNull())
        .select(*keys, F.col("_to").alias("_chunk"), "_head.*", F.lit(True).alias("_extra"))
    )
    both = rows.withColumn("_extra", F.lit(False)).unionByName(follow, allowMissingColumns=True)
    along = W.partitionBy(*keys, "_chunk").orderBy(order)
    for c in carry:
        both = both.withColumn(f"next_{c}", F.lead(c).over(along))
    return both.filter(~F.col("_extra")).drop("_extra", "_chunk")
