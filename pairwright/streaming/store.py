"""A stored table with one row per key, and streams that add the rows it does not have yet.

Below the store's folder, ``rows/batch=../key_part=..`` holds what each batch
added and ``counts/batch=..`` what came of its rows. A batch looks the keys up in
the store itself, however old they are, and only in the parts that its own keys fall
into. It writes to a folder named by the stream and the batch number and never
counts that folder as known, so a batch that is repeated after a failure replaces its
own output. One stream writes to a store at a time.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pairwright.operators.identity import first_seen
from pairwright.session import cut_lineage

OWN = ("batch", "key_part")


def _part(key: str, digits: int) -> Column:
    return F.concat(F.lit("p"), F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, digits))


def _stored(spark: SparkSession, path: str, fields: list[T.StructField]) -> DataFrame:
    schema = T.StructType([*fields, *[T.StructField(n, T.StringType()) for n in OWN]])
    return spark.read.schema(schema).parquet(f"{path}/rows")


def _checked(rows: DataFrame) -> DataFrame:
    taken = [c for c in rows.columns if c.lower() in OWN]
    if taken:
        raise ValueError(f"a stored table has no columns named {taken}")
    return rows


def create_store(rows: DataFrame, key: str, order: Column, path: str, digits: int = 2) -> None:
    """A new store with the first row of each key. It can be empty. Null is a key like others.

    Keys are dealt to parts by the first ``digits`` hexadecimal digits of their hash:
    as many parts as a lookup of few keys should leave out of the store.
    """
    rows.sparkSession.range(1).select(F.lit(digits).alias("digits")).write.parquet(f"{path}/layout")
    first = first_seen(_checked(rows), key, order).withColumn("key_part", _part(key, digits))
    first.hint("rebalance", "key_part").write.partitionBy("key_part").parquet(f"{path}/rows/batch=start")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All rows, with the batch that added them."""
    return spark.read.parquet(f"{path}/rows").drop("key_part")


def batch_counts(spark: SparkSession, path: str) -> DataFrame:
    """stream, batch_no, added, duplicates of all batches that went in."""
    return spark.read.parquet(f"{path}/counts").drop("batch")


def add_batch(batch: DataFrame, key: str, order: Column, path: str, stream: str, batch_no: int) -> None:
    """Adds the first row of each key that no other batch has brought, and writes the counts."""
    spark, name = batch.sparkSession, f"{stream}-{batch_no}"
    fields = batch.schema.fields
    digits = spark.read.parquet(f"{path}/layout").first()[0]
    # written once: it is looked through for parts, keys and counts
    one = cut_lineage(first_seen(_checked(batch), key, order, copies="_copies").withColumn("key_part", _part(key, digits)), "batch")
    parts = [r["key_part"] for r in one.select("key_part").distinct().collect()]  # 16 ** digits at most
    known = _stored(spark, path, fields).where(F.col("key_part").isin(parts) & (F.col("batch") != name)).select(F.col(key).alias("_known"))
    new = one.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti").drop("_copies")
    new.hint("rebalance", "key_part").write.mode("overwrite").partitionBy("key_part").parquet(f"{path}/rows/batch={name}")
    added = _stored(spark, path, fields).where(F.col("batch") == name).count()
    seen = one.agg(F.coalesce(F.sum("_copies"), F.lit(0))).first()[0]
    counts = spark.range(1).select(F.lit(stream).alias("stream"), F.lit(batch_no).cast("long").alias("batch_no"), F.lit(added).cast("long").alias("added"), F.lit(seen - added).cast("long").alias("duplicates"))
    _write_counts(counts, f"{path}/counts/batch={name}")


def _write_counts(counts: DataFrame, path: str) -> None:
    counts.write.mode("overwrite").parquet(path)


def insert_into_store(rows: DataFrame, key: str, order: Column, path: str, checkpoint: str) -> StreamingQuery:
    """Adds the rows of a stream whose key the store does not have; the first by ``order`` of those that come together.

    The checkpoint names the stream: started again with it, the job goes on where
    it stopped.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def save(batch: DataFrame, batch_id: int) -> None:
        add_batch(batch, key, order, path, stream, batch_id)

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()
