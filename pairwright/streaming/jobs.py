"""Incremental jobs as Structured Streaming.

Each takes a streaming DataFrame. The checkpoint makes a restarted job go on
where it stopped; batch outputs go to a directory named by the batch number,
so a batch that is repeated after a failure overwrites its own output only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairwright.operators.stats import verification_quality
from pairwright.sinks.writers import ROUTES, observed_routes


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """Streaming scan of a parquet table, a file or a folder, with the schema of its files.

    The path is given as a pattern that only matches itself: the file source
    takes a plain path for a folder.
    """
    parent, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{parent}/{{{name}}}")


def append_enriched(
    rows: DataFrame, enrich: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, tasks: int | None = None
) -> StreamingQuery:
    """Enrich and append, exactly once. ``tasks`` spreads costly work on few large input files."""
    rows = rows.repartition(tasks) if tasks else rows
    return (
        enrich(rows)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def insert_absent_stream(rows: DataFrame, key: str, ts: str, delay: str, path: str, checkpoint: str) -> StreamingQuery:
    """First row per key within the watermark; state older than ``delay`` is dropped."""
    return (
        rows.withWatermark(ts, delay)
        .dropDuplicatesWithinWatermark([key])
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def windowed_quality(log: DataFrame, ts: str, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Verification quality per time window and domain."""
    marked = log.withWatermark(ts, delay).withColumn("window", F.window(ts, window))
    return verification_quality(marked, ["window", "domain"]).withColumn("window_start", F.col("window.start")).drop("window")


def snapshot_quality(log: DataFrame, ts: str, path: str, checkpoint: str, window: str = "1 day", delay: str = "1 day") -> StreamingQuery:
    """Writes the windows that a batch changed below ``path``.

    In update mode the watermark drops the state of closed windows, and a batch
    costs what it changes, not what was ever seen.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        windowed_quality(log, ts, window, delay)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(availableNow=True)
        .start()
    )


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each window and domain."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy("window_start", "domain").agg(F.max("batch").alias("batch"))
    on = F.col("n.window_start").eqNullSafe(F.col("r.window_start")) & F.col("n.domain").eqNullSafe(F.col("r.domain")) & (F.col("n.batch") == F.col("r.batch"))
    return rows.alias("r").join(newest.alias("n"), on, "left_semi").drop("batch")


def route_by_status(
    rows: DataFrame, path: str, checkpoint: str, by: str = "verification_status", stats: str | None = None, routes: tuple[str, ...] = ROUTES, measures: dict[str, Column] | None = None
) -> StreamingQuery:
    """Writes each batch partitioned by status, and with ``stats`` each batch's statistics beside it, see ``observed_routes``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        watched, counts = observed_routes(batch, by, routes, measures or {}) if stats else (batch, None)
        watched.write.mode("overwrite").partitionBy(by).parquet(f"{path}/batch={batch_id}")
        if counts:
            counts().write.mode("overwrite").json(f"{stats}/batch={batch_id}")

    return (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(availableNow=True)
        .start()
    )


def routed_stats(spark: SparkSession, stats: str) -> DataFrame:
    """Statistics of all batches, added up by route."""
    rows = spark.read.json(stats).drop("batch")
    return rows.groupBy("route").agg(*[F.sum(c).alias(c) for c in rows.columns if c != "route"])
