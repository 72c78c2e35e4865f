"""Spark helpers of the operators: bounded batches, row keys, tables in the shared folder."""

from __future__ import annotations

import ctypes
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.session import shared_dir

#: Rows and bytes of one Arrow batch between the JVM and a Python worker.
BATCH_ROWS, BATCH_BYTES = "4096", "16m"


def bounded(spark: SparkSession) -> None:
    """Keeps Arrow batches small whatever the texts' lengths are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def send(spark: SparkSession, value):
    """Broadcasts a data object as its fields: workers then need no module to read it. The caller knows its size."""
    return spark.sparkContext.broadcast(None if value is None else vars(value))


def kept_table(df: DataFrame, label: str) -> DataFrame:
    """Writes once to the folder that all executors share and reads back: lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def others(df: DataFrame, *names: str) -> list[str]:
    """Columns whose names are not among ``names``; Spark does not heed case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def named(name: str) -> Column:
    """A column by its name, which may have dots and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_key(text: str) -> Column:
    """Tells texts of one id apart. Rows with equal id and equal text have equal results in all operators here."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Returns freed memory to the system: idle Python workers live on beside the next ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(fn):
    """A mapInArrow function that leaves no memory behind in its worker."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def lean_group(fn):
    """The same for an applyInArrow function."""

    def run(table):
        try:
            return fn(table)
        finally:
            give_back()

    return run


def packed(values: np.ndarray) -> bytes:
    """Numbers as bytes, all first bytes, then all second ones, and so on: high bytes compress."""
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes() if len(values) else b""


def unpacked(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def by_group(group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts the groups 0..n-1 one after the other and keeps the order inside, and where each begins."""
    kind = np.uint16 if n <= 1 << 16 else np.uint32
    order = np.argsort(group.astype(kind), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(group, minlength=n))])


def blob_rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def in_blocks(total: int, limit: int) -> int:
    """Blocks needed for ``total`` bytes when one holds ``limit``."""
    return max(1, -(-int(total) // limit))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
