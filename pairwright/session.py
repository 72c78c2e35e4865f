"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


_LOCAL_DIRS: dict[str, str] = {}


def build_session(app: str = "pairwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is written for.

    On a cluster the submit command sets master, memory and partition counts;
    AQE then sizes shuffles, turns small sides into broadcasts from their
    measured size and splits skewed join partitions.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # large expressions are built faster when their Python lines are not kept for error messages
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.dataFrameQueryContext.enabled": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="pairwright-")
    return _LOCAL_DIRS[app]


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh run folder below the shared folder; nothing is ever rewritten in place."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


#: Splits of a scan that may be dealt anew.
FEW_SPLITS = 8


#: Narrow rows that a task works on.
ROWS_OF_TASK = 100_000


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for costly row-wise work on a scan of a few splits.

    A file with one row group is one task however many byte ranges and cores
    there are; what is moved is ``FEW_SPLITS`` splits at most. All other tables
    are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= min(cores, FEW_SPLITS) else df


def spread_rows(df: DataFrame, rows: int = ROWS_OF_TASK) -> DataFrame:
    """The same for narrow rows of a table of any size: the number of tasks grows with the rows.

    Splits of a scan may be as few as the cores, and those without the begin of
    a row group are empty. Rows are counted, which reads footers of Parquet
    files, and all are dealt anew, a bounded number to a task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)))


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back.

    Used after model inference, whose answers must not be computed twice.
    A written table survives the loss of any executor.
    """
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dimension(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    """A configuration table.

    Goes in through Arrow as a local relation, so Catalyst knows its exact size
    and joins it by broadcast only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))
