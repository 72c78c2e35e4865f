import pytest
from cases import odd_rows
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
    # Names that the operators use inside.
    *[T.StructField(n, T.StringType()) for n in ("id", "_id", "_key", "text_key", "cls", "node", "Size", "hash", "row", "places", "_places", "bucket", "found_spans", "kept_words", "n_words", "KEPT")],
])


def frame(spark, rows):
    """documents of (doc_id, text[, source]) with further columns of clashing names."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s") + ("x",) * 16 for r in rows], SCHEMA)


@pytest.fixture
def odd(spark):
    return frame(spark, odd_rows())


@pytest.fixture
def empty(spark):
    return frame(spark, [])


@pytest.fixture
def make(spark):
    return lambda rows: frame(spark, rows)
