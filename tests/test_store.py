"""Streams into a stored table: what is there already, late rows, failures, restarts."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from pairwright.streaming import jobs, store


def deliver(spark, rows, path):
    spark.createDataFrame(rows, "k string, n long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{path}/in")


def run(spark, path, **kw):
    query = store.insert_into_store(jobs.stream_table(spark, f"{path}/in"), "k", F.col("n"), f"{path}/store", f"{path}/checkpoint")
    query.awaitTermination()
    return query


def state(spark, path):
    rows = {(r.k, r.n) for r in store.read_store(spark, f"{path}/store").collect()}
    assert store.read_store(spark, f"{path}/store").count() == len(rows)
    return rows, {r.batch_no: (r.added, r.duplicates) for r in store.batch_counts(spark, f"{path}/store").collect()}


def day(d):
    import datetime as dt

    return dt.datetime(2024, 1, d)


@pytest.fixture
def path(spark, tmp_path):
    start = spark.createDataFrame([("a", 1, day(1)), ("a", 0, day(1)), ("b", 1, day(1))], "k string, n long, ts timestamp")
    store.create_store(start, "k", F.col("n"), f"{tmp_path}/store", digits=1)
    return str(tmp_path)


def test_known_late_and_repeated_rows(spark, path):
    deliver(spark, [("a", 5, day(20)), ("c", 7, day(20)), ("c", 6, day(20)), (None, 3, day(20)), (None, 2, day(20))], path)
    run(spark, path)
    # far older than anything that a watermark would still know
    deliver(spark, [("c", 1, day(2)), ("b", 0, day(2)), ("d", 1, day(2)), (None, 1, day(2))], path)
    run(spark, path)
    run(spark, path)
    rows, counts = state(spark, path)
    assert rows == {("a", 0), ("b", 1), ("c", 6), (None, 2), ("d", 1)}
    assert counts == {0: (2, 3), 1: (1, 3)}


def test_a_batch_that_failed_after_its_rows_were_written(spark, path, monkeypatch):
    deliver(spark, [("c", 1, day(3)), ("c", 2, day(3)), ("a", 1, day(3))], path)

    def fail(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_write_counts", fail)
        with pytest.raises(StreamingQueryException):
            run(spark, path)
    deliver(spark, [("c", 3, day(3)), ("e", 1, day(3))], path)
    run(spark, path)
    rows, counts = state(spark, path)
    assert rows == {("a", 0), ("b", 1), ("c", 1), ("e", 1)}
    assert sum(a for a, _ in counts.values()) == 2 and sum(d for _, d in counts.values()) == 3


def test_two_streams_do_not_replace_each_other(spark, path):
    rows = [spark.createDataFrame(r, "k string, n long, ts timestamp") for r in ([("c", 1, day(3))], [("d", 1, day(3)), ("c", 2, day(3))])]
    for name, batch in zip(("one", "two"), rows, strict=True):
        store.add_batch(batch, "k", F.col("n"), f"{path}/store", name, 0)
    assert state(spark, path)[0] == {("a", 0), ("b", 1), ("c", 1), ("d", 1)}


def test_empty_store_and_only_known_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "k string, n long")
    store.create_store(empty, "k", F.col("n"), f"{tmp_path}/s", digits=1)
    batch = spark.createDataFrame([("x", 1)], "k string, n long")
    store.add_batch(batch, "k", F.col("n"), f"{tmp_path}/s", "s", 0)
    store.add_batch(batch, "k", F.col("n"), f"{tmp_path}/s", "s", 1)
    store.add_batch(empty, "k", F.col("n"), f"{tmp_path}/s", "s", 2)
    assert [tuple(r) for r in store.read_store(spark, f"{tmp_path}/s").select("k", "n").collect()] == [("x", 1)]
    assert sorted((r.batch_no, r.added, r.duplicates) for r in store.batch_counts(spark, f"{tmp_path}/s").collect()) == [(0, 1, 0), (1, 0, 1), (2, 0, 0)]


def test_only_the_parts_of_the_batch_are_read(spark, tmp_path):
    many = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("n"))
    store.create_store(many, "k", F.col("n"), f"{tmp_path}/s")
    plan = store._stored(spark, f"{tmp_path}/s", many.schema.fields).where(F.col("key_part").isin(["p00"]))._jdf.queryExecution().executedPlan().toString()
    assert "key_part" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_names_that_the_store_uses(spark, tmp_path):
    with pytest.raises(ValueError, match="Batch"):
        store.create_store(spark.createDataFrame([("x", 1)], "k string, Batch long"), "k", F.lit(1), f"{tmp_path}/s")
