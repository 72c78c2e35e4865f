"""Lists in JSON documents, cut into splits of a few bytes."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.sources import readers
from pairwright.sources.json_lists import read_json_lists

ELEMENT = T.StructType([T.StructField("id", T.LongType()), T.StructField("s", T.StringType()), T.StructField("more", T.ArrayType(T.StructType([T.StructField("x", T.LongType())])))])


def items(seed, n):
    rng = random.Random(seed)
    odd = ['"', "\\", "}", "{", "[", "]", ",", "\n", "é", "😀", '\\"', "}]", 'a"}', "samples", '"samples":[{', " "]
    return [{"id": k, "s": "".join(rng.choice(odd) for _ in range(rng.randrange(12))), "more": [{"x": j} for j in range(rng.randrange(3))]} for k in range(n)]


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def read(spark, path):
    rows = read_json_lists(spark, str(path), ELEMENT).collect()
    return [json.loads(json.dumps(r["element"].asDict(True))) for r in sorted(rows, key=lambda r: (r["file"], r["no"]))]


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("shape", ["bare", "samples", "pairs", "among others", "two lists"])
def test_shapes(spark, tmp_path, small_splits, shape, indent):
    rows = items(hash(shape) % 100, 60)
    whole = {
        "bare": rows, "samples": {"samples": rows}, "pairs": {"pairs": rows},
        "among others": {"metadata": {"a": {"b": [1, 2]}, "text": 'x"}{['}, "other": [{"id": -1}], "samples": rows, "end": {"n": 1}},
        "two lists": {"samples": rows[:30], "n": [1], "pairs": rows[30:]},
    }[shape]
    (tmp_path / "d.json").write_text(json.dumps(whole, indent=indent, ensure_ascii=indent is None) + ("\n" if indent else ""))
    assert read(spark, tmp_path / "d.json") == rows


def test_many_files_and_many_splits(spark, tmp_path, small_splits):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps(items(k, 40 + k)))
    assert read(spark, tmp_path) == [x for k in range(3) for x in items(k, 40 + k)]
    assert spark.read.text(str(tmp_path / "0.json")).rdd.getNumPartitions() > 4


@pytest.mark.parametrize("text", ["[]", '{"samples": []}', "[ ]\n"])
def test_empty_lists(spark, tmp_path, text):
    (tmp_path / "d.json").write_text(text)
    assert read(spark, tmp_path / "d.json") == []


@pytest.mark.parametrize("text", ['[{"id": 1}, {"id": 2', '[{"id": 1}, {"id": 2}', '{"samples": [{"id": 1}]', '[{"id": 1}, {"s": "open}]'])
def test_documents_that_are_cut_off(spark, tmp_path, text):
    (tmp_path / "d.json").write_text(text)
    with pytest.raises(Exception, match="cut off"):
        read(spark, tmp_path / "d.json")


def test_lists_grow_in_number_not_in_size(spark, tmp_path):
    """A file is one task's work, so the largest one must not grow with the table."""
    from pairwright.catalog import storage

    def largest(n, path):
        ids = spark.range(n).select(F.concat(F.lit("d"), "id").alias("id"), F.repeat(F.lit("word "), 200).alias("nl_statement"), F.lit("<<a>> G(b)").alias("atl_formula"), F.lit("en").alias("domain"))
        storage.write_lists(ids, path, list_bytes=200_000)
        back = readers.read_large_json(spark, path).where("id <> 'none'")
        assert back.select("id").distinct().count() == back.count() == n
        files = [f.stat().st_size for f in tmp_path.glob(f"{path.rsplit('/', 1)[1]}/*/*.txt")]
        return len(files), max(files)

    few, some = largest(500, f"{tmp_path}/small")
    many, most = largest(4000, f"{tmp_path}/large")
    assert few == 4 and many == 20 and most < 2 * some
