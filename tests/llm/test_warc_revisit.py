import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pairwright.llm import warc_revisit as wr

T0 = datetime(2024, 1, 1)
SCHEMA = wr.CAPTURE + ", url_key string, chunk int, last string"


def row(i, kind, url, minute, status=200, headers=(), digest=None, body=None):
    return (i, kind, url, None if minute is None else T0 + timedelta(minutes=minute), status, None if headers is None else list(headers), digest, body, "x", 1, "x")


def test_canonical(spark):
    same = ["http://Example.com/a?b=2&a=1#x", "https://www.example.com:443/a?a=1&b=2", "EXAMPLE.com:80/a?a=1&b=2", " http://example.com/a?b=2&a=1 "]
    other = ["http://example.com/A?a=1&b=2", "http://example.com", "http://example.com/", None, "", "http://example.com:8080/"]
    df = spark.createDataFrame([(u,) for u in same + other], "u string").select(wr.canonical(F.col("u")).alias("k"))
    got = [r["k"] for r in df.collect()]
    assert set(got[:4]) == {"example.com/a?a=1&b=2"}
    assert got[4:] == ["example.com/A?a=1&b=2", "example.com/", "example.com/", None, "/", "example.com:8080/"]


def test_validators_and_headers(spark):
    stored = [("Content-Type", "text/html"), ("ETag", '"v1"'), ("Last-Modified", "Mon"), ("X-A", "old"), ("X-A", "old2"), ("Expires", None), (None, "odd")]
    rows = [
        row(1, "response", "http://a.com/", 0, headers=stored, digest="d1", body="one"),
        row(2, "revisit", "http://a.com/", 1, 304, [("etag", 'W/"v1"'), ("x-a", "new"), ("CONTENT-TYPE", "no"), ("Content-Length", "0"), ("Date", "now"), (None, "q")]),
        row(3, "revisit", "http://a.com/", 2, 304, [("ETag", '"v2"')]),
        row(4, "revisit", "http://a.com/", 3, 304, [("ETag", '"v2"')], digest="d1"),
        row(5, "revisit", "http://a.com/", 4, 304, [("ETag", '"v1"')], digest="d2"),
        row(6, "revisit", "http://a.com/", 5, 304, [("last-modified", "Mon")]),
        row(7, "revisit", "http://a.com/", 6, 304, None),
        row(8, "revisit", "http://a.com/", 0, 304, [("ETag", '"v1"')]),
        row(9, "revisit", "http://a.com/", None, 304, [("ETag", '"v1"')]),
        row(10, "revisit", None, 9, 304, [("ETag", '"v1"')]),
        row(11, "response", "http://a.com/", 7, 404, stored, body="gone"),
        row(12, "revisit", "http://a.com/", 8, 304, [("ETag", '"v1"')]),
        row(13, None, "http://a.com/", 8), row(14, "request", "http://a.com/", 8),
    ]
    out = {r["record_id"]: r for r in wr.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: r["outcome"] for k, r in out.items()} == {
        2: "resolved", 3: "mismatch", 4: "resolved", 5: "mismatch", 6: "resolved", 7: "no_validator", 8: "no_response", 9: "no_response", 10: "no_response", 12: "resolved",
    }
    assert [tuple(h) for h in out[2]["headers"]] == [
        ("Content-Type", "text/html"), ("Last-Modified", "Mon"), ("Expires", None), (None, "odd"), ("etag", 'W/"v1"'), ("x-a", "new"), ("Date", "now"),
    ]
    assert (out[2]["body"], out[2]["status"], out[2]["response_id"], out[3]["body"], out[3]["headers"], out[3]["response_id"]) == ("one", 200, 1, None, None, 1)


@pytest.mark.parametrize("width", ["1", "8", "50"])
def test_hot_url_over_many_ranges(spark, width):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        hot = i % 3 == 0
        rows.append(row(i, rng.choice(["response", "revisit", "revisit"]), "http://hot.com/" if hot else f"http://h{rng.randrange(40)}.com/", rng.randrange(300), headers=[("ETag", '"1"')], body=f"b{i}"))
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        out = {r["record_id"]: r["response_id"] for r in wr.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)
    for r in rows:
        if r[1] == "revisit":
            before = [(x[3], x[0]) for x in rows if x[1] == "response" and x[2] == r[2] and x[3] < r[3]]
            assert out.pop(r[0]) == (max(before)[1] if before else None)
    assert not out


def test_repeats_and_empty(spark):
    rows = [row(1, "response", "http://a.com/", 0, headers=[("ETag", "1")], body="x")] * 2 + [row(2, "revisit", "http://a.com/", 1, 304, [("ETag", "1")])] * 3
    out = wr.resolve(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["record_id"], r["outcome"], r["body"]) for r in out] == [(2, "resolved", "x")] * 3
    assert wr.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
