"""Merged sketches against exact figures, within their error bounds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pairwright.operators import sketches as sk


@pytest.fixture(scope="module")
def log(spark):
    """Five days; one domain has two thirds of the rows."""
    rnd = random.Random(8)
    rows = []
    for i in range(12_000):
        names = [f"agent{rnd.randrange(3000)}" for _ in range(rnd.randrange(3))]
        rows.append((i % 5, "hot" if i % 3 else rnd.choice(["a", None]), f"user{rnd.randrange(5000)}" if i % 10 else None, names, rnd.lognormvariate(2, 2)))
    return rows, spark.createDataFrame(rows, "day int, domain string, user string, agents array<string>, ms double").repartition(6)


def kept(df):
    return sk.sketches(df, ["day", "domain"], {"users": "user", "agents": "agents"}, {"ms": F.col("ms")})


def check(rows, got):
    users, agents = {r[2] for r in rows if r[2]}, {a for r in rows for a in r[3]}
    assert got["rows"] == len(rows)
    for name, exact in (("distinct_users", users), ("distinct_agents", agents)):
        assert abs(got[name] - len(exact)) <= 4 * sk.hll_error() * len(exact) + 1
    ms = sorted(r[4] for r in rows)
    for name, share in (("ms_median", 0.5), ("ms_high", 0.95)):
        low, high = ms[max(0, math.floor((share - 0.02) * len(ms)))], ms[min(len(ms) - 1, math.ceil((share + 0.02) * len(ms)))]
        assert low <= got[name] <= high


def test_merged_days(log):
    rows, df = log
    ranks = {"median": 0.5, "high": 0.95}
    days = kept(df)
    for r in sk.estimates(sk.merged(days, ["domain"]), ranks).collect():
        check([x for x in rows if x[1] == r["domain"]], r)
    check(rows, sk.estimates(sk.merged(days, []), ranks).first())


def test_new_days_need_no_old_rows(log, spark, tmp_path):
    """Stored sketches and those of a new day give what all rows give."""
    rows, df = log
    path = str(tmp_path / "days")
    kept(df.where("day < 4")).write.parquet(path)
    kept(df.where("day = 4")).write.mode("append").parquet(path)
    check(rows, sk.estimates(sk.merged(spark.read.parquet(path), []), {"median": 0.5, "high": 0.95}).first())


def test_odd_values(spark):
    df = spark.createDataFrame([(1, None, None, None, None), (1, None, None, [], float("nan")), (2, None, "u", [None, "x", "x"], 3.0)], "day int, domain string, user string, agents array<string>, ms double")
    got = {r["day"]: r for r in sk.estimates(sk.merged(kept(df), ["day"])).collect()}
    assert (got[1]["rows"], got[1]["distinct_users"], got[1]["distinct_agents"], got[1]["ms_median"]) == (2, 0, 0, None)
    assert (got[2]["rows"], got[2]["distinct_users"], got[2]["distinct_agents"], got[2]["ms_median"]) == (1, 1, 1, 3.0)
    assert sk.estimates(kept(df.where("day > 5"))).count() == 0
