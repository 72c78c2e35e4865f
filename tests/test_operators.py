"""Operators against brute force, with hot groups and different partitionings."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairwright.operators import changes, choose, identity, neighbours, ranking, stats


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """900 rows; one group holds two thirds of them."""
    rnd = random.Random(1)
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", rnd.choice([1, 1, 1, 2, 5, 7, 9])) for i in range(900)]
    return rows, spark.createDataFrame(rows, "id long, g string, v long")


@pytest.mark.parametrize("parts", [1, 4, 64])
@pytest.mark.parametrize("digits", [1, 4])
def test_mark_first_is_exact(skewed, parts, digits):
    rows, df = skewed
    got = ranking.mark_first(df.repartition(parts), "id", 9, lambda n: F.floor(n / 3), ["g"], digits=digits)
    sizes = Counter(r[1] for r in rows)
    want = set()
    for g, n in sizes.items():
        want |= set(sorted((r[0] for r in rows if r[1] == g), key=lambda i: md5(f"{i}#9"))[: n // 3])
    assert {r.id for r in got.filter("taken").collect()} == want
    assert got.count() == len(rows)


@pytest.mark.parametrize("n", [0, 1, 450, 900, 2000])
def test_take_random(skewed, n):
    rows, df = skewed
    want = sorted((r[0] for r in rows), key=lambda i: md5(f"{i}#3"))[:n]
    assert sorted(r.id for r in choose.take_random(df, "id", 3, n).collect()) == sorted(want)


def test_take_from_nothing(skewed):
    assert choose.take_random(skewed[1].filter("id < 0"), "id", 3, 5).count() == 0


@pytest.mark.parametrize("per_bucket", [5, 50, 10_000])
def test_dense_index(skewed, per_bucket):
    rows, df = skewed
    got = ranking.dense_index(df, "id", "i", rows_per_bucket=per_bucket)
    assert {r.id: r.i for r in got.collect()} == {r[0]: i for i, r in enumerate(sorted(rows))}
    got = ranking.dense_index(df.repartition(7), "id", "i", ["g"], rows_per_bucket=per_bucket)
    want = {}
    for g in {r[1] for r in rows}:
        want |= {r[0]: i for i, r in enumerate(sorted(x for x in rows if x[1] == g))}
    assert {r.id: r.i for r in got.collect()} == want


@pytest.mark.parametrize("per_bucket", [1, 2, 10_000])
def test_upper_median(skewed, per_bucket):
    rows, df = skewed
    got = ranking.upper_half_median(df, "v", ["g"], "m", rows_per_bucket=per_bucket)
    want = {}
    for g in {r[1] for r in rows}:
        vs = sorted(r[2] for r in rows if r[1] == g)
        want[g] = vs[len(vs) // 2]
    assert {r.g: r.m for r in got.collect()} == want


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_with_next(skewed, chunk):
    rows, df = skewed
    got = neighbours.with_next(df, ["g"], "id", F.floor(F.col("id") / chunk), ["v", "id"])
    want = {}
    for g in {r[1] for r in rows}:
        mine = sorted(r for r in rows if r[1] == g)
        want |= {a[0]: (b[2], b[0]) if b else (None, None) for a, b in zip(mine, mine[1:] + [None])}
    assert {r.id: (r.next_v, r.next_id) for r in got.collect()} == want


@pytest.mark.parametrize("n", [1, 3, 25, 500, 5000])
def test_stratified_quotas(skewed, n):
    rows, df = skewed
    sizes = sorted(Counter(r[1] for r in rows).items())
    left, want = min(n, len(rows)), {}
    for i, (g, size) in enumerate(sizes):
        share = left if i == len(sizes) - 1 else max(1, int(min(n, len(rows)) * (size / len(rows))))
        want[g] = min(share, size, left)
        left -= want[g]
    assert {r.g: r.quota for r in choose.stratified_quotas(df, "g", n).collect()} == want
    assert Counter(r.g for r in choose.stratified_sample(df, "id", "g", n, 5).collect()) == Counter({k: v for k, v in want.items() if v})


def test_split_sizes(skewed):
    _, df = skewed
    got = Counter(r.split for r in choose.split_exact(df, "id", 1, 0.1).collect())
    assert got == {"train": 810, "validation": 90}
    one = choose.split_exact(df.filter("id < 3"), "id", 1, 0.1)
    assert Counter(r.split for r in one.collect()) == {"train": 2, "validation": 1}
    a = {r.id: r.split for r in choose.split_by_hash(df, "id", 1, 0.1).collect()}
    b = {r.id: r.split for r in choose.split_by_hash(df.repartition(9), "id", 1, 0.1).collect()}
    assert a == b


def test_first_and_last_seen(spark):
    rows = [("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), ("a", 2, "w")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    assert {(r.k, r.v, r.n) for r in identity.first_seen(df, "k", F.col("o"), "n").collect()} == {("a", "y", 3), ("b", "z", 1)}
    assert {(r.k, r.v) for r in identity.last_seen(df, "k", F.col("o")).collect()} == {("a", "x"), ("b", "z")}
    store = spark.createDataFrame([("b", 0, "old"), ("c", 0, "old")], "k string, o int, v string")
    assert [(r.k, r.v) for r in identity.insert_absent(store, df, "k", F.col("o")).collect()] == [("a", "y")]
    assert identity.insert_counts(store, df, "k").first().asDict() == {"added": 1, "duplicates": 3}
    assert {(r.k, r.v) for r in identity.update_present(store, df, "k", F.col("o")).collect()} == {("b", "z"), ("c", "old")}


def test_before_after(spark):
    before = spark.createDataFrame(
        [("1", "n", "f", True, 0), ("2", "n", "f", None, 0), ("3", "n", "f", True, 0), ("4", "n", "f", False, 0)],
        "id string, nl_statement string, atl_formula string, verified boolean, o int",
    )
    after = spark.createDataFrame(
        [("1", "f", "f", "verified", None, 0), ("2", "f", "g", "rejected", "e", 0), ("3", "f", "g", "rejected", None, 0),
         ("3", "f", None, "verified", None, 1), ("9", "f", None, "verified", None, 0)],
        "id string, atl_formula string, corrected_atl string, status string, explanation string, o int",
    )
    got = {r.id: r for r in changes.before_after(before, after, F.col("o"), F.col("o")).collect()}
    assert set(got) == {"1", "2", "3"}
    assert not got["1"].is_correction and not got["1"].is_status_change
    # a null status differs from both outcomes
    assert got["2"].is_correction and got["2"].is_status_change and got["2"].reason == "e"
    # the last row of an id counts
    assert not got["3"].is_correction and not got["3"].is_status_change


def test_retranslation_golden(spark):
    rows = [("same", "REJECT", True, 0.0)] * 16 + [("improved", "ACCEPT", True, 0.9)] + [("syntax_error", None, False, None)] * 3
    df = spark.createDataFrame(rows, "status string, finetuned_verdict string, finetuned_syntax_valid boolean, finetuned_confidence double")
    r = stats.retranslation_stats(df).first()
    assert (r.total, r.improved, r.same, r.syntax_errors, r.improvement_rate) == (20, 1, 16, 3, 5.0)
    assert math.isclose(r.acceptance_rate, 100 / 17) and r.avg_confidence == 0.9


def test_rollup_golden(spark):
    counts = {("O→A", "verified"): 2, ("O→A", "rejected"): 3, ("A→O", "verified"): 5, ("A→A", "verified"): 3, ("A→A", "rejected"): 1,
              ("A→A", "needs_review"): 1, ("O→O", "verified"): 5}
    rows = [(c, s) for (c, s), n in counts.items() for _ in range(n)]
    got = {(r.dimension, r.value): (r.total, r.verified) for r in stats.rollups(spark.createDataFrame(rows, "config string, verification_status string"), ["config"]).collect()}
    assert got == {("all", "all"): (20, 15), ("config", "O→A"): (5, 2), ("config", "A→O"): (5, 5), ("config", "A→A"): (5, 3), ("config", "O→O"): (5, 5)}


def test_model_with_errors_only(spark):
    rows = [("a", 1.0, 10, True, None), ("a", 3.0, 20, False, None), ("b", None, None, None, "404")]
    df = spark.createDataFrame(rows, "model string, response_time double, tokens_used long, syntax_valid boolean, error string")
    got = {r.model: r for r in stats.model_stats(df).collect()}
    assert (got["a"].median_time, got["a"].avg_time, got["a"].syntax_valid_rate) == (3.0, 2.0, 0.5)
    assert (got["b"].error_count, got["b"].avg_time, got["b"].median_time, got["b"].total_tokens) == (1, None, None, None)


def test_empty_inputs(spark):
    log = spark.createDataFrame(
        [], "domain string, syntax_valid boolean, semantic_verified boolean, confidence double, cross_model_agreement boolean, "
        "complexity int, latency_ms double, prompt_tokens long, completion_tokens long"
    )
    assert stats.verification_quality(log).first().total_samples == 0
    assert stats.verification_quality(log).first().avg_confidence == 0.0
    assert stats.diversity(log).first().unique_domains == 0
    assert stats.performance(log).first().samples_per_minute == 0.0


def test_best_models_ignore_silent_ones(spark):
    rows = [("a", True, 2.0, True, None), ("a", False, 4.0, True, None), ("b", None, 0.0, False, "404"), ("c", True, 9.0, True, None)]
    df = spark.createDataFrame(rows, "model string, correct boolean, response_time double, syntax_valid boolean, error string")
    r = stats.best_models(stats.review_accuracy(df)).first()
    assert (r.most_accurate, r.best_accuracy, r.fastest, r.fastest_time) == ("c", 1.0, "a", 3.0)


def test_round_robin_and_quota(spark):
    df = spark.range(7).withColumnRenamed("id", "i")
    got = choose.round_robin(df, "i", {"d": ["x", "y", "z"]}).orderBy("i").collect()
    assert [r.d for r in got] == list("xyzxyzx")
    q = choose.generator_quota(df, "i", 7, ("one", "two")).orderBy("i").collect()
    assert [r.generator for r in q] == ["one"] * 3 + ["two"] * 4 and q[0].sample_id == "sample_001"


def test_first_successes(spark):
    df = spark.createDataFrame([("g", i, i % 2 == 1) for i in range(20)], "g string, attempt int, ok boolean")
    got = choose.first_successes(df, "attempt", F.col("ok"), 3, ["g"])
    assert sorted(r.attempt for r in got.collect()) == [1, 3, 5]
    # attempts beyond 3n do not count
    assert choose.first_successes(df.filter("attempt > 7"), "attempt", F.col("ok"), 3, ["g"]).count() == 0


# no row is lost ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def holes(spark):
    """100 rows: null keys, null groups, null order values."""
    rows = [(None if i % 10 == 0 else i, None if i % 4 == 0 else f"g{i % 3}", None if i % 7 == 0 else i % 5, i) for i in range(100)]
    return rows, spark.createDataFrame(rows, "id long, g string, v long, n long")


@pytest.mark.parametrize("digits", [1, 4])
def test_marks_keep_all_rows(holes, digits):
    rows, df = holes
    got = ranking.mark_first(df, "id", 3, lambda n: F.floor(n / 2), ["g"], digits=digits).collect()
    assert sorted(r.n for r in got) == list(range(100))
    sizes = Counter(r[1] for r in rows)
    assert Counter(r.g for r in got if r.taken) == Counter({g: n // 2 for g, n in sizes.items()})
    assert choose.split_exact(df, "id", 1, 0.1).count() == 100
    assert choose.halves(df, "id", 1, "h", F.lit("a"), F.lit("b"), ["g"]).count() == 100
    assert choose.stratified_sample(df, "id", "g", 100, 1).count() == 100
    assert choose.take_random(df, "id", 1, 37).count() == 37


@pytest.mark.parametrize("per_bucket", [5, 10_000])
def test_positions_keep_all_rows(holes, per_bucket):
    rows, df = holes
    got = {r.n: r.i for r in ranking.dense_index(df, "n", "i", ["g"], rows_per_bucket=per_bucket).collect()}
    want = {}
    for g in {r[1] for r in rows}:
        want |= {r[3]: i for i, r in enumerate(x for x in rows if x[1] == g)}
    assert got == want
    at = sorted(r.i for r in ranking.dense_index(df, "id", "i", rows_per_bucket=per_bucket).collect())
    assert at == list(range(100))


@pytest.mark.parametrize("per_bucket", [5, 10_000])
def test_medians_of_null_groups(holes, per_bucket):
    rows, df = holes
    got = {r.g: r.m for r in ranking.upper_half_median(df, "v", ["g"], "m", rows_per_bucket=per_bucket).collect()}
    want = {}
    for g in {r[1] for r in rows}:
        vs = sorted(r[2] for r in rows if r[1] == g and r[2] is not None)
        want[g] = vs[len(vs) // 2]
    assert got == want


def test_statements_without_domain_are_kept(spark):
    from pairwright.sinks import writers

    df = spark.createDataFrame([("a", "x"), (None, "y"), (None, "z")], "domain string, nl_statement string")
    assert {(r.domain, r.nl_statement, r.domain_count) for r in writers.by_domain(df).collect()} == {("a", "x", 1), (None, "y", 2), (None, "z", 2)}


# order statistics by rounds, quotas by the last hash --------------------------------------------------------------


def test_order_statistic_in_rounds(spark):
    """Values of all magnitudes, with infinities and numbers that are none: 3 bins make many rounds."""
    rnd = random.Random(4)
    odd = [float("inf"), float("-inf"), float("nan"), 5e-324, 0.0, -1e308, 1e308]
    rows = [(rnd.choice(["hot", "hot", "hot", "a", None]), rnd.choice([rnd.gauss(0, 10.0 ** rnd.randrange(-9, 9)), rnd.choice(odd), 7.0])) for _ in range(600)]
    df = spark.createDataFrame(rows, "g string, v double")
    order = lambda v: (math.isnan(v), 0 if math.isnan(v) else v)
    for share in (0.0, 0.03, 0.5, 0.97):
        got = ranking.value_at(df, "v", ["g"], lambda n, s=share: F.floor(n * s), "m", rows_per_bucket=2, bins=64)
        want = {}
        for g in {r[0] for r in rows}:
            vs = sorted((r[1] for r in rows if r[0] == g), key=order)
            want[g] = str(vs[math.floor(len(vs) * share)])
        assert {r.g: str(r.m) for r in got.collect()} == want


def test_order_statistic_of_near_numbers(spark):
    """Numbers that are one double are told apart; a position outside a group gives no row."""
    rows = [(2**60 + i % 50,) for i in range(200)]
    df = spark.createDataFrame(rows, "v long")
    for at in (0, 57, 199):
        assert ranking.value_at(df, "v", [], lambda n, a=at: F.lit(a), "m", rows_per_bucket=1, bins=4).first().m == sorted(rows)[at][0]
    assert ranking.value_at(df, "v", [], lambda n: n, "m").count() == 0
    assert ranking.value_at(df.filter("v < 0"), "v", [], lambda n: F.floor(n / 2), "m").count() == 0


def test_quota_within_equal_rows(spark):
    """A third of the rows have no key and are all equal: just so many are taken, by many tasks."""
    df = spark.createDataFrame([(None, "x")] * 300 + [(i, f"t{i}") for i in range(600)], "id long, `a.b` string")
    whole = ranking.mark_first(df, "id", 3, lambda n: F.floor(n / 2), rows_per_bucket=20)
    assert Counter(r.taken for r in whole.collect()) == Counter({True: 450, False: 450})
    for n in (0, 1, 299, 300, 301, 899, 900, 5000):
        got = ranking.mark_first(df.repartition(5), "id", 3, lambda _, n=n: F.lit(n), rows_per_bucket=50).collect()
        assert len(got) == 900 and sum(r.taken for r in got) == min(n, 900)


def test_quota_moves_no_row(spark, tmp_path):
    """The marking pass scans once and neither sorts nor shuffles; counting reads the key alone."""
    spark.range(1000).selectExpr("id", "repeat('x', 50) AS text").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = choose.split_exact(df, "id", 1, 0.2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Exchange" not in plan and "Sort" not in plan
    df.createOrReplaceTempView("t_rows")
    by = ranking.mark_first(df.withColumn("g", F.pmod("id", F.lit(3))), "id", 1, lambda n: F.floor(n / 2), ["g"])
    plan = by._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2 and "Sort" not in plan  # the rows, and one row per group


def test_rows_without_order_are_split(spark, monkeypatch):
    """Null order values that most rows share do not end in one range, and every position is given once."""
    df = spark.createDataFrame([(None if i % 3 else i, i) for i in range(900)], "o long, n long")
    written = []
    keep = ranking.cut_lineage
    monkeypatch.setattr(ranking, "cut_lineage", lambda d, label: written.append(keep(d, label)) or written[-1])
    got = ranking.dense_index(df, "o", "i", rows_per_bucket=60).collect()
    assert sorted(r.i for r in got) == list(range(900))
    assert [r.i for r in sorted((r for r in got if r.o is not None), key=lambda r: r.o)] == list(range(600, 900))
    sizes = [r["count"] for r in written[0].groupBy("_b").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 200
