"""Inference stages, plans and streams end to end on small tables."""

import hashlib
import sys
import time
from itertools import combinations

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pairwright import session, vocab
from pairwright.catalog import replies
from pairwright.catalog.models import verifier_reply
from pairwright.operators import generate
from pairwright.operators import inference as inf
from pairwright.plans import compare, create, training, verify
from pairwright.sinks import writers
from pairwright.streaming import jobs


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Counting:
    """Replies with the number of calls so far, so a second call for a prompt would show."""

    model = provider = "mock"
    calls = 0

    def answer(self, prompt):
        if "fail" in prompt:
            raise RuntimeError("Error code: 429")
        self.calls += 1
        return f"{prompt}!{self.calls}", 3, 4


def test_batch_stage_asks_once_per_prompt(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 != 0, "hot").when(F.col("id") % 2 == 0, None).otherwise("cold").alias("q"))
    got = inf.batch_stage(lambda: Counting(), workers=1)(rows, "q", "a").cache()
    assert got.count() == 4000
    texts = {r.q: r.t for r in got.groupBy("q").agg(F.collect_set("a.text").alias("t")).collect()}
    assert all(len(t) == 1 for q, t in texts.items() if q) and texts[None] == []
    used = got.filter("q = 'hot'").first()["a"]
    assert (used.prompt_tokens, used.completion_tokens, used.provider) == (3, 4, "mock")


def test_hot_prompts(spark):
    rows = spark.range(300_000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 50).cast("string"))).alias("q"))
    got = inf.batch_stage(lambda: replies.Measure())(rows, "q", "a")
    assert got.count() == 300_000
    assert got.filter(F.col("a").isNull()).count() == 0


class Named:
    """A model that signs its answers."""

    provider = "mock"

    def __init__(self, model):
        self.model = model

    def answer(self, prompt):
        return f"{self.model}: {prompt}", 1, 1


def test_each_row_is_asked_its_own_model(spark):
    rows = spark.createDataFrame([(1, "q", "a"), (2, "q", "b"), (3, "q", "c"), (4, "q", None), (5, None, "a"), (6, "q", "a")], "id int, q string, m string")
    backends = {name: (lambda name=name: Named(name)) for name in "ab"}
    got = {r.id: r.x for r in inf.batch_stage(backends, in_flight=4)(rows, "q", "x", model="m").collect()}
    assert (got[1].text, got[2].text, got[6].text, got[5]) == ("a: q", "b: q", "a: q", None)
    assert "no backend" in got[3].error and got[3].model == "c" and got[4].error
    long = compare.compare_models(rows.filter("id < 3").select("id", F.col("q").alias("nl_statement")), ["a", "b"], inf.batch_stage(backends))
    assert {(r.model, r.atl_formula.split(":")[0]) for r in long.collect()} == {("a", "a"), ("b", "b")}


def test_attempts_are_asked_each(spark):
    attempts = spark.range(6).select(F.col("id").alias("attempt"), F.lit("d").alias("domain"), F.array(F.lit("a")).alias("agents"), F.array(F.lit("p")).alias("atoms"), F.lit("safety").alias("pattern"))

    class Numbered(Counting):
        def answer(self, prompt):
            self.calls += 1
            return ("<<a>> G p" if "ATL:" in prompt else f"1. Statement {self.calls} of them."), 0, 0

    out = create.model_dataset(attempts, inf.batch_stage(lambda: Numbered(), workers=1), 2, ["domain"], "mock").collect()
    assert len(out) == 2 and len({r.nl_statement for r in out}) == 2


def test_rows_with_maps(spark):
    rows = spark.createDataFrame([(1, "q", {"a": 1}), (2, None, {"b": 2})], "id int, q string, m map<string,int>")
    assert inf.batch_stage(lambda: replies.Measure())(rows, "q", "a").count() == 2


def test_errors_are_rows(spark):
    rows = spark.createDataFrame([(1, "fail now"), (2, "fine")], "id int, q string")
    got = {r.id: r.a for r in inf.batch_stage(lambda: Counting())(rows, "q", "a").collect()}
    assert got[1].error == "Error code: 429" and got[1].text is None and got[2].error is None


def test_recorded_answers(spark):
    recorded = spark.createDataFrame([("a", "one"), ("b", None)], "prompt string, text string")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "a")], "id int, q string")
    got = {r.id: r.x for r in inf.recorded_stage(recorded)(rows, "q", "x").collect()}
    assert (got[1].text, got[5].text, got[1].error, got[2].text, got[2].error, got[3].error, got[4]) == ("one", "one", None, None, None, "no recorded answer", None)


class Logged:
    """Writes down every call; some prompts fail, kill the task or never come back."""

    model = provider = "mock"

    def __init__(self, log, fail=(), die=(), hang=()):
        self.log, self.fail, self.die, self.hang = log, set(fail), set(die), set(hang)

    def answer(self, prompt):
        with open(self.log, "a") as f:
            f.write(f"{prompt}\n")
        if prompt in self.die:
            raise KeyboardInterrupt
        if prompt in self.hang:
            time.sleep(600)
        if prompt in self.fail:
            raise RuntimeError("Error code: 503" if "again" in prompt else "no such thing")
        return prompt.upper(), 1, 1


def test_a_job_that_died_asks_no_answered_prompt_again(spark, tmp_path):
    rows = spark.range(400).select("id", F.concat(F.lit("p"), F.col("id")).alias("q"))
    log, kept = f"{tmp_path}/log", f"{tmp_path}/answers"
    slice_of = lambda p: int(hashlib.sha256(f"\x01\x01{p}".encode()).hexdigest()[:8], 16) % 16
    late = next(f"p{k}" for k in range(400) if slice_of(f"p{k}") == 9)
    with pytest.raises(Exception, match="."):
        inf.batch_stage(lambda: Logged(log, die=[late]), workers=1, kept=kept, slices=16)(rows, "q", "a")
    first = open(log).read().split()
    there = {r.text for r in inf.kept_answers(spark, kept).collect()}
    assert there == {f"P{k}" for k in range(400) if slice_of(f"p{k}") < 9}
    out = inf.batch_stage(lambda: Logged(log), kept=kept, slices=5)(rows, "q", "a")
    assert {(r.q, r.a.text) for r in out.collect()} == {(f"p{k}", f"P{k}") for k in range(400)}
    second = open(log).read().split()[len(first):]
    assert len(second) == len(set(second)) and not {p.upper() for p in second} & there and len(second) + len(there) == 400
    inf.batch_stage(lambda: Logged(log, die=[f"p{k}" for k in range(400)]), kept=kept)(rows, "q", "a")
    assert len(open(log).read().split()) == len(first) + len(second)


def test_only_retryable_errors_are_asked_again(spark, tmp_path):
    rows = spark.createDataFrame([("again 1",), ("never 1",), ("fine",)], "q string")
    log, kept = f"{tmp_path}/log", f"{tmp_path}/answers"
    stage = lambda fail, **kw: inf.batch_stage(lambda: Logged(log, fail), kept=kept, slices=2, **kw)(rows, "q", "a")
    got = {r.q: r.a for r in stage(["again 1", "never 1"], attempts=3, wait=0.01).collect()}
    assert got["again 1"].error == "Error code: 503" and got["never 1"].error == "no such thing" and got["fine"].text == "FINE"
    assert sorted(open(log).read().splitlines()) == ["again 1"] * 3 + ["fine", "never 1"]
    got = {r.q: r.a for r in stage([]).collect()}
    assert got["again 1"].text == "AGAIN 1" and got["never 1"].error == "no such thing"
    assert len(open(log).read().splitlines()) == 6


def test_calls_that_hang_become_errors(spark, tmp_path):
    rows = spark.createDataFrame([("hang",), ("fine",)], "q string")
    start = time.monotonic()
    out = inf.batch_stage(lambda: Logged(f"{tmp_path}/log", hang=["hang"]), workers=1, in_flight=2, deadline=1.0, attempts=2, wait=0.01)(rows, "q", "a")
    got = {r.q: r.a for r in out.collect()}
    assert got["fine"].text == "FINE" and got["hang"].error == "Request timed out after 1 s" and time.monotonic() - start < 60
    assert open(f"{tmp_path}/log").read().split().count("hang") == 2


def test_a_backend_that_always_hangs_is_not_called_without_end(monkeypatch, tmp_path):
    monkeypatch.setattr(inf, "HUNG", 3)
    call, backend = inf._Caller(0.05, 1, 0), Logged(f"{tmp_path}/log", hang=[str(k) for k in range(9)])
    said = []
    for k in range(9):
        with pytest.raises(TimeoutError) as e:
            call(backend, str(k))
        said.append(str(e.value))
    assert said == ["Request timed out after 0.05 s"] * 3 + ["Request timed out: 3 calls hang"] * 6


PAIRS = [
    ("1", "react to view always", "<<a>> G (p)", "d"),
    ("2", "react to error always", "<<a>> G (p)", "d"),
    ("3", "react to view always", "G (p", "d"),
]


def pairs(spark):
    return spark.createDataFrame(PAIRS, "id string, nl_statement string, atl_formula string, domain string")


def test_verify_with_backend_and_expression_agree(spark):
    rows = pairs(spark)
    a = verify.verify_table(rows, inf.expression_stage(verifier_reply))

    class Verifier(Counting):
        def answer(self, prompt):
            if prompt.endswith("nothing else."):
                return "<<checker>> F seen", 0, 0
            right = "react to error" not in prompt
            return f'{{"matches": {str(right).lower()}, "confidence": {0.9 if right else 0.3}}}', 0, 0

    b = verify.verify_table(rows, inf.batch_stage(lambda: Verifier()))
    got = [{r.id: (r.status, r.cross_model_agreement) for r in x.collect()} for x in (a, b)]
    assert got[0] == got[1] == {"1": ("needs_review", False), "2": ("rejected", False), "3": ("rejected", None)}
    alone = verify.verify_table(rows, inf.expression_stage(verifier_reply), cross_check=False)
    assert {r.id: r.status for r in alone.collect()} == {"1": "verified", "2": "rejected", "3": "rejected"}


def test_retry(spark):
    rejected = spark.createDataFrame(
        [("1", "react to view", "f", "d", "ver", ["Error code: 429"], ["n"], "rejected"), ("2", "x", "f", "d", None, ["rate limit exceeded"], None, "rejected"),
         ("3", "x", "f", "d", "ver", ["wrong"], ["n"], "rejected")],
        "id string, nl_statement string, atl_formula string, domain string, verifier string, rejection_reasons array<string>, "
        "verification_notes array<string>, verification_status string",
    )
    good = rejected.filter("false")
    reply = lambda q: F.when(F.contains(q, F.lit("view")), '{"verdict": "ACCEPT", "confidence": 1.0}').otherwise('{"verdict": "REJECT", "issues": ["no"]}')
    merged, retried = compare.retry_rejections(good, rejected, inf.expression_stage(reply))
    got = {r.id: (r.verification_status, r.verifier, r.rejection_reasons) for r in merged.collect()}
    assert got == {"1": ("verified", "ver", None), "2": ("rejected", "anthropic", ["no"]), "3": ("rejected", "ver", ["wrong"])}
    assert retried.count() == 2


def test_training_export(spark, tmp_path):
    rows = spark.createDataFrame(
        [(i, f"Statement number {i}", "<<a>> G p", "d", None, None, ["a", "b"]) for i in range(30)] + [(99, "short", "<<a>> G p", "d", None, None, None)],
        "id int, nl_statement string, atl_formula string, domain string, verification_confidence double, verification_status string, agents array<string>",
    )
    marked = training.mark_rows(rows)
    out = training.chat_records(training.training_split(marked, "id", 1))
    assert out.count() == 30 and out.filter("split = 'validation'").count() == 3
    m = out.first()["messages"]
    assert [x.role for x in m] == ["system", "user", "assistant"]
    assert m[1].content.startswith(vocab.TRAINING_REQUEST) and m[1].content.endswith("\n\nDomain: d\n\nAgents: a, b")
    writers.write_split(out, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o" / "split=validation")).count() == 3


def test_plain_training_filters_reach_the_scan(spark, tmp_path):
    rows = [(i, f"Statement number {i}", "<<a>> G p", (None, "a", "b")[i % 3], (None, 0.2, 0.9)[i // 3 % 3], (None, "verified", "rejected")[i // 9 % 3]) for i in range(27)]
    schema = "id int, nl_statement string, atl_formula string, domain string, verification_confidence double, verification_status string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    for args in ((0.0, "verified", None), (0.5, "verified", ["a"]), (0.5, "rejected", None), (0.0, "all", ["b"])):
        plain = training.trainable(stored, *args)
        marked = training.mark_rows(stored, *args).filter("failed_filter is null")
        assert {r.id for r in plain.collect()} == {r.id for r in marked.collect()}
    plan = training.trainable(stored, 0.5, "verified", ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "IsNull(verification_confidence)" in plan.split("PushedFilters: [")[1]


def test_generation_is_the_same_for_any_partitioning(spark):
    draws = spark.range(200).withColumnRenamed("id", "d")
    a = generate.base_pairs(draws, "d", 3).select("d", "nl", "formula").collect()
    b = generate.base_pairs(draws.repartition(13), "d", 3).select("d", "nl", "formula").collect()
    assert sorted(a) == sorted(b) and len(a) == 200
    assert not any("{" in r.nl or "{" in r.formula for r in a)


@pytest.mark.parametrize("n", [1, 2, 3, 12])
def test_coalition_space(spark, n):
    size = generate.coalition_count(n, ["x", "y"])
    got = [r.c for r in spark.range(2 * size).orderBy("id").select("id", generate.coalition_at(F.col("id"), n, ["x", "y"]).alias("c")).collect()]
    numbers = [str(i) for i in range(1, n + 1)]
    want = [[a] for a in numbers] + [list(p) for p in combinations(numbers, 2)] + ([numbers] if n > 1 else []) + [["x"], ["y"]]
    assert got == want * 2


def test_templates_from_a_table(spark):
    draws = spark.range(60).withColumnRenamed("id", "d")
    shapes = sorted(vocab.FORMULA_SHAPES)
    table = spark.createDataFrame([(*s, None) for s in shapes], "template_id string, category string, shape string, frames array<string>")
    a = generate.base_pairs(draws, "d", 3, shapes=shapes).collect()
    b = generate.base_pairs(draws, "d", 3, shapes=table).collect()
    assert sorted(a) == sorted(b) and len(a) == 60
    own = generate.base_pairs(draws, "d", 3, shapes=table.limit(2).withColumn("frames", F.array(F.lit("Say {p_nl}.")))).collect()
    assert all(r.nl.startswith("Say ") for r in own)


def test_closed_windows_leave_the_state(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    for day in (1, 2, 20, 40):
        log = spark.createDataFrame([(day, "d", True, True, 0.5, True)], "day int, domain string, syntax_valid boolean, semantic_verified boolean, confidence double, cross_model_agreement boolean")
        log = log.withColumn("ts", F.make_timestamp(F.lit(2024), F.lit(1) + F.floor(F.col("day") / 29).cast("int"), F.pmod("day", F.lit(29)) + 1, F.lit(0), F.lit(0), F.lit(0)))
        log.write.mode("append").parquet(src)
        query = jobs.snapshot_quality(jobs.stream_table(spark, src), "ts", out, cp)
        query.awaitTermination()
    assert jobs.latest_snapshot(spark, out).count() == 4
    assert query.lastProgress is None or sum(s.numRowsTotal for s in query.lastProgress.stateOperators) <= 2


def test_unique_statements(spark):
    df = spark.createDataFrame([("b", "g1", 0, " Same One"), ("a", "g2", 1, "same one "), ("a", "g1", 2, "other")], "domain string, generator string, pos int, nl_statement string")
    got = create.unique_statements(df, F.struct("domain", "generator", "pos")).collect()
    assert {(r.domain, r.generator) for r in got} == {("a", "g2"), ("a", "g1")}


def test_work_folder_comes_from_the_session(spark):
    assert session.run_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_stream_resumes_without_repeats(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    enrich = lambda df: df.withColumn("y", F.col("x") * 2)
    for lo in (0, 100):
        spark.range(lo, lo + 100).withColumnRenamed("id", "x").write.mode("append").parquet(src)
        jobs.append_enriched(jobs.stream_table(spark, src), enrich, out, cp).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted(r.x for r in rows) == list(range(200)) and all(r.y == 2 * r.x for r in rows)
    # nothing new: nothing written
    jobs.append_enriched(jobs.stream_table(spark, src), enrich, out, cp).awaitTermination()
    assert spark.read.parquet(out).count() == 200


def test_hybrid_writes_only_what_is_needed_to_trim(spark, monkeypatch):
    written, cut = [], create.cut_lineage
    monkeypatch.setattr(create, "cut_lineage", lambda df, label: written.append(df.columns) or cut(df, label))
    draws = spark.range(300).withColumnRenamed("id", "draw")
    rows = create.hybrid_dataset(draws, "draw", 3, 40, inf.expression_stage(replies.paraphrases), inf.expression_stage(replies.critique), "mock")
    assert not {"id", "domain", "agents", "operators", "atoms", "atl_unicode"} & set(written[0])
    kept = rows.collect()
    assert len(kept) == 40 and all(r.agents and r.atoms and r.outcome == "keep" and r.confidence == 1.0 for r in kept)
    assert {r.generation.provider for r in kept} == {"none", "mock"}
    assert all(not r.nl_statement.startswith(replies.WORDINGS[1]) for r in kept)
    assert len(create.hybrid_dataset(draws, "draw", 3, 40, inf.expression_stage(replies.paraphrases), None, "mock").collect()) == 40


def test_rows_of_a_task_are_bounded_whatever_the_splits(spark, tmp_path):
    """A file of one row group in many splits: one split has all rows."""
    from pairwright.catalog import views

    n = 3 * session.ROWS_OF_TASK
    rows = spark.range(0, n, 1, 1).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"), (F.col("id") % 7).alias("user_id"), F.concat(F.lit('{"k": '), F.col("id") % 100, F.lit("}")).alias("props"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    size = sum(f.stat().st_size for f in (tmp_path / "events.parquet").glob("*.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 16))
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert views.table(spark, str(tmp_path), "events").rdd.getNumPartitions() > session.FEW_SPLITS
        per = views.events(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(r["count"] for r in per) == n
    assert max(r["count"] for r in per) <= session.ROWS_OF_TASK
    assert session.spread_rows(spark.range(n * 10)).rdd.getNumPartitions() == 30
