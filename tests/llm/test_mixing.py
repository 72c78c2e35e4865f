import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pairwright.llm import mixing


def levels(sizes):
    """Targets by the definition: share by weight, cut, share what is left over among the others."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2 * sizes[s]
                open_.discard(s)
    return target


def check(df, rows, digits=3):
    got = mixing.mix(df, digits=digits, keep=["source"]).collect()
    words = [(r[0], r[2], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows]
    assert sorted(map(str, ((r["doc_id"], r["source"], r["size"]) for r in got))) == sorted(map(str, words))
    sizes, taken = defaultdict(int), defaultdict(list)
    for _, s, n in words:
        sizes[s] += n
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]].append(r)
    for s, goal in levels(dict(sizes)).items():
        assert {r["source_size"] for r in taken[s]} == {sizes[s]} and len({r["target"] for r in taken[s]}) == 1
        assert taken[s][0]["target"] == pytest.approx(goal)
        assert abs(sum(r["taken"] for r in taken[s]) - goal) <= max(r["size"] for r in taken[s])
    return [(r["doc_id"], r["copies"]) for r in got]


def test_targets_and_thresholds(make):
    rows = [(k, "w " * (k * 7 % 23), f"s{k % 5}" if k % 11 else None) for k in range(600)] + [(1000 + k, "x " * 40, "hot") for k in range(300)]
    first = check(make(rows), rows)
    assert sorted(first) == sorted((r["doc_id"], r["copies"]) for r in mixing.mix(make(rows).repartition(7), digits=1).collect())


def test_thresholds_are_nested(make):
    df = make([(k, "w " * (1 + k % 9), "s") for k in range(400)])
    more = [{r["doc_id"] for r in mixing.mix(df, share=s, digits=1).collect() if r["copies"]} for s in (0.1, 0.4, 0.8)]
    assert more[0] < more[1] < more[2]
    hashes = {k: hashlib.md5(f"{k}/{hashlib.md5(('w ' * (1 + k % 9)).encode()).hexdigest()}".encode()).hexdigest() for k in range(400)}
    assert max(hashes[k] for k in more[0]) < min(hashes[k] for k in set(hashes) - more[0])


def test_odd_rows(odd, empty):
    got = mixing.mix(odd, keep=["source", "Size", "hash", "row"]).collect()
    assert len(got) == odd.count() and all(r["hash"] == "x" and r["row"] == "x" for r in got)
    assert all(r["copies"] <= 2 for r in got)
    assert {r["taken"] for r in got if r["size"] == 0} == {0}
    assert mixing.mix(empty).count() == 0
    sizes = mixing.mix(odd.withColumn("tokens", F.when(F.col("doc_id") > 4, 10)), size=F.col("tokens")).agg(F.sum("size")).first()[0]
    assert sizes == 10 * odd.where("doc_id > 4").count()


def test_all_texts_empty(make):
    got = mixing.mix(make([(1, ""), (2, None)])).collect()
    assert [(r["target"], r["taken"]) for r in got] == [(0.0, 0), (0.0, 0)]


def test_a_third_of_all_ids_null_or_one(make):
    rows = [((None, 7, k)[k % 3], " ".join(f"w{k}x{j}" for j in range(5 + k % 40)), f"s{k % 4}" if k % 13 else None) for k in range(3000)]
    check(make(rows), rows)
    got = mixing.mix(make(rows), keep=["source"]).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.02 * r["target"] for r in got)
