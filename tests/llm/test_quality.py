import os
import re
from collections import Counter

import numpy as np
import pytest

from cases import odd_rows, prose

from pairwright.llm import quality


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeated), failed


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1), (6, 0), (8, 1), (None, 0), (4, None), (1, 1)], "doc_id long, quality int")


def test_counts(spark, make, odd, labels):
    hard = ["a b c a b c a", "x\n\nx\n x\nx ", "a b c\na b c\n\x0b\na b c", "#*$ %&|<> é# " * 20, prose(1, 70) + "\n" + prose(1, 70), "é " * 60, "a\x85b\xa0c d"]
    rows = [*odd_rows(), *((100 + k, t) for k, t in enumerate(hard))]
    out = quality.judge(make(rows), labels)
    assert sorted(tuple(r[c] for c in COUNTS) for r in out.collect()) == sorted(brute(r[1]) for r in rows)
    assert all(not r["kept"] for r in out.where("base_failed").collect())
    assert out.columns.count("n_words") == 1 and "KEPT" not in out.columns and out.where("source = 's'").count() == len(rows)


def test_without_labels(odd, empty, labels):
    out = quality.judge(odd, labels.where("quality = 1"))
    assert out.where("probability is not null or kept = base_failed").count() == 0
    assert quality.judge(empty, labels).count() == 0
    assert quality.judge(odd, labels.where("false")).count() == odd.count()


def held_back(spark, sf):
    """Labelled rows, one half to learn from and one to judge."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.judge(docs, labels.where("doc_id % 2 = 0"))
    return out.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()


def test_held_out_accuracy_and_calibration(spark):
    rows = [r for r in held_back(spark, "/root/testdata/sf0.1") if not r["base_failed"]]
    good, p = np.array([r["quality"] for r in rows]), np.array([r["probability"] for r in rows])
    kept = np.array([r["kept"] for r in rows])
    assert (kept == (good == 1)).mean() > 0.97
    assert kept[good == 1].mean() > 0.98
    assert abs(p.mean() - good.mean()) < 0.05
    assert ((p - good) ** 2).mean() < 0.03


def test_training_repeats_and_is_bounded(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    a, b = quality.train(docs, labels), quality.train(docs.repartition(5), labels)
    assert (a.weights == b.weights).all() and (a.slope, a.offset) == (b.slope, b.offset)
    texts, sizes = quality.labelled_sample(docs, labels, "doc_id", "text", "quality", 20)
    assert {r["good"]: r["count"] for r in texts.groupBy("good").count().collect()} == {0: 20, 1: 20}
    assert sum(sizes.values()) == labels.count()


def test_training_leaves_the_driver_alone(spark, monkeypatch):
    """The sample's features go to a task; the driver fits nothing."""
    rows = [(k, ("clean sentence of plain words here " if k % 2 else "buy $$$ now ### click ") * 20) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    driver, fit = os.getpid(), quality._fit

    def elsewhere(*args):
        assert os.getpid() != driver
        return fit(*args)

    monkeypatch.setattr(quality, "_fit", elsewhere)
    model = quality.train(docs, labels)
    assert model.weights.any() and len(model.weights) == quality.BUCKETS
