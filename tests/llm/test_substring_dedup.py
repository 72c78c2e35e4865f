import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cases import odd_rows, prose, same_hash

from pairwright.llm import substring_dedup as sd


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(rows, size):
    """(id, words, removed, kept words) of every row."""
    far = float("inf")
    least = defaultdict(lambda: far)
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            least[g] = min(least[g], far if r[0] is None else r[0])
    out = []
    for r in rows:
        w, gone = words(r[1]), set()
        for i in range(len(w) - size + 1):
            if least[tuple(w[i : i + size])] < (far if r[0] is None else r[0]):
                gone |= set(range(i, i + size))
        out.append((str(r[0]), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), r["all_words"], r["cut_words"], r["kept_words"]) for r in df.collect())


def corpus(seed):
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 30))) for _ in range(12)]
    rows = []
    for k in range(120):
        text = "  ".join(rng.choice([*passages, *(" ".join(f"u{rng.randrange(10**6)}" for _ in range(8)),) * 6]) for _ in range(rng.randrange(8)))
        rows.append((rng.choice([k, k, k, k // 3, None]) if k % 9 == 0 else k, text + rng.choice(["", "\n", "\t x"])))
    return rows


@pytest.mark.parametrize(("group", "flush", "bins"), [(1 << 22, 1 << 20, 1 << 16), (40, 100, 1 << 8), (3, 50, 1 << 4)])
@pytest.mark.parametrize("size", [4, 13])
def test_against_brute_force(make, group, flush, bins, size):
    """Small groups make prefixes longer, windows hot and flushes many; the result is the same."""
    rows = corpus(size)
    out = sd.dedup_substrings(make(rows).repartition(3), size=size, group=group, flush=flush, bins=bins)
    assert result(out) == brute(rows, size)
    for r in out.collect():
        assert words(r["text"]) == words(r["kept_words"]) and r["source"] == "s"


def test_hot_window(make):
    line = " ".join(f"licence{k}" for k in range(13))
    rows = [(k, f"{line} own{k} text{k}") for k in range(300)]
    df = make(rows)
    keyed = df.select(F.col("doc_id").alias("id"), "text", F.hash("text").alias("text_key"))
    part = sd.partition(keyed, group=64)
    assert len(part.hot) >= 1 and part.least[0] == 0
    assert result(sd.dedup_substrings(df, group=64)) == brute(rows, 13)


def test_groups_fit():
    """No group of whole bins holds more than its limit, and every suffix has one group."""
    import numpy as np

    part = sd.Partition((1, 4), np.array([[0, -1], [1, -1]]), 2, 3, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    h = np.array([0, 1 << 63, 1 << 63], np.uint64)
    assert part.of([h, np.array([0, 0, 1 << 63], np.uint64)], np.array([7, 8, 9], np.uint64)).tolist() == [0, 1, 2]


def test_odd_rows(odd, empty):
    out = sd.dedup_substrings(odd)
    assert result(out) == brute(odd_rows(), 13)
    assert sorted(out.columns) == sorted([*[c for c in odd.columns if c != "kept_words"], "all_words", "cut_words", "kept_words"])
    texts = {r["doc_id"]: r["text"] for r in out.where("doc_id in (3, 4, 5, 12)").collect()}
    assert (texts[3], texts[4], texts[5]) == (None, "", " \n\t ")
    assert sd.dedup_substrings(empty).count() == 0


def test_passages_go_with_the_space_behind_them(make):
    shared = " ".join(f"s{k}" for k in range(20))
    out = sd.dedup_substrings(make([(1, shared), (2, f"Début.\n{shared}\n\nEnd  of it. "), (3, f"{shared}\n")]))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: shared, 2: "Début.\nEnd  of it. ", 3: ""}


def test_texts_of_equal_hash_are_told_apart(spark, make):
    shared = prose(1, 20, 500)
    a, b = same_hash(spark, shared, prose(2, 30, 500))
    rows = [(1, shared), (None, a), (None, b)]
    assert result(sd.dedup_substrings(make(rows))) == brute(rows, 13)
