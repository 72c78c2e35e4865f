import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import prose

from pairwright.llm import decontamination as dc

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))


def brute(text, items, size):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        for a in range(max(1, len(x) - size + 1) if x else 0):
            g = x[a : a + size]
            for i in range(len(w) - len(g) + 1):
                if w[i : i + len(g)] == g:
                    hit |= set(range(i, i + len(g)))
                    found |= {str(item)} if item is not None else set()
    return len(w), hit, sorted(found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=25), min_size=1, max_size=6))
def test_suffix_array_and_ranks(texts):
    symbols = np.array([x for t in texts for x in (*t, 0)], np.int64)
    order = dc.suffix_array(symbols)
    ends = np.flatnonzero(symbols == 0)

    def key(i):
        return (*symbols[i : ends[np.searchsorted(ends, i)] + 1].tolist(), i)

    assert order.tolist() == sorted(range(len(symbols)), key=key)
    tree = dc.Wavelet(symbols, int(symbols.max()))
    at = np.arange(len(symbols) + 1)
    for s in range(int(symbols.max()) + 1):
        assert tree.rank(np.full(len(at), s), at).tolist() == [int((symbols[:a] == s).sum()) for a in at]


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_every_occurrence_is_located(data):
    texts = data.draw(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=5))
    phrases = data.draw(st.lists(st.lists(st.sampled_from("abcd"), min_size=1, max_size=6), min_size=1, max_size=6))
    pairs = dc.window_rows(dc.pa.RecordBatch.from_pydict({"item": [str(k) for k in range(len(phrases))], "text": [" ".join(p) for p in phrases]}), 4)
    windows = dc.windows_of(dc.pa.Table.from_pylist([dict(x) for x in sorted({tuple(r.items()) for r in pairs.to_pylist()})]), 4)
    flat = dc.words_of(dc.pa.array([" ".join(t) for t in texts]), dc.alphanumeric())
    at, which = dc.hits_of(flat, windows, shard=data.draw(st.sampled_from([4, 9, 1000])))
    got = {(int(a), tuple(windows.words[k][: windows.lengths[k]][::-1].tolist())) for a, k in zip(at, which, strict=True)}
    want = set()
    for r in range(len(texts)):
        own = flat.hashes[flat.bounds[r] : flat.bounds[r + 1]].tolist()
        for k in range(len(windows.words)):
            g = windows.words[k][: windows.lengths[k]][::-1].tolist()
            want |= {(int(flat.bounds[r]) + i, tuple(g)) for i in range(len(own) - len(g) + 1) if own[i : i + len(g)] == g}
    assert got == want and len(at) == len(got)


@pytest.mark.parametrize("block", [1 << 19, 7, 1])
def test_documents_against_brute_force(spark, make, block):
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "gamma,", "delta-1", "é", "zeta"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 2, 3, 5, 9])))) for k in range(12 if block > 1 else 2)] + [(None, "beta beta beta"), (99, None), (3, "zeta zeta")]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for k in range(40)] + [(100, None), (101, ""), (None, "beta beta beta alpha"), (5, "zeta zeta")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, found_spans string")
    out = dc.decontaminate(make(docs), bench, window=4, shard=16, block=block).collect()
    assert len(out) == len(docs)
    got = sorted((str(r["doc_id"]), r["found_words"], sum(e - a for a, e in r["found_spans"]), r["found_items"]) for r in out)
    want = sorted((str(d), n, len(hit), found) for d, t in docs for n, hit, found in [brute(t, items, 4)])
    assert got == want
    source = {(str(d), t) for d, t in docs}
    for r in out:
        assert r["source"] == "s" and (r["text"] is None) == (r["doc_id"] == 100)
        n, hit, _ = next(brute(t, items, 4) for d, t in source if str(r["doc_id"]) == d and brute(t, items, 4)[0] == r["found_words"])
        assert len(words(r["text"])) == n - len(hit)


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "one two"), (2, None), (None, "three")], "item_id long, text string")
    out = {r["doc_id"]: r for r in dc.decontaminate(odd.where("doc_id in (3, 4, 5, 6, 7, 12)"), bench).collect()}
    assert (out[6]["found_spans"], out[6]["found_items"], out[6]["text"]) == ([[0, 2]], ["1"], "\n")
    assert (out[3]["text"], out[3]["found_words"], out[12]["found_words"]) == (None, 0, 1)
    assert dc.decontaminate(odd, bench).count() == odd.count()
    assert dc.decontaminate(empty, bench).count() == 0
    none = dc.decontaminate(odd, bench.where("false"))
    assert none.select("text").exceptAll(odd.select("text")).count() == 0 and none.count() == odd.count()


def test_blocks_with_and_without_hits(spark, make):
    """A task with many blocks of which only some have passages."""
    rows = [(k, prose(k, 120_000) + (" one two" if k % 2 else "")) for k in range(6)]
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    out = dc.decontaminate(make(rows).coalesce(1), bench).collect()
    assert {r["doc_id"]: r["found_items"] for r in out} == {k: ["1"] if k % 2 else [] for k in range(6)}
    assert all(r["text"].endswith("\n") == (r["doc_id"] % 2 == 1) for r in out)


def test_a_window_of_very_many_items(spark, make):
    """Blocks are dealt by window and item, so no block holds all items of a common window."""
    bench = spark.range(500).selectExpr("id AS item_id", "'one two three' AS text")
    pairs = dc.window_pairs(bench.selectExpr("CAST(item_id AS string) AS item", "text"))
    assert pairs.count() == 500
    out = dc.decontaminate(make([(1, "zero one two three four"), (2, "one two")]), bench, block=200).collect()
    assert {r["doc_id"]: (r["found_spans"], len(r["found_items"])) for r in out} == {1: ([[1, 4]], 500), 2: ([], 0)}


def test_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "a one two b", "x", "y")], "doc_id long, text string, `a.b` string, `c``d` string")
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    r = dc.decontaminate(docs, bench).first()
    assert (r["a.b"], r["c`d"], r["found_items"]) == ("x", "y", ["1"])
