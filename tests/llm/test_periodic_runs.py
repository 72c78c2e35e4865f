import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from cases import odd_rows

from pairwright.llm import periodic_runs as pr
from pairwright.llm import queries
from pairwright.llm.words import spaced, words_of


def brute(w, shortest=24, copies=3):
    """All runs by trying every period at every word."""
    out = []
    for q in range(1, len(w) // copies + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - s
            if n >= max(shortest, copies * q) and not any(all(w[x] == w[x + p] for x in range(s, s + n - p)) for p in range(1, q)):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(w, runs):
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def periodic(rng):
    k = rng.choice([1, 2, 2, 3, 50])
    w = [f"v{rng.randrange(k)}" for _ in range(rng.choice([0, 1, 5, 20, 30, 60, 150]))]
    for _ in range(rng.randrange(3)):
        p = [f"v{rng.randrange(rng.choice([2, 3, 30]))}" for _ in range(rng.choice([1, 2, 5, 8, 9, 16, 17, 20, 33, 70]))]
        at = rng.randrange(len(w) + 1)
        w[at:at] = (p * 6)[: rng.randrange(1, len(p) * 5 + 1)]
    return w


@pytest.mark.parametrize("shortest, copies", [(24, 3), (10, 3), (5, 4), (40, 3), (3, 3)])
def test_runs_against_brute_force(shortest, copies):
    rng = random.Random(shortest * 10 + copies)
    for _ in range(60):
        texts = [periodic(rng) for _ in range(5)]
        w = words_of(pa.array([" ".join(t) for t in texts] + [None, ""]), spaced())
        got = pr.runs_of(w, shortest, copies)
        want = [[(s + int(w.bounds[k]), n, q) for s, n, q in brute(t, shortest, copies)] for k, t in enumerate(texts)]
        assert [tuple(r) for r in got.tolist()] == sum(want, [])
        assert pr.collapsed(w, got).to_pylist() == [kept(t, brute(t, shortest, copies)) for t in texts] + ["", ""]


def test_a_gram_that_comes_back_inside_a_period():
    rng = random.Random(4)
    part = [f"p{k}" for k in range(20)]
    period = part + ["a"] + part + [f"b{rng.randrange(9)}" for _ in range(30)]
    w = ["x"] + period * 4 + ["y"]
    assert [tuple(r) for r in pr.runs_of(words_of(pa.array([" ".join(w)]), spaced())).tolist()] == brute(w) == [(1, 4 * len(period), len(period))]


def test_long_text_of_one_word():
    w = words_of(pa.array(["a " * 200_000, "b " * 23, "c " * 24]), spaced())
    assert pr.runs_of(w).tolist() == [[0, 200_000, 1], [200_023, 24, 1]]


def test_period_of_thousands_of_words():
    w = words_of(pa.array([" ".join(str(i % 4999) for i in range(30_000))]), spaced())
    assert pr.runs_of(w).tolist() == [[0, 30_000, 4999]]


def test_rows(odd):
    rows = odd_rows()
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["best"], r["collapsed"]) for r in pr.periodic_runs(odd).collect())
    want = []
    for d, text in ((r[0], r[1]) for r in rows):
        w = words(text)
        runs = brute(w) if len(w) < 5000 else []
        best = max(range(len(runs)), key=lambda k: (runs[k][1] / runs[k][2], -k)) if runs else None
        want.append((str(d), len(w), runs, best, kept(w, runs)))
    assert got == sorted(want)


def test_empty(empty):
    assert pr.periodic_runs(empty).collect() == []


def test_ties_go_to_the_first():
    assert pr._best([(0, 24, 8), (30, 30, 10), (70, 24, 8)]) == 0
    assert pr._best([(0, 24, 8), (30, 31, 10)]) == 1
    assert pr._best([]) is None


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, " ".join(periodic(rng)) if k % 7 else f"a\t{k}\n" * k) for k in range(300)] + [(None, "x " * 30), (301, None), (302, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {str(r["doc_id"]): r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    planted = 0
    for d, text in rows:
        w = words(text)
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute(w)
        r = got[str(d)]
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept(w, runs).encode()).hexdigest()
    assert planted > 10
