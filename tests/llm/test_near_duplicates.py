import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from cases import odd_rows

from pairwright.llm import near_duplicates as nd

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows):
    own = [sets(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if own[i] and own[j] and 100 * len(own[i] & own[j]) >= 75 * len(own[i] | own[j]):
                up[root(i)] = root(j)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        low[root(i)].append(r[0])
    out = []
    for i, r in enumerate(rows):
        comp = min((x for x in low[root(i)] if x is not None), default=None)
        out.append((str(r[0]), len(own[i]), str(comp), comp == r[0]))
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in df.collect())


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"c{rng.randrange(10**6)}"
    return words


def families(seed):
    """Families of copies, small changes, and chains whose ends are far apart."""
    rng = random.Random(seed)
    rows, k = [], 0
    for f in range(14):
        base = [f"f{f}w{rng.randrange(400)}" for _ in range(rng.choice([4, 6, 40, 200, 300]))]
        for _ in range(rng.randrange(1, 14)):
            rows.append((k, " ".join(changed(rng, base, rng.choice([0, 0, 1, 3, 6])))))
            if f % 3 == 0:
                base = changed(rng, base, 5)
            k += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(make, seed):
    rows = families(seed)
    assert result(nd.near_duplicates(make(rows))) == brute(rows)


def test_large_bucket_of_unlike_texts(make):
    """Texts that share a passage fall into common buckets without being alike; each is tried, none is linked."""
    rng = random.Random(9)
    shared = [f"p{k}" for k in range(120)]
    rows = [(k, " ".join(shared + [f"o{k}x{rng.randrange(10**6)}" for _ in range(60)])) for k in range(40)]
    rows += [(100 + k, " ".join(changed(rng, shared + [f"z{x}" for x in range(60)], 1))) for k in range(30)]
    assert result(nd.near_duplicates(make(rows))) == brute(rows)


def test_threshold_is_met_exactly(make):
    # 3 + 4 shingles: 3 of 4 shared is 75 %; with one more it is less.
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g"), (3, "q r s t u v w"), (4, "q r s t u v w x y")]
    assert result(nd.near_duplicates(make(rows))) == brute(rows)


def test_odd_rows(odd, empty):
    assert result(nd.near_duplicates(odd)) == brute(odd_rows())
    assert nd.near_duplicates(empty).count() == 0
    assert nd.near_duplicates(odd.where("doc_id in (4, 5)")).select("kept").distinct().collect()[0][0]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(100, 0, -1)] + [(500, 900), (900, 800)], "a long, b long")
    got = {r["node"]: r["comp"] for r in nd.components(links).collect()}
    assert got == dict.fromkeys(range(1, 102), 1) | dict.fromkeys((500, 800, 900), 500)


def test_posterior_bounds():
    """A pair at the threshold is dropped with less than the chosen chance, summed over the batches."""
    least = nd.least_matches(nd.MINIMA, nd.BATCH, 75, 1e-6)
    assert (np.diff(least) > 0).all()
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (2, nd.MINIMA), np.uint8)
    for share, low, high in ((0.75, 0.9995, 1), (0.6, 0, 0.01), (0.3, 0, 0)):
        rows = np.concatenate([x[:1], np.where(rng.random((20_000, nd.MINIMA)) < share, x[0], rng.integers(0, 256, (20_000, nd.MINIMA)))]).astype(np.uint8)
        p, m = nd.survivors(rows, np.zeros(20_000, np.int64), np.arange(1, 20_001), nd.BATCH, least)
        assert low <= len(m) / 20_000 <= high and (p == 0).all()


def test_posterior_bounds_take_little_memory():
    """The driver works them out: the whole table of densities was over 300 MB."""
    tracemalloc.start()
    try:
        least = nd.least_matches(512, 64, 90, 1e-6)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert least.tolist() == [45, 98, 151, 206, 261, 316, 371, 427]  # those of the whole table
    assert peak < 8_000_000


@pytest.mark.parametrize(("growth", "most", "members", "pairs"), [(2, 3, 5, 7), (32, 1 << 15, 1 << 16, 1 << 16)])
def test_rounds_salts_and_slices(make, monkeypatch, growth, most, members, pairs):
    """Many rounds of few pivots, buckets over many tasks and small slices give the same."""
    for name, value in (("GROWTH", growth), ("MOST_PIVOTS", most), ("MEMBERS", members), ("PAIRS", pairs)):
        monkeypatch.setattr(nd, name, value)
    rng = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    rows = [(k, " ".join(changed(rng, base, rng.randrange(12)))) for k in range(60)]
    assert result(nd.near_duplicates(make(rows))) == brute(rows)


def test_bound_from_short_halves():
    rng = np.random.default_rng(2)
    for size in (10, 400, 30_000):
        common, a, b = (rng.integers(0, 2**64, size, np.uint64) for _ in range(3))
        x, y = np.concatenate([common, a]), np.concatenate([common, b])
        bound = nd.shared_at_most(*(np.unique(s.astype(np.uint16)) for s in (x, y)), len(x), len(y))
        assert bound >= size and (size > 1000 or bound < size * 1.1 + 2)
