import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from cases import odd_rows, prose, same_hash

from pairwright.llm import lm_scoring as lm

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)), None]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1


def brute(rows):
    c = Counter(t for r in rows if not held(r[0]) for t in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    return sorted(
        (str(r[0]), held(r[0]), len(tokens(r[1])), sum(c[t] > 0 for t in tokens(r[1])), n, round(sum(log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(r[1])), 5)) for r in rows
    )


def result(df):
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in df.collect())


def same(a, b):
    assert [x[:5] for x in a] == [x[:5] for x in b]
    assert [x[5] for x in a] == pytest.approx([x[5] for x in b], abs=2e-5)


@pytest.mark.parametrize(("group", "flush"), [(1 << 22, 1 << 19), (50, 60)])
def test_base_scores(make, group, flush):
    rows = [(k, prose(k, 60 + k % 30, 200) + " The the THE" * (k % 4)) for k in range(60)]
    same(result(lm.score(make(rows).repartition(4), group=group, flush=flush)), brute(rows))


def test_odd_rows(odd, empty):
    same(result(lm.score(odd)), brute(odd_rows()))
    assert lm.score(empty).count() == 0


def test_nothing_to_learn_from(make):
    k = next(k for k in range(100) if held(k))
    (row,) = lm.score(make([(k, "a b")])).collect()
    assert (row["train_tokens"], row["n_known"], row["score"], row["base_score"]) == (0, 0, None, 0.0)


def counted(spark, make, rows, bits, groups=4):
    df = make(rows)
    counts = lm.count_ngrams(df, groups).cache()
    return lm.build_filter(counts, groups, 8 * -(-bits // (8 * groups)))


def test_counts_in_the_filter_are_never_too_low(spark, make):
    texts = [prose(k, 300, 500) for k in range(20)]
    own = counted(spark, make, list(enumerate(texts)), 1 << 20)
    c = Counter(t for x in texts for t in tokens(x))
    w = lm.words_of(lm.words_of.__globals__["pa"].array(texts), lm.spaced(), lower=True)
    _, token, pair = lm.tokens_of(w)
    assert own.total == sum(c.values()) and own.distinct == len(c)
    keys, n = np.unique(token, return_counts=True)
    got = own.levels(keys, 1)
    assert (got >= lm.level(n)).all() and (got == lm.level(n)).mean() > 0.9
    keys, n = np.unique(pair, return_counts=True)
    got = own.levels(keys, 2)
    assert (got >= lm.level(n)).all() and (got == lm.level(n)).mean() > 0.9
    unseen = np.random.default_rng(1).integers(0, 2**64, 5000, np.uint64)
    assert (own.levels(unseen, 2) > 0).mean() < 0.06


def test_model_prefers_text_like_its_own(make):
    """Held-out texts with the corpus's word order score better than the same words shuffled."""
    import random

    rng = random.Random(0)
    chain = {k: [rng.randrange(60) for _ in range(2)] for k in range(60)}

    def walk(n):
        k, out = rng.randrange(60), []
        for _ in range(n):
            out.append(f"w{k}")
            k = rng.choice(chain[k])
        return out

    rows = [(k, " ".join(walk(100))) for k in range(200)]
    heldout = [(k, walk(100)) for k in range(1000, 1200) if held(k)]
    rows += [(k, " ".join(w)) for k, w in heldout] + [(next(x for x in range(5000 + 50 * k, 9000000) if held(x)), " ".join(rng.sample(w, len(w)))) for k, w in heldout]
    out = {r["doc_id"]: r for r in lm.score(make(rows)).collect()}
    natural, mixed = [out[k]["score"] for k, _ in heldout], [r["score"] for r in out.values() if r["doc_id"] >= 5000]
    assert np.mean(natural) > np.mean(mixed) + 20
    assert np.mean(natural) > np.mean([out[k]["base_score"] for k, _ in heldout]) + 20


def test_no_ngram_is_left_out_of_scores(make):
    """Scores follow from all n-grams, whatever number of bits is sent at once and of texts is scored at once."""
    rows = [(k, prose(k, 200, 400)) for k in range(40)] + [(None, prose(3, 200, 400)), (900, "")]
    whole, blocked = ({r["doc_id"]: r["score"] for r in lm.score(make(rows), bits=bits, part=part).collect()} for bits, part in ((lm.BITS, lm.ROUND), (1 << 12, 20000)))
    assert blocked == pytest.approx(whole, abs=1e-9)
    one, two, v = Counter(), Counter(), set()
    for i, t in rows:
        if not held(i):
            own = [None, *tokens(t)]
            one.update(own[1:])
            two.update(zip(own, own[1:]))
    n, v = sum(one.values()), len(one)

    def typical(c):
        return float(lm.typical(lm.level(np.array([c])))[0])

    def expected(t):
        own, out = [None, *tokens(t)], 0.0
        for a, b in zip(own, own[1:]):
            share, context = (typical(one[b]) + lm.HALF) / (n + lm.HALF * (v + 1)), typical(one[a])
            out += log10((min(typical(two[a, b]), context) + lm.PRIOR * share) / (context + lm.PRIOR))
        return out

    for i, t in rows:  # false memberships are rare
        assert whole[i] == pytest.approx(expected(t), abs=0.1 + 0.05 * len(tokens(t)))


def test_texts_of_equal_hash_are_told_apart(spark, make):
    rows = [(None, t) for t in same_hash(spark, "a b c", "a")] + [(1, "a b c d")]
    same(result(lm.score(make(rows))), brute(rows))
