import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import odd_rows, prose

from pairwright.llm import queries
from pairwright.llm import token_alignment as ta


@pytest.fixture(scope="module")
def sides():
    """Ids and bytes of each token, by the tokenizer file and token by token."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in keep)}
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def a(text):
        e = t.encode(" " + text, add_special_tokens=False)
        return [(i, bytes(letters[c] for c in t.id_to_token(i))) for i in e.ids]

    def b(text):
        out = []
        for i in sp.encode(text):
            p = sp.id_to_piece(i)
            out.append((i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()))
        return out

    return a, b


def brute(sides, rows):
    docs = []
    for d, text in rows:
        a, b = (side(text or "") for side in sides)
        if not text or any(b"".join(x for _, x in s) != (" " + text).encode() for s in (a, b)):
            a = b = []
        ends = [np.cumsum([len(x) for _, x in s]).tolist() for s in (a, b)]
        begins = [[0, *e[:-1]] for e in ends]
        both = sorted(set(ends[0]) & set(ends[1]))
        links = [(a[ends[0].index(e)][0], b[ends[1].index(e)][0]) for e in both]
        groups = []
        for lo, hi in zip([0, *both], both):
            groups.append("|".join(",".join(str(i) for (i, _), e in zip(s, es) if lo < e <= hi) for s, es in zip((a, b), ends)))
        shared = sum(max(x, u) < min(y, v) for x, y in zip(begins[0], ends[0]) for u, v in zip(begins[1], ends[1])) if len(a) < 400 else None
        docs.append((d, len(a), len(b), links, ";".join(groups), shared))
    count = Counter(pair for doc in docs for pair in doc[3])
    most = {}
    for (_, y), n in count.items():
        most[y] = max(n, most.get(y, 0))
    return [
        (d, n_a, n_b, len(links), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "", g, shared)
        for d, n_a, n_b, links, g, shared in docs
    ]


def texts():
    rng = random.Random(3)
    out = [(k, prose(k, rng.randrange(1, 60), 40)) for k in range(40)]
    alphabet = "ab \n\t<|>éß漢字😀́ 0123ﬁ"
    out += [(100 + k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))) for k in range(80)]
    out += [(300, "<|endoftext|> <s> </s> <unk> <0x41>"), (301, "▁x"), (302, " "), (303, "a\x00b"), (304, None), (305, ""), (None, "null id"), (306, "  two  spaces  ")]
    return [*out, *out[:5]]


@pytest.mark.parametrize("pairs", [ta.PAIRS, 40])
def test_against_brute_force(spark, sides, pairs):
    rows = texts()
    got = ta.align_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), pairs=pairs).collect()
    want = brute(sides, rows)
    key = lambda r: tuple(str(x) for x in r)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "grouped")
    assert sorted((tuple(r[n] for n in names) for r in got), key=key) == sorted((w[:7] + (w[8],) for w in want), key=key)
    assert sum(r["n_overlaps"] for r in got) == sum(w[9] for w in want)


def test_query_against_brute_force(spark, sides, tmp_path):
    rows = texts()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_token_alignment(spark, str(tmp_path)).drop("n_overlaps").collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((w[:8] for w in brute(sides, rows)), key=key)


def test_odd_rows(odd, sides):
    rows = [(r[0], r[1]) for r in odd_rows()]
    got = {(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], hashlib.sha256(r["grouped"].encode()).hexdigest()) for r in ta.align_tokens(odd).collect()}
    short = [(d, t) for d, t in rows if len(t or "") < 5000]
    for d, n_a, n_b, n, _, _, _, _, g, _ in brute(sides, short):
        assert (d, n_a, n_b, n, hashlib.sha256(g.encode()).hexdigest()) in got
    assert len(ta.align_tokens(odd).collect()) == len(rows)


def test_empty(empty):
    assert ta.align_tokens(empty).collect() == []


def test_rank_file_gives_the_ids_of_the_tokenizer_file(spark, sides):
    side = ta.Side.of(ta.SIDE_A)
    sample = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    sample += ["".join(chr(c) for c in range(lo, min(lo + 500, 0xD800))) for lo in range(1, 0xD800, 500)]
    ids, counts = side.ids(sample)
    ends = np.cumsum(counts)
    for t, e, n in zip(sample, ends, counts):
        assert ids[e - n : e].tolist() == [i for i, _ in sides[0](t)]


def test_all_pairs_that_share_a_byte():
    rng = np.random.default_rng(2)
    for _ in range(50):
        cuts = [np.unique(np.append(rng.choice(np.arange(1, 60), rng.integers(1, 30), replace=False), [0, 30])) for _ in range(2)]
        row = [np.where(c < 30, 0, 1) for c in cuts]
        ends = [np.append(c[1:], 60) for c in cuts]
        x, y = ta.overlaps(cuts[0], row[0], cuts[1], row[1])
        want = {(i, j) for i in range(len(cuts[0])) for j in range(len(cuts[1])) if max(cuts[0][i], cuts[1][j]) < min(ends[0][i], ends[1][j])}
        assert len(x) == len(want) and set(zip(x.tolist(), y.tolist())) == want
