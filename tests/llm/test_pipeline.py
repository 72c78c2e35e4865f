"""The pipeline's stages on whole small tables, each held against its definition on its own input."""

import re
from collections import defaultdict

import pytest
from cases import odd_rows

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lowered(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shingles(t):
    w = words(lowered(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows before the first stage and after each."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        assert set(cp.COLUMNS) <= set(docs.columns) and (k == 4 or sorted(docs.columns) == sorted(cp.COLUMNS))
        out.append(docs.collect())
    return out


def test_stages_are_those_asked_for():
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "substring_dedup", "decontamination", "mixing"]


def test_quality(spark, steps):
    kept = {r.doc_id for r in steps[1]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in steps[0]:
        w = words(r.text)
        if len(w) < 50:
            assert r.doc_id not in kept
    good = [i for i, q in labels.items() if q == 1 and any(r.doc_id == i and len(words(r.text)) >= 50 for r in steps[0])]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) > 0.95 * len(good) and sum(i in kept for i in bad) < 0.1 * len(bad) + 1
    assert {tuple(r) for r in steps[1]} <= {tuple(r) for r in steps[0]}


def test_near_duplicates(steps):
    sets = {r.doc_id: shingles(r.text) for r in steps[1]}
    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, s in sets.items():
        for j in {j for x in s for j in by[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * len(s | sets[j]):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    assert {r.doc_id for r in steps[2]} == {i for i in sets if root(i) == i}


def test_substrings(steps):
    least = {}
    for r in sorted(steps[2], key=lambda r: r.doc_id):
        w = words(r.text)
        for i in range(len(w) - 12):
            least.setdefault(tuple(w[i : i + 13]), r.doc_id)
    out = {r.doc_id: r for r in steps[3]}
    for r in steps[2]:
        w, gone = words(r.text), set()
        for i in range(len(w) - 12):
            if least[tuple(w[i : i + 13])] < r.doc_id:
                gone |= set(range(i, i + 13))
        kept = [x for k, x in enumerate(w) if k not in gone]
        assert (words(out[r.doc_id].text) if r.doc_id in out else []) == kept
        if r.doc_id in out:
            assert out[r.doc_id].n_chars == len(out[r.doc_id].text) or not gone


def test_benchmark(spark, steps):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall(lowered(r.text))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    out, hits = {r.doc_id: r.text for r in steps[4]}, 0
    for r in steps[3]:
        w, gone = word.findall(lowered(r.text)), set()
        for i in range(len(w) - 9):
            if tuple(w[i : i + 10]) in windows:
                gone |= set(range(i, i + 10))
        hits += bool(gone)
        kept = [x for k, x in enumerate(w) if k not in gone]
        assert word.findall(lowered(out.get(r.doc_id))) == kept and (gone or out[r.doc_id] == r.text)
    assert hits


def test_mix(steps):
    before = {r.doc_id: r for r in steps[4]}
    total = sum(len(words(r.text)) for r in steps[4])
    for r in steps[5]:
        assert tuple(r[c] for c in cp.COLUMNS) == tuple(before[r.doc_id][c] for c in cp.COLUMNS)
        assert r.copies in (1, 2) and r.taken == r.copies * len(words(r.text))
    largest = max(len(words(r.text)) for r in steps[4])
    assert abs(sum(r.taken for r in steps[5]) - 1.5 * total) <= largest * len({r.source for r in steps[4]})


def test_run_equals_the_stages(spark, steps):
    assert sorted(map(str, cp.run(spark, SF).collect())) == sorted(map(str, steps[5]))


def test_odd_documents(spark):
    rows = [(i, t, "en", None if k % 3 else "s", None) for k, (i, t) in enumerate(odd_rows())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert 0 <= out.count() <= len(rows)
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_groups_whose_ids_are_null_or_repeated(spark):
    import random

    rng = random.Random(2)
    texts = [" ".join(f"t{g}w{rng.randrange(10**6)}" for _ in range(80)) for g in range(6)]
    near = [t + " and a tail" for t in texts]
    rows = [(None, texts[0]), (None, texts[0]), (1, texts[0]), (1, texts[0]), (2, texts[0])]
    rows += [(None, texts[1]), (None, near[1]), (None, texts[1])]  # no id at all
    rows += [(5, texts[2]), (5, near[2]), (5, texts[3])]  # one id, two groups
    rows += [(k, t) for k, t in ((9, texts[4]), (8, near[4]), (None, near[4]), (8, near[4]))]
    rows += [(None, ""), (None, ""), (None, None), (3, " ")]  # in no group
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in cp.near_duplicate_groups(spark, docs, SF).collect()]
    key = lambda r: tuple(str(x) for x in r)
    alone = [r for r in got if r[1] not in (texts[1], near[1], texts[2], near[2])]
    assert sorted(alone, key=key) == sorted([(1, texts[0]), (5, texts[3]), (8, near[4]), (None, ""), (None, ""), (None, None), (3, " ")], key=key)
    assert sum(r[1] in (texts[1], near[1]) for r in got) == 1 and sum(r[1] in (texts[2], near[2]) for r in got) == 1
