"""The numpy text core against regular expressions."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairwright.llm import words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab Z09\n\t\r\x0b\x0c\x1c\x85  é漢-_'<|😀"), max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_expression(texts):
    column = pa.array(texts, pa.string())
    w = words.words_of(column, words.spaced())
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    got = [[w.data[w.starts[i] : w.ends[i]].tobytes().decode() for i in range(w.bounds[k], w.bounds[k + 1])] for k in range(len(texts))]
    assert got == want
    lower = words.words_of(column, words.alphanumeric(), lower=True)
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(fold)) for t in texts]
    assert [[lower.data[lower.starts[i] : lower.ends[i]].tobytes().decode() for i in range(lower.bounds[k], lower.bounds[k + 1])] for k in range(len(texts))] == want
    flat = [x for t in want for x in t]
    assert (len(set(flat)), {}) == (len(set(lower.hashes.tolist())), {})
    assert len({(a, b) for a, b in zip(flat, lower.hashes.tolist(), strict=True)}) == len(set(flat))


def test_fingerprints_do_not_depend_on_place_or_piece(monkeypatch):
    text = " ".join(f"word{k % 97}" for k in range(5000))
    whole = words.words_of(pa.array([text]), words.spaced()).hashes
    monkeypatch.setattr(words, "PIECE", 100)
    assert (words.words_of(pa.array(["x", text]), words.spaced()).hashes[1:] == whole).all()
    assert len(np.unique(whole)) == 97


def test_windows_and_cover():
    w = words.words_of(pa.array(["a b c", "d", None, "e f"]), words.spaced())
    assert w.windows(2).tolist() == [0, 1, 4]
    assert words.chained(w.hashes, np.array([0]), 2) != words.chained(w.hashes[::-1].copy(), np.array([4]), 2)
    assert words.covered(6, np.array([1, 2]), 2).tolist() == [False, True, True, True, False, False]
    assert words.covered(6, np.array([0, 4]), np.array([1, 2])).tolist() == [True, False, False, False, True, True]


@pytest.mark.parametrize("limit", [1, 7, 1000])
def test_blocks_keep_all_rows(limit):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["abc", None, "", "d" * 20, "é"])})
    out = list(words.blocks(iter([batch]), "text", limit))
    assert pa.Table.from_batches(out).to_pydict() == batch.to_pydict()
    assert all(len(b) == 1 or sum(len((x or "").encode()) for x in b.column(0).to_pylist()) <= limit for b in out)
