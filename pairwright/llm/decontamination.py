"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is some hundred thousand words of consecutive rows in one task. Its words
are numbered by their fingerprints; a suffix array by prefix doubling gives the
Burrows-Wheeler transform, kept as a wavelet matrix with rank counts, and every
``SAMPLE``-th position of a row is kept for locating. All windows of the
benchmark are searched backwards at once: one step narrows the ranges of those
that are left by one word. Occurrences are located by walking back to a sampled
position, checked word by word against the text, and merged to spans.

A text longer than a shard is cut into pieces that overlap by one word less than
the longest window, so no occurrence is lost and memory stays bounded.

The benchmark is the stated query set. Tasks make its windows, which are written
as distinct (window, item) pairs and dealt to blocks of about ``BLOCK`` pairs; the
driver sees one block at a time, as packed arrays, and broadcasts it. Further blocks
are further passes; after ``CHAIN`` of them the rows are written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.frames import bounded, in_blocks, kept_table, lean, named, others, send
from pairwright.llm.words import Words, alphanumeric, blocks, covered, ragged, runs, words_of

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Words of a shard, distance of sampled positions, (window, item) pairs in one pass, passes between two writes.
SHARD, SAMPLE, BLOCK, CHAIN = 1 << 18, 8, 1 << 19, 4
#: Bytes of text from which a shard is made.
SHARD_TEXT = 4 << 20


@dataclass
class Windows:
    """Distinct windows of a block of the benchmark: word fingerprints, last word first, and the items that have each."""

    words: np.ndarray  # one row per window, filled with 0 behind its words
    lengths: np.ndarray
    owner: np.ndarray  # window of each (window, item) pair, in order
    items: np.ndarray  # item of each pair, as a number into ``names``
    names: list[str | None]


def window_rows(items: pa.RecordBatch, size: int = WINDOW) -> pa.RecordBatch:
    """Windows of a batch of (item, text): the fingerprints of a window's words as one key, last word first, and its item."""
    w = words_of(items.column("text"), alphanumeric(), lower=True)
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    whole = w.windows(size)
    at = np.concatenate([whole, w.bounds[short]])
    lengths = np.concatenate([np.full(len(whole), size), w.counts[short]])
    key = np.zeros((len(at), size), np.uint64)
    for k in range(size):
        has = lengths > k
        key[has, k] = w.hashes[at[has] + lengths[has] - 1 - k]
    row = np.concatenate([w.rows[whole], short])
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * size), len(at), [None, pa.py_buffer(key.tobytes())])
    return pa.RecordBatch.from_arrays([raw.cast(pa.binary()), pa.array(lengths, pa.int32()), items.column("item").take(pa.array(row))], ["key", "length", "item"])


def windows_of(pairs: pa.Table, size: int = WINDOW) -> Windows:
    """The distinct windows of a table of (key, length, item) pairs, each pair there once."""
    raw = b"".join(pairs.column("key").to_pylist())
    keys, first, owner = np.unique(np.frombuffer(raw, f"V{8 * size}"), return_index=True, return_inverse=True)
    items = pairs.column("item").combine_chunks().dictionary_encode("encode")
    order = np.argsort(owner, kind="stable")
    lengths = pairs.column("length").to_numpy().astype(np.int64)
    return Windows(
        np.frombuffer(keys.tobytes(), np.uint64).reshape(-1, size), lengths[first], owner[order],
        items.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order], items.dictionary.to_pylist(),
    )


def window_pairs(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, text) -> the distinct (key, length, item) of all windows, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            yield window_rows(b, size)

    return kept_table(items.mapInArrow(lean(run), "key binary, length int, item string").distinct(), "windows")


class Wavelet:
    """Symbols in a wavelet matrix; ``rank`` counts a symbol before a position, for many at once."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.zeros, self.ones = [], []
        s = symbols.astype(np.uint32)
        for b in range(self.bits - 1, -1, -1):
            bit = (s >> np.uint32(b)) & np.uint32(1)
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(s) - int(ones[-1]))
            one = bit.astype(bool)
            s = np.concatenate([s[~one], s[one]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        begin = np.zeros(len(at), np.int64)
        end = at.astype(np.int64)
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> b) & 1).astype(bool)
            ones = self.ones[k]
            b1, e1 = ones[begin].astype(np.int64), ones[end].astype(np.int64)
            begin = np.where(one, self.zeros[k] + b1, begin - b1)
            end = np.where(one, self.zeros[k] + e1, end - e1)
        return end - begin


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; only those that are not yet told apart are sorted again.

    A symbol 0 ends a text. Suffixes that are equal up to their 0 are ordered by position.
    """
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length()) if n else 1
    first = max(1, 62 // bits)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([symbols, np.zeros(first, symbols.dtype)]).astype(np.uint64)
    open_ = np.ones(n, bool)  # not yet past the end of the text
    for k in range(first):
        word = np.where(open_, padded[k : k + n], 0)
        key = (key << np.uint64(bits)) | word
        open_ &= word > 0
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    begins = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    # What ends within the prefix is told apart by position already: the sort is stable.
    depth = first
    ended = ~open_
    place = np.arange(n)
    single = begins & np.concatenate([begins[1:], [True]])
    todo = place[~single & ~ended[order]]
    while len(todo):
        at = order[todo]
        group = rank[at]
        after = np.where(at + depth < n, rank[np.minimum(at + depth, n - 1)], -1)
        sub = np.lexsort((after, group))
        at, group, after = at[sub], group[sub], after[sub]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        order[todo] = at
        rank[at] = np.maximum.accumulate(np.where(new, todo, 0))
        alone = new & np.concatenate([new[1:], [True]])
        past = np.zeros(len(at), bool)
        past[:] = ended[np.minimum(at + depth, n - 1)] | (at + depth >= n)
        keep = ~alone & ~past
        ended_now = at[past]
        ended[ended_now] = True
        todo = todo[keep]
        depth *= 2
    return order


class Shard:
    """FM-index of a row of words: texts one after the other, a 0 behind each."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray, sample: int = SAMPLE):
        self.vocabulary, number = np.unique(hashes, return_inverse=True)
        counts = np.diff(bounds)
        n = len(hashes) + len(counts)
        row = np.repeat(np.arange(len(counts)), counts)
        self.place = np.arange(len(hashes)) + row  # of each word among words and zeros
        symbols = np.zeros(n, np.int64)
        symbols[self.place] = number + 1
        order = suffix_array(symbols)
        before = symbols[order - 1]  # of the first suffix: the zero at the end
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(self.vocabulary) + 2))])
        self.wavelet = Wavelet(before, len(self.vocabulary) + 1)
        self.before = before
        # Sampled positions: every ``sample``-th word of a text, so that no walk leaves its text.
        offset = np.full(n, 1, np.int64)
        offset[self.place] = ragged(counts)
        self.sampled = offset[order] % sample == 0
        self.slot = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows (word fingerprints, last word first) that occur, with the range of suffixes that begin with each."""
        left = np.arange(len(words))
        lo, hi = np.zeros(len(words), np.int64), np.full(len(words), len(self.before), np.int64)
        for k in range(words.shape[1]):
            live = left[k < lengths[left]]
            if not len(live):
                break
            if not len(self.vocabulary):
                return live[:0], lo[:0], hi[:0]
            at = np.searchsorted(self.vocabulary, words[live, k])
            known = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == words[live, k]
            symbol = at[known] + 1
            w = live[known]
            lo[w] = self.first[symbol] + self.wavelet.rank(symbol, lo[w])
            hi[w] = self.first[symbol] + self.wavelet.rank(symbol, hi[w])
            gone = np.zeros(len(words), bool)
            gone[live[~known]] = True
            gone[w[lo[w] >= hi[w]]] = True
            left = left[~gone[left]]
        return left, lo[left], hi[left]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position (among words and zeros) of each suffix, by steps back to a sampled one."""
        rows = rows.copy()
        steps = np.zeros(len(rows), np.int64)
        walk = np.flatnonzero(~self.sampled[rows])
        while len(walk):
            r = rows[walk]
            symbol = self.before[r]
            rows[walk] = self.first[symbol] + self.wavelet.rank(symbol, r)
            steps[walk] += 1
            walk = walk[~self.sampled[rows[walk]]]
        return self.positions[self.slot[rows]] + steps


def occurrences(hashes: np.ndarray, bounds: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of all occurrences in the texts; a text is ``hashes[bounds[k]:bounds[k + 1]]``."""
    if not len(hashes) or not len(windows.words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shard = Shard(hashes, bounds)
    which, lo, hi = shard.search(windows.words, windows.lengths)
    rows = np.repeat(lo, hi - lo) + ragged(hi - lo)
    window = np.repeat(which, hi - lo)
    at = np.searchsorted(shard.place, shard.locate(rows))
    for k in range(windows.words.shape[1]):  # word by word: what the index found is there
        inside = k < windows.lengths[window]
        same = hashes[np.minimum(at + k, len(hashes) - 1)] == windows.words[window, np.maximum(windows.lengths[window] - 1 - k, 0)]
        keep = ~inside | same
        at, window = at[keep], window[keep]
    return at, window


def pieces(bounds: np.ndarray, limit: int, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shards as (first words, ends) of texts or pieces of texts, ``limit`` words or so in each."""
    starts, ends, size = [], [], 0
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        while True:
            end = min(hi, lo + limit)
            if size and size + end - lo > limit:
                yield np.array(starts), np.array(ends)
                starts, ends, size = [], [], 0
            starts.append(lo)
            ends.append(end)
            size += end - lo
            if end == hi:
                break
            lo = end - overlap
    if starts:
        yield np.array(starts), np.array(ends)


def hits_of(w: Words, windows: Windows, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of all occurrences in a block of texts, each once."""
    overlap = windows.words.shape[1] - 1
    at, which = [], []
    for starts, ends in pieces(w.bounds, max(shard, 2 * overlap + 2), overlap):
        counts = ends - starts
        bounds = np.concatenate([[0], np.cumsum(counts)])
        a, k = occurrences(w.hashes[np.repeat(starts, counts) + ragged(counts)], bounds, windows)
        piece = np.searchsorted(bounds, a, "right") - 1
        at.append(starts[piece] + a - bounds[piece])
        which.append(k)
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.stack([np.concatenate(at), np.concatenate(which)]), axis=1) if len(at) > 1 else np.stack([at[0], which[0]])
    return pairs[0], pairs[1]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """Rows of ``docs`` with the benchmark's passages cut out of the text.

    All columns stay; ``text_col`` loses the merged spans (a line break takes the
    place of each), and these are added: ``found_words``, the words of the text,
    ``found_spans``, the merged spans as numbers of first word and word behind the
    last, and ``found_items``, the items with an occurring window, as strings in
    order. Columns of these names are replaced. A null text stays null and has no
    words; an item without words or without text has no window; an item without an
    id is not named. Repeated items count once for an id. An empty benchmark leaves
    all texts as they are.
    """
    spark = docs.sparkSession
    bounded(spark)
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    pairs = window_pairs(items, window)
    n = in_blocks(pairs.count(), block)
    own = others(docs, "found_words", "found_spans", "found_items")
    column = f"c{own.index(text_col)}"
    # Numbered names on the way: mapInArrow takes no names with dots.
    out = docs.select(
        *[named(c).alias(f"c{k}") for k, c in enumerate(own)], F.lit(0).cast("long").alias("found_words"), F.lit(None).cast("array<array<long>>").alias("found_spans"), F.lit(None).cast("array<string>").alias("found_items")
    )
    for k in range(n):
        # By window and item: a window that very many items have is searched for in several blocks.
        part = pairs.where(F.pmod(F.xxhash64("key", "item"), F.lit(n)) == k) if n > 1 else pairs
        sent = send(spark, windows_of(part.toArrow(), window))
        out = out.mapInArrow(lean(_searcher(sent, column, shard, cut=k == n - 1)), out.schema)
        if k % CHAIN == CHAIN - 1 and k < n - 1:
            out = kept_table(out, "searched")
    return out.toDF(*own, "found_words", "found_spans", "found_items")


def _searcher(sent, text_col: str, shard: int, cut: bool):
    """Adds the spans and items of one block of the benchmark to what the row has; after the last block the spans are ``cut``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(**sent.value)
        for b in blocks(batches, text_col, SHARD_TEXT):
            column = b.column(b.schema.get_field_index(text_col))
            w = words_of(column, alphanumeric(), lower=True)
            at, which = hits_of(w, windows, shard)
            hit = covered(len(w.starts), at, windows.lengths[which])
            row = np.searchsorted(w.bounds, at, "right") - 1
            spans, items = _spans(hit, w.bounds), _items(row, which, windows)
            old_s, old_i = b.column(b.schema.get_field_index("found_spans")).to_pylist(), b.column(b.schema.get_field_index("found_items")).to_pylist()
            spans = [_merged((old_s[k] or []) + spans.get(k, [])) for k in range(len(b))]
            items = [sorted(set(old_i[k] or ()) | items.get(k, set())) for k in range(len(b))]
            texts = _cut(column, w, spans) if cut and any(spans) else column
            yield _with(
                b, **{text_col: texts}, found_words=pa.array(w.counts, pa.int64()), found_spans=pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                found_items=pa.array(items, pa.list_(pa.string())),
            )

    return search


def _spans(hit: np.ndarray, bounds: np.ndarray) -> dict[int, list[list[int]]]:
    out: dict[int, list[list[int]]] = {}
    starts, ends = runs(hit, bounds)
    row = np.searchsorted(bounds, starts, "right") - 1
    for k, a, e in zip(row.tolist(), (starts - bounds[row]).tolist(), (ends - bounds[row]).tolist(), strict=True):
        out.setdefault(k, []).append([a, e])
    return out


def _items(row: np.ndarray, which: np.ndarray, windows: Windows) -> dict[int, set[str]]:
    """Row -> names of the items that have one of the windows found in it."""
    lo = np.searchsorted(windows.owner, which)
    n = np.searchsorted(windows.owner, which, "right") - lo
    pairs = np.unique(np.stack([np.repeat(row, n), windows.items[np.repeat(lo, n) + ragged(n)]]), axis=1)
    out: dict[int, set[str]] = {}
    for k, item in pairs.T.tolist():
        if windows.names[item] is not None:
            out.setdefault(k, set()).add(windows.names[item])
    return out


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, e in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return out


def _with(b: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(n, c) for n, c in zip(b.schema.names, b.columns, strict=True)], b.schema.names)


def _cut(column: pa.Array, w: Words, spans: list[list[list[int]]]) -> pa.Array:
    texts = column.to_pylist()
    for k, found in enumerate(spans):
        if found:
            own = [(w.bounds[k] + a, w.bounds[k] + e - 1) for a, e in found]
            texts[k] = _without(texts[k].encode(), [(int(w.starts[a] - w.offsets[k]), int(w.ends[e] - w.offsets[k])) for a, e in own])
    return pa.array(texts, pa.string())


def _without(raw: bytes, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for a, e in spans:
        kept.append(raw[at:a])
        at = e
    kept.append(raw[at:])
    return b"\n".join(kept).decode()
