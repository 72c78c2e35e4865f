"""Periodic runs of words: seeds from an index of k-grams, extended along their diagonals.

A run is a stretch of words with smallest period ``q`` that is at least ``shortest``
words and ``copies`` periods long. On the diagonal of lag ``q``, where word i meets
word i + q, it is a stretch of equal words, and the length of that stretch has a
guaranteed minimum:

* ``base`` words for any lag: max(shortest - q, (copies - 1) q) is nowhere smaller;
* 2 q words for a lag q, as there are three periods or more.

So lags are taken in bands: up to ``base`` by the index of ``base``-grams, and those
in (k / 2, k] by the index of k-grams, k = 2 base, 4 base, .. A gram of a band is as
long as any of its lags. Then only pairs of an occurrence and the next one of the
same gram in the same document have to be enumerated: an occurrence in between, j
words on, would give the run the period gcd(j, q). A k-gram can only be repeated
where both its halves are, so each index is made of what was repeated in the one
before, and a word takes part in log2(n) of them at most, whatever the text is.

Pairs of a lag come in order; the stretch of a pair is extended to both sides unless
the table of what is covered on its lag reaches beyond it already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.frames import bounded, lean
from pairwright.llm.words import WORD_STEP, Words, blocks, chained, gathered, mix, spaced, string_array, words_of

#: Words and periods that a run has at least.
SHORTEST, COPIES = 24, 3

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("best", pa.int32()), ("collapsed", pa.string())])
_FOUND_SQL = "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, best int, collapsed string"


def guaranteed(shortest: int, copies: int) -> int:
    """Equal words that the diagonal of any run has at least."""
    return min(max(shortest - q, (copies - 1) * q) for q in range(1, max(2, shortest)))


def repeated(key: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def seeds(w: Words, base: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each band of lags: k, and the pairs (i, lag) of a k-gram at word i and its next occurrence in the row, sorted by (lag, i)."""
    rows = w.rows.astype(np.uint64)
    stop = np.repeat(w.bounds[1:], w.counts)
    k, at = base, w.windows(base)
    key = mix(chained(w.hashes, at, base) + rows[at] * np.uint64(0x9E3779B97F4A7C15))
    gram = np.zeros(len(rows), np.uint64)
    again = np.zeros(len(rows), bool)
    while len(at):
        more = repeated(key)
        at, key = at[more], key[more]
        order = np.argsort(key, kind="stable")
        i, next_ = at[order[:-1]], at[order[1:]]
        lag = next_ - i
        fit = (key[order[:-1]] == key[order[1:]]) & (lag <= k) & (lag > (0 if k == base else k // 2))
        i, lag = i[fit], lag[fit]
        order = np.lexsort((i, lag))
        yield k, i[order], lag[order]
        gram[at], again[at] = key, True
        whole = at[at + 2 * k <= stop[at]]
        whole = whole[again[whole + k]]
        key = mix(gram[whole] * np.uint64(WORD_STEP) + gram[whole + k])
        again[at] = False
        at, k = whole, 2 * k


def equal_until(h: np.ndarray, x: int, lag: int, stop: int) -> int:
    """First y >= x where word y differs from word y + lag, or whose partner is ``stop``."""
    size = 64
    while x + lag < stop:
        n = min(size, stop - lag - x)
        differ = h[x : x + n] != h[x + lag : x + lag + n]
        if differ.any():
            return x + int(differ.argmax())
        x, size = x + n, size * 4
    return x


def equal_since(h: np.ndarray, x: int, lag: int, begin: int) -> int:
    """Smallest y <= x from which on every word before x equals its partner."""
    size = 64
    while x > begin:
        n = min(size, x - begin)
        differ = h[x - n : x] != h[x - n + lag : x + lag]
        if differ.any():
            return x - int(differ[::-1].argmax())
        x, size = x - n, size * 4
    return x


def runs_of(w: Words, shortest: int = SHORTEST, copies: int = COPIES) -> np.ndarray:
    """(start, length, period) of all runs of a block as rows, by start and period; starts count from the block's first word."""
    found: list[tuple[int, int, int]] = []
    covered: dict[int, int] = {}  # lag -> end of the furthest stretch that was extended
    for k, i, lag in seeds(w, guaranteed(shortest, copies)):
        if not len(i):
            continue
        # Pairs that follow each other within k words are in one stretch.
        new = np.flatnonzero(np.concatenate([[True], (lag[1:] != lag[:-1]) | (i[1:] > i[:-1] + k)]))
        row = np.searchsorted(w.bounds, i[new], "right") - 1
        for first, last, q, r in zip(i[new].tolist(), i[np.append(new[1:], len(i)) - 1].tolist(), lag[new].tolist(), row.tolist(), strict=True):
            if first < covered.get(q, 0):
                continue
            begin = equal_since(w.hashes, first, q, int(w.bounds[r]))
            end = equal_until(w.hashes, last + k, q, int(w.bounds[r + 1]))
            covered[q] = end
            if end + q - begin >= max(shortest, copies * q):
                found.append((begin, end + q - begin, q))
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _best(runs: list[tuple[int, int, int]]) -> int | None:
    """Number of the run with the greatest exact length / period; the first of equal ones."""
    best = None
    for k, (_, length, period) in enumerate(runs):
        if best is None or length * runs[best][2] > runs[best][1] * period:
            best = k
    return best


def collapsed(w: Words, runs: np.ndarray) -> pa.Array:
    """The texts' words, joined by one space, without what runs repeat after their first period."""
    n = len(w.starts)
    steps = np.bincount(runs[:, 0] + runs[:, 2], minlength=n + 1)[: n + 1] - np.bincount(runs[:, 0] + runs[:, 1], minlength=n + 1)[: n + 1]
    keep = np.cumsum(steps)[:n] == 0
    starts, rows = w.starts[keep], w.rows[keep]
    lengths = w.ends[keep] - starts + 1  # with the byte after the word, which becomes the space
    lengths[np.append(rows[1:] != rows[:-1], True)[: len(rows)]] -= 1
    data = gathered(np.append(w.data, np.uint8(0x20)), starts, lengths)
    ends = np.cumsum(lengths)
    data[ends[np.append(rows[1:] == rows[:-1], False)[: len(rows)]] - 1] = 0x20
    return string_array(data, np.bincount(rows, lengths, len(w.bounds) - 1).astype(np.int64))


def _find(shortest: int, copies: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            w = words_of(b.column("text"), spaced())
            runs = runs_of(w, shortest, copies)
            row = np.searchsorted(w.bounds, runs[:, 0], "right") - 1
            cut = np.searchsorted(row, np.arange(len(b) + 1))
            own = runs - np.stack([w.bounds[row], np.zeros_like(row), np.zeros_like(row)], axis=1)
            listed = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(own[:, c]) for c in range(3)], fields=list(_RUN)))
            best = [_best(own[x:y].tolist()) if y > x else None for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            columns = [b.column("doc_id"), pa.array(w.counts.astype(np.int64)), listed, pa.array(best, pa.int32()), collapsed(w, runs).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=_FOUND)

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, copies: int = COPIES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs, best, collapsed.

    ``runs`` lists start (a word's number from 0), length and period by start and
    period, ``best`` is the number in it of the run with the greatest length /
    period (the first of equal ones; null without runs), ``collapsed`` the words,
    joined by one space, without those that a run has after its first period.
    ``copies`` is 3 at least. Words are ``[^\\x20\\x09-\\x0D]+`` and compared by
    64-bit fingerprints. A null text has no words. Null ids and repeated rows stay
    as they are; other columns are not looked at. A text is worked on by one task,
    in time that grows with n log n.
    """
    if copies < 3:
        raise ValueError("runs have three periods at least")
    bounded(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(lean(_find(shortest, copies)), _FOUND_SQL)
