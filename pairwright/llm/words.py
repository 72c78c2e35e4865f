"""Whole-batch text work in numpy: words, word fingerprints and fingerprints of word windows.

Everything works on the UTF-8 buffer of an Arrow column, so no Python object is
made per text or per word. Separators are ASCII bytes in all word rules used
here, hence bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multipliers of the fingerprints; any odd numbers would do.
BYTE_STEP = 0x9E3779B97F4A7C15
WORD_STEP = 0xD6E8FEB86659FD93
MIX_1, MIX_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53

#: Bytes hashed at once, and bytes of text that a block of rows holds.
PIECE = 1 << 20
BLOCK = 1 << 20


def spaced() -> np.ndarray:
    """Byte -> part of a word, for words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def alphanumeric() -> np.ndarray:
    """Byte -> part of a word, for words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of lower-cased texts."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


def lowered() -> np.ndarray:
    """Byte -> byte with A-Z as a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the offsets between them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one hold ``limit`` bytes at most, or are a single text."""
    for batch in batches:
        at = batch.schema.get_field_index(column) if isinstance(column, str) else column
        _, offs = text_buffer(batch.column(at))
        a = 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the byte ranges (in order, not overlapping): a polynomial over random byte values, mixed."""
    out = np.empty(len(starts), np.uint64)
    values = np.random.default_rng(20240229).integers(0, 2**64, 256, np.uint64) | np.uint64(1)
    size = 0
    a = 0
    while a < len(starts):
        lo = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, lo + PIECE, "right")))
        hi = ends[b - 1]
        if hi - lo > size:
            size = int(max(min(PIECE, len(data)), hi - lo))
            power = _powers(BYTE_STEP, size)
            inverse = _powers(pow(BYTE_STEP, -1, 2**64), size)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[data[lo:hi]] * power[: hi - lo], out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = (sums[e] - sums[s]) * inverse[s]
        a = b
    return mix(out)


def _powers(step: int, n: int) -> np.ndarray:
    p = np.full(n, step, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all bits; one to one."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(MIX_1)
    h ^= h >> np.uint64(33)
    h *= np.uint64(MIX_2)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Words:
    """Words of a block of texts: byte ranges, fingerprints, and ``bounds``, where each row's words begin."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def rows(self) -> np.ndarray:
        """Row of every word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def windows(self, size: int) -> np.ndarray:
        """Numbers of the words at which a window of ``size`` words of one row starts."""
        left = np.repeat(self.bounds[1:], self.counts) - np.arange(len(self.starts))
        return np.flatnonzero(left >= size)


def words_of(column: pa.Array, part: np.ndarray, lower: bool = False, hashed: bool = True) -> Words:
    data, offsets = text_buffer(column)
    if lower:
        data = lowered()[data]
    starts, ends = runs(part[data], offsets)
    hashes = fingerprints(data, starts, ends) if hashed else np.zeros(0, np.uint64)
    return Words(data, offsets, starts, ends, hashes, np.searchsorted(starts, offsets))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run ends where a row ends."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[offsets < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[offsets > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def chained(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the ``size`` words from each of ``at`` on, in order."""
    h = hashes[at]
    for k in range(1, size):
        h = h * np.uint64(WORD_STEP) + hashes[at + k]
    return mix(h + np.uint64(size))


def covered(n: int, at: np.ndarray, size) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``size`` words (one number, or one for each) from ``at`` on."""
    steps = np.bincount(at, minlength=n + 1)[: n + 1].astype(np.int64)
    steps -= np.bincount(at + size, minlength=n + 1)[: n + 1]
    return np.cumsum(steps)[:n] > 0


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The byte ranges copied one after the other."""
    return data[np.repeat(starts, lengths) + ragged(lengths)]


def string_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A string column whose texts lie one after the other in ``data``."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    if offsets[-1] < 2**31:
        return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def code_points(data: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (data & 0xC0) != 0x80
