"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

A byte-level BPE (side a) and a sentence-piece BPE (side b) encode every text; both
give the bytes of a space and the text. ``merge_asof`` of a batch's tokens, keyed by
document, finds for each token start the other side's token that covers it. The union
of both directions are all overlapping pairs. Pairs that end together cut the
tokens into groups, and are the links.

1. Texts are encoded and aligned once. What is written is ids and where groups end:
   about two bytes a token.
2. Id pairs of links are counted over all documents, combined in each task first.
   Their number is bounded by the vocabularies and not by the corpus.
3. Counts come back to the documents by blocks of ``PAIRS`` broadcast id pairs. A
   link's contributions add up, so each further block is another pass over the
   written ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.frames import bounded, in_blocks, kept_table, lean
from pairwright.llm.words import blocks, gathered, string_array

SIDE_A, SIDE_B = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Id pairs of one broadcast (16 bytes each), and distinct pairs that a task holds before it sends them on.
PAIRS, HELD = 1 << 21, 1 << 20
#: Tokens of written rows that are worked on at once.
TOKENS = 1 << 18

_PACKED = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_overlaps", pa.int64()),
    ("a", pa.binary()), ("b", pa.binary()), ("last_a", pa.binary()), ("last_b", pa.binary()), ("n_best", pa.int64()), ("count_sum", pa.int64()),
])
_PACKED_SQL = (
    "doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, a binary, b binary, last_a binary, last_b binary, n_best long, count_sum long"
)
_DONE = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "n_links", "n_best", "count_sum")] + [("grouped", pa.string())])
_DONE_SQL = "doc_id long, n_a long, n_b long, n_groups long, n_overlaps long, n_links long, n_best long, count_sum long, grouped string"


@dataclass
class Side:
    """A tokenizer: ids of texts, and the bytes of each id one after the other."""

    encode: object
    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, name: str) -> Side:
        encode, words = (_ranks if name.endswith(".tiktoken") else _pieces)(name)
        lengths = np.array([len(w) for w in words], np.int64)
        return cls(encode, np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each text's."""
        lists = self.encode(texts)
        counts = np.array([len(x) for x in lists], np.int64)
        return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return gathered(self.data, self.starts[ids], self.lengths[ids])


def _ranks(name: str):
    """Byte-level BPE from a rank file; special strings are plain text."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
    encoder = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = [b""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        words[rank] = word
    return lambda texts: [encoder.encode_ordinary(" " + t) for t in texts], words


def _pieces(name: str):
    """Sentence pieces; the model puts the space in front itself."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    words = []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        words.append(bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode())
    return lambda texts: model.encode(texts, num_threads=1), words


def _kind(size: int):
    return np.uint16 if size <= 1 << 16 else np.uint32


def overlaps(start_a: np.ndarray, row_a: np.ndarray, start_b: np.ndarray, row_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token of a, token of b) of all pairs that share a byte.

    Starts are offsets in the whole batch and grow; each row's tokens cover all of its bytes.
    """
    if not len(start_a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = pd.DataFrame({"at": start_a, "row": row_a, "a": np.arange(len(start_a))}), pd.DataFrame({"at": start_b, "row": row_b, "b": np.arange(len(start_b))})
    over_a = pd.merge_asof(a, b, on="at", by="row")["b"].to_numpy()
    over_b = pd.merge_asof(b, a, on="at", by="row")["a"].to_numpy()
    later = start_a[over_b] < start_b  # equal starts are in the first direction already
    return np.concatenate([np.arange(len(start_a)), over_b[later]]), np.concatenate([over_a, np.flatnonzero(later)])


def _same_bytes(side: Side, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which texts are given back exactly by their tokens."""
    row = np.repeat(np.arange(len(counts)), counts)
    same = np.bincount(row, side.lengths[ids], len(counts)).astype(np.int64) == lengths
    got = side.bytes_of(ids[same[row]])
    want = data[np.repeat(same, lengths)]
    wrong = np.flatnonzero(got != want)
    if len(wrong):
        ends = np.cumsum(np.where(same, lengths, 0))
        same[np.unique(np.searchsorted(ends, wrong, "right"))] = False
    return same


def _encode(name_a: str, name_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = Side.of(name_a), Side.of(name_b)
        for batch in blocks(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            data = [b" " + t.encode() for t in texts]
            lengths = np.array([len(t) for t in data], np.int64)
            data = np.frombuffer(b"".join(data), np.uint8)
            ids_a, n_a = side_a.ids(texts)
            ids_b, n_b = side_b.ids(texts)
            fit = _same_bytes(side_a, ids_a, n_a, data, lengths) & _same_bytes(side_b, ids_b, n_b, data, lengths) & (lengths > 1)
            ids_a, ids_b = ids_a[np.repeat(fit, n_a)], ids_b[np.repeat(fit, n_b)]
            n_a, n_b = np.where(fit, n_a, 0), np.where(fit, n_b, 0)
            row_a, row_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
            end_a, end_b = np.cumsum(side_a.lengths[ids_a]), np.cumsum(side_b.lengths[ids_b])
            x, y = overlaps(end_a - side_a.lengths[ids_a], row_a, end_b - side_b.lengths[ids_b], row_b)
            ends = end_a[x] == end_b[y]
            last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
            last_a[x[ends]] = True
            last_b[y[ends]] = True
            per_row = lambda row: np.bincount(row, minlength=len(texts))
            zero = pa.array(np.zeros(len(texts), np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n_a), pa.array(n_b), pa.array(per_row(row_a[last_a])), pa.array(per_row(row_a[x])),
                _split(ids_a.astype(_kind(len(side_a.lengths))), n_a), _split(ids_b.astype(_kind(len(side_b.lengths))), n_b),
                _split(last_a, n_a, bits=True), _split(last_b, n_b, bits=True), zero, zero,
            ], schema=_PACKED)

    return run


def _split(values: np.ndarray, counts: np.ndarray, bits: bool = False) -> pa.Array:
    ends = np.cumsum(counts).tolist()
    parts = [values[e - n : e] for e, n in zip(ends, counts.tolist(), strict=True)]
    return pa.array([(np.packbits(p) if bits else p).tobytes() for p in parts], pa.binary())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``TOKENS`` tokens of side a at most, or of a single text."""
    for batch in batches:
        total = np.concatenate([[0], np.cumsum(batch.column("n_a").to_numpy())])
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(total, total[at] + TOKENS, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def _joined(batch: pa.RecordBatch, side: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows and which of them end a group."""
    ids = np.frombuffer(b"".join(batch.column(side).to_pylist()), kind).astype(np.int64)
    bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(batch.column(f"last_{side}").to_pylist(), batch.column(f"n_{side}").to_pylist(), strict=True)]
    return ids, np.concatenate(bits) if bits else np.zeros(0, bool)


def _count(size_a: int, size_b: int):
    """Rows -> (pair, n) of links, combined as far as ``HELD`` pairs reach."""

    def merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(keys, return_inverse=True)
        return keys, np.bincount(at, n, len(keys)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64)), []
        rows = lambda t: pa.RecordBatch.from_arrays([pa.array(t[0]), pa.array(t[1])], ["pair", "n"])
        for b in _cut(batches):
            (x, last_x), (y, last_y) = _joined(b, "a", _kind(size_a)), _joined(b, "b", _kind(size_b))
            waiting.append(np.unique(x[last_x] * size_b + y[last_y], return_counts=True))
            if sum(len(w[0]) for w in waiting) >= HELD // 2:
                held, waiting = merged(*[np.concatenate([held[k], *[w[k] for w in waiting]]) for k in (0, 1)]), []
                if len(held[0]) >= HELD:
                    yield rows(held)
                    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield rows(merged(*[np.concatenate([held[k], *[w[k] for w in waiting]]) for k in (0, 1)]))

    return run


def _add(sent, size_a: int, size_b: int, done: bool):
    """Adds what the links of one block of id pairs contribute; the last pass writes out the groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, count, best = sent.value
        words = _group_words(size_a, size_b) if done else None
        for b in _cut(batches):
            (x, last_x), (y, last_y) = _joined(b, "a", _kind(size_a)), _joined(b, "b", _kind(size_b))
            n_groups = b.column("n_groups").to_numpy()
            row = np.repeat(np.arange(len(b)), n_groups)
            key = x[last_x] * size_b + y[last_y]
            at = np.minimum(np.searchsorted(pairs, key), max(0, len(pairs) - 1))
            here = pairs[at] == key if len(pairs) else np.zeros(len(key), bool)
            row, at = row[here], at[here]
            n_best = b.column("n_best").to_numpy() + np.bincount(row, best[at], len(b)).astype(np.int64)
            total = np.zeros(len(b), np.int64)
            np.add.at(total, row, count[at])  # in whole numbers
            total += b.column("count_sum").to_numpy()
            if not done:
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(n_best), pa.array(total)], schema=_PACKED)
                continue
            grouped = _grouped(words, size_a, x, last_x, y, last_y, n_groups)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], b.column("n_groups"), pa.array(n_best), pa.array(total), grouped], schema=_DONE)

    return run


def _group_words(size_a: int, size_b: int) -> pa.Array:
    """Every id with what follows it inside a group and at the end of its side."""
    return pa.array([f"{k}{c}" for k in range(size_a) for c in ",|"] + [f"{k}{c}" for k in range(size_b) for c in ",;"])


def _grouped(words: pa.Array, size_a: int, x: np.ndarray, last_x: np.ndarray, y: np.ndarray, last_y: np.ndarray, n_groups: np.ndarray) -> pa.Array:
    """Each row's groups as ``a1,a2|b1;a3|b2,b3``."""
    group_x, group_y = np.cumsum(last_x) - last_x, np.cumsum(last_y) - last_y
    total = int(n_groups.sum())
    count_x, count_y = np.bincount(group_x, minlength=total), np.bincount(group_y, minlength=total)
    order = np.empty(len(x) + len(y), np.int64)
    order[np.arange(len(x)) + (np.cumsum(count_y) - count_y)[group_x]] = 2 * x + last_x
    order[np.arange(len(y)) + np.cumsum(count_x)[group_y]] = 2 * (size_a + y) + last_y
    taken = words.take(pa.array(order)).cast(pa.large_string())
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(order) + 1]
    data = np.frombuffer(taken.buffers()[2], np.uint8)[: offsets[-1]] if len(order) else np.zeros(0, np.uint8)
    ends = np.concatenate([[0], np.cumsum(count_x + count_y)])[np.concatenate([[0], np.cumsum(n_groups)])]
    lengths = np.diff(offsets[ends])
    some = lengths > 0
    data = np.delete(data, np.cumsum(lengths)[some] - 1)  # the last ; of each row
    return string_array(data, lengths - some).cast(pa.string())


def align_tokens(
    docs: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B, id_col: str = "doc_id", text_col: str = "text", pairs: int = PAIRS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_overlaps, n_links, n_best, count_sum, grouped.

    ``n_a`` and ``n_b`` count tokens, ``n_overlaps`` pairs that share a byte,
    ``n_links`` those that end together, and ``grouped`` lists the ids of each
    group. A pair of ids counts as often as links hold it in all rows; ``count_sum``
    adds the counts of a row's links, ``n_best`` is the number of links whose count
    is the highest of their b id. ``side_a`` names a rank file, ``side_b`` a
    sentence-piece model of the public tokenizers. Null and empty texts, and those
    that either side does not give back byte by byte, have no tokens: zeros and an
    empty string. Null ids and repeated rows stay, each row counts; other columns
    are not looked at. A text is encoded as a whole by one task.
    """
    spark = docs.sparkSession
    bounded(spark)
    size_a, size_b = len(Side.of(side_a).lengths), len(Side.of(side_b).lengths)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = kept_table(texts.mapInArrow(lean(_encode(side_a, side_b)), _PACKED_SQL), "aligned")
    counted = rows.select("n_a", "n_b", "a", "b", "last_a", "last_b").mapInArrow(lean(_count(size_a, size_b)), "pair long, n long")
    counted = kept_table(counted.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b_id", F.col("pair") % size_b), "id-pairs")
    highest = counted.groupBy(F.col("b_id").alias("_b")).agg(F.max("n").alias("most"))
    known = counted.join(highest, F.col("b_id") == F.col("_b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    parts = in_blocks(counted.count(), pairs)
    for k in range(parts):
        part = known if parts == 1 else known.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == k)
        block = part.toArrow()  # about ``pairs`` rows
        order = np.argsort(pair := block["pair"].to_numpy())
        sent = spark.sparkContext.broadcast((pair[order], block["n"].to_numpy()[order], block["best"].to_numpy()[order]))
        done = k == parts - 1
        rows = rows.mapInArrow(lean(_add(sent, size_a, size_b, done)), _DONE_SQL if done else _PACKED_SQL)
        if not done:
            rows = kept_table(rows, "aligned")
    return rows
