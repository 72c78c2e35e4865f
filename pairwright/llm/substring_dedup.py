"""Substring dedup by prefix-partitioned suffix trees over words.

Every word position is the start of a suffix, of which the first ``SIZE`` words
matter. Suffixes are split into groups by variable-length prefixes: by their first
word where few suffixes share it, else by their first two, four, and so on, so
that a group fits into memory. Counts for this come from one pass over all words
into histograms of ``BINS`` bins for each prefix length.

In a group the suffixes are sorted, which lays out the leaves of the group's
suffix tree; neighbours that agree on ``SIZE`` words lie under one deep internal
node. Its words are a repeat; the leaves from documents with a greater id than the
node's smallest start a window that is to go. Windows of one text that overlap or
touch are merged to maximal repeats when they are cut.

A group sends what it found on by documents, again as packed arrays, and all
starts of a document meet there before the join with its text.

A leaf is kept as its position and a 64-bit fingerprint of its path of ``SIZE``
words (the group's prefix adds to it): two different windows fall together with a
chance of 2**-64 a pair. Leaves travel as packed arrays, a row for each flush of
a task and group.

A window so frequent that even ``SIZE`` words do not split it is not gathered at
all: its smallest document id is aggregated before the shuffle, sent to the
tasks (their number is bounded by words over group size), and compared in place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.frames import blob_rows, bounded, by_group, lean, lean_group, others, packed, send, shuffle_width, text_key, unpacked
from pairwright.llm.words import WORD_STEP, Words, blocks, covered, gathered, mix, ragged, runs, spaced, string_array, words_of

#: Words of a window; lengths of prefixes that are tried; bins of a histogram.
SIZE = 13
PREFIXES = (1, 2, 4, 8)
BINS = 1 << 16
#: Suffixes of a group, by the memory of a task (some 60 bytes each), and suffixes a task holds before it sends them.
#: Groups for each core at least. Fewer, larger groups make a document's share of a group less costly to send.
GROUP, FLUSH, GROUPS_PER_CORE, LEAST_GROUP = 1 << 22, 1 << 19, 4, 1 << 14

#: Stands for a null id: greater than all others.
NO_ID = np.iinfo(np.int64).max

_LEAVES = "grp int, paths binary, places binary, ids binary, keys binary, counts binary"
_LEAF_KINDS = pa.schema([("grp", pa.int32()), *[(c, pa.binary()) for c in ("paths", "places", "ids", "keys", "counts")]])
_CUTS = "bucket int, ids binary, keys binary, counts binary, places binary"
_CUT_KINDS = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("ids", "keys", "counts", "places")]])
_STARTS = "id long, text_key long, places binary"
_START_KINDS = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("places", pa.binary())])


@dataclass
class Partition:
    """Which group a suffix belongs to: for each prefix length the group of each bin, -1 where the prefix is too frequent."""

    lengths: tuple[int, ...]
    groups: np.ndarray  # (prefix length, bin)
    n: int  # groups made of whole bins; those of windows in frequent bins follow
    spare: int
    hot: np.ndarray  # paths of the windows that are not gathered, in order
    least: np.ndarray  # and the smallest document id of each

    def of(self, prefixes: list[np.ndarray], paths: np.ndarray) -> np.ndarray:
        group = np.full(len(paths), -1, np.int64)
        for k, h in enumerate(prefixes):
            todo = group < 0
            group[todo] = self.groups[k, _bins(h[todo], self.groups.shape[1])]
        todo = group < 0
        group[todo] = self.n + (paths[todo] % np.uint64(max(1, self.spare))).astype(np.int64)
        return group


def _bins(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> np.uint64(64 - int(n).bit_length() + 1)).astype(np.int64)


def prefix_hashes(w: Words, at: np.ndarray, lengths: tuple[int, ...], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Fingerprints of the first words of the suffixes, for each length, and of all ``size`` words."""
    out, h = [], w.hashes[at]
    for k in range(1, size + 1):
        if k in lengths:
            out.append(mix(h ^ np.uint64(k)))
        if k < size:
            h = h * np.uint64(WORD_STEP) + w.hashes[at + k]
    out.append(mix(h ^ np.uint64(size)))
    return out, mix(h + np.uint64(size))


def _histograms(docs: DataFrame, lengths: tuple[int, ...], size: int, bins: int) -> np.ndarray:
    """Suffixes by prefix length and bin, over all words. What reaches the driver has ``len(lengths) * bins`` numbers."""
    n, cut = len(lengths) + 1, 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n, bins), np.int64)
        for b in blocks(batches, "text"):
            w = words_of(b.column("text"), spaced())
            for k, h in enumerate(prefix_hashes(w, w.windows(size), lengths, size)[0]):
                sums[k] += np.bincount(_bins(h, bins), minlength=bins)
        yield blob_rows(kinds, [(k, packed(row.astype(np.int64))) for k, row in enumerate(sums.reshape(n * cut, -1))])

    def add(table: pa.Table) -> pa.Table:
        sums = sum(unpacked(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.Table.from_pydict({"slice": table.column("slice")[:1], "counts": [packed(sums)]}, kinds)

    kinds = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])
    rows = docs.select("text").mapInArrow(lean(count), "slice int, counts binary").groupBy("slice").applyInArrow(lean_group(add), "slice int, counts binary").collect()
    out = np.zeros((n * cut, bins // cut), np.int64)
    for r in rows:
        out[r["slice"]] = unpacked(bytes(r["counts"]), np.int64)
    return out.reshape(n, bins)


def partition(docs: DataFrame, size: int = SIZE, lengths: tuple[int, ...] = PREFIXES, bins: int = BINS, group: int = GROUP) -> Partition:
    """Groups of ``group`` suffixes at most, as far as prefixes can split them, and frequent windows set apart."""
    lengths = tuple(k for k in lengths if k < size)
    counts = _histograms(docs, lengths, size, bins)
    total = int(counts[0].sum())
    limit = min(group, max(LEAST_GROUP, -(-total // (GROUPS_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism))))
    groups = np.full(counts.shape, -1, np.int64)
    n, load, left = 0, 0.0, float(max(1, total))  # ``left``: suffixes that no shorter prefix took
    for k, row in enumerate(counts):
        fits = row <= limit
        groups[k, fits] = n
        # Neighbouring bins together until the next one would overfill. A bin also counts suffixes that a shorter
        # prefix took; on average the share of those that are left holds for it.
        for b in np.flatnonzero(fits & (row > 0)).tolist():
            own = row[b] * left / max(1, total)
            if load + own > limit:
                n, load = n + 1, 0.0
            load += own
            groups[k, b] = n
        left *= row[~fits].sum() / max(1, row.sum())
    n += 1
    too_many = counts[-1] > limit
    found = Partition((*lengths, size), groups, n, 1, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if too_many.any():
        found.spare = int(-(-counts[-1][too_many].sum() // limit))
        found.hot, found.least = _hot(docs, found, size, limit)
    return found


def _hot(docs: DataFrame, part: Partition, size: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the frequent bins that occur more than ``limit / 4`` times: at most four for each ``limit`` words."""
    sent = send(docs.sparkSession, part)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Partition(**sent.value)
        for b in blocks(batches, "text"):
            w = words_of(b.column("text"), spaced())
            at = w.windows(size)
            prefixes, paths = prefix_hashes(w, at, part.lengths[:-1], size)
            last = part.of(prefixes, paths) >= part.n
            path, where, n = np.unique(paths[last], return_inverse=True, return_counts=True)
            low = np.full(len(path), NO_ID)
            np.minimum.at(low, where, _ids(b)[w.rows[at[last]]])
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(n), pa.array(low)], ["path", "n", "low"])

    seen = docs.select("id", "text").mapInArrow(lean(least), "path long, n long, low long").groupBy("path").agg(F.sum("n").alias("n"), F.min("low").alias("low"))
    rows = sorted((r["path"] % 2**64, r["low"]) for r in seen.where(F.col("n") > limit / 4).collect())
    return np.array([p for p, _ in rows], np.uint64), np.array([x for _, x in rows], np.int64)


def _ids(b: pa.RecordBatch) -> np.ndarray:
    return b.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _leaves(sent, size: int, flush: int):
    """Texts -> leaves by group; starts that frequent windows decide leave under a negative group, as they are."""

    def rows(held: list[tuple[np.ndarray, ...]], n: int) -> list[tuple]:
        group, path, place, id_, key = (np.concatenate(x) for x in zip(*held, strict=True))
        order, begin = by_group(group, n)
        out = []
        for g in np.flatnonzero(np.diff(begin)).tolist():
            own = order[begin[g] : begin[g + 1]]
            i, k = id_[own], key[own]
            new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (k[1:] != k[:-1])]))
            counts = np.diff(np.append(new, len(own))).astype(np.uint32)
            out.append((g, path[own].tobytes(), packed(place[own].astype(np.uint32)), packed(i[new]), k[new].tobytes(), packed(counts)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Partition(**sent.value)
        held: list[tuple[np.ndarray, ...]] = []
        size_ = 0
        for b in blocks(batches, "text"):
            w = words_of(b.column("text"), spaced())
            at = w.windows(size)
            row = w.rows[at]
            ids, keys = _ids(b), b.column("text_key").to_numpy(zero_copy_only=False)
            prefixes, paths = prefix_hashes(w, at, part.lengths[:-1], size)
            place = at - w.bounds[row]
            if len(part.hot):
                slot = np.minimum(np.searchsorted(part.hot, paths), len(part.hot) - 1)
                hot = part.hot[slot] == paths
                gone = np.flatnonzero(hot & (ids[row] > part.least[slot]))
                text = np.unique(row[gone])
                ends = np.searchsorted(row[gone], text, "right")
                yield blob_rows(_LEAF_KINDS, [
                    (-1 - int(keys[r]) % max(64, part.n), b"", packed(place[gone[a:e]].astype(np.uint32)), packed(ids[r : r + 1]), keys[r : r + 1].tobytes(), b"")
                    for r, a, e in zip(text.tolist(), [0, *ends.tolist()], ends.tolist(), strict=False)
                ])
                at, row, paths, place = at[~hot], row[~hot], paths[~hot], place[~hot]
                prefixes = [p[~hot] for p in prefixes]
            held.append((part.of(prefixes, paths).astype(np.int32), paths, place.astype(np.uint32), ids[row], keys[row]))
            size_ += len(paths)
            if size_ >= flush:
                yield blob_rows(_LEAF_KINDS, rows(held, part.n + part.spare))
                held, size_ = [], 0
        if size_:
            yield blob_rows(_LEAF_KINDS, rows(held, part.n + part.spare))

    return run


class SuffixTree:
    """Leaves of one group in suffix order, and its deep internal nodes: the runs of leaves that share a whole path."""

    def __init__(self, paths: np.ndarray, ids: np.ndarray):
        self.order = np.argsort(paths, kind="stable").astype(np.int32)
        p = paths[self.order]
        self.nodes = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
        del p
        self.sizes = np.diff(np.append(self.nodes, len(paths)))
        self.ids = ids[self.order]

    def later_leaves(self) -> np.ndarray:
        """Leaves of internal nodes whose document is not the node's first."""
        if not len(self.order):
            return self.order
        first = np.minimum.reduceat(self.ids, self.nodes)
        return self.order[self.ids > np.repeat(first, self.sizes)]


def _texts(id_: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts ordered by text, each once: (ids, keys) of the texts, how many starts each has, and the starts."""
    order = np.lexsort((place, key, id_))
    id_, key, place = id_[order], key[order], place[order]
    text = np.concatenate([[True], (id_[1:] != id_[:-1]) | (key[1:] != key[:-1])])[: len(place)]
    once = text | np.concatenate([[True], place[1:] != place[:-1]])[: len(place)]
    id_, key, place, text = id_[once], key[once], place[once], np.flatnonzero(text[once])
    return id_[text], key[text], np.diff(np.append(text, len(place))), place


def _repeats(buckets: int):
    """A group of leaves -> the starts of windows that are to go, packed by buckets of texts."""

    def find(table: pa.Table) -> pa.Table:
        id_, key, n, place = _texts(*_later(table))
        if not len(place):
            return _CUT_KINDS.empty_table()
        bucket = (mix(id_.astype(np.uint64) + key.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order, begin = by_group(bucket, buckets)
        first = np.cumsum(n) - n
        out = []
        for b in np.flatnonzero(np.diff(begin)).tolist():
            own = order[begin[b] : begin[b + 1]]
            out.append((b, packed(id_[own]), key[own].tobytes(), packed(n[own].astype(np.uint32)), packed(place[np.repeat(first[own], n[own]) + ragged(n[own])])))
        return pa.Table.from_batches([blob_rows(_CUT_KINDS, out)])

    return find


def _gathered(table: pa.Table) -> pa.Table:
    """A bucket of texts -> all starts of each."""
    cols = {n: table.column(n).to_pylist() for n in table.column_names}
    counts = np.concatenate([unpacked(x, np.uint32) for x in cols["counts"]])
    ids, keys = np.concatenate([unpacked(x, np.int64) for x in cols["ids"]]), np.concatenate([np.frombuffer(x, np.int64) for x in cols["keys"]])
    id_, key, n, place = _texts(np.repeat(ids, counts), np.repeat(keys, counts), np.concatenate([unpacked(x, np.uint32) for x in cols["places"]]))
    ends = np.cumsum(n)
    places = [packed(place[a:e]) for a, e in zip((ends - n).tolist(), ends.tolist(), strict=True)]
    return pa.Table.from_arrays([pa.array(id_), pa.array(key), pa.array(places, pa.binary())], schema=_START_KINDS)


def _column(table: pa.Table, name: str) -> list:
    """Buffers of a binary column, not copied."""
    return [v.as_buffer() for v in table.column(name)]


def _later(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(id, key, place) of the leaves of a group that are to go."""
    ids = np.concatenate([unpacked(x, np.int64) for x in _column(table, "ids")])
    keys = np.concatenate([np.frombuffer(x, np.int64) for x in _column(table, "keys")])
    if table.column("grp")[0].as_py() < 0:  # one text in each row, already decided
        n = [x.size // 4 for x in _column(table, "places")]
        return np.repeat(ids, n), np.repeat(keys, n), np.concatenate([unpacked(x, np.uint32) for x in _column(table, "places")])
    counts = np.concatenate([unpacked(x, np.uint32) for x in _column(table, "counts")])
    # Leaves know their text by number and its document by rank: four bytes each instead of eight.
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)
    tree = SuffixTree(np.concatenate([np.frombuffer(x, np.uint64) for x in _column(table, "paths")]), np.repeat(rank, counts))
    gone = tree.later_leaves()
    del tree
    text = np.repeat(np.arange(len(ids), dtype=np.int32), counts)[gone]
    place = np.concatenate([unpacked(x, np.uint32) for x in _column(table, "places")])[gone]
    return ids[text], keys[text], place


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, lengths: tuple[int, ...] = PREFIXES,
    bins: int = BINS, group: int = GROUP, flush: int = FLUSH,
) -> DataFrame:
    """Rows of ``docs`` without the words that lie in a window of ``size`` words which also starts in a document with a smaller id.

    All columns stay; ``text_col`` loses the maximal repeats with the white space
    behind each, and these are added (columns of these names are replaced):
    ``all_words``, ``cut_words`` (longs) and ``kept_words``, the kept words joined
    by one blank. Windows are judged on the input. Rows of equal id are not
    compared, so repeated rows keep what one row keeps. A null id comes after all
    others: such rows lose windows to rows with an id, not to each other. A null
    text has no words and stays null. Texts of less than ``size`` words stay whole.
    """
    spark = docs.sparkSession
    bounded(spark)
    own = others(docs, "all_words", "cut_words", "kept_words")
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), text_key(text_col).alias("text_key"))
    part = partition(keyed, size, lengths, bins, group)
    sent = send(spark, part)
    buckets = max(part.n, shuffle_width(spark))
    found = keyed.mapInArrow(lean(_leaves(sent, size, flush)), _LEAVES).groupBy("grp").applyInArrow(lean_group(_repeats(buckets)), _CUTS)
    gone = found.groupBy("bucket").applyInArrow(lean_group(_gathered), _STARTS).withColumnRenamed("places", "_places")
    # The rows travel as one column of numbered fields, so none of their names can clash.
    row = F.struct(*[F.col(c).alias(f"r{k}") for k, c in enumerate(own)])
    rows = docs.select(row.alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), text_key(text_col).alias("_key"))
    joined = rows.join(gone, (F.col("_id") == F.col("id")) & (F.col("_key") == F.col("text_key")), "left")
    new = [F.lit(0).cast("long").alias("all_words"), F.lit(0).cast("long").alias("cut_words"), F.lit("").alias("kept_words")]
    return joined.select("_places", "row.*").mapInArrow(lean(_cutter(own.index(text_col), own, size)), docs.select(*own, *new).schema)


def _cutter(text_at: int, names: list[str], size: int):
    """(starts of windows, columns of the row) -> the row without the windows, and the three new columns."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text_at + 1):
            own = b.columns[1:]
            column = own[text_at]
            w = words_of(column, spaced(), hashed=False)
            at = [
                w.bounds[k] + unpacked(places, np.uint32).astype(np.int64) for k, places in enumerate(b.column(0).to_pylist()) if places
            ]
            hit = covered(len(w.starts), np.concatenate(at), size) if at else np.zeros(len(w.starts), bool)
            lengths = w.ends - w.starts
            # Kept words with a blank behind each, but for a row's last.
            rows = w.rows
            kept = np.flatnonzero(~hit)
            data = np.concatenate([w.data, np.array([0x20], np.uint8)])
            bit = np.stack([w.starts[kept], np.full(len(kept), len(w.data))], axis=1).ravel()
            last = np.append(rows[kept][1:] != rows[kept][:-1], True)[: len(kept)]
            n = np.stack([lengths[kept], np.where(last, 0, 1)], axis=1).ravel()
            words = string_array(gathered(data, bit, n), np.bincount(rows[kept], (n[0::2] + n[1::2]), minlength=len(b)).astype(np.int64))
            if hit.any():
                # A repeat goes with the white space up to the next word, or to the end of the text.
                keep = np.ones(len(w.data), bool)
                a, e = runs(hit, w.bounds)
                row = rows[a]
                behind = np.where(e < w.bounds[row + 1], w.starts[np.minimum(e, len(w.starts) - 1)], w.offsets[row + 1])
                edges = np.zeros(len(w.data) + 1, np.int64)
                np.add.at(edges, w.starts[a], 1)
                np.add.at(edges, behind, -1)
                keep = np.cumsum(edges[:-1]) == 0
                sizes = np.diff(np.concatenate([[0], np.cumsum(keep)])[w.offsets])
                texts = string_array(w.data[keep], sizes)
                null = column.is_null()
                own[text_at] = pa.array(texts.to_pylist(), pa.string(), mask=null.to_numpy(zero_copy_only=False)) if column.null_count else texts
            new = [pa.array(w.counts.astype(np.int64)), pa.array(np.bincount(rows[hit], minlength=len(b)).astype(np.int64)), words]
            yield pa.RecordBatch.from_arrays([*own, *new], [*names, "all_words", "cut_words", "kept_words"])

    return cut
