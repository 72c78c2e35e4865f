"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

All unigrams and bigrams of the training texts are counted, combined in each task
before the shuffle and added up by ranges of their fingerprints. A count c is
quantised to q = 1 + floor(log2 c) and stored as the q memberships (n-gram, 1) ..
(n-gram, q) of a Bloom filter; each range builds its own segment. Reading a count is
probing 1, 2, .. until a membership fails, so it is never too low. The filter has
``ENTRY_BITS`` bits a membership at least and grows with the corpus; a score leaves
no n-gram out.

The segments of unigrams are broadcast, in blocks of ``BITS`` bits: a pass over the
texts for each block but the last notes the levels of their tokens. The segments of
bigrams, most of the filter, stay where they are, and the distinct bigrams of texts
come to their range with the levels of their two words:

    log (both + PRIOR share) / (context + PRIOR) = log (PRIOR share) / (context + PRIOR) + log (1 + both / (PRIOR share))

The first part is known with the text, the second is 0 for bigrams that were never
seen, and its sums by text and range add up. Bigrams with a word that was never
seen are not sent.

The exact base score does not go through the filter: token counts of texts and of
the training corpus meet by fingerprint range too, and the ranges' parts of a text
meet by buckets of texts, all as packed arrays; the few tokens and bigrams that make
up more than 1 / ``HEAVY`` of the corpus are looked up in place instead, so no range
is flooded by one of them. Large corpora are scored in ``ROUNDS`` rounds, each over
its share of the texts, and what a round has shuffled goes when its scores are written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.frames import blob_rows, bounded, by_group, in_blocks, kept_table, lean, lean_group, packed, send, shuffle_width, text_key, union_all, unpacked
from pairwright.llm.words import WORD_STEP, Words, blocks, mix, spaced, words_of

#: Bits of the filter that are broadcast at once, least bits for a membership, hash functions.
BITS, ENTRY_BITS, PROBES = 1 << 28, 8, 4
#: Bits for a membership in the segments that stay where they are.
PLACED_BITS = 16
#: Weight of the unigram distribution in a bigram probability, and of a word that was never seen.
PRIOR, HALF = 4.0, 0.5
#: Tokens and bigrams above this share of the corpus are looked up in place; n-grams of a range by the memory of a task, ranges for
#: each core at least, tokens that a task holds.
HEAVY, GROUP, RANGES_PER_CORE, FLUSH = 4096, 1 << 21, 16, 1 << 18
#: Bytes of text that are scored at once: frequent n-grams are probed once for all of them.
SCORED = 2 << 20
#: Rounds at most, and bytes of text from which there is one more.
ROUNDS, ROUND = 4, 192 << 20
#: Shuffle files go with the query that made them.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows with this remainder are held out.
FOLDS, HELD = 5, 1

#: Fingerprints of the end of a text, and of what stands before its first token.
END, BEGIN = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
NO_ID = np.iinfo(np.int64).max
LEVELS = 64


def held_out(id_: Column) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % FOLDS == HELD


def tokens_of(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, bigram) of every token, the end of each text included."""
    rows = len(w.bounds) - 1
    token = np.full(len(w.hashes) + rows, END)
    token[np.arange(len(w.hashes)) + w.rows] = w.hashes
    counts = w.counts + 1
    first = np.cumsum(counts) - counts
    before = np.concatenate([[BEGIN], token[:-1]]) if len(token) else token
    before[first] = BEGIN
    return np.repeat(np.arange(rows), counts), token, mix(before * np.uint64(WORD_STEP) + token)


def range_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


# --- counts -------------------------------------------------------------------------------------------------------

_COUNTS = "grp int, n int, keys binary, counts binary"
_COUNT_KINDS = pa.schema([("grp", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_SUMS = f"{_COUNTS}, distinct_keys long, total long, levels array<long>"


def count_ngrams(texts: DataFrame, groups: int, flush: int = FLUSH) -> DataFrame:
    """Rows of (range, order): sorted fingerprints and counts of the range, how many, their sum, and n-grams by level."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> list[tuple]:
            out = []
            for n in (1, 2):
                keys, counts = np.unique(np.concatenate([h[n - 1] for h in held]), return_counts=True)
                at = np.searchsorted(range_of(keys, groups), np.arange(groups + 1))
                out += [(g, n, keys[a:e].tobytes(), packed(counts[a:e].astype(np.uint32))) for g, (a, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if e > a]
            return out

        size = 0
        for b in blocks(batches, "text"):
            _, token, pair = tokens_of(words_of(b.column("text"), spaced(), lower=True))
            held.append((token, pair))
            size += len(token)
            if size >= flush:
                yield blob_rows(_COUNT_KINDS, rows())
                held.clear()
                size = 0
        if size:
            yield blob_rows(_COUNT_KINDS, rows())

    def add(table: pa.Table) -> pa.Table:
        order = np.array(table.column("n"))
        out = []
        for n in np.unique(order).tolist():
            own = table.filter(pa.array(order == n))
            keys = np.concatenate([np.frombuffer(x, np.uint64) for x in own.column("keys").to_pylist()])
            counts = np.concatenate([unpacked(x, np.uint32) for x in own.column("counts").to_pylist()])
            at = np.argsort(keys, kind="stable")
            keys = keys[at]
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, counts = keys[new], np.add.reduceat(counts[at].astype(np.int64), new)
            out.append((own.column("grp")[0].as_py(), n, keys.tobytes(), packed(counts), len(keys), int(counts.sum()), np.bincount(level(counts), minlength=LEVELS).tolist()))
        kinds = pa.schema([*_COUNT_KINDS, ("distinct_keys", pa.int64()), ("total", pa.int64()), ("levels", pa.list_(pa.int64()))])
        return pa.Table.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(kinds)], schema=kinds)

    return texts.select("text").mapInArrow(lean(combine), _COUNTS).groupBy("grp").applyInArrow(lean_group(add), _SUMS)


def level(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c); 0 for 0."""
    return np.frexp(counts.astype(float))[1].astype(np.int64)


def typical(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level."""
    return np.where(levels > 1, 0.75 * np.exp2(levels) - 0.5, levels)


# --- filter -------------------------------------------------------------------------------------------------------


@dataclass
class Filter:
    """Memberships of (n-gram, level)."""

    bits: np.ndarray
    groups: int
    total: int  # tokens of the training texts
    distinct: int
    first: int = 0  # the filter holds the ranges from here
    last: int | None = None  # up to here, or all

    def levels(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Level of each key: the number of memberships in a row that hold. 0 for keys of other ranges."""
        last = self.groups if self.last is None else self.last
        segment = 8 * (len(self.bits) // (last - self.first))
        group = range_of(keys, self.groups)
        own = np.flatnonzero((group >= self.first) & (group < last))
        out = np.zeros(len(keys), np.int64)
        out[own] = probed(self.bits, (group[own] - self.first) * segment, segment, keys[own], order)
        return out


def probed(bits: np.ndarray, base: np.ndarray, segment: int, keys: np.ndarray, order: int) -> np.ndarray:
    """Level of each key in the segment that begins at its ``base``."""
    out = np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    for at in range(1, LEVELS):
        hashed = membership(keys[live], order, at)
        for k in range(PROBES):
            place = base[live] + places(hashed, k, segment)
            hold = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            live, hashed = live[hold], hashed[hold]  # most misses end at the first probe
        if not len(live):
            break
        out[live] = at
    return out


def segment_of(keys: np.ndarray, q: np.ndarray, order: int, segment: int) -> np.ndarray:
    """Bits of the memberships of keys with these levels."""
    on = np.zeros(segment, bool)
    for at in range(1, int(q.max(initial=0)) + 1):
        deep = membership(keys[q >= at], order, at)
        for k in range(PROBES):
            on[places(deep, k, segment)] = True
    return np.packbits(on, bitorder="little")


def share(levels: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """Share of a unigram in the corpus, from its level."""
    return (typical(levels) + HALF) / (total + HALF * (distinct + 1))


def gain(both: np.ndarray, context: np.ndarray, of: np.ndarray) -> np.ndarray:
    """What the levels of a bigram, of its first word, and the share of its second add to log10 of P(second | first)."""
    return np.log10(1 + np.minimum(typical(both), typical(context)) / (PRIOR * of))


def membership(keys: np.ndarray, order: int, at: int) -> np.ndarray:
    """Fingerprint of (n-gram, level)."""
    return mix(keys ^ np.uint64(((order << 8) + at) * 0xA24BAED4963EE407 % 2**64))


def places(hashed: np.ndarray, probe: int, segment: int) -> np.ndarray:
    """Bit of a membership inside its segment, for one of the hash functions."""
    turned = hashed * np.uint64((2 * probe + 1) * 0x9FB21C651E98DF25 % 2**64)
    return (((turned >> np.uint64(32)) * np.uint64(segment)) >> np.uint64(32)).astype(np.int64)


def build_filter(counts: DataFrame, groups: int, segment: int, first: int = 0, last: int | None = None) -> Filter | None:
    """The filter of all n-grams of the ranges ``first`` to ``last``, ``segment`` bits for each; what reaches the driver is the filter itself. None without tokens."""
    last = groups if last is None else last
    counts = counts.where((F.col("grp") >= first) & (F.col("grp") < last))
    sums = counts.where("n = 1").agg(F.sum("distinct_keys").alias("v"), F.sum("total").alias("t")).first()
    if sums["t"] is None:
        return None

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                keys, q = np.frombuffer(r["keys"], np.uint64), level(unpacked(r["counts"], np.int64))
                yield blob_rows(kinds, [(r["grp"], segment_of(keys, q, r["n"], segment).tobytes())])

    kinds = pa.schema([("grp", pa.int32()), ("bits", pa.binary())])
    out = np.zeros((last - first, segment // 8), np.uint8)
    for r in counts.select("grp", "n", "keys", "counts").mapInArrow(lean(fill), "grp int, bits binary").toLocalIterator():
        out[r["grp"] - first] |= np.frombuffer(r["bits"], np.uint8)
    return Filter(out.ravel(), groups, sums["t"], sums["v"], first, last)


def filter_bits(memberships: int) -> int:
    """Bits for so many memberships: a power of two, so small inputs get small filters."""
    return 1 << max(10, (ENTRY_BITS * memberships).bit_length())


def with_segments(counts: DataFrame) -> DataFrame:
    """Counts with the filter's segment of each range of bigrams instead of the bigrams; of these only those remain that can be heavy."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, n in enumerate(b.column("n").to_pylist()):
                r = b.slice(k, 1)
                bits = None
                if n == 2:
                    keys, c = np.frombuffer(r.column("keys")[0].as_py(), np.uint64), unpacked(r.column("counts")[0].as_py(), np.int64)
                    q = level(c)
                    bits = segment_of(keys, q, 2, 8 * -(-PLACED_BITS * int(q.sum()) // 8)).tobytes()
                    often = c > c.sum() / HEAVY  # a range has no more tokens than the corpus
                    r = r.set_column(2, "keys", pa.array([keys[often].tobytes()], pa.binary())).set_column(3, "counts", pa.array([packed(c[often])], pa.binary()))
                yield r.append_column("bits", pa.array([bits], pa.binary()))

    return counts.mapInArrow(lean(build), f"{_SUMS}, bits binary")


def token_levels(texts: DataFrame, counts: DataFrame, groups: int, bits: int) -> tuple[DataFrame, Filter | None]:
    """Texts with the levels of the tokens in all blocks of the unigrams' filter but the last (null if there is one), and the last."""
    spark = texts.sparkSession
    tokens = counts.where("n = 1")
    need = tokens.select(F.posexplode("levels").alias("level", "c")).agg(F.sum(F.col("level") * F.col("c"))).first()[0] or 0
    segment = 8 * -(-filter_bits(need) // (8 * groups))
    step = max(1, bits // segment)
    blocks_ = [(a, min(groups, a + step)) for a in range(0, groups, step)]
    texts = texts.withColumn("levels", F.lit(None).cast("binary"))
    for first, last in blocks_[:-1]:
        own = build_filter(tokens, groups, segment, first, last)
        if own:
            sent = send(spark, own)
            texts = kept_table(texts.mapInArrow(lean(_noted(sent)), texts.schema), "token-levels")
            sent.destroy()
    return texts, build_filter(tokens, groups, segment, *blocks_[-1])


def _levels_of(b: pa.RecordBatch, token: np.ndarray, filter_: Filter | None) -> np.ndarray:
    """Levels of the tokens of a block of texts: those that were noted and those in this block of the filter."""
    noted = b.column("levels")
    out = np.zeros(len(token), np.int64) if noted.null_count else np.frombuffer(b"".join(noted.to_pylist()), np.uint8).astype(np.int64)
    if filter_:
        one, at = np.unique(token, return_inverse=True)
        out += filter_.levels(one, 1)[at]
    return out


def _noted(sent):
    """Texts -> the same, with the levels of the tokens in one block of the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(**sent.value)
        for b in blocks(batches, "text", SCORED):
            row, token, _ = tokens_of(words_of(b.column("text"), spaced(), lower=True))
            found = _levels_of(b, token, own).astype(np.uint8)
            ends = np.searchsorted(row, np.arange(len(b)), "right").tolist()
            new = pa.array([found[a:e].tobytes() for a, e in zip([0, *ends], ends, strict=False)], pa.binary())
            yield b.set_column(b.schema.get_field_index("levels"), "levels", new)

    return run


# --- scores -------------------------------------------------------------------------------------------------------

_PARTS = "id long, text_key long, n_rows long, n_tokens long, n_known long, base double, score double"
#: What adds up over the parts of a text.
_ADDED = (("n_rows", np.int64), ("n_tokens", np.int64), ("n_known", np.int64), ("base", np.float64), ("score", np.float64))
_PART_KINDS = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), *[(c, pa.int64()) for c in ("n_rows", "n_tokens", "n_known")], ("base", pa.float64()), ("score", pa.float64())])
_SUMMED_KINDS = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("ids", "text_keys", *[n for n, _ in _ADDED])]])
_SUMMED = ", ".join(["bucket int", *[f"{f.name} binary" for f in list(_SUMMED_KINDS)[1:]]])
#: Texts of a range with their tokens (how often, how many a text) and bigrams (the same, and the levels of both words), or what was
#: learned. Groups from the number of ranges on are buckets of texts, with what a task knows of a text alone: rows, tokens, known ones
#: among the heavy, and both scores without what ranges add (in the columns ``sizes``, ``counts``, ``times``, ``pairs``, ``keys``).
_BAG_COLUMNS = ("keys", "counts", "ids", "text_keys", "sizes", "pairs", "times", "befores", "afters", "pair_sizes", "bits")
_BAGS = ", ".join(["grp int", *[f"{c} binary" for c in _BAG_COLUMNS]])
_BAG_KINDS = pa.schema([("grp", pa.int32()), *[(c, pa.binary()) for c in _BAG_COLUMNS]])


def _bag(row: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each row: (where, how often), rows in order."""
    _, at, n = np.unique(mix(token + row.astype(np.uint64) * np.uint64(WORD_STEP)), return_index=True, return_counts=True)
    order = np.argsort(at)
    return at[order], n[order]


def _among(keys: np.ndarray, these: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the sorted ones, and the slots of those."""
    if not len(these):
        return np.zeros(len(keys), bool), np.zeros(0, np.int64)
    slot = np.minimum(np.searchsorted(these, keys), len(these) - 1)
    hit = these[slot] == keys
    return hit, slot[hit]


def _lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a sorted array and how often each is there."""
    new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))[: len(x)]
    return x[new], np.diff(np.append(new, len(x)))


def _alone(sent: tuple, row: np.ndarray, q: np.ndarray, n: int, heavy: tuple[np.ndarray, np.ndarray], heavy_pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """What a task knows of texts alone, in the order of ``_ADDED``: tokens, the score without bigrams, and what heavy tokens and bigrams add.

    ``heavy`` and ``heavy_pairs`` tell which tokens and bigrams are heavy, and their slots.
    """
    _, total, distinct, (_, counts), (_, pair_counts) = sent
    score = np.zeros(len(row))
    if total:
        before = np.roll(q, 1)  # a text begins as often as one ends, and an end is before it here
        of = share(q, total, distinct)
        score = np.log10(PRIOR * of / (typical(before) + PRIOR))
        often, slot = heavy_pairs
        score[often] += gain(level(pair_counts[slot]), before[often], of[often])
    known, slot = heavy
    base = np.bincount(row[known], np.log10(counts[slot] + HALF), minlength=n)
    return np.ones(n, np.int64), np.bincount(row, minlength=n), np.bincount(row[known], minlength=n), base, np.bincount(row, score, minlength=n)


def _buckets(ids: np.ndarray, keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64) + keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _bags(sent, groups: int, buckets: int, flush: int):
    """Texts -> what is known of them alone, by bucket, and their other tokens and bigrams with counts, by range."""

    def rows(tokens: list[tuple[np.ndarray, ...]], pairs: list[tuple[np.ndarray, ...]], ids: np.ndarray, texts: np.ndarray) -> list[tuple]:
        def dealt(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            text, key, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
            order, _ = by_group(range_of(key, groups), groups)
            text, key = text[order], key[order]
            return range_of(key, groups) * len(ids) + text, key, *(r[order] for r in rest)

        place, key, n = dealt(tokens)
        pair_place, pair, times, before, after = dealt(pairs)
        (one, n_one), (two, n_two) = _lengths(place), _lengths(pair_place)  # places only grow
        both = np.union1d(one, two)
        sizes, pair_sizes = np.zeros(len(both), np.int64), np.zeros(len(both), np.int64)
        sizes[np.searchsorted(both, one)] = n_one
        pair_sizes[np.searchsorted(both, two)] = n_two
        bounds = np.arange(groups + 1) * len(ids)
        out = []
        for g, (u, t, p) in enumerate(zip(*(np.stack([x[:-1], x[1:]], 1).tolist() for x in (np.searchsorted(y, bounds) for y in (both, place, pair_place))), strict=True)):
            if u[1] > u[0]:
                own, t, p = slice(*u), slice(*t), slice(*p)
                text = both[own] - g * len(ids)
                out.append((
                    g, key[t].tobytes(), packed(n[t].astype(np.uint32)), packed(ids[text]), texts[text].tobytes(), packed(sizes[own].astype(np.uint32)),
                    pair[p].tobytes(), packed(times[p].astype(np.uint32)), before[p].tobytes(), after[p].tobytes(), packed(pair_sizes[own].astype(np.uint32)), None,
                ))
        return out

    def whole(ids: np.ndarray, texts: np.ndarray, alone: list[tuple[np.ndarray, ...]]) -> list[tuple]:
        n_rows, n_tokens, n_known, base, score = (np.concatenate(x) for x in zip(*alone, strict=True))
        order, begin = by_group(_buckets(ids, texts, buckets), buckets)
        out = []
        for g in np.flatnonzero(np.diff(begin)).tolist():
            own = order[begin[g] : begin[g + 1]]
            named = {"ids": packed(ids[own]), "text_keys": texts[own].tobytes(), "sizes": packed(n_rows[own]), "counts": packed(n_tokens[own]), "times": packed(n_known[own]),
                     "pairs": base[own].tobytes(), "keys": score[own].tobytes()}
            out.append((groups + g, *[named.get(c) for c in _BAG_COLUMNS]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, _, _, (heavy, _), (heavy_pairs, _) = sent.value
        filter_ = Filter(**filter_) if filter_ else None
        tokens, pairs, ids, texts, alone = [], [], [], [], []
        size = n_texts = 0

        def held() -> pa.RecordBatch:
            i, t = np.concatenate(ids), np.concatenate(texts)
            return blob_rows(_BAG_KINDS, rows(tokens, pairs, i, t) + whole(i, t, alone))

        for b in blocks(batches, "text"):
            row, token, pair = tokens_of(words_of(b.column("text"), spaced(), lower=True))
            q = _levels_of(b, token, filter_)
            often, often_pairs = _among(token, heavy), _among(pair, heavy_pairs)
            alone.append(_alone(sent.value, row, q, len(b), often, often_pairs))
            q = q.astype(np.uint8)
            before = np.roll(q, 1)
            seen = (q > 0) & (before > 0) & ~often_pairs[0]
            rest = ~often[0]
            at, n = _bag(row[rest], token[rest])
            tokens.append((row[rest][at] + n_texts, token[rest][at], n))
            size += len(at)
            at, n = _bag(row[seen], pair[seen])
            pairs.append((row[seen][at] + n_texts, pair[seen][at], n, before[seen][at], q[seen][at]))
            size += len(at)
            ids.append(b.column("id").to_numpy(zero_copy_only=False))
            texts.append(b.column("text_key").to_numpy(zero_copy_only=False))
            n_texts += len(b)
            if size >= flush:
                yield held()
                tokens, pairs, ids, texts, alone = [], [], [], [], []
                size = n_texts = 0
        if n_texts:
            yield held()

    return run


def _by_text(ids: np.ndarray, keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Values added up by text: ids, keys, sums."""
    order = np.lexsort((keys, ids))
    ids, keys = ids[order], keys[order]
    new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])]))
    return ids[new], keys[new], *(np.add.reduceat(v[order], new) for v in values)


def _range_scores(groups: int, buckets: int, total: int, distinct: int):
    """One range: what was learned (rows without ids) looked up for the tokens and bigrams of texts, summed by text, packed by buckets of texts.

    What is known of texts alone goes on as it is.
    """

    def run(table: pa.Table) -> pa.Table:
        cols = {n: table.column(n).to_pylist() for n in table.column_names}
        if cols["grp"][0] >= groups:
            named = [cols[c] for c in ("ids", "text_keys", "sizes", "counts", "times", "pairs", "keys")]
            return pa.Table.from_batches([blob_rows(_SUMMED_KINDS, [(cols["grp"][0] - groups, *r) for r in zip(*named, strict=True)])])
        bags = [k for k, ids in enumerate(cols["ids"]) if ids is not None]
        if not bags:
            return _SUMMED_KINDS.empty_table()
        known, n, bits = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        for k in set(range(len(table))) - set(bags):  # one row of tokens, one of bigrams
            if cols["bits"][k] is None:
                known, n = np.frombuffer(cols["keys"][k], np.uint64), unpacked(cols["counts"][k], np.int64)
            else:
                bits = np.frombuffer(cols["bits"][k], np.uint8)
        base, n_known, score = [], [], []
        for k in bags:
            key, times = np.frombuffer(cols["keys"][k], np.uint64), unpacked(cols["counts"][k], np.uint32).astype(np.int64)
            own = unpacked(cols["sizes"][k], np.uint32)
            text = np.repeat(np.arange(len(own)), own)
            slot = np.searchsorted(known, key)
            count = np.where(np.append(known, np.uint64(0))[slot] == key, np.append(n, 0)[slot], 0)
            base.append(np.bincount(text, times * np.log10(count + HALF), minlength=len(own)))
            n_known.append(np.bincount(text, times * (count > 0), minlength=len(own)).astype(np.int64))
            pair, times = np.frombuffer(cols["pairs"][k], np.uint64), unpacked(cols["times"][k], np.uint32).astype(np.int64)
            before, after = (np.frombuffer(cols[c][k], np.uint8).astype(np.int64) for c in ("befores", "afters"))
            text = np.repeat(np.arange(len(own)), unpacked(cols["pair_sizes"][k], np.uint32))
            both = probed(bits, np.zeros(len(pair), np.int64), 8 * len(bits), pair, 2) if len(bits) else np.zeros(len(pair), np.int64)
            score.append(np.bincount(text, times * gain(both, before, share(after, total, distinct)), minlength=len(own)))
        ids = np.concatenate([unpacked(cols["ids"][k], np.int64) for k in bags])
        keys = np.concatenate([np.frombuffer(cols["text_keys"][k], np.int64) for k in bags])
        ids, keys, base, n_known, score = _by_text(ids, keys, *(np.concatenate(x) for x in (base, n_known, score)))
        order, begin = by_group(_buckets(ids, keys, buckets), buckets)
        rows = []
        for g in np.flatnonzero(np.diff(begin)).tolist():
            own = order[begin[g] : begin[g + 1]]
            rows.append((g, packed(ids[own]), keys[own].tobytes(), None, None, packed(n_known[own]), base[own].tobytes(), score[own].tobytes()))
        return pa.Table.from_batches([blob_rows(_SUMMED_KINDS, rows)])

    return run


def _text_scores(table: pa.Table) -> pa.Table:
    """A bucket of texts: what is known of them alone and the ranges' parts added up."""
    cols = {n: table.column(n).to_pylist() for n in table.column_names}
    ids = [unpacked(x, np.int64) for x in cols["ids"]]

    def added(name: str, kind) -> np.ndarray:
        read = (lambda x: np.frombuffer(x, kind)) if kind is np.float64 else (lambda x: unpacked(x, kind))
        return np.concatenate([np.zeros(len(own), kind) if x is None else read(x) for x, own in zip(cols[name], ids, strict=True)])

    keys = np.concatenate([np.frombuffer(x, np.int64) for x in cols["text_keys"]])
    sums = _by_text(np.concatenate(ids), keys, *(added(n, kind) for n, kind in _ADDED))
    return pa.Table.from_arrays([pa.array(x) for x in sums], schema=_PART_KINDS)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None, bits: int = BITS, group: int = GROUP, flush: int = FLUSH, part: int = ROUND) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` tells the rows to learn from; without it, those that ``held_out``
    does not name. A null text is empty: one token, the end. Rows of equal id and
    text get equal results, repeated rows one each. A null id is never held out.
    Without training rows all counts are 0 and ``score`` is null. Other columns
    are not looked at. ``bits`` of the unigrams' filter are broadcast at once; the
    scores do not depend on them, nor on ``part``, the bytes of text of a round.
    """
    spark = docs.sparkSession
    bounded(spark)
    out = held_out(F.col(id_col))
    texts = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text_key(text_col).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        (~out if train is None else F.coalesce(train, F.lit(False))).alias("train"),
    )
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    # A word and its blank are three bytes at least, mostly.
    groups = max(RANGES_PER_CORE * spark.sparkContext.defaultParallelism, -(-size // (3 * group)))
    buckets = max(groups, shuffle_width(spark))
    counts = _freed_table(with_segments(count_ngrams(texts.where("train"), groups, flush)), "ngram-counts")
    learned = counts.where("n = 1").agg(F.sum("total"), F.sum("distinct_keys")).first()
    total, distinct = learned[0] or 0, learned[1] or 0
    texts, filter_ = token_levels(texts.drop("train"), counts, groups, bits)
    # ``bits`` (a range at least) and twice HEAVY numbers at most.
    sent = spark.sparkContext.broadcast((vars(filter_) if filter_ else None, total, distinct, _heavy(counts, 1, total), _heavy(counts, 2, total)))
    one = F.col("n") == 1
    known = counts.select("grp", *[F.when(one, F.col(c)).alias(c) if c in ("keys", "counts") else F.col(c) if c == "bits" else F.lit(None).cast("binary").alias(c) for c in _BAG_COLUMNS])
    rounds = min(ROUNDS, in_blocks(size, part))

    def scored(texts: DataFrame) -> DataFrame:
        bags = texts.mapInArrow(lean(_bags(sent, groups, buckets, flush)), _BAGS)
        found = bags.unionByName(known).groupBy("grp").applyInArrow(lean_group(_range_scores(groups, buckets, total, distinct)), _SUMMED)
        return found.groupBy("bucket").applyInArrow(lean_group(_text_scores), _PARTS)

    # Rows of equal id and text meet in one round; nothing of a text but its length is looked at to deal them.
    dealt = F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(rounds))
    shares = [texts.where(dealt == k) for k in range(rounds)]
    sums = union_all([_freed_table(scored(x), "text-scores") for x in shares]) if rounds > 1 else scored(texts)
    id_ = F.when(F.col("id") != NO_ID, F.col("id"))
    level_ = float(np.log10(total + HALF * (distinct + 1)))
    each = sums.select(
        id_.alias("doc_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))).alias("_"),
        (F.col("n_tokens") / F.col("n_rows")).cast("long").alias("n_tokens"), (F.col("n_known") / F.col("n_rows")).cast("long").alias("n_known"),
        (F.col("base") / F.col("n_rows")).alias("base"), (F.col("score") / F.col("n_rows")).alias("score"),
    )
    return each.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * level_).alias("base_score"), (F.col("score") if total else F.lit(None).cast("double")).alias("score"),
    )


def _freed_table(df: DataFrame, label: str) -> DataFrame:
    """A kept table whose shuffle files do not stay."""
    conf = df.sparkSession.conf
    before = conf.get(FREED)
    conf.set(FREED, "true")
    try:
        return kept_table(df, label)
    finally:
        conf.set(FREED, before)


def _heavy(counts: DataFrame, order: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of more than 1 / HEAVY of the corpus with their counts: HEAVY at most."""
    limit = total / HEAVY

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                keys, n = np.frombuffer(r["keys"], np.int64), unpacked(r["counts"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[n > limit]), pa.array(n[n > limit])], ["k", "c"])

    rows = counts.where(F.col("n") == order).select("keys", "counts").mapInArrow(lean(find), "k long, c long").collect()
    keys, n = np.array([r["k"] for r in rows], np.int64).view(np.uint64), np.array([r["c"] for r in rows], np.int64)
    order = np.argsort(keys)
    return keys[order], n[order]
