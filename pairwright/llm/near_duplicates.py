"""Near duplicates: banded MinHash candidates, sequential Bayesian verification, exact check.

1. Each text becomes the set of its distinct shingles. Texts with equal sets are
   one class; only classes go on.
2. A signature of ``BANDS * ROWS`` minima gives ``BANDS`` bucket keys. Buckets with
   one class are dropped.
3. Pairs are compared against pivots. In the first round a bucket's pivot is its
   class of smallest rank (a hash), and all others are paired with it. Where a bucket
   still spans several components, further rounds take pivots from the classes that
   are outside the first pivot's component, by growing rank, and pair them with
   classes of other components, until all have been pivots. So a bucket of a million
   copies with small changes costs about a pair for each, and no similar pair of
   different components goes untested.
4. Pivots and members of a bucket meet in sorted order in one task, a pivot's copies
   in several tasks if the bucket is large. Each class has a second signature of
   ``MINIMA`` minima, one byte of each; a pair's are compared a batch at a time.
   After each batch the pair is dropped if the posterior probability that its
   similarity reaches the threshold is below ``MISS`` (uniform prior). After the
   first round, when what is left are mostly families of texts that are almost alike
   enough, 16 bits of each shingle bound the shared part from above. Pairs that are
   dropped never become rows.
5. What survives is checked on the full sets; links that hold are joined to
   components by label propagation with pointer jumping, table by table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.frames import bounded, give_back, kept_table, lean, lean_group, shuffle_width, text_key
from pairwright.llm.words import Words, blocks, chained, mix, ragged, spaced, words_of

#: Words of a shingle; links share at least this percentage of their union.
SHINGLE, PERCENT = 5, 75
#: At similarity 0.75 a pair shares no bucket with a chance of 0.0000053; at 0.3 it shares one with 0.23.
BANDS, ROWS = 32, 4
#: Minima of the second signature, those compared at once, and the chance of missing a link that a batch may add.
MINIMA, BATCH, MISS = 512, 64, 1e-6
#: Pivots of a bucket grow by this factor each round, and by so many at most. Members of a bucket for each task.
GROWTH, MOST_PIVOTS, MEMBERS = 32, 1 << 15, 1 << 16
#: Pairs that a task compares at once.
PAIRS = 1 << 16
#: Bits of the filter that tells which texts are needed again.
FILTER_BITS = 1 << 25

_SIGNED = "id long, text_key long, cls binary, n long, sig binary"
_SIGNED_KINDS = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("cls", pa.binary()), ("n", pa.int64()), ("sig", pa.binary())])


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint) of the distinct shingles, rows in order; a text of fewer words is one shingle."""
    at = w.windows(size)
    rows = [w.rows[at]]
    prints = [chained(w.hashes, at, size)]
    for n in range(1, size):
        short = np.flatnonzero(w.counts == n)
        rows.append(short)
        prints.append(chained(w.hashes, w.bounds[short], n))
    row, h = np.concatenate(rows), np.concatenate(prints)
    _, first = np.unique(mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    first = first[np.argsort(row[first], kind="stable")]
    return row[first], h[first]


def signatures(h: np.ndarray, begin: np.ndarray, n: int, seed: int = 1009) -> np.ndarray:
    """``n`` minima (upper halves) of each run of fingerprints; no run is empty."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 2**64, n, np.uint64) | np.uint64(1)
    shifts = rng.integers(0, 2**64, n, np.uint64)
    out = np.empty((len(begin), n), np.uint32)
    if len(begin):
        x = np.empty_like(h)
        for k in range(n):
            np.multiply(h, factors[k], out=x)
            np.add(x, shifts[k], out=x)
            out[:, k] = np.minimum.reduceat(x, begin) >> np.uint64(32)
    return out


def _class_of(row: np.ndarray, h: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """128 bits of each set, in any order of its shingles; they stand for the set."""
    low, high = np.add.reduceat(h, begin), np.add.reduceat(mix(h ^ np.uint64(0x94D049BB133111EB)), begin)
    return np.stack([mix(low + counts.astype(np.uint64)), mix(high)], axis=1)


def _sign(size: int, n_minima: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            w = words_of(b.column("text"), spaced(), lower=True)
            row, h = shingles(w, size)
            n = np.bincount(row, minlength=len(b))
            some = np.flatnonzero(n)
            begin = np.searchsorted(row, some)
            cls: list[bytes | None] = [None] * len(b)
            sig: list[bytes | None] = [None] * len(b)
            if len(some):
                sets, minima = _class_of(row, h, begin, n[some]), signatures(h, begin, n_minima)
                for k, r in enumerate(some.tolist()):
                    cls[r], sig[r] = sets[k].tobytes(), minima[k].tobytes()
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_key"), pa.array(cls, pa.binary()), pa.array(n.astype(np.int64)), pa.array(sig, pa.binary())], schema=_SIGNED_KINDS)

    return run


@cache
def least_matches(total: int, batch: int, percent: int, miss: float) -> np.ndarray:
    """For each number of compared bytes: matches from which P(similarity >= threshold | matches) is at least ``miss``.

    A byte of unlike minima matches by chance once in 256. The driver works this
    out, so one number of matches is looked at at a time.
    """
    x = (np.arange(20000) + 0.5) / 20000
    over = x >= percent / 100
    match = x + (1 - x) / 256
    hit, fail = np.log(match), np.log1p(-match)

    def reached(n: int, m: int) -> bool:
        log_density = m * hit + (n - m) * fail
        density = np.exp(log_density - log_density.max())
        return (density * over).sum() >= miss * density.sum()

    return np.array([next((m for m in range(n + 1) if reached(n, m)), 0) for n in range(batch, total + 1, batch)])


def survivors(x: np.ndarray, p: np.ndarray, m: np.ndarray, batch: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (row p, row m) of signatures those that no batch rules out."""
    matches = np.zeros(len(p), np.int64)
    for k, need in enumerate(least):
        part = slice(k * batch, (k + 1) * batch)
        matches += (x[p, part] == x[m, part]).sum(axis=1)
        hold = matches >= need
        p, m, matches = p[hold], m[hold], matches[hold]
    return p, m


def shared_at_most(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> int:
    """Upper bound of the common part of two sets from their distinct 16-bit halves and full sizes."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both + min(n_a - len(a), n_b - len(b))


_DEALT = ("bucket", "salt", "node", "comp", "pivot", "member", "n", "sig", "short")


def _compare(percent: int, batch: int, miss: float):
    """Rows of buckets, pivots first -> pairs (a < b) of members with pivots before them that the posterior does not rule out."""
    least = least_matches(MINIMA, batch, percent, miss)

    def pairs(get: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        new = np.flatnonzero(np.concatenate([[True], (get["bucket"][1:] != get["bucket"][:-1]) | (get["salt"][1:] != get["salt"][:-1])]))
        group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(get["node"]))))
        seen = np.cumsum(get["pivot"]) - get["pivot"]  # pivots before each row
        first = seen[new][group]
        pivots = np.flatnonzero(get["pivot"])
        rows = np.flatnonzero(get["member"] & (seen > first))
        counts = (seen - first)[rows]
        cuts = (np.flatnonzero(np.diff(np.cumsum(counts) // PAIRS)) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            m = np.repeat(rows[lo:hi], counts[lo:hi])
            p = pivots[np.repeat(first[rows[lo:hi]], counts[lo:hi]) + ragged(counts[lo:hi])]
            n = get["n"]  # the smaller set must reach the share of the larger
            able = (get["comp"][m] != get["comp"][p]) & (100 * np.minimum(n[m], n[p]) >= percent * np.maximum(n[m], n[p]))
            p, m = survivors(get["sig"], p[able], m[able], batch, least)
            if len(p) and get["short"][p[0]]:
                near = np.zeros(len(p), bool)
                for k, (x, y) in enumerate(zip(p.tolist(), m.tolist(), strict=True)):
                    both = shared_at_most(*(np.frombuffer(get["short"][r], np.uint16) for r in (x, y)), n[x], n[y])
                    near[k] = 100 * both >= percent * (n[x] + n[y] - both)
                p, m = p[near], m[near]
            yield get["node"][p], get["node"][m]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None  # pivots of the last bucket
        for b in batches:
            if not len(b):
                continue
            get = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(_DEALT, b.columns, strict=True)}
            get["sig"] = np.frombuffer(b"".join(get["sig"]), np.uint8).reshape(len(b), -1)
            if held is not None:
                get = {n: np.concatenate([held[n], get[n]]) for n in _DEALT}
            found = np.concatenate([np.stack([np.minimum(x, y), np.maximum(x, y)]) for x, y in pairs(get)] or [np.zeros((2, 0), np.int64)], axis=1)
            found = np.unique(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])
            last = get["pivot"] & (get["bucket"] == get["bucket"][-1]) & (get["salt"] == get["salt"][-1])
            held = {n: v[last] for n, v in get.items()}
            held["member"] = np.zeros(int(last.sum()), bool)

    return run


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, comp): the smallest node of each component.

    Every round each node takes the smallest label among its own, its neighbours'
    and its label's label; rounds end when none changes. Minima combine before
    the shuffle, so a node with very many neighbours is no hot group.
    """
    edges = kept_table(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = kept_table(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("comp").alias("near"))
        step = labels.join(near, F.col("node") == F.col("n")).select("node", "comp", F.least("comp", "near").alias("low"))
        up = labels.select(F.col("node").alias("n"), F.col("comp").alias("up"))
        step = step.join(up, F.col("low") == F.col("n"), "left").select("node", "comp", F.least("low", "up").alias("new"))
        step = kept_table(step, "labels")
        labels = step.select("node", F.col("new").alias("comp"))
        if step.where("new <> comp").isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
    batch: int = BATCH, miss: float = MISS, detail: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept; with ``detail`` also text_key and component.

    ``component_id`` is the smallest id reachable by links, ``kept`` whether that
    is the row's own. A null text has no words; a text without words has no
    shingles and is linked with nothing. Null ids are never smallest: a component
    of such rows alone has a null id and keeps them. Rows that repeat an id are
    nodes of their own, but all of them are kept if the id is. ``text_key`` tells
    texts of one id apart, ``component`` is a number for each component, ids or not,
    and null for a text without shingles. Other columns are not looked at.
    """
    spark = docs.sparkSession
    bounded(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = kept_table(texts.mapInArrow(lean(_sign(shingle, bands * rows)), _SIGNED), "signed")
    # One row per class; the node number is fixed by writing it.
    classes = signed.where("cls is not null").groupBy("cls").agg(F.min("id").alias("low"), F.first("sig").alias("sig"))
    classes = kept_table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    keys = F.expr(f"transform(sequence(0, {bands - 1}), b -> xxhash64(b, substring(sig, b * {4 * rows} + 1, {4 * rows})))")
    banded = classes.select(F.explode(keys).alias("bucket"), "node")
    several = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    buckets = kept_table(banded.join(several, "bucket"), "buckets")
    wanted = kept_table(classes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "cls"), "candidates")
    comps = _links(buckets, kept_table(_sets(texts, wanted, shingle), "shingle-sets"), percent, batch, miss)
    if comps is None:
        low = classes.select("cls", "low", F.col("node").alias("comp"))
    else:
        placed = classes.select("cls", "node", "low").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        lows = placed.groupBy("comp").agg(F.min("low").alias("least"))
        low = placed.join(lows, "comp").select("cls", F.col("least").alias("low"), "comp")
    # Texts without shingles have no class and stay out of the join.
    none = signed.where("cls is null").select("id", "text_key", "n", F.col("id").alias("low"), F.lit(None).cast("long").alias("comp"))
    some = signed.where("cls is not null").join(kept_table(low, "components").withColumnRenamed("cls", "_c"), F.col("cls") == F.col("_c"))
    out = some.select("id", "text_key", "n", "low", "comp").unionByName(none)
    more = ["text_key", F.col("comp").alias("component")] if detail else []
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("low").alias("component_id"), F.col("id").eqNullSafe(F.col("low")).alias("kept"), *more)


def _sets(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, n, set, sig, short): shingles, second signature and 16-bit halves of the classes in ``wanted``, from one text of each.

    A filter of fixed size keeps most other texts out before the join decides.
    """
    spark = texts.sparkSession
    slices = 16

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(FILTER_BITS // 8, np.uint8)
        for b in batches:
            place = _filter_places(b.column("cls").to_pylist())
            np.bitwise_or.at(on, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(slices, dtype=np.int32)), pa.array([x.tobytes() for x in np.split(on, slices)], pa.binary())], ["slice", "bits"])

    def either(table: pa.Table) -> pa.Table:
        on = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
        return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([on.tobytes()], pa.binary())})

    parts = wanted.select("cls").mapInArrow(lean(mark), "slice int, bits binary").groupBy("slice").applyInArrow(lean_group(either), "slice int, bits binary").collect()
    bits = np.concatenate([np.frombuffer(r["bits"], np.uint8) for r in sorted(parts)]) if parts else np.zeros(FILTER_BITS // 8, np.uint8)
    sent = spark.sparkContext.broadcast(bits)  # FILTER_BITS bits
    del parts, bits
    give_back()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = sent.value
        for b in blocks(batches, "text"):
            row, h = shingles(words_of(b.column("text"), spaced(), lower=True), size)
            n = np.bincount(row, minlength=len(b))
            some = np.flatnonzero(n)
            begin = np.searchsorted(row, some)
            if not len(some):
                continue
            cls = [c.tobytes() for c in _class_of(row, h, begin, n[some])]
            place = _filter_places(cls)
            new = dict(zip(cls, range(len(cls)), strict=True))  # one of equal sets
            keep = [k for c, k in new.items() if on[place[k] >> 3] >> (place[k] & 7) & 1]
            sets = [h[begin[k] : begin[k] + n[some[k]]] for k in keep]
            sizes = np.array([len(x) for x in sets], np.int64)
            minima = signatures(np.concatenate(sets), np.cumsum(sizes) - sizes, MINIMA, 2003).astype(np.uint8) if sets else np.zeros((0, MINIMA), np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([cls[k] for k in keep], pa.binary()), pa.array(sizes), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array([x.tobytes() for x in minima], pa.binary()),
                 pa.array([np.unique(x.astype(np.uint16)).tobytes() for x in sets], pa.binary())],
                ["cls", "n", "set", "sig", "short"],
            )

    found = texts.select("text").mapInArrow(lean(read), "cls binary, n long, set array<long>, sig binary, short binary")
    return wanted.join(found, "cls").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "set", "sig", "short")])


def _filter_places(cls: list[bytes]) -> np.ndarray:
    return (np.frombuffer(b"".join(cls), np.uint64)[0::2] % np.uint64(FILTER_BITS)).astype(np.int64)


def _links(buckets: DataFrame, nodes: DataFrame, percent: int, batch: int, miss: float) -> DataFrame | None:
    """(node, comp) of all nodes with links, found pivot by pivot; None if there are no links.

    ``below`` of a bucket: classes whose share (their rank) is smaller have been pivots.
    """
    rank = F.xxhash64(F.lit("rank"), "node")  # the same in all buckets, so pivots are too
    share = F.shiftrightunsigned(rank, 11) / float(1 << 53)
    here = buckets.select("bucket", "node", share.alias("share"), F.lit(0.0).alias("below"))
    comps = None
    pivots = 0
    while True:
        here = _open(here, comps)
        if pivots:
            # Classes outside the first pivot's component: every pair of different components has one.
            rest = here.where("stray").groupBy(F.col("bucket").alias("_k")).agg(F.count("*").alias("rest"))
            here = here.join(rest, F.col("bucket") == F.col("_k")).drop("_k").withColumn("upto", F.lit(float(pivots)) / F.col("rest"))
            chosen = F.col("stray") & (F.col("share") >= F.col("below")) & (F.col("share") < F.col("upto"))
        else:
            here = here.withColumn("rest", F.lit(2).cast("long")).withColumn("upto", F.lit(0.0))
            chosen = F.col("node") == F.col("first")
        here = kept_table(here, "open-buckets")
        most = here.agg(F.max("rest")).first()[0]
        if most is None:
            return comps
        # Pairs with an earlier pivot were tested in its round.
        rows = here.where(~(F.col("stray") & (F.col("share") < F.col("below")))).withColumn("pivot", chosen)
        held = kept_table(_checked(_dealt(rows, nodes, pivots > 0, percent, batch, miss), nodes, percent), "links")
        if not held.isEmpty():
            comps = _joined(comps, held)
        if 0 < most <= pivots:
            return comps
        here = here.select("bucket", "node", "share", F.col("upto").alias("below"))
        pivots = max(GROWTH, pivots + min(pivots * (GROWTH - 1), MOST_PIVOTS))


def _joined(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components with further links: only components are linked anew, not their nodes."""
    if comps is None:
        return components(links)
    x, y = comps.select(F.col("node").alias("_x"), F.col("comp").alias("_p")), comps.select(F.col("node").alias("_y"), F.col("comp").alias("_q"))
    ends = links.join(x, F.col("a") == F.col("_x"), "left").join(y, F.col("b") == F.col("_y"), "left")
    up = components(ends.select(F.coalesce("_p", "a").alias("a"), F.coalesce("_q", "b").alias("b"))).select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
    moved = comps.join(up, F.col("comp") == F.col("_n"), "left").select("node", F.coalesce("_c", "comp").alias("comp"))
    fresh = up.join(comps, F.col("_n") == F.col("node"), "left_anti").select(F.col("_n").alias("node"), F.col("_c").alias("comp"))
    return kept_table(moved.unionByName(fresh), "components")


def _dealt(rows: DataFrame, nodes: DataFrame, bounded_by_sets: bool, percent: int, batch: int, miss: float) -> DataFrame:
    """Pairs of pivots and members that are likely to be linked. A bucket of many members is dealt to several tasks, with all pivots in each."""
    salts = F.ceil(F.col("size") / MEMBERS).cast("int")
    own = F.pmod(F.hash("node"), salts)
    copies = F.when(F.col("pivot"), F.sequence(F.lit(0), salts - 1)).otherwise(F.array(own))
    salted = rows.select("bucket", "node", "comp", "share", "pivot", own.alias("own"), F.explode(copies).alias("salt"))
    short = F.col("short") if bounded_by_sets else F.lit(b"")
    full = salted.join(nodes.select(F.col("node").alias("_n"), "n", "sig", short.alias("short")), F.col("node") == F.col("_n")).withColumn("member", F.col("salt") == F.col("own"))
    sorted_ = full.repartition(shuffle_width(rows.sparkSession), "bucket", "salt").sortWithinPartitions("bucket", "salt", F.desc("pivot"), "share", "node")
    return sorted_.select(*_DEALT).mapInArrow(lean(_compare(percent, batch, miss)), "a long, b long").distinct()


def _open(here: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Buckets that span several components, with each class's component, the first pivot, and whether the class is outside that one's component."""
    if comps is None:
        placed = here.withColumn("comp", F.col("node"))
    else:
        c = comps.select(F.col("node").alias("_n"), F.col("comp").alias("_comp"))
        placed = here.join(c, F.col("node") == F.col("_n"), "left").select(*here.columns, F.coalesce("_comp", "node").alias("comp"))
    first = F.min(F.struct("share", "node", "comp"))
    span = placed.groupBy(F.col("bucket").alias("_k")).agg(F.min("comp").alias("_a"), F.max("comp").alias("_b"), first.alias("_f"), F.count("*").alias("size")).where("_a < _b")
    out = placed.join(span, F.col("bucket") == F.col("_k"))
    return out.select(*placed.columns, "size", F.col("_f.node").alias("first"), (F.col("comp") != F.col("_f.comp")).alias("stray"))


def _checked(likely: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets share enough."""
    likely = kept_table(likely, "likely")  # its size decides how it is joined
    x, y = nodes.select(F.col("node").alias("a"), F.col("set").alias("set_a")), nodes.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    full = likely.join(x, "a").join(y, "b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return full.where(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")
