"""Embedding near-duplicates: an exact metric range join over pivots.

Vectors of equal components are one class with a weight. Their angle is a metric, and
``cosine >= c`` is a ball of radius r = arccos c.

1. Pivots come from a sample of ``SAMPLE`` classes, the densest first and none within
   r / 2 of an earlier one. How many are taken follows from the work that they save
   on the sample; any number gives the same result.
2. Every vector is at home in the cell of its nearest pivot. Vectors within r / 2 of
   the pivot form the cell's core: they are all linked with each other, which takes no
   comparison, so a cluster of very many near copies costs what its members cost.
   Homes are dealt to parts of ``MEMBERS``.
3. Of two parts one visits the other, by their numbers. A vector at home under pivot
   p, at angles d to the pivots, visits a part of pivot q only if a link is possible:
   by the triangle inequality the part must reach angles from d_i - r to d_i + r of
   every pivot i, and d_q - d_p must not exceed 2 r.
4. Parts are joined independently: vectors in order of their angle to the pivot, in
   blocks. Blocks whose angles differ by more than r are skipped, those whose angles
   add up to r at most are linked without a product; of all others a product in single
   precision settles all pairs but those near the threshold, which are computed again
   in double precision.
5. A part gives each vector the weight of its links and one linked vector to follow to
   its component, never pairs. Sums and components are made over all parts.

In vectors without structure around r (independent ones of many dimensions) no pivot
rules anything out: then the cost is that of comparing all parts, each pair once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.frames import bounded, kept_table, lean, lean_group, send, union_all
from pairwright.llm.near_duplicates import components

COSINE = 0.9
#: Classes that pivots are chosen from, pivots at most, and vectors at home in a part.
SAMPLE, PIVOTS, MEMBERS = 2048, 256, 4096
#: Vectors of a block inside a part, and candidates whose bounds are tested at once.
BLOCK, ROWS = 1024, 1 << 13
#: What moving a vector costs, in comparisons.
MOVE = 2000
#: Slack of angles: bounds only rule out (or link) what is further from the threshold.
SLACK = 1e-6


@dataclass
class Cells:
    """Pivots (unit rows, padded with zeros to one length) and what is known of the parts."""

    pivots: np.ndarray
    lengths: np.ndarray
    radius: float
    low: np.ndarray
    high: np.ndarray
    cell: np.ndarray
    core: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    def visits(self, angles: np.ndarray, home: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, part) of all visits; ``home`` is the kind (row of the tables) and ``own`` the part each vector lives in."""
        reach, kinds = self.radius + SLACK, np.arange(len(self.cell))
        there = angles[:, self.cell]
        near = (there >= self.low[kinds, self.cell] - reach) & (there <= self.high[kinds, self.cell] + reach)
        near &= there - angles[np.arange(len(angles)), self.cell[home]][:, None] <= 2 * reach
        near[np.arange(len(angles)), home] &= ~self.core[home]  # a core is linked with itself already
        vector, kind = np.nonzero(near)
        for lo in range(0, len(vector), ROWS):  # the other pivots' angles
            v, k = vector[lo : lo + ROWS], kind[lo : lo + ROWS]
            near[v, k] = ((angles[v] >= self.low[k] - reach) & (angles[v] <= self.high[k] + reach)).all(axis=1)
        vector, kind = np.nonzero(near)
        vector, part = np.repeat(vector, self.parts[kind]), np.repeat(self.first[kind], self.parts[kind]) + _counted(self.parts[kind])
        mine = own[vector]
        goes = (part != mine) & ((mine < part) ^ ((mine + part) % 2 == 1))
        return vector[goes], part[goes]


def _counted(counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _rows_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Raw vectors as rows of ``width`` doubles, padded with zeros, and their own lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = column.offsets.to_numpy()
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), _counted(lengths)] = flat
    return out, lengths


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _homes(angles: np.ndarray, lengths: np.ndarray, pivot_lengths: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each vector, and whether it is in the core. Only vectors of the pivot's length are in a core."""
    cell = angles.argmin(axis=1)
    return cell, (angles[np.arange(len(cell)), cell] <= radius / 2 - SLACK) & (lengths == pivot_lengths[cell])


def _densest_first(unit: np.ndarray, radius: float) -> np.ndarray:
    """Rows in order of how many others are within r / 2, without those that are within r / 2 of an earlier one."""
    near = unit @ unit.T >= math.cos(radius / 2)
    order = np.argsort(-near.sum(axis=1), kind="stable")
    taken, covered = [], np.zeros(len(unit), bool)
    for k in order.tolist():
        if not covered[k]:
            taken.append(k)
            covered |= near[k]
    return np.array(taken, np.int64)


def _tables(angles: np.ndarray, lengths: np.ndarray, pivot_lengths: np.ndarray, radius: float) -> tuple[np.ndarray, ...]:
    """Kinds (2 cell + core) that occur, with their sizes and their least and greatest angle to every pivot."""
    cell, core = _homes(angles, lengths, pivot_lengths, radius)
    kind, at, size = np.unique(2 * cell + core, return_inverse=True, return_counts=True)
    order = np.argsort(at, kind="stable")
    begin = np.cumsum(size) - size
    return kind, size, np.minimum.reduceat(angles[order], begin, axis=0), np.maximum.reduceat(angles[order], begin, axis=0)


def _cells(pivots: np.ndarray, pivot_lengths: np.ndarray, radius: float, kind: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, members: int) -> Cells:
    parts = -(-size // members)
    return Cells(pivots, pivot_lengths, radius, low, high, kind // 2, kind % 2 == 1, np.cumsum(parts) - parts, parts)


def choose_pivots(raw: np.ndarray, lengths: np.ndarray, total: int, radius: float, members: int = MEMBERS, most: int = PIVOTS) -> np.ndarray:
    """Rows of a sample that serve as pivots for ``total`` vectors: as many as make the sample's share of the work least."""
    unit = _unit(raw)
    order = _densest_first(unit, radius)
    best, chosen = math.inf, order[:1]
    n = 1
    while n <= min(most, len(order)):
        own = order[:n]
        angles = _angles(unit, unit[own])
        kind, size, low, high = _tables(angles, lengths, lengths[own], radius)
        scaled = np.maximum(1, np.round(size * (total / len(unit)))).astype(np.int64)
        cells = _cells(unit[own], lengths[own], radius, kind, scaled, low, high, members)
        cell, core = _homes(angles, lengths, lengths[own], radius)
        home = np.searchsorted(kind, 2 * cell + core)
        part = cells.first[home] + np.arange(len(home)) % cells.parts[home]
        vector, visited = cells.visits(angles, home, part)
        of = np.repeat(np.arange(len(kind)), cells.parts)
        homes = (scaled / cells.parts)[of]
        cost = MOVE * len(vector) + homes[visited].sum() + (np.where(core, 0, homes[part]) / 2).sum() + len(unit) * n
        if cost < best:
            best, chosen = cost, own
        elif n > 4 * len(chosen):
            break
        n *= 2
    return chosen


def _ranges(sent, width: int):
    """Vectors -> a row for each kind of the task: its size, and its least and greatest angle to every pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, pivot_lengths, radius = sent.value
        held: dict[int, list] = {}
        for b in batches:
            if not len(b):
                continue
            raw, lengths = _rows_of(b.column("vector"), width)
            for kind, size, low, high in zip(*_tables(_angles(_unit(raw), pivots), lengths, pivot_lengths, radius), strict=True):
                at = held.setdefault(int(kind), [0, low, high])
                held[int(kind)] = [at[0] + int(size), np.minimum(at[1], low), np.maximum(at[2], high)]
        yield _range_rows(list(held), list(held.values()))

    return run


def _range_rows(kinds: list[int], values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int64()), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1].tobytes() for v in values], pa.binary()), pa.array([v[2].tobytes() for v in values], pa.binary())],
        ["kind", "size", "low", "high"],
    )


def _merged(table: pa.Table) -> pa.Table:
    """Rows of one kind -> one."""
    low, high = (np.frombuffer(b"".join(table.column(c).to_pylist())).reshape(table.num_rows, -1) for c in ("low", "high"))
    size = sum(table.column("size").to_pylist())
    return pa.Table.from_batches([_range_rows([table.column("kind")[0].as_py()], [[size, low.min(axis=0), high.max(axis=0)]])])


_DEALT = "node long, weight long, vector array<{0}>, length int, core boolean, parts array<int>, angles array<double>"


def _deal(sent, width: int):
    """Vectors with the parts where they take part, their own first, and their angles to those parts' pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(**sent.value)
        kinds = 2 * cells.cell + cells.core
        of = np.repeat(np.arange(len(kinds)), cells.parts)
        for b in batches:
            if not len(b):
                continue
            raw, lengths = _rows_of(b.column("vector"), width)
            angles = _angles(_unit(raw), cells.pivots)
            cell, core = _homes(angles, lengths, cells.lengths, cells.radius)
            home = np.searchsorted(kinds, 2 * cell + core)
            node = b.column("node").to_numpy()
            spread = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            part = cells.first[home] + spread % cells.parts[home]
            vector, visited = cells.visits(angles, home, part)
            vector, visited = np.concatenate([np.arange(len(b)), vector]), np.concatenate([part, visited])
            order = np.argsort(vector, kind="stable")
            vector, visited = vector[order], visited[order]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(vector, minlength=len(b)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), b.column("weight"), b.column("vector"), pa.array(lengths.astype(np.int32)), pa.array(core),
                 pa.ListArray.from_arrays(offsets, pa.array(visited.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(angles[vector, cells.cell[of[visited]]]))],
                ["node", "weight", "vector", "length", "core", "parts", "angles"],
            )

    return run


class Part:
    """Homes of a part in order of their angle, the links found so far, and which homes are joined."""

    def __init__(self, rows: dict[str, np.ndarray], radius: float, cosine: float):
        order = np.argsort(rows["angle"], kind="stable")
        self.home = {k: v[order] for k, v in rows.items()}
        self.radius, self.cosine = radius, cosine
        n = len(order)
        self.up = np.arange(n)
        self.weight = np.zeros(n, np.int64)
        core = self.home["core"]
        if core.any():  # all of them or none
            self.up[:] = 0
        else:
            for lo in range(0, n, BLOCK):
                for x, y in self._pairs(self._slice(self.home, lo, lo + BLOCK), lo):
                    x = x + lo
                    later = y > x
                    self._join(x[later], y[later])
                    np.add.at(self.weight, x[later], self.home["weight"][y[later]])
                    np.add.at(self.weight, y[later], self.home["weight"][x[later]])

    @staticmethod
    def _slice(rows: dict[str, np.ndarray], lo: int, hi: int) -> dict[str, np.ndarray]:
        return {k: v[lo:hi] for k, v in rows.items()}

    def _pairs(self, rows: dict[str, np.ndarray], since: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, home) of all links of a block of rows, sorted by angle, with homes from number ``since`` on."""
        a = rows["angle"]
        lo = max(since, int(np.searchsorted(self.home["angle"], a[0] - self.radius - SLACK)))
        hi = int(np.searchsorted(self.home["angle"], a[-1] + self.radius + SLACK, "right"))
        for at in range(lo, hi, BLOCK):
            h = self._slice(self.home, at, min(hi, at + BLOCK))
            one_length = rows["length"].min() == rows["length"].max() == h["length"].min() == h["length"].max()
            if one_length and a[-1] + h["angle"][-1] <= self.radius - SLACK:
                x, y = np.divmod(np.arange(len(a) * len(h["angle"])), len(h["angle"]))
            else:
                s = rows["short"] @ h["short"].T
                margin = 2e-7 * (rows["short"].shape[1] + 8)
                likely = s >= self.cosine - margin
                if not likely.any():
                    continue
                x, y = np.nonzero(likely)
                unsure = np.flatnonzero(s[x, y] < self.cosine + margin)
                exact = np.einsum("ij,ij->i", rows["unit"][x[unsure]], h["unit"][y[unsure]])
                keep = np.ones(len(x), bool)
                keep[unsure] = exact >= self.cosine
                keep &= rows["length"][x] == h["length"][y]
                x, y = x[keep], y[keep]
            yield x, y + at

    def _root(self, k: np.ndarray) -> np.ndarray:
        root = self.up[k]
        while True:
            up = self.up[root]
            if (up == root).all():
                self.up[k] = root
                return root
            root = up

    def _join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Roots of linked homes take the smaller number until all links are inside one tree."""
        while len(x):
            x, y = self._root(x), self._root(y)
            differ = x != y
            x, y = np.minimum(x[differ], y[differ]), np.maximum(x[differ], y[differ])
            np.minimum.at(self.up, y, x)

    def visit(self, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Visitors -> those with links: node, weight of their links, a linked home's node. Homes linked by a visitor are joined."""
        order = np.argsort(rows["angle"], kind="stable")
        rows = {k: v[order] for k, v in rows.items()}
        total, to = np.zeros(len(order), np.int64), np.full(len(order), -1, np.int64)
        for lo in range(0, len(order), BLOCK):
            block = self._slice(rows, lo, lo + BLOCK)
            for x, y in self._pairs(block):
                if not len(x):
                    continue
                np.add.at(total, x + lo, self.home["weight"][y])
                np.add.at(self.weight, y, block["weight"][x])
                first = np.full(len(block["angle"]), -1, np.int64)
                first[x[::-1]] = y[::-1]
                seen = to[lo : lo + BLOCK]
                self._join(seen[(first >= 0) & (seen >= 0)], first[(first >= 0) & (seen >= 0)])
                self._join(first[x], y)
                seen[(seen < 0) & (first >= 0)] = first[(seen < 0) & (first >= 0)]
        some = to >= 0
        return rows["node"][some], total[some], self.home["node"][to[some]]

    def ends(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Homes with links or another home above them: node, weight, the node of their root."""
        root = self._root(np.arange(len(self.up)))
        some = (self.weight > 0) | (root != np.arange(len(root)))
        return self.home["node"][some], self.weight[some], self.home["node"][root[some]]


_JOINED = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("linked", pa.int64())])


def _join_parts(width: int, radius: float, cosine: float):
    """Rows sorted by part, homes first -> (node, weight of links, a linked node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, part = None, [], None

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array(f) for f in found], schema=_JOINED)

        def built() -> Part:
            return Part({k: np.concatenate([w[k] for w in waiting]) for k in waiting[0]}, radius, cosine)

        for b in batches:
            at, visitor = b.column("part").to_numpy(), b.column("visitor").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (visitor[1:] != visitor[:-1])]))[: len(b)]
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(b)], strict=True):
                rows = _read(b.slice(lo, hi - lo), width)
                if at[lo] != number:
                    if number is not None:
                        yield out((part or built()).ends())
                    number, waiting, part = at[lo], [], None
                if not visitor[lo]:
                    waiting.append(rows)
                    continue
                part = part or built()
                yield out(part.visit(rows))
        if number is not None:
            yield out((part or built()).ends())

    return run


def _read(b: pa.RecordBatch, width: int) -> dict[str, np.ndarray]:
    unit = _unit(_rows_of(b.column("vector"), width)[0])
    rows = {k: b.column(k).to_numpy(zero_copy_only=False) for k in ("node", "weight", "length", "core", "angle")}
    return {**rows, "unit": unit, "short": unit.astype(np.float32)}


def _cores(dealt: DataFrame, cells: Cells) -> tuple[DataFrame, DataFrame]:
    """Links inside cores, where all are linked with all: (node, links), and (a, b) that join the parts of a core."""
    spark = dealt.sparkSession
    of = [(first + k, first) for first, n, core in zip(cells.first.tolist(), cells.parts.tolist(), cells.core.tolist(), strict=True) if core for k in range(n)]
    parts = spark.createDataFrame(of, "_part int, _core int")  # what the driver knows of the cells
    here = dealt.where("core").select("node", "weight", F.col("parts")[0].alias("part"))
    each = kept_table(here.groupBy("part").agg(F.sum("weight").alias("here"), F.min("node").alias("a")).join(parts, F.col("part") == F.col("_part")), "core-parts")
    whole = each.groupBy(F.col("_core").alias("_c")).agg(F.sum("here").alias("all"), F.min("a").alias("b"))
    each = kept_table(each.join(whole, F.col("_core") == F.col("_c")).select("_part", "a", "b", "all"), "cores")
    links = here.join(each.select("_part", "all"), F.col("part") == F.col("_part")).select("node", (F.col("all") - F.col("weight")).alias("links"))
    return links, each.where("a <> b").select("a", "b")


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, members: int = MEMBERS, sample: int = SAMPLE, pivots: int = PIVOTS
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    ``n_links`` counts the other rows whose vector has a cosine of at least ``cosine``
    (above 0) with the row's, ``component_id`` is the smallest id reachable by links,
    ``kept`` whether that is the row's own. Null, empty and zero vectors and those with
    a null or non-finite component link with nothing, and so do vectors of different
    length. Null ids are never smallest: a component of such rows alone has a null id
    and keeps them. Rows that repeat an id are vectors of their own, and all are kept if
    the id is. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    bounded(spark)
    element = vectors.schema[vector_col].dataType.elementType
    kind = element.simpleString() if element.simpleString() in ("float", "double") else "double"
    v = F.col(vector_col).cast(f"array<{kind}>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(finite, v).alias("vector"))
    rows = kept_table(rows.withColumn("ok", F.col("vector").isNotNull()), "vectors")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    classes = rows.where("ok").groupBy("vector").agg(F.count("*").alias("weight"), F.min("vec_id").alias("low"))
    # The node number is fixed by writing it.
    classes = kept_table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    size = classes.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    if not size["n"]:
        return alone
    width, radius = size["width"], math.acos(cosine)
    first = classes.orderBy(F.xxhash64("node")).limit(sample).select("vector").toArrow()["vector"].combine_chunks()  # ``sample`` rows
    raw, lengths = _rows_of(first, width)
    own = choose_pivots(raw, lengths, size["n"], radius, members, pivots)
    unit = _unit(raw[own])
    sent = spark.sparkContext.broadcast((unit, lengths[own], radius))
    schema = "kind long, size long, low binary, high binary"
    found = classes.select("vector").mapInArrow(lean(_ranges(sent, width)), schema).groupBy("kind").applyInArrow(lean_group(_merged), schema)
    found = sorted(found.collect(), key=lambda r: r["kind"])  # two rows a pivot at most
    low, high = (np.stack([np.frombuffer(r[c]) for r in found]) for c in ("low", "high"))
    cells = _cells(unit, lengths[own], radius, np.array([r["kind"] for r in found]), np.array([r["size"] for r in found]), low, high, members)

    dealt = kept_table(classes.select("node", "weight", "vector").mapInArrow(lean(_deal(send(spark, cells), width)), _DEALT.format(kind)), "dealt")
    each = dealt.select("node", "weight", "vector", "length", "core", F.posexplode(F.arrays_zip("parts", "angles")).alias("stop", "at"))
    each = each.select("node", "weight", "vector", "length", "core", F.col("at.parts").alias("part"), F.col("at.angles").alias("angle"), (F.col("stop") > 0).alias("visitor"))
    ordered = each.repartitionById(int(cells.parts.sum()), "part").sortWithinPartitions("part", "visitor", "angle")
    joined = kept_table(ordered.mapInArrow(lean(_join_parts(width, radius, cosine)), "node long, links long, linked long"), "joined")
    core_links, core_edges = _cores(dealt, cells)

    links = union_all([joined.select("node", "links"), core_links]).groupBy("node").agg(F.sum("links").alias("links"))
    edges = kept_table(union_all([joined.where("node <> linked").select(F.col("node").alias("a"), F.col("linked").alias("b")), core_edges]), "edges")
    placed = classes.select("node", "vector", "weight", "low")
    comp = components(edges) if not edges.isEmpty() else spark.createDataFrame([], "node long, comp long")
    placed = placed.join(comp.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").drop("_n").withColumn("comp", F.coalesce("comp", "node"))
    placed = placed.join(links.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").drop("_n")
    least = placed.groupBy(F.col("comp").alias("_c")).agg(F.min("low").alias("least"))
    placed = placed.join(least, F.col("comp") == F.col("_c")).select(F.col("vector").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.col("least").alias("component_id"))
    placed = kept_table(placed, "placed")
    out = rows.where("ok").join(placed, F.col("vector") == F.col("_v"))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")).unionByName(alone)
