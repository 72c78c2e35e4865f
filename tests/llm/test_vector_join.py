import math

import numpy as np
import pytest

from pairwright.llm import vector_join as vj


def valid(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, cosine=0.9):
    n = len(rows)
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if valid(v) else None for _, v in rows]
    up, links = list(range(n)), [0] * n

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return sorted((str(d), links[i], str(low.get(root(i))), low.get(root(i)) == d) for i, (d, _) in enumerate(rows))


def result(df):
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in df.collect())


def clusters(seed, n=420, dim=12, spread=(0.02, 0.1, 0.2, 0.35)):
    """Lone vectors, tight and loose clusters, chains, exact copies, and other scales of the same direction."""
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=dim) for _ in range(n // 3)]
    for k in range(6):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        out += [centre + rng.normal(size=dim) * spread[k % len(spread)] / math.sqrt(dim) for _ in range(int(rng.integers(5, n // 6)))]
    chain = rng.normal(size=dim)
    for _ in range(30):
        chain = chain / np.linalg.norm(chain) + rng.normal(size=dim) * 0.35 / math.sqrt(dim)
        out.append(chain)
    out += [out[0]] * 12 + [out[1] * 4.0] + [out[-1]] * 3
    order = rng.permutation(len(out))
    return [(int(k), [float(np.float32(x)) for x in out[i]]) for k, i in enumerate(order)]


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


@pytest.mark.parametrize("seed, members, pivots", [(1, 4096, 256), (2, 40, 256), (3, 16, 8), (4, 64, 1), (5, 300, 64)])
def test_against_brute_force(spark, seed, members, pivots):
    rows = clusters(seed)
    assert result(vj.near_vectors(frame(spark, rows).repartition(5), members=members, pivots=pivots)) == brute(rows)


@pytest.mark.parametrize("cosine", [0.5, 0.99, 1.0])
def test_other_thresholds(spark, cosine):
    rows = [(k, v) for k, v in clusters(7, 240)]
    if cosine == 1.0:  # copies have a cosine of 1 only as far as doubles tell
        rows = [(k, [float(x) for x in np.eye(12)[k % 12]]) for k in range(30)]
    assert result(vj.near_vectors(frame(spark, rows, "double"), cosine=cosine, members=50)) == brute(rows, cosine)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 0.0, 0.0]
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, nan, 0.0]), (5, [inf, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, one), (8, one), (8, one), (9, [1.0, 0.0]),
        (10, [1.0, 0.0, 0.0, 0.0]), (11, [2.0, 0.0]), (None, one), (None, None), (None, [0.0, 1.0, 0.0]), (None, [0.0, 2.0, 0.0]), (12, [1e30, 1e30, 0.0]), (13, [1e-30, 1e-30, 0.0]),
        (14, [-0.0, 0.0, 5.0]), (15, [0.0, 0.0, 5.0]), (16, [0.0, -0.0, 4.0]),
    ]
    assert result(vj.near_vectors(frame(spark, rows, "double"))) == brute(rows)
    assert result(vj.near_vectors(frame(spark, rows * 3, "double"), members=2)) == brute(rows * 3)


def test_other_columns_are_not_looked_at(spark):
    from pyspark.sql import functions as F

    rows = clusters(9, 60)
    df = frame(spark, rows)
    for name in ("node", "vector", "weight", "low", "part", "ok", "a.b", "Links", "_v"):
        df = df.withColumn(name, F.lit("x"))
    assert result(vj.near_vectors(df)) == brute(rows)


def test_empty_and_nothing_but_nulls(spark):
    assert result(vj.near_vectors(frame(spark, []))) == []
    assert result(vj.near_vectors(frame(spark, [(1, None), (2, None)]))) == brute([(1, None), (2, None)])


def test_a_third_of_all_rows_near_one_vector(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=32)
    hot = centre / np.linalg.norm(centre) + rng.normal(size=(700, 32)) * 0.02
    rows = [(k, v.astype(np.float32).tolist()) for k, v in enumerate(np.concatenate([rng.normal(size=(1400, 32)), hot]))]
    got = vj.near_vectors(frame(spark, rows), members=128)
    want = {}
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    for r in got.collect():
        want[r["vec_id"]] = r["n_links"]
    assert [want[k] for k in range(len(rows))] == links.tolist()
    assert sorted(r["vec_id"] for r in got.where("kept").collect()) == list(range(1401))


def test_pivots_save_work_in_clusters_and_cores_take_no_comparison():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    raw = np.concatenate([c / np.linalg.norm(c) + rng.normal(size=(50, 24)) * 0.01 for c in centres])
    lengths = np.full(len(raw), 24)
    radius = math.acos(0.9)
    own = vj.choose_pivots(raw, lengths, 200_000, radius)
    assert len(own) > 20
    unit = vj._unit(raw)
    angles = vj._angles(unit, unit[own])
    kind, size, low, high = vj._tables(angles, lengths, lengths[own], radius)
    cells = vj._cells(unit[own], lengths[own], radius, kind, size, low, high, 4096)
    cell, core = vj._homes(angles, lengths, lengths[own], radius)
    home = np.searchsorted(kind, 2 * cell + core)
    vector, _ = cells.visits(angles, home, cells.first[home])
    assert len(vector) < 0.5 * len(raw)


def test_bounds_lose_no_link():
    """Every linked pair lives in one part, or one of the two visits the other's."""
    for seed in range(4):
        raw = np.array([v for _, v in clusters(seed, 300)])
        lengths = np.full(len(raw), raw.shape[1])
        unit, radius = vj._unit(raw), math.acos(0.9)
        for n in (1, 5, 40):
            own = vj._densest_first(unit, radius)[:n]
            angles = vj._angles(unit, unit[own])
            kind, size, low, high = vj._tables(angles, lengths, lengths[own], radius)
            cells = vj._cells(unit[own], lengths[own], radius, kind, size, low, high, 30)
            cell, core = vj._homes(angles, lengths, lengths[own], radius)
            home = np.searchsorted(kind, 2 * cell + core)
            part = cells.first[home] + np.arange(len(home)) % cells.parts[home]
            visits = set(zip(*(x.tolist() for x in cells.visits(angles, home, part)), strict=True))
            for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.9, 1)), strict=True):
                met = (part[i] == part[j]) + ((i, part[j]) in visits) + ((j, part[i]) in visits)
                assert met == 1 or (home[i] == home[j] and core[i])
