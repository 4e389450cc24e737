from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cpgspark.llm import hard_negatives as hn

VECTORS = "vec_id long, embedding array<double>, label long, block string, q string, key string, slice string"


def brute(rows, asks, k=hn.K):
    """Every anchor against every row, in whole numbers."""
    held = [
        (i, y, [math.floor(256 * x) for x in v])
        for i, v, y in rows
        if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    out = []
    for i, y, q in held:
        if i % asks:
            continue
        mine = sorted(((-dot(q, w), j) for j, z, w in held if z == y and j != i))[:k]
        for minus, positive in mine:
            ps = -minus
            other = [(-dot(q, w), j) for j, z, w in held if z != y]
            other = sorted(x for x in other if 80 * ps <= -100 * x[0] <= 100 * ps)[:k]
            out += [(i, positive, n, j, ps, -s) for n, (s, j) in enumerate(other, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "b", "q", "k", "s") for r in rows], VECTORS)


def clusters(n, seed=0, dims=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dims)) * 2
    return [
        (i, (centres[i % 8] + 0.3 * rng.normal(size=dims)).tolist(), int(rng.integers(0, 4))) for i in range(n)
    ]


def check(spark, rows, asks, **more):
    found = hn.mine(frame(spark, rows), F.col("vec_id") % asks == 0, **more).collect()
    assert sorted(map(tuple, found)) == brute(rows, asks)
    return found


def test_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "SLICE", 8)
    monkeypatch.setattr(hn, "ZONES", 4)
    assert check(spark, clusters(600), 20, block=32)


def test_odd_vectors(spark):
    rows = clusters(60, 3, 4)
    rows += [(100, None, 1), (101, [1.0, None, 0.0, 0.0], 1), (102, [math.nan] * 4, 1), (103, [1.0] * 4, None)]
    rows += [(None, [1.0] * 4, 1), (104, [math.inf] * 4, 2), (105, [0.0] * 4, 1), (106, [2.0, 1.0], 2), (107, [], 3)]
    rows += [(200, [1e5, -1e5, 3e4, 1.0], 0), (201, [1e5, -1e5, 2e4, 9.0], 1), (202, [1e5, -1e5, 3e4, 1.0], 0)]
    rows += [rows[0], rows[5], rows[7], (300, [1.0] * 4, 77)]
    assert check(spark, rows, 10, block=16)
    assert hn.mine(frame(spark, rows).limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_hold_and_prune(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, a = rng.integers(-256, 256, (50, 9)), rng.integers(-256, 256, (7, 9))
    least, most = hn.bounds(a, x.min(0)[None], x.max(0)[None])
    scores = a @ x.T
    assert (least[:, 0] <= scores.min(1)).all() and (most[:, 0] >= scores.max(1)).all()
    rows = clusters(800, 5)
    marked = hn.with_hilbert_key(hn.scaled(frame(spark, rows), "vec_id", "embedding", F.col("label")))
    placed = marked.orderBy("label", "key").toPandas()
    # Neighbours on the curve inside a label mostly belong to one cluster.
    same = (placed.vec_id % 8).to_numpy()
    assert (same[1:] == same[:-1]).mean() > 0.8


@pytest.mark.parametrize("dims", [2, 3])
def test_hilbert_curve_visits_neighbours(dims):
    bits = 3
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    key = hn.hilbert_key(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_products_are_exact_for_large_numbers():
    x = np.array([[3_000_000_019, 7], [1, -2]])
    assert hn.products(x, x).tolist() == [[3_000_000_019**2 + 49, 3_000_000_019 - 14], [3_000_000_019 - 14, 5]]
