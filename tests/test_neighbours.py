"""Nearest donors of missing cells: bounds first, distances of few pairs, results of all."""

from __future__ import annotations

import numpy as np
import pytest

from cpgspark.operators import cohort, neighbours

M = "sample_id string, probe_id string, value double"


def _loops(x, targets, k):
    """Of every gap the k nearest donors, by the plain rule."""
    out = {}
    for t in targets:
        both = ~np.isnan(x) & ~np.isnan(x[t])
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            gap = np.where(both, np.where(both, x, 0) - np.where(np.isnan(x[t]), 0, x[t]), 0.0)
            far = np.sqrt(x.shape[1] / both.sum(1) * (gap * gap).sum(1))
        for p in np.flatnonzero(np.isnan(x[t])):
            can = [d for d in range(len(x)) if d != t and both[d].any() and not np.isnan(x[d, p])]
            out[t, p] = [(far[d], d, x[d, p]) for d in sorted(can, key=lambda d: (far[d], d))[:k]]
    return out


def _rows(kind):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 12))
    if kind == "copies":  # equal rows and equal distances
        x = np.round(x[rng.integers(0, 25, 300)])
    if kind == "far":  # small differences of large numbers
        x = 1e7 + 1e-3 * x
    if kind == "huge":
        x[::7] *= 1e200
    if kind == "tiny":
        x *= 1e-170
    if kind == "mixed":
        x[:, :4] *= 1e6
    share = 0.6 if kind == "sparse" else 0.15
    gaps = rng.random(x.shape) < share
    if kind != "sparse":
        gaps[:, 5:] = False
    x[gaps] = np.nan
    if kind == "sparse":
        x[3:40, 3:] = np.nan  # rows that share nothing with others
        x[40:50, :6] = np.nan
        x[:, 11] = np.nan
        x[60, 11] = 2.0  # one donor
    return x


@pytest.mark.parametrize("kind", ["plain", "copies", "far", "huge", "tiny", "mixed", "sparse"])
@pytest.mark.parametrize("step", [17, 300])
def test_screened_is_all_pairs(monkeypatch, kind, step):
    monkeypatch.setattr(neighbours, "_TARGETS", 16)
    monkeypatch.setattr(neighbours, "_TILE_BYTES", 8 * 12 * 40)
    monkeypatch.setattr(neighbours, "_PAIRS", 500)
    monkeypatch.setattr(neighbours, "_DIFFERENCE_BYTES", 8 * 12 * 70)
    x = _rows(kind)
    targets = np.flatnonzero(np.isnan(x).any(axis=1))[::2]
    state = neighbours.Nearest(x[targets], targets, 3, 12)
    for i in range(0, len(x), step):
        state.meet(x[i : i + step], np.arange(len(x))[i : i + step])
    got = {}
    for t, p, far, d, v in zip(*state.result(), strict=True):
        got.setdefault((targets[t], p), []).append((far, d, v))
    want = {key: rows for key, rows in _loops(x, targets, 3).items() if rows}
    assert got == want


def test_few_pairs_get_their_distance(monkeypatch):
    """The work per pair is a product: distances are worked out for a few hundredths."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12_000, 32))
    x[:, ::4][rng.random((len(x), 8)) < 0.06] = np.nan
    targets = np.flatnonzero(np.isnan(x).any(axis=1))[:600]
    measured = []
    plain = neighbours.distances
    monkeypatch.setattr(
        neighbours, "distances", lambda p, squares, shared: measured.append(len(shared)) or plain(p, squares, shared)
    )
    state = neighbours.Nearest(x[targets], targets, 5, 32)
    state.meet(x, np.arange(len(x)))
    assert 0 < sum(measured) < 0.05 * len(targets) * len(x)


def test_impute_by_many_tasks(spark, monkeypatch):
    """Equal rows from many small tasks and from few; odd cells and unnamed probes as they were."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(90, 6)), 1)
    rows = [(f"s{i:02d}", f"p{j}", float(x[i, j]) if rng.random() > 0.2 else None) for i in range(90) for j in range(6)]
    rows = [r for r in rows if r[2] is not None or rng.random() > 0.5]  # absent rows and null values
    rows += [("odd", "p0", float("nan")), ("odd", "p1", 1.0), ("odd", None, 2.0), (None, "p0", 3.0), (None, "p1", None)]
    m = spark.createDataFrame(rows, M)

    def filled():
        out = cohort.knn_impute(m, m, 2).select("sample_id", "probe_id", "value").collect()
        return sorted((str(a), str(b), str(v)) for a, b, v in out)

    whole = filled()
    assert len(whole) == 91 * 6 + 1 and ("odd", "p0", "nan") in whole and ("odd", "None", "2.0") in whole
    assert not [r for r in whole if r[2] == "None" or r[0] == "None"]
    monkeypatch.setattr(cohort, "_BLOCK_BYTES", 1500)
    monkeypatch.setattr(cohort, "_DONORS", 20)
    assert filled() == whole
    monkeypatch.setattr(cohort, "_RANGE", 2)
    assert [r[:2] for r in filled()] == [r[:2] for r in whole]
