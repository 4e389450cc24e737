"""Forests whose nodes stay in files, against plain loops and Spark's own forest."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cpgspark.operators import forests, search, train
from cpgspark.plans.durable import scratch_path


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        c = i % 3
        v = rng.normal(0, 0.6, 6) + 2.0 * (np.arange(6) == c)
        rows.append((f"s{i:03d}", [float(x) for x in v], f"k{c}"))
    rows += rows[:5] + [(None, rows[0][1], "k0")]
    df = spark.createDataFrame(rows, "sample_id string, values array<double>, class string")
    return df.select("sample_id", array_to_vector("values").alias("features"), "class")


def _small(monkeypatch, local):
    monkeypatch.setattr(forests, "DRIVER_NODES", 0)
    monkeypatch.setattr(forests, "_LOCAL_BYTES", local)


NAMES = [f"p{i}" for i in range(6)]


@pytest.mark.parametrize("local", [1 << 26, 6_000])
def test_large_forest_stays_in_files_and_calls_as_sparks(spark, vectors, monkeypatch, local):
    plain = train.train_forest(vectors, NAMES, n_trees=20)
    _small(monkeypatch, local)
    model = train.train_forest(vectors, NAMES, n_trees=20)
    assert isinstance(model.model, forests.FilesModel) and not isinstance(plain.model, forests.FilesModel)
    assert (model.model.nodes.count() > 20) == (local == 6_000)

    def called(m):
        out = m.predict(vectors).select("class", "prediction", "probability", "scores").collect()
        assert len(out) == 246 and all(sum(r["scores"]) == pytest.approx(1) for r in out)
        assert all(r["probability"] == max(r["scores"]) for r in out)
        return np.mean([r["class"] == r["prediction"] for r in out])

    assert called(model) >= 0.97 and called(plain) >= 0.97
    own = train.feature_importance(model, spark).collect()
    assert sum(r["importance"] for r in own) == pytest.approx(1)
    assert {r["probe_id"] for r in sorted(own, key=lambda r: -r["importance"])[:3]} == {"p0", "p1", "p2"}

    folder = scratch_path(spark, "models")
    train.save_model(model, folder, spark)
    back = train.load_model(["ROOT"], folder, spark)
    a, b = (
        sorted((str(r[0]), r[1], r[2]) for r in m.predict(vectors).select("sample_id", "prediction", "probability").collect())
        for m in (model, back)
    )
    assert a == b


def test_searches_use_it(spark, vectors, monkeypatch):
    _small(monkeypatch, 1 << 26)
    best, table = train.grid_search(vectors, NAMES, n_trees=(5, 8), max_depth=(4,), k=2, score="roc_auc")
    assert isinstance(best.model, forests.FilesModel) and best.classes == ["k0", "k1", "k2"]
    assert [r["mean_test_score"] > 0.9 for r in table.collect()] == [True, True]
    some = search.Settings(n_trees=8, scale=True, balanced=False)
    scaled = search.fit(vectors, NAMES, some)
    right = scaled.predict(vectors).where(F.col("class") == F.col("prediction")).count()
    assert right >= 235


@pytest.mark.parametrize("impurity", ["gini", "entropy"])
@pytest.mark.parametrize("min_rows", [1, 4])
def test_subtree_against_loops(impurity, min_rows):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 5, (60, 3)).astype(np.uint8)
    y = rng.integers(0, 3, 60)
    n = rng.integers(1, 4, 60)
    weights = np.array([1.0, 2.0, 0.5])

    def impure(rows):
        p = np.bincount(y[rows], weights=n[rows], minlength=3) * weights
        total, p = p.sum(), p / p.sum()
        return total, 1 - (p**2).sum() if impurity == "gini" else -sum(q * np.log2(q) for q in p if q > 0)

    def loop(rows, depth):
        totals = np.bincount(y[rows], weights=n[rows], minlength=3) * weights
        best = (1e-9, None)
        whole, own = impure(rows)
        for f, b in itertools.product(range(3), range(5)):
            low, high = rows[x[rows, f] <= b], rows[x[rows, f] > b]
            if min(n[low].sum(), n[high].sum()) < min_rows:
                continue
            (a, i), (c, j) = impure(low), impure(high)
            gain = whole * own - a * i - c * j
            if gain > best[0] + 1e-9:
                best = (gain, (f, b, low, high))
        if best[1] is None or depth == 0:
            return {int(r): totals / totals.sum() for r in rows}, int(totals.argmax()), True
        f, b, low, high = best[1]
        (m, cm, lm), (k, ck, lk) = loop(low, depth - 1), loop(high, depth - 1)
        if lm and lk and cm == ck:
            return {int(r): totals / totals.sum() for r in rows}, int(totals.argmax()), True
        return {**m, **k}, -1, False

    wanted = loop(np.arange(60), 4)[0]
    feature, cut, left, shares, _ = forests.grow_subtree(
        x, y, n, 4, (weights, 3, impurity, min_rows), np.random.default_rng(0)
    )
    ends = -1 - left[forests._walk(x, feature, cut, left)]
    for r in range(60):
        assert shares[ends[r]] == pytest.approx(wanted[r])


def _nodes(model):
    rows = model.nodes.orderBy("tree", "unit").collect()
    return [tuple(bytes(r[c]) if c in ("feature", "cut", "left", "dist") else r[c] for c in r.asDict()) for r in rows]


def test_search_grows_shared_trees_once(spark, vectors, monkeypatch):
    """A forest of fewer trees is the first trees of the larger one: grown once, equal to its own."""
    _small(monkeypatch, 6_000)
    alone = train.train_forest(vectors, NAMES, n_trees=5).model
    indexer, _ = train._indexed(vectors)
    rows = indexer.transform(train.class_weights(vectors))
    estimator = train.forest(5, train.MAX_DEPTH, train.SEED)
    grown = []
    plain = forests.Forest._grow
    monkeypatch.setattr(
        forests.Forest, "_grow", lambda self, df: grown.append(self.getNumTrees()) or plain(self, df)
    )
    maps = [{estimator.numTrees: n, estimator.impurity: i} for i in ("gini", "entropy") for n in (5, 8)]
    models = dict(estimator.fitMultiple(rows, maps))
    assert sorted(grown) == [8, 8]
    assert [len(models[i].trees) for i in range(4)] == [5, 8, 5, 8]
    assert _nodes(models[0]) == _nodes(alone) and (models[0].upper == alone.upper).all()
    assert _nodes(models[0]) == [r for r in _nodes(models[1]) if r[0] < 5]
    assert _nodes(models[0]) != _nodes(models[2])
    called = [models[0].transform(rows), alone.transform(rows)]
    a, b = (sorted(map(str, c.select("sample_id", "probability").collect())) for c in called)
    assert a == b
