"""Principal components against a full decomposition."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cpgspark.operators import cohort
from cpgspark.operators.components import principal_components
from cpgspark.plans.durable import store


def arrays_of(spark, x):
    rows = [(f"s{i}", [float(v) for v in row]) for i, row in enumerate(x)]
    return store(spark.createDataFrame(rows, "sample_id string, values array<double>"), "arrays")


def full(x, k):
    variances, vectors = np.linalg.eigh(np.atleast_2d(np.cov(x, rowvar=False)))
    return variances[::-1][:k], vectors[:, ::-1][:, :k]


@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_equals_the_full_decomposition(spark, spread):
    """With clear leading directions, and with nearly equal variances throughout."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 300)) * (1 + spread * np.arange(300)[::-1] / 10) + 5
    found = principal_components(arrays_of(spark, x), 300)
    variances, vectors = full(x, 3)
    assert found.variances == pytest.approx(variances, rel=1e-9)
    assert np.abs((vectors * found.directions).sum(axis=0)) == pytest.approx(np.ones(3), abs=1e-6)
    assert found.directions.T @ found.directions == pytest.approx(np.eye(3), abs=1e-9)


def test_few_values_and_few_samples(spark):
    x = np.array([[1.0, 2.0, 0.0], [3.0, 2.0, 1.0], [5.0, 2.0, 7.0], [0.0, 2.0, 1.0]])
    found = principal_components(arrays_of(spark, x), 3)
    assert found.variances == pytest.approx(np.maximum(full(x, 3)[0], 0), abs=1e-9)
    alone = principal_components(arrays_of(spark, x[:1]), 3)
    assert alone.variances.tolist() == [0, 0, 0]
    with pytest.raises(ValueError):
        principal_components(arrays_of(spark, x).limit(0), 3)
    with pytest.raises(ValueError):
        principal_components(arrays_of(spark, x), 3, k=4)


def test_batches_and_spare_samples_do_not_matter(spark, monkeypatch):
    from cpgspark.operators import components

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 40)) * np.linspace(5, 1, 40)
    whole = principal_components(arrays_of(spark, x), 40)
    monkeypatch.setattr(components, "_BATCH_BYTES", 8 * 40 * 3)
    cut = principal_components(arrays_of(spark, x), 40)
    assert cut.directions == pytest.approx(whole.directions, abs=1e-6)


def test_embedding_is_centred_and_uncorrelated(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 6)) * [6, 5, 4, 1, 1, 1] + 3
    rows = [(f"s{i:02d}", f"p{j}", float(x[i, j])) for i in range(50) for j in range(6)]
    m = spark.createDataFrame(rows, "sample_id string, probe_id string, value double")
    names = spark.createDataFrame([(f"p{j}", 1.0) for j in range(6)], "probe_id string, importance double")
    placed, model, features = cohort.embed_cohort(m, names)
    points = np.array([r[:3] for r in placed.select("x", "y", "z").collect()])
    assert points.mean(axis=0) == pytest.approx(np.zeros(3), abs=1e-9)
    assert np.cov(points, rowvar=False) == pytest.approx(np.diag(full(x, 3)[0]), abs=1e-6)
    part = placed.filter(F.col("sample_id") < "s40")
    again = cohort.project_samples(part, m, m.select("sample_id"), model, features)
    a = sorted(map(tuple, placed.select("sample_id", "x").collect()))
    b = sorted(map(tuple, again.select("sample_id", "x").collect()))
    assert [r[0] for r in a] == [r[0] for r in b]
    assert [r[1] for r in a] == pytest.approx([r[1] for r in b])
