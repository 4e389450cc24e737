"""Isotonic fits by ranges against plain pooling, whatever the cut."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from cpgspark.operators import isotonic, train


def plain(rows):
    """Largest-over-starts of least-over-ends means, by the definition."""
    scores = sorted({s for s, _ in rows})
    tally = {s: [sum(t for v, t in rows if v == s), sum(v == s for v, _ in rows)] for s in scores}
    cum = [(0, 0)]
    for s in scores:
        cum.append((cum[-1][0] + tally[s][0], cum[-1][1] + tally[s][1]))

    def mean(a, b):
        return Fraction(cum[b + 1][0] - cum[a][0], cum[b + 1][1] - cum[a][1])

    size = len(scores)
    return {
        s: max(min(mean(a, b) for b in range(i, size)) for a in range(i + 1))
        for i, s in enumerate(scores)
    }


def fitted(spark, rows, per_range):
    df = spark.createDataFrame(rows, "score double, truth int")
    out = isotonic.isotonic_blocks(df, per_range=per_range).collect()
    return sorted((r["low"], r["high"], r["positives"], r["n"]) for r in out)


def expected(rows):
    blocks = {}
    for score, share in plain(rows).items():
        blocks.setdefault(share, []).append(score)
    made = []
    for scores in blocks.values():
        inside = [t for s, t in rows if s in scores]
        made.append((min(scores), max(scores), sum(inside), len(inside)))
    return sorted(made)


@pytest.mark.parametrize("per_range", [1000, 7, 1])
def test_same_blocks_for_every_cut(spark, per_range):
    rng = np.random.default_rng(3)
    scores = np.round(rng.random(150), 2)
    rows = [(float(s), int(rng.random() < s)) for s in scores]
    rows += [(0.5, 1)] * 40 + [(0.51, 0)] * 25  # hot ties in the wrong order
    assert fitted(spark, rows, per_range) == expected(rows)


@pytest.mark.parametrize("per_range", [1000, 2])
def test_sorted_and_reversed_outcomes(spark, per_range):
    up = [(i / 10, int(i > 5)) for i in range(12)]
    down = [(i / 10, int(i < 5)) for i in range(12)]
    assert fitted(spark, up, per_range) == expected(up)
    assert fitted(spark, down, per_range) == [(0.0, 1.1, 5, 12)]


def test_odd_scores(spark):
    nan = float("nan")
    rows = [(None, 1), (nan, 1), (0.2, None), (0.0, 0), (-0.0, 1), (0.3, 1), (float("inf"), 1)]
    assert fitted(spark, rows, 1) == [(0.0, 0.0, 1, 2), (0.3, float("inf"), 2, 2)]
    assert fitted(spark, [], 10) == []


def test_calibration_equals_a_fit_to_all_rows(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        p = float(np.round(rng.random(), 2))
        rows.append((f"s{i}", "b" if rng.random() < p else "a", [1 - p, p]))
    df = spark.createDataFrame(rows, "sample_id string, class string, scores array<double>")
    got = train.calibrate(df, ["a", "b"], "isotonic").maps["b"]
    direct = df.select(
        F.get("scores", F.lit(1)).alias("x"), (F.col("class") == "b").cast("double").alias("y")
    )
    want = IsotonicRegression(featuresCol="x", labelCol="y").fit(direct)
    asked = spark.range(101).select((F.col("id") / 100).alias("x"))
    a = [r[0] for r in got.setFeaturesCol("x").transform(asked).orderBy("x").select("prediction").collect()]
    b = [r[0] for r in want.transform(asked).orderBy("x").select("prediction").collect()]
    assert a == pytest.approx(b)
    assert a == sorted(a)
