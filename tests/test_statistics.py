from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cpgspark.functions import tails
from cpgspark.operators import dm, vectors


@pytest.mark.parametrize(
    ("t", "df", "p"),
    [(2.228139, 10, 0.05), (12.706205, 1, 0.05), (1.959964, math.inf, 0.05), (0.0, 5, 1.0),
     (2.750000, 30, 0.01), (-4.302653, 2, 0.05), (1.959966, 1e6, 0.05)],
)
def test_t_tail_matches_tables(t, df, p):
    assert tails.t_two_sided(np.array([t]), np.array([df]))[0] == pytest.approx(p, abs=2e-6)


def test_t_tail_unknown_is_unknown():
    out = tails.t_two_sided(np.array([np.nan, 1.0, 1.0]), np.array([3.0, 0.0, np.nan]))
    assert np.isnan(out).all()


def test_digamma_and_trigamma():
    assert float(tails.digamma(1.0)) == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert float(tails.trigamma(1.0)) == pytest.approx(math.pi**2 / 6, abs=1e-12)
    assert tails.inverse_trigamma(float(tails.trigamma(3.7))) == pytest.approx(3.7, rel=1e-9)


@settings(max_examples=30, deadline=None)
@given(st.floats(0.01, 50), st.floats(0.5, 200))
def test_beta_symmetry(a, b):
    x = np.array([0.3])
    left = tails.incomplete_beta(np.array([a]), np.array([b]), x)[0]
    right = tails.incomplete_beta(np.array([b]), np.array([a]), 1 - x)[0]
    assert left + right == pytest.approx(1.0, abs=1e-9)


def _table(spark, offset=0.0, seed=1):
    """Three classes, one of them with two samples; gaps as nulls and as lost rows."""
    rng = np.random.default_rng(seed)
    sizes = {"a": 7, "b": 9, "tiny": 2}
    names = [c for c, n in sizes.items() for _ in range(n)]
    rows = []
    for i, cls in enumerate(names):
        for p in range(6):
            v = float(rng.normal(offset + (p == 1) * (cls == "a"), 1.0))
            if p == 5:
                v = 3.0
            if p == 2 and i % 4 == 0:
                v = None
            if p == 3 and i % 5 == 0:
                continue
            rows.append((f"s{i}", f"p{p}", v, cls))
    return spark.createDataFrame(rows, "sample_id string, probe_id string, value double, class string"), rows


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_class_stats_against_numpy(spark, offset):
    df, rows = _table(spark, offset)
    got = {(r["probe_id"], r["class"]): r for r in dm.dm_class_stats(df).collect()}
    assert {c for _, c in got} == {"a", "b"}
    for (probe, cls), r in got.items():
        a = np.array([v for _, p, v, c in rows if p == probe and c == cls and v is not None])
        b = np.array([v for _, p, v, c in rows if p == probe and c != cls and v is not None])
        va, vb = a.var(ddof=1), b.var(ddof=1)
        if probe == "p5":
            assert r["effect_size"] == 0.0 and r["t"] is None
            continue
        t = (a.mean() - b.mean()) / math.sqrt(va / len(a) + vb / len(b))
        assert r["t"] == pytest.approx(t, rel=1e-6)
        d = (a.mean() - b.mean()) / math.sqrt((va + vb) / 2)
        assert r["effect_size"] == pytest.approx(d, rel=1e-6)


def _bh(p):
    p = np.asarray(p)
    order = np.argsort(p, kind="stable")
    raw = p[order] * len(p) / np.arange(1, len(p) + 1)
    q = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1)
    out = np.empty_like(q)
    out[order] = q
    return out


@pytest.mark.parametrize("grouped", [False, True])
def test_large_bh_equals_direct(spark, grouped):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(3000) ** 3, 3)  # many ties
    g = np.where(rng.random(3000) < 0.9, "hot", "cold")
    rows = [(i, str(g[i]), float(p[i])) for i in range(3000)] + [(9999, "hot", None)]
    df = spark.createDataFrame(rows, "id int, g string, p_value double")
    out = dm.bh_fdr_large(df, ["g"] if grouped else [])
    got = {r["id"]: r["q_value"] for r in out.collect()}
    assert len(got) == 3000
    for part in (["hot", "cold"] if grouped else [None]):
        pick = [i for i in range(3000) if part is None or g[i] == part]
        want = _bh(p[pick])
        assert np.allclose([got[i] for i in pick], want)
        assert all(got[i] >= p[i] - 1e-12 for i in pick)


def test_best_class_breaks_ties_by_given_order(spark):
    rows = [("p", "x", 0.02, 1.0), ("p", "y", 0.01, 2.0), ("p", "z", None, 3.0)]
    df = spark.createDataFrame(rows, "probe_id string, class string, p_value double, effect_size double")
    # q of both is 0.02: the reverse minimum makes the tie.
    assert dm.dm_best_class(df, ["x", "y"]).first()["best_class"] == "x"
    assert dm.dm_best_class(df, ["y", "x"]).first()["best_class"] == "y"


def test_moderated_against_numpy(spark):
    rng = np.random.default_rng(5)
    n, probes = 24, 60
    cls = ["a"] * 10 + ["b"] * 14
    x = rng.normal(size=(probes, n)) * rng.gamma(2, 0.5, size=(probes, 1))
    rows = [(f"s{j}", f"p{i:02d}", float(x[i, j]), cls[j]) for i in range(probes) for j in range(n)]
    df = spark.createDataFrame(rows, "sample_id string, probe_id string, value double, class string")
    a, b = x[:, :10], x[:, 10:]
    m2 = ((a - a.mean(1, keepdims=True)) ** 2).sum(1) + ((b - b.mean(1, keepdims=True)) ** 2).sum(1)
    d = n - 2
    s2 = m2 / d
    e = np.log(s2) - float(tails.digamma(d / 2)) + math.log(d / 2)
    d0 = 2 * tails.inverse_trigamma(e.var(ddof=1) - float(tails.trigamma(d / 2)))
    s0 = math.exp(e.mean() + float(tails.digamma(d0 / 2)) - math.log(d0 / 2))
    post = (d0 * s0 + d * s2) / (d0 + d)
    t = (a.mean(1) - b.mean(1)) / np.sqrt(post * (1 / 10 + 1 / 14))
    got = {r["probe_id"]: r for r in dm.moderated_stats(df, robust=False).filter("class = 'a'").collect()}
    for i in range(probes):
        assert got[f"p{i:02d}"]["t_mod"] == pytest.approx(t[i], rel=1e-8)
        assert got[f"p{i:02d}"]["df_total"] == pytest.approx(d0 + d, rel=1e-8)
    top = {r["probe_id"] for r in dm.moderated_dm(df, 5).collect()}
    assert top == {f"p{i:02d}" for i in np.argsort(-np.abs(t))[:5]}


def test_anova_two_classes_is_t_squared(spark):
    df, rows = _table(spark)
    two = df.filter("class <> 'tiny' AND probe_id = 'p0'")
    a = np.array([v for _, p, v, c in rows if p == "p0" and c == "a"])
    b = np.array([v for _, p, v, c in rows if p == "p0" and c == "b"])
    pooled = (a.var() * len(a) + b.var() * len(b)) / (len(a) + len(b) - 2)
    t = (a.mean() - b.mean()) / math.sqrt(pooled * (1 / len(a) + 1 / len(b)))
    assert dm.anova_f(two).first()["f_score"] == pytest.approx(t * t, rel=1e-9)


def test_anova_zero_fill_counts_lost_rows(spark):
    df, _ = _table(spark)
    ids = df.select("sample_id", "class").distinct()
    full = ids.crossJoin(df.select("probe_id").distinct())
    dense = full.join(df.drop("class"), ["sample_id", "probe_id"], "left").fillna(0.0, ["value"])
    left = {r["probe_id"]: r for r in dm.anova_f(df, zero_fill=True).collect()}
    right = {r["probe_id"]: r for r in dm.anova_f(dense).collect()}
    for probe, r in right.items():
        assert left[probe]["df_within"] == r["df_within"]
        if r["f_score"] is not None:
            assert left[probe]["f_score"] == pytest.approx(r["f_score"], rel=1e-9)


def test_precomputed_select_without_p(spark):
    stats = spark.createDataFrame([("a", 0.1)], "feature string, best_p double")
    chosen = spark.createDataFrame([("b",), ("c",)], "feature string")
    have = spark.createDataFrame([("c",), ("d",)], "probe_id string")
    assert [r["probe_id"] for r in dm.precomputed_select(stats, chosen, have).collect()] == ["c"]
    wide = spark.createDataFrame([("s", 1.0, 2.0)], "sample_id string, c double, d double")
    assert {r["probe_id"] for r in dm.precomputed_select(None, wide, have).collect()} == {"c", "d"}


def test_scaling_of_a_constant_probe(spark):
    df = spark.createDataFrame([("a", "p", 2.0), ("b", "p", 2.0)], "sample_id string, probe_id string, value double")
    assert {r["value"] for r in vectors.standard_scale(df).collect()} == {0.0}


def test_sample_arrays_fill_gaps_in_order(spark):
    rows = [("s", "b", 2.0), ("s", "d", None), ("s", "e", float("inf")), ("t", "a", 1.0), ("u", "c", None)]
    df = spark.createDataFrame(rows, "sample_id string, probe_id string, value double")
    got = {r["sample_id"]: list(r["values"]) for r in vectors.sample_arrays(df, list("abcde")).collect()}
    assert got == {"s": [0, 2, 0, 0, 0], "t": [1, 0, 0, 0, 0], "u": [0] * 5}


def test_sample_arrays_sort_without_a_comparison_per_cell(spark):
    """Values come in two plain lists; only a gap costs a lambda, and places that repeat stay."""
    rows = [("s", "b", 2.0), ("s", "a", 5.0), ("s", "b", 1.0), ("t", "c", 3.0), ("t", "x", 4.0)]
    df = spark.createDataFrame(rows, "sample_id string, probe_id string, value double")
    out = vectors.sample_arrays(df, list("abc"), fill=-1.0)
    assert {r["sample_id"]: list(r["values"]) for r in out.collect()} == {"s": [5, 1, 2, -1], "t": [-1, -1, 3]}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and "flatten" not in plan
    pairs = [line for line in plan.splitlines() if "collect_list" in line and "struct(" in line]
    assert not [line for line in pairs if "Aggregate" in line]


def test_a_model_of_all_stored_probes_looks_none_up(spark):
    df = spark.createDataFrame([("s", [1.0, 2.0, 3.0]), ("t", [4.0, 5.0, 6.0, 7.0])], "sample_id string, values array<double>")
    whole, part = (vectors.pick(df, list("abc"), some) for some in (list("abc"), ["c", "a"]))
    assert {r["sample_id"]: list(r["features"]) for r in whole.collect()} == {"s": [1, 2, 3], "t": [4, 5, 6]}
    assert {r["sample_id"]: list(r["features"]) for r in part.collect()} == {"s": [3, 1], "t": [6, 4]}
    assert "lambda" not in whole._jdf.queryExecution().optimizedPlan().toString()


def test_class_weights_balance(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "class string")
    got = {r["class"]: r["weight"] for r in vectors.class_weights(df).distinct().collect()}
    assert got == {"a": pytest.approx(4 / 6), "b": pytest.approx(2.0)}


def test_class_weights_of_known_counts(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "class string")
    got, want = (
        {r["class"]: r["weight"] for r in vectors.class_weights(df, counted=n).collect()}
        for n in ({"a": 3, "b": 1}, None)
    )
    assert got == want


def test_udf_runs_once_when_filtered(spark):
    df, _ = _table(spark)
    plan = dm.welch_p(dm.dm_class_stats(df)).filter(F.col("p_value") < 0.5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1


def test_winsorised_moments_without_tails_are_the_plain_ones():
    mean, var = tails.winsorised_log_ratio(8.0, 12.0, (0.0, 0.0))
    assert mean == pytest.approx(float(tails.digamma(4) - tails.digamma(6)) - math.log(8 / 12), abs=1e-4)
    assert var == pytest.approx(float(tails.trigamma(4) + tails.trigamma(6)), rel=1e-3)


def test_robust_prior_resists_wild_probes(spark):
    rng = np.random.default_rng(9)
    n, probes, d0, s0 = 20, 400, 10.0, 2.0
    var = d0 * s0 / rng.chisquare(d0, probes)
    x = rng.normal(size=(probes, n)) * np.sqrt(var)[:, None]

    def rows(data):
        cells = [(f"s{j}", f"p{i}", float(data[i, j]), "a" if j < 9 else "b") for i in range(probes) for j in range(n)]
        return spark.createDataFrame(cells, "sample_id string, probe_id string, value double, class string")

    wild = x.copy()
    wild[:16] *= 30.0  # four probes in a hundred
    def df_total(df, robust):
        return dm.moderated_stats(df, robust).filter("class = 'a'").first()["df_total"] - (n - 2)

    clean, spoilt, held = df_total(rows(x), False), df_total(rows(wild), False), df_total(rows(wild), True)
    assert spoilt < clean / 3
    assert clean / 2 < held < clean * 2


def _own_priors(s2, df, d0, s02, pooled):
    """Degrees of freedom of each probe by plain loops over the sorted probes."""
    tail = tails.f_upper(s2 / s02, df, d0)
    share = np.array([(np.sum(tail < v) + np.sum(tail == v) / 2) / len(tail) for v in tail])
    weight = np.minimum(tail / share, 1)
    low = dm._median_df((s2 / s02)[np.argmin(tail)], df, d0)
    own = np.where(weight < 1, weight * pooled if np.isinf(d0) else weight * d0 + (1 - weight) * low, d0)
    order = np.argsort(tail, kind="stable")
    sorted_own = own[order]
    means = np.cumsum(sorted_own) / np.arange(1, len(own) + 1)
    cut = int(np.argmin(means))
    sorted_own[: cut + 1] = means[cut]
    own[order] = np.maximum.accumulate(sorted_own)
    return own


@pytest.mark.parametrize("d0", [8.0, math.inf])
def test_outliers_get_a_looser_prior(spark, d0):
    rng = np.random.default_rng(21)
    probes, df, s02 = 300, 12.0, 1.5
    prior = np.ones(probes) if np.isinf(d0) else d0 / rng.chisquare(d0, probes)
    s2 = s02 * prior * rng.chisquare(df, probes) / df
    s2[:6] *= [1e4, 900, 80, 1, 1, 1]
    s2[10] = s2[11]  # a tie
    rows = [(f"p{i}", c, df, float(s2[i])) for i in range(probes) for c in "ab"]
    rows.append(("none", "a", df, math.nan))
    cells = spark.createDataFrame(rows, "probe_id string, class string, df double, s2 double")
    given = [(c, float(d0), s02, probes * df) for c in "ab"]
    prior = spark.createDataFrame(given, "class string, d0 double, s02 double, df_pooled double")
    got = {(r["probe_id"], r["class"]): r["d0"] for r in dm.outlier_priors(cells, prior).collect()}
    assert len(got) == 2 * probes
    want = _own_priors(s2, df, d0, s02, probes * df)
    for c in "ab":
        have = np.array([got[(f"p{i}", c)] for i in range(probes)])
        assert np.allclose(have, want, rtol=1e-9)
    by_variance = have[np.argsort(s2)]
    assert (np.diff(by_variance[np.isfinite(by_variance)]) <= 1e-9).all()
    assert have[0] < 2 and have[np.argsort(s2)[:50]].min() == d0


def test_median_df():
    d = dm._median_df(50.0, 10.0, 20.0)
    assert float(tails.f_upper(50.0, 10.0, d)) == pytest.approx(0.5, abs=1e-6)
    assert dm._median_df(0.2, 10.0, 20.0) == 20.0


def test_a_wild_probe_is_held_back(spark):
    """A probe of huge variance loses degrees of freedom; the others keep theirs."""
    rng = np.random.default_rng(13)
    n, probes = 20, 300
    x = rng.normal(size=(probes, n)) * np.sqrt(10 / rng.chisquare(10, probes))[:, None]
    x[0] *= 60
    cells = [(f"s{j}", f"p{i}", float(x[i, j]), "a" if j < 9 else "b") for i in range(probes) for j in range(n)]
    df = spark.createDataFrame(cells, "sample_id string, probe_id string, value double, class string")
    got = {r["probe_id"]: r["df_total"] for r in dm.moderated_stats(df).filter("class = 'a'").collect()}
    usual = np.median(list(got.values()))
    assert len(got) == probes and got["p0"] < n - 2 + 2 < usual


def test_f_and_chi_square_tails():
    x = np.array([0.0, 0.1, 1, 3, 10, 50, 700])
    assert np.allclose(tails.chi2_upper(x, 2.0), np.exp(-x / 2), rtol=1e-11, atol=0)
    assert np.allclose(tails.chi2_upper(x, 1.0), [math.erfc(math.sqrt(v / 2)) for v in x], rtol=1e-11, atol=0)
    assert np.allclose(tails.f_upper(x, 2.0, 7.0), (1 + 2 * x / 7) ** -3.5, rtol=1e-11, atol=0)
    assert np.allclose(tails.f_upper(x, 4.0, math.inf), tails.chi2_upper(4 * x, 4.0))


def test_tails_against_the_standard_library():
    x = np.logspace(-3, 8, 2000)
    assert np.allclose(tails._lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    z = np.linspace(-37, 37, 1501)
    exact = [math.erfc(abs(v) / math.sqrt(2)) for v in z]
    assert np.allclose(tails._normal_two_sided(z), exact, rtol=1e-11, atol=0)


def test_degrees_of_freedom_are_those_of_the_pool_at_most(spark):
    rng = np.random.default_rng(11)
    rows = []
    for p in range(5):
        for j in range(12):
            value = 3.0 if p == 4 else float(rng.normal())
            rows.append((f"s{j}", f"p{p}", value, "ab"[j % 2]))
    df = spark.createDataFrame(rows, "sample_id string, probe_id string, value double, class string")
    for robust in (False, True):
        got = dm.moderated_stats(df, robust).collect()
        assert len(got) == 10 and all(10 < r["df_total"] <= 50 for r in got)
        # A probe without variance takes the prior's and gives no difference.
        assert all(r["t_mod"] == 0 for r in got if r["probe_id"] == "p4")
