"""Metrics, imputation, models and prediction."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cpgspark.operators import cohort, dm, metrics, predict, qc, train, tree
from cpgspark.operators.vectors import sample_vectors
from cpgspark.plans.durable import scratch_path

M = "sample_id string, probe_id string, value double"


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "actual string, predicted string")


def test_core_metrics_by_hand(spark):
    # "z" is only predicted: it counts for macro F1, not for balanced accuracy.
    df = _pairs(spark, [("a", "a"), ("a", "a"), ("a", "b"), ("b", "b"), ("b", "z")])
    row = metrics.core_metrics(df).first()
    f_a, f_b = 2 * 2 / (3 + 2), 2 * 1 / (2 + 2)
    assert row["accuracy"] == 0.6
    assert row["f1_macro"] == pytest.approx((f_a + f_b + 0) / 3, abs=1e-6)
    assert row["balanced_accuracy"] == pytest.approx((2 / 3 + 1 / 2) / 2, abs=1e-6)
    youden = {r["class"]: r for r in metrics.class_youden(df).collect()}
    assert set(youden) == {"a", "b"}
    assert youden["a"]["youden_index"] == pytest.approx(2 / 3 + 1 - 1)


def test_confusion_drops_unlisted(spark):
    df = _pairs(spark, [("a", "a"), ("a", "q"), ("q", "a")])
    cells = {(r[0], r[1]): (r[2], r[3]) for r in metrics.confusion_matrix(df, ["a", "b"]).collect()}
    assert cells == {("a", "a"): (1, 1.0), ("a", "b"): (0, 0.0), ("b", "a"): (0, 0.0), ("b", "b"): (0, 0.0)}
    frame = spark.createDataFrame([("a",), ("b",), ("a",)], "class string")
    assert metrics.confusion_matrix(df, frame).count() == 4


def test_report_averages(spark):
    df = _pairs(spark, [("a", "a"), ("a", "b"), ("b", "b")])
    rep = {r["class"]: r for r in metrics.class_report(df).collect()}
    assert rep["accuracy"]["precision"] == pytest.approx(2 / 3)
    assert rep["macro avg"]["recall"] == pytest.approx(0.75)
    assert rep["weighted avg"]["support"] == 3


def test_auc_with_ties_and_single_class(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.9), ("a", 1, 0.4), ("a", 0, 0.1), ("one", 1, 0.5)]
    df = spark.createDataFrame(rows, "class string, truth int, score double")
    # Pairs: (0.9, 0.9) half, (0.9, 0.1) one, (0.4, 0.9) none, (0.4, 0.1) one.
    assert [tuple(r) for r in metrics.roc_auc(df).collect()] == [("a", pytest.approx(2.5 / 4))]
    curve = metrics.roc_curve(df)
    assert {r["class"] for r in curve.collect()} == {"a"}
    assert curve.agg(F.max("tpr"), F.max("fpr"), F.min("tpr")).first()[:] == (1.0, 1.0, 0.0)
    pr = metrics.pr_curve(df).orderBy("recall").collect()
    assert (pr[0]["recall"], pr[0]["precision"]) == (0.0, 1.0)
    assert pr[-1]["precision"] == pytest.approx(2 / 3) or pr[-1]["recall"] == 1.0


def test_shares_and_brier(spark):
    df = spark.createDataFrame([(0.2,), (0.8,)], "p double")
    assert metrics.share_above(df, "p", 0.5).first()[0] == 0.5
    assert metrics.share_above(df.limit(0), "p", 0.5).first()[0] == 0.0
    scored = spark.createDataFrame([(1, 0.8), (0, 0.4)], "truth int, score double")
    assert metrics.brier(scored).first()[0] == pytest.approx((0.04 + 0.16) / 2)


def test_knn_against_direct(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(40, 7))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 6] = np.nan
    x[3, 6] = 4.0  # a single donor
    names = [f"s{i:02d}" for i in range(40)]
    rows = [(names[i], f"p{j}", None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(40) for j in range(7)]
    m = spark.createDataFrame(rows, M)
    targets = spark.createDataFrame([(n,) for n in names[:12]], "sample_id string")
    got = {(r[0], r[1]): r[2] for r in cohort.knn_impute(m, targets, 3).select("sample_id", "probe_id", "value").collect()}
    assert len(got) == 12 * 7
    for i in range(12):
        for j in range(7):
            if not np.isnan(x[i, j]):
                assert got[(names[i], f"p{j}")] == x[i, j]
                continue
            near = []
            for d in range(40):
                both = ~np.isnan(x[i]) & ~np.isnan(x[d])
                if d != i and not np.isnan(x[d, j]) and both.any():
                    near.append((np.sqrt(7 / both.sum() * ((x[i] - x[d])[both] ** 2).sum()), names[d], x[d, j]))
            want = np.mean([v for *_, v in sorted(near)[:3]]) if near else np.nanmean(x[:, j])
            assert got[(names[i], f"p{j}")] == pytest.approx(want, rel=1e-9)


def test_knn_does_not_depend_on_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(f"s{i}", f"p{j}", None if (i + j) % 6 == 0 else float(rng.normal())) for i in range(30) for j in range(5)]
    m = spark.createDataFrame(rows, M)
    whole = sorted(map(tuple, cohort.knn_impute(m, m).select("sample_id", "probe_id", "value").collect()))
    monkeypatch.setattr(cohort, "_BLOCK_BYTES", 8 * 5 * 7)
    cut = sorted(map(tuple, cohort.knn_impute(m, m).select("sample_id", "probe_id", "value").collect()))
    assert [r[:2] for r in whole] == [r[:2] for r in cut]
    assert np.allclose([r[2] for r in whole], [r[2] for r in cut])


@pytest.fixture(scope="module")
def grown(spark):
    """Two groups of two classes, well apart; models for all three inner nodes."""
    rng = np.random.default_rng(4)
    edges = spark.createDataFrame(
        [("ROOT", "g0"), ("ROOT", "g1"), ("g0", "c0"), ("g0", "c1"), ("g1", "c2"), ("g1", "c3")],
        "parent string, child string",
    )
    samples, cells = [], []
    for c in range(4):
        for i in range(15):
            name = f"s{c}_{i:02d}"
            samples.append((name, f"c{c}"))
            for p in range(8):
                centre = 6.0 if p == c else (4.0 if p == 4 + c // 2 else 0.0)
                cells.append((name, f"p{p}", float(rng.normal(centre))))
    m = spark.createDataFrame(cells, M)
    nodes, held = tree.build_tree(edges, spark.createDataFrame(samples, "sample_id string, diseaseName string"))
    models = train.train_tree(m, nodes, held, n_trees=10, top_k=6)
    return m, nodes, held, models


def test_tree_of_models_predicts_the_leaves(spark, grown):
    m, nodes, held, models = grown
    assert set(models) == {"ROOT", "ROOT/g0", "ROOT/g1"}
    ids = held.select("sample_id").unionByName(spark.createDataFrame([("ghost",)], "sample_id string"))
    steps = predict.predict_tree(m, ids, models, "ROOT")
    assert steps.filter("sample_id = 'ghost'").count() == 0
    assert {r[0]: r[1] for r in steps.groupBy("depth").count().collect()} == {1: 60, 2: 60}
    last = predict.final_prediction(steps)
    right = last.join(held, "sample_id").filter(F.element_at("node_path", -1) == F.col("final_prediction"))
    assert right.count() >= 57
    nested = predict.predictions_map(steps).first()["predictions"]
    assert "ROOT" in nested and 0 <= nested["ROOT"]["probability"] <= 1
    assert predict.predict_tree(m, ids, {}, "ROOT").count() == 0


def test_prediction_stops_at_its_own_name(spark, grown):
    m, _, held, models = grown
    root = models["ROOT"]
    loop = train.NodeModel("ROOT", root.features, ["ROOT", "g1"], root.model)
    steps = predict.predict_tree(m, held, {"ROOT": loop, "ROOT/g1": models["ROOT/g1"]}, "ROOT")
    assert steps.filter("prediction = 'ROOT' AND depth > 1").count() == 0
    assert steps.agg(F.max("depth")).first()[0] == 2


def test_equal_names_on_other_paths_are_other_models(spark, grown, tmp_path):
    m, _, held, models = grown
    right, wrong = models["ROOT/g0"], models["ROOT/g1"]
    same = [
        train.NodeModel("same", x.features, x.classes, x.model, path=("ROOT", g, "same"))
        for x, g in ((right, "g0"), (wrong, "g1"))
    ]
    assert len({train.path_key(x.path) for x in same}) == 2
    for x in same:
        train.save_model(x, str(tmp_path), spark)
    back = [train.load_model(x.path, str(tmp_path), spark) for x in same]
    assert [x.classes for x in back] == [["c0", "c1"], ["c2", "c3"]]
    assert train.path_key(["a/b", "c"]) != train.path_key(["a", "b", "c"])


def test_linear_machines_and_samples_without_model_probes(spark, grown):
    m, _, held, models = grown
    root = models["ROOT"]
    labels = held.select("sample_id", F.element_at("node_path", 2).alias("class"))
    vectors = sample_vectors(m, root.features).join(labels, "sample_id")
    linear = train.train_linear_svm(vectors, root.features, max_iter=10)
    other = spark.createDataFrame([("elsewhere", "no model probe", 1.0)], M)
    ids = held.select("sample_id").unionByName(other.select("sample_id"))
    steps = predict.predict_tree(m.unionByName(other), ids, {**models, "ROOT": linear}, "ROOT")
    first = steps.filter("depth = 1")
    assert first.count() == 61 and first.filter("probability IS NOT NULL").count() == 0
    assert steps.filter("sample_id = 'elsewhere'").count() >= 1
    assert steps.filter("depth = 2 AND probability IS NULL").count() == 0


def test_neighbours_over_many_probes_go_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(size=700)
    rows = []
    for s in range(30):
        for p, v in enumerate(base + 0.01 * s):
            if (s, p) != (3, 5):
                rows.append((f"s{s:02d}", f"p{p:03d}", float(v)))
    m = spark.createDataFrame(rows, M)
    wanted = spark.createDataFrame([("s03",)], "sample_id string")
    whole = cohort.knn_impute(m, wanted).filter("probe_id = 'p005'").first()["value"]
    monkeypatch.setattr(cohort, "_BLOCK_BYTES", 8 * 700 * 4)
    blocked = cohort.knn_impute(m, wanted)
    assert blocked.count() == 700
    assert blocked.filter("probe_id = 'p005'").first()["value"] == pytest.approx(whole)
    assert whole == pytest.approx(base[5] + 0.01 * np.mean([1, 2, 4, 5, 0]), abs=0.02)


@pytest.mark.parametrize("width", [1, 3, 64])
def test_neighbours_do_not_depend_on_probe_ranges(spark, monkeypatch, width):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(25, 10))
    x[rng.random(x.shape) < 0.3] = np.nan
    x[2, 3:6] = np.nan  # a range of one target without any value
    x[:, 9] = np.nan
    x[4, 9] = 1.5
    rows = [(f"s{i:02d}", f"p{j}", float(x[i, j])) for i in range(25) for j in range(10) if not np.isnan(x[i, j])]
    m = spark.createDataFrame(rows, M)
    wanted = spark.createDataFrame([("s02",), ("s07",), ("s20",)], "sample_id string")
    whole = {r[:2]: r[2] for r in cohort.knn_impute(m, wanted, 3).select("sample_id", "probe_id", "value").collect()}
    monkeypatch.setattr(cohort, "_RANGE", width)
    monkeypatch.setattr(cohort, "_BLOCK_BYTES", 8 * width * 6)
    cut = {r[:2]: r[2] for r in cohort.knn_impute(m, wanted, 3).select("sample_id", "probe_id", "value").collect()}
    assert len(whole) == 30 and cut == pytest.approx(whole)


def test_neighbours_of_seventy_thousand_probes(spark):
    """Every sample is a shift of one profile, so the nearest are the next shifts."""
    cells = spark.range(200 * 70_000).select(
        F.format_string("s%03d", F.floor(F.col("id") / 70_000)).alias("sample_id"),
        F.format_string("p%05d", F.col("id") % 70_000).alias("probe_id"),
        (F.floor(F.col("id") / 70_000) + (F.col("id") % 70_000) % 17).cast("double").alias("value"),
    )
    gap = "(sample_id = 's100' and probe_id in ('p00004', 'p69999'))"
    m = cells.filter(f"not {gap}")
    wanted = spark.createDataFrame([("s100",), ("s101",)], "sample_id string")
    out = cohort.knn_impute(m, wanted, 2)
    found = {r[1]: r[2] for r in out.filter(gap).select("sample_id", "probe_id", "value").collect()}
    assert found == {"p00004": pytest.approx(100 + 4), "p69999": pytest.approx(100 + 69_999 % 17)}


def test_models_survive_storage(spark, grown):
    m, _, held, models = grown
    folder = scratch_path(spark, "models")
    train.save_model(models["ROOT/g0"], folder, spark)
    back = train.load_model(["ROOT", "g0"], folder, spark)
    vectors = sample_vectors(m, back.features)
    a = sorted(map(tuple, models["ROOT/g0"].predict(vectors).select("sample_id", "prediction").collect()))
    assert a == sorted(map(tuple, back.predict(vectors).select("sample_id", "prediction").collect()))


def test_node_report(spark, grown):
    m, _, held, models = grown
    out = predict.validate_node(m, models["ROOT/g1"], held, held.select("sample_id"), ["ROOT", "g1"])
    rep = {r["class"]: r for r in out.collect()}
    assert {"c2", "c3", "accuracy"} <= set(rep) and rep["c2"]["support"] == 15


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
@pytest.mark.parametrize("count", [2, 3])
def test_calibration_gives_probabilities(spark, method, count):
    rng = np.random.default_rng(8)
    classes = [f"k{i}" for i in range(count)]
    rows = []
    for i in range(120):
        c = i % count
        p = rng.dirichlet(np.ones(count) + 3 * (np.arange(count) == c))
        rows.append((f"s{i}", classes[c], [float(v) for v in p]))
    df = spark.createDataFrame(rows, "sample_id string, class string, scores array<double>")
    out = train.calibrate(df, classes, method).transform(df).collect()
    assert len(out) == 120
    for r in out:
        assert sum(r["scores"]) == pytest.approx(1.0)
        assert r["prediction"] == classes[int(np.argmax(r["scores"]))]


def test_bad_names_are_refused(spark):
    with pytest.raises(ValueError):
        train.ClassScore("auc")
    with pytest.raises(ValueError):
        train.calibrate(None, ["a"], "beta")


def test_grid_search_by_area(spark, grown):
    m, _, held, models = grown
    labels = held.select("sample_id", F.element_at("node_path", -1).alias("class"))
    vectors = sample_vectors(m, models["ROOT"].features).join(labels, "sample_id")
    best, table = train.grid_search(vectors, models["ROOT"].features, n_trees=(5,), max_depth=(3,), score="roc_auc")
    assert 0.9 <= table.first()["mean_test_score"] <= 1.0
    assert best.classes == ["c0", "c1", "c2", "c3"]


def test_right_calls_take_the_largest_probability(spark):
    df = spark.createDataFrame([("a", "a", [0.2, 0.8]), ("a", "b", [0.9, 0.1])], "actual string, predicted string, probability array<double>")
    assert [tuple(r) for r in qc.correct_calls(df).collect()] == [("a", "a", 0.8)]


def test_select_all_without_k(spark):
    df = spark.createDataFrame([("p", 1.0)], "probe_id string, f_score double")
    assert dm.select_k_best(df, None).count() == 1


def test_svm_choice_of_c(spark, grown):
    m, _, held, models = grown
    labels = held.select("sample_id", F.get("node_path", F.lit(1)).alias("class"))
    features = models["ROOT"].features
    vectors = sample_vectors(m, features).join(labels, "sample_id")
    best, table = train.search_linear_svm(vectors, features, c=(0.01, 1.0), k=2, max_iter=5)
    assert table.count() == 2 and best.metrics["cv_best"] >= 0.9
    calls = best.predict(vectors)
    assert calls.filter(F.col("class") == F.col("prediction")).count() >= 55
    with pytest.raises(ValueError):
        train.search_linear_svm(vectors, features, score="roc_auc")


def test_one_range_holds_no_pairs_of_samples(spark, monkeypatch):
    """Few probes and many samples: no distances leave a task, and far ties leave no gap short."""
    def refused(*_):
        raise AssertionError("distances of a whole block were made")

    monkeypatch.setattr(cohort, "_tile_guesses", refused)
    monkeypatch.setattr(cohort, "_BLOCK_ROWS", 40)
    # All but six far samples lack p1, so the nearest sixteen times k cannot fill it.
    rows = [(f"s{i:03d}", "p0", float(i)) for i in range(150)]
    rows += [(f"s{i:03d}", "p1", float(i)) for i in range(144, 150)]
    rows += [(f"s{i:03d}", "p1", None) for i in range(144)]
    m = spark.createDataFrame(rows, M)
    out = cohort.knn_impute(m, m.filter("sample_id = 's000'"), 2)
    assert out.filter("probe_id = 'p1'").first()["value"] == pytest.approx(144.5)
