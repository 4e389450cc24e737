"""Selection inside the folds, the training task, and all nodes of a tree in one pass."""

from __future__ import annotations

import threading
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import Window, functions as F

from cpgspark.operators import design, dm, predict, search, splits, train, tree
from cpgspark.operators.forests import Forest
from cpgspark.operators.vectors import sample_vectors

M = "sample_id string, probe_id string, value double"


def cells(spark, x, names=None, gaps=()):
    names = names or [f"s{i:03d}" for i in range(len(x))]
    rows = [
        (names[i], f"p{j:04d}", None if (i, j) in gaps else float(v))
        for i, row in enumerate(x)
        for j, v in enumerate(row)
    ]
    return spark.createDataFrame(rows, M)


def cohort_of(spark, classes, folds, node="a"):
    rows = [(node, f"s{i:03d}", c, f) for i, (c, f) in enumerate(zip(classes, folds))]
    return spark.createDataFrame(rows, "node string, sample_id string, class string, fold int")


def plain_f(x, y):
    """One-way F, missing values as zero."""
    x, kinds = np.nan_to_num(x), sorted(set(y))
    groups = [x[np.array(y) == k] for k in kinds]
    between = sum(len(g) * (g.mean() - x.mean()) ** 2 for g in groups) / (len(kinds) - 1)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(x) - len(kinds))
    return between / within


def test_scores_leave_the_fold_out(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(24, 5)) + 1e6  # large means: sums of squares would lose digits
    classes, folds = [f"k{i % 3}" for i in range(24)], [i // 3 % 4 for i in range(21)] + [None] * 3
    gaps = {(0, 1), (5, 1), (7, 4)}
    got = {
        (r.left_out, r.probe_id): r
        for r in dm.fold_scores(cells(spark, x, gaps=gaps), cohort_of(spark, classes, folds)).collect()
    }
    assert len(got) == 5 * 5
    for part in (-1, 0, 1, 2, 3):
        keep = [i for i, f in enumerate(folds) if f is not None and f != part]
        for j in range(5):
            v = np.array([np.nan if (i, j) in gaps else x[i, j] for i in keep])
            r = got[part, f"p{j:04d}"]
            assert r.f_score == pytest.approx(plain_f(v, [classes[i] for i in keep]), rel=1e-6)
            assert r.df_between == 2 and r.df_within == len(keep) - 3


def test_incomplete_probes_of_a_node_are_dropped(spark):
    x = np.arange(40.0).reshape(8, 5) ** 1.5
    frame = cells(spark, x, gaps={(7, 2)})
    rows = cohort_of(spark, list("abababab"), [0, 0, 1, 1, 0, 1, 0, None])
    few = rows.where("sample_id != 's007'").withColumn("node", F.lit("b"))
    got = dm.fold_scores(frame, rows.unionByName(few), complete=True)
    found = {(r.node, r.probe_id) for r in got.collect()}
    assert ("a", "p0002") not in found and ("b", "p0002") in found and len(found) == 9


def test_ties_empty_tables_and_all_probes(spark):
    x = np.tile(np.arange(8.0)[:, None], (1, 3))
    scores = dm.fold_scores(cells(spark, x), cohort_of(spark, list("aabbaabb"), [0, 1] * 4))
    some = dm.fold_features(scores, 2).where("left_out = -1").orderBy("place").collect()
    assert [r.probe_id for r in some] == ["p0000", "p0001"]
    assert dm.fold_features(scores, None).count() == 9
    none = cells(spark, x).limit(0)
    assert dm.fold_features(dm.fold_scores(none, cohort_of(spark, ["a"], [0]))).count() == 0


def task(spark, x, classes, seed=0):
    rng = np.random.default_rng(seed)
    split = ["train"] * int(len(x) * 0.7)
    split += ["val", "test"] * len(x)
    rows = [(f"s{i:03d}", c, split[i]) for i, c in enumerate(classes)]
    return cells(spark, x), spark.createDataFrame(rows, "sample_id string, class string, split string")


def test_pure_noise_scores_at_chance(spark):
    """Chosen outside the folds, 10 of 600 noise probes would score far above one half."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 600))
    m, rows = task(spark, x, [f"k{i % 2}" for i in range(60)])
    settings = search.grid(top_k=(10, 20), n_trees=(8,), max_depth=(3,))
    found = search.train_task(m, rows, settings, score="accuracy")
    scores = [r.mean_test_score for r in found.scores.collect()]
    assert len(scores) == 2 and all(0.25 <= s <= 0.75 for s in scores)
    parts = {r.left_out for r in found.chosen.select("left_out").distinct().collect()}
    assert parts == {-1, 0, 1, 2, 3, 4}
    kept = defaultdict(set)
    for r in found.chosen.where("place <= 10").collect():
        kept[r.left_out].add(r.probe_id)
    assert len(set.union(*kept.values())) >= 20  # every fold chose its own


def test_task_fits_read_stored_rows(spark, monkeypatch):
    """A fit reads the rows several times: no join, split or class count is left in its plan."""
    rng = np.random.default_rng(6)
    m, rows = task(spark, rng.normal(size=(40, 4)), [f"k{i % 2}" for i in range(40)])
    rows = rows.withColumn("split", F.max("split").over(Window.partitionBy("sample_id")))
    plans, plain = [], Forest._fit

    def spied(self, data):
        plans.append(data._jdf.queryExecution().optimizedPlan().toString())
        return plain(self, data)

    monkeypatch.setattr(Forest, "_fit", spied)
    search.train_task(m, rows, search.grid(top_k=(2,), n_trees=(3,), max_depth=(2,)))
    assert plans
    for plan in plans:
        assert "Join" not in plan and "Window" not in plan and "Aggregate" not in plan


def test_folds_are_fitted_at_once(spark, monkeypatch):
    rng = np.random.default_rng(7)
    m, rows = task(spark, rng.normal(size=(40, 4)), [f"k{i % 2}" for i in range(40)])
    both, plain = threading.Barrier(2), search.fit

    def met(vectors, *given):
        if both.n_waiting or not met.done:
            both.wait(60)  # two fits are under way
            met.done = True
        return plain(vectors, *given)

    met.done = False
    monkeypatch.setattr(search, "fit", met)
    found = search.train_task(m, rows, search.grid(top_k=(2, 4), n_trees=(3,), max_depth=(2,)))
    table = found.scores.orderBy("setting").collect()
    assert [(r.top_k, r.n_folds) for r in table] == [(2, 5), (4, 5)]


def test_signal_is_found_and_scaling_is_kept(spark, tmp_path):
    rng = np.random.default_rng(4)
    classes = [f"k{i % 3}" for i in range(60)]
    x = rng.normal(size=(60, 40))
    for i in range(60):
        x[i, i % 3] += 6
    x[:, 1] *= 1000
    m, rows = task(spark, x, classes)
    settings = search.grid(kind=("svm",), scale=(True,), top_k=(3,), max_iter=(4,))
    found = search.train_task(m, rows, settings, score="accuracy")
    assert sorted(found.model.features) == ["p0000", "p0001", "p0002"]
    summary = {r["set"]: r for r in found.summary.collect()}
    assert summary["val"]["accuracy"] >= 0.8 and summary["test"]["accuracy"] >= 0.8
    train.save_model(found.model, str(tmp_path), spark)
    back = train.load_model(found.model.path, str(tmp_path), spark)
    vectors = sample_vectors(m, back.features)
    calls = lambda x: sorted(map(tuple, x.predict(vectors).select("sample_id", "prediction").collect()))
    assert calls(back) == calls(found.model)


def test_one_sample_class_is_scored_on_validation(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 6))
    classes = ["rare"] + [f"k{i % 2}" for i in range(29)]
    m, rows = task(spark, x, classes)
    found = search.train_task(m, rows, search.grid(top_k=(2, 4), n_trees=(5,), max_depth=(3,)))
    table = found.scores.collect()
    assert len(table) == 2 and all(r.n_folds == 1 for r in table)
    best = max(r.mean_test_score for r in table)
    assert len(found.model.features) == next(r.top_k for r in table if r.mean_test_score == best)


def test_bad_kind_is_refused(spark):
    vectors = spark.createDataFrame([("a", "x")], "sample_id string, class string")
    with pytest.raises(ValueError):
        search.fit(vectors, [], search.Settings(kind="bayes"))


@pytest.fixture(scope="module")
def grown(spark):
    rng = np.random.default_rng(4)
    edges = [("ROOT", "g0"), ("ROOT", "g1"), ("g0", "c0"), ("g0", "c1"), ("g1", "c2"), ("g1", "c3")]
    samples = [(f"s{i:03d}", f"c{i // 15}") for i in range(60)]
    x = rng.normal(size=(60, 8))
    for i in range(60):
        x[i, i // 15] += 6
        x[i, 4 + i // 30] += 4
    m = cells(spark, x)
    nodes, held = tree.build_tree(
        spark.createDataFrame(edges, "parent string, child string"),
        spark.createDataFrame(samples, "sample_id string, diseaseName string"),
    )
    return m, nodes, held


def test_every_node_is_searched_calibrated_and_held_out(spark, grown, tmp_path):
    m, nodes, held = grown
    settings = search.grid(top_k=(1, 6), n_trees=(5,), max_depth=(3,))
    models = train.train_tree(m, nodes, held, settings=settings, calibration="sigmoid", folds=2)
    assert set(models) == {"ROOT", "ROOT/g0", "ROOT/g1"}
    rows = {r.sample_id: r.node_path for r in held.collect()}
    for key, model in models.items():
        out = model.held_out.collect()
        below = [s for s, p in rows.items() if "/".join(p).startswith(key)]
        assert len(out) == -(-len(below) // 5) and all("/".join(rows[r.sample_id]).startswith(key) for r in out)
        assert model.metrics["cv_best"] >= 0.8 and model.metrics["accuracy"] >= 0.6
        assert model.calibrator is not None
    steps = predict.predict_tree(m, held, models, "ROOT")
    last = predict.final_prediction(steps).join(held, "sample_id")
    assert last.filter(F.element_at("node_path", -1) == F.col("final_prediction")).count() >= 54
    train.save_model(models["ROOT"], str(tmp_path), spark)
    back = train.load_model(["ROOT"], str(tmp_path), spark)
    vectors = sample_vectors(m, back.features)
    pairs = [
        {r.sample_id: r.probability for r in x.predict(vectors).collect()} for x in (models["ROOT"], back)
    ]
    assert pairs[0] == pytest.approx(pairs[1])


def test_reads_of_the_measurements_do_not_grow_with_the_nodes(spark, grown):
    """The plans of the pass over the measurements name them as often for one node as for three."""
    m, nodes, held = grown
    rows = design.node_design(nodes, held, m.select("sample_id"))
    counts = []
    for some in (rows.where("size(node_path) = 1"), rows):
        cohorts = search.node_cohorts(some)
        plan = dm.fold_scores(m, cohorts, complete=True)._jdf.queryExecution().optimizedPlan().toString()
        counts.append(plan.count("probe_id#"))
    assert counts[0] == counts[1]
    dealt = search.node_cohorts(rows).collect()
    per_node = Counter(r.node for r in dealt)
    assert per_node == {"ROOT": 60, "ROOT/g0": 30, "ROOT/g1": 30}
    for node in per_node:
        folds = Counter((r["class"], r.fold) for r in dealt if r.node == node and r.fold is not None)
        by_class = defaultdict(list)
        for (c, _), n in folds.items():
            by_class[c].append(n)
        assert all(max(n) - min(n) <= 1 for n in by_class.values())


def test_a_tree_finds_complete_probes_and_counts_classes_once(spark, grown, monkeypatch):
    """Passes over the measurements read stored probes; no fit counts its classes anew."""
    m, nodes, held = grown
    seen = []

    class Cohorts(search.FoldedCohorts):
        def __init__(self, rows, *rest):
            seen.append(rows._jdf.queryExecution().optimizedPlan().toString())
            super().__init__(rows, *rest)

    def refused(*_):
        raise AssertionError("a fit counted its classes")

    monkeypatch.setattr(search, "FoldedCohorts", Cohorts)
    monkeypatch.setattr(train.StringIndexer, "fit", refused)
    settings = search.grid(top_k=(6,), n_trees=(3, 5), max_depth=(3,))
    models = train.train_tree(m, nodes, held, settings=settings, folds=2)
    assert set(models) == {"ROOT", "ROOT/g0", "ROOT/g1"}
    assert [x.classes for x in models.values()] == [["g0", "g1"], ["c0", "c1"], ["c2", "c3"]]
    assert len(seen) == 1 and "Aggregate" not in seen[0]


def test_known_classes_fit_the_same_model(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{i}", Vectors.dense(rng.normal(size=3) + i % 3), "\U0001F600\uFFFFb"[i % 3]) for i in range(45)]
    vectors = spark.createDataFrame(rows, ["sample_id", "features", "class"]).repartition(1).cache()
    settings = search.Settings(n_trees=4, max_depth=3)
    counted = dict(Counter(r[2] for r in rows))
    told, asked = (search.fit(vectors, list("xyz"), settings, counted=n) for n in (counted, None))
    assert told.classes == asked.classes == ["b", "\uFFFF", "\U0001F600"]
    assert told.model._java_obj.toDebugString().split("\n")[1:] == asked.model._java_obj.toDebugString().split("\n")[1:]


def test_classes_of_a_calibration_are_fitted_at_once(spark, monkeypatch):
    gate = threading.Barrier(3, timeout=60)

    class Waits(train.LogisticRegression):
        def fit(self, rows):
            gate.wait()
            return super().fit(rows)

    monkeypatch.setattr(train, "LogisticRegression", Waits)
    rng = np.random.default_rng(6)
    rows = [("abc"[i % 3], [float(v) for v in rng.dirichlet(np.ones(3) + (np.arange(3) == i % 3))]) for i in range(60)]
    scored = spark.createDataFrame(rows, "class string, scores array<double>")
    with ThreadPoolExecutor(3) as pool:
        fitted = train.calibrate(scored, "abc", pool=pool)
    assert list(fitted.maps) == list("abc")
