"""Probe selection, scaling and model fitted together and searched by cross-validation.

Probes are chosen anew on the training part of every fold, so no score has seen its own
test rows.  The choices of all folds, and of all nodes of a tree, come from one aggregate
of the measurements (:func:`cpgspark.operators.dm.fold_scores`); a second pass stores one
array per sample over all chosen probes, from which every fit picks its vector.  Only the
fits themselves go fold by fold and node by node, as concurrent Spark jobs.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from cpgspark.operators import design as design_ops
from cpgspark.operators.dm import ALL_FOLDS, fold_features, fold_scores
from cpgspark.operators.metrics import core_metrics, metrics_summary
from cpgspark.operators.qc import complete_probes
from cpgspark.operators.splits import SEED, adaptive_folds, node_folds
from cpgspark.operators.train import (
    MAX_DEPTH,
    TREES,
    ClassScore,
    NodeModel,
    _indexed,
    calibrate,
    forest,
    path_key,
)
from cpgspark.operators.vectors import MAX_FEATURES, class_weights, pick, sample_arrays
from cpgspark.plans.durable import store
from cpgspark.plans.sizing import small_side

_TASK = "task"
#: Folds of a search that are fitted at once.
FITS = 4


@dataclass(frozen=True)
class Settings:
    """One way to fit: how many probes, whether they are scaled, and the model's settings.

    ``kind`` is forest or svm; ``c`` and ``max_iter`` are the
    machine's, the settings after them the forest's.
    ``max_features`` is one of Spark's strategies (all, sqrt, log2, ...), ``min_rows`` the
    fewest samples in a leaf.
    """

    top_k: int | None = 5000
    scale: bool = False
    kind: str = "forest"
    c: float = 1.0
    max_iter: int = 50
    n_trees: int = TREES[0]
    max_depth: int = MAX_DEPTH
    impurity: str = "gini"
    max_features: str = "sqrt"
    min_rows: int = 1
    balanced: bool = True


def grid(**choices: Iterable) -> list[Settings]:
    """All combinations of the given choices, the first named varying slowest."""
    names = list(choices)
    return [Settings(**dict(zip(names, some))) for some in itertools.product(*choices.values())]


def fit(
    vectors: DataFrame,
    features: list[str],
    settings: Settings,
    name: str = "ROOT",
    seed: int = SEED,
    counted: dict[str, int] | None = None,
) -> NodeModel:
    """Scaling and model on ``sample_id, features, class``; both are kept in the model.

    ``counted`` has the number of rows of every class, where they were counted before.
    """
    indexer, classes = _indexed(vectors, counted)
    rows = indexer.transform(vectors)
    column = "scaled" if settings.scale else "features"
    if settings.kind == "svm":
        machine = LinearSVC(maxIter=settings.max_iter, regParam=1.0 / (settings.c * rows.count()), featuresCol=column)
        last = OneVsRest(classifier=machine, featuresCol=column)
    elif settings.kind == "forest":
        rows = class_weights(rows, counted=counted) if settings.balanced else rows.withColumn("weight", F.lit(1.0))
        last = forest(
            settings.n_trees,
            settings.max_depth,
            seed,
            settings.max_features,
            impurity=settings.impurity,
            minInstancesPerNode=settings.min_rows,
            featuresCol=column,
        )
    else:
        raise ValueError(f"unknown kind of model: {settings.kind}")
    if not settings.scale:
        return NodeModel(name, features, classes, last.fit(rows))
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="scaled")
    return NodeModel(name, features, classes, Pipeline(stages=[scaler, last]).fit(rows))


@dataclass
class Searched:
    """What a search of one node gives: the model and one row per setting and fold."""

    model: NodeModel
    scores: list[tuple[int, int, float]]


def _called(model: NodeModel, rows: DataFrame) -> DataFrame:
    return model.predict(rows).select(F.col("class").alias("actual"), F.col("prediction").alias("predicted"))


def _score(model: NodeModel, rows: DataFrame, score: str) -> float:
    if score == "roc_auc":
        places = [(c, float(i)) for i, c in enumerate(model.classes)]
        labels = rows.sparkSession.createDataFrame(places, "class string, label double")
        known = rows.join(F.broadcast(labels), "class", "left")
        return ClassScore(score, model.classes).evaluate(model.model.transform(known))
    return float(core_metrics(_called(model, rows)).first()[score] or 0.0)


class FoldedCohorts:
    """The chosen probes and the stored arrays of all nodes of a cohort."""

    def __init__(self, m: DataFrame, cohort: DataFrame, top_k: int | None, complete: bool):
        self.cohort = store(cohort, "cohort")
        scores = store(fold_scores(m, self.cohort, complete=complete), "fold-scores")
        self.chosen = store(fold_features(scores, top_k), "fold-features")
        # At most top_k names for every part of every node: they belong to the models.
        self.lists: dict[tuple[str, int], list[str]] = {}
        for r in self.chosen.orderBy("node", "left_out", "place").collect():
            self.lists.setdefault((r["node"], r["left_out"]), []).append(r["probe_id"])
        self.names = sorted({p for some in self.lists.values() for p in some})
        ids = self.cohort.select("sample_id").distinct()
        arrays = sample_arrays(m.join(ids, "sample_id", "left_semi"), self.names)
        self.arrays = store(arrays, "node-arrays")

    def folds(self, node: str) -> list[int]:
        return sorted(part for name, part in self.lists if name == node and part != ALL_FOLDS)

    def features(self, node: str, left_out: int, top_k: int | None) -> list[str]:
        some = self.lists[node, left_out][:top_k]
        if len(some) > MAX_FEATURES:
            raise ValueError("select fewer probes before building vectors")
        return sorted(some)

    def rows(self, node: str, marks: DataFrame | None = None) -> "NodeRows":
        """Samples of a node with the values of the probes chosen in any part of it, stored once.

        ``marks`` has further columns by ``sample_id``.
        """
        names = sorted({p for (of, _), some in self.lists.items() if of == node for p in some})
        own = self.cohort.where(F.col("node") == node).drop("node")
        extra: list[str] = []
        if marks is not None:
            own = own.join(marks, "sample_id")
            extra = [c for c in marks.columns if c != "sample_id"]
        picked = pick(self.arrays.join(small_side(own), "sample_id"), self.names, names)
        values = vector_to_array("features").alias("values")
        return NodeRows(store(picked.select("sample_id", "class", "fold", *extra, values), "node-rows"), names)


@dataclass
class NodeRows:
    """``sample_id, class, fold`` and ``values`` over ``names``."""

    frame: DataFrame
    names: list[str]

    def where(self, condition) -> "NodeRows":
        return NodeRows(self.frame.where(condition), self.names)

    def vectors(self, features: list[str]) -> DataFrame:
        return pick(self.frame, self.names, features)

    def class_sizes(self, folds: Sequence[int]) -> dict[int, dict[str, int] | None]:
        """Rows of every class outside each of the folds, and in all of them by :data:`ALL_FOLDS`.

        None stands for rows that have no class.
        """
        found = self.frame.where("fold IS NOT NULL").groupBy("class", "fold").count().collect()
        sizes: dict[int, dict[str, int] | None] = {}
        for left_out in (*folds, ALL_FOLDS):
            some: Counter = Counter()
            for r in found:
                if r["fold"] != left_out:
                    some[r["class"]] += r["count"]
            sizes[left_out] = None if None in some else dict(some)
        return sizes


def search_node(
    held: FoldedCohorts,
    node: str,
    settings: Sequence[Settings],
    score: str = "f1_macro",
    calibration: str | None = None,
    name: str | None = None,
    seed: int = SEED,
    rows: NodeRows | None = None,
    pool: ThreadPoolExecutor | None = None,
) -> Searched:
    """Every setting on every fold, the best refitted on all training rows of the node.

    The first of equally good settings is kept.  With ``calibration`` the kept setting's
    out-of-fold scores give the maps to probabilities.  The fits of the folds run as
    concurrent Spark jobs, as many as ``pool`` has threads.
    """
    if pool is None:
        with ThreadPoolExecutor(FITS) as own_pool:
            return search_node(held, node, settings, score, calibration, name, seed, rows, own_pool)
    label, rows = name or node, rows or held.rows(node)
    folds = held.folds(node) if len(settings) > 1 or calibration else []
    sizes = rows.class_sizes(folds)

    def fit_fold(some: Settings, fold: int) -> tuple[NodeModel, DataFrame]:
        features = held.features(node, fold, some.top_k)
        vectors = rows.vectors(features)
        model = fit(vectors.where(F.col("fold") != fold), features, some, label, seed, sizes[fold])
        return model, vectors.where(F.col("fold") == fold)

    def tried(at: tuple[int, int]) -> tuple[NodeModel, float]:
        model, outside = fit_fold(settings[at[0]], at[1])
        return model, _score(model, outside, score)

    best, models, means = 0, {}, []
    places = [(i, fold) for i in range(len(settings)) for fold in folds] if len(settings) > 1 else []
    found: list[tuple[int, int, float]] = []
    parts: dict[int, NodeModel] = {}
    tries = pool.map(tried, places)
    for i, fold in places:
        model, value = next(tries)
        found.append((i, fold, value))
        parts[fold] = model
        if fold != folds[-1]:
            continue
        means.append(sum(s for j, _, s in found if i == j) / len(folds))
        # Only the parts of the best setting so far are kept, for the calibration.
        if means[i] > means[best] or i == 0:
            best, models = i, parts if calibration else {}
        parts = {}
    chosen = settings[best]
    features = held.features(node, ALL_FOLDS, chosen.top_k)
    training = rows.vectors(features).where("fold IS NOT NULL")
    model = fit(training, features, chosen, label, seed, sizes[ALL_FOLDS])
    if found:
        model.metrics["cv_best"] = max(means)
    if calibration:
        outside = None

        def part_of(fold: int) -> NodeModel:
            return models.get(fold) or fit_fold(chosen, fold)[0]

        for fold, part in zip(folds, pool.map(part_of, folds), strict=True):
            if part.classes != model.classes:
                continue  # a class too small to be in every training part
            vectors = rows.vectors(held.features(node, fold, chosen.top_k))
            scored = part.predict(vectors.where(F.col("fold") == fold)).select("class", "scores")
            outside = scored if outside is None else outside.unionByName(scored)
        if outside is not None:
            model.calibrator = calibrate(outside, model.classes, calibration, pool)
    return Searched(model, found)


def score_table(spark, searched: dict[str, Searched], settings: Sequence[Settings]) -> DataFrame:
    """``node``, the number and settings of each way to fit, and its mean score over the folds."""
    rows = []
    for node, found in searched.items():
        for i, some in enumerate(settings):
            own = [s for j, _, s in found.scores if j == i]
            if own:
                rows.append((node, i, *asdict(some).values(), len(own), sum(own) / len(own)))
    kinds = "top_k int, scale boolean, kind string, c double, max_iter int, n_trees int, max_depth int, impurity string"
    kinds += ", max_features string, min_rows int, balanced boolean"
    return spark.createDataFrame(rows, f"node string, setting int, {kinds}, n_folds int, mean_test_score double")


@dataclass
class TaskResult:
    """A trained task: its model, the scores of the settings, the probes of each part, the metrics."""

    model: NodeModel
    scores: DataFrame
    chosen: DataFrame
    summary: DataFrame


def train_task(
    m: DataFrame,
    cohort: DataFrame,
    settings: Sequence[Settings],
    score: str = "f1_macro",
    calibration: str | None = None,
    seed: int = SEED,
) -> TaskResult:
    """Train one classifier on ``sample_id, class, split`` (train, val, test).

    The smallest training class gives the number of folds, two to five.  Where it has one
    sample the settings are scored on the validation rows, the first of equally good ones
    kept.  The summary has the metrics of the validation and the test rows.
    """
    spark = m.sparkSession
    cohort = store(cohort.select("sample_id", "class", "split"), "task-cohort")
    training = cohort.where("split = 'train'")
    plan = adaptive_folds(training, "class").first()
    dealt = node_folds(
        training.select(F.lit(_TASK).alias("node"), "sample_id", "class"), 0.0, plan["n_splits"], seed
    )
    rest = cohort.where("split != 'train'").select(
        F.lit(_TASK).alias("node"), "sample_id", "class", F.lit(None).cast("int").alias("fold")
    )
    sizes = [s.top_k for s in settings]
    held = FoldedCohorts(m, dealt.unionByName(rest), None if None in sizes else max(sizes), False)
    # Stored with their split: every fit reads the rows several times.
    rows = held.rows(_TASK, cohort.select("sample_id", "split"))

    def part(model: NodeModel, split: str) -> DataFrame:
        return _called(model, rows.where(F.col("split") == split).vectors(model.features))

    if plan["strategy"] == "cross_validation":
        found = search_node(held, _TASK, settings, score, calibration, seed=seed, rows=rows)
    else:
        tried = []
        for some in settings:
            features = held.features(_TASK, ALL_FOLDS, some.top_k)
            vectors = rows.vectors(features)
            model = fit(vectors.where("split = 'train'"), features, some, _TASK, seed)
            tried.append((_score(model, vectors.where("split = 'val'"), score), model))
        values = [v for v, _ in tried]
        model = tried[values.index(max(values))][1]
        model.metrics["cv_best"] = max(values)
        found = Searched(model, [(i, ALL_FOLDS, v) for i, v in enumerate(values)])
    summary = metrics_summary(
        part(found.model, "val"), part(found.model, "test"), found.model.metrics.get("cv_best")
    )
    return TaskResult(found.model, score_table(spark, {_TASK: found}, settings), held.chosen, summary)


def node_cohorts(
    design: DataFrame, test_size: float = 0.2, seed: int = SEED, folds: int | None = None
) -> DataFrame:
    """``node, sample_id, class, fold`` of all trainable nodes; ``node`` is the path's key."""
    ready = design_ops.trainable_nodes(design).where("trainable").select("node_path")
    key = F.array_join(F.transform("node_path", lambda x: F.replace(x, F.lit("/"), F.lit("//"))), "/")
    rows = design.where(F.col("class") != design_ops.OTHER_CLASS).join(ready, "node_path", "left_semi")
    return node_folds(rows.select(key.alias("node"), "sample_id", "class"), test_size, folds, seed)


def train_nodes(
    m: DataFrame,
    design: DataFrame,
    settings: Sequence[Settings],
    calibration: str | None = None,
    parallel: int = 4,
    seed: int = SEED,
    score: str = "f1_macro",
    test_size: float = 0.2,
    folds: int | None = None,
) -> list[NodeModel]:
    """Search, fit, calibrate and hold-out test every trainable node of a design.

    Measurements are read for the probes that lack a value, for the scores of all nodes and
    for the arrays, whatever the number of nodes.  Each model keeps its held-out samples as
    ``held_out``, a frame of ``sample_id, class``.
    """
    cohort = store(node_cohorts(design, test_size, seed, folds), "cohorts")
    paths = {path_key(r["node_path"]): list(r["node_path"]) for r in design.select("node_path").distinct().collect()}
    nodes = [r["node"] for r in cohort.select("node").distinct().orderBy("node").collect()]
    if not nodes:
        return []
    sizes = [s.top_k for s in settings]
    # The probes that all samples have are found once: two passes over the measurements use them.
    kept = store(complete_probes(m), "complete-probes")
    whole = m.join(small_side(kept), "probe_id", "left_semi")
    held = FoldedCohorts(whole, cohort, None if None in sizes else max(sizes), True)

    def one(node: str) -> NodeModel | None:
        if (node, ALL_FOLDS) not in held.lists:
            return None  # no probe that all its samples have
        rows = held.rows(node)
        model = search_node(
            held, node, settings, score, calibration, paths[node][-1], seed, rows, fits
        ).model
        calls = _called(model, rows.where("fold IS NULL").vectors(model.features))
        kept = {k: v for k, v in core_metrics(calls).first().asDict().items() if v is not None}
        model.metrics = {**model.metrics, **kept}
        model.held_out = held.cohort.where((F.col("node") == node) & F.col("fold").isNull()).select("sample_id", "class")
        return replace(model, path=tuple(paths[node]))

    with ThreadPoolExecutor(max(1, parallel)) as pool, ThreadPoolExecutor(max(1, parallel)) as fits:
        return [x for x in pool.map(one, nodes) if x is not None]
