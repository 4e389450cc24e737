"""Model training per tree node with ``pyspark.ml``."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from urllib.parse import quote

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    LogisticRegressionModel,
    OneVsRest,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cpgspark.operators import design as design_ops
from cpgspark.operators.dm import anova_f, moderated_dm, restrict_to, select_k_best
from cpgspark.operators.forests import Forest
from cpgspark.operators.isotonic import block_ends, isotonic_blocks
from cpgspark.operators.metrics import core_metrics, one_vs_rest_scores, roc_auc
from cpgspark.operators.splits import SEED, random_holdout, stratified_folds
from cpgspark.operators.vectors import class_weights, feature_places, sample_vectors
from cpgspark.plans.durable import store

TREES = (200, 400)
#: Spark's deepest tree; a forest is otherwise not limited in depth.
MAX_DEPTH = 30
SCORES = ("f1_macro", "accuracy", "roc_auc")


def path_key(path: Sequence[str]) -> str:
    """A node's path as one text; slashes inside names are doubled."""
    return "/".join(name.replace("/", "//") for name in path)


def key_part(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("//"))


@dataclass
class NodeModel:
    """A fitted classifier of one node: its features, its classes, its model.

    ``path`` leads from the root to the node; names repeat in a tree, paths do not.
    """

    name: str
    features: list[str]
    classes: list[str]
    model: Model
    metrics: dict[str, float] = field(default_factory=dict)
    path: tuple[str, ...] = ()
    calibrator: Calibrator | None = None
    held_out: DataFrame | None = None

    def __post_init__(self) -> None:
        self.path = tuple(self.path) or (self.name,)

    def predict(self, vectors: DataFrame) -> DataFrame:
        """``sample_id, prediction, probability, scores`` (scores in class order)."""
        if self.calibrator is not None:
            return self.calibrator.transform(replace(self, calibrator=None).predict(vectors))
        out = self.model.transform(vectors)
        names = F.array(*[F.lit(c) for c in self.classes])
        kept = [c for c in vectors.columns if c != "features"]
        called = F.get(names, F.col("prediction").cast("int"))
        if "probability" not in out.columns:
            return out.select(*kept, called.alias("prediction"))
        scores = vector_to_array("probability")
        return out.select(
            *kept,
            called.alias("prediction"),
            F.get(scores, F.col("prediction").cast("int")).alias("probability"),
            scores.alias("scores"),
        )


def _indexed(
    vectors: DataFrame, counted: dict[str, int] | None = None
) -> tuple[Model, list[str]]:
    """Classes in the order of code points; those of ``counted``, where they are known."""
    if counted:
        classes = sorted(counted)
        return StringIndexerModel.from_labels(classes, inputCol="class", outputCol="label"), classes
    indexer = StringIndexer(inputCol="class", outputCol="label", stringOrderType="alphabetAsc")
    fitted = indexer.fit(vectors)
    return fitted, list(fitted.labels)


def forest(
    n_trees: int, max_depth: int, seed: int, max_features: str = "sqrt", **extra: object
) -> Forest:
    return Forest(
        numTrees=n_trees,
        maxDepth=max_depth,
        seed=seed,
        weightCol="weight",
        featureSubsetStrategy=max_features,
        maxMemoryInMB=512,
        **extra,
    )


def train_forest(
    vectors: DataFrame,
    features: list[str],
    name: str = "ROOT",
    n_trees: int = TREES[0],
    max_depth: int = MAX_DEPTH,
    seed: int = SEED,
) -> NodeModel:
    """Class-weighted random forest on ``sample_id, features, class``."""
    indexer, classes = _indexed(vectors)
    weighted = indexer.transform(class_weights(vectors))
    model = forest(n_trees, max_depth, seed).fit(weighted)
    return NodeModel(name, features, classes, model)


def train_linear_svm(
    vectors: DataFrame,
    features: list[str],
    name: str = "ROOT",
    c: float = 1.0,
    max_iter: int = 50,
) -> NodeModel:
    """Linear support vector classifier, one class against the rest.

    ``c`` weighs the summed hinge loss, so the penalty on the mean is 1 / (c n).
    """
    indexer, classes = _indexed(vectors)
    rows = indexer.transform(vectors)
    svc = LinearSVC(maxIter=max_iter, regParam=1.0 / (c * rows.count()))
    model = OneVsRest(classifier=svc, parallelism=4).fit(rows)
    return NodeModel(name, features, classes, model)


def search_linear_svm(
    vectors: DataFrame,
    features: list[str],
    name: str = "ROOT",
    c: Sequence[float] = (0.1, 1.0, 10.0),
    k: int = 3,
    score: str = "accuracy",
    max_iter: int = 50,
    seed: int = SEED,
) -> tuple[NodeModel, DataFrame]:
    """Cross-validated choice of ``c``, refitted on all rows; and ``c, mean_test_score``."""
    if score == "roc_auc":
        raise ValueError("the one-against-rest classifier gives no class probabilities")
    indexer, _ = _indexed(vectors)
    folded = store(indexer.transform(stratified_folds(vectors, "sample_id", "class", k, seed)), "folds")
    fitted_rows = folded.count() * (k - 1) / k
    svc = LinearSVC(maxIter=max_iter)
    grid = ParamGridBuilder().addGrid(svc.regParam, [1.0 / (v * fitted_rows) for v in c]).build()
    search = CrossValidator(
        estimator=OneVsRest(classifier=svc),
        estimatorParamMaps=grid,
        evaluator=ClassScore(score),
        numFolds=k,
        foldCol="fold",
        parallelism=2,
    ).fit(folded)
    scores = [float(v) for v in search.avgMetrics]
    best = train_linear_svm(vectors, features, name, c[scores.index(max(scores))], max_iter)
    best.metrics["cv_best"] = max(scores)
    rows = [(float(v), s) for v, s in zip(c, scores, strict=True)]
    return best, vectors.sparkSession.createDataFrame(rows, "c double, mean_test_score double")


class ClassScore(Evaluator):
    """Macro F1, accuracy or macro one-against-rest area, for ``CrossValidator``."""

    def __init__(self, score: str = "f1_macro", classes: Sequence[str] = ()) -> None:
        super().__init__()
        if score not in SCORES:
            raise ValueError(f"unknown score: {score}")
        self.score = score
        self.classes = list(classes)

    def _evaluate(self, dataset: DataFrame) -> float:
        if self.score == "roc_auc":
            rows = dataset.select(
                F.col("class").alias("actual"), vector_to_array("probability").alias("scores")
            )
            areas = roc_auc(one_vs_rest_scores(rows, self.classes))
            return float(areas.agg(F.avg("roc_auc")).first()[0] or 0.0)
        calls = dataset.select(F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
        return float(core_metrics(calls).first()[self.score] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


def grid_search(
    vectors: DataFrame,
    features: list[str],
    name: str = "ROOT",
    n_trees: Sequence[int] = TREES,
    max_depth: Sequence[int] = (MAX_DEPTH,),
    impurity: Sequence[str] = ("gini",),
    k: int = 3,
    score: str = "f1_macro",
    seed: int = SEED,
    parallelism: int = 2,
) -> tuple[NodeModel, DataFrame]:
    """Cross-validated choice of the forest settings, refitted on all rows.

    Folds are balanced over classes.  Also returns ``n_trees, max_depth, impurity,
    mean_test_score`` of every setting.
    """
    indexer, classes = _indexed(vectors)
    folded = stratified_folds(class_weights(vectors), "sample_id", "class", k, seed)
    estimator = forest(n_trees[0], max_depth[0], seed)
    grid = (
        ParamGridBuilder()
        .addGrid(estimator.numTrees, list(n_trees))
        .addGrid(estimator.maxDepth, list(max_depth))
        .addGrid(estimator.impurity, list(impurity))
        .build()
    )
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=grid,
        evaluator=ClassScore(score, classes),
        numFolds=k,
        foldCol="fold",
        parallelism=parallelism,
    )
    # Stored once: every fold and setting reads the vectors again.
    fitted = search.fit(store(indexer.transform(folded), "folds"))
    rows = [
        (
            int(p[estimator.numTrees]),
            int(p[estimator.maxDepth]),
            str(p[estimator.impurity]),
            float(s),
        )
        for p, s in zip(grid, fitted.avgMetrics, strict=True)
    ]
    table = vectors.sparkSession.createDataFrame(
        rows, "n_trees int, max_depth int, impurity string, mean_test_score double"
    )
    best = NodeModel(name, features, classes, fitted.bestModel)
    best.metrics["cv_best"] = max(fitted.avgMetrics)
    return best, table


def select_on_validation(
    train: DataFrame,
    val: DataFrame,
    features: list[str],
    name: str = "ROOT",
    n_trees: Iterable[int] = TREES,
    score: str = "f1_macro",
    seed: int = SEED,
) -> tuple[NodeModel, DataFrame]:
    """Choice of the number of trees on a validation set, for classes too small to
    fold.  The first of equally good settings is kept."""
    best: NodeModel | None = None
    best_score, rows = -1.0, []
    for n in n_trees:
        model = train_forest(train, features, name, n, seed=seed)
        calls = model.predict(val).select(
            F.col("class").alias("actual"), F.col("prediction").alias("predicted")
        )
        value = float(core_metrics(calls).first()[score])
        rows.append((int(n), value))
        if value > best_score:
            best, best_score = model, value
    best.metrics["cv_best"] = best_score
    return best, train.sparkSession.createDataFrame(rows, "n_trees int, val_score double")


def cv_curve(results: DataFrame, score_col: str = "mean_test_score") -> DataFrame:
    """Mean score by number of trees."""
    return results.groupBy("n_trees").agg(F.avg(score_col).alias("mean_score"))


def feature_importance(model: NodeModel, spark: SparkSession) -> DataFrame:
    """``probe_id, importance`` of every feature; bounded by the feature list."""
    last = model.model.stages[-1] if isinstance(model.model, PipelineModel) else model.model
    values = last.featureImportances.toArray().tolist()
    return spark.createDataFrame(
        list(zip(model.features, values, strict=True)), "probe_id string, importance double"
    )


def top_importance(importances: DataFrame, top: int = 30) -> DataFrame:
    return importances.orderBy(F.col("importance").desc(), "probe_id").limit(top)


def used_features(importances: DataFrame) -> DataFrame:
    return importances.filter(F.col("importance") > 0)


# --- calibration ---------------------------------------------------------------


@dataclass
class Calibrator:
    """One fitted map from score to probability per class."""

    classes: list[str]
    maps: dict[str, Model]
    method: str

    def transform(self, rows: DataFrame) -> DataFrame:
        """Replace the array ``scores`` by calibrated probabilities that sum to 1."""
        spots = {c: i for i, c in enumerate(self.classes)}
        out = rows
        for i, (cls, fitted) in enumerate(self.maps.items()):
            score = F.get("scores", F.lit(spots[cls]))
            if self.method == "sigmoid":
                given = out.withColumn("__x", array_to_vector(F.array(score)))
                fitted.setFeaturesCol("__x").setProbabilityCol("__p")
                fitted.setRawPredictionCol("__raw").setPredictionCol("__y")
                done = fitted.transform(given)
                out = done.withColumn(f"__c{i}", F.get(vector_to_array("__p"), F.lit(1)))
                out = out.drop("__x", "__p", "__raw", "__y")
            else:
                given = out.withColumn("__x", score)
                fitted.setFeaturesCol("__x").setPredictionCol("__y")
                out = fitted.transform(given).withColumn(f"__c{i}", F.col("__y"))
                out = out.drop("__x", "__y")
        count = len(self.maps)
        if count == 1:
            p = F.col("__c0")
            made = F.array(1 - p, p)
        else:
            parts = [F.col(f"__c{i}") for i in range(count)]
            total = sum(parts[1:], parts[0])
            equal = F.lit(1.0 / count)
            made = F.array(*[F.when(total > 0, p / total).otherwise(equal) for p in parts])
        names = F.array(*[F.lit(c) for c in self.classes])
        out = out.withColumn("scores", made).drop(*[f"__c{i}" for i in range(count)])
        top = F.array_max("scores")
        return out.withColumn("probability", top).withColumn(
            "prediction", F.get(names, (F.array_position("scores", top) - 1).cast("int"))
        )


def calibrate(
    scored: DataFrame,
    classes: Sequence[str],
    method: str = "sigmoid",
    pool: ThreadPoolExecutor | None = None,
) -> Calibrator:
    """Fit score-to-probability maps on ``class, scores`` (array in class order).

    Each class is fitted against the rest, with ``pool`` as concurrent Spark jobs; of two
    classes only the second is.  The
    sigmoid is fitted to softened targets (n+ + 1)/(n+ + 2) and 1/(n- + 2), written
    as two weighted rows per sample; isotonic is fitted to the plain 0 and 1, which are
    pooled on the executors, so that only the ends of its blocks reach the driver.
    """
    if method not in ("sigmoid", "isotonic"):
        raise ValueError(f"unknown calibration method: {method}")
    targets = list(classes)[1:] if len(classes) == 2 else list(classes)
    spots = {c: i for i, c in enumerate(classes)}
    kept = store(scored.select("class", "scores"), "calibration")
    sizes = {r["class"]: r["count"] for r in kept.groupBy("class").count().collect()}
    total = sum(sizes.values())

    def fitted(cls: str) -> Model:
        truth = F.col("class") == cls
        rows = kept.select(truth.alias("truth"), F.get("scores", F.lit(spots[cls])).alias("score"))
        if method == "isotonic":
            ends = block_ends(isotonic_blocks(rows))
            return IsotonicRegression(
                featuresCol="score", labelCol="label", weightCol="weight"
            ).fit(ends)
        pos = sizes.get(cls, 0)
        high, low = (pos + 1.0) / (pos + 2.0), 1.0 / (total - pos + 2.0)
        target = F.when(F.col("truth"), F.lit(high)).otherwise(F.lit(low))
        both = F.array(
            F.struct(F.lit(1.0).alias("label"), target.alias("w")),
            F.struct(F.lit(0.0).alias("label"), (1 - target).alias("w")),
        )
        soft = rows.select(
            array_to_vector(F.array("score")).alias("features"), F.explode(both).alias("b")
        ).select("features", "b.label", "b.w")
        return LogisticRegression(weightCol="w", regParam=0.0, maxIter=100).fit(soft)

    each = pool.map(fitted, targets) if pool else map(fitted, targets)
    maps = dict(zip(targets, each, strict=True))
    return Calibrator(list(classes), maps, method)


# --- whole trees ---------------------------------------------------------------


def _node_features(rows: DataFrame, top_k: int | None, per_class: int | None) -> list[str]:
    if per_class is not None:
        return feature_places(moderated_dm(rows, per_class))
    return feature_places(select_k_best(anova_f(rows), top_k))


def train_node(
    m: DataFrame,
    design: DataFrame,
    path: list[str],
    n_trees: int = TREES[0],
    top_k: int | None = 5000,
    per_class: int | None = None,
    test_size: float = 0.2,
    seed: int = SEED,
) -> NodeModel | None:
    """Train and hold-out test one node; None if the node is rejected.

    Probes are chosen on the training part only: the ``top_k`` by F, or with
    ``per_class`` the best of each class by moderated statistics.
    """
    rows = store(design_ops.node_dataset(m, design, path), "node")
    cohort = rows.select("sample_id", "class").distinct()
    parts = random_holdout(cohort.select("sample_id"), "sample_id", test_size, seed)
    cohort = store(cohort.join(parts, "sample_id"), "cohort")
    fit_ids = cohort.filter("split = 'train'").select("sample_id")
    training = rows.join(fit_ids, "sample_id", "left_semi")
    features = _node_features(training, top_k, per_class)
    if not features:
        return None
    vectors = store(
        sample_vectors(rows, features).join(cohort, "sample_id"), "vectors"
    )
    model = train_forest(
        vectors.filter("split = 'train'").drop("split"), features, path[-1], n_trees, seed=seed
    )
    calls = model.predict(vectors.filter("split = 'test'")).select(
        F.col("class").alias("actual"), F.col("prediction").alias("predicted")
    )
    scores = core_metrics(calls).first().asDict()
    model.metrics = {k: v for k, v in scores.items() if v is not None}
    model.path = tuple(path)
    return model


def train_tree(
    m: DataFrame,
    nodes: DataFrame,
    tree_samples: DataFrame,
    n_trees: int = TREES[0],
    top_k: int | None = 5000,
    per_class: int | None = None,
    parallel: int = 4,
    seed: int = SEED,
    settings: Sequence[object] | None = None,
    calibration: str | None = None,
    folds: int | None = None,
) -> dict[str, NodeModel]:
    """Train every node that passes the gates; models by :func:`path_key`.

    The gates, the hold-outs, the folds and the probe scores of all nodes are one pass
    each, and the measurements are read as often as for one node; only the fits run node
    by node, as concurrent Spark jobs.  Several ``settings`` (:class:`search.Settings`) are
    chosen among by cross-validation in every node; ``calibration`` (sigmoid or isotonic)
    fits the node's probabilities to its out-of-fold scores.  With ``per_class`` the probes
    are chosen by moderated statistics, node by node.
    """
    from cpgspark.operators import search

    design = store(
        design_ops.node_design(nodes, tree_samples, m.select("sample_id")), "design"
    )
    if per_class is None:
        found = search.train_nodes(
            m,
            design,
            settings or [search.Settings(top_k=top_k, n_trees=n_trees)],
            calibration,
            parallel,
            seed,
            folds=folds,
        )
        return {path_key(x.path): x for x in found}
    ready = design_ops.trainable_nodes(design).filter("trainable").select("node_path")
    paths = [r["node_path"] for r in ready.orderBy("node_path").collect()]

    def one(path: list[str]) -> NodeModel | None:
        return train_node(m, design, path, n_trees, top_k, per_class, seed=seed)

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        fitted = list(pool.map(one, paths))
    return {path_key(f.path): f for f in fitted if f is not None}


def model_table(models: dict[str, NodeModel], spark: SparkSession) -> DataFrame:
    """One line per model: sizes and hold-out metrics."""
    rows = [
        (
            x.name,
            list(x.path),
            len(x.classes),
            len(x.features),
            x.metrics.get("accuracy"),
            x.metrics.get("f1_macro"),
            x.metrics.get("balanced_accuracy"),
        )
        for x in models.values()
    ]
    return spark.createDataFrame(
        rows,
        "model_name string, node_path array<string>, n_classes int, n_features int, accuracy double, f1_macro double, "
        "balanced_accuracy double",
    )


def refit_full(
    m: DataFrame,
    cohort: DataFrame,
    name: str,
    parameters: dict[str, int],
    feature_names: Sequence[str],
    seed: int = SEED,
) -> NodeModel:
    """Refit with stored settings on all samples of a node, features present only.

    ``cohort`` is ``sample_id, cancerType``; labels are joined by id.
    """
    listed = m.sparkSession.createDataFrame([(f,) for f in feature_names], "probe_id string")
    rows = restrict_to(m, listed)
    features = feature_places(rows)
    labels = cohort.select("sample_id", F.col("cancerType").alias("class"))
    vectors = sample_vectors(rows, features).join(labels, "sample_id")
    return train_forest(
        vectors,
        features,
        name,
        int(parameters.get("n_trees", TREES[0])),
        int(parameters.get("max_depth", MAX_DEPTH)),
        seed,
    )


def _folder(folder: str, path: Sequence[str]) -> str:
    """A folder for each path, whatever characters its names have."""
    return "/".join([folder, *(quote(name, safe="") for name in path), "@model"])


def save_model(model: NodeModel, folder: str, spark: SparkSession) -> None:
    """Write the fitted model and one metadata row below a folder of its path."""
    place = _folder(folder, model.path)
    PipelineModel([model.model]).write().overwrite().save(f"{place}/model")
    method, mapped = None, []
    if model.calibrator is not None:
        method, mapped = model.calibrator.method, list(model.calibrator.maps)
        for i, cls in enumerate(mapped):
            model.calibrator.maps[cls].write().overwrite().save(f"{place}/calibrator{i}")
    row = [
        (
            model.name, list(model.path), model.features, model.classes, json.dumps(model.metrics),
            method, mapped,
        )
    ]
    schema = (
        "name string, path array<string>, features array<string>, classes array<string>, "
        "metrics string, calibration string, calibrated array<string>"
    )
    spark.createDataFrame(row, schema).write.mode("overwrite").parquet(f"{place}/meta")


def load_model(path: Sequence[str], folder: str, spark: SparkSession) -> NodeModel:
    """The model of a node's path."""
    place = _folder(folder, path)
    meta = spark.read.parquet(f"{place}/meta").first()
    model = PipelineModel.load(f"{place}/model").stages[0]
    calibrator = None
    if meta["calibration"]:
        kind = LogisticRegressionModel if meta["calibration"] == "sigmoid" else IsotonicRegressionModel
        maps = {c: kind.load(f"{place}/calibrator{i}") for i, c in enumerate(meta["calibrated"])}
        calibrator = Calibrator(list(meta["classes"]), maps, meta["calibration"])
    return NodeModel(
        meta["name"], list(meta["features"]), list(meta["classes"]), model,
        json.loads(meta["metrics"]), tuple(meta["path"]), calibrator,
    )
