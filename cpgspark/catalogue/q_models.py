"""Queries: model training, prediction down the tree, embedding.

Fitted models have no SQL counterpart; these queries return their result tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cpgspark.catalogue import fixtures as fx
from cpgspark.catalogue.registry import query, rounded
from cpgspark.operators import cohort, components, design, dm, metrics, predict, qc, search, splits, train
from cpgspark.operators.tree import ROOT, samples_at_level
from cpgspark.operators.vectors import feature_places, sample_arrays, sample_vectors
from cpgspark.plans.durable import store

_TREES = train.TREES[0]
_TOP = 64


def chosen_vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """``sample_id, features, class, split`` with the best probes of the training part."""
    rows = fx.labelled(spark, sf)
    parts = splits.split_ids(fx.labels(spark, sf), "sample_id")
    ids = parts.filter("split = 'train'").select("sample_id")
    training = rows.join(ids, "sample_id", "left_semi")
    features = feature_places(dm.select_k_best(dm.anova_f(training, zero_fill=True), _TOP))
    vectors = sample_vectors(fx.measurements(spark, sf), features)
    named = vectors.join(fx.labels(spark, sf), "sample_id").join(parts, "sample_id")
    return store(named, "vectors"), features


def part_of(vectors: DataFrame, name: str) -> DataFrame:
    return vectors.filter(F.col("split") == name).drop("split")


def _calls(model: train.NodeModel, rows: DataFrame) -> DataFrame:
    return model.predict(rows).select(
        F.col("class").alias("actual"), F.col("prediction").alias("predicted")
    )


@query("train_forest")
def train_forest(spark: SparkSession, sf: str) -> DataFrame:
    vectors, features = chosen_vectors(spark, sf)
    model = train.train_forest(part_of(vectors, "train"), features, n_trees=_TREES)
    val, test = (_calls(model, part_of(vectors, p)) for p in ("val", "test"))
    return metrics.metrics_summary(val, test)


@query("feature_importance")
def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    vectors, features = chosen_vectors(spark, sf)
    model = train.train_forest(part_of(vectors, "train"), features, n_trees=_TREES)
    return train.top_importance(train.feature_importance(model, spark), 30)


def _folded(spark: SparkSession, sf: str) -> DataFrame:
    """All labelled samples in three folds."""
    rows = fx.labels(spark, sf).select(F.lit("task").alias("node"), "sample_id", "class")
    return store(splits.node_folds(rows, 0.0, 3), "cohort")


#: The 20 probes of the highest F on the rows of all folds but one, and on all rows.
_FOLD_SQL = f"""WITH {fx.LM},
folds AS (SELECT sample_id, (row_number() OVER (PARTITION BY class
            ORDER BY md5('42:' || sample_id), sample_id) - 1) % 3 AS fold FROM lab),
parts AS (SELECT unnest([-1, 0, 1, 2]) AS left_out),
rows AS (SELECT left_out, probe_id, class, coalesce(value, 0) AS v
         FROM lm JOIN folds USING (sample_id) JOIN parts ON fold != left_out),
a AS (SELECT left_out, probe_id, class, count(v) AS n, avg(v) AS mu, var_pop(v) * count(v) AS m2
      FROM rows GROUP BY ALL),
g AS (SELECT left_out, probe_id, sum(n) AS n, sum(n * mu) / sum(n) AS mu, count(*) AS k, sum(m2) AS w
      FROM a GROUP BY ALL),
b AS (SELECT a.left_out, a.probe_id, sum(a.n * pow(a.mu - g.mu, 2)) AS b
      FROM a JOIN g ON g.left_out = a.left_out AND g.probe_id = a.probe_id GROUP BY ALL),
f AS (SELECT g.left_out, g.probe_id, b / (k - 1) / (w / (n - k)) AS f
      FROM g JOIN b ON g.left_out = b.left_out AND g.probe_id = b.probe_id),
p AS (SELECT *, row_number() OVER (PARTITION BY left_out ORDER BY f DESC, probe_id) AS place FROM f)
SELECT CAST(left_out AS INTEGER) AS left_out, CAST(place AS INTEGER) AS place, probe_id,
       round(f, 6) + 0.0 AS f_score FROM p WHERE place <= 20"""


@query("fold_features", _FOLD_SQL)
def fold_features(spark: SparkSession, sf: str) -> DataFrame:
    scores = dm.fold_scores(fx.measurements(spark, sf), _folded(spark, sf))
    chosen = dm.fold_features(scores, 20)
    return chosen.select("left_out", "place", "probe_id", rounded("f_score").alias("f_score"))


@query("train_task")
def train_task(spark: SparkSession, sf: str) -> DataFrame:
    """Probes chosen in every fold, the better of two settings, both metric rows."""
    parts = splits.split_ids(fx.labels(spark, sf), "sample_id")
    rows = fx.labels(spark, sf).join(parts, "sample_id")
    settings = search.grid(top_k=(_TOP // 4, _TOP), n_trees=(20,), max_depth=(10,))
    return search.train_task(fx.measurements(spark, sf), rows, settings).summary


@query("grid_search")
def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    vectors, features = chosen_vectors(spark, sf)
    _, table = train.grid_search(part_of(vectors, "train"), features)
    return table


@query("select_on_validation")
def select_on_validation(spark: SparkSession, sf: str) -> DataFrame:
    vectors, features = chosen_vectors(spark, sf)
    _, table = train.select_on_validation(
        part_of(vectors, "train"), part_of(vectors, "val"), features
    )
    return table


@query("train_linear_svm")
def train_linear_svm(spark: SparkSession, sf: str) -> DataFrame:
    vectors, features = chosen_vectors(spark, sf)
    model = train.train_linear_svm(part_of(vectors, "train"), features)
    return metrics.core_metrics(_calls(model, part_of(vectors, "val")))


def _calibrated(spark: SparkSession, sf: str, method: str) -> DataFrame:
    vectors, features = chosen_vectors(spark, sf)
    model = train.train_forest(part_of(vectors, "train"), features, n_trees=_TREES)
    scored = model.predict(part_of(vectors, "train"))
    fitted = train.calibrate(scored, model.classes, method)
    out = fitted.transform(model.predict(part_of(vectors, "val")))
    return out.select("sample_id", "class", "prediction", "probability")


@query("calibrate_sigmoid")
def calibrate_sigmoid(spark: SparkSession, sf: str) -> DataFrame:
    return _calibrated(spark, sf, "sigmoid")


@query("calibrate_isotonic")
def calibrate_isotonic(spark: SparkSession, sf: str) -> DataFrame:
    return _calibrated(spark, sf, "isotonic")


def _models(spark: SparkSession, sf: str) -> dict[str, train.NodeModel]:
    nodes, held = fx.class_tree(spark, sf)
    settings = search.grid(top_k=(_TOP,), n_trees=(10, 20), max_depth=(10,))
    return train.train_tree(
        fx.measurements(spark, sf), nodes, held, settings=settings, calibration="sigmoid", folds=2
    )


@query("train_tree")
def train_tree(spark: SparkSession, sf: str) -> DataFrame:
    return train.model_table(_models(spark, sf), spark)


@query("predict_tree")
def predict_tree(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.measurements(spark, sf)
    return predict.predict_tree(m, fx.labels(spark, sf), _models(spark, sf), ROOT)


@query("validate_node")
def validate_node(spark: SparkSession, sf: str) -> DataFrame:
    """Root model against level 2 on the samples the tree holds out."""
    m = fx.measurements(spark, sf)
    nodes, held = fx.class_tree(spark, sf)
    roles = splits.tree_holdout(held, nodes).filter(F.size("node_path") == 1)
    rows = store(design.node_design(nodes, held, m), "design")
    out = roles.filter("role = 'validation'").select("sample_id")
    model = train.train_node(
        m.join(out, "sample_id", "left_anti"), rows, [ROOT], n_trees=_TREES, top_k=_TOP
    )
    return predict.validate_node(m, model, held, out, [ROOT])


@query("refit_full")
def refit_full(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.measurements(spark, sf)
    _, held = fx.class_tree(spark, sf)
    # One stored feature is not in the data and must be passed over.
    names = [*fx.PROBES, "p99"]
    model = train.refit_full(m, samples_at_level(held, 2), ROOT, {"n_trees": _TREES}, names)
    return train.feature_importance(model, spark)


def _used(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Clean measurements and the importances of a model over all probes."""
    m = qc.clean_values(fx.measurements(spark, sf))
    _, held = fx.class_tree(spark, sf)
    model = train.refit_full(m, samples_at_level(held, 2), ROOT, {"n_trees": _TREES}, fx.PROBES)
    return m, train.feature_importance(model, spark)


@query("embed_cohort")
def embed_cohort(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.embed_cohort(*_used(spark, sf))[0]


@query("project_samples")
def project_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The test part joins an embedding of the others."""
    m, importances = _used(spark, sf)
    parts = splits.split_ids(fx.labels(spark, sf), "sample_id")
    old = parts.filter("split <> 'test'").select("sample_id")
    embedding, model, features = cohort.embed_cohort(
        m.join(old, "sample_id", "left_semi"), importances
    )
    return cohort.project_samples(embedding, m, fx.labels(spark, sf), model, features)


@query(
    "component_covariances",
    f"""WITH {fx.M}, f AS (SELECT sample_id, probe_id, coalesce(value, 0) AS value FROM m)
    SELECT a.probe_id AS probe_a, b.probe_id AS probe_b,
           round(covar_samp(a.value, b.value), 6) + 0.0 AS covariance
    FROM f a JOIN f b ON a.sample_id = b.sample_id AND a.probe_id <= b.probe_id GROUP BY 1, 2""",
)
def component_covariances(spark: SparkSession, sf: str) -> DataFrame:
    """All components together give back the covariance of every two probes."""
    arrays = store(sample_arrays(fx.measurements(spark, sf), fx.PROBES), "arrays")
    size = len(fx.PROBES)
    found = components.principal_components(arrays, size, size)
    scaled = (found.directions * found.variances) @ found.directions.T
    rows = [
        (fx.PROBES[i], fx.PROBES[j], float(scaled[i, j])) for i in range(size) for j in range(i, size)
    ]
    out = spark.createDataFrame(rows, "probe_a string, probe_b string, covariance double")
    return out.withColumn("covariance", rounded("covariance"))
