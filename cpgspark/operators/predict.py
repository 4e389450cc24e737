"""Classify samples down the tree of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cpgspark.operators.metrics import class_report
from cpgspark.operators.train import NodeModel, key_part, path_key
from cpgspark.operators.tree import samples_at_level
from cpgspark.operators.vectors import pick, sample_arrays, sample_vectors
from cpgspark.plans.durable import store

STEPS = (
    "sample_id string, depth int, model_name string, prediction string, probability double"
)


def predict_tree(
    m: DataFrame, samples: DataFrame, models: dict[str, NodeModel], root: str
) -> DataFrame:
    """``sample_id, depth, model_name, prediction, probability``: every step.

    ``models`` has a model for each :func:`path_key`; names may repeat in a tree, paths do
    not.  The measurements are read once, cut to the samples and to the features of all
    models, one stored array per sample; each model picks its places.  All samples move
    down together, one level per round, and every level lengthens the path, so the rounds
    end with the deepest model.  A sample stops where the predicted class has no model or
    is the model's own name; one without measurements is left out.  A model without class
    probabilities gives null.
    """
    spark = m.sparkSession
    active = {(root,)} & {x.path for x in models.values()}
    if not active:
        return spark.createDataFrame([], STEPS)
    by_path = {x.path: x for x in models.values()}
    names = sorted({f for x in models.values() for f in x.features})
    wanted = samples.select("sample_id").distinct()
    arrays = store(
        sample_arrays(m.join(wanted, "sample_id", "left_semi"), names), "arrays"
    )
    frontier = wanted.select("sample_id", F.lit(path_key([root])).alias("key"))
    levels: list[DataFrame] = []
    while active:
        steps = None
        for path in sorted(active):
            model = by_path[path]
            mine = frontier.filter(F.col("key") == path_key(path)).select("sample_id")
            rows = arrays.join(mine, "sample_id", "left_semi")
            calls = model.predict(pick(rows, names, model.features))
            known = "probability" in calls.columns
            part = calls.select(
                "sample_id",
                F.lit(len(levels) + 1).alias("depth"),
                F.lit(model.name).alias("model_name"),
                "prediction",
                (F.col("probability") if known else F.lit(None).cast("double")).alias("probability"),
                F.concat(F.lit(path_key(path) + "/"), key_part(F.col("prediction"))).alias("key"),
            )
            steps = part if steps is None else steps.unionByName(part)
        done = store(steps, f"level-{len(levels) + 1}")
        levels.append(done)
        frontier = done.filter(F.col("prediction") != F.col("model_name")).select("sample_id", "key")
        onward = {(*p, c) for p in active for c in by_path[p].classes if c != by_path[p].name}
        active = onward & set(by_path)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.drop("key")


def final_prediction(steps: DataFrame) -> DataFrame:
    """The last class reached by each sample."""
    return steps.groupBy("sample_id").agg(
        F.max_by("prediction", "depth").alias("final_prediction")
    )


def predictions_map(steps: DataFrame) -> DataFrame:
    """One nested value per sample: model name to prediction and probability."""
    entry = F.struct(
        F.col("model_name").alias("key"),
        F.struct("prediction", "probability").alias("value"),
    )
    # As many entries as the tree has levels.
    return steps.groupBy("sample_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("predictions")
    )


def predict_binary(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Positive probability and 0/1 label from ``scores`` (two entries)."""
    p = F.get("scores", F.lit(1))
    return scored.withColumn("probability", p).withColumn(
        "label", (p >= threshold).cast("int")
    )


def validate_node(
    m: DataFrame,
    model: NodeModel,
    tree_samples: DataFrame,
    held_out: DataFrame,
    path: list[str],
) -> DataFrame:
    """Class report of one node's held-out samples against their level-2 class."""
    truth = samples_at_level(tree_samples, 2, below=path)
    rows = m.join(held_out.select("sample_id"), "sample_id", "left_semi")
    calls = model.predict(sample_vectors(rows, model.features))
    pairs = calls.join(truth, "sample_id").select(
        F.col("cancerType").alias("actual"), F.col("prediction").alias("predicted")
    )
    return class_report(pairs)
