"""Training sets: labels joined to samples, one design per tree node."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cpgspark.functions.identifiers import join_key
from cpgspark.operators.qc import drop_incomplete_probes, drop_incomplete_samples
from cpgspark.operators.tree import prefixes

# Class name of unassigned samples and the size gates.
OTHER_CLASS = "otherCancerType"
MIN_CHILD_SAMPLES = 3
MIN_NODE_SAMPLES = 10


def label_join(
    samples: DataFrame, labels: DataFrame, id_col: str = "biosample_id", label_col: str = "label"
) -> DataFrame:
    """Add the label by trimmed, upper-cased id; samples without one drop out."""
    keyed = samples.withColumn(id_col, join_key(F.col(id_col)))
    named = labels.filter(F.col(label_col).isNotNull()).select(
        join_key(F.col(id_col)).alias(id_col), F.col(label_col).cast("string").alias(label_col)
    )
    return keyed.join(named, id_col)


def node_design(
    nodes: DataFrame,
    tree_samples: DataFrame,
    measured: DataFrame | None = None,
    min_child_samples: int = MIN_CHILD_SAMPLES,
) -> DataFrame:
    """``node_path, sample_id, class`` for every node and every sample below it.

    The class is the direct child that contains the sample, if that child's subtree
    holds at least ``min_child_samples`` (the last such child in order, where there
    are several), else the fixed name for other.  ``measured`` restricts the result
    to samples with data; the child sizes are those of the whole tree.
    """
    steps = tree_samples.select(
        "sample_id",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("node_path")),
                lambda i: F.struct(
                    F.slice("node_path", F.lit(1), i).alias("node_path"),
                    F.when(
                        i < F.size("node_path"), F.slice("node_path", F.lit(1), i + 1)
                    ).alias("child_path"),
                ),
            )
        ).alias("s"),
    ).select("sample_id", "s.node_path", "s.child_path")

    direct = tree_samples.groupBy("node_path").agg(F.count(F.lit(1)).alias("n"))
    big = (
        direct.select(F.explode(prefixes(F.col("node_path"))).alias("child_path"), "n")
        .groupBy("child_path")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= min_child_samples)
        .join(nodes.select(F.col("node_path").alias("child_path"), "order_path"), "child_path")
        .select("child_path", "order_path")
    )
    if measured is not None:
        steps = steps.join(measured.select("sample_id").distinct(), "sample_id", "left_semi")
    named = steps.join(big, "child_path", "left")
    child = F.when(F.col("order_path").isNotNull(), F.element_at("child_path", -1))
    return named.groupBy("node_path", "sample_id").agg(
        F.coalesce(F.max_by(child, "order_path"), F.lit(OTHER_CLASS)).alias("class")
    )


def trainable_nodes(
    design: DataFrame, min_samples: int = MIN_NODE_SAMPLES, keep_other: bool = False
) -> DataFrame:
    """Per node: sizes, whether a model can be trained, and the reason if not.

    ``keep_other`` counts samples of no child as samples and as a class.
    """
    counted = F.lit(True) if keep_other else F.col("class") != OTHER_CLASS
    sizes = design.groupBy("node_path").agg(
        F.count(F.when(counted, 1)).alias("n_samples"),
        F.countDistinct(F.when(counted, F.col("class"))).alias("n_classes"),
    )
    reason = F.when(F.col("n_samples") < min_samples, "too few samples").when(
        F.col("n_classes") < 2, "only one subgroup"
    )
    return sizes.withColumn("reason", reason).withColumn("trainable", reason.isNull())


def _gated(design: DataFrame, min_samples: int, keep_other: bool) -> DataFrame:
    ready = trainable_nodes(design, min_samples, keep_other).filter("trainable")
    return design.join(ready.select("node_path"), "node_path", "left_semi")


def node_dataset(
    m: DataFrame, design: DataFrame, path: list[str], min_samples: int = MIN_NODE_SAMPLES
) -> DataFrame:
    """Measurements and class of one node's cohort; empty if the node is rejected.

    Probes that any sample lacks are dropped over the whole table first and over
    the cohort again.  Samples of no child are left out.
    """
    here = F.array(*[F.lit(p) for p in path])
    cohort = _gated(design.filter(F.col("node_path") == here), min_samples, False)
    cohort = cohort.filter(F.col("class") != OTHER_CLASS)
    rows = drop_incomplete_probes(m).join(cohort.select("sample_id", "class"), "sample_id")
    return drop_incomplete_probes(rows)


def node_dataset_all(
    m: DataFrame, design: DataFrame, path: list[str], min_samples: int = MIN_NODE_SAMPLES
) -> DataFrame:
    """Variant that keeps the samples of no child and drops incomplete samples."""
    here = F.array(*[F.lit(p) for p in path])
    cohort = _gated(design.filter(F.col("node_path") == here), min_samples, True)
    rows = m.join(cohort.select("sample_id", "class"), "sample_id")
    return drop_incomplete_samples(rows)
