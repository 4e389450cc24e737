"""Seeded splits, hold-outs and folds.

Random order is the order of a seeded digest of the id: equal on every run and
cluster, and independent of how the rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cpgspark.operators.tree import prefixes
from cpgspark.plans.ordering import seeded_rank

SEED = 42
RATIOS = (0.7, 0.15, 0.15)


def _check_ratios(ratios: Sequence[float]) -> None:
    if abs(sum(ratios) - 1.0) >= 1e-6:
        raise ValueError("ratios must sum to 1")


def _share(size: Column, ratio: float) -> Column:
    return F.floor(size.cast("double") * F.lit(float(ratio)))


def split_ids(
    ids: DataFrame, id_col: str, ratios: Sequence[float] = RATIOS, seed: int = SEED
) -> DataFrame:
    """``id, split`` with splits train, val, test; train is never empty."""
    _check_ratios(ratios)
    ranked = seeded_rank(ids.select(id_col), id_col, seed)
    n = F.col("group_size")
    n_train = F.greatest(F.lit(1), _share(n, ratios[0]))
    n_val = _share(n, ratios[1])
    split = (
        F.when(F.col("rank") <= n_train, "train")
        .when(F.col("rank") <= n_train + n_val, "val")
        .otherwise("test")
    )
    return ranked.select(id_col, split.alias("split"))


def random_holdout(
    ids: DataFrame, id_col: str, test_size: float = 0.2, seed: int = SEED
) -> DataFrame:
    """``id, split`` with train and test; the test size is rounded up."""
    ranked = seeded_rank(ids.select(id_col), id_col, seed)
    n_test = F.ceil(F.col("group_size").cast("double") * F.lit(float(test_size)))
    return ranked.select(
        id_col, F.when(F.col("rank") <= n_test, "test").otherwise("train").alias("split")
    )


def split_manifest(
    assignments: DataFrame,
    id_col: str,
    ratios: Sequence[float] = RATIOS,
    seed: int = SEED,
) -> DataFrame:
    """Counts, ratios, seed and id lists of a split.

    The id lists are cut into 256 parts per split by digest (``split, part, ids``),
    so no row holds the ids of a whole split.  Counts and settings repeat per row.
    """
    _check_ratios(ratios)
    counts = assignments.groupBy("split").agg(F.count(F.lit(1)).alias("n_ids"))
    part = F.substring(F.md5(F.col(id_col).cast("string")), 1, 2).alias("part")
    lists = assignments.groupBy("split", part).agg(
        F.sort_array(F.collect_list(F.col(id_col).cast("string"))).alias("ids")
    )
    total = Window.partitionBy()
    sizes = counts.withColumn("total", F.sum("n_ids").over(total))
    return lists.join(sizes, "split").select(
        "split",
        "part",
        "n_ids",
        "total",
        F.array(*[F.lit(float(r)) for r in ratios]).alias("ratios"),
        F.lit(seed).alias("seed"),
        F.lit(id_col).alias("id_col"),
        "ids",
    )


def manifest_counts(assignments: DataFrame) -> DataFrame:
    """One row: the number of ids in all and in each split."""

    def size(name: str) -> Column:
        return F.count(F.when(F.col("split") == name, 1)).alias(name)

    return assignments.agg(
        F.count(F.lit(1)).alias("total"), size("train"), size("val"), size("test")
    )


MANIFEST_SCHEMA = (
    "input_csv string, ratios array<double>, seed int, id_col string, "
    "counts struct<total:int,train:int,val:int,test:int>, "
    "ids struct<train:array<string>,val:array<string>,test:array<string>>"
)


def manifest_assignments(manifest_json: DataFrame, json_col: str = "value") -> DataFrame:
    """``sample_id, split`` out of stored manifest documents (one JSON per row)."""
    doc = manifest_json.select(F.from_json(json_col, MANIFEST_SCHEMA).alias("doc"))
    lists = F.create_map(
        F.lit("train"), F.col("doc.ids.train"),
        F.lit("val"), F.col("doc.ids.val"),
        F.lit("test"), F.col("doc.ids.test"),
    )
    return doc.select(F.explode(lists).alias("split", "ids")).select(
        F.explode("ids").alias("sample_id"), "split"
    )


def apply_assignments(rows: DataFrame, assignments: DataFrame, id_col: str) -> DataFrame:
    """Attach stored split names by id; rows without one drop out."""
    stored = assignments.select(F.col("sample_id").alias("__id"), "split")
    return rows.join(stored, F.col(id_col).cast("string") == F.col("__id")).drop("__id")


def tree_holdout(
    tree_samples: DataFrame, nodes: DataFrame, ratio: float = 0.2, seed: int = SEED
) -> DataFrame:
    """``node_path, sample_id, role`` for every node of the tree.

    Each leaf holds out ``max(1, floor(n * ratio))`` samples; an inner node takes
    what its leaves took.  Samples attached to inner nodes take no part.
    """
    inner = nodes.filter(F.size("node_path") > 1).select(
        F.expr("slice(node_path, 1, size(node_path) - 1)").alias("node_path")
    )
    at_leaves = tree_samples.select("node_path", "sample_id").join(
        inner.distinct(), "node_path", "left_anti"
    )
    ranked = seeded_rank(at_leaves, "sample_id", seed, ["node_path"])
    n_val = F.greatest(F.lit(1), _share(F.col("group_size"), ratio))
    role = F.when(F.col("rank") <= n_val, "validation").otherwise("training")
    return ranked.select(
        F.explode(prefixes(F.col("node_path"))).alias("node_path"), "sample_id", role.alias("role")
    )


def stratified_holdout(
    tree_samples: DataFrame,
    nodes: DataFrame,
    test_size: float = 0.2,
    min_per_class: int = 2,
    seed: int = SEED,
) -> DataFrame:
    """``node_path, sample_id, class`` held out at each node, by class share.

    A child with samples of its own stands for those only, else for its subtree.
    A sample under two children counts for the last.  The number held out is the
    node's size times ``test_size`` rounded up, shared among the classes by largest
    remainder.  Nodes that cannot give each class a held-out and a kept sample are
    left out.
    """
    own = tree_samples.select(F.col("node_path").alias("child_path")).distinct()
    size = F.size("node_path")
    closure = tree_samples.select(
        "sample_id",
        size.alias("depth"),
        F.explode(F.expr("filter(sequence(1, size(node_path)), i -> i > 1)")).alias("i"),
        "node_path",
    ).select(
        "sample_id",
        F.expr("slice(node_path, 1, i)").alias("child_path"),
        (F.col("depth") == F.col("i")).alias("direct"),
    )
    with_own = own.withColumn("has_own", F.lit(True))
    counted = closure.join(with_own, "child_path", "left").filter(
        F.col("direct") | F.col("has_own").isNull()
    )
    ordered = counted.join(
        nodes.select(F.col("node_path").alias("child_path"), "order_path"), "child_path"
    ).select(
        F.expr("slice(child_path, 1, size(child_path) - 1)").alias("node_path"),
        F.element_at("child_path", -1).alias("class"),
        "order_path",
        "sample_id",
    )
    listed = ordered.groupBy("node_path", "class").agg(F.count(F.lit(1)).alias("listed"))
    last = ordered.groupBy("node_path", "sample_id").agg(
        F.max_by("class", "order_path").alias("class")
    )
    valid = last.join(
        listed.filter(F.col("listed") >= min_per_class).select("node_path", "class"),
        ["node_path", "class"],
        "left_semi",
    )
    # Bounded frame from here: one row per (node, class).
    per_class = valid.groupBy("node_path", "class").agg(F.count(F.lit(1)).alias("n"))
    node = Window.partitionBy("node_path")
    sized = (
        per_class.withColumn("total", F.sum("n").over(node))
        .withColumn("classes", F.count(F.lit(1)).over(node))
        .withColumn("held", F.ceil(F.col("total").cast("double") * F.lit(float(test_size))))
        .filter("classes > 1 AND held >= classes AND total - held >= classes")
        .withColumn("exact", F.col("n") * F.col("held") / F.col("total"))
        .withColumn("base", F.floor("exact"))
        .withColumn("spare", F.col("held") - F.sum("base").over(node))
        .withColumn(
            "place",
            F.row_number().over(
                node.orderBy(F.round(F.col("exact") - F.col("base"), 9).desc(), "class")
            ),
        )
        .withColumn("quota", F.col("base") + (F.col("place") <= F.col("spare")).cast("long"))
    )
    ranked = seeded_rank(valid, "sample_id", seed, ["node_path", "class"])
    return (
        ranked.join(sized.select("node_path", "class", "quota"), ["node_path", "class"])
        .filter(F.col("rank") <= F.col("quota"))
        .select("node_path", "sample_id", "class")
    )


def stratified_folds(
    labelled: DataFrame, id_col: str, label_col: str, k: int = 3, seed: int = SEED
) -> DataFrame:
    """Adds ``fold`` in 0..k-1, each class dealt out evenly."""
    ranked = seeded_rank(labelled, id_col, seed, [label_col])
    fold = F.pmod(F.col("rank") - 1, F.lit(k)).cast("int")
    return ranked.withColumn("fold", fold).drop("rank", "group_size")


def node_folds(
    cohort: DataFrame, test_size: float = 0.0, folds: int | None = None, seed: int = SEED
) -> DataFrame:
    """``node, sample_id, class, fold``: each node's samples dealt to folds, class by class.

    A share ``test_size`` of each node, rounded up, is held out: its fold is null.  A node has
    ``folds`` folds, or, without it, as many as its smallest class has samples, two to five.
    """
    held = seeded_rank(cohort.select("node", "sample_id", "class"), "sample_id", seed, ["node"])
    n_test = F.ceil(F.col("group_size").cast("double") * F.lit(float(test_size)))
    held = held.select("node", "sample_id", "class", (F.col("rank") <= n_test).alias("test"))
    ranked = seeded_rank(held.where(~F.col("test")), "sample_id", seed, ["node", "class"])
    smallest = Window.partitionBy("node")  # one row per class
    sizes = ranked.groupBy("node", "class").agg(F.first("group_size").alias("n"))
    count = F.lit(folds) if folds else F.least(F.lit(5), F.greatest(F.lit(2), F.min("n").over(smallest)))
    sizes = sizes.select("node", "class", count.alias("folds"))
    fold = F.pmod(F.col("rank") - 1, F.col("folds")).cast("int")
    dealt = ranked.join(sizes, ["node", "class"]).select("node", "sample_id", "class", fold.alias("fold"))
    return dealt.unionByName(
        held.where("test").select("node", "sample_id", "class", F.lit(None).cast("int").alias("fold"))
    )


def adaptive_folds(labelled: DataFrame, label_col: str) -> DataFrame:
    """One row: smallest class, number of folds, and how settings are chosen."""
    smallest = labelled.groupBy(label_col).count().agg(F.min("count").alias("min_count"))
    k = F.least(F.lit(5), F.greatest(F.lit(2), F.col("min_count")))
    strategy = F.when(F.col("min_count") >= 2, "cross_validation").otherwise("validation_set")
    return smallest.select("min_count", k.cast("int").alias("n_splits"), strategy.alias("strategy"))


def split_profile(m: DataFrame) -> DataFrame:
    """Per split: number of probes, mean of probe means, mean of probe deviations."""
    per_probe = m.groupBy("split", "probe_id").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
    return per_probe.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_numeric_cols"),
        F.avg("mean").alias("mean_of_means"),
        F.avg("std").alias("mean_of_stds"),
    )


def split_row_counts(assigned: DataFrame) -> DataFrame:
    """Rows per split, without touching values."""
    return assigned.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
