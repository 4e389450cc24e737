"""Disease-tree queries over two flat tables.

``nodes``: ``node_path array<string>, name, parent_path, level, order_path``; the
root has level 1.  ``tree_samples``: ``node_path, sample_id``.  Names may repeat in
the tree, so the key is the path.  Sorting by ``order_path`` is pre-order, because
a path sorts before its extensions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from cpgspark.plans.durable import store

ROOT = "ROOT"


def prefixes(path: Column) -> Column:
    """All ancestors of a node and the node itself, as paths."""
    return F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.slice(path, F.lit(1), i))


def expand_edges(edges: DataFrame, root: str = ROOT) -> DataFrame:
    """Every node reachable from the root, one row per path.

    ``edges`` holds ``parent, child`` and optionally ``ordinal``, the place among
    the siblings; without it siblings go by name.  A cycle that the root reaches is
    refused.

    The walk doubles its reach: known walks of fewer than n edges, each followed by every
    segment of exactly n edges, give those of n to 2n - 1.  A tree of any depth takes
    as many steps as its depth has binary digits.
    """
    columns = "parent, child, " + ("ordinal" if "ordinal" in edges.columns else "child AS ordinal")
    typed = edges.selectExpr(*[c.strip() for c in columns.split(",")]).distinct()
    kind = dict(typed.dtypes)["ordinal"]
    segments = store(
        typed.select(
            F.col("parent").alias("start"),
            F.col("child").alias("end"),
            F.array("child").alias("names"),
            F.array("ordinal").alias("places"),
        ),
        "segments",
    )
    known = edges.sparkSession.range(1).select(
        F.array(F.lit(root)).alias("node_path"),
        F.lit(root).alias("name"),
        F.array().cast(f"array<{kind}>").alias("order_path"),
    )
    while True:
        longer = store(_followed(known, segments), "walk")
        if longer.isEmpty():
            break
        again = longer.filter(F.size(F.array_distinct("node_path")) < F.size("node_path")).first()
        if again is not None:
            raise ValueError(f"edges form a cycle at {again['name']}: RECURSION without end")
        known = known.unionByName(longer)
        segments = store(_doubled(segments), "segments")
    size = F.size("node_path")
    parent = F.when(size > 1, F.slice("node_path", F.lit(1), size - 1))
    return known.select(
        "node_path", "name", parent.alias("parent_path"), size.alias("level"), "order_path"
    )


def _followed(known: DataFrame, segments: DataFrame) -> DataFrame:
    """Each known walk, continued by each segment that starts where it ends."""
    return known.join(segments, F.col("name") == F.col("start")).select(
        F.concat("node_path", "names").alias("node_path"),
        F.col("end").alias("name"),
        F.concat("order_path", "places").alias("order_path"),
    )


def _doubled(segments: DataFrame) -> DataFrame:
    """Segments of twice the length; only the last name may be one passed before.

    A walk that first closes a cycle at its end thus keeps its last segment, and cycles out
    of the root's reach do not grow.
    """
    ahead = segments.select(
        F.col("start").alias("end"), F.col("end").alias("far"), F.col("names").alias("more"),
        F.col("places").alias("further"),
    )
    names = F.concat("names", "more")
    passed = F.concat(F.array("start"), F.slice(names, F.lit(1), F.size(names) - 1))
    return (
        segments.join(ahead, "end")
        .filter(F.size(F.array_distinct(passed)) == F.size(passed))
        .select(
            "start", F.col("far").alias("end"), names.alias("names"),
            F.concat("places", "further").alias("places"),
        )
    )


def attach_samples(nodes: DataFrame, samples: DataFrame) -> DataFrame:
    """Put each sample at every node that bears its disease name."""
    return samples.join(
        nodes.select("node_path", F.col("name").alias("diseaseName")), "diseaseName"
    ).select("node_path", "sample_id")


def build_tree(
    edges: DataFrame, samples: DataFrame, root: str = ROOT
) -> tuple[DataFrame, DataFrame]:
    """``(nodes, tree_samples)``; a node stays if its subtree holds a sample.

    The walk down the edges runs once and is stored: the tree is a small table that
    every later step joins, and its stored size lets Spark choose the join.
    """
    nodes = store(expand_edges(edges, root), "tree")
    held = attach_samples(nodes, samples)
    # Distinct first: one row per sampled node, not per sample.
    occupied = (
        held.select("node_path")
        .distinct()
        .select(F.explode(prefixes(F.col("node_path"))).alias("node_path"))
        .distinct()
    )
    kept = nodes.join(occupied.withColumn("occupied", F.lit(True)), "node_path", "left")
    return kept.filter((F.col("level") == 1) | F.col("occupied")).drop("occupied"), held


def tree_from_labels(
    labels: DataFrame, id_col: str = "biosample_id", root: str = ROOT
) -> tuple[DataFrame, DataFrame]:
    """Root plus one child per label; null ids and labels without ids drop out."""
    missing = {id_col, "label"} - set(labels.columns)
    if missing:
        raise ValueError(f"required column is missing: {sorted(missing)}")
    path = F.array(F.lit(root), F.col("label"))
    held = (
        labels.filter(F.col(id_col).isNotNull() & F.col("label").isNotNull())
        .withColumn("label", F.col("label").cast("string"))
        .select(path.alias("node_path"), F.col(id_col).cast("string").alias("sample_id"))
    )
    leaves = held.select("node_path").distinct().select(
        "node_path",
        F.get("node_path", F.lit(1)).alias("name"),
        F.array(F.lit(root)).alias("parent_path"),
        F.lit(2).alias("level"),
        F.slice("node_path", 2, 1).alias("order_path"),
    )
    top = labels.sparkSession.range(1).select(
        F.array(F.lit(root)).alias("node_path"),
        F.lit(root).alias("name"),
        F.lit(None).cast("array<string>").alias("parent_path"),
        F.lit(1).alias("level"),
        F.array().cast("array<string>").alias("order_path"),
    )
    return top.unionByName(leaves), held


def find_node(nodes: DataFrame, name: str) -> DataFrame:
    """The first node of that name in pre-order."""
    return nodes.filter(F.col("name") == name).orderBy("order_path").limit(1)


def child_names(nodes: DataFrame, path: list[str]) -> DataFrame:
    """Direct children of one node."""
    here = F.array(*[F.lit(p) for p in path])
    return nodes.filter(F.col("parent_path") == here).select("name", "order_path")


def ancestor_closure(tree_samples: DataFrame) -> DataFrame:
    """Each sample once per node on its path, with the node where it sits."""
    return tree_samples.select(
        F.explode(prefixes(F.col("node_path"))).alias("node_path"),
        F.col("node_path").alias("sample_path"),
        *[c for c in tree_samples.columns if c != "node_path"],
    )


def samples_recursive(tree_samples: DataFrame, role: str = "all") -> DataFrame:
    """``node_path, sample_id`` of each node and its descendants, as a bag.

    ``role`` is all, training or validation.  For the latter two the input is a
    table with a ``role`` column that says where each sample was stored.
    """
    if role not in ("all", "training", "validation"):
        raise ValueError(f"unknown sample role: {role}")
    rows = tree_samples if role == "all" else tree_samples.filter(F.col("role") == role)
    return ancestor_closure(rows).select("node_path", "sample_id")


def nodes_at_level(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes at a level; the root is level 1."""
    return nodes.filter(F.col("level") == level)


def nodes_at_depth(nodes: DataFrame, depth: int) -> DataFrame:
    """Names at a depth; the root is depth 0.  A negative depth has none."""
    return nodes.filter(F.col("level") - 1 == depth).select("name", "order_path")


def samples_at_level(tree_samples: DataFrame, level: int, below: list[str] | None = None) -> DataFrame:
    """``sample_id, cancerType``: the ancestor at that level names the type.

    ``below`` makes a node the root of the count.  Samples attached above the level
    are left out.  The path itself holds the answer, so nothing is joined.
    """
    rows = tree_samples
    shift = 0
    if below is not None:
        here = F.array(*[F.lit(p) for p in below])
        rows = rows.filter(F.slice("node_path", 1, len(below)) == here)
        shift = len(below) - 1
    at = level + shift
    return rows.filter(F.size("node_path") >= at).select(
        "sample_id", F.get("node_path", F.lit(at - 1)).alias("cancerType")
    )


def find_sample(tree_samples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Path from the root to the first node, in pre-order, that holds the sample."""
    placed = tree_samples.join(nodes.select("node_path", "order_path"), "node_path")
    first = placed.groupBy("sample_id").agg(F.min_by("node_path", "order_path").alias("node_path"))
    return first.withColumn("node_name", F.element_at("node_path", -1))


def tree_edges(nodes: DataFrame, tree_samples: DataFrame) -> DataFrame:
    """``parent, child, n_samples`` with the sample count of the child's subtree."""
    direct = tree_samples.groupBy("node_path").agg(F.count(F.lit(1)).alias("n"))
    counts = (
        direct.select(F.explode(prefixes(F.col("node_path"))).alias("node_path"), "n")
        .groupBy("node_path")
        .agg(F.sum("n").alias("n"))
    )
    return (
        nodes.filter("level > 1")
        .join(counts, "node_path", "left")
        .select(
            F.element_at("parent_path", -1).alias("parent"),
            F.col("name").alias("child"),
            F.coalesce("n", F.lit(0)).alias("n_samples"),
        )
    )


def delete_node(nodes: DataFrame, name: str) -> DataFrame:
    """Without every node of that name and all below it."""
    return nodes.filter(~F.array_contains("node_path", name))


def preorder_nodes(nodes: DataFrame, tree_samples: DataFrame | None = None) -> DataFrame:
    """Depth-first list; given samples, only nodes that hold some themselves."""
    if tree_samples is not None:
        nodes = nodes.join(tree_samples.select("node_path").distinct(), "node_path", "left_semi")
    return nodes.orderBy("order_path")


def preorder_window() -> WindowSpec:
    """Window over the nodes of one tree in pre-order, to number them."""
    return Window.orderBy("order_path")


def leaves(nodes: DataFrame, tree_samples: DataFrame) -> DataFrame:
    """Nodes without children that hold at least one sample."""
    parents = nodes.filter(F.col("parent_path").isNotNull()).select(
        F.col("parent_path").alias("node_path")
    )
    return nodes.join(parents.distinct(), "node_path", "left_anti").join(
        tree_samples.select("node_path").distinct(), "node_path", "left_semi"
    )
