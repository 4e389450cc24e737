"""Queries: disease tree, splits, training-set design."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cpgspark.catalogue import fixtures as fx
from cpgspark.catalogue.registry import path_text, query, rounded
from cpgspark.operators import design, splits, tree

_TREE = f"WITH RECURSIVE {fx.TREE}"


def _path(df: DataFrame, *others: str) -> DataFrame:
    return df.select(path_text("node_path").alias("path"), *others)


# --- tree -------------------------------------------------------------------------


@query("build_tree", f"{_TREE} SELECT path, name, parent, level FROM nodes")
def build_tree(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = fx.disease_tree(spark, sf)
    return nodes.select(
        path_text("node_path").alias("path"),
        "name",
        path_text("parent_path").alias("parent"),
        "level",
    )


@query(
    "tree_from_labels",
    f"""WITH {fx.LAB} SELECT 'ROOT/' || class AS path, class AS name, 2 AS level, count(*) AS n
    FROM lab GROUP BY class UNION ALL SELECT 'ROOT', 'ROOT', 1, 0""",
)
def tree_from_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.labels(spark, sf).select("sample_id", F.col("class").alias("label"))
    nodes, held = tree.tree_from_labels(rows, "sample_id")
    counts = held.groupBy("node_path").agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(counts, "node_path", "left").select(
        path_text("node_path").alias("path"), "name", "level", F.coalesce("n", F.lit(0)).alias("n")
    )


@query(
    "find_node",
    f"""{_TREE} SELECT path, name, level FROM nodes WHERE name = 'NATION_3' ORDER BY path LIMIT 1""",
)
def find_node(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = fx.disease_tree(spark, sf)
    return _path(tree.find_node(nodes, "NATION_3"), "name", "level")


@query("child_names", f"{_TREE} SELECT name FROM nodes WHERE parent = 'ROOT/ASIA'")
def child_names(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = fx.disease_tree(spark, sf)
    return tree.child_names(nodes, ["ROOT", "ASIA"]).select("name")


@query("samples_recursive", f"{_TREE} SELECT path, sample_id FROM closure")
def samples_recursive(spark: SparkSession, sf: str) -> DataFrame:
    _, held = fx.disease_tree(spark, sf)
    return _path(tree.samples_recursive(held), "sample_id")


@query("nodes_at_level", f"{_TREE} SELECT path, name, level FROM nodes WHERE level = 2")
def nodes_at_level(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = fx.disease_tree(spark, sf)
    return _path(tree.nodes_at_level(nodes, 2), "name", "level")


@query("nodes_at_depth", f"{_TREE} SELECT name FROM nodes WHERE level = 3")
def nodes_at_depth(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = fx.disease_tree(spark, sf)
    return tree.nodes_at_depth(nodes, 2).select("name")


@query(
    "samples_at_level",
    f"""{_TREE} SELECT sample_id, name AS "cancerType" FROM closure WHERE level = 3""",
)
def samples_at_level(spark: SparkSession, sf: str) -> DataFrame:
    _, held = fx.disease_tree(spark, sf)
    return tree.samples_at_level(held, 3)


@query(
    "find_sample",
    f"""{_TREE} SELECT sample_id, min(path) AS path, arg_min(name, path) AS node_name
    FROM ts GROUP BY sample_id""",
)
def find_sample(spark: SparkSession, sf: str) -> DataFrame:
    nodes, held = fx.disease_tree(spark, sf)
    return _path(tree.find_sample(held, nodes), "sample_id", "node_name")


@query(
    "tree_edges",
    f"""{_TREE} SELECT split_part(n.parent, '/', n.level - 1) AS parent, n.name AS child,
    (SELECT count(*) FROM closure c WHERE c.path = n.path) AS n_samples
    FROM nodes n WHERE n.level > 1""",
)
def tree_edges(spark: SparkSession, sf: str) -> DataFrame:
    nodes, held = fx.disease_tree(spark, sf)
    return tree.tree_edges(nodes, held)


@query(
    "delete_node",
    f"""{_TREE} SELECT path, name, level FROM nodes
    WHERE NOT list_contains(string_split(path, '/'), 'EUROPE')""",
)
def delete_node(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _ = fx.disease_tree(spark, sf)
    return _path(tree.delete_node(nodes, "EUROPE"), "name", "level")


@query(
    "preorder_nodes",
    f"""{_TREE} SELECT path, name, row_number() OVER (ORDER BY path) AS place FROM nodes
    WHERE path IN (SELECT path FROM ts)""",
)
def preorder_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes, held = fx.disease_tree(spark, sf)
    listed = tree.preorder_nodes(nodes, held)
    # The tree is small: number it to show the order.
    place = F.row_number().over(tree.preorder_window()).cast("long")
    return listed.withColumn("place", place).select(path_text("node_path").alias("path"), "name", "place")


@query(
    "leaves",
    f"""{_TREE} SELECT path, name FROM nodes n WHERE path IN (SELECT path FROM ts)
    AND NOT EXISTS (SELECT 1 FROM nodes k WHERE k.parent = n.path)""",
)
def leaves(spark: SparkSession, sf: str) -> DataFrame:
    nodes, held = fx.disease_tree(spark, sf)
    return _path(tree.leaves(nodes, held), "name")


# --- splits ----------------------------------------------------------------------------

_IDS = "ids AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id FROM documents)"
_RANKED = f"""{_IDS},
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || id), id) AS r,
                  count(*) OVER () AS n FROM ids)"""
_ASSIGNED = f"""{_RANKED},
asg AS (SELECT doc_id, CASE WHEN r <= greatest(1, floor(n * 0.7e0)) THEN 'train'
                            WHEN r <= greatest(1, floor(n * 0.7e0)) + floor(n * 0.15e0) THEN 'val'
                            ELSE 'test' END AS split FROM ranked)"""


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "documents")


@query("split_ids", f"WITH {_ASSIGNED} SELECT doc_id, split FROM asg")
def split_ids(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_ids(_documents(spark, sf), "doc_id")


@query(
    "random_holdout",
    f"""WITH {_RANKED}
    SELECT doc_id, CASE WHEN r <= ceil(n * 0.2e0) THEN 'test' ELSE 'train' END AS split FROM ranked""",
)
def random_holdout(spark: SparkSession, sf: str) -> DataFrame:
    return splits.random_holdout(_documents(spark, sf), "doc_id")


@query(
    "apply_manifest",
    f"""WITH {_ASSIGNED} SELECT d.doc_id, d.lang, asg.split
    FROM documents d JOIN asg ON asg.doc_id = d.doc_id""",
)
def apply_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Assignments go into manifest documents as JSON and come back out."""
    parts = splits.split_manifest(splits.split_ids(_documents(spark, sf), "doc_id"), "doc_id")
    names = ("train", "val", "test")
    lists = [F.when(F.col("split") == n, F.col("ids")).alias(n) for n in names]
    stored = parts.select(F.to_json(F.struct(F.struct(*lists).alias("ids"))).alias("value"))
    assigned = splits.manifest_assignments(stored)
    rows = _documents(spark, sf).select("doc_id", "lang")
    return splits.apply_assignments(rows, assigned, "doc_id")


_HOLDOUT_TREE = f"""{_TREE},
lf AS (SELECT ts.path, ts.sample_id,
              row_number() OVER (PARTITION BY ts.path ORDER BY md5('42:' || ts.sample_id), ts.sample_id) AS r,
              count(*) OVER (PARTITION BY ts.path) AS n
       FROM ts WHERE NOT EXISTS (SELECT 1 FROM nodes k WHERE k.parent = ts.path)),
roles AS (SELECT path, sample_id,
                 CASE WHEN r <= greatest(1, floor(n * 0.2e0)) THEN 'validation' ELSE 'training' END AS role
          FROM lf)"""


@query(
    "tree_holdout",
    f"""{_HOLDOUT_TREE} SELECT n.path, r.sample_id, r.role FROM nodes n
    JOIN roles r ON r.path = n.path OR starts_with(r.path, n.path || '/')""",
)
def tree_holdout(spark: SparkSession, sf: str) -> DataFrame:
    nodes, held = fx.disease_tree(spark, sf)
    return _path(splits.tree_holdout(held, nodes), "sample_id", "role")


@query(
    "stratified_holdout",
    f"""{_TREE},
    -- a child with own samples stands for those, else for its subtree
    pool AS (SELECT k.parent AS path, k.name AS class, k.path AS child, c.sample_id
             FROM nodes k JOIN closure c ON c.path = k.path
             WHERE k.level > 1 AND (c.sample_path = k.path
                OR NOT EXISTS (SELECT 1 FROM ts WHERE ts.path = k.path))),
    listed AS (SELECT path, class, count(*) AS n FROM pool GROUP BY 1, 2),
    lastc AS (SELECT path, sample_id, arg_max(class, child) AS class FROM pool GROUP BY 1, 2),
    valid AS (SELECT v.* FROM lastc v JOIN listed l ON l.path = v.path AND l.class = v.class
              WHERE l.n >= 2),
    sizes AS (SELECT path, class, count(*) AS n, sum(count(*)) OVER (PARTITION BY path) AS total,
                     count(*) OVER (PARTITION BY path) AS k FROM valid GROUP BY 1, 2),
    gate AS (SELECT *, ceil(total * 0.2e0) AS held FROM sizes
             WHERE k > 1 AND ceil(total * 0.2e0) >= k AND total - ceil(total * 0.2e0) >= k),
    base AS (SELECT *, n * held / total AS exact, floor(n * held / total) AS b FROM gate),
    quota AS (SELECT path, class, b + CASE WHEN
                row_number() OVER (PARTITION BY path ORDER BY round(exact - b, 9) DESC, class)
                <= held - sum(b) OVER (PARTITION BY path) THEN 1 ELSE 0 END AS q FROM base),
    rk AS (SELECT v.*, row_number() OVER (PARTITION BY v.path, v.class
             ORDER BY md5('42:' || v.sample_id), v.sample_id) AS r FROM valid v)
    SELECT rk.path, rk.sample_id, rk.class FROM rk
    JOIN quota ON quota.path = rk.path AND quota.class = rk.class WHERE r <= q""",
)
def stratified_holdout(spark: SparkSession, sf: str) -> DataFrame:
    nodes, held = fx.disease_tree(spark, sf)
    return _path(splits.stratified_holdout(held, nodes), "sample_id", "class")


@query(
    "stratified_folds",
    f"""WITH {fx.LAB} SELECT sample_id, class, CAST((row_number() OVER (PARTITION BY class
      ORDER BY md5('42:' || sample_id), sample_id) - 1) % 3 AS INTEGER) AS fold FROM lab""",
)
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    return splits.stratified_folds(fx.labels(spark, sf), "sample_id", "class", 3)


@query(
    "adaptive_folds",
    """WITH s AS (SELECT c_mktsegment || c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1)
    SELECT min(n) AS min_count, CAST(least(5, greatest(2, min(n))) AS INTEGER) AS n_splits,
           CASE WHEN min(n) >= 2 THEN 'cross_validation' ELSE 'validation_set' END AS strategy FROM s""",
)
def adaptive_folds(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(spark, sf, "customer").select(
        F.concat("c_mktsegment", fx.text("c_nationkey")).alias("label")
    )
    return splits.adaptive_folds(rows, "label")


_VEC_SPLIT = f"""{fx.M},
vr AS (SELECT sample_id, row_number() OVER (ORDER BY md5('42:' || sample_id), sample_id) AS r,
              count(*) OVER () AS n FROM (SELECT DISTINCT sample_id FROM m)),
va AS (SELECT sample_id, CASE WHEN r <= greatest(1, floor(n * 0.7e0)) THEN 'train'
              WHEN r <= greatest(1, floor(n * 0.7e0)) + floor(n * 0.15e0) THEN 'val'
              ELSE 'test' END AS split FROM vr)"""


@query(
    "split_profile",
    f"""WITH {_VEC_SPLIT}, pp AS (SELECT split, probe_id, avg(value) AS mean, stddev_samp(value) AS std
      FROM m JOIN va ON va.sample_id = m.sample_id GROUP BY 1, 2)
    SELECT split, count(*) AS n_numeric_cols, round(avg(mean), 6) + 0.0 AS mean_of_means,
           round(avg(std), 6) + 0.0 AS mean_of_stds FROM pp GROUP BY split""",
)
def split_profile(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.measurements(spark, sf)
    ids = fx.labels(spark, sf).select("sample_id")
    rows = m.join(splits.split_ids(ids, "sample_id"), "sample_id")
    out = splits.split_profile(rows)
    return out.withColumn("mean_of_means", rounded("mean_of_means")).withColumn(
        "mean_of_stds", rounded("mean_of_stds")
    )


@query("split_row_counts", f"WITH {_ASSIGNED} SELECT split, count(*) AS n_rows FROM asg GROUP BY split")
def split_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_row_counts(splits.split_ids(_documents(spark, sf), "doc_id"))


# --- design -------------------------------------------------------------------------------


@query(
    "label_join",
    """WITH a AS (SELECT upper(trim(' ' || c_name || ' ')) AS biosample_id, c_custkey FROM customer),
    b AS (SELECT upper(trim(lower(c_name))) AS biosample_id,
                 CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS label FROM customer)
    SELECT a.biosample_id, a.c_custkey, b.label FROM a JOIN b ON b.biosample_id = a.biosample_id
    WHERE b.label IS NOT NULL""",
)
def label_join(spark: SparkSession, sf: str) -> DataFrame:
    customer = fx.table(spark, sf, "customer")
    space = F.lit(" ")
    samples = customer.select(F.concat(space, "c_name", space).alias("biosample_id"), "c_custkey")
    labels = customer.select(
        F.lower("c_name").alias("biosample_id"),
        F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("label"),
    )
    return design.label_join(samples, labels)


def _design_sql(measured: str = "") -> str:
    where = f"WHERE c.sample_id IN ({measured})" if measured else ""
    return f""",
sub AS (SELECT path, count(*) AS n FROM closure GROUP BY path),
des AS (SELECT c.path, c.sample_id,
               coalesce(arg_max(k.name, k.path) FILTER (s.n >= 3), 'otherCancerType') AS class
        FROM closure c
        LEFT JOIN nodes k ON k.parent = c.path
             AND (k.path = c.sample_path OR starts_with(c.sample_path, k.path || '/'))
        LEFT JOIN sub s ON s.path = k.path {where} GROUP BY 1, 2)"""


_MEASURED = "SELECT CAST(o_custkey AS VARCHAR) FROM orders"


def _customer_design(spark: SparkSession, sf: str) -> DataFrame:
    nodes, held = fx.disease_tree(spark, sf)
    measured = fx.table(spark, sf, "orders").select(fx.text("o_custkey").alias("sample_id"))
    return design.node_design(nodes, held, measured)


@query("node_design", _TREE + _design_sql(_MEASURED) + " SELECT path, sample_id, class FROM des")
def node_design(spark: SparkSession, sf: str) -> DataFrame:
    return _path(_customer_design(spark, sf), "sample_id", "class")


def _gates(keep_other: bool) -> str:
    kept = "true" if keep_other else "class <> 'otherCancerType'"
    return f""", g AS (SELECT path, count(*) FILTER ({kept}) AS n_samples,
      count(DISTINCT class) FILTER ({kept}) AS n_classes FROM des GROUP BY path),
    gate AS (SELECT *, CASE WHEN n_samples < 10 THEN 'too few samples'
                            WHEN n_classes < 2 THEN 'only one subgroup' END AS reason FROM g)"""


@query(
    "trainable_nodes",
    _TREE
    + _design_sql(_MEASURED)
    + _gates(False)
    + " SELECT path, n_samples, n_classes, reason, reason IS NULL AS trainable FROM gate",
)
def trainable_nodes(spark: SparkSession, sf: str) -> DataFrame:
    rows = design.trainable_nodes(_customer_design(spark, sf))
    return _path(rows, "n_samples", "n_classes", "reason", "trainable")


@query(
    "trainable_nodes_all",
    _TREE
    + _design_sql(_MEASURED)
    + _gates(True)
    + " SELECT path, n_samples, n_classes, reason, reason IS NULL AS trainable FROM gate",
)
def trainable_nodes_all(spark: SparkSession, sf: str) -> DataFrame:
    rows = design.trainable_nodes(_customer_design(spark, sf), keep_other=True)
    return _path(rows, "n_samples", "n_classes", "reason", "trainable")


_CLASS_TREE = f"WITH RECURSIVE {fx.M}, {fx.CLASS_TREE}"


def _class_design(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    m = fx.measurements(spark, sf)
    nodes, held = fx.class_tree(spark, sf)
    return m, design.node_design(nodes, held, m)


@query(
    "node_dataset",
    _CLASS_TREE
    + _design_sql()
    + _gates(False)
    + """, whole AS (SELECT probe_id FROM m GROUP BY 1
            HAVING count(value) = (SELECT count(DISTINCT sample_id) FROM m))
    SELECT m.sample_id, m.probe_id, m.value, des.class FROM m JOIN des ON des.sample_id = m.sample_id
    WHERE des.path = 'ROOT/g1' AND class <> 'otherCancerType'
      AND des.path IN (SELECT path FROM gate WHERE reason IS NULL)
      AND probe_id IN (SELECT probe_id FROM whole)""",
)
def node_dataset(spark: SparkSession, sf: str) -> DataFrame:
    m, rows = _class_design(spark, sf)
    out = design.node_dataset(m, rows, ["ROOT", "g1"])
    return out.select("sample_id", "probe_id", "value", "class")


@query(
    "node_dataset_all",
    _CLASS_TREE
    + _design_sql()
    + _gates(True)
    + """, cohort AS (SELECT m.sample_id, m.probe_id, m.value, des.class
            FROM m JOIN des ON des.sample_id = m.sample_id
            WHERE des.path = 'ROOT/g1' AND des.path IN (SELECT path FROM gate WHERE reason IS NULL))
    SELECT * FROM cohort WHERE sample_id NOT IN (SELECT sample_id FROM cohort WHERE value IS NULL)""",
)
def node_dataset_all(spark: SparkSession, sf: str) -> DataFrame:
    m, rows = _class_design(spark, sf)
    out = design.node_dataset_all(m, rows, ["ROOT", "g1"])
    return out.select("sample_id", "probe_id", "value", "class")
