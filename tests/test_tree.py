"""Tree, design and per-node splits on small hand-made trees."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cpgspark.operators import design, splits, tree


def _paths(df, *more):
    return sorted(
        ("/".join(r["node_path"]), *[r[m] for m in more]) for r in df.select("node_path", *more).collect()
    )


@pytest.fixture(scope="module")
def small(spark):
    """ROOT over A, B, C; X under both A and B; C/E without samples; B has its own."""
    edges = spark.createDataFrame(
        [("ROOT", "B", 0), ("ROOT", "A", 1), ("ROOT", "C", 2), ("A", "X", 0), ("B", "X", 0),
         ("C", "E", 0), ("A", "Y", 1)],
        "parent string, child string, ordinal int",
    )
    rows = [(f"x{i}", "X") for i in range(4)] + [(f"b{i}", "B") for i in range(2)]
    rows += [(f"y{i}", "Y") for i in range(12)] + [("lost", "Nowhere")]
    samples = spark.createDataFrame(rows, "sample_id string, diseaseName string")
    return tree.build_tree(edges, samples)


def test_empty_branches_go_and_shared_names_stay(small):
    nodes, held = small
    assert [p for p, in _paths(nodes)] == ["ROOT", "ROOT/A", "ROOT/A/X", "ROOT/A/Y", "ROOT/B", "ROOT/B/X"]
    assert held.count() == 4 * 2 + 2 + 12


def test_root_stays_without_samples(spark):
    edges = spark.createDataFrame([("ROOT", "A")], "parent string, child string")
    none = spark.createDataFrame([], "sample_id string, diseaseName string")
    assert _paths(tree.build_tree(edges, none)[0]) == [("ROOT",)]


def test_cycle_is_refused(spark):
    edges = spark.createDataFrame([("ROOT", "A"), ("A", "B"), ("B", "A")], "parent string, child string")
    with pytest.raises(Exception, match="RECURSION"):
        tree.expand_edges(edges).collect()


@pytest.mark.parametrize(
    "links", ["ROOT>A A>A", "ROOT>A A>ROOT", "ROOT>A A>B B>C C>D D>E E>F F>B", "ROOT>A ROOT>B B>C C>B"]
)
def test_cycles_of_any_length_are_refused(spark, links):
    edges = spark.createDataFrame([tuple(e.split(">")) for e in links.split()], "parent string, child string")
    with pytest.raises(ValueError, match="cycle"):
        tree.expand_edges(edges).collect()


def test_cycles_out_of_reach_do_not_matter(spark):
    rows = [("ROOT", "A"), ("X", "Y"), ("Y", "X"), ("X", "A"), (None, "Z"), ("Q", None)]
    edges = spark.createDataFrame(rows, "parent string, child string")
    assert _paths(tree.expand_edges(edges)) == [("ROOT",), ("ROOT/A",)]
    none = spark.createDataFrame([], "parent string, child string")
    assert _paths(tree.expand_edges(none)) == [("ROOT",)]


def test_a_chain_far_beyond_the_recursion_limit(spark):
    depth = 3000
    parent = F.when(F.col("id") == 0, "ROOT").otherwise(F.concat(F.lit("n"), F.col("id")))
    edges = spark.range(depth).select(parent.alias("parent"), F.concat(F.lit("n"), F.col("id") + 1).alias("child"))
    nodes = tree.expand_edges(edges)
    last = nodes.filter(F.col("level") == depth + 1).first()
    assert nodes.count() == depth + 1
    assert last["node_path"] == ["ROOT", *[f"n{i}" for i in range(1, depth + 1)]]
    assert last["order_path"] == last["node_path"][1:] and last["parent_path"] == last["node_path"][:-1]


def test_order_follows_ordinals(small):
    nodes, held = small
    assert tree.find_node(nodes, "X").first()["node_path"] == ["ROOT", "B", "X"]
    listed = [r["name"] for r in tree.preorder_nodes(nodes).collect()]
    assert listed == ["ROOT", "B", "X", "A", "X", "Y"]
    assert [r["name"] for r in tree.preorder_nodes(nodes, held).collect()] == ["B", "X", "X", "Y"]
    found = {r["sample_id"]: r["node_path"] for r in tree.find_sample(held, nodes).collect()}
    assert found["x0"] == ["ROOT", "B", "X"] and "lost" not in found


def test_levels_and_counts(small):
    nodes, held = small
    assert tree.nodes_at_depth(nodes, -1).count() == 0
    assert tree.nodes_at_depth(nodes, 0).first()["name"] == "ROOT"
    assert tree.samples_at_level(held, 3).filter("cancerType = 'B'").count() == 0
    below = tree.samples_at_level(held, 2, below=["ROOT", "A"])
    assert {r[0]: r[1] for r in below.groupBy("cancerType").count().collect()} == {"X": 4, "Y": 12}
    edges = {(r["parent"], r["child"]): r["n_samples"] for r in tree.tree_edges(nodes, held).collect()}
    assert edges[("ROOT", "B")] == 6 and edges[("ROOT", "A")] == 16
    assert {p for p, in _paths(tree.leaves(nodes, held))} == {"ROOT/A/X", "ROOT/A/Y", "ROOT/B/X"}
    assert {p for p, in _paths(tree.delete_node(nodes, "X"))} == {"ROOT", "ROOT/A", "ROOT/A/Y", "ROOT/B"}
    assert tree.delete_node(nodes, "ROOT").count() == 0


def test_roles(small):
    nodes, held = small
    roles = splits.tree_holdout(held, nodes)
    at = roles.filter(F.size("node_path") == 3)
    sizes = {(p, r): n for p, r, n in _paths(at.groupBy("node_path", "role").count(), "role", "count")}
    assert sizes[("ROOT/A/X", "validation")] == 1 and sizes[("ROOT/A/Y", "validation")] == 2
    # Own samples of an inner node take no part.
    assert roles.filter(F.col("sample_id").startswith("b")).count() == 0
    own = roles.filter(F.col("node_path") == F.array(F.lit("ROOT")))
    assert own.count() == 4 * 2 + 12
    only = tree.samples_recursive(at, "validation")
    assert only.filter(F.size("node_path") == 1).count() == 1 + 1 + 2
    with pytest.raises(ValueError):
        tree.samples_recursive(held, "other")


def test_last_child_wins_and_small_children_are_other(small):
    nodes, held = small
    rows = {(p, s): c for p, s, c in _paths(design.node_design(nodes, held), "sample_id", "class")}
    assert rows[("ROOT", "x0")] == "A" and rows[("ROOT", "b0")] == "B"
    assert rows[("ROOT/B", "x0")] == "X" and rows[("ROOT/B", "b0")] == "otherCancerType"
    assert rows[("ROOT/A/X", "x0")] == "otherCancerType"
    gates = {r["node_path"][-1]: r for r in design.trainable_nodes(design.node_design(nodes, held)).collect()}
    assert gates["ROOT"]["trainable"] and gates["A"]["trainable"]
    assert gates["B"]["reason"] == "too few samples"


def test_stratified_holdout_quota(small):
    nodes, held = small
    out = splits.stratified_holdout(held, nodes)
    counts = {(p, c): n for p, c, n in _paths(out.groupBy("node_path", "class").count(), "class", "count")}
    # A: 16 samples, 4 held out, by share 1 and 3.
    assert counts[("ROOT/A", "X")] == 1 and counts[("ROOT/A", "Y")] == 3
    # ROOT: B stands for its own two samples, A for 16: 18 samples, 4 held out.
    assert counts[("ROOT", "A")] + counts.get(("ROOT", "B"), 0) == 4


def test_labels_make_a_flat_tree(spark):
    rows = [("a", "L"), (None, "L"), ("b", "K"), (None, "Empty")]
    df = spark.createDataFrame(rows, "biosample_id string, label string")
    nodes, held = tree.tree_from_labels(df)
    assert [p for p, in _paths(nodes)] == ["ROOT", "ROOT/K", "ROOT/L"]
    assert held.count() == 2
    with pytest.raises(ValueError):
        tree.tree_from_labels(df.drop("label"))


def test_node_dataset_gates(spark, small):
    nodes, held = small
    rows = [(s["sample_id"], p, None if (p == "q" and i == 0) else float(i)) for i, s in
            enumerate(held.select("sample_id").distinct().orderBy("sample_id").collect()) for p in ("p", "q")]
    m = spark.createDataFrame(rows, "sample_id string, probe_id string, value double")
    d = design.node_design(nodes, held, m)
    good = design.node_dataset(m, d, ["ROOT", "A"])
    assert {r[0] for r in good.select("probe_id").distinct().collect()} == {"p"}
    assert good.count() == 16
    assert design.node_dataset(m, d, ["ROOT", "B"]).count() == 0
    everyone = design.node_dataset_all(m, d, ["ROOT"])
    assert everyone.select("sample_id").distinct().count() == 17
