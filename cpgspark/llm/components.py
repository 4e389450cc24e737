"""Connected components of a link table, by alternating large and small stars.

Every round rewires the links so that all nodes of a component come to hang on its
smallest node: first each node's larger neighbours move to its smallest neighbour, then
its smaller ones do.  A node's neighbours meet only in a minimum (combined before the
shuffle) and in a join on the node, whose hot keys adaptive execution splits, so no
neighbourhood is gathered.  Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cpgspark.plans.durable import store


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) for every node with a link.

    Loops, repeats and the direction of links do not matter; nulls are left out.  No
    links give no rows.
    """
    edges = links.select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
    edges = store(edges.distinct(), "links")
    before = None
    while True:
        state = edges.agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("h"),
        ).first()
        if state["n"] == 0 or tuple(state) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = tuple(state)
        edges = store(_small_star(_large_star(edges)).distinct(), "stars")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where("v > u")
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = (
        edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return moved.unionByName(least.select("u", F.col("m").alias("v")))
