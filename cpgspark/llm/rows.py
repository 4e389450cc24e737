"""Rows named by their id and text or content, with their columns out of the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cpgspark.plans.sizing import small_side


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The id beside a 64-bit hash of id and text; rows equal in both share it.

    Only different texts under one id could collide.  Null ids equal each other in it.
    """
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("text"))


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as one, so that no name of theirs meets a name used inside."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def one_per_key(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """``all`` of ``keyed`` beside the columns of ``wanted``, one row of ``all`` for each key.

    ``keyed`` has ``row`` and ``all``; ``wanted`` has ``row``, in ``equal`` how many rows share
    the key, and may hold a key several times.  Of rows that share a key the one with the
    smallest hash of its columns stands for all; only those are grouped by it.
    """
    alone = keyed.join(wanted.where("equal = 1"), "row")
    several = wanted.where("equal > 1")
    first = (
        keyed.join(small_side(several.select("row").distinct()), "row", "left_semi")
        .groupBy("row")
        .agg(F.min_by("all", F.xxhash64("all")).alias("all"))
    )
    return alone.unionByName(first.join(several, "row"))
