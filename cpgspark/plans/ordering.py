"""Ranks and running totals over groups of any size.

A window ordered inside one group sends the whole group to one task.  Here the
rows of a group are first cut into consecutive buckets that follow the order, the
window runs inside each (group, bucket), and the small table of bucket totals
supplies what the earlier buckets add.  Results equal the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from cpgspark.plans.durable import store

#: Rows that one task orders at a time; the number of buckets follows from it.
ROWS_PER_BUCKET = 65_536
# The cut points are constants of the plan; beyond this many, buckets grow instead.
MAX_BUCKETS = 10_000

_BUCKET = "__bucket"


def seeded_hash(id_col: str, seed: int) -> Column:
    """Seed-dependent shuffle key: a uniform hex digest of the id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def seeded_rank(
    df: DataFrame,
    id_col: str,
    seed: int,
    group_cols: Sequence[str] = (),
    rank_col: str = "rank",
    size_col: str = "group_size",
) -> DataFrame:
    """Number the rows of each group 1..n in seeded random order; also give n.

    The leading digits of the digest are the bucket: they follow the digest order
    and are uniform, so even a group holding most of the table is spread over
    4,096 tasks' worth of work.
    """
    group_cols = list(group_cols)
    keyed = df.withColumn("__digest", seeded_hash(id_col, seed)).withColumn(
        _BUCKET, F.substring("__digest", 1, 3)
    )
    inside = Window.partitionBy(*group_cols, _BUCKET).orderBy("__digest", id_col)
    ranked = keyed.withColumn("__inside", F.row_number().over(inside))

    totals = keyed.groupBy(*group_cols, _BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(1))
    before = whole.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group_cols,
        _BUCKET,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(whole).alias(size_col),
    )
    return (
        ranked.join(offsets, [*group_cols, _BUCKET])
        .withColumn(rank_col, F.col("__before") + F.col("__inside"))
        .drop("__digest", "__inside", "__before", _BUCKET)
    )


def value_bounds(df: DataFrame, value_col: str, buckets: int) -> list[float]:
    """Cut points that split the rows into about equal shares (at most ``buckets``)."""
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    cuts = df.approxQuantile(value_col, shares, 1.0 / (4 * buckets))
    return sorted({c for c in cuts if abs(c) != float("inf")})


def with_bucket(df: DataFrame, value_col: str, bounds: Sequence[float]) -> DataFrame:
    """Add ``__bucket``, a number that never falls as ``value_col`` rises.

    The cut points are constants of the plan, so every use of the frame, and
    every re-run of a lost task, buckets the same way.  Equal values share one.
    """
    if not bounds:
        return df.withColumn(_BUCKET, F.lit(0.0))
    splits = [float("-inf"), *bounds, float("inf")]
    return Bucketizer(
        splits=splits, inputCol=value_col, outputCol=_BUCKET, handleInvalid="keep"
    ).transform(df)


def running_totals(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    totals: dict[str, str],
    descending: bool = True,
    buckets: int | None = None,
) -> DataFrame:
    """Cumulative sums along ``value_col`` inside each group.

    ``totals`` maps an input column to the output name of its running sum.  Rows
    must already be unique per (group, value), so ties need no rule.  The sum over
    the whole group is added as ``<output>_all``.

    The input runs once: its rows are stored, and the count in the file footers gives
    the number of buckets unless ``buckets`` names it.
    """
    group_cols = list(group_cols)
    df = store(df, "running")
    if buckets is None:
        buckets = min(MAX_BUCKETS, -(-df.count() // ROWS_PER_BUCKET))
    bucketed = with_bucket(df, value_col, value_bounds(df, value_col, buckets))
    order = F.col(value_col).desc() if descending else F.col(value_col).asc()
    inside = (
        Window.partitionBy(*group_cols, _BUCKET)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    bucket_order = F.col(_BUCKET).desc() if descending else F.col(_BUCKET).asc()
    whole = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(1))
    before = whole.orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)

    sums = bucketed.groupBy(*group_cols, _BUCKET).agg(
        *[F.sum(c).alias(f"__sum_{out}") for c, out in totals.items()]
    )
    offsets = sums.select(
        *group_cols,
        _BUCKET,
        *[
            F.coalesce(F.sum(f"__sum_{out}").over(before), F.lit(0)).alias(f"__before_{out}")
            for out in totals.values()
        ],
        *[F.sum(f"__sum_{out}").over(whole).alias(f"{out}_all") for out in totals.values()],
    )
    running = bucketed.select(
        "*", *[F.sum(c).over(inside).alias(f"__in_{out}") for c, out in totals.items()]
    )
    joined = running.join(offsets, [*group_cols, _BUCKET])
    for out in totals.values():
        joined = joined.withColumn(out, F.col(f"__before_{out}") + F.col(f"__in_{out}"))
    hidden = [f"__before_{o}" for o in totals.values()] + [f"__in_{o}" for o in totals.values()]
    return joined.drop(_BUCKET, *hidden)


def running_extreme(
    df: DataFrame,
    group_cols: Sequence[str],
    rank_col: str,
    value_col: str,
    out: str,
    largest: bool = True,
    descending: bool = False,
    piece: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add the running maximum (minimum) of ``value_col`` along a rank inside each group.

    ``rank_col`` holds distinct whole numbers from 1 on per group.  A window runs inside
    each stretch of ``piece`` ranks, and one row per stretch carries the extreme onward.
    """
    group_cols = list(group_cols)
    extreme, pick = (F.max, F.greatest) if largest else (F.min, F.least)
    cut = df.withColumn(_BUCKET, F.floor((F.col(rank_col) - 1) / piece))

    def order(column: str) -> Column:
        return F.col(column).desc() if descending else F.col(column).asc()

    inside = (
        Window.partitionBy(*group_cols, _BUCKET)
        .orderBy(order(rank_col))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    whole = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(1))
    before = whole.orderBy(order(_BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        cut.groupBy(*group_cols, _BUCKET)
        .agg(extreme(value_col).alias("__best"))
        .select(*group_cols, _BUCKET, extreme("__best").over(before).alias("__before"))
    )
    return (
        cut.withColumn("__here", extreme(value_col).over(inside))
        .join(carried, [*group_cols, _BUCKET])
        .withColumn(out, pick("__here", "__before"))
        .drop(_BUCKET, "__here", "__before")
    )
