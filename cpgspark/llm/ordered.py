"""Positions and running totals along a total order, for any number of rows.

A window without a partition would sort the table in one task.  Here rows are cut into
consecutive ranges by sampled bounds; the window runs inside each range and the totals of
earlier ranges, one row each, are added.  The ranged rows are stored once, so that every
later job, and every re-run of a lost task, sees the same ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from cpgspark.plans.durable import store


def ordered_totals(
    df: DataFrame, order: Sequence[str], totals: Mapping[str, str], position: str = "position"
) -> DataFrame:
    """Add ``position`` (from 0) and, for each input column of ``totals``, the sum before the row.

    Nulls come first.  Rows equal in ``order`` may take their places in any way, so the
    order should name all columns that matter.  An empty table stays empty.
    """
    cut = store(
        df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ordered"
    )
    sums = {name: f"__sum{i}" for i, name in enumerate(totals)}
    ranges = cut.groupBy("__range").agg(
        F.count(F.lit(1)).alias("__rows"), *[F.sum(c).alias(s) for c, s in sums.items()]
    )
    # One row for each range, that is, for each shuffle partition.
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        "__range",
        *[
            F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before")
            for c in ("__rows", *sums.values())
        ],
    )
    inside = Window.partitionBy("__range").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.select(
        "*",
        (F.row_number().over(inside) - 1).alias("__row"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{s}_in") for c, s in sums.items()],
    ).join(F.broadcast(offsets), "__range")
    return placed.select(
        *df.columns,
        (F.col("__rows_before") + F.col("__row")).cast("long").alias(position),
        *[
            (F.col(f"{sums[c]}_before") + F.col(f"{sums[c]}_in")).cast("long").alias(out)
            for c, out in totals.items()
        ],
    )
