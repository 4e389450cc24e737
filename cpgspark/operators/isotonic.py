"""Isotonic regression of outcomes on scores, pooled inside score ranges and then across them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cpgspark.plans.durable import store
from cpgspark.plans.ordering import ROWS_PER_BUCKET, value_bounds, with_bucket

#: Neighbouring ranges that one task of a merge takes in.
FAN_IN = 16

_BLOCK = "low double, high double, positives long, n long"


def _pooled(rows: Iterator[tuple[float, float, int, int]]) -> list[list]:
    """Pool blocks in score order until their shares of positives rise strictly.

    Shares are compared as products of whole numbers, so the blocks do not depend on
    where the ranges were cut.
    """
    blocks: list[list] = []
    for low, high, positives, n in rows:
        blocks.append([low, high, positives, n])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, high_end, more, rows_more = blocks.pop()
            blocks[-1][1] = high_end
            blocks[-1][2] += more
            blocks[-1][3] += rows_more
    return blocks


def _pool_range(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("low")
    columns = (rows[c].tolist() for c in ("low", "high", "positives", "n"))
    return pd.DataFrame(_pooled(zip(*columns)), columns=["low", "high", "positives", "n"])


def isotonic_blocks(
    rows: DataFrame,
    score_col: str = "score",
    truth: Column | str = "truth",
    per_range: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``low, high, positives, n``: the blocks of the rising least-squares fit.

    Equal scores are one point.  Ranges of about ``per_range`` distinct scores are pooled
    at once, each in a task; then ``FAN_IN`` neighbouring ranges are merged at a time until
    one is left.  Shares of positives in a range of w rows that rise strictly number at
    most about 1.3 * w^(2/3) (that many fractions have denominators summing to w), so a
    later task holds far fewer rows than its ranges had.  Scores that are null or no
    number, and null outcomes, take no part; no rows give no blocks.
    """
    truth = F.col(truth) if isinstance(truth, str) else truth
    score = F.col(score_col).cast("double")
    points = store(
        # Adding zero makes the negative zero a zero, which the range cut takes as equal.
        rows.select((score + F.lit(0.0)).alias("low"), truth.cast("boolean").alias("hit"))
        .filter(F.col("low").isNotNull() & ~F.isnan("low") & F.col("hit").isNotNull())
        .groupBy("low")
        .agg(F.sum(F.col("hit").cast("long")).alias("positives"), F.count(F.lit(1)).alias("n"))
        .withColumn("high", F.col("low")),
        "points",
    )
    ranges = max(1, -(-points.count() // per_range))
    bounds = value_bounds(points, "low", ranges)
    # Scores outside the finite cut points fall in the first and the last range.
    ranged = with_bucket(points, "low", bounds).withColumnRenamed("__bucket", "range")
    left = len(bounds) + 1
    blocks = ranged.withColumn("range", F.col("range").cast("long"))
    while True:
        blocks = blocks.select("range", "low", "high", "positives", "n").groupBy("range")
        blocks = blocks.applyInPandas(lambda key, r: _pool_range(r).assign(range=key[0]),
                                      f"{_BLOCK}, range long")
        if left == 1:
            return blocks.drop("range")
        left = -(-left // FAN_IN)
        blocks = store(blocks.withColumn("range", F.floor(F.col("range") / FAN_IN)), "blocks")


def block_ends(blocks: DataFrame) -> DataFrame:
    """``score, label, weight``: both ends of every block with its share of positives.

    A fit to these few rows is the fit to the rows behind them.
    """
    ends = F.when(F.col("low") == F.col("high"), F.array("low")).otherwise(F.array("low", "high"))
    return blocks.select(
        F.explode(ends).alias("score"),
        (F.col("positives") / F.col("n")).alias("label"),
        (F.col("n") / F.size(ends)).alias("weight"),
    )
