"""Broadcast only what was measured to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A probe list can never exceed the largest array (below one million loci), so
# this limit admits any probe list while refusing anything sample-sized.
MAX_BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Return ``df`` with a broadcast hint if it holds at most ``max_rows`` rows.

    The check stops reading after ``max_rows + 1`` rows.  A larger side comes back
    unhinted, and the join falls to a shuffle join, which adaptive execution
    splits where one key is hot.
    """
    seen = df.limit(max_rows + 1).count()
    return F.broadcast(df) if seen <= max_rows else df

