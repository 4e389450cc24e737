"""Sharding to equal bytes by sampled splitters, in DataFrame operations only.

Rows are keyed by a hash of their text, so equal texts lie together.  A sample in which a
row's chance follows its size gives splitters at equal steps of weight; they cut the keys
into many more ranges than shards.  The exact bytes of every range are then counted and
overfull ranges subdivided: a range of many keys evenly along the key, a range of one key
(copies of one text) by a hash of the id.  Rows equal in id and text are counted first and
go on in bundles of at most a piece, which are drawn and cut one by one.  Copies stay in
one shard unless they outweigh a shard, in which case their slices spread.  The pieces, whose number is bounded by the
number of shards and of rows per piece, go to shards largest first, each to the lightest.

A row's slot is the start of its piece in the shard plus its rank in the piece, so no
window holds more than a piece.

Defined cases: a null text weighs as an empty one and is a copy of it; repeated rows take
neighbouring slots; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cpgspark.plans.durable import store

SHARDS = 40
ROW_BYTES = 16
#: Pieces per shard at least, and rows per piece that a larger table aims at.
PIECES = 64
ROWS_PER_PIECE = 100_000
#: Keys drawn for each piece.
DRAWS = 8


def keyed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``key`` (53 bits of a hash) and ``rows``, how many
    rows are equal in all of them; stored once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return store(
        df.select(
            "doc_id",
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.shiftright(F.xxhash64(text), 11).alias("key"),
        )
        .groupBy("doc_id", "size", "text_crc32", "key")
        .agg(F.count(F.lit(1)).alias("rows")),
        "shard-keys",
    )


def bundled(rows: DataFrame, ideal: float) -> DataFrame:
    """Equal rows in bundles that weigh at most a piece, or are one row; with ``weight``."""
    most = F.greatest(F.floor(F.lit(ideal) / F.col("size")), F.lit(1))
    most = F.least(most, F.lit(ROWS_PER_PIECE)).cast("long")
    cut = rows.withColumn("most", most).withColumn(
        "bundle", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(rows - 1) div most")))
    )
    return (
        cut.withColumn("rows", F.least("most", F.col("rows") - F.col("bundle") * F.col("most")))
        .withColumn("weight", F.col("size") * F.col("rows"))
        .drop("most")
    )


def _uniform(*columns: str) -> Column:
    """A number in [0, 1) that follows from the row."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def splitters(rows: DataFrame, total: int, pieces: int) -> list[float]:
    """Keys at equal steps of weight in a size-weighted sample, at most two per piece.

    A key that fills more than one step is a heavy text: it gets a range of its own.
    """
    step = total / pieces
    draw = step / DRAWS
    drawn = rows.where(_uniform("key", "doc_id", "size", "bundle") * draw < F.col("weight")).select(
        "key", F.greatest(F.col("weight").cast("double"), F.lit(draw)).alias("weight")
    )
    # About DRAWS * pieces rows, and never more than twice that: one task sorts them.
    along = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.floor(F.sum("weight").over(along) / step)
    cuts = (
        drawn.select("key", at.alias("step"))
        .groupBy("step")
        .agg(F.min("key").alias("key"))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("steps"))
        .collect()
    )
    found = {float(r["key"]) for r in cuts}
    return sorted(found | {float(r["key"]) + 1 for r in cuts if r["steps"] > 1})


def _ranged(rows: DataFrame, cuts: list[float]) -> DataFrame:
    if not cuts:
        return rows.withColumn("range", F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    placed = Bucketizer(splits=splits, inputCol="__key", outputCol="__range").transform(
        rows.withColumn("__key", F.col("key").cast("double"))
    )
    return placed.withColumn("range", F.col("__range").cast("int")).drop("__key", "__range")


def place(
    pieces: Iterable[tuple[int, int, int, int]], shards: int, most: float
) -> list[tuple[int, int, int, int]]:
    """Put pieces into shards, largest first, each into the lightest so far.

    A piece is (range, part, bytes, rows); parts below zero are slices of one key, which
    stay together up to the weight ``most``.  Returns (range, part, shard, first slot).
    """
    together: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    for piece in pieces:
        together[piece[0]].append(piece)
    units = []
    for parts in together.values():
        if parts[0][1] < 0 and sum(p[2] for p in parts) <= most:
            units.append(parts)
        else:
            units += [[part] for part in parts]
    units.sort(key=lambda parts: (-sum(p[2] for p in parts), min(parts)))
    heap = [(0, shard) for shard in range(shards)]
    slots = [0] * shards
    placed = []
    for parts in units:
        load, shard = heapq.heappop(heap)
        for number, part, size, rows in sorted(parts):
            placed.append((number, part, shard, slots[shard]))
            slots[shard] += rows
            load += size
        heapq.heappush(heap, (load, shard))
    return placed


def shard_by_bytes(
    df: DataFrame, shards: int = SHARDS, pieces: int = PIECES, text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row."""
    spark = df.sparkSession
    rows = keyed(df, text_col)
    total, count = rows.agg(
        F.sum(F.col("size") * F.col("rows")), F.coalesce(F.sum("rows"), F.lit(0))
    ).first()
    number = shards * max(pieces, -(-count // (shards * ROWS_PER_PIECE)))
    ideal = max((total or 0) / number, 1.0)
    rows = bundled(rows, ideal)
    ranged = _ranged(rows, splitters(rows, total, number) if count else [])

    # At most two ranges per piece come to the driver here, and the pieces below.
    ranges = (
        ranged.groupBy("range")
        .agg(F.sum("weight").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
        .where(F.col("bytes") > 2 * ideal)
    )
    overfull = [
        (r["range"], r["low"], r["high"] - r["low"] + 1, -int(-r["bytes"] // ideal))
        for r in ranges.collect()
    ]
    names = ("range", "low", "width", "parts")
    plan = spark.createDataFrame(
        overfull, StructType([StructField(n, LongType()) for n in names])
    )
    along = F.floor(
        (F.col("key") - F.col("low")).cast("double") * F.col("parts") / F.col("width")
    ).cast("long")
    # Bundles of equal rows go round the parts.
    across = -1 - F.pmod(F.pmod(F.xxhash64("doc_id"), F.col("parts")) + F.col("bundle"), F.col("parts"))
    part = F.when(F.col("parts").isNull(), 0).when(F.col("width") > 1, along).otherwise(across)
    cut = ranged.join(F.broadcast(plan), "range", "left").select(
        *rows.columns, F.col("range").cast("long"), part.alias("part")
    )
    totals = cut.groupBy("range", "part").agg(
        F.sum("weight").alias("bytes"), F.sum("rows").alias("rows")
    )
    placed = place([tuple(r) for r in totals.collect()], shards, (total or 0) / shards)
    names = ("range", "part", "shard", "first")
    where = spark.createDataFrame(placed, StructType([StructField(n, LongType()) for n in names]))
    inside = (
        Window.partitionBy("range", "part")
        .orderBy("key", "doc_id", "size", "text_crc32", "bundle")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        cut.withColumn("before", F.sum("rows").over(inside) - F.col("rows"))
        .withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
        .join(F.broadcast(where), ["range", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.col("shard").cast("int").alias("shard"),
            (F.col("first") + F.col("before") + F.col("row")).cast("long").alias("slot"),
        )
    )
