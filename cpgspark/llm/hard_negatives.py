"""Hard negatives from candidate blocks in Hilbert order with min/max zone maps.

Vectors are scaled to integers, so scores are exact.  Candidates are ordered by label and,
inside a label, along a Hilbert curve through the components that vary most, and cut into
blocks of :data:`BLOCK` rows, stored as Parquet.  A block's zone map is the least and
largest value of every component and the labels it holds.  Interval arithmetic on a zone
map bounds the inner product of an anchor with every row of the block from both sides.

Each anchor asks for the best rows inside windows of scores.  A first round reads, for
every stretch of zone maps, the block that promises an anchor most; the k-th best score
found there raises the lower end of the window.  The second round reads all blocks whose
bounds still meet a window, so nothing is missed.  Positives are one open window over rows
of the anchor's label; each positive then gives a window over the rows of other labels.

Anchors meet zone maps, and chosen blocks, in slices of at most :data:`SLICE`; no task
holds more than one block and one slice, and a meeting hands on at most k rows a window.

Defined cases: rows with a null id, label or vector, or with a null or non-finite
component, take no part; shorter vectors count as if zeros followed; rows that share the
anchor's id are not its positives; of repeated rows each is a candidate and each asks;
ties go to the smaller id; an anchor without positives, and a window without rows, give no
rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from cpgspark.llm.ordered import ordered_totals
from cpgspark.plans.durable import store

SCALE = 256
K = 5
#: Scores of negatives, in percent of the positive's: from, to.
FLOOR_PERCENT, CEILING_PERCENT = 80, 100
BLOCK = 2048
SLICE = 1024
#: Zone maps that meet one slice of anchors at once.
ZONES = 512
#: The Hilbert key has 64 bits: so many components with so many bits each.
DIMENSIONS, BITS = 16, 4
_END = 1 << 62


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each row of small integers along the Hilbert curve through their grid."""
    x = cells.astype(np.uint64).T.copy()
    n, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(level), (one << np.uint64(level)) - one
        for i in range(n):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flips = np.zeros(x.shape[1], dtype=np.uint64)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        flips ^= np.where((x[n - 1] & bit) != 0, bit - one, np.uint64(0))
    x ^= flips
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return key


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.int64).reshape(len(flat), -1)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; by floating point where that is exact."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(x.shape[1], 1)
    if most < 2**53:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x @ y.T


def scaled(df: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``label`` and ``q``, the integer vector, of the rows that take part."""
    v = F.col("v")
    rows = df.select(
        F.col(id_col).cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"),
    ).where(
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    rows = rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("q"))
    rows = store(rows, "negatives-rows")
    shortest, longest = rows.agg(F.min(F.size("q")), F.max(F.size("q"))).first()
    if shortest == longest:
        return rows
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("q"))
    return rows.withColumn("q", F.concat("q", zeros))


def with_hilbert_key(rows: DataFrame) -> DataFrame:
    """Add ``key``: the place on the curve through the components that vary most."""
    moments = rows.select(
        Summarizer.metrics("mean", "variance").summary(array_to_vector(F.col("q").cast("array<double>"))).alias("m")
    ).first()["m"]
    mean, spread = np.asarray(moments["mean"]), np.sqrt(np.asarray(moments["variance"]))
    chosen = np.argsort(-spread, kind="stable")[:DIMENSIONS]
    low, width = (mean - 2 * spread)[chosen], np.maximum(4 * spread[chosen], 1) / (1 << BITS)

    @F.arrow_udf("long")
    def key(q: pa.Array) -> pa.Array:
        values = _matrix(q)[:, chosen] if len(chosen) else np.zeros((len(q), 1), np.int64)
        cells = np.clip((values - low) // width, 0, (1 << BITS) - 1) if len(chosen) else values
        place = hilbert_key(cells)
        return pa.array((place ^ np.uint64(1 << 63)).view(np.int64))

    return rows.withColumn("key", key("q"))


def zone_maps(rows: DataFrame) -> DataFrame:
    """``block``, its ``labels``, and ``low`` and ``high`` of every component."""

    def zone(held: pa.Table) -> pa.Table:
        q = _matrix(held["q"])
        return pa.table(
            {
                "block": held["block"][:1],
                "labels": pa.array([np.unique(np.asarray(held["label"])).tolist()], pa.list_(pa.int64())),
                "low": pa.array([q.min(0).tolist()], pa.list_(pa.int64())),
                "high": pa.array([q.max(0).tolist()], pa.list_(pa.int64())),
            }
        )

    return (
        rows.select("block", "label", "q")
        .groupBy("block")
        .applyInArrow(zone, "block long, labels array<long>, low array<long>, high array<long>")
    )


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each anchor with vectors between ``low`` and ``high``."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def chosen_blocks(anchors: DataFrame, zones: DataFrame, stretches: int, same: bool, first: bool) -> DataFrame:
    """``slice``, ``at`` and ``block``: the blocks whose rows each anchor must meet.

    With ``first`` the one block of every stretch of zone maps with the largest bound.
    """

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, np.ndarray] = {"slice": np.zeros(0, np.int64)}
        found["at"] = found["block"] = found["slice"]
        if left.num_rows and right.num_rows:
            least, most = bounds(_matrix(left["q"]), _matrix(right["low"]), _matrix(right["high"]))
            label, kinds = np.asarray(left["label"]), right["labels"].to_pylist()
            if same:
                may = np.array([[x in k for k in kinds] for x in label.tolist()])
            else:
                may = np.array([[k != [x] for k in kinds] for x in label.tolist()])
            low, high = _matrix(left["low"]), _matrix(left["high"])
            meets = np.zeros(may.shape, dtype=bool)
            for j in range(low.shape[1]):
                meets |= (most >= low[:, [j]]) & (least <= high[:, [j]])
            meets &= may
            if first:
                best = np.where(meets, most, -_END).argmax(1)
                one = np.zeros(may.shape, dtype=bool)
                one[np.arange(len(best)), best] = True
                meets &= one
            a, z = np.nonzero(meets)
            found = {
                "slice": np.asarray(left["slice"])[a],
                "at": np.asarray(left["at"])[a],
                "block": np.asarray(right["block"])[z],
            }
        return pa.table({name: pa.array(x, pa.int64()) for name, x in found.items()})

    asked = anchors.select(
        "slice", "at", "label", "q", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(stretches - 1))).alias("stretch")
    )
    slices = anchors.agg(F.max("slice")).first()[0]
    maps = zones.select(
        "*",
        F.floor(F.col("block") / ZONES).cast("int").alias("stretch"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices or 0).cast("long"))).alias("slice"),
    )
    return (
        asked.groupBy("slice", "stretch")
        .cogroup(maps.groupBy("slice", "stretch"))
        .applyInArrow(choose, "slice long, at long, block long")
    )


def read_blocks(anchors: DataFrame, rows: DataFrame, needed: DataFrame, same: bool, k: int) -> DataFrame:
    """``slice``, ``at``, ``window``, ``vec_id`` and ``score``: the best k rows of each block read."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        parts: list[dict[str, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            score = products(_matrix(left["q"]), _matrix(right["q"]))
            ids, own = np.asarray(right["vec_id"]), np.asarray(left["vec_id"])
            equal = np.asarray(left["label"])[:, None] == np.asarray(right["label"])[None, :]
            may = equal & (own[:, None] != ids[None, :]) if same else ~equal
            low, high = _matrix(left["low"]), _matrix(left["high"])
            for j in range(low.shape[1]):
                inside = np.where(may & (score >= low[:, [j]]) & (score <= high[:, [j]]), score, -_END)
                least = np.partition(inside, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(own), -_END)
                a, e = np.nonzero((inside >= least[:, None]) & (inside > -_END))
                order = np.lexsort((ids[e], -inside[a, e], a))
                a, e = a[order], e[order]
                some = np.arange(len(a)) - np.searchsorted(a, a) < k
                a, e = a[some], e[some]
                parts.append(
                    {
                        "slice": np.asarray(left["slice"])[a],
                        "at": np.asarray(left["at"])[a],
                        "window": np.full(len(a), j),
                        "vec_id": ids[e],
                        "score": inside[a, e],
                    }
                )
        names = ("slice", "at", "window", "vec_id", "score")
        none = np.zeros(0, np.int64)
        return pa.table({n: pa.array(np.concatenate([none, *(p[n] for p in parts)]), pa.int64()) for n in names})

    asked = needed.join(anchors, ["slice", "at"])
    read = needed.select(F.col("slice").alias("by"), F.col("block").alias("taken")).distinct()
    held = rows.join(read, F.col("block") == F.col("taken")).select(
        F.col("by").alias("slice"), F.col("taken").alias("block"), "vec_id", "label", "q"
    )
    return (
        asked.groupBy("block", "slice")
        .cogroup(held.groupBy("block", "slice"))
        .applyInArrow(meet, "slice long, at long, window long, vec_id long, score long")
    )


def best_in_windows(anchors: DataFrame, rows: DataFrame, zones: DataFrame, same: bool, k: int) -> DataFrame:
    """``slice``, ``at``, ``window``, ``vec_id``, ``score`` and ``rank`` of each window's best k rows.

    ``anchors`` has ``slice``, ``at``, ``vec_id``, ``label``, ``q`` and the arrays ``low`` and
    ``high`` of its windows, both ends within.
    """
    last = zones.agg(F.max("block")).first()[0] or 0
    stretches = last // ZONES + 1
    order = Window.partitionBy("slice", "at", "window").orderBy(F.desc("score"), "vec_id")

    def round_of(asked: DataFrame, first: bool) -> DataFrame:
        needed = store(chosen_blocks(asked, zones, stretches, same, first), "negatives-needed")
        return read_blocks(asked, rows, needed, same, k).withColumn("rank", F.row_number().over(order))

    reached = (
        round_of(anchors, True)
        .where(F.col("rank") == k)
        .groupBy("slice", "at")
        .agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("reached"))
    )
    raised = F.transform(
        "low", lambda x, j: F.greatest(x, F.coalesce(F.try_element_at("reached", j.cast("long")), x))
    )
    narrowed = anchors.join(reached, ["slice", "at"], "left").withColumn("low", raised).drop("reached")
    return round_of(store(narrowed, "negatives-anchors"), False).where(F.col("rank") <= k)


def mine(
    df: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    k: int = K,
    floor_percent: int = FLOOR_PERCENT,
    ceiling_percent: int = CEILING_PERCENT,
    block: int = BLOCK,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores.

    ``anchors`` says of ``vec_id`` which rows ask; ``label`` is ``df``'s label column by
    default.  Every anchor has its best ``k`` rows of its own label as positives, and every
    positive the best ``k`` rows of other labels that score between the two percentages of it.
    """
    marked = scaled(df, id_col, vector_col, F.col("label") if label is None else label)
    if not marked.limit(1).count():
        return df.sparkSession.createDataFrame(
            [],
            "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
        )
    order = ["label", "key", "vec_id", "q"]
    placed = ordered_totals(store(with_hilbert_key(marked), "negatives-keys"), order, {}, "position")
    rows = store(
        placed.select(F.floor(F.col("position") / block).cast("long").alias("block"), *order), "negatives-blocks"
    )
    zones = store(zone_maps(rows), "negatives-zones")
    asking = ordered_totals(rows.where(anchors).select(*order), order, {}, "at")
    end = F.lit(_END).cast("long")
    asking = store(
        asking.select(
            F.floor(F.col("at") / SLICE).cast("long").alias("slice"),
            "at",
            "vec_id",
            "label",
            "q",
            F.array(-end).alias("low"),
            F.array(end).alias("high"),
        ),
        "negatives-anchors",
    )
    positives = store(
        best_in_windows(asking, rows, zones, True, k).select(
            "slice", "at", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
        ),
        "negatives-positives",
    )

    def lowest(score: Column) -> Column:
        """Least whole score of at least ``floor_percent`` of this one."""
        part = -score * floor_percent
        return -((part - F.pmod(part, F.lit(100))) / 100).cast("long")

    def highest(score: Column) -> Column:
        part = score * ceiling_percent
        return ((part - F.pmod(part, F.lit(100))) / 100).cast("long")

    by_rank = F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score")))
    windows = positives.groupBy("slice", "at").agg(by_rank.alias("positives"))
    asking = asking.drop("low", "high").join(windows, ["slice", "at"])
    # Windows of one anchor are as many as its positives; missing ones hold no score.
    padded = F.concat("positives", F.array_repeat(F.lit(None), F.lit(k) - F.size("positives")))
    asking = store(
        asking.select(
            "slice",
            "at",
            "vec_id",
            "label",
            "q",
            F.transform(padded, lambda p: F.coalesce(lowest(p["positive_score"]), end)).alias("low"),
            F.transform(padded, lambda p: F.coalesce(highest(p["positive_score"]), -end)).alias("high"),
        ),
        "negatives-asking",
    )
    found = best_in_windows(asking, rows, zones, False, k).select(
        "slice",
        "at",
        (F.col("window") + 1).alias("of"),
        F.col("rank").alias("place"),
        F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"),
    )
    names = asking.select("slice", "at", F.col("vec_id").alias("anchor_id"))
    return (
        found.join(positives.withColumnRenamed("rank", "of"), ["slice", "at", "of"])
        .join(names, ["slice", "at"])
        .select(
            "anchor_id",
            "positive_id",
            F.col("place").cast("int").alias("rank"),
            "negative_id",
            "positive_score",
            "negative_score",
        )
    )
