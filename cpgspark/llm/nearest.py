"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised on their own, so ``cells`` centroids for each half
make ``cells * cells`` cells.  A query walks the centroid pairs in falling order of their
summed inner products, with a heap over the two sorted lists, until the cells it has
visited hold ``visit`` of all rows and ``k`` rows at least, those of its own id not
counted; their entries are reranked by the exact inner product.

Centroids come from a bounded sample drawn by a hash of the id; every row is indexed.
Entries are laid out by groups of first-half centroids and cut into chunks, queries into
blocks, so no task holds more than one chunk and one block whatever a cell's size; a query
reaches a chunk with a bit for each cell it visits there.  Each meeting hands on at most
``k`` entries a query.

``visit`` decides recall.  On vectors without structure the neighbours lie far apart and
about half of the rows are reranked for a recall above 0.9; the default is set for those.

Defined cases: vectors that are null, zero, of another length than most, or that hold null
or non-finite components take no part; of rows that share a query's id none is its
candidate, and of queries that share an id the one with the smallest vector asks; repeated
entries are each returned; ties go to the smaller id; fewer candidates than ``k`` are all
returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cpgspark.plans.durable import store

K = 20
CELLS = 64
GROUPS = 8
#: Share of all rows in the cells that a query visits.
VISIT = 0.55
SAMPLE_ROWS = 20_000
CHUNK = 8192
BLOCK = 2048
_ROUNDS = 12
_AT_ONCE = 128


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _half_centroids(x: np.ndarray, cells: int) -> np.ndarray:
    """Lloyd's rounds from evenly spaced sample rows; at most one centroid per row."""
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(_ROUNDS):
        near = nearest_centre(x, centres)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(1), axis=1)


def train_index(sample: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of both halves."""
    half = sample.shape[1] // 2
    return _half_centroids(sample[:, :half], cells), _half_centroids(sample[:, half:], cells)


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, need: float) -> np.ndarray:
    """Cells in falling order of ``first[i] + second[j]`` until they hold ``need`` rows.

    ``sizes`` is the number of rows in each cell.  Returns a mask of cells.
    """
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    seen = np.zeros(sizes.shape, dtype=bool)
    order = sizes[np.ix_(a, b)].tolist()
    x, y = first[a].tolist(), second[b].tolist()
    heap, held, done = [(-x[0] - y[0], 0, 0)], 0, []
    while heap and held < need:
        _, i, j = heapq.heappop(heap)
        done.append((i, j))
        held += order[i][j]
        if j + 1 < len(y):
            heapq.heappush(heap, (-x[i] - y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-x[i + 1] - y[0], i + 1, 0))
    ii, jj = np.array(done, dtype=int).reshape(-1, 2).T
    seen[a[ii], b[jj]] = True
    return seen


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def rerank(queries: np.ndarray, query_ids, masks, entries: np.ndarray, entry_ids, cells, k: int):
    """Best ``k`` entries in visited cells for each query: (query row, entry row, score)."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(queries), _AT_ONCE):
        some = slice(start, start + _AT_ONCE)
        scores = queries[some] @ entries.T
        scores[~masks[some][:, cells]] = -np.inf
        scores[query_ids[some][:, None] == entry_ids[None, :]] = -np.inf
        if len(entries) > k:
            least = np.partition(scores, len(entries) - k, axis=1)[:, len(entries) - k]
        else:
            least = np.full(len(scores), -np.inf)
        # A margin for the order of additions; the exact score then decides.
        keep = (scores >= (least - 1e-9 * (1 + np.abs(least)))[:, None]) & (scores > -np.inf)
        q, e = np.nonzero(keep)
        exact = (queries[some][q] * entries[e]).sum(axis=1)
        order = np.lexsort((entry_ids[e], -exact, q))
        q, e, exact = q[order], e[order], exact[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        found.append((q[place < k] + start, e[place < k], exact[place < k]))
    return tuple(np.concatenate(x) for x in zip(*found))


def search(
    df: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    cells: int = CELLS,
    visit: float = VISIT,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's nearest rows.

    Both frames have the id and the vector.
    """
    spark = df.sparkSession

    def vectors(frame: DataFrame) -> DataFrame:
        return frame.select(
            F.col(id_col).cast("long").alias("vec_id"),
            F.col(vector_col).cast("array<double>").alias("v"),
        ).where(usable(F.col("v")) & F.col("vec_id").isNotNull())

    result = "query_id long, rank int, vec_id long, score double"
    usual = (
        vectors(df).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    )
    if usual is None:
        return spark.createDataFrame([], result)
    rows = vectors(df).where(F.size("v") == usual["n"])
    asked = (
        vectors(queries).where(F.size("v") == usual["n"]).groupBy("vec_id").agg(F.min("v").alias("v"))
    )
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample_rows).toPandas()
    index = train_index(np.array(drawn["v"].tolist(), dtype=np.float64), cells)
    half = usual["n"] // 2
    shape = (len(index[0]), len(index[1]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            i, j = nearest_centre(x[:, :half], index[0]), nearest_centre(x[:, half:], index[1])
            yield pa.RecordBatch.from_pydict(
                {"vec_id": batch.column(0), "v": batch.column(1), "cell": pa.array(i * shape[1] + j)}
            )

    placed = store(rows.mapInArrow(assign, "vec_id long, v array<double>, cell long"), "ann-index")
    # One row for each cell that is not empty: cells * cells at most.
    counts = placed.groupBy("cell").count().collect()
    sizes = np.zeros(shape, dtype=np.int64)
    for row in counts:
        sizes.flat[row["cell"]] = row["count"]
    total = int(sizes.sum())
    # Rows of the query's own id are no answers: they come on top of what it visits.
    own = placed.groupBy("vec_id").agg(F.count(F.lit(1)).alias("own"))
    asked = asked.join(own, "vec_id", "left").select("vec_id", "v", F.coalesce("own", F.lit(0)).alias("own"))
    group_of = np.arange(shape[0]) * GROUPS // shape[0]
    chunks = np.maximum(-(-np.bincount(group_of, sizes.sum(1), GROUPS) // CHUNK), 1).astype(int)
    blocks = -(-asked.count() // BLOCK) or 1

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per query and group with the visited cells as bits."""
        for batch in batches:
            x = _matrix(batch.column(1))
            first, second = x[:, :half] @ index[0].T, x[:, half:] @ index[1].T
            out: dict[str, list[Any]] = {"query": [], "v": [], "group": [], "bits": []}
            for row, (query, vector, own) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]))):
                need = own + max(visit * (total - own), k)
                seen = walk(first[row], second[row], sizes, need)
                for group in range(GROUPS):
                    if (mask := seen[group_of == group]).any():
                        out["query"].append(query)
                        out["v"].append(vector)
                        out["group"].append(group)
                        out["bits"].append(np.packbits(mask).tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=plan_arrow)

    plan_arrow = pa.schema(
        [("query", pa.int64()), ("v", pa.list_(pa.float64())), ("group", pa.int64()), ("bits", pa.binary())]
    )
    number = F.array(*[F.lit(int(c)) for c in chunks])
    groups = F.array(*[F.lit(int(g)) for g in group_of])
    entries = placed.withColumn(
        "group", F.get(groups, F.floor(F.col("cell") / shape[1]).cast("int")).cast("long")
    )
    entries = entries.select(
        "vec_id",
        "v",
        "cell",
        "group",
        F.pmod(F.xxhash64("vec_id", "v"), F.get(number, F.col("group").cast("int")))
        .cast("int")
        .alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    spread = asked.mapInArrow(plan, "query long, v array<double>, group long, bits binary").select(
        "*",
        F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(
            F.sequence(F.lit(0), F.get(number, F.col("group").cast("int")) - 1)
        ).alias("chunk"),
    )

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if left.empty or right.empty:
            return none.astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        group = int(left["group"].iloc[0])
        base = int(np.flatnonzero(group_of == group)[0]) * shape[1]
        width = int((group_of == group).sum()) * shape[1]
        masks = np.unpackbits(
            np.frombuffer(b"".join(left["bits"]), np.uint8).reshape(len(left), -1), axis=1
        )[:, :width].astype(bool)
        ids, entry_ids = left["query"].to_numpy(), right["vec_id"].to_numpy()
        q, e, score = rerank(
            np.stack(left["v"]), ids, masks, np.stack(right["v"]), entry_ids,
            right["cell"].to_numpy() - base, k,
        )
        return pd.DataFrame({"query_id": ids[q], "vec_id": entry_ids[e], "score": score})

    key = ["group", "chunk", "block"]
    best = (
        spread.groupBy(*key)
        .cogroup(entries.groupBy(*key))
        .applyInPandas(meet, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
