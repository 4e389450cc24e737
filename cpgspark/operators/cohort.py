"""Cohort views and imputation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cpgspark.operators.components import Components, principal_components
from cpgspark.operators.ingest import missing_probes
from cpgspark.operators.neighbours import Nearest, distances as _distance, held_bytes
from cpgspark.operators.vectors import feature_places, probe_names, sample_arrays
from cpgspark.plans.durable import store
from cpgspark.plans.sizing import small_side

NEIGHBOURS = 5
#: Probes of one range: a task holds the values of one range only.
_RANGE = 4096
#: Bytes of one block's values in a range; a block has at least one sample.
_BLOCK_BYTES = 16 << 20
#: Samples of one block at most, however few the probes.
_BLOCK_ROWS = 8192
#: Donors that one task meets at least, where there are so many.
_DONORS = 32_768


def _coordinates(arrays: DataFrame, model: Components) -> DataFrame:
    values = F.col("values")
    return arrays.select(
        *[model.coordinate(values, i).alias(c) for i, c in enumerate("xyz")], "sample_id"
    )


def embed_cohort(m: DataFrame, importances: DataFrame) -> tuple[DataFrame, Components, list[str]]:
    """``x, y, z, sample_id`` from the probes a model uses (importance above 0).

    The coordinates are centred, uncorrelated, and fall in variance from x to z.
    """
    used = importances.filter(F.col("importance") > 0)
    features = feature_places(used)
    if len(features) < 3:
        raise ValueError("three coordinates need at least three used features")
    arrays = store(sample_arrays(m, features), "arrays")
    model = principal_components(arrays, len(features))
    return _coordinates(arrays, model), model, features


def project_samples(
    embedding: DataFrame, m: DataFrame, samples: DataFrame, model: Components, features: list[str]
) -> DataFrame:
    """Add the listed samples that the embedding lacks and that have data."""
    absent = samples.select("sample_id").distinct().join(
        embedding.select("sample_id"), "sample_id", "left_anti"
    )
    rows = m.join(absent, "sample_id", "left_semi")
    placed = _coordinates(sample_arrays(rows, features), model)
    return embedding.select("x", "y", "z", "sample_id").unionByName(placed)


def plot_table(embedding: DataFrame, diagnoses: DataFrame, samples: DataFrame) -> DataFrame:
    """Coordinates with diagnosis and array id; samples without diagnosis drop out."""
    named = embedding.drop("meth_sample_id").join(diagnoses, "sample_id")
    return named.join(samples.select("sample_id", "meth_sample_id"), "sample_id", "left").select(
        "x", "y", "z", "sample_id", "meth_sample_id", "cancerType"
    )


def class_centroids(points: DataFrame, class_col: str = "cancerType") -> DataFrame:
    """Centroid and height of each class in the first two coordinates."""
    return points.groupBy(class_col).agg(
        F.avg("x").alias("centroid_x"),
        F.avg("y").alias("centroid_y"),
        (F.max("y") - F.min("y")).alias("y_range"),
    )


def mean_impute(m: DataFrame) -> DataFrame:
    """Every sample with every probe; what is missing gets the probe's mean."""
    known = m.filter(F.col("value").isNotNull()).select("sample_id", "probe_id", "value")
    means = known.groupBy("probe_id").agg(F.avg("value").alias("value"))
    gaps = missing_probes(m, m.select("probe_id"))
    filled = gaps.join(means, "probe_id").select("sample_id", "probe_id", "value")
    return known.unionByName(filled)


def _tile_sums(
    targets: pd.DataFrame, donors: pd.DataFrame
) -> Iterator[tuple[str, list[float], list[int]]]:
    """Of every target the squared distance and shared probes to each donor, in one range.

    Donors come in name order; a sample shares nothing with itself.
    """
    donors = donors.sort_values("donor")
    a, b = np.stack(targets["values"]), np.stack(donors["donor_values"])
    ka, kb = ~np.isnan(a), ~np.isnan(b)
    a0, b0 = np.where(ka, a, 0.0), np.where(kb, b, 0.0)
    names = donors["donor"].to_numpy()
    for i, target in enumerate(targets["sample_id"]):
        both = kb & ka[i]
        gap = np.where(both, b0 - a0[i], 0.0)
        common = np.where(names == target, 0, both.sum(axis=1))
        yield target, (gap * gap).sum(axis=1), common


def _fill(
    target: str, values: np.ndarray, distance: np.ndarray, b: np.ndarray, names: np.ndarray, k: int, first: int
) -> Iterator[tuple[str, int, float, str, float]]:
    """Of each missing cell of one target the first k donors that have it, ties in name order."""
    gaps = np.flatnonzero(np.isnan(values))
    near = np.flatnonzero(~np.isnan(distance))
    some = 16 * k
    while True:
        part = near
        if some < near.size:
            # The nearest alone, with all of equal distance, unless they leave a gap short.
            part = near[distance[near] <= np.partition(distance[near], some)[some]]
        order = part[np.argsort(distance[part], kind="stable")]  # ties stay in name order
        have = ~np.isnan(b[np.ix_(order, gaps)])
        if part.size == near.size or (have.sum(axis=0) >= k).all():
            break
        some = near.size
    row, gap_at = np.nonzero(have & (np.cumsum(have, axis=0) <= k))
    for j, place in zip(order[row].tolist(), gaps[gap_at].tolist(), strict=True):
        yield target, first + place, float(distance[j]), names[j], float(b[j, place])


def _cells(column: pa.Array) -> np.ndarray:
    """The rows of a column of equally long arrays."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _met(
    batches: Iterator[pa.RecordBatch], k: int, probes: int
) -> Iterator[pa.RecordBatch]:
    """Of each task, whose targets come before its donors, the k nearest of every missing cell."""
    task, names, held, state = None, [], [], None

    def found() -> Iterator[pa.RecordBatch]:
        if state is not None:
            target, place, distance, donor, value = state.result()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays(names).take(pa.array(target)), pa.array(place.astype(np.int32)),
                    pa.array(distance), pa.array(donor), pa.array(value),
                ],
                ["sample_id", "place", "distance", "donor", "value"],
            )

    for batch in batches:
        of, donors = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("task", "donor"))
        cuts = np.flatnonzero((of[1:] != of[:-1]) | (donors[1:] != donors[:-1])) + 1
        for start, end in zip([0, *cuts], [*cuts, len(of)], strict=True):
            if start == end:
                continue
            part = batch.slice(start, end - start)
            if of[start] != task:
                yield from found()
                task, names, held, state = of[start], [], [], None
            given = _cells(part.column("values")), part.column("rank").to_numpy()
            if not donors[start]:
                names.append(part.column("sample_id"))
                held.append(given)
            elif held:
                if state is None:
                    values, ranks = (np.concatenate(x) for x in zip(*held, strict=True))
                    state = Nearest(values, ranks, k, probes)
                state.meet(*given)
    yield from found()


def _tile_guesses(
    targets: pd.DataFrame, donors: pd.DataFrame, k: int, first: int
) -> Iterator[tuple[str, int, float, str, float]]:
    """The k nearest donors of one block that have a missing cell, in one range."""
    donors = donors.sort_values("donor")
    b = np.stack(donors["donor_values"])
    names = donors["donor"].to_numpy()
    for target, values, distance in zip(
        targets["sample_id"], targets["values"], targets["distances"], strict=True
    ):
        yield from _fill(target, values, np.asarray(distance), b, names, k, first)


def knn_impute(m: DataFrame, targets: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """``sample_id, probe_id, value`` of the target samples, every cell filled.

    A missing cell takes the mean of the ``k`` nearest samples that have it, or the
    probe's mean if none does.  Distance is Euclidean over the shared probes, scaled up
    by the share that is shared.

    Samples are cut into blocks and probes into ranges.  Where one range has all probes, a
    task holds a block of targets with gaps and meets donors one after another, in the order
    of their names; it keeps ``k`` donors per gap (:class:`Nearest`).  Else a block of targets
    meets each block of donors range by range; what the ranges add to the distances is
    summed as it arrives, so no task holds more than one range of two blocks and one
    distance per pair of them, however many the probes.  A range then gets the distances
    of those targets that have a gap in it, and hands on at most ``k`` donors per gap
    and block.
    """
    features = probe_names(m)
    width = max(1, min(_RANGE, len(features)))
    ranges = max(1, math.ceil(len(features) / width))
    arrays = store(sample_arrays(m, features, fill=float("nan"), gaps=True), "arrays")
    wanted = small_side(store(targets.select("sample_id").distinct(), "wanted"))
    mine = arrays.join(wanted, "sample_id", "left_semi")
    find = _find if ranges == 1 else _find_by_range
    found = find(arrays, mine, k, len(features), width, ranges)
    nearest = Window.partitionBy("sample_id", "place").orderBy("distance", "donor")
    guesses = (
        found.withColumn("nth", F.row_number().over(nearest))
        .filter(F.col("nth") <= k)
        .groupBy("sample_id", "place")
        .agg(F.avg("value").alias("guess"))
    )
    known = (
        m.join(wanted, "sample_id", "left_semi")
        .filter(F.col("value").isNotNull())
        .select("sample_id", "probe_id", "value")
    )
    named = [(i, p) for i, p in enumerate(features) if p is not None]
    names = m.sparkSession.createDataFrame(named, "place int, probe_id string")
    means = m.groupBy("probe_id").agg(F.avg("value").alias("mean"))
    filled = (
        mine.select("sample_id", F.explode("gaps").alias("place"))
        .join(guesses, ["sample_id", "place"], "left")
        .join(names.join(means, "probe_id", "left"), "place")
        .select("sample_id", "probe_id", F.coalesce("guess", "mean").alias("value"))
    )
    return known.unionByName(filled)


def _numbers(size: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(size - 1)))


def _find(
    arrays: DataFrame, mine: DataFrame, k: int, probes: int, width: int, ranges: int
) -> DataFrame:
    """Of every gap of ``mine`` the k nearest donors, each task's own."""
    spark = arrays.sparkSession
    # Ranks are numbers that rise with the names.
    by_name = arrays.select("sample_id", F.slice("values", 1, width).alias("values")).orderBy(
        F.col("sample_id").asc_nulls_last()
    )
    ranked = store(by_name.withColumn("rank", F.monotonically_increasing_id()), "ranked")
    gaps = F.size(F.filter("values", F.isnan))
    asked = ranked.join(mine.select("sample_id"), "sample_id", "left_semi").filter(gaps > 0)
    asked = store(asked, "asked")
    count, mean = asked.agg(F.count(F.lit(1)), F.avg(gaps)).first()
    per_task = max(1, int(4 * _BLOCK_BYTES / held_bytes(width, mean or 0.0, k)))
    tblocks = max(1, math.ceil(count / per_task))
    # Enough tasks for all cores, however few the targets; each starts anew with its donors.
    cores = spark.sparkContext.defaultParallelism
    dblocks = max(1, min(math.ceil(2 * cores / tblocks), ranked.count() // _DONORS))
    tblocks = max(tblocks, math.ceil(2 * cores / dblocks))
    while tblocks * dblocks % cores and tblocks * dblocks < 4 * cores:
        tblocks += 1

    def dealt(size: int) -> Column:
        return F.pmod(F.xxhash64("rank"), F.lit(size)).cast("int")

    columns = ["task", "donor", "rank", "sample_id", "values"]
    left = asked.withColumn("dblock", _numbers(dblocks)).withColumn("donor", F.lit(False))
    left = left.withColumn("task", dealt(tblocks) * dblocks + F.col("dblock"))
    right = ranked.withColumn("tblock", _numbers(tblocks)).withColumn("donor", F.lit(True))
    right = right.withColumn("task", F.col("tblock") * dblocks + dealt(dblocks))
    right = right.withColumn("sample_id", F.lit(None).cast("string"))
    return (
        left.select(*columns)
        .unionByName(right.select(*columns))
        .repartitionById(tblocks * dblocks, "task")
        .sortWithinPartitions("task", "donor", "rank")
        .mapInArrow(
            lambda batches: _met(batches, k, probes),
            "sample_id string, place int, distance double, donor long, value double",
        )
    )


def _find_by_range(
    arrays: DataFrame, mine: DataFrame, k: int, probes: int, width: int, ranges: int
) -> DataFrame:
    """Of every gap of ``mine`` the k nearest donors of each block."""
    per_block = max(1, min(_BLOCK_ROWS, _BLOCK_BYTES // (8 * width)))
    gappy = F.exists("values", F.isnan)
    asked = mine.drop("gaps").filter(gappy)
    tblocks, dblocks = (max(1, math.ceil(d.count() / per_block)) for d in (asked, arrays))

    def tiles(rows: DataFrame, blocks: int, block_col: str) -> DataFrame:
        cut = F.transform(
            F.sequence(F.lit(0), F.lit(ranges - 1)),
            lambda r: F.struct(
                r.alias("range"), F.slice("values", r * width + 1, F.lit(width)).alias("values")
            ),
        )
        block = F.pmod(F.xxhash64("sample_id"), F.lit(blocks)).cast("int").alias(block_col)
        return rows.select("sample_id", block, F.explode(cut).alias("tile")).select(
            "sample_id", block_col, "tile.*"
        )

    keys = ["tblock", "dblock", "range"]
    left = tiles(asked, tblocks, "tblock")
    right = tiles(arrays, dblocks, "dblock").withColumnsRenamed(
        {"sample_id": "donor", "values": "donor_values"}
    )
    given = right.withColumn("tblock", _numbers(tblocks))

    def sums(key: tuple, t: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        made = _tile_sums(t, d) if len(t) and len(d) else ()
        lists = ((target, squares.tolist(), shared.tolist()) for target, squares, shared in made)
        out = pd.DataFrame(lists, columns=["sample_id", "squares", "shared"])
        return out.assign(tblock=key[0], dblock=key[1])

    parts = (
        left.withColumn("dblock", _numbers(dblocks))
        .groupBy(keys)
        .cogroup(given.groupBy(keys))
        .applyInPandas(
            sums,
            "sample_id string, squares array<double>, shared array<long>, tblock int, dblock int",
        )
    )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list[np.ndarray]] = {}
        block = None
        for batch in batches:
            for row in range(batch.num_rows):
                target = batch.column("sample_id")[row].as_py()
                new = [batch.column(c)[row].values.to_numpy() for c in ("squares", "shared")]
                if target in totals:
                    totals[target] = [x + y for x, y in zip(totals[target], new, strict=True)]
                else:
                    totals[target] = [np.array(x) for x in new]
                block = batch.column("dblock")[row].as_py()
        for target, (squares, shared) in totals.items():
            distance = _distance(probes, squares, shared)
            yield pa.RecordBatch.from_arrays(
                [pa.array([target]), pa.array([block], pa.int32()), pa.array([distance.tolist()])],
                ["sample_id", "dblock", "distances"],
            )

    distances = parts.groupBy("tblock", "dblock").applyInArrow(
        add_up, "sample_id string, dblock int, distances array<double>"
    )
    open_tiles = left.filter(gappy)
    needed = open_tiles.select("tblock", "range").distinct()

    def guess(key: tuple, t: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        made = _tile_guesses(t, d, k, int(key[2]) * width) if len(t) and len(d) else ()
        return pd.DataFrame(made, columns=["sample_id", "place", "distance", "donor", "value"])

    return (
        open_tiles.join(distances, "sample_id")
        .groupBy(keys)
        .cogroup(given.join(needed, ["tblock", "range"], "left_semi").groupBy(keys))
        .applyInPandas(guess, "sample_id string, place int, distance double, donor string, value double")
    )
