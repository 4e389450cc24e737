"""Random forests whose nodes stay in files.

Spark's own trainer keeps every node of every tree on the driver and sends a full table of
bins for each of them, however few rows it has.  A deep forest has about as many leaves as
bagged rows, so above ``DRIVER_NODES`` expected nodes the trees are grown here: nodes of many
rows by summed bin counts, level by level over all trees; what is below them by tasks, each of
which has the rows of one subtree.  Bins, bagging, feature subsets, impurities, pruning and
votes are those of Spark's trees; the random numbers are not.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.base import _FitMultipleIterator
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from cpgspark.plans.durable import store

#: Expected nodes up to which Spark's own trainer grows the forest.
DRIVER_NODES = 1 << 17
#: About what the rows of one subtree take in a task.
_LOCAL_BYTES = 64 << 20
#: Bytes of bin counts that one pass over the rows sums up.
_COUNT_BYTES = 128 << 20
#: Poisson(1): a row's copies in a tree, by the first bound above its uniform number.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(17)])
_NODES = (
    "tree int, unit int, feature binary, cut binary, left binary, dist binary, importance array<double>"
)


# --- one subtree ---------------------------------------------------------------------------


def _worth(counts: np.ndarray, impurity: str) -> np.ndarray:
    """Of weighted class counts: what makes gain = worth(left) + worth(right) - worth(all)."""
    whole = counts.sum(axis=-1)
    if impurity == "gini":
        return np.einsum("...c,...c->...", counts, counts) / np.where(whole > 0, whole, 1.0)
    logs = (counts * np.log2(np.where(counts > 0, counts, 1.0))).sum(axis=-1)
    return logs - whole * np.log2(np.where(whole > 0, whole, 1.0))


def _subsets(rng: np.random.Generator, nodes: int, width: int, size: int) -> np.ndarray:
    """``size`` different features for every node."""
    if size >= width:
        return np.tile(np.arange(width), (nodes, 1))
    step = max(1, (1 << 21) // width)
    parts = [
        np.argpartition(rng.random((min(step, nodes - i), width)), size, axis=1)[:, :size]
        for i in range(0, nodes, step)
    ]
    return np.sort(np.concatenate(parts), axis=1)


def _best_cuts(x, y, n, rows, slot, totals, setup, rng):
    """Of every open node the gain, feature and bin of its best cut."""
    weights, size, impurity, min_rows = setup
    classes = len(weights)
    whole = _worth(totals * weights, impurity)
    chosen = _subsets(rng, len(totals), x.shape[1], size)
    best = np.zeros(len(totals))
    feature, cut = np.full(len(totals), -1), np.zeros(len(totals), int)
    least = 1e-12 * (totals @ weights)
    short = slot.astype(np.uint16) if len(totals) <= 1 << 16 else slot
    labels, copies = y[rows], n[rows]
    for j in range(chosen.shape[1]):
        bins = x[rows, chosen[slot, j]]
        order = np.argsort(bins, kind="stable")
        order = order[np.argsort(short[order], kind="stable")]
        s, b = slot[order], bins[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        cell = np.cumsum(new) - 1
        of, at = s[new], b[new]
        counts = np.bincount(
            cell * classes + labels[order], weights=copies[order], minlength=len(of) * classes
        ).reshape(-1, classes)
        start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        left = np.cumsum(counts, axis=0)
        left -= (left[start] - counts[start])[of]
        right = totals[of] - left
        gain = _worth(left * weights, impurity) + _worth(right * weights, impurity) - whole[of]
        gain[(left.sum(axis=1) < min_rows) | (right.sum(axis=1) < min_rows)] = -np.inf
        top = np.maximum.reduceat(gain, start)
        hit = np.flatnonzero(gain == top[of])[::-1]  # the first of equal cuts is written last
        where = np.empty(len(totals), int)
        where[of[hit]] = hit
        better = top > np.maximum(best, least)
        best[better] = top[better]
        feature[better] = chosen[better, j]
        cut[better] = at[where[better]]
    return best, feature, cut


def grow_subtree(x, y, n, depth, setup, rng):
    """Nodes of a tree on binned rows ``x``, classes ``y`` and copies ``n``.

    Returns feature (-1: leaf), cut (bins up to it go left), left (right is the next; of a leaf
    the number of its line in the shares, as -1 - number), shares of the classes in the leaves
    and the importance of every feature.  Leaves of one parent that call the same class are
    merged.
    """
    weights, _, _, min_rows = setup
    classes = len(weights)
    totals = np.bincount(y, weights=n, minlength=classes)[None, :]
    rows, node = np.arange(len(y)), np.zeros(len(y), int)
    levels, base = [], 0
    for level in range(depth + 1):
        size = len(totals)
        feature, cut = np.full(size, -1), np.zeros(size, int)
        left, gain = np.zeros(size, int), np.zeros(size)
        opened = ((totals > 0).sum(axis=1) > 1) & (totals.sum(axis=1) >= 2 * min_rows) & (level < depth)
        levels.append((feature, cut, left, gain, totals))
        if not opened.any():
            break
        at = np.flatnonzero(opened)
        slots = np.full(size, -1)
        slots[at] = np.arange(len(at))
        slot = slots[node]
        rows, slot = rows[slot >= 0], slot[slot >= 0]
        gain[at], feature[at], cut[at] = _best_cuts(x, y, n, rows, slot, totals[at], setup, rng)
        cutting = feature[at] >= 0
        if not cutting.any():
            break
        place = np.cumsum(cutting) - 1
        left[at[cutting]] = base + size + 2 * place[cutting]
        rows, slot = rows[cutting[slot]], slot[cutting[slot]]
        node = 2 * place[slot] + (x[rows, feature[at][slot]] > cut[at][slot])
        made = 2 * int(cutting.sum())
        totals = np.bincount(
            node * classes + y[rows], weights=n[rows], minlength=made * classes
        ).reshape(-1, classes)
        base += size
    starts = np.cumsum([0] + [len(part[0]) for part in levels])
    feature, cut, left, gain, totals = (np.concatenate(c) for c in zip(*levels, strict=True))
    weighed = totals * weights
    called = weighed.argmax(axis=1)
    for first, last in zip(starts[-2::-1], starts[:0:-1], strict=True):
        inner = first + np.flatnonzero(feature[first:last] >= 0)
        a = left[inner]
        alike = (feature[a] < 0) & (feature[a + 1] < 0) & (called[a] == called[a + 1])
        feature[inner[alike]] = -1
    kept = np.zeros(len(feature), bool)
    kept[0] = True
    for first, last in zip(starts[:-1], starts[1:], strict=True):
        a = left[first:last][kept[first:last] & (feature[first:last] >= 0)]
        kept[a] = kept[a + 1] = True
    number = np.cumsum(kept) - 1
    left = np.where(feature >= 0, number[left], 0)[kept]
    feature, cut, gain, weighed = feature[kept], cut[kept], gain[kept], weighed[kept]
    leaf = feature < 0
    left[leaf] = -1 - np.arange(leaf.sum())
    shares = weighed[leaf] / weighed[leaf].sum(axis=1, keepdims=True)
    importance = np.bincount(feature[~leaf], weights=gain[~leaf], minlength=x.shape[1])
    return feature, cut, left, shares, importance


def _walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The node without a cut that every row ends in."""
    at = np.zeros(len(x), np.int64)
    alive = np.arange(len(x))
    while alive.size:
        alive = alive[feature[at[alive]] >= 0]
        here = at[alive]
        at[alive] = left[here] + (x[alive, feature[here]] > cut[here])
    return at


# --- rows ----------------------------------------------------------------------------------


def _copies(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree: a digest of row, tree and seed, read as a Poisson number."""
    mixed = (seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF
    z = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(mixed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z ^= z >> np.uint64(31)
    return np.searchsorted(_POISSON, (z >> np.uint64(11)) * 2.0**-53, side="right")


def _bins_of(column: pa.Array) -> np.ndarray:
    """The binned rows of a column of equally long binaries."""
    if not len(column):
        return np.zeros((0, 0), np.uint8)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _bounds(values: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Of every feature the values that separate its bins: quantiles of all rows, each once."""
    shares = F.lit([i / bins for i in range(1, bins)])
    found = (
        values.select(F.posexplode("values").alias("place", "value"))
        .groupBy("place")
        .agg(F.percentile_approx("value", shares, 1000).alias("cuts"), F.max("value").alias("top"))
    )
    bounds = [np.zeros(0)] * width
    for r in found.collect():
        cuts = np.unique(r["cuts"])
        bounds[r["place"]] = cuts[cuts < r["top"]]
    return bounds


def _binned(rows: DataFrame, bounds: list[np.ndarray]) -> DataFrame:
    """``values`` replaced by ``bins``, one byte a feature."""
    kept = [c for c in rows.columns if c != "values"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("values")
            values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(bounds))
            bins = np.empty(values.shape, np.uint8)
            for i, cuts in enumerate(bounds):
                bins[:, i] = np.searchsorted(cuts, values[:, i], side="left")
            coded = pa.array([row.tobytes() for row in bins], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), coded], [*kept, "bins"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, "values").mapInArrow(code, f"{schema}, bins binary")


def _spread(spark: SparkSession, amount: float) -> int:
    """Partitions for ``amount`` bytes: about 64 MB each, and three for each core."""
    return max(3 * spark.sparkContext.defaultParallelism, math.ceil(amount / (64 << 20)))


# --- the upper nodes -----------------------------------------------------------------------


class _Top:
    """The upper nodes of one tree; ``state`` is cut, open, unit (grown by a task) or leaf."""

    def __init__(self, rows: int, limit: int) -> None:
        self.feature, self.cut, self.left = [-1], [0], [0]
        self.depth, self.state = [0], ["open" if rows > limit else "unit"]
        self.shares: dict[int, np.ndarray] = {}

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature), np.array(self.cut), np.array(self.left)

    def add(self, rows: float, depth: int, limit: int) -> None:
        self.feature.append(-1)
        self.cut.append(0)
        self.left.append(0)
        self.depth.append(depth)
        self.state.append("open" if rows > limit else "unit")


def _grow_tops(coded, tops, setup, width, bins, max_depth, limit, seed, importance) -> None:
    """Cut the nodes of more than ``limit`` rows by bin counts summed over all rows."""
    weights, size, impurity, min_rows = setup
    classes = len(weights)
    per_pass = max(1, _COUNT_BYTES // (8 * size * bins * classes))

    def subset(tree: int, node: int) -> np.ndarray:
        return _subsets(np.random.default_rng([seed, tree, node]), 1, width, size)[0]

    while True:
        waiting = [(t, i) for t, top in enumerate(tops) for i, s in enumerate(top.state) if s == "open"]
        if not waiting:
            return
        part = waiting[:per_pass]
        nodes: dict[int, list[int]] = {}
        for t, i in part:
            nodes.setdefault(t, []).append(i)
        trees = {t: tops[t].arrays() for t in nodes}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {(t, i): np.zeros((size, bins, classes)) for t in nodes for i in nodes[t]}
            chosen = {key: subset(*key) for key in sums}
            for batch in batches:
                x = _bins_of(batch.column("bins"))
                row, y = (batch.column(c).to_numpy() for c in ("row", "label"))
                for t, arrays in trees.items():
                    n = _copies(row, t, seed)
                    at = _walk(x, *arrays)
                    for i in nodes[t]:
                        mine = np.flatnonzero((at == i) & (n > 0))
                        for j, f in enumerate(chosen[t, i]):
                            cell = x[mine, f].astype(int) * classes + y[mine]
                            sums[t, i][j] += np.bincount(
                                cell, weights=n[mine], minlength=bins * classes
                            ).reshape(bins, classes)
            for (t, i), found in sums.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t], pa.int32()), pa.array([i], pa.int32()), pa.array([found.ravel().tolist()])],
                    ["tree", "node", "counts"],
                )

        def choose(key: tuple, table: pa.Table) -> pa.Table:
            tree, node = (k.as_py() for k in key)
            counts = sum(np.array(c) for c in table.column("counts").to_pylist()).reshape(size, bins, classes)
            left = np.cumsum(counts, axis=1)
            whole = left[0, -1]
            right = whole - left
            gain = _worth(left * weights, impurity) + _worth(right * weights, impurity)
            gain -= _worth(whole * weights, impurity)
            gain[(left.sum(axis=-1) < min_rows) | (right.sum(axis=-1) < min_rows)] = -np.inf
            j, b = np.unravel_index(gain.argmax(), gain.shape)
            worth = float(gain[j, b])
            feature = int(subset(tree, node)[j]) if worth > 1e-12 * float(whole @ weights) else -1
            line = {
                "tree": tree, "node": node, "feature": feature, "cut": int(b), "gain": worth,
                "lower": left[j, b].tolist(), "whole": whole.tolist(),
            }
            return pa.Table.from_pylist([line], schema=pa.schema([
                ("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()),
                ("gain", pa.float64()), ("lower", pa.list_(pa.float64())), ("whole", pa.list_(pa.float64())),
            ]))

        summed = coded.mapInArrow(count, "tree int, node int, counts array<double>")
        cuts = summed.groupBy("tree", "node").applyInArrow(
            choose,
            "tree int, node int, feature int, cut int, gain double, lower array<double>, whole array<double>",
        )
        for r in cuts.orderBy("tree", "node").collect():
            top, i = tops[r["tree"]], r["node"]
            depth = top.depth[i]
            if r["feature"] < 0 or depth >= max_depth:
                weighed = np.array(r["whole"]) * weights
                top.state[i], top.shares[i] = "leaf", weighed / weighed.sum()
                continue
            top.feature[i], top.cut[i], top.left[i] = r["feature"], r["cut"], len(top.state)
            top.state[i] = "cut"
            importance[r["tree"], r["feature"]] += r["gain"]
            for rows in (sum(r["lower"]), sum(r["whole"]) - sum(r["lower"])):
                top.add(rows, depth + 1, limit)


# --- the estimator -------------------------------------------------------------------------


def _subset_size(strategy: str, width: int, n_trees: int) -> int:
    """Features tried at a node, by Spark's rules."""
    if strategy == "auto":
        strategy = "all" if n_trees == 1 else "sqrt"
    if strategy == "all":
        return width
    if strategy == "sqrt":
        return math.ceil(math.sqrt(width))
    if strategy == "log2":
        return max(1, math.ceil(math.log2(width)))
    if strategy == "onethird":
        return math.ceil(width / 3)
    if strategy.isdigit():
        return min(int(strategy), width)
    return max(1, math.ceil(float(strategy) * width))


class Forest(RandomForestClassifier):
    """Spark's random forest; one of many nodes is grown by the executors and stays in files."""

    def _fit(self, dataset: DataFrame) -> Model:
        if self._in_files(dataset):
            return self._grow(dataset) or super()._fit(dataset)
        return super()._fit(dataset)

    def _in_files(self, dataset: DataFrame) -> bool:
        trees = self.getNumTrees()
        plain = self.getBootstrap() and self.getSubsamplingRate() == 1.0 and self.getMinInfoGain() == 0.0
        plain = plain and self.getMinWeightFractionPerNode() == 0.0 and self.getMaxBins() <= 256
        if not plain or trees * 2 ** (self.getMaxDepth() + 1) <= DRIVER_NODES:
            return False
        # A tree has below two nodes for each of its rows, of which it has 63 %.
        return trees * 1.26 * dataset.count() > DRIVER_NODES

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence[dict]) -> Iterator[tuple[int, Model]]:
        """Models by setting; of settings that differ in the number of trees alone the trees are grown once.

        A tree in files depends on its own number and the seed, not on how many there are.
        """
        settings = [self.copy(p) for p in paramMaps]
        groups: dict[tuple, list[int]] = {}
        for i, p in enumerate(paramMaps):
            rest = {k.name: v for k, v in p.items() if k.name != "numTrees"}
            single = settings[i].getNumTrees() == 1  # "auto" takes all features for one tree
            groups.setdefault((single, repr(sorted(rest.items()))), []).append(i)
        group_of = {i: key for key, members in groups.items() for i in members}
        locks = {key: Lock() for key in groups}
        largest: dict[tuple, Model] = {}

        def fit(i: int) -> Model:
            key = group_of[i]
            most = max(groups[key], key=lambda j: settings[j].getNumTrees())
            if len(groups[key]) == 1 or not settings[i]._in_files(dataset):
                return settings[i].fit(dataset)
            with locks[key]:
                if key not in largest:
                    largest[key] = settings[most].fit(dataset)
            model = largest[key]
            if i == most:
                return model
            if not isinstance(model, FilesModel):
                return settings[i].fit(dataset)
            return model.first(settings[i].getNumTrees())

        return _FitMultipleIterator(fit, len(paramMaps))

    def _grow(self, dataset: DataFrame) -> FilesModel | None:
        """The forest in files; None where rows of one class differ in weight."""
        spark = dataset.sparkSession
        n_trees, bins, seed = self.getNumTrees(), self.getMaxBins(), self.getSeed() & 0x7FFFFFFF
        weight = F.col(self.getWeightCol()) if self.isDefined(self.weightCol) else F.lit(1.0)
        rows = dataset.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(self.getLabelCol()).cast("int").alias("label"),
            weight.cast("double").alias("weight"),
            vector_to_array(self.getFeaturesCol()).alias("values"),
        )
        rows = store(rows, "forest-rows")
        sizes = rows.groupBy("label").agg(
            F.count(F.lit(1)).alias("n"), F.min("weight").alias("low"), F.max("weight").alias("high")
        ).collect()
        if any(r["low"] != r["high"] for r in sizes):
            return None
        attr = dataset.schema[self.getLabelCol()].metadata.get("ml_attr", {})
        classes = len(attr["vals"]) if "vals" in attr else max(r["label"] for r in sizes) + 1
        weights = np.zeros(classes)
        for r in sizes:
            weights[r["label"]] = r["low"]
        width = len(rows.select("values").first()["values"])
        total = sum(r["n"] for r in sizes)
        bounds = _bounds(rows, width, bins)
        coded = store(_binned(rows.drop("weight"), bounds), "forest-bins")
        coded = coded.repartition(_spread(spark, total * n_trees * (width + 24)), "row")
        limit = max(1, _LOCAL_BYTES // (width + 40 + 48 * classes))
        size = _subset_size(self.getFeatureSubsetStrategy(), width, n_trees)
        setup = (weights, size, self.getImpurity(), self.getMinInstancesPerNode())
        depth = self.getMaxDepth()
        tops = [_Top(total, limit) for _ in range(n_trees)]
        upper = np.zeros((n_trees, width))
        _grow_tops(coded, tops, setup, width, bins, depth, limit, seed, upper)
        trees = [top.arrays() for top in tops]
        units = [np.array([s == "unit" for s in top.state]) for top in tops]
        depths = [top.depth for top in tops]

        def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["tree", "unit", "row", "label", "n", "bins"]
            for batch in batches:
                x = _bins_of(batch.column("bins"))
                row = batch.column("row").to_numpy()
                for t, arrays in enumerate(trees):
                    n, at = _copies(row, t, seed), _walk(x, *arrays)
                    mine = np.flatnonzero((n > 0) & units[t][at])
                    if mine.size:
                        take = pa.array(mine)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(mine.size, t, np.int32)),
                                pa.array(at[mine].astype(np.int32)),
                                batch.column("row").take(take),
                                batch.column("label").take(take),
                                pa.array(n[mine].astype(np.int32)),
                                batch.column("bins").take(take),
                            ],
                            names,
                        )

        def plant(key: tuple, table: pa.Table) -> pa.Table:
            tree, unit = (k.as_py() for k in key)
            order = np.argsort(table.column("row").to_numpy(), kind="stable")
            x = _bins_of(table.column("bins").combine_chunks())[order]
            y, n = (table.column(c).to_numpy()[order] for c in ("label", "n"))
            rng = np.random.default_rng([seed, tree, unit, 1])
            grown = grow_subtree(x, y.astype(int), n, depth - depths[tree][unit], setup, rng)
            return _node_table([_node_line(tree, unit, *grown)])

        bagged = coded.mapInArrow(bag, "tree int, unit int, row long, label int, n int, bins binary")
        parts = _spread(spark, 0.63 * total * n_trees * (width + 24))
        nodes = bagged.repartition(parts, "tree", "unit").groupBy("tree", "unit").applyInArrow(plant, _NODES)
        leaves = [
            _node_line(t, i, np.array([-1]), np.array([0]), np.array([-1]), share[None, :], np.zeros(width))
            for t, top in enumerate(tops)
            for i, share in top.shares.items()
        ]
        if leaves:
            nodes = nodes.unionByName(spark.createDataFrame([_row(x) for x in leaves], _NODES))
        model = FilesModel()._given(store(nodes, "forest-nodes"), bounds, trees, upper, classes)
        model._features_col = self.getFeaturesCol()
        return model


def _node_line(tree, unit, feature, cut, left, shares, importance) -> dict:
    return {
        "tree": tree,
        "unit": unit,
        "feature": feature.astype(np.int32).tobytes(),
        "cut": cut.astype(np.uint8).tobytes(),
        "left": left.astype(np.int32).tobytes(),
        "dist": shares.astype(np.float64).tobytes(),
        "importance": importance.astype(float).tolist(),
    }


def _row(line: dict) -> tuple:
    return tuple(bytearray(v) if isinstance(v, bytes) else v for v in line.values())


def _node_table(lines: list[dict]) -> pa.Table:
    ints, blobs = ("tree", "unit"), ("feature", "cut", "left", "dist")
    fields = [*((c, pa.int32()) for c in ints), *((c, pa.binary()) for c in blobs)]
    return pa.Table.from_pylist(lines, schema=pa.schema([*fields, ("importance", pa.list_(pa.float64()))]))


# --- the model -----------------------------------------------------------------------------


class FilesModel(Model, MLWritable, MLReadable):
    """A forest whose nodes are rows of a stored table, a row for each subtree.

    Rows meet the subtrees in slices of both, so a task holds some subtrees and some rows.
    """

    _features_col = "features"

    def _given(self, nodes, bounds, trees, upper, classes) -> FilesModel:
        self.nodes, self.bounds, self.trees = nodes, bounds, trees
        self.upper, self.classes = upper, classes
        return self

    def copy(self, extra=None) -> FilesModel:
        made = FilesModel()._given(self.nodes, self.bounds, self.trees, self.upper, self.classes)
        made._features_col = self._features_col
        return made

    def first(self, trees: int) -> FilesModel:
        """The forest of the first trees alone."""
        made = self.copy()
        made.nodes = self.nodes.where(F.col("tree") < trees)
        made.trees, made.upper = self.trees[:trees], self.upper[:trees]
        return made

    @property
    def featureImportances(self) -> DenseVector:
        """As in Spark: gains of a tree to a sum of 1, trees added up, that to a sum of 1."""
        sums = self.upper.copy()
        found = self.nodes.select("tree", F.posexplode("importance").alias("place", "gain"))
        # Trees times features numbers, as many as the split totals of the upper nodes.
        for r in found.where("gain > 0").groupBy("tree", "place").agg(F.sum("gain").alias("gain")).toLocalIterator():
            sums[r["tree"], r["place"]] += r["gain"]
        each = sums.sum(axis=1, keepdims=True)
        shares = np.divide(sums, each, out=np.zeros_like(sums), where=each > 0).sum(axis=0)
        return DenseVector(shares / shares.sum() if shares.sum() > 0 else shares)

    def _slices(self) -> tuple[DataFrame, int]:
        """``nodes`` with ``slice``: neighbouring subtrees of about 64 MB, more slices than cores."""
        spark = self.nodes.sparkSession
        size = F.octet_length("feature") + F.octet_length("cut") + F.octet_length("left") + F.octet_length("dist")
        sizes = self.nodes.select("tree", "unit", size.alias("size")).orderBy("tree", "unit").collect()
        whole = sum(r["size"] for r in sizes)
        step = max(1, min(_LOCAL_BYTES, math.ceil(whole / (2 * spark.sparkContext.defaultParallelism))))
        placed, before = [], 0
        for r in sizes:
            placed.append((r["tree"], r["unit"], before // step))
            before += r["size"]
        numbers = {old: new for new, old in enumerate(sorted({p[2] for p in placed}))}
        rows = [(t, u, numbers[s]) for t, u, s in placed]
        table = spark.createDataFrame(rows, "tree int, unit int, slice int")
        return self.nodes.drop("importance").join(F.broadcast(table), ["tree", "unit"]), len(numbers)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees, classes, width = self.trees, self.classes, len(self.bounds)
        rows = store(dataset.withColumn("__row", F.monotonically_increasing_id()), "forest-asked")
        coded = _binned(
            rows.select(F.col("__row").alias("row"), vector_to_array(self._features_col).alias("values")),
            self.bounds,
        )
        chunks = max(1, math.ceil(rows.count() * (width + 8 * classes + 24) / _LOCAL_BYTES))
        sliced, slices = self._slices()

        def every(size: int):
            return F.explode(F.sequence(F.lit(0), F.lit(size - 1)))

        asked = coded.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
        asked = asked.withColumn("slice", every(slices))
        sliced = sliced.withColumn("chunk", every(chunks))

        def vote(key: tuple, given: pa.Table, subtrees: pa.Table) -> pa.Table:
            x = _bins_of(given.column("bins").combine_chunks()) if given.num_rows else np.zeros((0, width), np.uint8)
            votes = np.zeros((len(x), classes))
            routes: tuple[int, np.ndarray] = (-1, np.zeros(0, int))
            lines = subtrees.sort_by([("tree", "ascending"), ("unit", "ascending")]) if len(x) else subtrees.slice(0, 0)
            for i in range(lines.num_rows):
                tree, unit = lines.column("tree")[i].as_py(), lines.column("unit")[i].as_py()
                feature, cut, left, dist = (
                    np.frombuffer(lines.column(c)[i].as_py(), kind)
                    for c, kind in (("feature", np.int32), ("cut", np.uint8), ("left", np.int32), ("dist", float))
                )
                if routes[0] != tree:
                    routes = (tree, _walk(x, *trees[tree]))
                mine = np.flatnonzero(routes[1] == unit)
                leaf = _walk(x[mine], feature, cut, left)
                votes[mine] += dist.reshape(-1, classes)[-1 - left[leaf]]
            flat = pa.array(votes.ravel())
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * classes)
            number = pa.array(np.full(len(x), key[0].as_py(), np.int32))
            return pa.Table.from_arrays(
                [given.column("row").combine_chunks(), number, pa.ListArray.from_arrays(ends, flat)],
                schema=pa.schema([("row", pa.int64()), ("slice", pa.int32()), ("votes", pa.list_(pa.float64()))]),
            )

        keys = ["slice", "chunk"]
        parts = max(1, min(slices * chunks, 3 * rows.sparkSession.sparkContext.defaultParallelism))
        voted = (
            asked.repartition(parts, *keys)
            .groupBy(*keys)
            .cogroup(sliced.repartition(parts, *keys).groupBy(*keys))
            .applyInArrow(vote, "row long, slice int, votes array<double>")
        )
        # Added in the order of the slices, so that the sum is the same in every run.
        ordered = F.array_sort(F.collect_list(F.struct("slice", "votes")))
        nothing = F.array_repeat(F.lit(0.0), classes)
        summed = F.aggregate(ordered, nothing, lambda a, v: F.zip_with(a, v["votes"], lambda p, q: p + q))
        raw = voted.groupBy(F.col("row").alias("__row")).agg(summed.alias("__raw"))
        shares = F.transform("__raw", lambda v: v / F.lit(float(len(trees))))
        top = F.array_position("__raw", F.array_max("__raw")) - 1
        return (
            rows.join(raw, "__row")
            .withColumn("rawPrediction", array_to_vector("__raw"))
            .withColumn("probability", array_to_vector(shares))
            .withColumn("prediction", top.cast("double"))
            .drop("__row", "__raw")
        )

    def write(self) -> MLWriter:
        return _FilesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FilesReader()


class _FilesWriter(MLWriter):
    def __init__(self, model: FilesModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        model = self.model
        DefaultParamsWriter.saveMetadata(
            model, path, self.sparkSession,
            {"classes": model.classes, "features": model._features_col, "trees": len(model.trees)},
        )
        model.nodes.write.parquet(f"{path}/nodes")
        spark = self.sparkSession
        cuts = [(i, [float(v) for v in b]) for i, b in enumerate(model.bounds)]
        spark.createDataFrame(cuts, "place int, cuts array<double>").write.parquet(f"{path}/bounds")
        tops = [
            (t, *([int(v) for v in a] for a in arrays), [float(v) for v in model.upper[t]])
            for t, arrays in enumerate(model.trees)
        ]
        schema = "tree int, feature array<int>, cut array<int>, left array<int>, importance array<double>"
        spark.createDataFrame(tops, schema).write.parquet(f"{path}/tops")


class _FilesReader(MLReader):
    def load(self, path: str) -> FilesModel:
        spark = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark)
        nodes = spark.read.schema(_NODES).parquet(f"{path}/nodes")
        cuts = spark.read.parquet(f"{path}/bounds").orderBy("place").collect()
        tops = spark.read.parquet(f"{path}/tops").orderBy("tree").collect()
        model = FilesModel()._given(
            nodes,
            [np.array(r["cuts"], float) for r in cuts],
            [tuple(np.array(r[c], int) for c in ("feature", "cut", "left")) for r in tops],
            np.array([r["importance"] for r in tops]),
            meta["classes"],
        )
        model._features_col = meta["features"]
        return model
