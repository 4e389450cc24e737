"""Quality classifier: an additive model with pairwise interactions.

Each feature of a text is cut into quantile bins.  Cyclic boosting visits the features in
turn and adds a shrunken tree of three leaves to the feature's lookup table; then the
pairs of features with most left to explain get two-dimensional tables of four-leaf trees
in the same way.  A score is the logistic of the bins' table values added up.

The fit runs on the driver over a sample of at most ``max_rows`` labelled rows (a stated
bound, drawn by a hash of the id), held as one small matrix.  Features are computed by
Spark tasks over whole texts, for the sample as for the scoring.

Defined cases: null and empty texts have all counts at zero and are scored like any
other; rows without a label, or with a null one, teach nothing; without any label every
score is 0.5; with one class the score is the smoothed share of that class.  Repeated rows
get equal scores.  Only the text enters the features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from cpgspark.llm.text import as_bytes, pieces, split_words

#: Most labelled rows that the fit reads.
MAX_TRAIN_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 120
PAIR_ROUNDS = 60
RATE = 0.15
_PIECE = 1 << 20

FEATURES = (
    "words",
    "word_bytes",
    "long_words",
    "short_words",
    "distinct_words",
    "distinct_pairs",
    "top_word",
    "symbols",
    "upper",
    "digits",
    "exclaims",
    "stops",
    "commas",
    "other_punctuation",
    "non_ascii",
    "lines",
    "repeated_lines",
    "entropy",
)


def text_features(column: pa.Array) -> np.ndarray:
    """One row of :data:`FEATURES` for each text of a string array."""
    n = len(column)
    raw = as_bytes(column)
    lengths = np.asarray(pc.binary_length(raw), dtype=np.int64)
    data = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint8)
    owner = np.repeat(np.arange(n), lengths)
    histogram = np.bincount(owner * 256 + data, minlength=256 * n).reshape(n, 256)
    size = np.maximum(lengths, 1)

    def of(letters: bytes) -> np.ndarray:
        return histogram[:, list(letters)].sum(1)

    words, rows = split_words(column)
    count = np.bincount(rows, minlength=n)
    per_word = np.maximum(count, 1)
    width = np.asarray(pc.binary_length(words), dtype=np.int64)
    codes = np.asarray(words.dictionary_encode().indices, dtype=np.int64)
    base = int(codes.max()) + 1 if len(codes) else 1
    kinds, uses = np.unique(rows * base + codes, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, kinds // base, uses)
    both = np.flatnonzero(rows[1:] == rows[:-1])
    # A pair's key may collide, which moves a share of distinct pairs by next to nothing.
    mixed = (codes[both] * np.int64(0x9E3779B97F4A7C15 - (1 << 64)) ^ codes[both + 1]) & 0xFFFFFFFF
    pairs = np.unique(rows[both] << 32 | mixed)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in raw.to_pylist()]
    line_count = np.array([len(x) for x in lines], dtype=np.int64)
    line_kinds = np.array([len(set(x)) for x in lines], dtype=np.int64)
    share = histogram / size[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    punctuation = of(b"\"'()-/:;?@[\\]^_`{}~+=")

    columns = [
        np.log1p(count),
        width_sum(width, rows, n) / per_word,
        width_sum(width > 12, rows, n) / per_word,
        width_sum(width < 3, rows, n) / per_word,
        np.bincount(kinds // base, minlength=n) / per_word,
        np.bincount(pairs >> 32, minlength=n) / np.maximum(count - 1, 1),
        top / per_word,
        of(b"#*$%&|<>") / per_word,
        of(bytes(range(65, 91))) / size,
        of(b"0123456789") / size,
        of(b"!") / per_word,
        of(b".") / per_word,
        of(b",") / per_word,
        punctuation / per_word,
        histogram[:, 128:].sum(1) / size,
        line_count / per_word,
        (line_count - line_kinds) / np.maximum(line_count, 1),
        entropy,
    ]
    return np.column_stack(columns) if n else np.zeros((0, len(FEATURES)))


def width_sum(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, values.astype(np.float64), minlength=n)


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables of single features and of pairs."""

    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        coarse = {
            j: np.searchsorted(self.pair_edges[j], x[:, j], side="right")
            for j in {j for pair in self.pairs for j in pair}
        }
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[a], coarse[b]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best place to split a run of bins: the gain, and bins on the left."""
    if len(g) < 2:
        return 0.0, 0
    lg, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(lg, lh) + _gain(g.sum() - lg, h.sum() - lh) - _gain(g.sum(), h.sum())
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value of each bin for a tree of up to three leaves."""
    bounds = [0, len(g)]
    for _ in range(2):
        best, where = 1e-9, None
        for a, b in zip(bounds, bounds[1:]):
            gain, at = _cut(g[a:b], h[a:b])
            if gain > best:
                best, where = gain, a + at
        if where is None:
            break
        bounds = sorted([*bounds, where])
    value = np.zeros(len(g))
    for a, b in zip(bounds, bounds[1:]):
        value[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return value


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree that cuts one feature, then the other on each side; its gain and values."""
    best, value = 0.0, np.zeros_like(g)
    whole = _gain(g.sum(), h.sum())
    for swap in (False, True):
        gg, hh = (g.T, h.T) if swap else (g, h)
        for at in range(1, len(gg)):
            total, out = -whole, np.zeros_like(gg)
            for rows in (slice(0, at), slice(at, None)):
                sg, sh = gg[rows].sum(0), hh[rows].sum(0)
                _, cut = _cut(sg, sh)
                for columns in (slice(0, cut), slice(cut, None)):
                    a, b = sg[columns].sum(), sh[columns].sum()
                    total += _gain(a, b)
                    out[rows, columns] = a / (b + 1.0)
            if total > best:
                best, value = total, out.T if swap else out
    return best, value


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boost the tables on features ``x`` and labels ``y`` (0 or 1)."""
    if len(y) == 0:
        return AdditiveModel()
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model = AdditiveModel(start=float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    n = x.shape[1]
    model.edges = [_edges(x[:, j], BINS) for j in range(n)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    total = np.full(len(y), model.start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(n):
            g, h = slopes()
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(binned[j], g, size), np.bincount(binned[j], h, size))
            model.tables[j] += step
            total += step[binned[j]]

    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(n)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def square(a: int, b: int, weights: np.ndarray) -> np.ndarray:
        flat = np.bincount(coarse[a] * sizes[b] + coarse[b], weights, sizes[a] * sizes[b])
        return flat.reshape(sizes[a], sizes[b])

    g, h = slopes()
    left = {
        (a, b): _pair_tree(square(a, b, g), square(a, b, h))[0]
        for a in range(n)
        for b in range(a + 1, n)
    }
    model.pairs = sorted(left, key=lambda pair: (-left[pair], pair))[:PAIRS]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * _pair_tree(square(a, b, g), square(a, b, h))[1]
            model.pair_tables[k] += step
            total += step[coarse[a], coarse[b]]
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept away from learning: crc32 of the id as text leaves 1 on division by 3."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 3 == 1


def _map_features(df: DataFrame, keep: list[str], text_col: str, fields: list[StructField], make):
    """Run ``make(features) -> columns`` over pieces of whole texts."""
    schema = StructType([df.schema[c] for c in keep] + fields)
    read = keep if text_col in keep else [*keep, text_col]
    at = read.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in pieces(batch.column(at), _PIECE):
                part = batch.slice(start, stop - start)
                added = make(text_features(part.column(at)))
                kept = {name: part.column(i) for i, name in enumerate(keep)}
                yield pa.RecordBatch.from_pydict({**kept, **added})

    return df.select(*read).mapInArrow(run, schema)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_TRAIN_ROWS,
) -> AdditiveModel:
    """Fit on labelled rows outside the held-out part.

    ``labels`` has the id and ``quality``.  Which rows are drawn depends on ids and texts
    alone; a labelled document found several times counts once, and ``max_rows`` bounds both
    the labels drawn and the documents under them.
    """
    sample = (
        labels.select(F.col(id_col).alias("__id"), F.col("quality").cast("double").alias("__y"))
        .where(~held_out("__id") & F.col("__id").isNotNull() & F.col("__y").isin(0.0, 1.0))
        .orderBy(F.xxhash64("__id"), "__id", "__y")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    # At most max_rows pairs of numbers: safe to broadcast at any size of the tables.
    labelled = texts.join(F.broadcast(sample), "__id")
    names = [f"f{i}" for i in range(len(FEATURES))]
    rows = (
        _map_features(
            labelled,
            ["__id", "__y"],
            "__text",
            [StructField(name, DoubleType()) for name in names],
            lambda x: {name: pa.array(x[:, i]) for i, name in enumerate(names)},
        )
        .distinct()
        .orderBy(F.xxhash64("__id"), "__id", "__y", *names)
        .limit(max_rows)
        .drop("__id")
        .toPandas()
    )
    order = np.lexsort(rows.to_numpy().T[::-1]) if len(rows) else []
    values = rows.to_numpy(dtype=np.float64)[order] if len(rows) else np.zeros((0, 1))
    return fit(values[:, 1:], values[:, 0])


def score(
    df: DataFrame, model: Any, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Columns of ``keep`` (all by default), ``score`` and ``predicted`` for every row.

    ``model`` is an :class:`AdditiveModel`; it holds a few thousand numbers.
    """
    kept = [c for c in (keep or df.columns) if c not in ("score", "predicted")]

    def make(x: np.ndarray) -> dict[str, pa.Array]:
        values = model.score(x)
        return {
            "score": pa.array(values),
            "predicted": pa.array((values >= 0.5).astype(np.int32)),
        }

    fields = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    return _map_features(df, kept, text_col, fields, make)


def accepted(df: DataFrame, model: AdditiveModel, text_col: str = "text") -> DataFrame:
    """The rows the model accepts, with their own columns, whatever their names."""
    plain = [f"c{i}" for i in range(len(df.columns))]
    kept = score(df.toDF(*plain), model, plain[df.columns.index(text_col)]).where("predicted = 1")
    return kept.select(*plain).toDF(*df.columns)
