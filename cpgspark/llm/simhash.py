"""SimHash near duplicates by a self-join of binary tries.

Texts become 64-bit fingerprints; equal fingerprints are one node from then on.  Two
fingerprints within ``budget`` bits agree on ``blocks - budget`` of ``blocks`` bit blocks,
so each fingerprint goes to one sub-trie for every such choice of blocks and its bits
there.  Inside a sub-trie pairs of nodes are walked together from the top: each level adds
the bits in which the two sides differ, and a pair is dropped once the budget is exceeded,
or once both sides are known to be one component.  The budget is raised step by step, so a
dense group is joined up by its closest links and its other pairs are never listed.  A
sub-trie hands on a spanning forest (fewer links than nodes), which the component step
joins across sub-tries: no link is lost, none is emitted twice per pair.

The number of blocks follows the number of fingerprints, so a sub-trie stays small at any
size; the result does not depend on it.

Defined cases: null, empty and blank texts have fingerprint zero, linked like any other;
texts of fewer words than a shingle are one shingle; repeated rows share a component; rows
with a null id belong to a component but never name one, unless all of it has null ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cpgspark.llm.components import connected_components
from cpgspark.llm.rows import one_per_key, packed, row_key
from cpgspark.llm.text import as_bytes, map_text
from cpgspark.plans.durable import store

SHINGLE = 4
BUDGET = 4
SEED = 42
#: Fingerprints that a sub-trie should hold at most on average.
SUBTRIE = 4096
#: Node pairs handled at once.
_FRONTIER = 1 << 17
_HASHES = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority of the bits of the hashes of all shingles; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    last = max(len(words) - shingle + 1, 1)
    stops = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, last, _HASHES):
        some = slice(at, min(at + _HASHES, last))
        pairs = zip(starts[some].tolist(), stops[some].tolist())
        hashes = np.array([digest(joined[i:j], seed) for i, j in pairs], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > last, bitorder="little").view("<u8")[0])


def fingerprints(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None
) -> DataFrame:
    """``doc_id``, what ``keep`` names, and ``fp``, the fingerprint as a signed long."""
    kept = {"doc_id": F.col(id_col), **(keep or {})}
    named = df.select(*[c.alias(name) for name, c in kept.items()], F.col(text_col).alias("__text"))
    schema = StructType([*[named.schema[name] for name in kept], StructField("fp", LongType())])

    def make(column: pa.Array) -> dict[str, pa.Array]:
        found = [fingerprint(t) for t in as_bytes(column).to_pylist()]
        return {"fp": pa.array(np.array(found, dtype=np.uint64).view(np.int64))}

    return map_text(named, list(kept), "__text", schema, make)


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def block_masks(blocks: int, budget: int = BUDGET) -> list[int]:
    """One mask of bits for each choice of blocks that may agree."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:])]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - budget)]


def blocks_for(count: int, budget: int = BUDGET) -> int:
    """Fewest blocks for which random fingerprints spread to :data:`SUBTRIE` or fewer."""
    blocks = budget + 1
    while count / 2 ** (64 * (blocks - budget) / blocks) > SUBTRIE and blocks < 16:
        blocks += 1
    return blocks


class _Forest:
    """Component labels of the fingerprints of some sub-tries."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self._mark()

    def _mark(self) -> None:
        self.changes = np.r_[0, np.cumsum(self.label[1:] != self.label[:-1])]

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join both ends of each link, always to the smaller label."""
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            if not len(a):
                break
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(after := label[label], label):
                label[:] = after
        self._mark()

    def joined(self, a_from, a_to, b_from, b_to) -> np.ndarray:
        """Pairs of ranges that lie in one component as a whole."""
        return (
            (self.label[a_from] == self.label[b_from])
            & (self.changes[a_from] == self.changes[a_to - 1])
            & (self.changes[b_from] == self.changes[b_to - 1])
        )


def trie_components(trie: np.ndarray, fps: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For each fingerprint the first position of its component within its sub-trie.

    Both arrays are sorted by (trie, fingerprint as unsigned); fingerprints are distinct
    within a sub-trie.
    """
    n = len(fps)
    forest = _Forest(n)
    if n < 2:
        return forest.label
    edges = np.flatnonzero(np.r_[True, trie[1:] != trie[:-1], True])
    roots = np.stack([edges[:-1], edges[1:], edges[:-1], edges[1:], 0 * edges[1:]])
    roots = roots[:, roots[1] - roots[0] > 1]
    for allowed in range(1, budget + 1):
        stack = [(0, roots)]
        while stack:
            depth, pairs = stack.pop()
            if pairs.shape[1] > _FRONTIER:
                half = pairs.shape[1] // 2
                stack += [(depth, pairs[:, half:]), (depth, pairs[:, :half])]
                continue
            pairs = pairs[:, ~forest.joined(*pairs[:4])]
            single = (pairs[1] - pairs[0] == 1) & (pairs[3] - pairs[2] == 1)
            ends = pairs[:, single]
            close = np.bitwise_count(fps[ends[0]] ^ fps[ends[2]]) <= allowed
            if close.any():
                forest.add(ends[0][close], ends[2][close])
            pairs = pairs[:, ~single]
            if pairs.shape[1] and depth < 64:
                stack.append((depth + 1, _children(fps, pairs, depth, allowed)))
    return forest.label


def _children(fps: np.ndarray, pairs: np.ndarray, depth: int, allowed: int) -> np.ndarray:
    """Pairs of child nodes one bit further down that keep within the budget."""
    ones = (fps >> np.uint64(63 - depth)) & np.uint64(1)
    zeros = np.r_[0, np.cumsum(1 - ones.astype(np.int64))]
    a_from, a_to, b_from, b_to, error = pairs
    a_cut = a_from + zeros[a_to] - zeros[a_from]
    b_cut = b_from + zeros[b_to] - zeros[b_from]
    same = a_from == b_from
    found = np.concatenate(
        [
            np.stack([a_from, a_cut, b_from, b_cut, error]),
            np.stack([a_cut, a_to, b_cut, b_to, error]),
            np.stack([a_from, a_cut, b_cut, b_to, error + 1]),
            # A node against itself has this pair already the other way round.
            np.stack([a_cut, a_to, b_from, b_cut, error + 1])[:, ~same],
        ],
        axis=1,
    )
    full = (found[0] < found[1]) & (found[2] < found[3]) & (found[4] <= allowed)
    alone = (found[0] == found[2]) & (found[1] - found[0] == 1)
    return found[:, full & ~alone]


_BATCH = 1 << 17


def _join_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of whole sub-tries; rows come sorted by (choice, bits, fp)."""

    def links(choice, bits, fps) -> pa.RecordBatch:
        order = np.lexsort((fps, bits, choice))
        choice, bits, fps = choice[order], bits[order], fps[order]
        fresh = np.r_[True, (choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])]
        label = trie_components(np.cumsum(fresh), fps)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_pydict(
            {"a": pa.array(fps[label[moved]].view(np.int64)), "b": pa.array(fps[moved].view(np.int64))}
        )

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        choice, bits, fps = (np.asarray(batch.column(i)) for i in range(3))
        held.append((choice, bits.view(np.uint64), fps.view(np.uint64)))
        if sum(len(x[0]) for x in held) < _BATCH:
            continue
        choice, bits, fps = map(np.concatenate, zip(*held))
        last = int(np.flatnonzero((choice != choice[-1]) | (bits != bits[-1]))[-1:].sum() + 1)
        if choice[0] == choice[-1] and bits[0] == bits[-1]:
            held = [(choice, bits, fps)]  # one sub-trie so far
            continue
        yield links(choice[:last], bits[:last], fps[:last])
        held = [(choice[last:], bits[last:], fps[last:])]
    if held:
        yield links(*map(np.concatenate, zip(*held)))


def linked(distinct: DataFrame, budget: int = BUDGET, blocks: int | None = None) -> DataFrame:
    """``a``, ``b``: links that join all fingerprints within ``budget`` bits of each other.

    ``distinct`` has one row for each fingerprint in ``fp``.
    """
    masks = block_masks(blocks or blocks_for(distinct.count(), budget), budget)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    choices = F.array(
        *[
            F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits"))
            for i, m in enumerate(signed)
        ]
    )
    placed = distinct.select("fp", F.explode(choices).alias("c")).select(
        F.col("c.choice").cast("long").alias("choice"), F.col("c.bits").alias("bits"), "fp"
    )
    return (
        placed.repartition("choice", "bits")
        .sortWithinPartitions("choice", "bits")
        .mapInArrow(_join_tries, "a long, b long")
    )


def _classes(prints: DataFrame) -> DataFrame:
    """``fp`` and ``root``, the component of every fingerprint."""
    nodes = store(prints.select("fp").distinct(), "simhash-nodes")
    roots = connected_components(linked(nodes))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id``, the smallest id it reaches."""
    prints = store(fingerprints(df, id_col, text_col), "simhash")
    placed = _classes(prints)
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    placed = store(placed.join(first, "fp"), "simhash-classes")
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = placed.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        "doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id"
    )


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, one of each component: that with the smallest id, nulls last.

    Of rows equal in id and text the one with the smallest hash of its columns stays.
    """
    key = row_key(id_col, text_col)
    prints = store(fingerprints(df, id_col, text_col, {"row": key}), "simhash")
    first = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    stay = (
        first.join(_classes(prints), "fp")
        .groupBy("root")
        .agg(F.min("first").alias("first"))
        .select(F.col("first.row").alias("row"))
    )
    equal = prints.groupBy("row").agg(F.count(F.lit(1)).alias("equal"))
    wanted = store(stay.join(equal, "row"), "simhash-kept")
    return one_per_key(df.select(key.alias("row"), packed(df).alias("all")), wanted).select("all.*")
