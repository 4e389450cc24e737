"""Substring dedup: passages of whole paragraphs that other documents hold too.

A paragraph is a line with a word.  Its lower-cased words give an exact key and, from
eight words on, a MinHash signature of its 5-word shingles in bands.  Paragraphs that share
a band meet in small groups, exact Jaccard similarity decides, and the links' components
are the classes.  A class found in several documents stays in the one with the smallest
id; in the others its paragraphs go if they lie in an unbroken run of such paragraphs of
at least ``min_words`` words, so that common short lines stay everywhere.

Below eight words a similarity of 0.8 means equal shingles, and the exact key serves.

:func:`remove_passages` then also cuts passages out of lines, wherever they begin and end:
every window of ``MIN_WORDS`` words of a text, unless it lies in removed paragraphs alone,
stays in the document with the smallest id that holds it and goes from the others.  A
window is named by the least hash of its ``GRAM``-word shingles, so equal windows share a
name; only windows whose name occurs in several documents are hashed whole and compared.
A window kept there may still lose words that overlap one kept in an earlier document.

Band keys are shuffled once as pairs of numbers; only keys with two or more different
texts go on, each group of equal members once.  Groups beyond ``GROUP`` texts are cut into
blocks that meet block by block.  Texts are fetched only for paragraphs in such groups, one
occurrence each.  Inside a group a text is compared with members of components it is not
joined to yet, and a spanning set of links is handed on, not all pairs.

Defined cases: null and empty texts have no paragraphs and stay as they are; rows equal in
id and text are one document and get equal results; a null id sorts first; paragraphs
repeated within one document only are left alone; all columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cpgspark.llm.components import connected_components
from cpgspark.llm.rows import packed, row_key
from cpgspark.llm.text import pieces, split_words, whole, word_count
from cpgspark.plans.durable import store
from cpgspark.plans.sizing import small_side

SHINGLE = 5
SIMILARITY = 0.8
#: Shortest run of repeated paragraphs that goes, in words.
MIN_WORDS = 50
#: Shortest paragraph with a signature.
SIGNED_WORDS = 8
ROWS = 3
RECALL = 0.996
#: Words of the shingles that name a window of ``MIN_WORDS``.
GRAM = 16
#: Texts that meet in one block of a group.
GROUP = 1024
_PIECE = 1 << 20
_SEED = 20
_LONG = (1 << 64) - 1


def bands_for(similarity: float = SIMILARITY, rows: int = ROWS, recall: float = RECALL) -> int:
    """Fewest bands that bring a pair at the threshold together with this chance."""
    return int(np.ceil(np.log1p(-recall) / np.log1p(-(similarity**rows))))


BANDS = bands_for()


def _factors(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _paragraph_words(column: pa.Array):
    """Lines of a string array with their row, and lower-cased words with their line."""
    lists = pc.split_pattern(pc.ascii_lower(whole(column)), "\n")
    lines = lists.flatten()
    row = np.asarray(pc.list_parent_indices(lists), dtype=np.int64)
    number = np.arange(len(row)) - np.searchsorted(row, row)
    words, owner = split_words(lines)
    return row, number, words, owner


def _shingle_hashes(words: pa.Array, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every full shingle and the paragraph it lies in."""
    coded = words.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    kinds = coded.dictionary.cast(pa.large_binary()).to_pylist()
    of_kind = np.array([digest(w, _SEED) for w in kinds], dtype=np.uint64)
    h = of_kind[np.asarray(coded.indices)] if len(words) else np.zeros(0, np.uint64)
    n = len(h) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mixed = np.zeros(n, dtype=np.uint64)
    for i, factor in enumerate(_factors(SHINGLE, 1)):
        mixed += h[i : i + n] * factor
    mixed ^= mixed >> np.uint64(32)
    inside = owner[:n] == owner[SHINGLE - 1 :]
    return mixed[inside], owner[:n][inside]


_MULTIPLY, _ADD = _factors(ROWS * BANDS, 2), _factors(ROWS * BANDS, 3)


def signatures(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Paragraphs with shingles, and their band keys, one row each."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros((0, BANDS), np.int64)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    keys = np.empty((len(first), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(first), band + 1, dtype=np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            mixed = hashes * _MULTIPLY[i] + _ADD[i]
            mixed ^= mixed >> np.uint64(29)
            least = np.minimum.reduceat(mixed, first)
            key = (key ^ least) * _MULTIPLY[0]
            key ^= key >> np.uint64(31)
        keys[:, band] = key
    return owner[first], keys.view(np.int64)


def paragraphs(docs: DataFrame) -> DataFrame:
    """``row``, ``doc_id``, ``line``, ``idx``, ``words``, ``phash`` and ``bands``.

    ``docs`` has ``row`` (a key of id and text), ``doc_id`` and ``text``.
    """
    added = "line int, idx int, words int, phash long, bands array<long>"
    schema = StructType([docs.schema["row"], docs.schema["doc_id"]] + StructType.fromDDL(added).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for start, stop in pieces(batch.column(2), _PIECE):
                part = batch.slice(start, stop - start)
                row, number, words, owner = _paragraph_words(part.column(2))
                full, first, count = np.unique(owner, return_index=True, return_counts=True)
                texts = words.cast(pa.large_binary()).to_pylist()
                phash = np.array(
                    [digest(b" ".join(texts[a : a + n]), _SEED) for a, n in zip(first.tolist(), count.tolist())],
                    dtype=np.uint64,
                )
                signed = count[np.searchsorted(full, owner)] >= SIGNED_WORDS
                hashes, of = _shingle_hashes(words.filter(pa.array(signed)), owner[signed])
                have, keys = signatures(hashes, of)
                place = np.zeros(len(full), dtype=np.int32)
                place[np.searchsorted(full, have)] = BANDS
                at = row[full]
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": part.column(0).take(pa.array(at)),
                        "doc_id": part.column(1).take(pa.array(at)),
                        "line": pa.array(number[full].astype(np.int32)),
                        "idx": pa.array((np.arange(len(full)) - np.searchsorted(at, at)).astype(np.int32)),
                        "words": pa.array(count.astype(np.int32)),
                        "phash": pa.array(phash.view(np.int64)),
                        "bands": pa.ListArray.from_arrays(
                            pa.array(np.r_[0, np.cumsum(place)].astype(np.int32)), pa.array(keys.ravel())
                        ),
                    }
                )

    return docs.select("row", "doc_id", "text").mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of different texts under one band key; rows come sorted by (key, phash).

    A group is named by its members, so that equal groups of several bands fall together.
    Large groups come as pairs of blocks.
    """

    def groups(key: np.ndarray, phash: np.ndarray) -> pa.RecordBatch:
        fresh = np.r_[True, (key[1:] != key[:-1]) | (phash[1:] != phash[:-1])]
        key, phash = key[fresh], phash[fresh]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        mixed = phash.view(np.uint64) * _MULTIPLY[0]
        mixed ^= mixed >> np.uint64(31)
        name = (np.add.reduceat(mixed * _MULTIPLY[1], start) ^ size.astype(np.uint64)).view(np.int64)
        group = np.repeat(np.arange(len(start)), size)
        some = (size[group] > 1) & (size[group] <= GROUP)
        out = {"name": [name[group[some]]], "phash": [phash[some]]}
        out["a"] = out["b"] = [np.zeros(some.sum(), dtype=np.int32)]
        out = {k: list(v) for k, v in out.items()}
        for i in np.flatnonzero(size > GROUP):
            members = phash[start[i] : start[i] + size[i]]
            block = np.arange(size[i]) // GROUP
            for a in range(block[-1] + 1):
                for b in range(a, block[-1] + 1):
                    held = members[(block == a) | (block == b)]
                    out["name"].append(np.full(len(held), name[i]))
                    out["phash"].append(held)
                    out["a"].append(np.full(len(held), a, dtype=np.int32))
                    out["b"].append(np.full(len(held), b, dtype=np.int32))
        return pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(v)) for k, v in out.items()})

    kept: tuple[np.ndarray, np.ndarray] | None = None
    for batch in batches:
        key, phash = (np.asarray(batch.column(i)) for i in range(2))
        if kept is not None:
            key, phash = np.r_[kept[0], key], np.r_[kept[1], phash]
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))  # the last key may go on
        if last:
            yield groups(key[:last], phash[:last])
        kept = key[last:], phash[last:]
    if kept is not None and len(kept[0]):
        yield groups(*kept)


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return False
    shared = len(x) + len(y) - len(np.union1d(x, y))
    return shared >= SIMILARITY * (len(x) + len(y) - shared)


def spanning_links(names: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all texts connected by similarity, one fewer than texts in each."""
    parts: list[list[int]] = []
    links = []
    for i in range(len(names)):
        joined, apart = [i], []
        for part in parts:
            near = next((j for j in part if _similar(sets[i], sets[j])), None)
            if near is None:
                apart.append(part)
            else:
                links.append((names[near], names[i]))
                joined = part + joined
        parts = [*apart, joined]
    return links


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each group; rows come sorted by (name, a, b)."""
    held: list[tuple] = []
    current = None

    def flush() -> pa.RecordBatch:
        links = spanning_links([x[0] for x in held], [x[1] for x in held])
        return pa.RecordBatch.from_pydict(
            {"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())}
        )

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        values, offsets = np.asarray(batch.column(4).flatten()), np.asarray(batch.column(4).offsets)
        offsets = offsets - offsets[0]
        for i, key in enumerate(zip(*columns[:3])):
            if key != current and held:
                yield flush()
                held = []
            current = key
            held.append((columns[3][i], values[offsets[i] : offsets[i + 1]]))
    if held:
        yield flush()


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct shingle hashes of the wanted lines of each text."""
    for batch in batches:
        for start, stop in pieces(batch.column(0), _PIECE):
            part = batch.slice(start, stop - start)
            row, number, words, owner = _paragraph_words(part.column(0))
            hashes, of = _shingle_hashes(words, owner)
            line_of = {(r, n): i for i, (r, n) in enumerate(zip(row.tolist(), number.tolist()))}
            found, sets = [], []
            for r, wanted in enumerate(part.column(1).to_pylist()):
                for item in wanted:
                    i = line_of[r, item["line"]]
                    a, b = np.searchsorted(of, i), np.searchsorted(of, i, side="right")
                    found.append(item["phash"])
                    sets.append(np.unique(hashes[a:b]).view(np.int64))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "phash": pa.array(found, pa.int64()),
                    "shingles": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                }
            )


def similar_paragraphs(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``node`` and ``root``: classes of different paragraph texts that are similar."""
    keys = (
        found.select(F.explode("bands").alias("key"), "phash")
        .repartition("key")
        .sortWithinPartitions("key", "phash")
    )
    groups = store(
        keys.mapInArrow(_runs, "name long, phash long, a int, b int").distinct(), "para-groups"
    )
    met = groups.select("phash").distinct()
    # One occurrence of each text that met another, listed by document.
    wanted = (
        found.join(met, "phash", "left_semi")
        .groupBy("phash")
        .agg(F.min(F.struct("row", "doc_id", "line")).alias("at"))
        .groupBy("at.row", F.struct("at.doc_id").alias("of"))
        .agg(F.collect_list(F.struct(F.col("at.line").alias("line"), "phash")).alias("wanted"))
    )
    sets = (
        docs.dropDuplicates(["row", "doc_id"])
        .withColumn("of", F.struct("doc_id"))
        .join(wanted, ["row", "of"])
        .select("text", "wanted")
        .mapInArrow(_shingle_sets, "phash long, shingles array<long>")
    )
    links = (
        groups.join(sets, "phash")
        .select("name", "a", "b", "phash", "shingles")
        .repartition("name", "a", "b")
        .sortWithinPartitions("name", "a", "b", "phash")
        .mapInArrow(_verify, "a long, b long")
    )
    return connected_components(links)


def repeated_paragraphs(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """``row``, ``doc_id``, ``line``, ``words``, ``class_id`` and ``kept_in`` of each removal.

    ``class_id`` names the class, ``kept_in`` is the document that keeps it.
    """
    docs = _keyed(df, id_col, text_col)
    found = store(paragraphs(docs), "paragraphs")
    roots = similar_paragraphs(docs, found)
    # Rows equal in id and text are one document.
    placed = (
        found.select("row", "doc_id", "line", "idx", "words", "phash")
        .distinct()
        .join(roots, F.col("phash") == F.col("node"), "left")
        .select("row", "doc_id", "line", "idx", "words", F.coalesce("root", "phash").alias("class_id"))
    )
    placed = store(placed, "para-classes")
    owner = F.struct("doc_id", "row")
    classes = (
        placed.groupBy("class_id")
        .agg(F.min(owner).alias("first"), F.max(owner).alias("last"))
        .where("first != last")
    )
    shared = placed.join(classes, "class_id")
    order = Window.partitionBy("row", "doc_id").orderBy("idx")
    runs = shared.withColumn("run", F.col("idx") - F.row_number().over(order))
    in_run = Window.partitionBy("row", "doc_id", "run")
    return (
        runs.withColumn("run_words", F.sum("words").over(in_run))
        .where((F.col("run_words") >= min_words) & (owner != F.col("first")))
        .select("row", "doc_id", "line", "words", "class_id", F.col("first.doc_id").alias("kept_in"))
    )


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` is a hash of id and text; what is decided goes by it and the id together."""
    return df.select(
        row_key(id_col, text_col)["text"].alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
    )


def _left_out(text: Column, lines: Column) -> Column:
    """The text without these lines."""
    left = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(lines, i))
    return F.when(lines.isNull(), text).otherwise(F.array_join(left, "\n"))


def _with_changes(df: DataFrame, changes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``all`` (the columns of ``df``) beside the changes of its ``row``, null where there are none."""
    held = df.select(packed(df).alias("all"), row_key(id_col, text_col).alias("key"))
    key = F.struct(F.col("doc_id").alias("id"), F.col("row").alias("text"))
    return held.join(changes.withColumn("key", key), "key", "left")


def _returned(cleaned: DataFrame, df: DataFrame, text_col: str, added: list[str]) -> DataFrame:
    """The columns of ``df`` with the cleaned text, then the added ones, which win equal names."""
    return cleaned.select(
        *[
            F.col("cleaned").alias(c) if c == text_col else F.col("all").getField(c).alias(c)
            for c in df.columns
            if c not in added
        ],
        *added,
    )


def remove_repeated(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """All columns of ``df`` with the text cleaned, and what was taken out of it.

    Adds ``removed_paragraphs``, ``removed_words``, ``class_ids`` and ``kept_in`` (ids of
    the documents that keep the removed passages); columns of these names are replaced.
    """
    added = ["removed_paragraphs", "removed_words", "class_ids", "kept_in"]
    removed = _removed_by_row(df, id_col, text_col, min_words)
    none = F.array().cast("array<long>")
    cleaned = _with_changes(df, removed, id_col, text_col).select(
        "all",
        _left_out(F.col("all").getField(text_col), F.col("lines")).alias("cleaned"),
        F.coalesce("removed_paragraphs", F.lit(0)).alias("removed_paragraphs"),
        F.coalesce("removed_words", F.lit(0)).alias("removed_words"),
        F.coalesce("class_ids", none).alias("class_ids"),
        F.coalesce("kept_in", F.array().cast(removed.schema["kept_in"].dataType)).alias("kept_in"),
    )
    return _returned(cleaned, df, text_col, added)


def _removed_by_row(df: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, ``row``, its removed ``lines``, their number, words, classes and keepers."""
    return (
        repeated_paragraphs(df, id_col, text_col, min_words)
        .groupBy("doc_id", "row")
        .agg(
            F.collect_set("line").alias("lines"),
            F.count(F.lit(1)).alias("removed_paragraphs"),
            F.sum("words").cast("long").alias("removed_words"),
            F.array_sort(F.collect_set("class_id")).alias("class_ids"),
            F.array_sort(F.collect_set("kept_in")).alias("kept_in"),
        )
    )


_FACTOR = _factors(8, 4)


def _windows(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Name and hash of each window of ``MIN_WORDS`` words, whatever texts it spans."""
    coded = words.dictionary_encode()
    kinds = coded.dictionary.cast(pa.large_binary()).to_pylist()
    of_kind = np.array([xxhash.xxh64_intdigest(w, _SEED) for w in kinds], dtype=np.uint64)
    if len(words) < MIN_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = _spans(of_kind[np.asarray(coded.indices)], GRAM)
    width = MIN_WORDS - GRAM + 1
    least, reach = grams, 1
    while 2 * reach <= width:
        least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
    if reach < width:
        least = np.minimum(least[: reach - width], least[width - reach :])
    # Shingles that lie end to end, the last one set back, hold every word.
    whole_hash = np.zeros(len(least), dtype=np.uint64)
    for at in [*range(0, MIN_WORDS - GRAM, GRAM), MIN_WORDS - GRAM]:
        whole_hash = (whole_hash ^ grams[at : at + len(least)]) * _FACTOR[6]
        whole_hash ^= whole_hash >> np.uint64(32)
    return least.view(np.int64), whole_hash.view(np.int64)


def _spans(h: np.ndarray, words: int) -> np.ndarray:
    """Hash of each run of so many words, a power of two."""
    reach = 1
    for factor in _FACTOR[: words.bit_length() - 1]:
        h = h[:-reach] * factor + h[reach:] * _FACTOR[7]
        h = h ^ (h >> np.uint64(31))
        reach *= 2
    return h


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows of one name: ``row``, ``name`` and the lines from first to last."""
    for batch in batches:
        for start, stop in pieces(batch.column(1), _PIECE):
            part = batch.slice(start, stop - start)
            row, number, words, owner = _paragraph_words(part.column(1))
            name, _ = _windows(words)
            n, text = len(name), row[owner]
            inside = np.flatnonzero(text[:n] == text[MIN_WORDS - 1 :]) if n else np.zeros(0, np.int64)
            name, of = name[inside], text[inside]
            fresh = np.r_[True, (name[1:] != name[:-1]) | (of[1:] != of[:-1])][: len(name)]
            first = np.flatnonzero(fresh)
            last = np.r_[first[1:], len(name)][: len(first)] - 1
            yield pa.RecordBatch.from_pydict(
                {
                    "row": part.column(0).take(pa.array(of[first])),
                    "name": pa.array(name[first]),
                    "low": pa.array(number[owner[inside[first]]].astype(np.int32)),
                    "high": pa.array(number[owner[inside[last] + MIN_WORDS - 1]].astype(np.int32)),
                }
            )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and hash of the windows of wanted names outside removed lines."""
    for batch in batches:
        for start, stop in pieces(batch.column(2), _PIECE):
            part = batch.slice(start, stop - start)
            row, number, words, owner = _paragraph_words(part.column(2))
            name, hashed = _windows(words)
            n, text = len(name), row[owner]
            taken, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
            for i, (wanted, lines) in enumerate(zip(*(part.column(c).to_pylist() for c in (3, 4)))):
                a, b = bounds[i], bounds[i + 1] - MIN_WORDS + 1
                if b <= a:
                    continue
                gone = np.isin(number[owner[a : bounds[i + 1]]], np.array(lines or [], np.int64))
                sums = np.r_[0, np.cumsum(gone)]
                here = np.isin(name[a:b], np.array(wanted, np.int64))
                here &= sums[MIN_WORDS:] - sums[:-MIN_WORDS] < MIN_WORDS
                places.append(np.flatnonzero(here))
                taken.append(a + places[-1])
            taken, places = np.concatenate(taken), np.concatenate(places)
            of = pa.array(text[taken])
            yield pa.RecordBatch.from_pydict(
                {
                    "row": part.column(0).take(of),
                    "doc_id": part.column(1).take(of),
                    "at": pa.array(places.astype(np.int32)),
                    "hash": pa.array(hashed[taken]),
                }
            )


def repeated_windows(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``doc_id``, ``row``, ``at`` (the first word) and ``kept_in`` of each window that goes.

    ``docs`` has ``row``, ``doc_id`` and ``text``; ``lines`` the removed lines of a ``row``
    as an array.
    """
    named = StructType([docs.schema["row"], *StructType.fromDDL("name long, low int, high int").fields])
    runs = docs.select("row", "text").mapInArrow(_named, named)
    stands = F.col("lines").isNull() | (
        F.size(F.array_except(F.sequence("low", "high"), "lines")) > 0
    )
    names = store(
        runs.join(lines, "row", "left").where(stands).select("row", "name").distinct(), "window-names"
    )
    shared = (
        names.groupBy("name")
        .agg(F.min("row").alias("a"), F.max("row").alias("b"))
        .where("a != b")
        .select("name")
    )
    shared = store(shared, "window-shared")
    wanted = (
        names.join(small_side(shared), "name")
        .groupBy("row")
        .agg(F.collect_list("name").alias("wanted"))
        .join(lines, "row", "left")
    )
    wanted = store(wanted, "window-wanted")
    kinds = [docs.schema["row"], docs.schema["doc_id"], *StructType.fromDDL("at int, hash long").fields]
    windows = (
        docs.join(small_side(wanted.select("row")), "row", "left_semi")
        .dropDuplicates(["row", "doc_id"])
        .join(wanted, "row")
        .select("row", "doc_id", "text", "wanted", "lines")
        .mapInArrow(_compared, StructType(kinds))
    )
    windows = store(windows, "windows")
    owner = F.struct("doc_id", "row")
    first = (
        windows.groupBy("hash")
        .agg(F.min(owner).alias("first"), F.max(owner).alias("last"))
        .where("first != last")
        .select("hash", "first")
    )
    return (
        windows.join(first, "hash")
        .where(owner != F.col("first"))
        .select("doc_id", "row", "at", F.col("first.doc_id").alias("kept_in"))
    )


_CUT = StructType(
    [StructField("text", StringType()), StructField("words", LongType()), StructField("runs", LongType())]
)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_windows(text: str, lines: list[int], starts: list[int]) -> tuple[str, int, int]:
    """The text without these lines and windows, and the words and runs cut from its lines."""
    texts, dropped = text.split("\n"), set(lines)
    spans = [[m.span() for m in _WORD.finditer(x)] for x in texts]
    steps = np.zeros(sum(map(len, spans)) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.asarray(starts) + MIN_WORDS, -1)
    cut = np.cumsum(steps)[:-1] > 0
    kept, words, runs, place, before = [], 0, 0, 0, False
    for i, (line, found) in enumerate(zip(texts, spans)):
        gone = cut[place : place + len(found)]
        place += len(found)
        if i in dropped:
            before = False
            continue
        if not gone.any():
            kept.append(line)
            before = before and not found
            continue
        words += int(gone.sum())
        runs += int((gone & ~np.r_[before, gone[:-1]]).sum())
        before = bool(gone[-1])
        if gone.all():
            continue
        out, at, n = [], 0, 0
        while n < len(found):
            if not gone[n]:
                n += 1
                continue
            end = n
            while end < len(found) and gone[end]:
                end += 1
            if end < len(found):
                out.append(line[at : found[n][0]])
                at = found[end][0]
            else:
                out.append(line[at : found[n - 1][1]])
                at = found[-1][1]
            n = end
        kept.append("".join(out) + line[at:])
    return "\n".join(kept), words, runs


@F.arrow_udf(_CUT)
def _cut(text: pa.Array, lines: pa.Array, starts: pa.Array) -> pa.Array:
    rows = zip(*(x.to_pylist() for x in (text, lines, starts)))
    found = [(None, None, None) if s is None else cut_windows(t, x or [], s) for t, x, s in rows]
    return pa.array(
        [dict(zip(("text", "words", "runs"), x)) for x in found],
        pa.struct([("text", pa.string()), ("words", pa.int64()), ("runs", pa.int64())]),
    )


def remove_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`remove_repeated`, and without the passages inside lines that others keep.

    Adds ``removed_passages``, the runs of words cut from lines; ``removed_words`` and
    ``kept_in`` count them too.
    """
    added = ["removed_paragraphs", "removed_words", "class_ids", "kept_in", "removed_passages"]
    return _returned(_without_passages(df, id_col, text_col), df, text_col, added)


def without_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The columns of ``df`` alone, with the text cleaned; documents left without a word go.

    ``length_col`` holds the number of characters and follows the cleaned text.
    """
    cleaned = _without_passages(df, id_col, text_col)
    changed = F.col("removed_words") > 0
    cleaned = cleaned.where(~(changed & (word_count("cleaned") == 0)))
    if length_col is not None:
        length = F.when(changed, F.length("cleaned").cast(df.schema[length_col].dataType))
        kept = F.coalesce(length, F.col("all").getField(length_col))
        cleaned = cleaned.withColumn("all", F.col("all").withField(f"`{length_col}`", kept))
    return _returned(cleaned, df, text_col, [])


def _without_passages(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``all``, the columns of ``df``, the text ``cleaned`` and what was taken out of it."""
    removed = store(_removed_by_row(df, id_col, text_col), "para-removed")
    lines = removed.groupBy("row").agg(F.flatten(F.collect_list("lines")).alias("lines"))
    windows = repeated_windows(_keyed(df, id_col, text_col), lines)
    key = F.struct("doc_id", "row")
    cuts = windows.groupBy(key.alias("key")).agg(
        F.collect_set("at").alias("starts"), F.collect_set("kept_in").alias("keepers")
    )
    both = removed.withColumn("key", key).drop("doc_id", "row").join(cuts, "key", "full")
    changes = store(both.select("key.*", *[c for c in both.columns if c != "key"]), "passages")
    text = F.col("all").getField(text_col)
    is_cut = F.col("starts").isNotNull()
    ids = F.array().cast(changes.schema["kept_in"].dataType)
    none = F.array().cast("array<long>")
    held = _with_changes(df, changes, id_col, text_col).withColumn(
        "cut", _cut(F.when(is_cut, text), "lines", "starts")
    )
    return held.select(
        "all",
        F.when(is_cut, F.col("cut.text")).otherwise(_left_out(text, F.col("lines"))).alias("cleaned"),
        F.coalesce("removed_paragraphs", F.lit(0)).alias("removed_paragraphs"),
        (F.coalesce("removed_words", F.lit(0)) + F.coalesce("cut.words", F.lit(0))).alias("removed_words"),
        F.coalesce("class_ids", none).alias("class_ids"),
        F.array_sort(
            F.array_union(F.coalesce("kept_in", ids), F.coalesce("keepers", ids))
        ).alias("kept_in"),
        F.coalesce("cut.runs", F.lit(0)).alias("removed_passages"),
    )
