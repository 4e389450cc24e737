"""Phrase collocations counted over a prefix-free parse.

Texts are lower-cased and cut at punctuation into pieces.  A word whose hash has a fixed
remainder ends a chunk, so equal passages fall into equal chunks wherever they stand; a
chunk also holds the ``longest - 1`` words after its own, so that every phrase lies whole
in the chunk that owns its first word, and only there is it counted.  The distinct chunks
with how often they occur are the dictionary, stored once; all counting goes over it,
weighted, so copies are counted once.

Phrases are counted level by level.  A phrase of n words can reach the least count only if
both phrases of n - 1 words in it do; a bitmap of :data:`BITMAP_BITS` bits, the same size
whatever the input, marks the hashes that did.  It may let a phrase through that is rare,
never hold one back, and the last pass counts the words themselves, so counts are exact.
Where many phrases are frequent the bitmap fills and holds back less.

Every cut of a candidate is scored by two joins with the table of frequent phrases, in
decimals of 38 digits; a cut's parts are at least as frequent as the candidate.

Defined cases: a null or empty text has no words; a null language is ``und``; repeated rows
count as often as they occur; equal scores are ordered by count, then by phrase; an empty
table, or none frequent, gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from cpgspark.llm.text import pieces, split_words, whole
from cpgspark.plans.durable import store

LEAST = 100
LONGEST = 5
TOP = 2000
#: Percent of a candidate's count at which a longer one holding it takes its place.
SUBSUMED_PERCENT = 100
#: Phrases up to so many words are counted by hash first; longer ones are few by then.
COUNTED_FIRST = 3
#: A chunk ends at one word in so many.
TRIGGER = 32
BITMAP_BITS = 1 << 26
NO_LANG = "und"
_PIECE = 1 << 20
_SEED = 13
_FACTORS = np.random.default_rng(_SEED).integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[list(b".,;:!?\n\x0b\x0c\r")] = ord("\n")


def _folded(column: pa.Array) -> pa.Array:
    """Texts in lower case with a line feed for every mark that cuts pieces; nulls are empty."""
    texts = whole(column)
    _, offsets, data = texts.buffers()
    changed = _FOLD[np.frombuffer(data or b"", dtype=np.uint8)]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(changed.tobytes())])


_OF_BYTE = np.random.default_rng(_SEED + 1).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _hashes(coded: pa.DictionaryArray) -> np.ndarray:
    """Hash of every distinct word: a polynomial over its bytes, all words at once."""
    kinds = coded.dictionary.cast(pa.large_binary())
    if not len(kinds):
        return np.zeros(0, dtype=np.uint64)
    _, offsets, data = kinds.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[kinds.offset : kinds.offset + len(kinds) + 1]
    values = _OF_BYTE[np.frombuffer(data or b"", dtype=np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    powers = np.full(len(values) + 1, _BASE, dtype=np.uint64)
    powers[0] = 1
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * np.cumprod(powers)[:-1], out=sums[1:])
    powers[1:] = _INVERSE
    mixed = (sums[ends[1:]] - sums[ends[:-1]]) * np.cumprod(powers)[ends[:-1]]
    for shift, factor in ((33, _FACTORS[14]), (29, _FACTORS[15])):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * factor
    return mixed ^ (mixed >> np.uint64(32))


def _joined(words: pa.Array, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The words from each start on, so many of them, with spaces between."""
    ends = np.r_[0, np.cumsum(length)]
    at = np.repeat(start - ends[:-1], length) + np.arange(ends[-1])
    lists = pa.LargeListArray.from_arrays(pa.array(ends), words.take(pa.array(at)))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def chunks_of(texts: pa.Array, longest: int, trigger: int = TRIGGER) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row, number of own words and words of every chunk."""
    lists = pc.split_pattern(_folded(texts), "\n")
    row = np.asarray(pc.list_parent_indices(lists), dtype=np.int64)
    words, piece = split_words(lists.flatten())
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_string())
    coded = words.dictionary_encode()
    ends_chunk = (_hashes(coded) % np.uint64(trigger) == 0)[np.asarray(coded.indices)]
    start = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | ends_chunk[:-1]])
    own_end = np.r_[start[1:], len(words)]
    piece_end = np.searchsorted(piece, piece[start], side="right")
    stop = np.minimum(own_end + longest - 1, piece_end)
    return row[piece[start]], own_end - start, _joined(words, start, stop - start)


def dictionary(df: DataFrame, lang_col: str, text_col: str, longest: int = LONGEST) -> DataFrame:
    """``lang``, ``own``, ``chunk`` and ``n``: the distinct chunks of the parse and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in pieces(batch.column(1), _PIECE):
                part = batch.slice(start, stop - start)
                row, own, chunk = chunks_of(part.column(1), longest)
                held = pa.table(
                    {
                        "lang": part.column(0).take(pa.array(row)),
                        "own": pa.array(own.astype(np.int32)),
                        "chunk": chunk.cast(pa.string()),
                    }
                )
                counted = held.group_by(["lang", "own", "chunk"]).aggregate([([], "count_all")])
                yield from counted.rename_columns(["lang", "own", "chunk", "n"]).to_batches()

    langs = F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang")
    parsed = df.select(langs, F.col(text_col).alias("text")).mapInArrow(
        run, "lang string, own int, chunk string, n long"
    )
    return store(parsed.groupBy("lang", "own", "chunk").agg(F.sum("n").alias("n")), "phrase-dictionary")


class _Chunks:
    """Words of a batch of chunks, and the hashes of the phrases that begin at each of them."""

    def __init__(self, batch: pa.RecordBatch):
        langs = batch.column(0).dictionary_encode()
        lists = pc.split_pattern(batch.column(2), " ")
        self.words = lists.flatten().cast(pa.large_string())
        self.row = np.asarray(pc.list_parent_indices(lists), dtype=np.int64)
        coded = self.words.dictionary_encode()
        self.code, self.kinds = np.asarray(coded.indices).astype(np.int64), len(coded.dictionary)
        self.hash = _hashes(coded)[self.code]
        self.lang = np.asarray(langs.indices).astype(np.int64)[self.row]
        self.langs = langs.dictionary
        self.lang_hash = _hashes(langs)[self.lang]
        self.weight = np.asarray(batch.column(3)).astype(np.float64)[self.row]
        place = np.arange(len(self.row)) - np.searchsorted(self.row, self.row)
        self.owned = place < np.asarray(batch.column(1))[self.row]

    def inside(self, n: int) -> np.ndarray:
        """Whether a phrase of n words that begins here lies in one chunk."""
        last = np.full(len(self.row), -1, dtype=np.int64)
        if len(self.row) >= n:
            last[: len(self.row) - n + 1] = self.row[n - 1 :]
        return last == self.row

    def grams(self, n: int) -> np.ndarray:
        """Hash of the phrase of n words that begins at each word; of no meaning if not inside."""
        mixed = self.lang_hash * _FACTORS[n]
        for j in range(n):
            following = np.r_[self.hash[j:], np.zeros(j, np.uint64)][: len(self.hash)]
            mixed = (mixed ^ following) * _FACTORS[8 + j]
            mixed ^= mixed >> np.uint64(31)
        return mixed

    def frequent(self, bitmaps: list[np.ndarray], longest: int) -> Iterator[np.ndarray]:
        """For 1, 2 ... words: whether the phrase here, and all shorter ones in it, may be frequent."""
        held = self.inside(1)
        for n in range(1, longest + 1):
            if n > 1:
                held = held & np.r_[held[1:], False] & self.inside(n)
            if n <= len(bitmaps):
                bit = self.grams(n) & np.uint64(BITMAP_BITS - 1)
                word = bitmaps[n - 1][(bit >> np.uint64(6)).astype(np.int64)]
                held = held & ((word >> (bit & np.uint64(63))) & np.uint64(1) != 0)
            yield held


def _load(shared) -> list[np.ndarray]:
    return [np.frombuffer(b.value, dtype=np.uint64) for b in shared]


def _bitmap(chunks: DataFrame, shared: list, n: int, least: int) -> bytes:
    """Bits of the hashes of phrases of n words that occur ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = _load(shared)
        for batch in batches:
            held = _Chunks(batch)
            *_, may = held.frequent(bitmaps, n)
            at = np.flatnonzero(may & held.owned)
            gram, of = np.unique(held.grams(n)[at], return_inverse=True)
            count = np.bincount(of, held.weight[at], len(gram)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"gram": pa.array(gram.view(np.int64)), "n": pa.array(count)})

    bit = F.col("gram").bitwiseAND(F.lit(BITMAP_BITS - 1))
    set_bits = (
        chunks.mapInArrow(run, "gram long, n long")
        .groupBy("gram")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= least)
        .select(F.shiftright(bit, 6).alias("word"), bit.bitwiseAND(F.lit(63)).cast("int").alias("place"))
        .groupBy("word")
        .agg(F.expr("bit_or(shiftleft(1L, place))").alias("bits"))
    )
    # At most BITMAP_BITS / 64 pairs of numbers, whatever the input.
    found = set_bits.toArrow()
    bitmap = np.zeros(BITMAP_BITS // 64, dtype=np.int64)
    bitmap[np.asarray(found["word"])] = np.asarray(found["bits"])
    return bitmap.tobytes()


def frequent_phrases(chunks: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """``lang``, ``phrase``, ``words`` and the exact count ``f`` of all phrases frequent enough."""
    context = chunks.sparkSession.sparkContext
    shared: list = []
    for n in range(1, min(longest, COUNTED_FIRST + 1)):
        shared.append(context.broadcast(_bitmap(chunks, list(shared), n, least)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = _load(shared)
        for batch in batches:
            held = _Chunks(batch)
            known = held.lang * max(held.kinds, 1) + held.code
            for n, may in enumerate(held.frequent(bitmaps, longest), 1):
                if n > 1:
                    following = np.r_[held.code[n - 1 :], np.zeros(n - 1, np.int64)][: len(known)]
                    known = known * held.kinds + following
                # Numbers of the shorter phrases stay small, so the next product is exact.
                kept, number = np.unique(known[may], return_inverse=True)
                known = np.zeros(len(known), dtype=np.int64)
                known[may] = number
                at = np.flatnonzero(may & held.owned)
                some, first, of = np.unique(known[at], return_index=True, return_inverse=True)
                begin = at[first]
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": held.langs.take(pa.array(held.lang[begin])),
                        "phrase": _joined(held.words, begin, np.full(len(begin), n)).cast(pa.string()),
                        "words": pa.array(np.full(len(begin), n, dtype=np.int32)),
                        "n": pa.array(np.bincount(of, held.weight[at], len(some)).astype(np.int64)),
                    }
                )

    return (
        chunks.mapInArrow(run, "lang string, phrase string, words int, n long")
        .groupBy("lang", "phrase", "words")
        .agg(F.sum("n").alias("f"))
        .where(F.col("f") >= least)
    )


def collocations(
    df: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = LEAST,
    longest: int = LONGEST,
    top: int | None = TOP,
    subsumed_percent: int = SUBSUMED_PERCENT,
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of each language's best.

    ``a`` is the phrase's count, ``l`` and ``r`` those of the two parts of its weakest cut,
    ``n`` the words of the language; ``score`` is 1000 a n / (l r), floored.
    """
    chunks = dictionary(df, lang_col, text_col, longest)
    totals = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n"))
    known = store(frequent_phrases(chunks, least, longest), "phrases")
    candidates = known.where("words > 1").withColumn("parts", F.split("phrase", " "))

    def span(begin, count):
        return F.array_join(F.slice("parts", begin, count), " ")

    cuts = candidates.select(
        "lang", "phrase", "words", "parts", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "k", span(F.lit(1), F.col("k")).alias("first"),
        span(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"),
    )
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    wide = "cast({} as decimal(38, 0))".format
    score = F.expr(f"({wide(1000)} * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    scored = (
        cuts.join(left, ["lang", "first"])
        .join(right, ["lang", "rest"])
        .join(F.broadcast(totals), "lang")  # one row for each language
        .withColumn("score", score.cast("long"))
        .groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut"))
    )
    longer = candidates.where("words > 2").select(
        "lang", "parts", "words", F.col("f").alias("longer"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size")
    )
    inner = (
        longer.select(
            "lang", "parts", "longer", "size",
            F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("begin"),
        )
        .select("lang", span(F.col("begin"), F.col("size")).alias("phrase"), "longer")
        .groupBy("lang", "phrase")
        .agg(F.max("longer").alias("longer"))
    )
    kept = scored.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < subsumed_percent * F.col("cut.a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("cut.a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score"
    )
