"""Quality rules on repetition, by suffix arrays over the words of each text.

For every text the suffix array of its word sequence is built by prefix doubling; the
longest-common-prefix values of neighbouring suffixes bound the intervals in which one
substring repeats.  The interval a suffix lies deepest in gives the longest stretch
starting there that occurs elsewhere in the text.  The union of those stretches is the
repeated part; its share of the words and the longest stretch are limited.

Many texts are sorted together (the text number is part of the first key, so no repeat
crosses texts), which keeps all work in array operations.  A single very long text is
one piece of its own: O(n log n) time, about 200 bytes a word.

Defined cases: a null or empty text has no words, no repeats, and fails the base rule
on length.  Repeated rows are judged each on its own and agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from cpgspark.llm.text import as_bytes, map_text, split_words

#: Shortest repeat that counts, in words.
MIN_REPEAT = 8
#: Base rule: fewest words, and the largest share of words in repeated 8-word windows.
MIN_WORDS = 20
BASE_PERCENT = 30
#: The method's own limits: share of words in repeats, and the longest repeat in words.
MAX_PERCENT = 30
MAX_LONGEST = 60


def suffix_repeats(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each word, how many words from it on also occur elsewhere in its row.

    ``codes`` numbers the words, ``rows`` (never falling) the text each belongs to.
    """
    n = len(codes)
    repeat = np.zeros(n, dtype=np.int64)
    if n == 0:
        return repeat
    end = np.searchsorted(rows, rows, side="right")
    position = np.arange(n)

    key = rows * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    start = np.maximum.accumulate(np.where(fresh, position, 0))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[order] = start
    levels = [rank.copy()]
    shared = np.bincount(start, minlength=n) > 1
    active = position[shared[rank[:n]]]

    step = 1
    while len(active):
        # A suffix that ends before the second half sorts first: rank -1.
        ahead = active + step
        second = np.where(ahead < end[active], rank[np.minimum(ahead, n)], -1)
        old = rank[active]
        order = np.argsort(old * (n + 1) + second + 1, kind="stable")
        old, second = old[order], second[order]
        place = np.arange(len(order))
        group = np.ones(len(order), dtype=bool)
        group[1:] = old[1:] != old[:-1]
        sub = group.copy()
        sub[1:] |= second[1:] != second[:-1]
        first = np.maximum.accumulate(np.where(sub, place, 0))
        new = old + first - np.maximum.accumulate(np.where(group, place, 0))
        rank[active[order]] = new
        levels.append(rank.copy())
        still = np.bincount(first, minlength=len(order))[first] > 1
        active = active[order][still]
        step *= 2

    suffix = np.empty(n, dtype=np.int64)
    suffix[rank[:n]] = position
    left, right = suffix[:-1].copy(), suffix[1:].copy()
    prefix = np.zeros(n - 1, dtype=np.int64)
    live = np.flatnonzero(levels[0][left] == levels[0][right])
    for level in range(len(levels) - 1, -1, -1):
        same = live[levels[level][left[live]] == levels[level][right[live]]]
        prefix[same] += 1 << level
        left[same] = np.minimum(left[same] + (1 << level), n)
        right[same] = np.minimum(right[same] + (1 << level), n)
    repeat[suffix[:-1]] = prefix
    repeat[suffix[1:]] = np.maximum(repeat[suffix[1:]], prefix)
    return repeat


def covered_words(repeat: np.ndarray, min_repeat: int) -> np.ndarray:
    """Which words lie in the union of all repeats of at least ``min_repeat`` words."""
    position = np.arange(len(repeat))
    reach = np.maximum.accumulate(np.where(repeat >= min_repeat, position + repeat, 0))
    return reach > position


def _duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def text_repetition(column: pa.Array, min_repeat: int = MIN_REPEAT) -> dict[str, pa.Array]:
    """Counts and repetition of every text of a string array."""
    count = len(column)
    words, rows = split_words(column)
    codes = np.asarray(words.dictionary_encode().indices, dtype=np.int64)
    repeat = suffix_repeats(codes, rows)
    covered = covered_words(repeat, min_repeat)
    opens = covered.copy()
    opens[1:] &= ~(covered[:-1] & (rows[1:] == rows[:-1]))
    longest = np.zeros(count, dtype=np.int64)
    if len(repeat):
        firsts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        longest[rows[firsts]] = np.maximum.reduceat(repeat, firsts)

    def per_row(weights: np.ndarray | None = None) -> pa.Array:
        return pa.array(np.bincount(rows, weights, minlength=count).astype(np.int64))

    raw = as_bytes(column)
    symbols = pc.count_substring_regex(raw, r"[#*$%&|<>]")
    return {
        "n_words": per_row(),
        "word_chars": per_row(np.asarray(pc.utf8_length(words), dtype=np.float64)),
        "n_symbols": symbols.cast(pa.int64()),
        "n_dup_lines": pa.array([_duplicate_lines(t) for t in raw.to_pylist()], pa.int64()),
        "n_repeat_words": per_row(covered.astype(np.float64)),
        "repeat_spans": per_row(opens.astype(np.float64)),
        "longest_repeat": pa.array(longest),
    }


_ADDED = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, repeat_spans long, longest_repeat long"
)


def repetition(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT
) -> DataFrame:
    """One row per text: its id, counts, words in repeats, spans and longest repeat."""
    named = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    schema = StructType([named.schema["doc_id"]] + StructType.fromDDL(_ADDED).fields)
    return map_text(
        named, ["doc_id"], "__text", schema, lambda text: text_repetition(text, min_repeat)
    )


def judge(
    counts: DataFrame, max_percent: int = MAX_PERCENT, max_longest: int = MAX_LONGEST
) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to the counts of :func:`repetition`."""
    base = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > BASE_PERCENT * F.col("n_words")
    )
    too_much = 100 * F.col("n_repeat_words") > max_percent * F.col("n_words")
    too_long = F.col("longest_repeat") > max_longest
    return counts.withColumn("base_failed", base).withColumn(
        "kept", ~(F.col("base_failed") | too_much | too_long)
    )
