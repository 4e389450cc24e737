"""Words of whole texts, taken a batch at a time.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]`` everywhere in this package; a null
text has none.  Work inside a task goes piece by piece, so memory follows the piece
size and the longest single text, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

#: Bytes of text handled at once inside a task.
PIECE_BYTES = 2 << 20

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column | str) -> Column:
    """Number of words as a JVM expression; 0 for null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a binary or string array holding about ``limit`` bytes each."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop
        start = stop


def as_bytes(column: pa.Array) -> pa.Array:
    """Texts as UTF-8 bytes with nulls as empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def whole(column: pa.Array) -> pa.Array:
    """A string array in memory of its own, nulls as empty.

    Some Arrow functions misread arrays whose offsets do not start at zero (slices).
    """
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    return texts.take(pa.array(np.arange(len(texts))))


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a string array in order, and each word's row number."""
    lists = pc.ascii_split_whitespace(whole(column))
    flat = lists.flatten()
    parents = np.asarray(pc.list_parent_indices(lists), dtype=np.int64)
    full = np.asarray(pc.binary_length(flat)) > 0
    if full.all():
        return flat, parents
    return flat.filter(pa.array(full)), parents[full]


def map_text(
    df: DataFrame,
    keep: list[str],
    text_col: str,
    schema: StructType | str,
    function,
) -> DataFrame:
    """Run ``function(text array) -> dict of columns`` over pieces of whole texts.

    Only ``keep`` and the text column are read; ``keep`` columns come back as they
    were, followed by what the function adds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(len(keep))
            for start, stop in pieces(text):
                part = batch.slice(start, stop - start)
                added = function(part.column(len(keep)))
                columns = {name: part.column(i) for i, name in enumerate(keep)}
                yield pa.RecordBatch.from_pydict({**columns, **added})

    return df.select(*keep, text_col).mapInArrow(run, schema)
