from __future__ import annotations

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCUMENTS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
        # Names that operators use inside or return.
        StructField("row", StringType()),
        StructField("size", StringType()),
        StructField("score", StringType()),
        StructField("shard", StringType()),
        StructField("words", StringType()),
    ]
)

PASSAGE = " ".join(f"passage{i % 37}x{i}" for i in range(60))
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))
WORD = "ab" * 200_000


def odd_documents() -> list[tuple]:
    """Nulls anywhere, empty and very long texts, ties and repeated rows."""
    texts = [
        (1, "the quick brown fox jumps over the lazy dog and runs far away from here today", "a"),
        (2, "the quick brown fox jumps over the lazy dog and runs far away from here today", "a"),
        (2, "the quick brown fox jumps over the lazy dog and runs far away from here today", "a"),
        (3, None, "a"),
        (4, "", "b"),
        (5, " \t\n\x0b\x0c\r ", "b"),
        (6, "one", None),
        (7, "One two", None),
        (8, "#*$ 12\n#*$ 12\n\n#*$ 12", "b"),
        (None, "no id here", "b"),
        (None, None, None),
        (9, LONG, "c"),
        (10, WORD, "c"),
        (11, "intro words of eleven\n" + PASSAGE + "\nthe end of eleven", "c"),
        (12, "other start in twelve\n" + PASSAGE + "\nan end of twelve", "c"),
        (13, "même é ß <|endoftext|> 日本 \x00 \U0001f600", "d"),
        (14, "a a a a a a a a a a a a a a a a a a a a a a a a", "d"),
    ]
    return [
        (i, t, None if i == 4 else "en", s, len(t) if t else None, "r", None, "s", "h", "w")
        for i, t, s in texts
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_documents(), DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def passage_text():
    return PASSAGE
