from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cpgspark.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tables():
    return bpe.load_tables()


def ids_of(coded: bytes) -> list[int]:
    return np.frombuffer(coded, "<u4").tolist()


def test_random_texts_equal_the_library(library, tables):
    random.seed(3)
    parts = ["a", "aa", "the", " ", "  ", "\n", "\t", "ß", "é", "日本", "<|endoftext|>", "'s", "'re", "00",
             "!!", "==", " ", "😀", "‍", "é", "\x00", "²", "Ⅷ"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 60))) for _ in range(1500)]
    texts += ["", "a" * 5000, " " * 3000, "ab" * 3000, "-" * 777]
    coded = bpe.Encoder(tables).encode(texts)
    for text, ids in zip(texts, coded):
        assert ids_of(ids) == library.encode(text, add_special_tokens=False).ids, text


def test_verified_proposals_equal_exact_merging(tables):
    random.seed(4)
    words = [bytes(random.choices(b"aeiothnrs \xc3\xa9x=-", k=random.randint(1, 90))) for _ in range(3000)]
    exact = [bpe.merge_exactly(tables, w) for w in words]
    assert [ids_of(x) for x in bpe.encode_words(tables, words)] == exact
    assert [bpe._merge_long(tables, w) for w in words[:500]] == exact[:500]
    ids, counts = bpe.propose(tables, words)
    assert counts.sum() == len(ids)


def test_odd_rows(spark, odd, none, library, documents):
    tables = bpe.share_tables(spark)
    renamed = odd.withColumnRenamed("words", "ids").withColumnRenamed("shard", "n_tokens")
    rows = bpe.round_trip(renamed, tables).collect()
    assert len(rows) == odd.count()
    expected = sorted(
        (
            len(ids := library.encode(x.text or "", add_special_tokens=False).ids),
            hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256((x.text or "").encode()).hexdigest(),
        )
        for x in odd.collect()
    )
    assert sorted((x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in rows) == expected
    assert bpe.round_trip(none, tables).count() == 0
    coded = bpe.encode(documents.select("doc_id", "text"), tables)
    back = bpe.decode(coded, tables)
    assert sorted(map(tuple, back.select("doc_id", "text").collect())) == sorted(
        map(tuple, documents.select("doc_id", "text").collect())
    )


def test_ids_that_form_no_text(spark, tables):
    half = tables.token_id[b"\xc3"]
    frame = spark.createDataFrame([(1, [half]), (2, None), (3, [])], "n long, ids array<int>")
    rows = bpe.decode(frame, bpe.share_tables(spark)).orderBy("n").collect()
    assert [r.text for r in rows] == ["�", None, ""]
