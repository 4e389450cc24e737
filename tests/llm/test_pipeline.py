"""The pipeline's stages, each against a brute-force version on its own input."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_mixing_sharding import expected_targets, words
from test_simhash import brute_labels, brute_print
from test_substrings import brute_windows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cpgspark.llm import quality
from cpgspark.plans.durable import store


def expect_quality(rows, labels):
    """Fit on labelled rows outside the held-out part, features of one text at a time."""
    x, y = [], []
    for r in {(r.doc_id, r.text): r for r in rows}.values():
        if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            x.append(quality.text_features(pa.array([r.text], pa.string()))[0])
            y.append(float(labels[r.doc_id]))
    order = np.lexsort(np.column_stack([y, x]).T[::-1])
    model = quality.fit(np.array(x)[order], np.array(y)[order])
    kept = []
    for r in rows:
        features = quality.text_features(pa.array([r.text], pa.string()))
        if model.score(features)[0] >= 0.5:
            kept.append(r)
    return kept


def expect_near(rows):
    prints = np.array([brute_print(r.text) for r in rows], dtype=np.uint64)
    label = brute_labels(prints, np.zeros(len(rows)))
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[label[i]].append(r)
    return [min(g, key=lambda r: (r.doc_id is None, r.doc_id or 0)) for g in groups.values()]


def expect_passages(rows):
    """Words of each line left, by a table of all windows of 50 words; emptied documents go."""
    left = brute_windows(rows)
    out = []
    for r in rows:
        lines = [x for x in left[r.doc_id is not None, r.doc_id or 0, r.text or ""] if x]
        if lines or not words(r.text):
            out.append((r.doc_id, lines))
    return out


def word_lines(text):
    return [x for x in (re.findall(r"[^\x20\x09-\x0D]+", y) for y in (text or "").split("\n")) if x]


def check_mix(before, after):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r.source] += words(r.text)
    for r in after:
        taken[r.source] += words(r.text)
    goal = expected_targets(sizes)
    assert all(abs(taken[s] - t) <= 1 for s, t in goal.items())
    texts = {(r.doc_id, r.text) for r in before}
    cut = [r for r in after if (r.doc_id, r.text) not in texts]
    assert len(cut) <= len(goal)
    assert max(Counter((r.doc_id, r.source) for r in after).values()) <= 3


def check_ids(before, after):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter(
        (r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids), r.text or "")
        for r in before
    )
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in after) == want


def key(rows):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows))


def run_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, out = docs.columns, [docs.collect()]
    extra = {r.doc_id: tuple(r)[4:] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, folder), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            assert all(tuple(r)[5:] == extra[r.doc_id][1:] for r in docs.collect())
        out.append(docs.collect())
    return out


def check(spark, folder):
    raw, good, single, clean, mixed, coded = run_stages(spark, folder)
    labels = {
        r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()
    }
    assert key(good) == key(expect_quality(raw, labels))
    assert key(single) == key(expect_near(good))
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = [(r.doc_id, word_lines(r.text)) for r in clean]
    assert sorted(got, key=order) == sorted(expect_passages(single), key=order)
    check_mix(clean, mixed)
    check_ids(mixed, coded)
    assert all(r.n_chars == len(r.text) for r in mixed if r.text is not None)
    return coded


def test_stages_in_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "simhash_near_dedup", "substring_dedup", "source_mixing", "bpe_encoding"
    ]
    assert corpus_pipeline.ORACLE_SQL is None


def test_documents_through_all_stages(spark, sf):
    coded = check(spark, sf)
    assert Counter(map(str, coded)) == Counter(map(str, corpus_pipeline.run(spark, sf).collect()))


@pytest.mark.parametrize("empty", [False, True])
def test_odd_and_empty_tables(spark, odd, tmp_path, empty):
    names = ["row", "all", "__row", "removed_words", "class_ids", "kept_in", "turn", "cleaned"]
    frame = odd.select("*", *[F.lit(f"{c} of the user").alias(c) for c in names if c not in odd.columns])
    folder = str(tmp_path)
    (frame.limit(0) if empty else frame).write.parquet(f"{folder}/documents.parquet")
    rows = [(i, 1, 0) for i in (1, 2, 6, 9, 11, 13, 12)] + [(14, 0, 0), (8, 0, 1)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet"
    )
    if empty:
        assert corpus_pipeline.run(spark, folder).count() == 0
    else:
        check(spark, folder)
