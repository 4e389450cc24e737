from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cpgspark.llm import nearest, quality


def test_tables_find_steps_and_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.625) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.97
    total = np.full(1000, model.start)
    for j, table in enumerate(model.tables):
        total += [table[int((model.edges[j] <= v).sum())] for v in x[3000:, j]]
    for (a, b), table in zip(model.pairs, model.pair_tables):
        total += [
            table[int((model.pair_edges[a] <= u).sum()), int((model.pair_edges[b] <= v).sum())]
            for u, v in x[3000:, [a, b]]
        ]
    assert np.allclose(total, model.log_odds(x[3000:]))


def test_features_of_a_text():
    text = "Two words, TWO words.\nTwo words, TWO words.\n\n12 ##"
    x = dict(zip(quality.FEATURES, quality.text_features(pa.array(["pad", text]))[1]))
    size, words = len(text), 10
    assert math.isclose(x["words"], math.log1p(words))
    assert math.isclose(x["word_bytes"], sum(map(len, text.split())) / words)
    assert math.isclose(x["symbols"], 2 / words) and math.isclose(x["digits"], 2 / size)
    assert math.isclose(x["upper"], 8 / size) and math.isclose(x["lines"], 3 / words)
    assert math.isclose(x["repeated_lines"], 1 / 3) and math.isclose(x["top_word"], 2 / words)
    assert math.isclose(x["distinct_words"], 6 / words)
    assert not quality.text_features(pa.array([None, ""])).any()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.score(docs, quality.train(docs, labels), keep=["doc_id"])
    both = rows.where(quality.held_out()).join(labels, "doc_id").toPandas()
    assert len(both) > 80
    assert (both.predicted == both.quality).mean() > 0.95
    good, bad = both[both.quality == 1].score.to_numpy(), both[both.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame(
        [(1, 1), (2, 1), (14, 0), (8, 0), (9, None), (None, 1), (99, 1), (1, 1)],
        "doc_id long, quality int",
    )
    model = quality.train(odd, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip(" \t\n\x0b\x0c\r") and not r.text}) == 1
    kept = quality.accepted(odd, model)
    assert kept.columns == odd.columns
    assert kept.count() == sum(r.predicted for r in rows)
    unlearned = quality.train(odd, labels.limit(0))
    assert {r.score for r in quality.score(odd, unlearned).collect()} == {0.5}
    assert quality.score(none, model).count() == 0
    assert quality.train(none, labels).tables == []


def brute(vectors: dict[int, list[float]], query: int, k: int) -> list[tuple]:
    q = np.array(vectors[query])
    scores = [(-(np.array(v) * q).sum(), i) for i, v in vectors.items() if i != query]
    return [(query, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]


def test_walk_takes_pairs_in_order():
    rng = np.random.default_rng(1)
    first, second, sizes = rng.random(9), rng.random(7), rng.integers(0, 5, (9, 7))
    order = np.argsort(-(first[:, None] + second[None, :]).ravel(), kind="stable")
    held = np.cumsum(sizes.ravel()[order])
    for need in (1, 10, 40, sizes.sum()):
        seen = nearest.walk(first, second, sizes, need)
        taken = int(np.searchsorted(held, need)) + 1
        assert seen.sum() == taken and seen.ravel()[order[:taken]].all()


def test_recall_on_the_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = nearest.search(table, table.where("vec_id % 20 = 0")).collect()
    vectors = {r.vec_id: r.embedding for r in table.collect()}
    queries = [i for i in vectors if i % 20 == 0]
    want = [x for q in queries for x in brute(vectors, q, 20)]
    assert len(rows) == len(want)
    found = {(r.query_id, r.vec_id) for r in rows}
    assert len(found & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    for r in rows:
        exact = float(np.dot(np.array(vectors[r.query_id]), np.array(vectors[r.vec_id])))
        assert abs(r.score - exact) < 1e-12


def test_full_visit_is_exact_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = {i: [float(x) for x in rng.integers(-2, 3, 4)] for i in range(300)}
    vectors |= {i: [1.0, 1.0, 1.0, 1.0] for i in range(300, 700)}
    good = {i: v for i, v in vectors.items() if any(v)}
    odd = [(1000, None), (1001, [0.0] * 4), (1002, [1.0, None, 1.0, 1.0]), (1003, [float("nan")] * 4),
           (1004, [float("inf"), 0.0, 0.0, 0.0]), (1005, [1.0]), (None, [1.0] * 4), (1006, [])]
    frame = spark.createDataFrame(
        [(i, v, "r", 1) for i, v in [*vectors.items(), *odd]],
        "vec_id long, embedding array<double>, cell string, rank int",
    ).repartition(5)
    rows = nearest.search(frame, frame.where("vec_id % 20 = 0"), visit=1.0).collect()
    want = sorted(x for q in good if q % 20 == 0 for x in brute(good, q, 20))
    assert sorted(tuple(r) for r in rows) == want


def test_few_candidates_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (1, [0.5, 1.0])], kind)
    rows = nearest.search(frame, frame.where(F.col("vec_id") == 0)).collect()
    assert sorted(tuple(r) for r in rows) == [(0, 1, 1, 0.5), (0, 2, 1, 0.5)]
    empty = spark.createDataFrame([], kind)
    assert nearest.search(empty, empty).count() == 0
    assert nearest.search(frame, empty).count() == 0


@pytest.mark.parametrize("n", [20, 30])
def test_small_tables_fill_the_answer(spark, n):
    vectors = np.random.default_rng(n).normal(size=(n, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    for more in ([], [rows[0]] * n):
        frame = spark.createDataFrame(rows + more, "vec_id long, embedding array<float>")
        found = nearest.search(frame, frame).collect()
        held = {q: [r.vec_id for r in found if r.query_id == q] for q in range(n)}
        assert all(q not in x for q, x in held.items()) and len(held[0]) == min(20, n - 1)
        assert all(len(x) == min(20, n - 1 + len(more)) for q, x in held.items() if q)
