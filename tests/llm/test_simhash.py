from __future__ import annotations

import numpy as np
import xxhash

from cpgspark.llm import components, simhash


def brute_print(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_labels(prints: np.ndarray, groups: np.ndarray, budget: int = 4) -> np.ndarray:
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= budget
    near &= groups[:, None] == groups[None, :]
    label = np.arange(len(prints))
    while True:
        after = np.array([label[row].min() for row in near])
        if np.array_equal(after, label):
            return label
        label = after


def test_trie_join_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(25):
        prints = []
        for base in rng.integers(0, 1 << 63, size=5, dtype=np.uint64):
            for _ in range(rng.integers(1, 40)):
                x = int(base)
                for _ in range(rng.integers(0, 6)):
                    x ^= 1 << int(rng.integers(0, 64))
                prints.append(x)
        prints = np.unique(np.array(prints, dtype=np.uint64))
        groups = np.sort(rng.integers(0, 2, len(prints)))
        assert np.array_equal(simhash.trie_components(groups, prints), brute_labels(prints, groups))


def check(frame):
    rows = frame.select("doc_id", "text").collect()
    prints = np.array([brute_print(r.text) for r in rows], dtype=np.uint64)
    label = brute_labels(prints, np.zeros(len(rows)))
    expected = []
    for i, row in enumerate(rows):
        ids = [rows[j].doc_id for j in np.flatnonzero(label == label[i]) if rows[j].doc_id is not None]
        expected.append((row.doc_id, format(int(prints[i]), "016x"), min(ids, default=None)))
    key = lambda x: tuple((v is None, v or 0) for v in x)
    got = [tuple(r) for r in simhash.near_duplicates(frame).collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_documents_equal_brute_force(documents):
    check(documents)


def test_odd_rows(odd, none):
    check(odd)
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id or 0 for r in kept.collect())
    assert 1 in ids and 2 not in ids and 3 in ids and 4 not in ids
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.one_of_each(none).count() == 0


def test_block_count_does_not_change_links(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 63))
    prints = {base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 64, (60, 3))}
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    roots = [
        {tuple(r) for r in components.connected_components(simhash.linked(frame, blocks=b)).collect()}
        for b in (5, 6)
    ]
    assert roots[0] == roots[1] and roots[0]


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 3)]
    found = components.connected_components(spark.createDataFrame(links, "a long, b long"))
    rows = {r.node: r.root for r in found.collect()}
    assert rows == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}
    assert found.count() == len(rows)
