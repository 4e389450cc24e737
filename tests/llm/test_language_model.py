from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from cpgspark.llm import language_model as lm


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=300))
def test_elias_fano_gives_back_its_numbers(values):
    values = np.sort(np.array(values, dtype=np.int64) >> 12)
    assert np.array_equal(lm.elias_fano_at(lm.elias_fano(values), np.arange(len(values))), values)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, (1 << 64) - 1), min_size=1, max_size=30))
def test_select_finds_every_set_bit(words):
    words = [*words, (1 << 64) - 1, 1 << 63, 1]
    bits = [(w, n, place) for w in words for n, place in enumerate(i for i in range(64) if w >> i & 1)]
    given_words, rank, place = zip(*bits)
    assert lm._select(np.array(given_words, dtype=np.uint64), np.array(rank)).tolist() == list(place)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(0, (1 << 40) - 1), max_size=200))
def test_packed_numbers(bits, values):
    values = np.array(values, dtype=np.int64) & ((1 << bits) - 1)
    packed = lm.pack(values, bits)
    assert np.array_equal(lm.unpack(packed, bits, np.arange(len(values))), values)
    kinds = np.unique(values)
    wanted = np.arange(min(1 << bits, 50))
    place = lm.successors(lm.pack(kinds, bits), bits, np.zeros(len(wanted), int), np.full(len(wanted), len(kinds)), wanted)
    index = {v: i for i, v in enumerate(kinds.tolist())}
    assert place.tolist() == [index.get(w, -1) for w in wanted.tolist()]


def test_frequent_shares_are_exact():
    share = np.r_[np.full(500, 0.25), np.full(300, 0.625), np.linspace(1e-6, 1, 400)]
    coded = lm.quantise("s", share)
    back = lm.restore(coded, "s", np.arange(len(share)))
    assert coded["s"].dtype == np.uint8 and np.allclose(back[:800], share[:800], rtol=1e-12)
    assert np.abs(np.log10(back) - np.log10(share)).max() < 0.03


class Brute:
    def __init__(self, texts, d=lm.DISCOUNT):
        self.d = d
        flows = [[b"<s>", *(t or "").encode().lower().split(), b"</s>"] for t in texts]
        self.c1 = Counter(w for f in flows for w in f[1:])
        self.c2 = Counter(p for f in flows for p in zip(f, f[1:]))
        self.c3 = Counter(p for f in flows for p in zip(f, f[1:], f[2:]))
        self.k1 = Counter(a for a, _ in self.c2)
        self.t1 = Counter()
        for (a, _), n in self.c2.items():
            self.t1[a] += n
        self.k2, self.t2 = Counter(), Counter()
        for (a, b, _), n in self.c3.items():
            self.k2[a, b] += 1
            self.t2[a, b] += n
        self.n, self.v = sum(self.c1.values()), len(self.c1)

    def p1(self, w):
        return (self.c1[w] + 1) / (self.n + self.v + 1)

    def p2(self, v, w):
        if not self.t1[v]:
            return self.p1(w)
        return max(self.c2[v, w] - self.d, 0) / self.t1[v] + self.d * self.k1[v] / self.t1[v] * self.p1(w)

    def p3(self, u, v, w):
        if not self.t2[u, v]:
            return self.p2(v, w)
        return max(self.c3[u, v, w] - self.d, 0) / self.t2[u, v] + self.d * self.k2[u, v] / self.t2[u, v] * self.p2(v, w)

    def row(self, text):
        f = [b"<s>", *(text or "").encode().lower().split(), b"</s>"]
        base = sum(math.log10(self.p1(w)) for w in f[1:])
        full = math.log10(self.p2(f[0], f[1])) + sum(math.log10(self.p3(*x)) for x in zip(f, f[1:], f[2:]))
        return len(f) - 1, sum(self.c1[w] > 0 for w in f[1:]), base, full


def check(frame, **sizes):
    rows = frame.select("doc_id", "text").collect()
    brute = Brute([r.text for r in rows if zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 7 != 2])
    model = lm.train(frame.where(lm.learns()), **sizes)
    assert (model.tokens, model.words) == (brute.n, brute.v)
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[3])
    got = sorted((tuple(r) for r in lm.score(frame, model).collect()), key=key)
    want = sorted(((r.doc_id, *brute.row(r.text)) for r in rows), key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want):
        assert g[3] == pytest.approx(w[3], rel=1e-9, abs=1e-9)
        assert abs(g[4] - w[4]) / w[1] < 0.02
    return model, brute


def test_documents_equal_brute_force(documents):
    model, _ = check(documents)
    small, _ = check(documents, file_grams=3000, file_words=1000)
    assert len(model.trie_files) == 1 and len(small.trie_files) > 5
    assert len(small.vocabulary_files) > 2 and small.split_kinds


def test_salted_merging_changes_nothing(documents, monkeypatch):
    monkeypatch.setattr(lm, "_PIECE", 20_000)
    monkeypatch.setattr(lm, "MERGED_RUNS", 3)
    check(documents, file_grams=20_000)


def test_probabilities_of_a_context_sum_to_one(documents):
    texts = [r.text for r in documents.select("text").collect()][:40]
    brute = Brute(texts)
    words = [*brute.c1, b"never seen"]
    for u, v in list(brute.t2)[:20]:
        assert sum(brute.p3(u, v, w) for w in words) == pytest.approx(1)


def test_odd_rows(odd, none):
    check(odd)
    model = lm.train(none)
    row = lm.score(odd.where("doc_id = 1"), model).first()
    assert row.n_known == 0 and row.base_score == 0 and row.score == 0
    assert lm.score(none, model).count() == 0


def test_held_out_text_is_better_predicted_than_by_words(documents):
    model = lm.train(documents.where(lm.learns()))
    rows = lm.score(documents.where(lm.held_out()), model).collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
