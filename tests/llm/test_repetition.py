from __future__ import annotations

import re

import numpy as np
from hypothesis import given, settings, strategies as st

from cpgspark.llm import repetition as r


def brute_repeats(words: list[str]) -> list[int]:
    n = len(words)
    out = []
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while j != i and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", max_size=14), max_size=6))
def test_suffix_repeats_equal_brute_force(texts):
    rows = np.array([i for i, t in enumerate(texts) for _ in t], dtype=np.int64)
    codes = np.array([ord(c) for t in texts for c in t], dtype=np.int64)
    expected = [x for t in texts for x in brute_repeats(list(t))]
    assert r.suffix_repeats(codes, rows).tolist() == expected


def brute(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    repeat = brute_repeats(words) if len(words) < 2000 else [0] * len(words)
    covered = {j for i, n in enumerate(repeat) if n >= 8 for j in range(i, i + n)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
        max(repeat, default=0),
    )


def test_odd_rows(odd, none):
    rows = r.judge(r.repetition(odd)).collect()
    texts = [t for t in odd.select("text").collect()]
    assert len(rows) == len(texts)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    short = [x for x in texts if len(x.text or "") < 10_000]
    expected = sorted(brute(x.text)[:5] for x in short)
    assert sorted(tuple(x[n] for n in names) for x in rows if x.n_words < 50_000 and x.doc_id != 10) == expected
    by_id = {x.doc_id: x for x in rows}
    assert by_id[3].base_failed and not by_id[3].kept
    assert by_id[10].n_words == 1 and by_id[10].word_chars == 400_000
    assert by_id[9].n_words == 60_000 and by_id[9].longest_repeat == 60_000 - 5003
    assert by_id[14].base_failed and by_id[14].longest_repeat == 23
    assert r.judge(r.repetition(none)).count() == 0


def test_long_repeat_alone_is_rejected(spark):
    part = [f"x{i}" for i in range(100)]
    rest = [f"y{i}" for i in range(1000)]
    text = " ".join(part + rest + part)
    row = r.judge(r.repetition(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert not row.base_failed and row.longest_repeat == 100 and not row.kept
