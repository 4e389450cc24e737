from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa

from cpgspark.llm import collocations as co


def split(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", low) if (w := re.findall(r"[^\x20\x09]+", p))]


def brute(rows, least, longest=5, top=2000):
    """All phrases of all texts counted whole."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        for words in split(text):
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    dropped = set()
    for (lang, p), a in candidates.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= 100 * f[lang, p[i : i + k]]:
                    dropped.add((lang, p[i : i + k]))
    found = defaultdict(list)
    for (lang, p), a in candidates.items():
        if (lang, p) in dropped:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(
        (lang, i, p.decode(), -a, left, right, n[lang], -s)
        for lang, some in found.items()
        for i, (s, a, p, left, right) in enumerate(sorted(some)[:top], 1)
    )


def check(frame, least, **more):
    found = co.collocations(frame, least=least, **more).collect()
    rows = [(r.text, r.lang) for r in frame.select("text", "lang").collect()]
    assert sorted(map(tuple, found)) == brute(rows, least, **more)
    return found


def test_documents_equal_brute_force(documents):
    assert check(documents, 20)


def test_odd_rows(odd, none):
    assert check(odd, 2)
    assert check(odd, 3, top=2, longest=3)
    assert co.collocations(none).count() == 0


def test_a_full_bitmap_loses_nothing(documents, monkeypatch):
    monkeypatch.setattr(co, "BITMAP_BITS", 64)
    assert check(documents.limit(60), 8)


def test_chunks_overlap_and_own_each_word_once():
    text = " ".join(f"w{i * 37 % 101}" for i in range(500)) + ". tail of it"
    row, own, chunk = co.chunks_of(pa.array([text, None, "", "one", "a a a a a a"]), 5, trigger=8)
    words = [c.split(" ") for c in chunk.to_pylist()]
    owned = [w for r, o, c in zip(row, own, words) if r == 0 for w in c[:o]]
    assert owned == [w for p in split(text) for w in p]
    assert all(o <= len(c) <= o + 4 for o, c in zip(own, words)) and 3 in row and 4 in row


def test_equal_passages_share_chunks():
    passage = " ".join(f"p{i * 53 % 211}" for i in range(400))
    chunks = []
    for start in ("one start ", "quite another longer start here "):
        _, own, chunk = co.chunks_of(pa.array([start + passage + " its end"]), 5)
        chunks.append(set(zip(own.tolist(), chunk.to_pylist())))
    assert len(chunks[0] & chunks[1]) >= len(chunks[0]) - 3


def test_counts_beyond_64_bits(spark):
    """Scores whose products pass 64 bits are exact."""
    spark_rows = [("a b",)] * 3
    frame = spark.createDataFrame([(t, "en") for (t,) in spark_rows], "text string, lang string")
    one = co.collocations(frame, least=3).collect()[0]
    assert (one.a, one.l, one.r, one.n, one.score) == (3, 3, 3, 6, 2000)
    huge = spark.sql(
        "SELECT (cast(1000 as decimal(38,0)) * cast(900000000001 as decimal(38,0)) * cast(7000000000003 as decimal(38,0)))"
        " div (cast(900000000002 as decimal(38,0)) * cast(900000000003 as decimal(38,0))) AS s"
    ).first()["s"]
    assert huge == 1000 * 900000000001 * 7000000000003 // (900000000002 * 900000000003)
