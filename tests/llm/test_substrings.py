from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest

from cpgspark.llm import substrings as ss


def brute(rows) -> dict:
    """Lines that go from each (id, text), by all pairs of paragraphs."""
    docs = {(r.doc_id is not None, r.doc_id or 0, r.text or "") for r in rows}
    found, number = [], {}
    for doc in docs:
        place = 0
        for line, text in enumerate(doc[2].split("\n")):
            words = tuple(text.encode().lower().split())
            if words:
                number.setdefault(words, len(number))
                found.append((doc, line, place, words))
                place += 1
    sets = [frozenset(w[i : i + 5] for i in range(len(w) - 4)) for w in number]
    label = list(range(len(sets)))
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            at[g].append(i)
    shared = defaultdict(int)
    for ids in at.values():
        for n, a in enumerate(ids):
            for b in ids[:n]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) and label[a] != label[b]:
            old = label[a]
            label = [label[b] if x == old else x for x in label]
    owners = defaultdict(set)
    for doc, _, _, words in found:
        owners[label[number[words]]].add(doc)
    gone, run = defaultdict(set), []

    def close():
        if sum(len(w) for *_, w in run) >= ss.MIN_WORDS:
            for doc, line, _, words in run:
                first = min(owners[label[number[words]]])
                if doc != first:
                    gone[doc].add(line)
        run.clear()

    for item in found:
        common = len(owners[label[number[item[3]]]]) > 1
        if run and (not common or run[-1][0] != item[0]):
            close()
        if common:
            run.append(item)
    close()
    return gone


def check(frame):
    rows = frame.select("doc_id", "text").collect()
    gone = brute(rows)
    want = []
    for r in rows:
        lines = gone.get((r.doc_id is not None, r.doc_id or 0, r.text or ""), set())
        kept = [x for i, x in enumerate((r.text or "").split("\n")) if i not in lines]
        want.append((r.doc_id, "\n".join(kept) if lines else r.text, len(lines)))
    got = [(r.doc_id, r.text, r.removed_paragraphs) for r in ss.remove_repeated(frame).collect()]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(got, key=key) == sorted(want, key=key)
    return gone


@pytest.mark.parametrize("table", ["sf0.001"])
def test_documents_equal_all_pairs(spark, table):
    assert check(spark.read.parquet(f"/root/testdata/{table}/documents.parquet"))


def test_odd_rows(odd, none, passage_text):
    frame = odd.withColumnRenamed("words", "removed_words")
    gone = check(frame)
    assert {d[1] for d in gone} == {12}
    cleaned = ss.remove_repeated(frame)
    row = cleaned.where("doc_id = 12").first()
    assert passage_text not in row.text and row.kept_in == [11] and row.removed_words == 60
    assert passage_text in cleaned.where("doc_id = 11").first().text
    assert ss.remove_repeated(none).count() == 0


def passage(seed: int, n: int) -> list[str]:
    rng = np.random.default_rng(seed)
    return [f"t{x}" for x in rng.integers(0, 10_000, n)]


def test_near_copies_and_short_lines(spark):
    own = passage(1, 70)
    near = own.copy()
    near[35] = "changed"
    lines = passage(2, 60)
    split = "\n".join(" ".join(lines[i : i + 12]) for i in range(0, 60, 12))
    common = "licensed to everyone under some terms"
    rows = [
        (1, "first one\n" + " ".join(own) + "\n" + common),
        (2, "second\n" + " ".join(near) + "\nmore of two\n" + common),
        (3, "third\n" + split + "\nend of three\n" + common),
        (4, split + "\nfourth here\n" + common),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r.doc_id: r.text for r in ss.remove_repeated(frame).collect()}
    assert texts[1] == rows[0][1] and texts[3] == rows[2][1]
    assert texts[2] == "second\nmore of two\n" + common
    assert texts[4] == "fourth here\n" + common


def test_large_groups_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ss, "GROUP", 8)
    base = passage(3, 90)
    rows = []
    for i in range(60):
        words = base.copy()
        words[3 * (i % 30)] = f"v{i}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r.doc_id: r.text for r in ss.remove_repeated(frame).collect()}
    assert texts[0] == rows[0][1] and all(texts[i] == "" for i in range(1, 60))


def test_bands_reach_the_recall():
    bands = ss.bands_for(0.8, 3, 0.996)
    assert 1 - (1 - 0.8**3) ** bands >= 0.996 > 1 - (1 - 0.8**3) ** (bands - 1)


def test_spanning_links_join_all_similar():
    sets = [np.arange(i, i + 40) for i in range(0, 30, 2)] + [np.arange(500, 540)]
    links = ss.spanning_links(list(range(16)), sets)
    assert len(links) == 14 and {x for link in links for x in link} == set(range(15))


def brute_windows(rows) -> dict:
    """Text left of each (id, text), by a table of all windows of 50 words."""
    gone, docs = brute(rows), sorted({(r.doc_id is not None, r.doc_id or 0, r.text or "") for r in rows})
    owner, left = {}, {}
    for doc in docs:
        lines = doc[2].split("\n")
        words = [(i, m) for i, x in enumerate(lines) for m in re.finditer(r"[^\x20\x09-\x0D]+", x)]
        lower = [m.group().encode().lower() for _, m in words]
        cut = set()
        for at in range(len(words) - 49):
            if all(i in gone.get(doc, ()) for i, _ in words[at : at + 50]):
                continue
            if owner.setdefault(tuple(lower[at : at + 50]), doc) != doc:
                cut.update(range(at, at + 50))
        kept = [[] for _ in lines]
        for n, (i, m) in enumerate(words):
            if n not in cut and i not in gone.get(doc, ()):
                kept[i].append(m.group())
        left[doc] = kept
    return left


def check_windows(frame):
    rows = frame.select("doc_id", "text").collect()
    left = brute_windows(rows)
    split = lambda x: re.findall(r"[^\x20\x09-\x0D]+", x)
    want = [
        (r.doc_id, [x for x in left[r.doc_id is not None, r.doc_id or 0, r.text or ""] if x]) for r in rows
    ]
    found = ss.remove_passages(frame).collect()
    got = [(r.doc_id, [split(x) for x in (r.text or "").split("\n") if split(x)]) for r in found]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    texts = {(r.doc_id, r.text) for r in rows}
    assert all(r.removed_words > 0 or (r.doc_id, r.text) in texts for r in found)
    return found


def test_windows_equal_brute_force(spark, odd, none):
    found = check_windows(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert sum(r.removed_passages for r in found) > 0
    check_windows(odd)
    assert ss.remove_passages(none).count() == 0


def test_passages_inside_lines(spark):
    shared, other = passage(11, 55), passage(12, 49)
    line = lambda seed, part: " ".join([*passage(seed, 40), *part, *passage(seed + 1, 30)])
    rows = [
        (1, "first\n" + line(20, shared)),
        (2, line(30, [x.upper() for x in shared]) + "\nend of two"),
        (3, line(40, other)),
        (4, line(50, other)),
        (5, "five\n" + "\n".join([" ".join(shared[:20]), " ".join(shared[20:]) + "  tail of five"])),
        (6, line(60, shared)),
        (6, line(60, shared)),
        (None, "null id " + " ".join(other)),
    ]
    found = ss.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == 8 and [got[i].text for i in (1, 3, 4, None)] == [rows[i][1] for i in (0, 2, 3, 7)]
    assert got[2].text == line(30, []) + "\nend of two" and got[2].kept_in == [1]
    assert got[5].text == "five\ntail of five" and got[5].removed_words == 55
    assert [r.text for r in found if r.doc_id == 6] == [line(60, [])] * 2
    assert got[6].removed_passages == 1 and got[6].removed_paragraphs == 0
