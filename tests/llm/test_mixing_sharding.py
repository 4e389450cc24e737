from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cpgspark.llm import mixing, sharding
from cpgspark.llm.queries import SQL
from tools.compare import compare, connect


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def expected_targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Share by weight, cap, and share the excess again until nothing is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped.update({s: 3.0 * sizes[s] for s in over})


def check(frame):
    rows = mixing.mix(frame).collect()
    source = [(r.doc_id, r.source, words(r.text)) for r in frame.collect()]
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, n) for i, _, n in source)
    sizes = defaultdict(int)
    for _, s, n in source:
        sizes[s] += n
    goal = expected_targets(sizes)
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    assert {round(r.target, 6) for r in rows} == {round(t, 6) for t in goal.values()}
    taken = defaultdict(int)
    for r in rows:
        taken[r.source_size, round(r.target, 6)] += r.taken
    for (size, target), n in taken.items():
        same = sum(sizes[s] == size and round(t, 6) == target for s, t in goal.items())
        assert abs(n - target * same) <= same
    return rows


def test_documents_meet_their_targets(documents):
    first, again = check(documents), mixing.mix(documents).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_odd_rows(odd, none):
    check(odd)
    assert mixing.mix(none).count() == 0
    assert mixing.mixed(none).count() == 0
    no_words = odd.where("doc_id in (3, 4, 5)")
    assert [r.taken for r in mixing.mix(no_words).collect()] == [0, 0, 0]


def test_mix_equals_its_rows(odd, documents):
    for frame in (documents, odd):
        taken = sum(r.taken for r in mixing.mix(frame).collect())
        rows = mixing.mixed(frame)
        assert rows.columns == frame.columns
        assert sum(words(r.text) for r in rows.collect()) == taken


def test_every_stretch_of_the_mix_holds_the_shares(documents):
    known, slots = mixing.ordered_mix(mixing.sized(documents), block=16)
    rank = {r.source_rank: (r.target, r.source_rank) for r in known.select("source_rank", "target").distinct().collect()}
    total = sum(t for t, _ in rank.values())
    taken = defaultdict(Counter)
    for r in slots.collect():
        taken[r.turn][r.source_rank] += r.words
    assert all(len(c) == 1 and sum(c.values()) <= 16 for c in taken.values())
    turns, seen = sorted(taken), Counter()
    for n, turn in enumerate(turns, 1):
        seen.update(taken[turn])
        if n % 64 == 0:
            words_so_far = sum(seen.values())
            assert all(abs(seen[s] - t / total * words_so_far) <= 16 * 16 for s, (t, _) in rank.items())


def test_equal_texts_of_two_sources_stay_apart(spark):
    rows = [(1, "one two three four", "a"), (1, "one two three four", "b"), (2, "five six seven", "b")]
    rows += [(None, "x y z", s) for s in ("a", "b", None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, sizes, taken = mixing.mixed(frame).collect(), Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    for r in got:
        taken[r.source] += words(r.text)
    assert all(abs(taken[s] - t) <= 1 for s, t in expected_targets(sizes).items())


def test_one_repeated_row_is_cut_into_ranges(spark, documents):
    bulk = documents.select("doc_id", "source", "text")
    hot = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("hot").alias("source"), F.lit("a b c").alias("text"))
    lined = mixing._lined(docs := mixing.sized(bulk.unionByName(hot)), mixing.targets(docs))
    rows = lined.where("doc_id = 7 and size = 3").select("at").collect()
    assert sorted(r["at"] for r in rows if r["at"] < 12000) == list(range(0, 12000, 3))


def test_schedule_spreads_sources(spark):
    goals = spark.createDataFrame(
        [("a", 0, 10_000, 1, 20_000.0), ("b", 1, 40_000, 1, 20_000.0), ("c", 2, 9_999, 1, 10_000.0)],
        "source string, source_rank long, source_size long, weight long, target double",
    )
    rows = mixing.schedule(goals, 50).orderBy("turn").collect()
    assert len({r.turn for r in rows}) == len(rows)
    share = {0: 0.4, 1: 0.4, 2: 0.2}
    for at in range(100, len(rows), 100):
        seen = Counter(r.source_rank for r in rows[:at])
        assert all(abs(seen[s] - share[s] * at) <= 8 for s in share)
    one = [r for r in rows if r.source_rank == 0]
    assert [r.rank for r in one] == list(range(len(one)))
    assert Counter(r["pass"] for r in one) == {0: 200, 1: 200}


@pytest.mark.parametrize("name", ["op1_mixing", "op4_warc", "op6_repetition", "op11_chat", "op12_negatives", "op13_collocations"])
def test_queries_equal_sql(name, spark, sf):
    from cpgspark.llm.queries import QUERIES

    df = QUERIES[name](spark, sf)
    cursor = connect(sf).execute(SQL[name])
    got = [tuple(r) for r in df.collect()]
    assert compare(df.columns, got, [d[0] for d in cursor.description], cursor.fetchall()) is None


def shards_of(frame, **more):
    rows = sharding.shard_by_bytes(frame, **more).collect()
    expected = Counter(
        (r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()))
        for r in frame.collect()
    )
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == expected
    slots, load = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows, load


def test_shards_are_near_equal(documents):
    rows, load = shards_of(documents)
    mean = sum(load.values()) / 40
    largest = max(r["size"] for r in rows)
    assert set(load) == set(range(40))
    assert max(load.values()) - mean <= largest and mean - min(load.values()) <= largest


def test_copies_stay_together_unless_they_outweigh_a_shard(spark, documents):
    hot = spark.range(3000).select(
        (F.col("id") + 10_000).alias("doc_id"), F.lit("many copies of one text " * 20).alias("text")
    )
    some = spark.range(5).select((F.col("id") + 50_000).alias("doc_id"), F.lit("five copies").alias("text"))
    frame = documents.select("doc_id", "text").unionByName(hot).unionByName(some)
    rows, load = shards_of(frame, shards=8)
    assert max(load.values()) <= 1.02 * min(load.values())
    place = defaultdict(set)
    for r in rows:
        place[r.text_crc32].add(r.shard)
    assert len(place[zlib.crc32(b"five copies")]) == 1
    assert sum(len(s) > 1 for s in place.values()) <= 1


@pytest.mark.parametrize("same", [7, None])
def test_rows_equal_in_id_and_text_spread(spark, documents, same):
    bulk = documents.select("doc_id", "text")
    total = bulk.agg(F.sum(F.octet_length("text") + sharding.ROW_BYTES)).first()[0]
    text = "one row many times " * 5
    n = total // 2 // (len(text) + sharding.ROW_BYTES)
    frame = bulk.unionByName(
        spark.range(n).select(F.lit(same).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    )
    rows, load = shards_of(frame, shards=8)
    held = [r.shard for r in rows if r["size"] == len(text) + sharding.ROW_BYTES]
    assert len(rows) == documents.count() + n and len(held) >= n and len(set(held)) > 2
    assert max(load.values()) <= 1.1 * sum(load.values()) / 8


def test_shards_of_odd_rows(odd, none):
    shards_of(odd)
    assert sharding.shard_by_bytes(none).count() == 0


def test_sharding_runs_no_python(documents):
    plan = sharding.shard_by_bytes(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
