"""Mixing sources to target weights by a low-discrepancy schedule.

The documents of a source, in an order shuffled by a seeded digest, form one line of
words that is cut into blocks of equal length.  A source needs as many slots as its target
has blocks.  The slots of all sources lie end to end on one line, in proportion to their
cumulative weights; the point at place j of it belongs to the van der Corput sequence at
index bit-reverse(j), and that index orders the mix.  So any stretch of the mix holds
every source in close to its share, and each source has exactly its number of slots.  The
slots of a source are ranked along the mix; rank r takes block r mod blocks, passes come
one after another, and the last slot is cut so that the words meet the target.

A source larger than others is cut into chunks before its slots are listed; ranks and word
positions come from range-cut running totals; blocks meet documents by an equi-join on
(source, block).  Nothing is gathered by source.

Defined cases: a null text has no words and none are taken of it; a null source is a
source of its own, last in order; repeated rows are separate documents, each under its own
source and columns; rows with equal digests (null ids, for one) are ordered by size and a
hash of the text; an empty table, or one without words, gives targets of zero; columns of
any name are kept as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cpgspark.llm.ordered import ordered_totals
from cpgspark.llm.rows import one_per_key, packed
from cpgspark.llm.text import WORD, word_count
from cpgspark.plans.durable import store

WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
#: Words in a block.
BLOCK = 256
#: Slots listed by one row before it is spread.
_CHUNK = 4096


def sized(df: DataFrame, seed: int = 0, keep: Column | None = None) -> DataFrame:
    """``doc_id``, ``source``, ``row``, ``key``, ``size`` in words and the shuffling digest.

    Stored once, as all further work is on these narrow rows.  ``row`` is a number of the
    row's own: it makes the order total, so that repeated rows can be cut into ranges.
    ``key`` is what ``keep`` says, a hash of the text by default.
    """
    rows = df.select(
        "doc_id",
        "source",
        F.monotonically_increasing_id().alias("row"),
        (F.xxhash64("text") if keep is None else keep).alias("key"),
        word_count("text").alias("size"),
    )
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return store(rows.withColumn("digest", digest), "mix-sizes")


def targets(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_passes: int = MAX_PASSES
) -> DataFrame:
    """``source``, ``source_size``, ``weight`` and ``target`` words of each source.

    Sources in code-point order, null last, take the weights in turn and share all words;
    a target stops at ``max_passes`` times its source and the rest is shared on by
    weight.  That is one common level per unit of weight: sources are ordered by the level
    at which they are used up, and the level is right at the first one not used up by it.
    """
    sums = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = ordered_totals(
        sums.withColumn("last", F.col("source").isNull().cast("int")), ["last", "source"], {}
    )
    turn = F.array(*[F.lit(int(w)) for w in weights])
    weighted = ranked.select(
        "source",
        "source_size",
        F.get(turn, F.pmod(F.col("position"), F.lit(len(weights)))).cast("long").alias("weight"),
        F.col("position").alias("source_rank"),
        (F.lit(max_passes).cast("long") * F.col("source_size")).alias("most"),
    )
    full = F.col("most").cast("double") / F.col("weight")
    filled = store(
        ordered_totals(
            weighted.withColumn("full", full),
            ["full", "source_rank"],
            {"most": "most_before", "weight": "weight_before"},
            "fill_order",
        ),
        "mix-fill",
    )
    words, total_weight = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(words) - F.col("most_before")).cast("double") / (
        F.lit(total_weight) - F.col("weight_before")
    )
    reached = (
        filled.withColumn("level", level)
        .where("full >= level")
        .agg(F.min_by("level", "fill_order"))
        .first()[0]
    )
    return filled.select(
        "source",
        "source_rank",
        "source_size",
        "weight",
        F.least(F.col("most").cast("double"), F.lit(reached) * F.col("weight")).alias("target"),
    )


def slots_of(quota: Column, size: Column, block: int) -> Column:
    """Slots that hold ``quota`` words of a source: whole passes, then a part of one."""
    blocks = F.ceil(size / F.lit(block))
    passes = F.when(size > 0, F.floor(quota / size)).otherwise(0)
    return (passes * blocks + F.ceil((quota - passes * size) / F.lit(block))).cast("long")


def schedule(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix: ``turn`` orders all slots; each names a source, pass, block and its words.

    ``start`` and ``stop`` bound the words on the source's line.
    """
    quota = F.round("target").cast("long")
    counted = goals.where("source_size > 0").select(
        "source_rank", "source_size", quota.alias("quota")
    ).withColumn("slots", slots_of(F.col("quota"), F.col("source_size"), block))
    lined = store(
        ordered_totals(counted, ["source_rank"], {"slots": "first_slot"}, "place"), "mix-slots"
    )
    total = lined.agg(F.sum("slots")).first()[0] or 0
    bits = max(total.bit_length(), 1)
    chunks = (
        lined.where("slots > 0")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("slots") - 1, F.lit(_CHUNK))))
        .repartition("source_rank", "chunk")
    )
    last = F.least(F.col("chunk") + _CHUNK, F.col("slots")) - 1
    points = (
        chunks.withColumn("i", F.explode(F.sequence(F.col("chunk"), last)))
        .select(
            "source_rank",
            "source_size",
            "quota",
            "first_slot",
            F.conv(
                F.reverse(F.lpad(F.bin(F.col("first_slot") + F.col("i")), bits, "0")),
                2,
                10,
            ).cast("long").alias("turn"),
        )
    )
    ranked = ordered_totals(points, ["source_rank", "turn"], {}, "at")
    rank = F.col("at") - F.col("first_slot")
    blocks = F.ceil(F.col("source_size") / F.lit(block))
    placed = ranked.select(
        "source_rank",
        "turn",
        rank.alias("rank"),
        F.floor(rank / blocks).cast("long").alias("pass"),
        (rank % blocks).cast("long").alias("block"),
        "source_size",
        "quota",
    )
    start = F.col("block") * block
    end = F.least(start + block, F.col("source_size"))
    left = F.col("quota") - F.col("pass") * F.col("source_size")
    return placed.select(
        "turn", "source_rank", "rank", "pass", "block", start.alias("start"),
        F.least(end, left).alias("stop"),
    )


def _lined(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """Documents with their goal and their place ``at`` on the source's line of words."""
    lined = ordered_totals(docs, ["source", "digest", "doc_id", "size", "key", "row"], {"size": "at"}, "place")
    starts = ordered_totals(
        goals.select("source", "source_size"), ["source"], {"source_size": "begin"}, "place"
    ).select("source", "begin")
    full_goals = goals.alias("g").join(
        starts.alias("s"), F.col("g.source").eqNullSafe(F.col("s.source"))
    ).select("g.*", "begin")
    known = lined.alias("d").join(
        full_goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))
    )
    return store(
        known.select(
            "row", "doc_id", "key", "size", "source_size", "target", "source_rank",
            (F.col("at") - F.col("begin")).alias("at"),
        ),
        "mix-lined",
    )


def _spans(known: DataFrame, block: int) -> DataFrame:
    """One row for each document and block that it has words in."""
    first, last = F.col("at") / block, (F.col("at") + F.col("size") - 1) / block
    return known.where("size > 0").select(
        "row", "at", "size", "source_rank",
        F.explode(F.sequence(F.floor(first), F.floor(last))).alias("block"),
    )


def _overlap(stop: Column, block: int) -> Column:
    """Words of a document in its block up to ``stop`` on the line."""
    begin = F.greatest(F.col("at"), F.col("block") * block)
    return F.greatest(F.least(F.col("at") + F.col("size"), stop) - begin, F.lit(0))


def ordered_mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_passes: int = MAX_PASSES,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """The documents with their goals, and the mix: one row per slot and document in it.

    ``docs`` is what :func:`sized` gives.  The mix has ``turn`` (its order), ``source_rank``,
    ``pass``, ``block``, ``row`` and ``words``, those that the slot takes of the document.
    """
    goals = store(targets(docs, weights, max_passes), "mix-targets")
    known = _lined(docs, goals)
    slots = schedule(goals, block).select("source_rank", "turn", "pass", "block", "stop")
    words = _overlap(F.col("stop"), block).cast("long")
    taken = _spans(known, block).join(slots, ["source_rank", "block"]).select(
        "turn", "source_rank", "pass", "block", "row", words.alias("words")
    )
    return known, taken.where("words > 0")


def mix(
    df: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_passes: int = MAX_PASSES,
    block: int = BLOCK,
    seed: int = 0,
) -> DataFrame:
    """One row per document: sizes, its source's target, and words the mix takes of it.

    ``first_turn`` is the turn at which the mix first takes words of it, null if never.
    Needs ``doc_id``, ``source`` and ``text``.
    """
    known, slots = ordered_mix(sized(df, seed), weights, max_passes, block)
    got = slots.groupBy("row").agg(F.sum("words").alias("taken"), F.min("turn").alias("first_turn"))
    return known.join(got, "row", "left").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        "first_turn",
    )


def mixed(
    df: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_passes: int = MAX_PASSES,
    block: int = BLOCK,
    seed: int = 0,
) -> DataFrame:
    """The mix itself: the rows of ``df``, once for each pass that takes words of them.

    Rows come in the order in which the mix first meets them in that pass.  The one
    document of a source at which its target ends is cut to the words taken.
    """
    # Rows that share a key are equal in all columns (by two hashes, the id and the source).
    columns = [F.col(f"`{c}`") for c in df.columns]
    key = F.struct(
        F.col("doc_id").alias("id"), F.col("source").alias("source"),
        F.xxhash64(*columns).alias("all"), F.xxhash64("text").alias("text"),
    )
    docs = sized(df, seed, key)
    known, slots = ordered_mix(docs, weights, max_passes, block)
    passes = slots.groupBy("row", "pass").agg(
        F.sum("words").alias("words"), F.min("turn").alias("turn")
    )
    equal = docs.groupBy("key").agg(F.count(F.lit(1)).alias("equal"))
    wanted = known.select("row", "key", "size").join(passes, "row").join(equal, "key").select(
        F.col("key").alias("row"), "equal", "words", "size", "turn"
    )
    found = one_per_key(df.select(key.alias("row"), packed(df).alias("all")), store(wanted, "mix-taken"))
    text = F.col("all.text")
    cut = F.array_join(
        F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})")), F.lit(1), F.col("words").cast("int")), " "
    )
    taken = F.when(F.col("words") >= F.col("size"), text).otherwise(cut)
    return (
        found.withColumn("all", F.col("all").withField("text", taken)).orderBy("turn").select("all.*")
    )
