"""Chat formatting of reply trees: every chosen root-to-leaf path becomes one conversation.

Messages name their parent.  Paths come from self-joins that double their reach: a table
of jumps leads from each message to the ancestor 1, 2, 4 ... replies up, and the paths of
the leaves, which hold the ancestors nearer than that, take in the same number again by one
join.  So the rounds grow with the logarithm of the longest path, on rows of three numbers.
Branches are ranked inside their tree by the mean score of their messages, ties to the
smaller leaf; the best ``best`` of them are formatted, all by default.

The template writes a turn as ``### role: text</turn>`` and a line feed.  Inside texts and
roles a backslash goes before every backslash, every ``#`` and every ``<`` that begins
``</turn>``, in roles before every colon as well; so no control string is left in them, and
dropping each backslash that stands before a character gives them back.  A conversation is
written in parts of :data:`PART_TURNS` turns, so that no row grows with its length; each
part has the spans of its text that the loss counts (code points from its start), which
are the texts of the learned role.

:func:`read_back` parses the parts alone, in order, with a running digest for each path.

Defined cases: a null text or role is empty; a message whose parent is null or not there is
a root; messages that hang on a cycle of parents have no path; a message found several
times under one number is taken once; equal turns of a table are ordered by role and
text, null turns come last, and rows without a conversation id form one conversation; an
empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from cpgspark.llm.ordered import ordered_totals
from cpgspark.plans.durable import store

PART_TURNS = 64
LEARNED = "assistant"
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
_TURN = re.compile(
    r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL
)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: Column, role: bool = False) -> Column:
    marks = r"([\\#:]|<(?=/turn>))" if role else r"([\\#]|<(?=/turn>))"
    return F.regexp_replace(F.coalesce(text, F.lit("")), marks, r"\\$1")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def linear_replies(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Conversations as trees without branches: each row replies to the row before it.

    Gives ``tree``, ``node``, ``parent``, ``role``, ``text`` and ``score``.
    """
    rows = df.select(
        F.col(conv_col).alias("tree"),
        F.col(turn_col).isNull().alias("late"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    order = ["tree", "late", "turn", "role", "text"]
    placed = store(ordered_totals(rows, order, {}, "node"), "chat-rows")
    first = placed.groupBy("tree").agg(F.min("node").alias("first"))
    rows, first = placed.alias("p"), first.alias("f")
    return rows.join(first, F.col("p.tree").eqNullSafe(F.col("f.tree"))).select(
        "p.tree",
        "node",
        F.when(F.col("node") > F.col("first"), F.col("node") - 1).alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def reply_paths(messages: DataFrame) -> DataFrame:
    """``leaf``, ``node`` and ``up`` (replies from the leaf up to it) of all root-to-leaf paths.

    ``messages`` has ``node`` and ``parent``, numbers that are unique over all trees.
    """
    known = store(messages.select("node", "parent").dropDuplicates(["node"]), "chat-links")
    there = known.select(F.col("node").alias("parent"))
    links = known.where("parent IS NOT NULL AND parent != node").join(there, "parent", "left_semi")
    jumps = store(links.select("node", F.col("parent").alias("to")), "chat-jumps")
    leaves = known.join(jumps.select(F.col("to").alias("node")), "node", "left_anti")
    paths = store(
        leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "chat-paths"
    )
    reach, total = 1, known.count()
    while reach < 2 * total and jumps.limit(1).count():
        step = F.col("up") + reach
        further = paths.join(jumps, "node").select("leaf", F.col("to").alias("node"), step.alias("up"))
        paths = store(paths.unionByName(further), "chat-paths")
        second = jumps.select(F.col("node").alias("to"), F.col("to").alias("then"))
        jumps = store(jumps.join(second, "to").select("node", F.col("then").alias("to")), "chat-jumps")
        reach *= 2
    # What still leads on after as many replies as there are messages hangs on a cycle.
    endless = paths.join(jumps, "node", "left_semi").select("leaf").distinct()
    return paths.join(endless, "leaf", "left_anti")


def ranked_paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """``tree``, ``path`` (its rank from 1), ``leaf``, ``turn`` (from 0) and ``node``."""
    paths = store(reply_paths(messages), "chat-all-paths")
    kept = messages.select("tree", "node", "score").dropDuplicates(["node"])
    scored = (
        paths.join(kept.select("node", "score"), "node")
        .groupBy("leaf")
        .agg(F.avg(F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("mean"), F.max("up").alias("depth"))
    )
    trees = kept.select(F.col("node").alias("leaf"), "tree")
    lined = scored.join(trees, "leaf").select("tree", (-F.col("mean")).alias("loss"), "leaf", "depth")
    placed = store(ordered_totals(lined, ["tree", "loss", "leaf"], {}, "place"), "chat-ranks")
    first = placed.groupBy("tree").agg(F.min("place").alias("first"))
    ranks = placed.alias("p").join(first.alias("f"), F.col("p.tree").eqNullSafe(F.col("f.tree"))).select(
        "p.tree", "leaf", "depth", (F.col("place") - F.col("first") + 1).alias("path")
    )
    if best is not None:
        ranks = ranks.where(F.col("path") <= best)
    return paths.join(ranks, "leaf").select(
        "tree", "path", "leaf", (F.col("depth") - F.col("up")).alias("turn"), "node"
    )


def format_paths(
    messages: DataFrame, best: int | None = None, learned: str = LEARNED, part_turns: int = PART_TURNS
) -> DataFrame:
    """``tree``, ``path``, ``part``, ``text`` and ``spans`` (``start``, ``stop``) under the loss.

    ``messages`` has ``tree``, ``node``, ``parent``, ``role``, ``text`` and ``score``.
    """
    said = messages.select(
        "node",
        F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(MIDDLE)).alias("head"),
        escape(F.col("text")).alias("body"),
        F.coalesce(F.col("role") == learned, F.lit(False)).alias("counts"),
    ).dropDuplicates(["node"])
    turns = ranked_paths(messages, best).join(said, "node")
    gathered = turns.groupBy(
        "tree", "path", F.floor(F.col("turn") / part_turns).cast("long").alias("part")
    ).agg(F.array_sort(F.collect_list(F.struct("turn", "head", "body", "counts"))).alias("turns"))
    long = F.lit(0).cast("long")
    spans = F.aggregate(
        "turns",
        F.struct(long.alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("found")),
        lambda held, t: F.struct(
            (held["at"] + F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).alias("at"),
            F.when(
                t["counts"],
                F.concat(
                    held["found"],
                    F.array(
                        F.struct(
                            (held["at"] + F.length(t["head"])).alias("start"),
                            (held["at"] + F.length(t["head"]) + F.length(t["body"])).alias("stop"),
                        )
                    ),
                ),
            )
            .otherwise(held["found"])
            .alias("found"),
        ),
        lambda held: held["found"],
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return gathered.select("tree", "path", "part", text.alias("text"), spans.alias("spans"))


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted part; text outside of turns is refused."""
    turns, at = [], 0
    while at < len(text):
        found = _TURN.match(text, at)
        if found is None:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


class _Reading:
    """Counts and running digests of one path."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, text: str, spans: list[dict]) -> None:
        self.formatted_chars += len(text)
        for role, said in parse(text):
            self.n_turns += 1
            self.turns.update(f"{role}\n{said}\n".encode())
        for span in spans:
            said = unescape(text[span["start"] : span["stop"]])
            self.loss_chars += len(said)
            self.loss.update(said.encode())


def read_back(parts: DataFrame) -> DataFrame:
    """Counts and digests of every formatted path, from its parts alone."""
    schema = StructType(
        [
            parts.schema["tree"],
            StructField("path", LongType()),
            StructField("n_turns", LongType()),
            StructField("turns_sha256", StringType()),
            StructField("loss_chars", LongType()),
            StructField("loss_sha256", StringType()),
            StructField("formatted_chars", LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reading = None, None
        arrow = None

        def row() -> pa.RecordBatch:
            found = {
                "tree": [current[0]],
                "path": [current[1]],
                "n_turns": [reading.n_turns],
                "turns_sha256": [reading.turns.hexdigest()],
                "loss_chars": [reading.loss_chars],
                "loss_sha256": [reading.loss.hexdigest()],
                "formatted_chars": [reading.formatted_chars],
            }
            return {"tree": pa.array(found.pop("tree"), arrow), **{k: pa.array(v) for k, v in found.items()}}

        done: list[dict] = []

        def batch_of() -> pa.RecordBatch:
            names = done[0].keys()
            return pa.RecordBatch.from_pydict({n: pa.concat_arrays([d[n] for d in done]) for n in names})

        for batch in batches:
            arrow = batch.column(0).type
            for i in range(batch.num_rows):
                tree, path, _, text, spans = (batch.column(c)[i].as_py() for c in range(5))
                if reading is None or (tree, path) != current:
                    if reading is not None:
                        done.append(row())
                    current, reading = (tree, path), _Reading()
                reading.add(text, spans)
                if len(done) >= 4096:
                    yield batch_of()
                    done.clear()
        if reading is not None:
            done.append(row())
            yield batch_of()

    ordered = parts.select("tree", "path", "part", "text", "spans")
    return ordered.repartition("tree", "path").sortWithinPartitions("tree", "path", "part").mapInArrow(run, schema)
