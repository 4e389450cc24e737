from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest

from cpgspark.llm import chat

MESSAGES = "tree long, node long, parent long, role string, text string, score double, path string, part string"


def messages(spark, rows):
    return spark.createDataFrame([(*r, "p", "q") for r in rows], MESSAGES)


def brute_paths(rows):
    """Rank, leaf and nodes of every root-to-leaf path, one parent at a time."""
    node = {r[1]: r for r in rows}
    parents = {r[2] for r in node.values() if r[2] != r[1]}
    trees = defaultdict(list)
    for leaf in node:
        if leaf in parents:
            continue
        path, at = [], leaf
        while at is not None and at in node and at not in path:
            path.append(at)
            at = node[at][2]
            if at == path[-1]:
                at = None
        if at is not None and at in path:
            continue  # a cycle
        mean = sum(node[n][5] or 0.0 for n in path) / len(path)
        trees[node[leaf][0]].append((-mean, leaf, path[::-1]))
    return {
        (t, i): (leaf, path) for t, found in trees.items() for i, (_, leaf, path) in enumerate(sorted(found), 1)
    }


def tree_rows():
    rows = [(1, 0, None, "user", "root", 0.0)]
    for i in range(1, 40):
        rows.append((1, i, (i * 7 % 11) % i, "assistant" if i % 2 else "user", f"text {i}", float(i * 13 % 5)))
    rows += [(2, 100, 99, "user", "parent unknown", None), (2, 101, 100, None, None, None)]
    rows += [(3, 200, 201, "a", "cycle", 1.0), (3, 201, 200, "b", "cycle", 1.0), (3, 202, 201, "c", "on it", 1.0)]
    rows += [(4, 300, 300, "user", "own parent", 1.0), (None, 400, None, "user", "no tree", 1.0)]
    return rows + rows[:3]


def test_paths_equal_walking_up(spark):
    rows = tree_rows()
    found = defaultdict(list)
    for r in chat.ranked_paths(messages(spark, rows)).collect():
        found[r.tree, r.path].append((r.turn, r.node, r.leaf))
    got = {k: (v[0][2], [n for _, n, _ in sorted(v)]) for k, v in found.items()}
    assert got == brute_paths(rows)
    assert all([t for t, _, _ in sorted(v)] == list(range(len(v))) for v in found.values())


def test_best_branches_only(spark):
    rows = tree_rows()
    got = {(r.tree, r.path) for r in chat.ranked_paths(messages(spark, rows), best=2).collect()}
    assert got == {k for k in brute_paths(rows) if k[1] <= 2}


@pytest.mark.parametrize("turns", [1, 3, 64])
def test_round_trip_of_control_strings(spark, turns):
    texts = ["", None, "\\", "\\\\", "###", "#### x", "</turn>", "\\</turn>\n", "### assistant: hi</turn>\n", "a\\", "é日\U0001f600", "<", "</turn", "x" * 50_000]
    roles = ["user", "assistant", "a: b", "x</turn>y", "#\\:", None, ""]
    rows = [(1, i, i - 1 if i else None, roles[i % len(roles)], t, 0.0) for i, t in enumerate(texts * 3)]
    parts = chat.format_paths(messages(spark, rows), part_turns=turns)
    said = [x for p in sorted(parts.collect(), key=lambda p: p.part) for x in chat.parse(p.text)]
    assert said == [(r[3] or "", r[4] or "") for r in rows]
    one = chat.read_back(parts).collect()[0]
    loss = "".join(t or "" for _, _, _, role, t, _ in rows if role == "assistant")
    assert one.n_turns == len(rows) and one.loss_chars == len(loss)
    assert one.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    whole = "".join(f"{r[3] or ''}\n{r[4] or ''}\n" for r in rows)
    assert one.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert one.formatted_chars == sum(len(p.text) for p in parts.collect())


def test_text_outside_of_turns_is_refused():
    with pytest.raises(ValueError):
        chat.parse("### user: a</turn>\nstray")


def test_linear_conversations_with_odd_rows(spark):
    rows = [(1, 2, "b", "two"), (1, 1, "a", "one"), (1, None, "z", None), (None, 5, None, ""), (1, 1, "a", "one")]
    rows += [(2, i, "assistant", f"t{i}") for i in range(300)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.tree: r for r in chat.read_back(chat.format_paths(chat.linear_replies(frame))).collect()}
    first = "a\none\na\none\nb\ntwo\nz\n\n"
    assert got[1].turns_sha256 == hashlib.sha256(first.encode()).hexdigest() and got[1].n_turns == 4
    assert got[None].n_turns == 1 and got[2].n_turns == 300
    assert got[2].loss_sha256 == hashlib.sha256("".join(f"t{i}" for i in range(300)).encode()).hexdigest()
    assert chat.read_back(chat.format_paths(chat.linear_replies(frame.limit(0)))).count() == 0
