"""Byte-level BPE by speculation: propose, verify, and merge only what fails.

Greedy longest match proposes the tokens of each distinct word.  A proposal is the true
encoding exactly if every token re-encodes to itself and every adjacent pair is
compatible, that is, no merge across the border would have come before the merges that
built the two tokens.  All pairs of a piece are checked together in array operations,
walking both tokens back through their merges; only failing words are merged step by
step.  The tables hold a few MB for a given vocabulary file, read once by the driver and
broadcast, so executors need no path of their own.

Defined cases: a null or empty text has no ids and decodes to the empty text; special
tokens' strings in a text become their ids, as the tokenizers library does; repeated rows
agree; a word of any length is merged in n log n steps.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from cpgspark.llm.text import pieces

#: How the byte-level scheme cuts text before merging.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Words kept ready in one Python worker; on reaching it the store starts afresh.
CACHE_WORDS = 100_000
CACHE_WORD_CHARS = 64
#: Words up to this many bytes are merged by scanning, longer ones with a heap.
SHORT_WORD = 64
_LAST = 1 << 40
_NEVER = np.int64(1) << 40
_PIECE = 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _byte_letters() -> dict[str, int]:
    """Letter to byte in the printable alphabet that such vocabulary files use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Tables:
    """What encoding and decoding need of one vocabulary."""

    tokens: list[bytes]
    left: np.ndarray  # of the merge that makes a token; -1 for a single byte
    right: np.ndarray
    made: np.ndarray  # rank of that merge; -1 for a single byte
    pair_keys: np.ndarray  # left * len(tokens) + right, rising
    pair_ranks: np.ndarray
    specials: dict[str, int]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @functools.cached_property
    def token_id(self) -> dict[bytes, int]:
        plain = set(self.specials.values())
        return {t: i for i, t in enumerate(self.tokens) if i not in plain and t}

    @functools.cached_property
    def prefixes(self) -> dict[bytes, int]:
        """Every beginning of a token, with the token's id or -1."""
        found: dict[bytes, int] = {}
        for token in self.token_id:
            for end in range(1, len(token)):
                found.setdefault(token[:end], -1)
            found[token] = self.token_id[token]
        return found

    @functools.cached_property
    def rank_of(self):
        return dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist())).get

    @functools.cached_property
    def token_of(self) -> dict[int, int]:
        """Merge rank to the token it makes."""
        return {rank: token for rank, token in self.made_by.values()}

    @functools.cached_property
    def made_by(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left, right) to (rank, token)."""
        return {
            (int(a), int(b)): (int(r), t)
            for t, (a, b, r) in enumerate(zip(self.left, self.right, self.made))
            if r >= 0
        }

    @functools.cached_property
    def sound(self) -> np.ndarray:
        """Whether a token's own bytes encode to that token."""
        built = np.flatnonzero(self.made >= 0)
        good = np.ones(len(self.tokens), dtype=bool)
        good[built] = self.compatible(self.left[built], self.right[built], self.made[built])
        for token in built[np.argsort(self.made[built])]:
            good[token] &= good[self.left[token]] and good[self.right[token]]
        return good

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wanted = a * len(self.tokens) + b
        at = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == wanted, self.pair_ranks[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None):
        """Whether no merge crosses the border of ``a`` and ``b`` before rank ``until``.

        Both tokens are taken apart from the latest merge to the earliest.  At each
        stage the two pieces at the border existed until the rank at which they were
        used up; a merge of the two that ranks before that would have come first.
        With equal ranks the leftmost place is merged first.
        """
        good = np.ones(len(a), dtype=bool)
        where = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_used = np.full(len(a), _NEVER) if until is None else until.astype(np.int64)
        y_used = x_used.copy()
        while len(where):
            rank = self.ranks(x, y)
            bad = (rank < x_used) & (rank <= y_used)
            good[where[bad]] = False
            x_made, y_made = self.made[x], self.made[y]
            go = ~bad & ((x_made >= 0) | (y_made >= 0))
            where, x, y = where[go], x[go], y[go]
            x_used, y_used, x_made, y_made = x_used[go], y_used[go], x_made[go], y_made[go]
            split_x = x_made > y_made
            x_used = np.where(split_x, x_made, x_used)
            y_used = np.where(split_x, y_used, y_made)
            x, y = np.where(split_x, self.right[x], x), np.where(split_x, y, self.left[y])
        return good


def load_tables(path: str | None = None) -> Tables:
    """Read a byte-level BPE vocabulary in the tokenizers library's JSON form."""
    with open(path or default_path(), encoding="utf-8") as file:
        content = json.load(file)
    model, letters = content["model"], _byte_letters()
    size = 1 + max([*model["vocab"].values(), *(t["id"] for t in content["added_tokens"])])
    tokens = [b""] * size
    for text, number in model["vocab"].items():
        tokens[number] = bytes(letters[c] for c in text)
    specials = {t["content"]: t["id"] for t in content["added_tokens"]}
    for text, number in specials.items():
        tokens[number] = text.encode()
    left, right, made = (np.full(size, -1, dtype=np.int64) for _ in range(3))
    keys, ranks = [], []
    for rank, merge in enumerate(model["merges"]):
        first, second = merge.split(" ") if isinstance(merge, str) else merge
        a, b, token = (model["vocab"][t] for t in (first, second, first + second))
        keys.append(a * size + b)
        ranks.append(rank)
        if made[token] < 0:
            left[token], right[token], made[token] = a, b, rank
    order = np.argsort(np.array(keys, dtype=np.int64))
    return Tables(
        tokens,
        left,
        right,
        made,
        np.array(keys, dtype=np.int64)[order],
        np.array(ranks, dtype=np.int64)[order],
        specials,
    )


def propose(tables: Tables, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Greedy longest-match tokens of all words in a row, and tokens per word."""
    ids, counts = [], []
    step = tables.prefixes.get
    for word in words:
        before, at, end = len(ids), 0, len(word)
        while at < end:
            token, stop, seen = -1, at, at + 1
            while (found := step(word[at:seen])) is not None:
                if found >= 0:
                    token, stop = found, seen
                if seen == end:
                    break
                seen += 1
            ids.append(token)
            at = stop
        counts.append(len(ids) - before)
    return np.array(ids, dtype=np.int64), np.array(counts, dtype=np.int64)


def merge_exactly(tables: Tables, word: bytes) -> list[int]:
    """The merges in rank order, leftmost first."""
    if len(word) > SHORT_WORD:
        return _merge_long(tables, word)
    rank_of, token_of, size = tables.rank_of, tables.token_of, len(tables.tokens)
    ids = [tables.token_id[word[i : i + 1]] for i in range(len(word))]
    ranks = [rank_of(a * size + b, _LAST) for a, b in itertools.pairwise(ids)]
    while ranks and (best := min(ranks)) < _LAST:
        i = ranks.index(best)
        ids[i : i + 2] = [token_of[best]]
        del ranks[i]
        if i < len(ranks):
            ranks[i] = rank_of(ids[i] * size + ids[i + 1], _LAST)
        if i:
            ranks[i - 1] = rank_of(ids[i - 1] * size + ids[i], _LAST)
    return ids


def _merge_long(tables: Tables, word: bytes) -> list[int]:
    """The same on a linked list with a heap: n log n steps for a word of n bytes."""
    ids = [tables.token_id[word[i : i + 1]] for i in range(len(word))]
    after = list(range(1, len(ids) + 1))
    before = list(range(-1, len(ids) - 1))
    made_by = tables.made_by
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(ids) and (found := made_by.get((ids[i], ids[j]))):
            heapq.heappush(heap, (found[0], i, ids[i], ids[j]))

    for i in range(len(ids) - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if ids[i] == a else len(ids)
        if j >= len(ids) or ids[j] != b:
            continue
        ids[i], ids[j] = made_by[(a, b)][1], -1
        after[i] = after[j]
        if after[i] < len(ids):
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [token for token in ids if token >= 0]


def encode_words(tables: Tables, words: list[bytes]) -> list[bytes]:
    """Ids of each word as little-endian 32-bit integers: proposals where all pairs hold, exact merging elsewhere."""
    ids, counts = propose(tables, words)
    owner = np.repeat(np.arange(len(words)), counts)
    failed = np.zeros(len(words), dtype=bool)
    failed[owner[~tables.sound[ids]]] = True
    inside = np.flatnonzero(owner[1:] == owner[:-1])
    pairs, at = np.unique(ids[inside] * len(tables.tokens) + ids[inside + 1], return_inverse=True)
    good = tables.compatible(pairs // len(tables.tokens), pairs % len(tables.tokens))
    failed[owner[inside[~good[at]]]] = True
    data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
    found = [data[a:b] for a, b in itertools.pairwise([0, *ends])]
    for i in np.flatnonzero(failed).tolist():
        merged = merge_exactly(tables, words[i])
        found[i] = struct.pack(f"<{len(merged)}I", *merged)
    return found


class Encoder:
    """Encodes texts with a store of words already seen."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.word = regex.compile(WORD_PATTERN)
        names = sorted(tables.specials, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.store: dict[str, bytes] = {}

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of ordinary text, each with the special token that follows it."""
        start = 0
        for match in self.special.finditer(text) if self.special else ():
            yield text[start : match.start()], self.tables.specials[match[0]]
            start = match.end()
        yield text[start:], None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        cut: list[list[tuple[list[str], int | None]]] = [
            [(self.word.findall(part), special) for part, special in self.segments(text)]
            for text in texts
        ]
        if len(self.store) > CACHE_WORDS:
            self.store = {}
        needed = set().union(*(words for parts in cut for words, _ in parts))
        new = [word for word in needed if word not in self.store]
        fresh = dict(zip(new, encode_words(self.tables, [w.encode() for w in new])))
        self.store |= {w: x for w, x in fresh.items() if len(w) <= CACHE_WORD_CHARS}
        long_words = {w: x for w, x in fresh.items() if len(w) > CACHE_WORD_CHARS}
        ids_of = ({**self.store, **long_words} if long_words else self.store).__getitem__
        found = []
        for parts in cut:
            out = []
            for words, special in parts:
                out.append(b"".join(map(ids_of, words)))
                if special is not None:
                    out.append(int(special).to_bytes(4, "little"))
            found.append(b"".join(out))
        return found


_ENCODERS: dict[str, Encoder] = {}


def _encoder(tables: Tables) -> Encoder:
    """One encoder for each Python worker, kept over its tasks."""
    if tables.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tables.key] = Encoder(tables)
    return _ENCODERS[tables.key]


def share_tables(spark: SparkSession, path: str | None = None) -> Any:
    """Broadcast of the tables; their size is that of the vocabulary file."""
    return spark.sparkContext.broadcast(load_tables(path))


def encode(df: DataFrame, tables: Any, text_col: str = "text") -> DataFrame:
    """Replace the text column by ``ids`` (array), ``n_tokens`` and ``ids_sha256``.

    All other columns are kept, but for those of these three names, which are replaced.
    """
    keep = [c for c in df.columns if c not in (text_col, "ids", "n_tokens", "ids_sha256")]
    schema = StructType(
        [df.schema[c] for c in keep]
        + [
            StructField("ids", ArrayType(IntegerType())),
            StructField("n_tokens", LongType()),
            StructField("ids_sha256", StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tables.value)
        for batch in batches:
            for start, stop in pieces(batch.column(len(keep)), _PIECE):
                part = batch.slice(start, stop - start)
                coded = encoder.encode([t or "" for t in part.column(len(keep)).to_pylist()])
                ends = np.cumsum([0, *(len(x) // 4 for x in coded)], dtype=np.int32)
                flat = np.frombuffer(b"".join(coded), dtype="<u4").astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {name: part.column(i) for i, name in enumerate(keep)}
                    | {
                        "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                        "n_tokens": pa.array(np.diff(ends).astype(np.int64)),
                        "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                    }
                )

    return df.select(*keep, text_col).mapInArrow(run, schema)


def decode(
    df: DataFrame,
    tables: Any,
    ids_col: str = "ids",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Replace the ids by the text they stand for, special tokens' strings included.

    With ``keep_ids`` both are returned.  A column of the text's name is replaced.

    Bytes that form no UTF-8 come out as replacement characters; null ids give null.
    """
    keep = [c for c in df.columns if c != text_col and (keep_ids or c != ids_col)]
    schema = StructType([df.schema[c] for c in keep] + [StructField(text_col, StringType())])

    read = keep if keep_ids else [*keep, ids_col]
    at = read.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(tables.value.tokens, pa.large_binary())
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column(at)
                counts = np.diff(np.asarray(lists.offsets))
                raw = tokens.take(lists.flatten())
                ends = np.r_[0, np.cumsum(np.asarray(pc.binary_length(raw), dtype=np.int64))]
                rows = ends[np.r_[0, np.cumsum(counts)]]
                data = raw.buffers()[2] or pa.py_buffer(b"")
                whole = pa.Array.from_buffers(
                    pa.large_binary(), part.num_rows, [None, pa.py_buffer(rows.tobytes()), data]
                )
                try:
                    texts = whole.cast(pa.large_string()).cast(pa.string())
                except pa.ArrowInvalid:
                    texts = pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()])
                if lists.null_count:
                    texts = pa.array(
                        [t if ok else None for t, ok in zip(texts.to_pylist(), lists.is_valid().to_pylist())],
                        pa.string(),
                    )
                yield pa.RecordBatch.from_pydict(
                    {name: part.column(i) for i, name in enumerate(keep)} | {text_col: texts}
                )

    return df.select(*read).mapInArrow(run, schema)


def round_trip(df: DataFrame, tables: Any, text_col: str = "text") -> DataFrame:
    """Encode and decode again; the texts come from the ids alone."""
    return decode(encode(df, tables, text_col), tables, "ids", text_col).withColumn(
        "decoded_sha256", F.sha2(F.encode(F.col(text_col), "UTF-8"), 256)
    )
