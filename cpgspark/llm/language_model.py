"""LM scoring with an n-gram trie whose pointers are Elias-Fano coded.

Training tokens are counted by Spark: words by a 64-bit hash, then trigrams by word
numbers.  Each piece of text sends one sorted, packed run of its grams to every range of
grams, and a range's runs are merged by one task; with very many pieces a salted round
merges some of them first.  Sampled bounds cut the grams into ranges of equal weight by
their first two words, so a frequent word or pair spreads over several files.  A range
becomes one trie file: first words, second words, third words, each level with quantised
smoothed probabilities, and the pointers from one level to the next as Elias-Fano
sequences.  Word numbers are packed to the bits they need.

Smoothing is interpolated absolute discounting over the add-one unigram:
``p3 = max(c3 - d, 0) / c2 + d * kinds2 / c2 * p2``, the same one level down, and
``p1 = (c + 1) / (n + v + 1)``.  Files hold the discounted shares and the back-off weights;
scores add them up.  A share takes one byte, by a book of each file.

A query finds the file of a pair, the first word in it, and then the first word number not
below the wanted one among the successors that the pointers bound for this context.  Each
piece of text asks for every different pair and triple once.  Files are mapped from the
shared place; the driver holds one line for each file.

Defined cases: a null or empty text is the end token alone; a word that training lacks has
count zero and is a context of no gram; without training rows every token has probability
1 / (v + 1) with v = 0; repeated rows count each; null ids are never held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from cpgspark.llm.mapped import open_arrays, write_arrays
from cpgspark.llm.text import as_bytes, pieces, split_words
from cpgspark.plans.durable import scratch_path, store

DISCOUNT = 0.75
#: Training tokens for each trie file, and for each vocabulary file.
FILE_GRAMS = 1 << 20
FILE_WORDS = 1 << 24
#: Runs merged at once.
MERGED_RUNS = 4096
_PIECE = 6 << 20
_SEED = 7
_UNKNOWN = np.int64(0x7FFFFFFE)
#: A byte no word can hold names the end token.
_END = np.uint64(xxhash.xxh64_intdigest(b"\n", _SEED))


# ---- Elias-Fano and quantising ---------------------------------------------------------


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of at most ``bits`` bits each, one after another in 64-bit words."""
    flat = np.zeros(-(-max(len(values) * bits, 1) // 64) * 64 + 64, dtype=np.uint8)
    for start in range(0, len(values), 1 << 16):
        some = values[start : start + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        rows = np.unpackbits(some, axis=1, bitorder="little")[:, :bits]
        flat[start * bits : start * bits + rows.size] = rows.ravel()
    return np.packbits(flat, bitorder="little").view("<u8")


def unpack(words: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    """The packed numbers at the given places."""
    if not bits:
        return np.zeros(len(at), dtype=np.int64)
    place = at * bits
    first, shift = place >> 6, (place & 63).astype(np.uint64)
    low = words[first] >> shift
    over = np.flatnonzero(shift + np.uint64(bits) > 64)
    low[over] |= words[first[over] + 1] << (np.uint64(64) - shift[over])
    return (low & np.uint64((1 << bits) - 1)).astype(np.int64)


def elias_fano(values: np.ndarray) -> dict[str, np.ndarray]:
    """Never-falling numbers as packed low bits and a bit vector of the high parts."""
    values = values.astype(np.int64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    bits = max((top // max(n, 1)).bit_length() - 1, 0)
    places = (values >> bits) + np.arange(n)
    flags = np.zeros((int(places[-1]) // 64 + 1 if n else 1) * 64, dtype=np.uint8)
    flags[places] = 1
    high = np.packbits(flags, bitorder="little").view("<u8")
    return {
        "high": high,
        "ones": np.r_[0, np.cumsum(np.bitwise_count(high))].astype(np.uint32),
        "low": pack(values & ((1 << bits) - 1), bits),
        "bits": np.array([bits], dtype=np.uint32),
    }


#: Place of the n-th set bit of a byte, in row n.
_BIT = np.array(
    [[([i for i in range(8) if b >> i & 1] + [0] * 8)[n] for b in range(256)] for n in range(8)], np.int64
)


def _select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit of each 64-bit word that ``rank`` others precede."""
    octets = np.ascontiguousarray(words, "<u8").view(np.uint8)
    # The product adds up the counts of the bytes so far, each in its own byte.
    so_far = np.bitwise_count(octets).view("<u8") * np.uint64(0x0101010101010101)
    octet = (so_far.view(np.uint8).reshape(-1, 8) <= rank[:, None].astype(np.uint8)).sum(axis=1)
    before = ((so_far << np.uint64(8)) >> (octet.astype(np.uint64) << np.uint64(3))) & np.uint64(255)
    return (octet << 3) + _BIT[rank - before.astype(np.int64), octets[np.arange(len(words)) * 8 + octet]]


def elias_fano_at(code: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """The numbers at the given places."""
    out = np.empty(len(at), dtype=np.int64)
    bits = int(code["bits"][0])
    for start in range(0, len(at), 1 << 16):
        i = at[start : start + (1 << 16)].astype(np.int64)
        word = np.searchsorted(code["ones"], i, side="right") - 1
        rank = i - code["ones"][word]
        place = (word << 6) + _select(code["high"][word], rank)
        out[start : start + (1 << 16)] = (place - i) << bits | unpack(code["low"], bits, i)
    return out


def quantise(name: str, share: np.ndarray) -> dict[str, np.ndarray]:
    """Shares in (0, 1] as one byte each, and the book of values the bytes stand for.

    Half of the book holds the most frequent values as they are, the other half is an even
    grid of logarithms for the rest.
    """
    logs = np.log10(share)
    steps = np.linspace(0, 1, 128)
    grid = logs.min() + steps * (logs.max() - logs.min())
    book = np.unique(np.r_[grid, np.quantile(logs, steps, method="nearest")])
    codes = np.searchsorted((book[1:] + book[:-1]) / 2, logs)
    return {name: codes.astype(np.uint8), name + "_book": 10.0**book}


def restore(file: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    return file[name + "_book"][file[name][at]]


def successors(
    words: np.ndarray, bits: int, start: np.ndarray, stop: np.ndarray, wanted: np.ndarray
) -> np.ndarray:
    """Place of each wanted number within its own range of packed words; -1 if not there."""
    low, high = start.copy(), stop.copy()
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live]) >> 1
        below = unpack(words, bits, middle) < wanted[live]
        low[live] = np.where(below, middle + 1, low[live])
        high[live] = np.where(below, high[live], middle)
        live = live[low[live] < high[live]]
    found = np.full(len(wanted), -1, dtype=np.int64)
    inside = np.flatnonzero(low < stop)
    hit = inside[unpack(words, bits, low[inside]) == wanted[inside]]
    found[hit] = low[hit]
    return found


# ---- the model -------------------------------------------------------------------------


@dataclass
class Model:
    """Sizes, and where the files are; a line for each file."""

    tokens: int = 0
    words: int = 0
    texts: int = 0
    discount: float = DISCOUNT
    vocabulary_bits: int = 0
    vocabulary_files: list[str] = field(default_factory=list)
    vocabulary_starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    trie_files: list[str] = field(default_factory=list)
    trie_last: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    split_kinds: dict[int, int] = field(default_factory=dict)

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and count of each word; unknown ones have count 0."""
        number = np.full(len(hashes), _UNKNOWN, dtype=np.int64)
        count = np.zeros(len(hashes), dtype=np.int64)
        if not self.words:
            return number, count
        shard = _top(hashes, self.vocabulary_bits)
        order = np.argsort(hashes)
        bounds = np.searchsorted(shard[order], np.arange(len(self.vocabulary_files) + 1))
        for s, path in enumerate(self.vocabulary_files):
            some = order[bounds[s] : bounds[s + 1]]
            if not len(some) or not path:
                continue
            file = open_arrays(path)
            at = np.minimum(np.searchsorted(file["hash"], hashes[some]), len(file["hash"]) - 1)
            hit = file["hash"][at] == hashes[some]
            number[some[hit]] = at[hit] + self.vocabulary_starts[s]
            count[some[hit]] = file["count"][at[hit]]
        return number, count

    def counts_of(self, numbers: np.ndarray) -> np.ndarray:
        """Count of each word number as a context; the start of a text is ``words``."""
        count = np.full(len(numbers), self.texts, dtype=np.int64)
        shard = np.searchsorted(self.vocabulary_starts, numbers, side="right") - 1
        for s in np.unique(shard[numbers < self.words]):
            some = np.flatnonzero((shard == s) & (numbers < self.words))
            file = open_arrays(self.vocabulary_files[s])
            count[some] = file["count"][numbers[some] - self.vocabulary_starts[s]]
        return count

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 1.0) / (self.tokens + self.words + 1.0)

    def lookup(self, pairs: np.ndarray, thirds: np.ndarray, pair_of: np.ndarray):
        """Probabilities for sorted pairs and for triples given as (pair, third word).

        Returns the pair's share, the back-off weights of its first word and of itself
        (1 where that context is unknown), and the triple's share.
        """
        share2, back1, back2 = np.zeros(len(pairs)), np.ones(len(pairs)), np.ones(len(pairs))
        share3 = np.zeros(len(thirds))
        # A first word lies in one file, that of its least pair, unless it is split.
        split = np.array(sorted(self.split_kinds), dtype=np.int64)
        is_split = np.isin(pairs >> 32, split)
        file_of = np.searchsorted(self.trie_last, np.where(is_split, pairs, pairs >> 32 << 32))
        file_of = np.where(is_split, np.minimum(file_of, len(self.trie_files) - 1), file_of)
        triple_file = file_of[pair_of] if len(thirds) else np.zeros(0, np.int64)
        triple_order = np.argsort(triple_file, kind="stable")
        for f in np.unique(file_of[file_of < len(self.trie_files)]):
            file = open_arrays(self.trie_files[f])
            here = slice(*np.searchsorted(file_of, [f, f + 1]))
            first, second = pairs[here] >> 32, pairs[here] & 0xFFFFFFFF
            at = np.minimum(np.searchsorted(file["first"], first), len(file["first"]) - 1)
            known = np.flatnonzero(file["first"][at] == first)
            at = at[known]
            weight = np.ones(len(first))
            weight[known] = restore(file, "back1", at)
            back1[here] = weight
            code = {k[2:]: v for k, v in file.items() if k.startswith("p2")}
            place = np.full(len(first), -1, dtype=np.int64)
            width = int(file["width"][0])
            place[known] = successors(
                file["second"], width, elias_fano_at(code, at), elias_fano_at(code, at + 1), second[known]
            )
            found = np.flatnonzero(place >= 0)
            share, weight = np.zeros(len(first)), np.ones(len(first))
            share[found] = restore(file, "share2", place[found])
            weight[found] = restore(file, "back2", place[found])
            share2[here], back2[here] = share, weight
            asked = triple_order[slice(*np.searchsorted(triple_file[triple_order], [f, f + 1]))]
            parent = place[pair_of[asked] - here.start]
            asked, parent = asked[parent >= 0], parent[parent >= 0]
            code = {k[2:]: v for k, v in file.items() if k.startswith("p3")}
            third = successors(
                file["third"], width, elias_fano_at(code, parent), elias_fano_at(code, parent + 1), thirds[asked]
            )
            share3[asked[third >= 0]] = restore(file, "share3", third[third >= 0])
        if len(split):  # their kinds are summed over files
            first = pairs[is_split] >> 32
            kinds = np.array([self.split_kinds[int(w)] for w in split])
            kinds = kinds[np.searchsorted(split, first)]
            back1[is_split] = self.discount * kinds / self.counts_of(first)
        return share2, back1, back2, share3


def _top(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def learns(id_col: str = "doc_id") -> Column:
    return ~held_out(id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept away from learning: crc32 of the id as text leaves 2 on division by 7."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 7 == 2


def _coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different lower-cased words, codes into them, and words per text."""
    lower = pa.array([t.lower() for t in as_bytes(column).to_pylist()], pa.large_binary())
    words, rows = split_words(lower.cast(pa.large_string()))
    coded = words.dictionary_encode()
    kinds = coded.dictionary.cast(pa.large_binary()).to_pylist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w, _SEED) for w in kinds], dtype=np.uint64)
    counts = np.bincount(rows, minlength=len(column))
    return hashes, np.asarray(coded.indices, dtype=np.int64), counts


def _sequence(codes: np.ndarray, counts: np.ndarray, end: int, start: int):
    """All texts in a row, each with a start before and an end after; and end places."""
    size = counts + 2
    ends = np.cumsum(size) - 1
    out = np.empty(int(size.sum()), dtype=np.int64)
    inner = np.ones(len(out), dtype=bool)
    inner[ends] = False
    inner[ends - counts - 1] = False
    out[inner] = codes
    out[ends], out[ends - counts - 1] = end, start
    return out, ends


# ---- training --------------------------------------------------------------------------


def _runs(df: DataFrame, make) -> DataFrame:
    """Rows (part, run): what ``make(texts)`` gives for each piece of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in pieces(batch.column(0), _PIECE):
                parts, blobs = make(batch.column(0).slice(start, stop - start))
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array(parts, pa.int64()), "run": pa.array(blobs, pa.binary())}
                )

    return df.select("__text").mapInArrow(run, "part long, run binary")


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers; the first never falls and goes as differences."""
    steps = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    data = steps.tobytes() + b"".join(c.tobytes() for c in columns[1:])
    return len(steps).to_bytes(4, "little") + bytes(pa.compress(data, "zstd", asbytes=True))


def _unpacked(run: bytes, *kinds: str) -> list[np.ndarray]:
    n = int.from_bytes(run[:4], "little")
    size = n * sum(np.dtype(k).itemsize for k in kinds)
    data = pa.decompress(run[4:], size, "zstd", asbytes=True)
    out, at = [], 0
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return [np.cumsum(out[0], dtype=kinds[0]), *out[1:]]


def _merged(runs: DataFrame, pieces_about: int, merge, finish, columns: str) -> DataFrame:
    """``finish(part, runs)`` for each part, after salted rounds of ``merge(runs)``."""

    def combine(table: pa.Table) -> pa.Table:
        part, blobs = table.column("part")[0].as_py(), table.column("run").to_pylist()
        return pa.table({"part": pa.array([part], pa.int64()), "run": pa.array([merge(blobs)], pa.binary())})

    def end(table: pa.Table) -> pa.Table:
        return finish(table.column("part")[0].as_py(), table.column("run").to_pylist())

    salts = 1 + pieces_about // MERGED_RUNS
    if salts > 1:
        salt = F.pmod(F.xxhash64("run"), F.lit(salts))
        runs = runs.withColumn("salt", salt).groupBy("part", "salt").applyInArrow(
            combine, "part long, run binary"
        )
    return runs.groupBy("part").applyInArrow(end, columns)


_WORD_KINDS = ("<u8", "<u4")
_GRAM_KINDS = ("<i8", "<i4", "<u4")


def _merge_words(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = map(np.concatenate, zip(*(_unpacked(r, *_WORD_KINDS) for r in runs)))
    kinds, at = np.unique(hashes, return_inverse=True)
    return kinds, np.bincount(at, counts, len(kinds)).astype(np.int64)


def _merge_grams(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pair, third, count = map(np.concatenate, zip(*(_unpacked(r, *_GRAM_KINDS) for r in runs)))
    order = np.lexsort((third, pair))
    pair, third, count = pair[order], third[order], count[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (third[1:] != third[:-1])])
    return pair[first], third[first], np.add.reduceat(count, first)


def _cut_runs(part: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[bytes]]:
    """One packed run for each value of ``part``, which never falls."""
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    stops = [*starts[1:].tolist(), len(part)]
    blobs = [_packed(*(c[a:b] for c in columns)) for a, b in zip(starts.tolist(), stops)]
    return part[starts].tolist(), blobs


def _write_vocabulary(texts: DataFrame, folder: str, bits: int, pieces_about: int) -> DataFrame:
    """One file of words and counts for each value of the hashes' leading bits."""

    def make(column: pa.Array):
        hashes, codes, counts = _coded(column)
        hashes = np.r_[hashes, _END]
        count = np.r_[np.bincount(codes, minlength=len(hashes) - 1), len(counts)]
        order = np.argsort(hashes)
        return _cut_runs(_top(hashes[order], bits), hashes[order], count[order].astype("<u4"))

    def finish(part: int, runs: list[bytes]) -> pa.Table:
        hashes, counts = _merge_words(runs)
        path = f"{folder}/words-{part}"
        small = counts.max() < 1 << 32
        write_arrays(path, {"hash": hashes, "count": counts.astype(np.uint32) if small else counts})
        ends = int(counts[hashes == _END].sum())
        return pa.table(
            {"part": [part], "words": [len(hashes)], "tokens": [int(counts.sum())], "ends": [ends], "path": [path]}
        )

    def merge(runs: list[bytes]) -> bytes:
        hashes, counts = _merge_words(runs)
        return _packed(hashes, counts.astype("<u4"))

    columns = "part long, words long, tokens long, ends long, path string"
    return store(_merged(_runs(texts, make), pieces_about, merge, finish, columns), "lm-words")


def _grams(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and the word after each, over all texts.

    The third is -1 for the pair of a last word and the end, which nothing follows.
    """
    hashes, codes, counts = _coded(column)
    number, _ = model.numbers(np.r_[hashes, _END])
    flow, ends = _sequence(number[codes], counts, number[-1], model.words)
    pair = flow[:-1] << 32 | flow[1:]
    third = np.full(len(pair), -1, dtype=np.int64)
    third[:-1] = flow[2:]
    third[ends - 1] = -1
    between = np.ones(len(pair), dtype=bool)
    between[ends[:-1]] = False  # from one text's end to the next one's start
    return pair[between], third[between]


def _gram_runs(texts: DataFrame, model: Model, bounds: np.ndarray) -> DataFrame:
    def make(column: pa.Array):
        pair, third = _grams(column, model)
        kinds, at = np.unique(pair, return_inverse=True)
        keys, count = np.unique(at << 32 | (third + 1), return_counts=True)
        pair = kinds[keys >> 32]
        third = (keys & 0xFFFFFFFF) - 1
        return _cut_runs(
            np.searchsorted(bounds, pair), pair, third.astype("<i4"), count.astype("<u4")
        )

    return _runs(texts, make)


def _bounds(texts: DataFrame, model: Model, parts: int) -> np.ndarray:
    """Pairs at equal steps of a sixty-fourth of the texts; they only set file sizes."""
    if parts < 2:
        return np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in pieces(batch.column(0), _PIECE):
                pair, _ = _grams(batch.column(0).slice(start, stop - start), model)
                yield pa.RecordBatch.from_pydict({"pair": pa.array(np.unique(pair))})

    some = texts.where(F.pmod(F.xxhash64("__text"), F.lit(64)) == 0)
    shares = [i / parts for i in range(1, parts)]
    found = some.mapInArrow(run, "pair long").agg(F.percentile_approx("pair", shares, 10_000)).first()[0]
    return np.unique(np.array(found or [], dtype=np.int64))


def trie_arrays(pair: np.ndarray, third: np.ndarray, count: np.ndarray, model: Model):
    """The levels of one file from sorted, different grams."""
    fresh = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    pairs = pair[fresh]
    total = np.add.reduceat(count, fresh)
    inner = third >= 0
    kinds = np.add.reduceat(inner.astype(np.int64), fresh)
    first, starts = np.unique(pairs >> 32, return_index=True)
    first_count = model.counts_of(first)
    kinds1 = np.diff(np.r_[starts, len(pairs)])
    d, width = model.discount, (model.words + 1).bit_length()
    owner = np.repeat(np.arange(len(first)), kinds1)
    parent = np.repeat(np.arange(len(pairs)), np.diff(np.r_[fresh, len(pair)]))
    levels = {
        "first": first,
        "width": np.array([width], dtype=np.uint32),
        "second": pack(pairs & 0xFFFFFFFF, width),
        "third": pack(third[inner], width),
    }
    levels |= quantise("back1", d * kinds1 / first_count)
    levels |= quantise("share2", (total - d) / first_count[owner])
    # A pair that ends a text is no context: its weight is 1.
    levels |= quantise("back2", np.where(kinds > 0, d * kinds / total, 1.0))
    if inner.any():
        levels |= quantise("share3", ((count - d) / total[parent])[inner])
    else:
        levels |= quantise("share3", np.ones(1))
    for name, pointers in (
        ("p2", np.r_[starts, len(pairs)]),
        ("p3", np.r_[0, np.cumsum(kinds)]),
    ):
        levels |= {name + k: v for k, v in elias_fano(pointers).items()}
    return levels, (int(first[0]), int(kinds1[0]), int(first[-1]), int(kinds1[-1]), int(pairs[-1]))


def _write_tries(runs: DataFrame, folder: str, model: Model, pieces_about: int) -> DataFrame:
    """A trie file for each part; a row with its path and ends."""

    def merge(blobs: list[bytes]) -> bytes:
        pair, third, count = _merge_grams(blobs)
        return _packed(pair, third.astype("<i4"), count.astype("<u4"))

    def finish(part: int, blobs: list[bytes]) -> pa.Table:
        pair, third, count = _merge_grams(blobs)
        path = f"{folder}/grams-{part}"
        levels, ends = trie_arrays(pair, third, count, model)
        write_arrays(path, levels)
        names = ("first", "first_kinds", "last", "last_kinds", "last_pair")
        return pa.table({"path": [path], **{n: [v] for n, v in zip(names, ends)}})

    columns = "path string, first long, first_kinds long, last long, last_kinds long, last_pair long"
    return store(_merged(runs, pieces_about, merge, finish, columns), "lm-grams")


def train(
    df: DataFrame,
    text_col: str = "text",
    discount: float = DISCOUNT,
    file_grams: int = FILE_GRAMS,
    file_words: int = FILE_WORDS,
) -> Model:
    """Count the texts of ``df`` and write the model's files under the shared folder."""
    folder = scratch_path(df.sparkSession, "lm")
    texts = df.select(F.col(text_col).alias("__text"))
    size = texts.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    pieces_about = size // _PIECE
    bits = int(size // 6 // file_words).bit_length()
    written = {r["part"]: r for r in _write_vocabulary(texts, folder, bits, pieces_about).collect()}
    if not written:
        return Model(discount=discount)
    shards = range(1 << bits)
    held = [written[s]["words"] if s in written else 0 for s in shards]
    model = Model(
        tokens=sum(r["tokens"] for r in written.values()),
        words=sum(held),
        texts=sum(r["ends"] for r in written.values()),
        discount=discount,
        vocabulary_bits=bits,
        vocabulary_files=[written[s]["path"] if s in written else "" for s in shards],
        vocabulary_starts=np.cumsum([0, *held])[:-1],
    )
    bounds = _bounds(texts, model, 1 + model.tokens // file_grams)
    tries = _write_tries(_gram_runs(texts, model, bounds), folder, model, pieces_about)
    rows = sorted(tries.collect(), key=lambda r: r["last_pair"])
    model.trie_files = [r["path"] for r in rows]
    model.trie_last = np.array([r["last_pair"] for r in rows], dtype=np.int64)
    kinds: dict[int, list[int]] = {}
    for r in rows:
        kinds.setdefault(r["first"], []).append(r["first_kinds"])
        if r["last"] != r["first"]:
            kinds.setdefault(r["last"], []).append(r["last_kinds"])
    model.split_kinds = {word: sum(n) for word, n in kinds.items() if len(n) > 1}
    return model


# ---- scoring ---------------------------------------------------------------------------


def score_texts(column: pa.Array, model: Model) -> dict[str, pa.Array]:
    """Token counts and log10 probabilities of every text of a string array."""
    hashes, codes, counts = _coded(column)
    number, count = model.numbers(np.r_[hashes, _END])
    end = len(hashes)
    flow, ends = _sequence(codes, counts, end, end + 1)
    row = np.repeat(np.arange(len(counts)), counts + 2)
    ids = np.r_[number, model.words][flow]
    real = flow <= end
    uses = np.r_[count, 0][flow]
    p1 = model.unigram(uses)
    p = p1.copy()
    if model.trie_files:
        pair = ids[:-1] << 32 | ids[1:]  # the pair that ends at each place but the first
        kinds, at = np.unique(pair, return_inverse=True)
        triple = at[:-1] << 32 | ids[2:]
        triples, which = np.unique(triple, return_inverse=True)
        share2, back1, back2, share3 = model.lookup(kinds, triples & 0xFFFFFFFF, triples >> 32)
        known = np.r_[count > 0, model.texts > 0][flow]
        p2 = p1.copy()
        p2[1:] = np.where(known[:-1], share2[at] + back1[at] * p1[1:], p1[1:])
        p = p2.copy()
        # The place after a start has no pair before it within its text.
        inside = real[1:-1] | (flow[1:-1] == end + 1)
        third = np.where(
            inside & (row[2:] == row[:-2]), share3[which] + back2[at[:-1]] * p2[2:], p2[2:]
        )
        p[2:] = third
    n = len(counts)

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(row[real], values[real], minlength=n)

    return {
        "n_tokens": pa.array((counts + 1).astype(np.int64)),
        "n_known": pa.array(per_text((uses > 0).astype(np.float64)).astype(np.int64)),
        "base_score": pa.array(per_text(np.log10(p1))),
        "score": pa.array(per_text(np.log10(p))),
    }


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of every row."""
    named = df.select(F.col(text_col).alias("__text"), F.col(id_col).alias("doc_id"))
    added = "n_tokens long, n_known long, base_score double, score double"
    schema = StructType([named.schema["doc_id"]] + StructType.fromDDL(added).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in pieces(batch.column(0), _PIECE):
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column(1), **score_texts(part.column(0), model)}
                )

    return named.mapInArrow(run, schema)
