"""WARC archives in Zstandard: written by tasks, read back record by record.

An archive begins with a skippable frame that holds the compression dictionary; every
record is one frame of its own after it.  Of records with equal payloads that with the
largest id is the response and the others revisit it.

Each task writes one archive under the shared folder: to a name of its attempt first, then
renamed to the name of its partition, so a task that runs again replaces its own file.
The reader streams an archive in chunks and holds one record at a time; it checks the
frame checksum, the record's version line, its declared length, its end and its digests,
and raises on the first that fails.  Archives are reached through Arrow's file systems
(local, HDFS, S3, GCS), as tasks have no Spark reader inside.

Defined cases: a null payload is empty; equal rows make one response and revisits of it; a
null id sorts below all others; a null address leaves out the header; control characters
in an address are percent-encoded; an empty table writes no archive and reads as no rows;
an archive too small to learn a dictionary from has none.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cpgspark.plans.durable import scratch_path, store

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DATE = "1970-01-01T00:00:00Z"
#: Record bytes per archive before packing, and what the dictionary is learned from and may hold.
ARCHIVE_BYTES = 64 << 20
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 32 << 10
_CHUNK = 1 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- records -------------------------------------------------------------------------


def record(
    record_id: str, kind: str, uri: str | None, refers_to: str | None, payload: bytes,
    payload_bytes: int, payload_digest: str,
) -> bytes:
    """One record; a revisit has the head of its response and no payload."""
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {payload_bytes}\r\n\r\n"
    ).encode()
    block = head + (payload if kind == "response" else b"")
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if uri is not None:
        lines.append("WARC-Target-URI: " + quote(uri, safe="!#$%&'()*+,/:;=?@[]~"))
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    named = b"\r\n".join([VERSION, *(x.encode() for x in lines)])
    return named + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict[str, object]:
    """Headers and payload of one record; ValueError if anything does not hold."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (VERSION, b"WARC/1.0"):
        raise ValueError("no WARC version line, or headers without end")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"header without a name: {line[:80]!r}")
        headers[name.decode().strip().lower()] = value.decode().strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"header missing: {name}")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, declared {length}")
    block = rest[:length]
    if (declared := headers.get("warc-block-digest")) and declared != f"sha1:{base32_sha1(block)}":
        raise ValueError("block digest differs")
    kind = headers["warc-type"]
    found: dict[str, object] = {
        "record_id": headers["warc-record-id"].strip("<>"),
        "record_type": kind,
        "target_uri": headers.get("warc-target-uri"),
        "refers_to_id": (headers.get("warc-refers-to") or "").strip("<>") or None,
        "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "payload_bytes": None,
        "payload": None,
    }
    if not headers.get("content-type", "").startswith("application/http"):
        return found | {"payload": block, "payload_bytes": length}
    http, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ValueError("block is not an HTTP message")
    for line in http.split(b"\r\n")[1:]:
        if line.lower().startswith(b"content-length:"):
            found["payload_bytes"] = int(line.split(b":")[1])
    if kind == "response":
        if found["payload_bytes"] not in (None, len(body)):
            raise ValueError(f"payload of {len(body)} bytes, declared {found['payload_bytes']}")
        if found["payload_digest"] not in (None, base32_sha1(body)):
            raise ValueError("payload digest differs")
        found |= {"payload": body, "payload_bytes": len(body)}
    return found


# ---- archives ------------------------------------------------------------------------


def learn_dictionary(samples: list[bytes]) -> bytes | None:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples
        return None


def write_archive(out, records: Iterable[bytes]) -> int:
    """Write records to an open file: dictionary frame, then one frame each."""
    held, size = [], 0
    source = iter(records)
    for item in source:
        held.append(item)
        size += len(item)
        if size >= SAMPLE_BYTES:
            break
    dictionary = learn_dictionary(held)
    if dictionary:
        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
    packer = zstandard.ZstdCompressor(
        write_checksum=True,
        write_content_size=True,
        dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None,
    )
    count = 0
    for some in (held, source):
        for item in some:
            out.write(packer.compress(item))
            count += 1
    return count


def read_archive(source) -> Iterator[bytes]:
    """Records of an open archive, one at a time."""
    pending = source.read(8)
    dictionary = None
    if len(pending) == 8 and struct.unpack("<I", pending[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", pending[4:])[0]
        raw = source.read(size)
        if len(raw) != size:
            raise ValueError("dictionary frame cut short")
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
        pending = b""
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        pending = pending or source.read(_CHUNK)
        if not pending:
            return
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if not pending and not (pending := source.read(_CHUNK)):
                raise ValueError("record frame cut short")
            parts.append(frame.decompress(pending))
            pending = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_records(records: DataFrame, folder: str) -> DataFrame:
    """Write records into archives; one row per file: path and records.

    Needs ``record_id``, ``record_type``, ``target_uri``, ``refers_to_id``, ``payload``,
    ``payload_bytes`` and ``sha1`` (hexadecimal).  Every partition becomes one archive, or
    more of :data:`ARCHIVE_BYTES`.  The files exist once this returns.
    """
    columns = (
        "record_id", "record_type", "target_uri", "refers_to_id", "payload", "payload_bytes", "sha1"
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for start in range(batch.num_rows):
                item = {name: batch.column(i)[start].as_py() for i, name in enumerate(columns)}
                digest = base64.b32encode(bytes.fromhex(item.pop("sha1"))).decode()
                yield record(
                    item["record_id"], item["record_type"], item["target_uri"],
                    item["refers_to_id"], item["payload"] or b"", item["payload_bytes"], digest,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        source, file = rows(batches), 0
        while (first := next(source, None)) is not None:
            system, base = _open(folder)
            system.create_dir(base, recursive=True)
            name = f"{base}/part-{context.partitionId():05d}-{file:04d}.warc.zst"
            own = f"{name}.{context.taskAttemptId()}"
            with system.open_output_stream(own, compression=None) as out:
                count = write_archive(out, _up_to(first, source))
            system.move(own, name)
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [count]})
            file += 1

    return store(records.select(*columns).mapInArrow(run, "path string, records long"), "warc-written")


def _up_to(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    """Records until an archive is full."""
    size, item = 0, first
    while item is not None:
        yield item
        size += len(item)
        item = next(rest, None) if size < ARCHIVE_BYTES else None


RECORD = (
    "record_id string, record_type string, target_uri string, refers_to_id string, "
    "payload_digest string, payload_bytes long, payload binary"
)


def read_records(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """All records of the archives in a folder, checked; a task takes whole archives."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.warc.zst")
        .load(folder)
        .select("path")
    )
    names = [c.split()[0] for c in RECORD.split(", ")]
    if not payload:
        names.remove("payload")
    schema = ", ".join(c for c in RECORD.split(", ") if c.split()[0] in names)
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}

    def batch_of(held: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {n: pa.array([x[n] for x in held], kinds.get(n, pa.string())) for n in names}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = _open(path)
                held, size = [], 0
                with system.open_input_stream(name, compression=None) as source:
                    for at, data in enumerate(read_archive(source)):
                        try:
                            held.append(parse_record(data))
                        except ValueError as error:
                            raise ValueError(f"{path}, record {at}: {error}") from error
                        size += len(data)
                        if size > 4 * _CHUNK:
                            yield batch_of(held)
                            held, size = [], 0
                if held:
                    yield batch_of(held)

    return files.mapInArrow(run, schema)


# ---- pages ---------------------------------------------------------------------------


def page_records(
    df: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """Records of a page table with responses and revisits decided.

    Equal payloads meet only in a maximum over digests.  Digests that occur once drop out,
    so pages are joined with those of copies alone; hot keys of the join are split by
    adaptive execution, and the payload is dropped from revisits after it.
    """
    pages = df.select(
        F.col(id_col).alias("page"),
        F.col(uri_col).cast("string").alias("target_uri"),
        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    # A null id counts as the smallest and prints as "-".
    latest = store(
        pages.groupBy("sha1", "page")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("sha1")
        .agg(
            F.max("page").alias("last"),
            F.sum("n").alias("copies"),
            F.coalesce(F.max_by("n", "page"), F.sum("n")).alias("ties"),
        )
        .where("copies > 1")
        .withColumnRenamed("sha1", "same"),
        "warc-copies",
    )
    joined = pages.join(latest, F.col("sha1") == F.col("same"), "left").withColumn(
        "first", F.col("same").isNull() | F.col("page").eqNullSafe(F.col("last"))
    ).withColumn("turn", F.lit(1))
    if latest.where("ties > 1").head(1):
        # Rows equal in id and payload: one of them responds.
        tied = F.col("first") & (F.coalesce("ties", F.lit(1)) > 1)
        order = Window.partitionBy("sha1").orderBy("target_uri")
        turns = joined.where(tied).withColumn("turn", F.row_number().over(order))
        joined = joined.where(~tied).unionByName(turns.withColumn("first", F.col("turn") == 1))

    def name(page: str, turn: Column) -> Column:
        return F.concat(
            F.lit("urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("-")),
            F.lit(":"), F.col("sha1"), F.lit(":"), turn.cast("string"),
        )

    return joined.select(
        name("page", F.col("turn")).alias("record_id"),
        F.when(F.col("first"), "response").otherwise("revisit").alias("record_type"),
        "target_uri",
        F.when(~F.col("first"), name("last", F.lit(1))).alias("refers_to_id"),
        F.when(F.col("first"), F.col("payload")).alias("payload"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "sha1",
    )


def write_pages(df: DataFrame, payload_col: str = "html", **columns: str) -> str:
    """Write a page table as archives in a new folder of the shared place; its path.

    An empty table writes none and gives an empty path.
    """
    folder = scratch_path(df.sparkSession, "warc")
    written = write_records(page_records(df, payload_col=payload_col, **columns), folder)
    return folder if written.head(1) else ""


def page_of(record_id: str):
    """The page id inside a record id; null for a null one or for "-"."""
    text = F.regexp_extract(record_id, r"^urn:page:([^:]*):", 1)
    return F.when(text.isin("", "-"), None).otherwise(text).cast("long")


def archived_pages(df: DataFrame) -> DataFrame:
    """Write ``page_id``, ``url`` and ``html`` as archives and read them back."""
    folder = write_pages(df)
    if not folder:
        empty = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
        return df.sparkSession.createDataFrame([], empty)
    return read_records(df.sparkSession, folder, payload=False).select(
        page_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_of("refers_to_id").alias("refers_to"),
    )
