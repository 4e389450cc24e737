from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections import Counter, defaultdict

import pytest
import zstandard

from cpgspark.llm import warc


def b32(text: str | None) -> str:
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


PAGES = "page_id long, url string, html string, sha1 string, turn string, payload string"


def pages(spark):
    rows = [
        (1, "http://a/1", "same"),
        (2, "http://a/2", "same"),
        (3, None, "same"),
        (3, None, "same"),
        (4, "http://a/\r\n4 é", None),
        (5, "http://a/5", ""),
        (None, "http://a/n", "alone without id"),
        (None, "http://a/n", "two without id"),
        (None, "http://a/m", "two without id"),
        (6, "http://a/6", "\r\n\r\nWARC/1.1\r\n" * 5000),
        (7, "http://a/7", "ß" * 300_000),
    ] + [(100 + i, f"http://hot/{i}", "a page that many hosts copy " * 40) for i in range(500)]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES).repartition(4)


def test_pages_round_trip(spark):
    frame = pages(spark)
    source = frame.collect()
    rows = warc.archived_pages(frame).collect()
    groups = defaultdict(list)
    for r in source:
        groups[r.html or ""].append(r.page_id)
    last = {h: max((i for i in ids if i is not None), default=None) for h, ids in groups.items()}
    assert len(rows) == len(source)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in rows) == Counter(
        (r.page_id, len((r.html or "").encode()), b32(r.html)) for r in source
    )
    by_digest = {b32(h): i for h, i in last.items()}
    responses = Counter(r.payload_digest for r in rows if r.record_type == "response")
    assert responses == Counter({d: 1 for d in by_digest})
    for r in rows:
        if r.record_type == "response":
            assert r.page_id == by_digest[r.payload_digest] and r.refers_to is None
        else:
            assert r.record_type == "revisit" and r.refers_to == by_digest[r.payload_digest]


def test_payloads_and_headers_come_back(spark):
    frame = pages(spark)
    folder = warc.write_pages(frame)
    rows = warc.read_records(spark, folder).collect()
    texts = {b32(r.html): (r.html or "").encode() for r in frame.collect()}
    for r in rows:
        if r.record_type == "response":
            assert bytes(r.payload) == texts[r.payload_digest]
        assert r.target_uri is None or not set(r.target_uri) & set("\r\n ")


def test_empty_table(spark):
    assert warc.archived_pages(spark.createDataFrame([], PAGES)).count() == 0


def records(n: int) -> list[bytes]:
    bodies = [f"<html>body number {i} with words in common</html>".encode() * 3 for i in range(n)]
    return [
        warc.record(f"urn:page:{i}:x:1", "response", "http://a", None, b, len(b), warc.base32_sha1(b))
        for i, b in enumerate(bodies)
    ]


@pytest.mark.parametrize("count", [1, 3000])
def test_archive_has_its_dictionary_and_one_frame_a_record(count):
    out = io.BytesIO()
    items = records(count)
    assert warc.write_archive(out, items) == count
    data = out.getvalue()
    if count > 1:
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        book = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        first = zstandard.ZstdDecompressor(dict_data=book).decompressobj()
        assert first.decompress(data[8 + size :]) == items[0]
    assert list(warc.read_archive(io.BytesIO(data))) == items


def test_packed_dictionary_is_read():
    out = io.BytesIO()
    items = records(3000)
    warc.write_archive(out, items)
    data = out.getvalue()
    size = struct.unpack("<I", data[4:8])[0]
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + size])
    again = struct.pack("<II", 0x184D2A5D, len(packed)) + packed + data[8 + size :]
    assert list(warc.read_archive(io.BytesIO(again))) == items


def test_faults_are_found():
    good = records(1)[0]
    warc.parse_record(good)
    for bad in (
        good.replace(b"WARC/1.1", b"WARC/9"),
        good.replace(b"Content-Length: ", b"Content-Length: 1", 1),
        good[:-2],
        good.replace(b"words in common", b"words in commoN"),
        good.replace(b"WARC-Type: response\r\n", b""),
        good.replace(b"WARC-Date", b"no colon here\r\nWARC-Date"),
    ):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    out = io.BytesIO()
    warc.write_archive(out, records(10))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.read_archive(io.BytesIO(out.getvalue()[:-5])))
