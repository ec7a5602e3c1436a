import base64
import hashlib
import struct
import uuid

import pytest
import zstandard

from sitefacts.llm import queries, warc


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, first long, sha string")


def test_round_trip(spark, folder):
    long = "<p>ünï</p>" * 100_000
    rows = [(1, "http://a/1", "<p>x</p>"), (5, None, "<p>x</p>"), (3, "http://a/3", None), (4, "u", ""), (9, "u\r\nX: y", long),
            (None, "u", "<p>x</p>"), (None, "u", "<p>z</p>"), (7, "u", "two"), (7, "u", "two"), (7, "u", "other")]
    warc.archive_pages(pages(spark, rows), folder)
    records = warc.read_archives(spark, folder).collect()
    assert len(records) == len(rows) and not any(r.error for r in records)
    full = {r.record_id: r for r in records if r.record_type == "response"}
    assert bytes(full["urn:page:9"].payload).decode() == long and full["urn:page:9"].target_uri == "u X: y"
    found = {}
    for r in warc.resolve_revisits(warc.read_archives(spark, folder, with_payload=False)).collect():
        found.setdefault(r.record_id, []).append((r.record_type, r.payload_bytes, r.payload_digest, r.refers_to))
    sha = base64.b32encode(hashlib.sha1(b"<p>x</p>").digest()).decode()
    assert found["urn:page:1"] == [("response", 8, sha, None)]
    assert found["urn:page:5"] == [("revisit", 8, sha, "urn:page:1")]
    assert found["urn:page:4"][0][0] == "revisit" and found["urn:page:4"][0][3] == "urn:page:3"
    assert [k[0] for k in found["urn:page:7"]] == ["response"] * 3
    assert sorted(k[0] for k in found["urn:page:null"]) == ["response", "revisit"]


def test_layout(spark, folder):
    warc.archive_pages(pages(spark, [(k, "u", f"<p>{k}</p>" * 50) for k in range(40)]).coalesce(1), folder)
    raw = [bytes(r.content) for r in spark.read.format("binaryFile").load(folder).collect()]
    for data in raw:
        magic, size = struct.unpack("<II", data[:8])
        assert magic == warc.DICTIONARY_FRAME
        dictionary = warc.load_dictionary(data[8 : 8 + size])
        rest, count = data[8 + size :], 0
        while rest:
            if struct.unpack("<I", rest[:4])[0] in warc.SKIPPABLE:
                rest = rest[8 + struct.unpack("<I", rest[4:8])[0] :]
                continue
            one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            assert one.decompress(rest).startswith(b"WARC/1.1\r\n")
            rest, count = one.unused_data, count + 1
        assert count


def test_broken_archives():
    good = warc.record_bytes({"WARC-Type": "resource", "WARC-Record-ID": "<urn:x>", "WARC-Date": "2025"}, b"abc")
    assert warc.parse_record(good).payload == b"abc"
    for bad in (good[:-1], good.replace(b"Length: 3", b"Length: 4"), good.replace(b"WARC/1.1", b"HTTP/1.1"),
                good.replace(b"WARC-Date", b"Else"), good.replace(b"Length: 3", b"Length: x"), b""):
        with pytest.raises(warc.ArchiveError):
            warc.parse_record(bad)
    frame = zstandard.ZstdCompressor().compress(good)
    assert list(warc.frames(frame + frame)) == [good, good] and list(warc.frames(b"")) == []
    for bad in (frame[:-3], frame + b"x", frame + b"abcdefgh", struct.pack("<II", 0x184D2A5D, 99)):
        with pytest.raises(warc.ArchiveError):
            list(warc.frames(bad))


def test_compressed_dictionary():
    data = b"some words that pages share " * 40
    assert warc.load_dictionary(zstandard.ZstdCompressor().compress(data)).as_bytes() == data


def test_no_pages(spark, folder):
    warc.archive_pages(pages(spark, []), folder)
    assert warc.read_archives(spark, folder).count() == 0


def test_query(spark, testdata):
    rows = spark.read.parquet(f"{testdata}/pages.parquet").collect()
    want = {}
    for r in sorted(rows, key=lambda r: r.page_id):
        raw = (r.html or "").encode()
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want[r.page_id] = (len(raw), sha)
    got = queries.op1_warc(spark, testdata).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in got} == want
    first = {}
    for page, (_, sha) in sorted(want.items()):
        first.setdefault(sha, page)
    for r in got:
        assert (r.record_type == "response") == (first[r.payload_digest] == r.page_id)
        assert r.refers_to == (None if r.record_type == "response" else first[r.payload_digest])
