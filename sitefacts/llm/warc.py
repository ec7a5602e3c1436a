"""WARC archives with one Zstandard frame per record.

An archive begins with a skippable frame that holds the dictionary; every record after it is a frame of
its own, so records can be cut out and decoded alone. Archives are written by Spark's text sink, a row
per frame, and thereby committed task by task; between rows the sink puts an empty skippable frame,
which decoders pass over. They are read whole, one archive per row, and decoded record by record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of the dictionary's skippable frame, of other skippable frames, of frames, of dictionaries (fixed values).
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME = 0xFD2FB528
DICTIONARY = 0xEC30A437
#: An empty skippable frame, all of it ASCII, so it can be the sink's line separator.
GAP = "P*M\x18\x00\x00\x00\x00"
VERSION = b"WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
_RECORD = (
    "archive string, record_no long, record_id string, record_type string, target_uri string, "
    "payload_digest string, refers_to string, payload binary, error string"
)


class ArchiveError(ValueError):
    pass


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(headers: dict[str, str], payload: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers.items()), f"Content-Length: {len(payload)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + payload + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes


def parse_record(raw: bytes) -> Record:
    """Check version, header lines, needed headers, length, closing lines and payload digest."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", VERSION):
        raise ArchiveError("no WARC header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise ArchiveError(f"bad header line {line[:60]!r}")
        headers[name.decode()] = value.strip().decode()
    if missing := [h for h in _NEEDED if h not in headers]:
        raise ArchiveError(f"missing {', '.join(missing)}")
    if not headers["Content-Length"].isdigit():
        raise ArchiveError("bad Content-Length")
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ArchiveError(f"Content-Length is {size}, the record holds {len(rest) - 4} bytes")
    payload = rest[:size]
    if headers.get("Content-Type", "").startswith("application/http"):
        _, gap, payload = payload.partition(b"\r\n\r\n")
        if not gap:
            raise ArchiveError("no HTTP header")
    block = headers.get("WARC-Payload-Digest", "")
    if headers["WARC-Type"] != "revisit" and block.startswith("sha1:") and block[5:] != digest(payload):
        raise ArchiveError("payload digest differs")
    return Record(headers, payload)


def load_dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    """Dictionary bytes as they stand in the skippable frame: plain, or compressed as a frame."""
    if len(data) >= 4 and struct.unpack("<I", data[:4])[0] == FRAME:
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    trained = len(data) >= 4 and struct.unpack("<I", data[:4])[0] == DICTIONARY
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind)


def frames(data: bytes) -> Iterator[bytes]:
    """Content of each frame of an archive, in order; raises where the bytes end early or are none."""
    at, decoder = 0, None
    view = memoryview(data)
    while at < len(data):
        if at + 4 > len(data):
            raise ArchiveError("trailing bytes")
        magic = struct.unpack_from("<I", data, at)[0]
        if magic in SKIPPABLE:
            if at + 8 > len(data):
                raise ArchiveError("cut skippable frame")
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
            if end > len(data):
                raise ArchiveError("cut skippable frame")
            if at == 0 and magic == DICTIONARY_FRAME:
                decoder = zstandard.ZstdDecompressor(dict_data=load_dictionary(data[8:end]))
            at = end
            continue
        if magic != FRAME:
            raise ArchiveError(f"no frame at byte {at}")
        one = (decoder or zstandard.ZstdDecompressor()).decompressobj()
        parts = []
        step = 1 << 16
        while not one.eof and at < len(data):
            piece = view[at : at + step]
            parts.append(one.decompress(piece))
            at += len(piece)
        if not one.eof:
            raise ArchiveError("cut frame")
        at -= len(one.unused_data)
        yield b"".join(parts)


def train_dictionary(pages: DataFrame, payload: str, sample: int = 200, size: int = 32768) -> bytes:
    """Dictionary of ``size`` bytes from the payloads of at most ``sample`` rows, 64 KB of each.

    It only serves compression: records come back the same with any dictionary. Where the rows are
    too few or too alike to train one, their bytes are the dictionary.
    """
    rows = pages.select(F.substring(payload, 1, 65536).alias("p")).filter(F.length("p") > 0).limit(sample).collect()
    samples = [bytes(r.p) for r in rows]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or VERSION


def write_archives(
    records: DataFrame, path: str, dictionary: bytes, date: str = "2025-01-01T00:00:00Z", level: int = 3
) -> None:
    """Write rows (record_id, record_type, target_uri, refers_to, payload) as archives.

    One archive per partition, in the row order of the partition. Revisits carry the digest of their
    payload, not the payload. A null payload is empty, null ``target_uri`` and ``refers_to`` leave
    their headers out; line breaks in headers become blanks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=level, dict_data=load_dictionary(dictionary))
        first = True
        for batch in batches:
            out = []
            if first and len(batch):
                out.append(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
                first = False
            columns = ("record_id", "record_type", "target_uri", "refers_to", "payload")
            for rid, kind, uri, refers, payload in zip(*(batch[c] for c in columns), strict=True):
                payload = bytes(payload or b"")
                headers = {
                    "WARC-Type": kind, "WARC-Record-ID": f"<{rid}>", "WARC-Date": date, "WARC-Target-URI": uri,
                    "WARC-Payload-Digest": f"sha1:{digest(payload)}", "WARC-Refers-To": refers and f"<{refers}>",
                }
                if kind == "revisit":
                    headers["WARC-Profile"] = IDENTICAL
                    block = b""
                else:
                    headers["Content-Type"] = HTTP
                    block = HTTP_HEAD % len(payload) + payload
                kept = {k: " ".join(v.splitlines()) for k, v in headers.items() if v is not None}
                out.append(packer.compress(record_bytes(kept, block)))
            yield pd.DataFrame({"value": out})

    written = records.mapInPandas(run, "value binary")
    written.select(F.col("value").cast("string").alias("value")).write.option("lineSep", GAP).text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of all archives under ``path``, one row each, checked; see ``_RECORD`` for the columns.

    A record that fails its checks is a row with ``error`` and the reader goes on with the next frame;
    where the bytes themselves are broken, one last row of the archive holds the error. An archive is
    one row of Spark's binary reader, so it may hold up to 2 GB; its records are decoded one by one.
    With ``with_payload=False`` payloads are checked, and only their length is kept (payload_bytes).
    """

    def rows(name: str, content: bytes) -> Iterator[tuple]:
        number = 0
        try:
            for number, raw in enumerate(frames(content)):
                try:
                    r = parse_record(raw)
                except (ArchiveError, UnicodeDecodeError) as problem:
                    yield (name, number, None, None, None, None, None, None, None, str(problem))
                    continue
                h = r.headers
                ids = [(h.get(k) or "").strip("<>") or None for k in ("WARC-Record-ID", "WARC-Refers-To")]
                sha = h.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
                payload = r.payload if with_payload else None
                yield (name, number, ids[0], h["WARC-Type"], h.get("WARC-Target-URI"), sha, ids[1], payload, len(r.payload), None)
        except (ArchiveError, zstandard.ZstdError) as problem:
            yield (name, number, None, None, None, None, None, None, None, str(problem))

    names = "archive record_no record_id record_type target_uri payload_digest refers_to payload payload_bytes error".split()
    schema = _RECORD.replace("error string", "payload_bytes long, error string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                part, held = [], 0
                for row in rows(name, content):
                    part.append(row)
                    held += len(row[7] or b"") + 200
                    if held > 8_000_000:
                        yield frame(part)
                        part, held = [], 0
                if part:
                    yield frame(part)

    def frame(part: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(part, columns=names).astype({"record_no": "Int64", "payload_bytes": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def archive_pages(pages: DataFrame, path: str, smallest_revisit: int = 0) -> None:
    """Write a record per row of ``pages`` (page_id, url, html), equal payloads once.

    Of rows with equal payloads of at least ``smallest_revisit`` bytes, the one with the smallest
    page_id is a response and the others are revisits of it; rows that share that smallest page_id are
    responses all, and so are rows of a payload that no row with a page_id has. Null html is an empty
    payload. Digests are grouped, not payloads: only (digest, page_id) is shuffled to find the first.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    facts = pages.select("page_id", "url", payload.alias("payload"))
    sums = pages.select("page_id", F.sha1(payload).alias("sha"), F.length(payload).alias("n"))
    sums = sums.filter(F.col("n") >= smallest_revisit)
    groups = sums.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    groups = groups.filter((F.col("copies") > 1) & F.col("first").isNotNull()).select("sha", "first")
    later = sums.join(groups, "sha").filter(~F.col("page_id").eqNullSafe(F.col("first")))
    later = later.select(F.col("page_id").alias("__id"), F.col("sha").alias("__sha"), "first").distinct()
    same = F.col("page_id").eqNullSafe(F.col("__id")) & (F.sha1("payload") == F.col("__sha"))
    marked = facts.join(later, same, "left")
    revisit = F.col("first").isNotNull()
    written = marked.select(
        _record_id(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.when(revisit, _record_id(F.col("first"))).alias("refers_to"),
        F.col("payload"),
    )
    write_archives(written, path, train_dictionary(facts, "payload"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Give revisits the payload length of the response they refer to; an ``error`` where there is none.

    Columns: record_id, record_type, payload_bytes, payload_digest, refers_to, error. Only lengths
    and digests move, never payloads.
    """
    facts = records.select("record_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "error")
    targets = facts.filter("record_type = 'response'").groupBy("record_id", "payload_digest").agg(
        F.max("payload_bytes").alias("__bytes")
    ).select(F.col("record_id").alias("__target"), F.col("payload_digest").alias("__digest"), "__bytes")
    revisits = facts.filter("record_type = 'revisit'").join(
        targets, (F.col("refers_to") == F.col("__target")) & (F.col("payload_digest") == F.col("__digest")), "left"
    )
    revisits = revisits.select(
        "record_id", "record_type", F.col("__bytes").alias("payload_bytes"), "payload_digest", "refers_to",
        F.when(F.col("__bytes").isNull(), "its response is missing").alias("error"),
    )
    others = facts.filter("record_type IS NULL OR record_type != 'revisit'")
    return others.unionByName(revisits)


def _record_id(page_id):
    return F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")))
