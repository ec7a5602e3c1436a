"""Context-triggered piecewise hashing of whole texts.

A rolling hash of the last few bytes marks the ends of chunks, so an edit moves only the boundaries
next to it. Each chunk becomes a symbol of 12 bits, written as two letters; the symbols of all chunks
in order are a signature. A fingerprint holds the block size, chosen by the text's length, and the
signatures at that size, at twice and at four times the size; two fingerprints are compared by edit
distance at the smallest block size that both have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts.sources.storage import staged

#: Bytes that the rolling hash sees, smallest block size, chunks that the block size aims at, sizes in a fingerprint.
WINDOW, SMALLEST, CHUNKS, LEVELS = 7, 3, 64, 3
#: Bytes hashed at once; longer texts go piece by piece.
STRETCH = 1 << 20
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_PAIRS = np.array([a + b for a in _LETTERS for b in _LETTERS])
_ODD, _FOLD = np.uint32(0x9E3779B1), np.uint64(0x9E3779B97F4A7C15)


def _weights(count: int) -> np.ndarray:
    """Odd 64-bit multipliers by the place of a byte in its chunk, by a multiply and shift rule."""
    x = np.arange(1, count + 1, dtype=np.uint64) * _FOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))) | np.uint64(1)


_WEIGHTS = _weights(4096)


def block_size(length: int) -> int:
    """Smallest size of 3, 6, 12, ... of which at most ``CHUNKS`` blocks cover ``length`` bytes."""
    size = SMALLEST
    while size * CHUNKS < length:
        size *= 2
    return size


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of each byte and the ``WINDOW - 1`` before it; bytes before the start count as -1."""
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32) + np.uint32(1)])
    total, power = np.zeros(len(data), np.uint32), np.uint32(1)
    with np.errstate(over="ignore"):
        for back in range(WINDOW):
            at = WINDOW - 1 - back
            total += padded[at : at + len(data)] * power
            power = power * _ODD
        total ^= total >> np.uint32(15)
        return total * np.uint32(0x85EBCA6B) >> np.uint32(4)


def signatures(data: bytes, size: int, levels: int = LEVELS) -> list[str]:
    """Symbols of the chunks that end where the rolling hash is ``size - 1`` modulo ``size``, for each
    of ``levels`` doubled sizes; what is left after the last end is a chunk too."""
    sums, places = [0] * levels, [0] * levels
    codes: list[list[int]] = [[] for _ in range(levels)]
    for at in range(0, len(data), STRETCH):
        reach = min(at, WINDOW - 1)
        piece = np.frombuffer(data, np.uint8, count=min(STRETCH, len(data) - at) + reach, offset=at - reach)
        marks = rolling(piece)[reach:]
        values = piece[reach:].astype(np.uint64) + np.uint64(1)
        for k in range(levels):
            step = np.uint32(size << k)
            ends = np.flatnonzero(marks % step == step - 1) + 1
            starts = np.concatenate([[0], ends[ends < len(values)]])
            sizes = np.diff(np.concatenate([starts, [len(values)]]))
            shift = np.zeros(len(starts), np.int64)
            shift[0] = places[k]
            place = np.arange(len(values)) - np.repeat(starts - shift, sizes)
            with np.errstate(over="ignore"):
                totals = np.add.reduceat(values * _WEIGHTS[place & 4095], starts)
                totals[0] += np.uint64(sums[k])
            closed = len(ends)
            codes[k] += totals[:closed].tolist()
            if closed < len(starts):
                sums[k], places[k] = int(totals[-1]), int(place[-1]) + 1
            else:
                sums[k] = places[k] = 0
    out = []
    for k in range(levels):
        if places[k]:
            codes[k].append(sums[k])
        with np.errstate(over="ignore"):
            folded = np.array(codes[k], np.uint64) * _FOLD >> np.uint64(52)
        out.append("".join(_PAIRS[folded.astype(np.int64)]))
    return out


def fingerprint(text: str) -> str:
    """``size:signature:signature:signature`` of the text's UTF-8 bytes; an empty text has empty ones."""
    data = text.encode("utf-8", "surrogatepass")
    size = block_size(len(data))
    return ":".join([str(size), *signatures(data, size)])


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict[str, int] = {}
    for i, symbol in enumerate(a):
        masks[symbol] = masks.get(symbol, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for symbol in b:
        met = row & masks.get(symbol, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def likeness(a: str, b: str) -> float:
    """1 minus the edit distance (insertions and deletions) over the symbols of both signatures.

    Taken at the smallest block size that both fingerprints have. 1 for equal fingerprints; 0 if they
    have no size in common or one of the texts is empty and the other is not.
    """
    if a == b:
        return 1.0
    (size_a, *of_a), (size_b, *of_b) = a.split(":"), b.split(":")
    size_a, size_b = int(size_a), int(size_b)
    size = max(size_a, size_b)
    if size >= min(size_a << len(of_a), size_b << len(of_b)):
        return 0.0
    x, y = (
        [s[i : i + 2] for i in range(0, len(s), 2)]
        for s in (of_a[(size // size_a).bit_length() - 1], of_b[(size // size_b).bit_length() - 1])
    )
    return 2 * common_subsequence(x, y) / (len(x) + len(y)) if x and y else 0.0


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_DIGEST = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_ROW = f"{_DIGEST}, kind string, part long, text string"
_NAMES = [c.split()[0] for c in _DIGEST.split(", ")]


def _digest(doc_id, text: str, own: str, following: str, next_own: str) -> tuple:
    changed = edited(text, following)
    of_changed = fingerprint(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, len(text), sha, own, of_changed, likeness(own, of_changed), likeness(own, next_own))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of every row but the last of an ordered partition; its first and last row as they are."""
    part = TaskContext.get().partitionId()
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in _ROW.split(", ")])
    empty = (None,) * (len(_NAMES) - 1)
    held = None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            text = text or ""
            own = fingerprint(text)
            if held is None:
                rows.append((doc_id, *empty, "first", part, text))
            else:
                rows.append((*_digest(*held, text, own), "done", part, None))
            held = doc_id, text, own
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema
        )
    if held is not None:
        last = (held[0], *empty, "last", part, held[1])
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(last, schema, strict=True)], schema=schema)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of last rows that have been given their next text."""
    for batch in batches:
        columns = (batch[c].to_pylist() for c in ("doc_id", "text", "following"))
        rows = [_digest(d, t, fingerprint(t), n, fingerprint(n)) for d, t, n in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_pydict({name: [r[i] for r in rows] for i, name in enumerate(_NAMES)}, _DIGEST_SCHEMA)


_DIGEST_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def fingerprints(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """Fingerprint of every whole text: doc_id, fingerprint. A null text counts as empty; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    one = F.col(text) if isinstance(text, str) else text
    return docs.select(F.col("doc_id").cast("long"), one.cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fingerprint string"
    )


def edit_study(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness, one row per row of ``docs``.

    The next document is the one before in the order of doc_id; after the last comes the first again,
    so a single document is its own next. Rows with equal doc_id follow each other by a hash of their
    text, rows with a null doc_id come last; null texts count as empty; other columns are not read. An
    empty table gives no rows.

    Texts are shuffled once, by ranges of doc_id and hash, so repeated ids are spread too. Each task
    walks its ordered rows one at a time; only the first and the last row of each task are staged as
    texts, to meet their neighbours.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie"), F.col("row")]
    slim = slim.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    dealt = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    walked = staged(dealt.mapInArrow(_walk, _ROW), "fingerprints")
    done = walked.filter("kind = 'done'").select(*_NAMES)
    # one number per task, and no texts, on the driver
    parts = sorted(r["part"] for r in walked.filter("kind = 'first'").select("part").collect())
    if not parts:
        return done
    turns = dict(zip(parts, [*parts[1:], parts[0]], strict=True))
    after = docs.sparkSession.createDataFrame(list(turns.items()), "part long, next_part long")
    firsts = walked.filter("kind = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    lasts = walked.filter("kind = 'last'").select("part", "doc_id", "text")
    met = lasts.join(after, "part").join(firsts, "next_part").select("doc_id", "text", "following")
    return done.unionByName(met.mapInArrow(_meet, _DIGEST))
