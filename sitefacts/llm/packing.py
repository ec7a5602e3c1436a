"""Packing of documents into fixed windows: best-fit decreasing over a tree of remaining capacities.

Documents are tokenized once; pieces carry only their place, length and checksum from there on. An
overlong document is first cut into full windows, each a sequence of its own; what is left of every
document is placed in decreasing order into the open window with the tightest room. Rooms are indexed
by a segment tree over the capacities 0..window, so one placement costs log(window) steps. Remainders
are dealt to shards of a few thousand by a hash, and shards are packed side by side.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitefacts.llm.token_counts import byte_letters
from sitefacts.sources.storage import staged

VOCABULARY = "byte_bpe_50k.json"
#: Id that follows every document.
SEPARATOR = 1
#: Remainders that are packed together. Larger shards waste a little less, smaller ones spread further.
SHARD = 4096
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PACKED = f"{_PIECE}, sequence_id long, offset long"


class TextEncoder:
    """Ids of byte-level texts as little-endian 32-bit bytes.

    Nothing that grows with the texts is kept, so a worker that is used again by other stages stays small.
    """

    #: The splitter steps back over a run of blanks on a stack that holds this many for certain.
    _BLANKS = 100_000
    _RUN = re.compile(r"\s+")

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        value = {letter: byte for byte, letter in enumerate(byte_letters())}
        ranks = {bytes(value[c] for c in token): k for token, k in vocab.items() if token not in self.special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
        if [vocab["".join(p)] for p in pairs] != list(range(256, 256 + len(merges))):
            raise ValueError(f"{path}: ids are not in the order of the merges")
        pieces = tiktoken.Encoding(
            "words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.core = pieces._core_bpe
        self.split = regex.compile(public_tokenizers.PATTERN)

    @cached_property
    def whole(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(text) > self._BLANKS and any(m.end() - m.start() > self._BLANKS for m in self._RUN.finditer(text)):
            ids = array("I")
            for word in self.split.findall(text):
                ids.extend(self.core.encode_single_piece(word.encode()))
        else:
            ids = array("I", self.core.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


@lru_cache(maxsize=2)
def encoder(name: str = VOCABULARY) -> TextEncoder:
    return TextEncoder(public_tokenizers.path(name))


def cut_documents(docs: DataFrame, window: int = 2048, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Full windows and the remainder of every document: doc_id, start, length, ids_crc32, doc_tokens[, ids].

    A document's ids are those of its whole text, special strings as the vocabulary has them, then the
    separator. A null text is empty. ``ids`` are little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, last = encoder(vocabulary), np.array([SEPARATOR], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                ids = own.encode("" if text is None else text) + last
                for at in range(0, len(ids), 4 * window):
                    piece = ids[at : at + 4 * window]
                    row = (doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)
                    rows.append((*row, piece) if with_ids else row)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, _PIECE + (", ids binary" if with_ids else ""))


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, decreasing lengths first, equal ones in the given order.

    Leaf ``c`` of the tree counts open windows with room ``c``. The tightest room of at least ``need``
    is found by climbing from the leaf to the first ancestor with windows to the right, then descending.
    """
    leaves = 1 << int(window).bit_length()
    tree = [0] * (2 * leaves)
    open_by_room: list[list[int]] = [[] for _ in range(window + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened = 0

    def add(room: int, by: int) -> None:
        at = room + leaves
        while at:
            tree[at] += by
            at >>= 1

    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        at = need + leaves
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):
                at >>= 1
            at = at + 1 if at > 1 else 0
            while at and at < leaves:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        room = at - leaves if at else window
        if at:
            chosen = open_by_room[room].pop()
            add(room, -1)
        else:
            chosen, opened = opened, opened + 1
        bins[k], offsets[k] = chosen, window - room
        if room > need:
            open_by_room[room - need].append(chosen)
            add(room - need, 1)
    return bins, offsets


def pack(pieces: DataFrame, window: int = 2048, shard: int = SHARD) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the pieces of ``cut_documents``.

    The pieces are counted, then dealt by a hash of (doc_id, start) and their row to shards of about
    ``shard`` rows, so long documents, repeated rows and rows without an id spread like any others. ``sequence_id`` is unique over all
    shards: the shard in the upper bits, the window of the shard in the lower 32. Sequences hold at
    most ``window`` tokens without gaps; the rest is padding, of which a length that is a power of
    two needs none. Ties go by doc_id and start, so reruns over the same files agree. ``pieces`` is a written
    table. No rows in, no rows out.
    """
    shards = max(1, -(-pieces.count() // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(shards)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = best_fit_decreasing(rows["length"].to_numpy(), window)
        rows["sequence_id"] = (rows["shard"].to_numpy() << 32) + bins
        rows["offset"] = offsets
        return rows.drop(columns="shard").astype({"doc_id": "Int64"})

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long"
    return dealt.groupBy("shard").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, window: int = 2048, vocabulary: str = VOCABULARY, shard: int = SHARD) -> DataFrame:
    """Pack all documents: one row per piece with its sequence and offset.

    Null and empty texts are one separator. Repeated rows are packed each; a null doc_id is kept.
    Further columns of ``docs`` are not read. Pieces are staged, so texts are tokenized once.
    """
    return pack(staged(cut_documents(docs, window, vocabulary), "pieces"), window, shard)
