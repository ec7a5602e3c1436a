import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sitefacts.llm import packing


@pytest.mark.parametrize("window", [1, 16, 100, 2048])
def test_tree_finds_the_tightest_window(window):
    rng = random.Random(window)
    for count in (0, 1, 5, 200):
        lengths = np.array([rng.randint(1, window) for _ in range(count)], np.int64)
        bins, offsets = packing.best_fit_decreasing(lengths, window)
        rooms = []
        for k in sorted(range(count), key=lambda k: (-lengths[k], k)):
            fits = [r for r in rooms if r >= lengths[k]]
            tightest = min(fits, default=window)
            assert offsets[k] == window - tightest
            if fits:
                rooms.remove(tightest)
            rooms.append(tightest - lengths[k])
        assert len(set(bins.tolist())) == len(rooms)


def test_pieces(spark, make_docs, words):
    texts = {k: words(30 * k, k) for k in range(1, 40)} | {100: words(30_000, 9), 101: "", 102: None}
    docs = make_docs([*texts.items(), (1, texts[1]), (None, "x")])
    rows = packing.pack_documents(docs, window=256, shard=16).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    own = packing.encoder()
    for doc, text in texts.items():
        ids = own.encode(text or "") + (1).to_bytes(4, "little")
        parts = sorted(pieces[doc], key=lambda r: r.start)
        parts = parts[:: 2 if doc == 1 else 1]
        assert sum(r.length for r in parts) == len(ids) // 4 == parts[0].doc_tokens
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])
    lengths = sorted((r.start, r.length) for r in pieces[1])
    assert lengths[::2] == lengths[1::2] and len(pieces[None]) == 1  # the repeated row has its pieces too
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_rows_without_an_id_spread_over_shards(spark, make_docs):
    """Null ids and repeats are dealt like any other rows, so no shard holds them all."""
    docs = make_docs([(None, "x")] * 300 + [(7, "y")] * 300)
    rows = packing.pack_documents(docs, window=64, shard=40).collect()
    shards = Counter(r.sequence_id >> 32 for r in rows)
    assert len(rows) == 600 and len(shards) == 15 and max(shards.values()) < 80
    of_null = Counter(r.sequence_id >> 32 for r in rows if r.doc_id is None)
    assert len(of_null) >= 14


def test_ids_are_the_vocabulary_s_own():
    """Any byte-level text, marks that look special and long runs of blanks included."""
    own, rng = packing.encoder(), random.Random(5)
    pools = ["".join(map(chr, range(256))), " \t\n\r\x0b\x1c\x85\xa0aB1'!", "'sStTreREvml ldD a\0<|", "aé 中 "]
    texts = ["".join(rng.choices(pools[k % 4], k=rng.randint(0, 30))) for k in range(2000)]
    texts += ["a<|endoftext|>b", "x" + " " * 150_000 + "y", "\t" * 2_000_000 + "a", "a" * 5000]
    for text in texts:
        assert own.encode(text) == np.array(own.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_an_encoder_keeps_nothing_of_the_texts():
    """A worker serves other stages later: what it keeps must not grow with what it has read."""
    own = packing.encoder()
    tracemalloc.start()
    try:
        own.encode("warm up")
        before = tracemalloc.get_traced_memory()[0]
        for k in range(0, 100_000, 1000):
            own.encode(" ".join(f"w{k + i:x}q" for i in range(1000)))
        assert tracemalloc.get_traced_memory()[0] - before < 1_000_000
    finally:
        tracemalloc.stop()
