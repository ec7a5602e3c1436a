import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sitefacts.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reference_targets(sizes, weights=(5, 2, 1)):
    """Give by weight, stop at twice the size, give the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not above:
            for s in open_:
                target[s] = left * weight[s] / total
            break
        for s in above:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in above)
        open_ -= above
    return target


def brute_force(docs, target, sizes):
    taken = []
    for source in sizes:
        mine = sorted((hashlib.md5(("" if d is None else str(d)).encode()).hexdigest(), len(WORD.findall(t or "")), d) for d, t, s in docs if s == source)
        words, at = int(target[source] + 0.5), 0
        for _, size, doc in mine:
            passes, rest = divmod(words, sizes[source]) if sizes[source] else (0, 0)
            taken.append((doc, size, passes * size + max(0, min(at + size, rest) - at)))
            at += size
    return sorted(taken, key=str)


@pytest.mark.parametrize("block", [1, 7, 64, 1024])
def test_mix_equals_brute_force(spark, make_docs, words, block, monkeypatch):
    monkeypatch.setattr(mixing, "PART", 16)
    docs = [(k, words(k % 40, k), f"s{k % 7}") for k in range(300)]
    docs += [(900 + k, words(25, k), "hot") for k in range(150)] + [(2000, words(20_000, 3), "long"), (2001, None, None)]
    docs += [(2002, "one\x0btwo\x1cthree \xa0", None), (2003, "", "void"), (2004, None, "void"), (None, "a b", "s1"), (5, docs[5][1], "s5"), (7, "x", "é"), (8, "y", "z")]
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    target = reference_targets(sizes)
    rows = mixing.mix(make_docs(docs), block=block).collect()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and r.taken <= 2 * r.size
    assert sorted(((r.doc_id, r.size, r.taken) for r in rows), key=str) == brute_force(docs, target, sizes)


def test_stretches_make_up_the_mix(make_docs, words):
    docs = make_docs([(k, words(k % 50, k), f"s{k % 3}") for k in range(200)])
    rows = mixing.placements(docs, block=16).filter("words > 0").collect()
    for r in rows:
        assert 0 <= r.from_word and r.from_word + r.words <= r.size
    by_slot = {}
    for r in rows:
        by_slot.setdefault(r.slot, []).append(r)
    assert all(len({r.source for r in part}) == 1 and sum(r.words for r in part) <= 16 for part in by_slot.values())
    # any early part of the mix is near the targets
    slots = sorted(by_slot)
    total = sum(r.words for r in rows)
    early = [r for s in slots[: len(slots) // 4] for r in by_slot[s]]
    for source in ("s0", "s1", "s2"):
        share = sum(r.words for r in rows if r.source == source) / total
        part = sum(r.words for r in early if r.source == source) / sum(r.words for r in early)
        assert abs(share - part) < 0.08


def test_nothing_to_mix(make_docs):
    assert mixing.mix(make_docs([])).count() == 0
    rows = mixing.mix(make_docs([(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def test_word_count_equals_regular_expression(spark, words):
    texts = ["", None, "a", " a ", "a\x1cb", "a\x0bb\x0cc", "\xa0", "a\xa0b c", "x y", words(20_000, 1), "\r\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mixing.word_count(F.col("t")).alias("n")).collect()
    assert all(r.n == len(WORD.findall(r.t or "")) for r in rows)
