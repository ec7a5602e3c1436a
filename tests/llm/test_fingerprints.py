"""Piecewise fingerprints against a byte-by-byte version and a plain edit distance."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from sitefacts.llm import fingerprints as P


def plain_signature(data, size):
    """One byte at a time: rolling hash, chunk sum, symbol."""
    codes, total, place = [], 0, 0
    for i, byte in enumerate(data):
        window = [data[i - k] + 1 if i >= k else 0 for k in range(P.WINDOW)]
        h = sum(b * pow(int(P._ODD), k, 1 << 32) for k, b in enumerate(window)) % (1 << 32)
        h ^= h >> 15
        h = (h * 0x85EBCA6B % (1 << 32)) >> 4
        total = (total + (byte + 1) * int(P._WEIGHTS[place % 4096])) % (1 << 64)
        place += 1
        if h % size == size - 1:
            codes.append(total)
            total = place = 0
    if place:
        codes.append(total)
    return "".join(P._PAIRS[(c * int(P._FOLD) % (1 << 64)) >> 52] for c in codes)


def plain_common(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.sampled_from([3, 6, 24]))
def test_signatures_byte_by_byte(data, size):
    assert P.signatures(data, size) == [plain_signature(data, size << k) for k in range(P.LEVELS)]


def test_signatures_over_several_stretches(monkeypatch):
    data = random.Random(1).randbytes(5000)
    whole = P.signatures(data, 12)
    for stretch in (64, 777, 5000):
        monkeypatch.setattr(P, "STRETCH", stretch)
        assert P.signatures(data, 12) == whole


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
def test_common_subsequence(a, b):
    assert P.common_subsequence(a, b) == plain_common(a, b)


def test_likeness(words):
    text = words(800, 1)
    own = P.fingerprint(text)
    assert P.likeness(own, own) == P.likeness(P.fingerprint(""), P.fingerprint("")) == 1
    assert P.likeness(own, P.fingerprint(words(800, 2))) < 0.15
    changed = text[:2000] + "inserted words here " + text[2000:]
    assert P.likeness(own, P.fingerprint(changed)) > 0.85
    half = P.likeness(own, P.fingerprint(P.edited(text, words(800, 3))))
    assert 0.3 < half < 0.7
    assert P.likeness(own, P.fingerprint("")) == P.likeness(own, P.fingerprint("x")) == 0
    # a text of half the length has another block size, and still meets at a common one
    assert P.likeness(own, P.fingerprint(text[: len(text) // 2])) > 0.5


def plain_study(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        a, b, c = map(P.fingerprint, (text, changed, following))
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, P.likeness(a, b), P.likeness(a, c)))
    return out


def test_study(spark, make_docs, words):
    texts = [words(n % 90, n) for n in range(120)]
    rows = [(i * 7 % 120, t) for i, t in enumerate(texts)]
    rows += [(500, None), (501, ""), (502, "é" * 50 + "日本"), (503, words(40_000, 5)), (504, words(3, 1)), (505, words(3, 1)), (None, "no id")]
    got = [tuple(r) for r in P.edit_study(make_docs(rows)).collect()]
    assert sorted(got, key=str) == sorted(plain_study(rows), key=str)
    alone = P.edit_study(make_docs([(1, "abcdef")])).collect()
    assert [(r.doc_id, r.n_chars, r.near_next) for r in alone] == [(1, 6, 1.0)]
    assert P.edit_study(make_docs([])).collect() == []


def test_study_repeats(spark, make_docs, words):
    """Rows that repeat a doc_id follow each other, whatever their texts; each gives a row."""
    rows = [(5, "same text " * 9)] * 40 + [(5, words(50, 1)), (4, words(60, 2))]
    got = P.edit_study(make_docs(rows)).collect()
    assert len(got) == 42 and sum(r.near_next == 1 for r in got) >= 39
    assert len({r.fingerprint for r in got}) == 3


def test_prints(spark, make_docs, words):
    rows = [(1, words(100, 1)), (2, words(100, 1)), (3, None)]
    got = {r.doc_id: r.fingerprint for r in P.fingerprints(make_docs(rows)).collect()}
    assert got == {i: P.fingerprint(t or "") for i, t in rows}
