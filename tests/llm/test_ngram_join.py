import random
import re

import numpy as np
import pytest

from sitefacts.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))


def brute_force(docs, size, percent):
    """Smallest reachable id of each document by comparing all pairs."""
    sets = {}
    for doc, text in docs:
        sets.setdefault(doc, []).append(shingle_set(text, size))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            linked = any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b] if x and y)
            if linked and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in ids}


def corpus(words):
    """Chains of near copies around the threshold, a large group, shared passages, short and long texts."""
    rng = random.Random(8)
    docs, passage = [], words(60, 77)
    for base in range(12):
        text = words(rng.choice([9, 12, 20, 60, 150, 400]), base).split()
        for _ in range(6):
            docs.append(" ".join(text))
            text = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = f"w{rng.random()}"
    hot = words(120, 500).split()
    for k in range(60):
        copy = list(hot)
        for _ in range(k % 3):
            copy[rng.randrange(len(copy))] = f"v{rng.random()}"
        docs.append(" ".join(copy))
    docs += [f"{passage} {words(8, 900 + k)}" for k in range(40)]
    docs += ["", None, "  \n\t ", "one", "ONE", "one two", "One\x0btwo", "one\x1ctwo", "É é", "é é", "a b c", "A B C", "a b c d"]
    docs += [words(9, 5)] * 30 + [words(30_000, 6), words(30_000, 6) + " end"]
    rng.shuffle(docs)
    return [(k * 3, t) for k, t in enumerate(docs)]


@pytest.mark.parametrize(("size", "percent", "small_list"), [(3, 90, 2), (5, 80, 16), (2, 60, 4)])
def test_components_equal_brute_force(spark, make_docs, words, monkeypatch, size, percent, small_list):
    monkeypatch.setattr(ngram_join, "SMALL_LIST", small_list)
    monkeypatch.setattr(ngram_join, "BLOCK", 24)
    docs = corpus(words)
    got = {r.doc_id: r for r in ngram_join.classes(make_docs(docs), size, percent).collect()}
    want = brute_force(docs, size, percent)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(got[d].n_shingles == len(shingle_set(t, size)) for d, t in docs)


def test_nulls_repeats_and_no_rows(spark, make_docs, words):
    text = words(40, 1)
    docs = [(None, text), (4, text), (4, text), (2, text + " x"), (9, words(40, 2)), (9, text)]
    rows = sorted((r.doc_id or -1, r.component_id) for r in ngram_join.classes(make_docs(docs)).collect())
    assert rows == [(-1, None), (2, 2), (4, 2), (4, 2), (9, 2), (9, 2)]
    assert ngram_join.classes(make_docs([])).count() == 0
    assert ngram_join.classes(make_docs([(1, None)])).collect()[0].component_id == 1


def test_bitmaps_never_exceed_the_distance(make_docs, words):
    """The parity bitmaps of two sets differ in no more bits than the sets differ in shingles."""
    texts = [words(200, k) for k in range(6)] + [words(200, 0) + " " + words(n, 90 + n) for n in (1, 5, 60, 2500)] + ["one two"]
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = ngram_join.features(make_docs(list(enumerate(texts))), 3, 90, none).collect()
    sets = {r.doc_id: set(ngram_join.shingles(texts[r.doc_id]).tolist()) for r in rows}
    bits = {r.doc_id: np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in rows}
    apart = {(a, b): (int((bits[a] != bits[b]).sum()), len(sets[a] ^ sets[b])) for a in bits for b in bits}
    assert all(of_bits <= of_sets for of_bits, of_sets in apart.values())
    assert apart[0, 6][0] > 0 and apart[0, 0] == (0, 0) and any(0 < x < y for x, y in apart.values())
    assert ngram_join.needed(600, 90) == 540 and ngram_join.needed(9, 90) == 9


def test_equal_sets_only(spark, make_docs, words):
    """At 100 percent only equal sets link."""
    docs = make_docs([(1, words(40, 1)), (2, words(40, 1)), (3, words(40, 1) + " more"), (4, words(5, 2)), (5, words(5, 2).upper())])
    got = {r.doc_id: r.component_id for r in ngram_join.classes(docs, percent=100).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


@pytest.mark.parametrize("blocks", [1, 2])
def test_sieve_leaves_only_what_it_did_not_tell(spark, blocks):
    """Pairs near by bitmaps are told or lie between members that are left; a list without such pairs is done."""
    rng = np.random.default_rng(4)
    rows = []
    for token in range(6):
        maps = rng.random((24, ngram_join.BITS)) < 0.2
        for k in range(1, 24 if token < 5 else 1):
            if k % (token + 1) and token:  # chains of near bitmaps, but none in the first and the last list
                maps[k] = maps[k - 1]
                maps[k, rng.integers(0, ngram_join.BITS, 12)] ^= True
        for k, x in enumerate(maps):
            own = k % blocks
            rows += [
                (token + 2**62, min(own, o), max(own, o), own, 100 * token + k, 500 + k, bytearray(np.packbits(x).tobytes()), 100 * token + k)
                for o in range(blocks)
            ]
    cells = spark.createDataFrame(rows, "token long, cell_i int, cell_j int, cell_own int, doc_id long, n long, bits binary, component long")
    near, bits = set(), {r[4]: (r[5], np.unpackbits(np.frombuffer(bytes(r[6]), np.uint8)), r[0]) for r in rows}
    for a, (n, x, list_a) in bits.items():
        near |= {(a, b) for b, (m, y, list_b) in bits.items() if a < b and list_a == list_b and (x != y).sum() * 190 <= (n + m) * 10}
    assert near
    for across, partners in ((False, None), (True, 1), (True, None)):
        got = ngram_join.sieve(cells, 90, across, partners).collect()
        told = {(r.a, r.b) for r in got if not r.left}
        left = {(r.token, r.cell_i, r.cell_j, r.doc_id) for r in got if r.left}
        assert told <= near and all(r.token >= 2**62 for r in got if r.left)
        cell = {a: [(r[0], r[1], r[2]) for r in rows if r[4] == a] for a in bits}
        for a, b in near - told:
            own = [c for c in cell[a] if c in cell[b] and {a % 100 % blocks, b % 100 % blocks} == {c[1], c[2]}]
            assert own and all((*c, a) in left and (*c, b) in left for c in own)
        assert not {t - 2**62 for t, *_ in left} & {0, 5}
        assert across and partners is None or len(left) > 0
    assert told == near and not left
