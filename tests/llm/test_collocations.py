"""Phrase index and collocations against counting every phrase."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitefacts.llm import collocations as C


def plain_grams(ids, length):
    return Counter(
        tuple(ids[i : i + length]) for i in range(len(ids) - length + 1) if 0 not in ids[i : i + length]
    )


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.integers(1, 5))
def test_phrases_of_an_index(ids, length):
    index = C.PhraseIndex(np.array(ids, np.int64), length)
    shorter = sorted(plain_grams(ids, length - 1)) if length > 1 else [()]
    nodes = index.phrases(length)
    places = index.ahead.places - 1
    got = {}
    for begin, size, first, last in zip(nodes.begin, nodes.size, nodes.first, nodes.last):
        at = places[begin : begin + size]
        found = {tuple(ids[p : p + length]) for p in at}
        assert len(found) == 1
        gram = found.pop()
        got[gram] = int(size)
        if length > 1:
            assert shorter[first] == gram[:-1] and shorter[last] == gram[1:]
    assert got == plain_grams(ids, length) and list(got) == sorted(got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=50), st.integers(1, 4), st.randoms())
def test_reduced_sequences(ids, length, rng):
    grams = sorted(plain_grams(ids, length))
    alive = np.array([i for i in range(len(grams)) if rng.random() < 0.6], np.int64)
    kept = {grams[i] for i in alive}
    new, left = C.keep_alive(np.array(ids, np.int64), length, alive)
    longer = {g: n for g, n in plain_grams(ids, length + 1).items() if g[:-1] in kept and g[1:] in kept}
    assert plain_grams(new.tolist(), length + 1) == longer
    assert sorted(plain_grams(new.tolist(), length)) == [grams[i] for i in left]


def plain(rows, longest, least):
    totals, counts = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts[lang][tuple(words[i : i + m])] += 1
    out = set()
    for lang, of in counts.items():
        often = {g: a for g, a in of.items() if len(g) > 1 and a >= least}
        rest = []
        for g, a in often.items():
            inside = any(
                len(h) > len(g) and b >= a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
                for h, b in often.items()
            )
            if not inside:
                cuts = [(1000 * a * totals[lang] // (of[g[:k]] * of[g[k:]]), k) for k in range(1, len(g))]
                score, k = min(cuts)
                rest.append((-score, -a, " ".join(g).encode(), of[g[:k]], of[g[k:]], k))
        for rank, (score, a, phrase, left, right, k) in enumerate(sorted(rest), 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score, k))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard long, id string, words int"


@pytest.mark.parametrize("shard", [50, 5000])
def test_collocations(spark, shard):
    rng = random.Random(8)
    pool = "un deux Trois été ÉTÉ a b c the The of x 日本".split(" ")
    rows = []
    for i in range(160):
        words = rng.choices(pool, k=rng.randint(0, 30))
        if i % 3 == 0:
            words[2:2] = "the quick Brown fox jumps over".split()
        gaps = [rng.choice([" ", " ", "  ", "\t", ". ", ",", "\r\n", "!?"]) for _ in words]
        rows.append((rng.choice(["en", "fr", None]), "".join(w + g for w, g in zip(words, gaps))))
    rows += [("en", None), ("fr", ""), (None, " . , "), ("long", "so it goes on and on " * 900), ("long", "x" * 50_000)]
    full = [(i, t, lang, "s", 0, 7, "x", 3) for i, (lang, t) in enumerate(rows)]
    got = C.collocations(spark.createDataFrame(full, SCHEMA), least=4, top=None, shard_words=shard)
    assert {tuple(r) for r in got.collect()} == plain(rows, 5, 4)
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_top(spark):
    rows = [(i, "aa bb. cc dd. ee ff. aa bb", "en", "s", 0, 1, "x", 1) for i in range(5)]
    got = C.collocations(spark.createDataFrame(rows, SCHEMA), least=5, top=2).collect()
    assert [(r["rank"], r.phrase) for r in sorted(got, key=lambda r: r["rank"])] == [(1, "cc dd"), (2, "ee ff")]


def test_stretches():
    data = b"ab cd\nef " * 5 + b"z" * 40 + b" end"
    for most in (1, 4, 7, 30, 500):
        words = [w for found, _ in C._stretches(data, most) for w in found if w]
        assert words == [w for w in (data + b"\n").replace(b"\n", b" \n ").split(b" ") if w]


def test_large_products(spark):
    """Products beyond 64 bits stay exact."""
    a, n, left, right = 9 * 10**15, 9 * 10**17, 3 * 10**16 + 1, 7 * 10**15 + 3
    row = spark.sql(
        f"SELECT (1000BD * CAST({a} AS decimal(19,0)) * CAST({n} AS decimal(19,0))) "
        f"div (CAST({left} AS decimal(19,0)) * CAST({right} AS decimal(19,0))) AS score"
    ).first()
    assert row.score == 1000 * a * n // (left * right)


def test_order_of_keys(monkeypatch):
    """Stable, and sorted as single numbers, without an argsort, where key and place fit one."""
    rng = np.random.default_rng(3)
    for most, size in ((1, 0), (1, 1), (3, 1000), (1 << 40, 5000), (1 << 61, 5000)):
        keys = rng.integers(0, most, size)
        keys = np.concatenate([keys, keys[: size // 2]])
        assert (C._order(keys) == np.argsort(keys, kind="stable")).all()
    monkeypatch.setattr(C.np, "argsort", None)
    assert C._order(np.array([2, 0, 2, 1])).tolist() == [1, 3, 0, 2]
    assert C.PhraseIndex(np.array([1, 2, 1, 2]), 3).phrases(2).size.tolist() == [2, 1]


def test_a_shard_is_reduced_without_a_second_index(monkeypatch):
    """What a shard drops is seen from its forward order; the index of the next length is the only one built."""
    monkeypatch.setattr(C, "PhraseIndex", None)
    ids, left = C.keep_alive(np.array([1, 2, 3, 0, 2, 3, 1, 2]), 2, np.array([0, 1]))
    assert ids.tolist() == [1, 2, 3, 0] and left.tolist() == [0, 1]
