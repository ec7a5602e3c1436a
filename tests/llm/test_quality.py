import random
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitefacts.llm import quality, queries

SCHEMA = "doc_id long, quality int, score double, text string"


@pytest.fixture(scope="module")
def labelled(spark, make_docs, words):
    rng, docs, labels = random.Random(2), [], []
    for k in range(900):
        good = k % 4 != 0
        text = words(rng.randint(5, 120), k)
        if not good:
            text = " ".join(w + rng.choice(["$$$", "!!"]) for w in text.split()) if k % 8 else " ".join([text.split()[0]] * 60)
        docs.append((k, text))
        labels.append((k, int(good), 0.1, "x"))
    docs += [(5000, None), (5001, ""), (None, "x"), (5002, words(40_000, 1)), (7, docs[7][1])]
    labels += [(None, 1, 0.0, "x"), (5000, None, 0.0, "x"), (9999, 1, 0.0, "x"), (8, 1, 0.0, "x")]
    return make_docs(docs), spark.createDataFrame(labels, SCHEMA), dict(docs), {k: g for k, g, *_ in labels[:900]}


def test_held_out_accuracy(labelled):
    docs, labels, texts, truth = labelled
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    for r in rows:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1)
    mine = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in mine]) > 0.97
    empty = {r.score for r in rows if r.doc_id in (5000, 5001)}
    assert len(empty) == 1
    assert len({r.score for r in rows if r.doc_id == 7}) == 1


def test_held_out_labels_are_never_used(spark, labelled):
    docs, labels, _, _ = labelled
    aside, label = quality.held_out(F.col("doc_id")), F.col("quality")
    flipped = labels.withColumn("quality", F.when(aside, 1 - label).otherwise(label))
    a = sorted((r.doc_id or -1, round(r.score, 12)) for r in quality.classify(docs, labels).collect())
    b = sorted((r.doc_id or -1, round(r.score, 12)) for r in quality.classify(docs, flipped).collect())
    assert a == b


def test_few_labels(spark, make_docs):
    docs = make_docs([(0, "a b"), (1, "c"), (2, None)])
    none = spark.createDataFrame([], SCHEMA)
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(k, 1, 0.0, "x") for k in range(3)], SCHEMA)
    assert {r.score for r in quality.classify(docs, ones).collect()} == {1.0}
    assert quality.classify(make_docs([]), ones).count() == 0


def test_pool_is_the_mean_of_word_vectors():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(quality.ROWS, quality.WIDTH)).astype(np.float32)
    text = "The cat the cat cat!! 42"
    rows = [r for c in text.split() for r in quality.word_rows(c)]
    want = vectors[rows].astype(np.float64).mean(0)
    assert np.allclose(quality.Pool(vectors).pooled(text)[:-1], want, atol=1e-5)
    again = [*rows, *quality.word_rows("42"), quality.AGAIN]
    assert np.allclose(quality.Pool(vectors).pooled(text + " 42")[:-1], vectors[again].astype(np.float64).mean(0), atol=1e-5)


def test_temperature():
    rng = np.random.default_rng(0)
    z = rng.normal(size=20_000) * 2
    y = (rng.random(20_000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(quality.fit_temperature(z * 3, y) - 3) < 0.2


def test_query(spark, testdata):
    testdata = testdata.replace("sf0.001", "sf0.01")  # with some hundred labels
    rows = queries.op3_quality(spark, testdata).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{testdata}/labels.parquet").collect()}
    mine = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in mine]) > 0.9


def test_repeated_ids_teach_one_text(spark, words):
    """Of rows that repeat a doc_id with different texts always the same one teaches."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1][:60]
    rows = [(i, words(30, 7 * i + k) + (" good" if i % 2 else " bad") * 5) for i in ids for k in range(3)]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    scores = []
    for part in (rows, rows[::-1]):
        docs = spark.createDataFrame(part, "doc_id long, text string").repartition(4)
        got = quality.classify(docs, labels).join(docs.distinct(), "doc_id").select("doc_id", "score").distinct().collect()
        scores.append(sorted((r.doc_id, round(r.score, 9)) for r in got))
    assert scores[0] == scores[1]


def test_rows_are_scored_a_few_at_a_time(spark, words, monkeypatch):
    """What a worker holds beside a batch of rows is small: its sums, and the rows it hands on."""
    held = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, run, schema: held.append(run))
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(quality.ROWS, quality.WIDTH)).astype(np.float32)
    layers = rng.normal(size=(quality.WIDTH + 1, 2)), np.zeros(2), np.ones(2), 0.0
    model = quality.Model(vectors, np.zeros(quality.WIDTH + 1), np.ones(quality.WIDTH + 1), layers)
    quality.score(spark.createDataFrame([], "doc_id long, text string"), model)
    texts = [words(3, k) if k % 7 else None for k in range(2300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2300)), pa.array(texts)], names=["doc_id", "text"])
    out = list(held[0](iter([batch, batch.slice(0, 0), batch.slice(10, 3)])))
    assert max(b.num_rows for b in out) <= 500
    got = pa.Table.from_batches(out)
    assert got["doc_id"].to_pylist() == [*range(2300), 10, 11, 12] and got["text"].to_pylist() == texts + texts[10:13]
    want = model.probabilities(np.array([quality.Pool(vectors).pooled(t) for t in texts[:50]]))
    assert np.allclose(got["score"].to_pylist()[:50], want)
    assert quality.Pool(vectors).sums.nbytes < 30_000_000


def plain_rows(chunk):
    """Rows of a stretch by the token pattern alone."""
    rows = []
    for token in re.findall(r"[^\W_]+|[\W_]+", chunk):
        if token[0].isalnum():
            case = "A" if token.isupper() else "a" if token.islower() else "1" if token.isdigit() else "Aa"
            rows += [token.lower(), f"\0{case}"]
        else:
            rows.append(token)
    return tuple(zlib.crc32(r.encode("utf-8", "replace")) % quality.ROWS for r in rows)


def test_one_word_needs_no_pattern():
    assert all(chr(k).isalnum() == bool(re.match(r"[^\W_]", chr(k))) for k in range(sys.maxunicode + 1))
    rng = random.Random(4)
    chunks = ["".join(rng.choices("aZ\u00df\u01c5\u03a3\u0130_-.$19\u2460\u00b2\u4e2d\u0301\ud800\U0001f600", k=rng.randint(1, 6))) for _ in range(5000)]
    for chunk in [*chunks, "word", "WORD", "Word", "42", "4th", "\u2163", "_", "_a_"]:
        assert quality.word_rows(chunk) == plain_rows(chunk)


def test_new_stretches_are_summed_together(words, monkeypatch):
    """Sums are those of one stretch at a time to the bit, but vectors are fetched for many stretches at once."""
    monkeypatch.setattr(quality, "CACHED", 300)
    fetched = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            fetched.append(key)
            return np.asarray(super().__getitem__(key))

    vectors = np.random.default_rng(3).normal(size=(quality.ROWS, quality.WIDTH)).astype(np.float32)
    pool = quality.Pool(vectors.view(Counted))
    rng = random.Random(5)
    texts = [" ".join(f"{rng.choice('abc')}{rng.randrange(400)}{rng.choice(['', '.', '-x', '.y' * 6])}" for _ in range(n)) for n in (1, 7, 250, 900, 40)]
    for text in [*texts, " ".join(["same"] * 700), "", None]:
        chunks = (text or "").split()
        sums = [vectors[list(plain_rows(c))].sum(0) for c in chunks]
        want = np.zeros(quality.WIDTH)
        for at in range(0, len(chunks), 300):
            want += np.array(sums[at : at + 300]).sum(0, dtype=np.float64)
        again = sum(a == b for a, b in zip(chunks, chunks[1:], strict=False))
        want += again * vectors[quality.AGAIN]
        count = sum(len(plain_rows(c)) for c in chunks) + again
        assert pool.pooled(text).tolist() == [*(want / max(count, 1)), np.log1p(count)]
    fetched.clear()
    pool.pooled(" ".join(f"n{k}." for k in range(300)))
    assert len(fetched) < 20
