"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network.

Every token has a sparse random index vector; the vector of a word is the sum of the index vectors that
stand around it in the training texts. Tokens are hashed to a fixed number of rows, so the table of
vectors is bounded, and summed as integers, so it doesn't depend on the order of tasks. A document is
the mean of its words' vectors over its whole text. A network with one hidden layer maps it to a score, and
a temperature fitted on rows set aside makes the scores probabilities.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts.llm.common import TwoGenerations, in_slices
from sitefacts.sources.storage import staged

#: Labelled rows that the classifier is fitted on, at most; those with the smallest hash of doc_id.
MOST_ROWS = 4000
#: Rows of the vector table, its width, places that are not 0 in an index vector, words on each side.
ROWS, WIDTH, PLACES, AROUND = 1 << 15, 64, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 40, 64, 3e-3, 1e-4, 7
#: Stretches whose rows or sums a worker keeps, twice as many at most: 26 MB of sums.
CACHED = 50_000
#: New stretches that are summed at once, and tokens up to which a stretch is summed with the others.
_AT_ONCE, _SHORT = 4096, 8
_TOKEN = re.compile(r"[^\W_]+|[\W_]+")
_STEP = 200_000
#: Row of the token that stands for "the same stretch again".
AGAIN = zlib.crc32(b"\0again") % ROWS
#: Rows of the case patterns: all upper case, all lower case, digits, anything else.
_UPPER, _LOWER, _DIGITS, _MIXED = (zlib.crc32(f"\0{case}".encode()) % ROWS for case in ("A", "a", "1", "Aa"))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def index_vectors() -> np.ndarray:
    """Sparse ternary index vectors of all rows, from a fixed seed."""
    rng = np.random.default_rng(SEED)
    places = rng.random((ROWS, WIDTH)).argpartition(PLACES, axis=1)[:, :PLACES]
    vectors = np.zeros((ROWS, WIDTH), np.int32)
    signs = rng.choice(np.array([-1, 1], np.int32), (ROWS, PLACES))
    np.put_along_axis(vectors, places, signs, axis=1)
    return vectors


def word_rows(chunk: str) -> tuple[int, ...]:
    """Rows of the tokens in a stretch without white space: words in lower case with their case pattern, and marks."""
    rows = []
    # most stretches are one word, which needs no pattern
    for token in (chunk,) if chunk.isalnum() else _TOKEN.findall(chunk):
        if token[0].isalnum():
            case = _LOWER if token.islower() else _UPPER if token.isupper() else _DIGITS if token.isdigit() else _MIXED
            rows += (zlib.crc32(token.lower().encode("utf-8", "replace")) % ROWS, case)
        else:
            rows.append(zlib.crc32(token.encode("utf-8", "replace")) % ROWS)
    return tuple(rows)


@dataclass
class Model:
    """Everything that scoring needs; ``vectors`` has one row per hashed token."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float] | None
    temperature: float = 1.0
    constant: float = 0.5

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(pooled), self.constant)
        x = (pooled - self.mean) / self.scale
        w, b, v, c = self.layers
        z = (np.tanh(x @ w + b) @ v + c) / self.temperature
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class Pool:
    """Means of word vectors over whole texts. The sum of each frequent stretch is kept as a row."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.sums = np.empty((2 * CACHED, WIDTH + 1), np.float32)
        self.free = 0
        self.places: dict[str, int] = {}

    def _keep(self, new: list[str]) -> None:
        """Sum different stretches that have no place yet, many at once; each adds up its own tokens in order."""
        for at in range(0, len(new), _AT_ONCE):
            part = new[at : at + _AT_ONCE]
            rows = [word_rows(c) for c in part]
            lengths = np.array([len(r) for r in rows])
            flat = np.array([r for each in rows for r in each])
            starts = lengths.cumsum() - lengths
            sums = self.vectors[flat[starts]]
            for k in range(1, min(int(lengths.max()), _SHORT)):
                more = np.flatnonzero(lengths > k)
                sums[more] += self.vectors[flat[starts[more] + k]]
            for k in np.flatnonzero(lengths > _SHORT):
                sums[k] = self.vectors[list(rows[k])].sum(0)
            first, self.free = self.free, self.free + len(part)
            self.sums[first : self.free, :WIDTH] = sums
            self.sums[first : self.free, WIDTH] = lengths
            self.places.update(zip(part, range(first, self.free), strict=True))

    def pooled(self, text: str | None) -> np.ndarray:
        """Mean vector and log of the number of tokens; zeros for empty texts."""
        total = np.zeros(WIDTH + 1)
        chunks = (text or "").split()
        again = 0
        for at in range(0, len(chunks), CACHED):
            part = chunks[at : at + CACHED]
            if self.free + len(part) > len(self.sums):
                self.free = 0
                self.places.clear()
            where = [*map(self.places.get, part)]
            if None in where:
                self._keep([*dict.fromkeys(c for c, p in zip(part, where, strict=True) if p is None)])
                where = [*map(self.places.get, part)]
            places = np.array(where)
            total += self.sums[places].sum(0, dtype=np.float64)
            again += int((places[1:] == places[:-1]).sum()) + (at > 0 and chunks[at] == chunks[at - 1])
        total[:WIDTH] += again * self.vectors[AGAIN]
        total[WIDTH] += again
        count = total[WIDTH]
        out = np.zeros(WIDTH + 1)
        if count:
            out[:WIDTH] = total[:WIDTH] / count
            out[WIDTH] = math.log1p(count)
        return out


def context_sums(texts: Iterator[str], index: np.ndarray) -> np.ndarray:
    """Sum of the index vectors around each row's occurrences, over whole texts."""
    sums = np.zeros((ROWS, WIDTH), np.int64)
    rows_of = TwoGenerations(word_rows, CACHED)

    def add(ids: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        starts = np.flatnonzero(np.diff(ids[order], prepend=-1))
        around = np.zeros((len(ids), WIDTH), np.int32)
        for k in range(1, AROUND + 1):
            around[k:] += index[ids[:-k]]
            around[:-k] += index[ids[k:]]
        sums[ids[order][starts]] += np.add.reduceat(around[order], starts, axis=0)

    for text in texts:
        ids, before = [], None
        for chunk in (text or "").split():
            ids += rows_of[chunk]
            if chunk == before:
                ids.append(AGAIN)
            before = chunk
        ids = np.array(ids, np.int64)
        for at in range(0, len(ids), _STEP):
            if len(part := ids[at : at + _STEP]) > AROUND:
                add(part)
    return sums


def word_vectors(sample: DataFrame) -> np.ndarray:
    """Table of word vectors of length 1. A row without contexts keeps its index vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = context_sums((t for batch in batches for t in batch["text"]), index_vectors())
        used = np.flatnonzero(sums.any(axis=1))
        out = pd.DataFrame(sums[used], columns=[f"v{k}" for k in range(WIDTH)])
        out.insert(0, "row", used)
        yield out

    names = [f"v{k}" for k in range(WIDTH)]
    parts = sample.select("text").mapInPandas(run, "row int, " + ", ".join(f"{n} long" for n in names))
    # at most ROWS rows of WIDTH numbers come to the driver, however large the sample
    table = parts.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    vectors = index_vectors().astype(np.float32)
    vectors[table["row"].to_numpy()] = table[names].to_numpy(np.float32)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True).clip(1e-9)


def fit_network(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Two layers by Adam on the log loss."""
    rng = np.random.default_rng(SEED)
    params = [
        rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1),
    ]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at : at + BATCH]
            h = np.tanh(x[rows] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
            d = (p - y[rows]) / len(rows)
            back = np.outer(d, params[2]) * (1 - h * h)
            grads = [x[rows].T @ back, back.sum(0), h.T @ d, np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                g = g + DECAY * params[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                rate = RATE * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                params[k] -= rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    return params[0], params[1], params[2], float(params[3][0])


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature with the least log loss, between 1/4 and 16."""

    def loss(t: float) -> float:
        z = logits / t
        return float(np.mean(np.logaddexp(0, z) - y * z))

    low, high = math.log(0.25), math.log(16)
    for _ in range(50):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(math.exp(a)) < loss(math.exp(b)) else (a, high)
    return math.exp((low + high) / 2)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """Fit on at most ``most_rows`` labelled documents that are not held out.

    Rows with a null doc_id or quality teach nothing, and a doc_id with both labels neither. Of rows
    that repeat a doc_id with different texts the one with the smallest hash teaches. Without
    labels, or with one kind only, the score is their share, 0.5 if there are none.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    each = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    chosen = each.filter("quality = most").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    texts = docs.select(F.col("doc_id").alias("__doc"), "text")
    # the chosen rows are at most most_rows, so broadcasting them is bounded
    met = texts.join(F.broadcast(chosen.select("doc_id", "quality")), F.col("__doc") == F.col("doc_id"))
    # of rows that repeat a doc_id one text teaches, always the same
    once = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    sample = staged(met.groupBy("doc_id", "quality").agg(once).select("doc_id", "text", "quality"), "labelled")
    vectors = word_vectors(sample)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = Pool(shared.value)
        for batch in batches:
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "quality": batch["quality"], "x": [pool.pooled(t).tolist() for t in batch["text"]]}
            )

    pooled = sample.mapInPandas(run, "doc_id long, quality int, x array<double>")
    rows = pooled.toPandas().sort_values("doc_id")
    y = rows["quality"].to_numpy(np.float64)
    if len(set(y)) < 2:
        none = np.zeros(WIDTH + 1)
        return Model(vectors, none, none + 1, None, constant=float(y.mean()) if len(y) else 0.5)
    x = np.array(rows["x"].tolist())
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    aside = np.arange(len(x)) % 5 == 0
    if len(set(y[~aside])) < 2:
        aside[:] = False
    layers = fit_network(x[~aside], y[~aside])
    check = aside if aside.any() else ~aside
    logits = np.tanh(x[check] @ layers[0] + layers[1]) @ layers[2] + layers[3]
    return Model(vectors, mean, scale, layers, fit_temperature(logits, y[check]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` to every row, from its whole text only; null and empty texts get the same score.

    All columns pass; a column named ``score`` is replaced. The model is broadcast: its size is fixed
    by ROWS and WIDTH. Rows leave the worker a few at a time, and one text at a time becomes Python's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema if f.name != "score"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = None
        for batch in in_slices(batches):
            pool = pool or Pool(shared.value.vectors)
            x = np.array([pool.pooled(t.as_py()) for t in batch.column("text")]).reshape(-1, WIDTH + 1)
            scores = pa.array(shared.value.probabilities(x), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "score"])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """Score all documents: doc_id, held_out, score, predicted.

    Repeated rows are scored each. Further columns of either table are not read.
    """
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), most_rows)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
