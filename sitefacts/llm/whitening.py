"""Principal components of embeddings by contour integration (FEAST), and vectors whitened with them.

Moments are exact integers summed by Spark, so they do not depend on the order of the rows. The top of
the spectrum is cut into intervals by inertia counts (signs of the pivots of a symmetric
factorisation). Each interval is a task: solves with the covariance shifted to complex points around
the interval, weighted by a quadrature rule, project random vectors onto its eigenspace, and
Rayleigh-Ritz takes the eigenpairs out. The inertia count says how many there must be; fewer or more
and the task goes on with a larger space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An entry c becomes floor(SCALE * c) + SHIFT (fixed values); numbers beyond +-SATURATED stop there.
SCALE, SHIFT, SATURATED = 64, 1_000_000, 2**62
COMPONENTS = 32
#: Eigenvalues that one contour takes, points of its quadrature rule, rounds of refinement at most.
PER_CONTOUR, POINTS, ROUNDS, SEED = 8, 8, 30, 5
#: Groups in which partial results of tasks meet before the last merge.
MERGES = 64
_EXACT = 2**26


# --- vectors --------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Not null, no null, NaN or infinite entry."""
    value = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def integers(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of each vector length in a batch with their integer vectors."""
    column = batch["vector"]
    lengths = np.diff(column.offsets.to_numpy())
    flat, start = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    whole = np.clip(np.floor(flat * float(SCALE)), -SATURATED, SATURATED).astype(np.int64) + SHIFT
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        yield at, whole[start[at][:, None] + np.arange(length)]


def whole_products(y: np.ndarray) -> tuple[list, np.ndarray]:
    """Exact sums of products of the columns of ``y`` as Python integers, and a rest for huge entries only.

    Sums of products below 2^53 are exact in doubles; rows are taken as many at a time as allow that.
    """
    width = y.shape[1]
    top = int(np.abs(y).max(initial=0))
    if top > _EXACT:
        x = y.astype(np.float64)
        return [[0] * width for _ in range(width)], x.T @ x
    rows = max(1, 2**53 // max(1, top * top))
    total = np.zeros((width, width), np.int64)
    parts = []
    for at in range(0, len(y), rows):
        x = y[at : at + rows].astype(np.float64)
        parts.append((x.T @ x).astype(np.int64))
        if len(parts) == 512:
            parts = [sum(p.astype(object) for p in parts)]
    total = sum((p.astype(object) for p in parts), total.astype(object))
    return total.tolist(), np.zeros((width, width))


# --- spectrum -------------------------------------------------------------------------


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues above ``shift``: positive pivots of the factorisation of ``matrix - shift``.

    Pivots are the largest diagonal entry, or a 2 x 2 block where the diagonal is too small; a block
    with a negative determinant has one positive and one negative eigenvalue.
    """
    a = matrix - shift * np.eye(len(matrix))
    above = 0
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        p = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diagonal(a)))
        q, r = divmod(int(off.argmax()), len(a))
        if diagonal[p] >= 0.64 * off[q, r]:
            if diagonal[p] == 0:
                break
            keep = [p]
            above += bool(a[p, p] > 0)
        else:
            keep = [q, r]
            block = a[np.ix_(keep, keep)]
            both = np.linalg.det(block) > 0
            above += (2 if block[0, 0] > 0 else 0) if both else 1
        rest = np.delete(np.arange(len(a)), keep)
        side = a[np.ix_(rest, keep)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(keep, keep)], side.T)
        a = (a + a.T) / 2
    return above


def slices(matrix: np.ndarray, wanted: int, most: int = PER_CONTOUR) -> list[tuple[float, float, int]]:
    """Intervals ``(low, high, eigenvalues)`` that together hold the ``wanted`` largest, from the top.

    Halved until none holds more than ``most``, unless its eigenvalues are equal within rounding.
    """
    radius = np.abs(matrix).sum(axis=1)
    high = float(radius.max())
    tiny = (high or 1.0) * 1e-12
    low, high = -high - tiny, high + tiny
    size = len(matrix)
    wanted = min(wanted, size)
    # what lies below ``floor`` is not wanted: the cut moves down to the wanted count, by halving
    floor, above, left, right = low, size, low, high
    while above > wanted and right - left > tiny:
        middle = (left + right) / 2
        count = count_above(matrix, middle)
        if count >= wanted:
            floor, above, left = middle, count, middle
        else:
            right = middle
    out, open_ = [], [(floor, high, above, 0)]
    while open_:
        a, b, above_a, above_b = open_.pop()
        inside = above_a - above_b
        if inside <= most or b - a <= 4 * tiny:
            out += [(a, b, inside)] * bool(inside)
            continue
        middle = (a + b) / 2
        count = count_above(matrix, middle)
        open_ += [(a, middle, above_a, count), (middle, b, count, above_b)]
    return out


def contour(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues in ``[low, high]``, ascending, with orthonormal vectors.

    The projector is the integral of the resolvent around the interval. A Gauss-Legendre rule on the
    upper half circle stands for it; the lower half is its conjugate. One solve per point and round.
    """
    size = len(matrix)
    scale = float(np.linalg.norm(matrix)) or 1.0
    centre, radius = (low + high) / 2, max((high - low) / 2, scale * 1e-9)
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    turn = np.exp(1j * np.pi * (1 - nodes) / 2)
    shifted = [matrix - (centre + radius * t) * np.eye(size) for t in turn]
    rng = np.random.default_rng(SEED)
    basis = np.linalg.qr(rng.normal(size=(size, min(size, count + max(4, count // 2)))))[0]
    for turns in range(ROUNDS):
        projected = np.zeros_like(basis)
        for t, w, m in zip(turn, weights, shifted, strict=True):
            projected += 0.5 * w * radius * (t * np.linalg.solve(m, -basis.astype(complex))).real
        basis = np.linalg.qr(projected)[0]
        values, small = np.linalg.eigh(basis.T @ matrix @ basis)
        vectors = basis @ small
        inside = (values >= low - 1e-13 * scale) & (values <= high + 1e-13 * scale)
        residual = np.linalg.norm(matrix @ vectors - vectors * values, axis=0)
        settled = inside & (residual <= 2e-15 * scale * np.sqrt(size))
        if settled.sum() == inside.sum() == count or basis.shape[1] == size:
            break
        if turns % 3 == 2:  # eigenvalues just outside pass the filter too: room for them
            more = rng.normal(size=(size, min(size, 2 * basis.shape[1]) - basis.shape[1]))
            vectors = np.linalg.qr(np.hstack([vectors, more]))[0]
        basis = vectors
    if inside.sum() < count:
        raise ArithmeticError(f"{int(inside.sum())} of {count} eigenvalues found in [{low}, {high}]")
    if inside.sum() > count:  # equal to an end within rounding: the neighbour counts them
        best = np.argsort(np.maximum(low - values, values - high))[:count]
        inside = np.isin(np.arange(len(values)), best)
    return values[inside], vectors[:, inside]


def rayleigh_ritz(matrix: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of ``matrix`` in the span of ``vectors``, largest first."""
    basis = np.linalg.qr(vectors)[0]
    values, small = np.linalg.eigh(basis.T @ matrix @ basis)
    return values[::-1], (basis @ small)[:, ::-1]


# --- fit ------------------------------------------------------------------------------


@dataclass
class Fit:
    """Whitening of vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of x - S/n, projected and scaled; NaN for components without variance."""
        base = [s // self.n for s in self.sums]
        rest = np.array([(s - b * self.n) / self.n for s, b in zip(self.sums, base, strict=True)])
        centred = (x - np.array(base, np.int64)).astype(np.float64) - rest
        scaled = np.where(self.positive(), self.values, np.nan)
        return centred @ self.vectors / np.sqrt(scaled)

    def positive(self) -> np.ndarray:
        return self.values > max(self.trace, 0.0) * 1e-13

    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace > 0 else np.full(len(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)^2, exact."""
        base = [s // self.n for s in self.sums]
        y = x - np.array(base, np.int64)
        rest = np.array([s - b * self.n for s, b in zip(self.sums, base, strict=True)], np.int64)
        top = (int(np.abs(y).max(initial=0)) + 1) * self.n
        if top * top * max(1, x.shape[1]) < 2**63:
            d = self.n * y - rest
            return (d * d).sum(axis=1).tolist()
        d = self.n * y.astype(object) - rest.astype(object)
        return (d * d).sum(axis=1).tolist()


def _sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and exact sums per dimension, of each vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in integers(batch):
                # halves, so that sums of a batch stay in range
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                d = x.shape[1]
                yield pa.RecordBatch.from_pydict(
                    {"length": [d] * (d + 1), "i": [*range(d), -1], "high": [*high.tolist(), 0], "low": [*low.tolist(), len(x)]},
                    pa.schema([("length", pa.int64()), ("i", pa.int64()), ("high", pa.int64()), ("low", pa.int64())]),
                )

    parts = vectors.mapInArrow(run, "length long, i long, high long, low long")
    totals = parts.groupBy("length", "i").agg(
        *[F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("high", "low")]
    )
    found: dict[int, dict[int, int]] = {}
    for r in totals.collect():  # a number per dimension
        found.setdefault(r["length"], {})[r["i"]] = int(r["high"]) * 2**32 + int(r["low"])
    return {d: (s[-1], [s[i] for i in range(d)]) for d, s in sorted(found.items())}


def _covariances(vectors: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Covariance of each vector length, from products of entries centred at their rounded mean."""
    centres = {d: np.array([s // n for s in of], np.int64) for d, (n, of) in sums.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total: dict[int, list] = {}
        for batch in batches:
            for _, x in integers(batch):
                d = x.shape[1]
                whole, rest = whole_products(x - centres[d])
                if d in total:
                    total[d][0] += np.array(whole, object).reshape(d, d)
                    total[d][1] += rest
                else:
                    total[d] = [np.array(whole, object).reshape(d, d), rest]
        for d, (whole, rest) in total.items():
            for i in range(d):
                yield pa.RecordBatch.from_pydict(
                    {"length": [d] * d, "i": [i] * d, "j": list(range(d)),
                     "whole": [Decimal(int(w)) for w in whole[i]], "rest": rest[i].tolist()},
                    pa.schema([("length", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("whole", pa.decimal128(38, 0)), ("rest", pa.float64())]),
                )

    parts = vectors.mapInArrow(run, "length long, i long, j long, whole decimal(38,0), rest double").filter("j <= i")
    totals = parts.groupBy("length", "i", "j").agg(F.sum("whole").alias("whole"), F.sum("rest").alias("rest"))
    out = {d: np.zeros((d, d)) for d in sums}
    for r in totals.toLocalIterator():  # half a number per pair of dimensions
        d, i, j = r["length"], r["i"], r["j"]
        n, of = sums[d]
        t = [of[k] - n * int(centres[d][k]) for k in (i, j)]
        exact = (n * int(r["whole"]) - t[0] * t[1]) / (n * n)
        out[d][i, j] = out[d][j, i] = exact + r["rest"] / n
    return out


def fits(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """Fit of each vector length: moments by Spark, each interval of the spectrum in a task of its own.

    The driver holds moments and components, a few numbers per pair of dimensions, and no vectors.
    """
    sums = _sums(vectors)
    matrices = _covariances(vectors, sums)
    cuts = [
        (d, k, *cut) for d, m in matrices.items() for k, cut in enumerate(slices(m, components) if d else [])
    ]
    if not cuts:
        return {}
    spark = vectors.sparkSession
    schema = "length long, k long, low double, high double, inside long"
    shared = spark.sparkContext.broadcast({d: m.tobytes() for d, m in matrices.items()})

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                matrix = np.frombuffer(shared.value[r.length]).reshape(r.length, r.length)
                _, vectors = contour(matrix, r.low, r.high, int(r.inside))
                yield pd.DataFrame({"length": [r.length], "basis": [np.ascontiguousarray(vectors.T).tobytes()]})

    tasks = spark.createDataFrame(cuts, schema).repartition(len(cuts), "length", "k")
    bases: dict[int, list[np.ndarray]] = {}
    for r in tasks.mapInPandas(solve, "length long, basis binary").collect():
        bases.setdefault(r["length"], []).append(np.frombuffer(r["basis"]).reshape(-1, r["length"]).T)
    out = {}
    for d, parts in bases.items():
        values, basis = rayleigh_ritz(matrices[d], np.hstack(parts))
        out[d] = Fit(*sums[d], values[:components], basis[:, :components], float(np.trace(matrices[d])))
    return out


def merged(moments: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and centred products of the union of several sets."""
    n, mean, products = moments[0]
    for m, other, theirs in moments[1:]:
        gap = other - mean
        products = products + theirs + np.outer(gap, gap) * (n * m / (n + m))
        mean = mean + gap * (m / (n + m))
        n += m
    return n, mean, products


def identity_errors(vectors: DataFrame, found: dict[int, Fit]) -> dict[int, float]:
    """Largest deviation of the covariance of the whitened vectors from the identity, by a pass over them.

    Each task sums products centred at its own mean; tasks' results are merged in two steps.
    """
    fit_of = vectors.sparkSession.sparkContext.broadcast(found)
    schema = "length long, part long, n long, mean binary, products binary"

    def pack(d: int, part: int, moments: tuple) -> dict:
        n, mean, products = moments
        return {"length": [d], "part": [part], "n": [n], "mean": [mean.tobytes()], "products": [products.tobytes()]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for _, x in integers(batch):
                if (fit := fit_of.value.get(x.shape[1])) is None:
                    continue
                w = fit.whitened(x)[:, fit.positive()]
                centred = w - w.mean(axis=0)
                total.setdefault(x.shape[1], []).append((len(w), w.mean(axis=0), centred.T @ centred))
                total[x.shape[1]] = [merged(total[x.shape[1]])]
        for d, (one,) in total.items():
            yield pa.RecordBatch.from_pydict(
                pack(d, TaskContext.get().partitionId() % MERGES, one),
                pa.schema([("length", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("mean", pa.binary()), ("products", pa.binary())]),
            )

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        d, part = int(rows["length"].iloc[0]), int(rows["part"].iloc[0])
        means = [np.frombuffer(m) for m in rows["mean"]]
        products = [np.frombuffer(p).reshape(len(m), len(m)) for m, p in zip(means, rows["products"], strict=True)]
        return pd.DataFrame(pack(d, part, merged(list(zip(rows["n"].tolist(), means, products, strict=True)))))

    parts = vectors.mapInArrow(run, schema).groupBy("length", "part").applyInPandas(merge, schema)
    whole = parts.groupBy("length").applyInPandas(merge, schema)
    out = {}
    for r in whole.collect():  # one row per vector length
        size = len(np.frombuffer(r["mean"]))
        covariance = np.frombuffer(r["products"]).reshape(size, size) / r["n"]
        out[r["length"]] = float(np.abs(covariance - np.eye(size)).max(initial=0.0))
    return out


# --- operator -------------------------------------------------------------------------


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened vectors: vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error.

    A row per usable vector and component, the first ``components`` or as many as it has dimensions.
    Vectors that are null or hold null or non-finite entries are left out, empty vectors have no components.
    Vectors of each length are a fit list of their own. A component without variance (of equal vectors,
    say) has whitened null and takes no part in identity_error; explained is null where nothing varies.
    deviation is null where it has over 38 digits. Repeated rows and null ids give rows each; further
    columns are not read. Four passes over the vectors, and no shuffle but of moments.
    """
    vector = F.transform("embedding", lambda x: x.cast("double")).alias("vector")
    vectors = embeddings.filter(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), vector)
    found = fits(vectors, components)
    errors = identity_errors(vectors, found) if found else {}
    fit_of = embeddings.sparkSession.sparkContext.broadcast((found, errors))
    schema = pa.schema([
        ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)),
        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, errors = fit_of.value
        for batch in batches:
            ids = batch["vec_id"]
            for at, x in integers(batch):
                if (fit := found.get(x.shape[1])) is None:
                    continue
                k = len(fit.values)
                w = fit.whitened(x).ravel()
                deviation = pa.array([Decimal(v) if v < 10**38 else None for v in fit.deviations(x)], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(len(x)), k))
                explained = np.tile(fit.explained(), len(x))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(w), fit.n)),
                        deviation.take(each),
                        pa.array(w, mask=np.isnan(w)),
                        pa.array(explained, mask=np.isnan(explained)),
                        pa.array(np.full(len(w), errors[x.shape[1]])),
                    ],
                    schema=schema,
                )

    return vectors.mapInArrow(run, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
