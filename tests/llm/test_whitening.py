"""Whitening against numpy's dense eigensolver and exact integer arithmetic."""

import math

import numpy as np
import pytest

from sitefacts.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string"


def symmetric(size, values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))[0]
    m = q @ np.diag(values) @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize(
    "values",
    [np.arange(1.0, 41), np.r_[np.zeros(10), np.ones(20), np.full(10, 5.0)], np.geomspace(1e-8, 1e8, 40),
     np.r_[1.0, 1 + 1e-9, 1 + 2e-9, np.linspace(2, 3, 20)], np.zeros(6), np.array([7.0])],
)
def test_contours_find_all(values):
    m = symmetric(len(values), values)
    own = np.sort(np.linalg.eigvalsh(m))[::-1]
    top = np.abs(own).max()
    for shift in (-1.0, 0.5, 2.5, 1e3):
        assert W.count_above(m, shift) == (own > shift).sum()
    cuts = W.slices(m, 12)
    assert sum(c for *_, c in cuts) >= min(12, len(values))
    parts = [W.contour(m, *cut)[1] for cut in cuts]
    got, vectors = W.rayleigh_ritz(m, np.hstack(parts))
    k = min(12, len(values))
    assert np.allclose(got[:k], own[:k], rtol=0, atol=1e-11 * max(top, 1e-300) * len(values))
    assert np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-12)
    assert np.linalg.norm(m @ vectors - vectors * got, axis=0).max(initial=0) <= 1e-10 * max(top, 1e-300)


def test_two_by_two_pivots():
    m = np.array([[0.0, 1.0, 0.0], [1.0, 0.0, 2.0], [0.0, 2.0, 0.0]])
    assert [W.count_above(m, s) for s in (-3.0, -1.0, 0.5, 3.0)] == [3, 2, 1, 0]


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for top in (100, 2**25):
        y = rng.integers(-top, top, size=(300, 5))
        whole, rest = W.whole_products(y)
        assert whole == (y.astype(object).T @ y.astype(object)).tolist() and not rest.any()
    whole, rest = W.whole_products(np.full((2, 2), 2**40))
    assert not np.any(np.array(whole)) and rest[0, 0] == 2.0**81


def plain(vectors, components):
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    centred = np.array([[(n * r[i] - sums[i]) / n for i in range(d)] for r in x])
    v = centred.T @ centred / n
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    deviations = [sum((n * r[i] - sums[i]) ** 2 for i in range(d)) for r in x]
    return n, deviations, centred @ basis / np.sqrt(values), values / np.trace(v)


def test_operator(spark):
    rng = np.random.default_rng(4)
    # long tails, an offset and correlated dimensions
    data = (rng.normal(size=(700, 40)) @ rng.normal(size=(40, 40)) + 3).astype(np.float32)
    rows = [(i, v.tolist(), 1, 5, "x") for i, v in enumerate(data)]
    bad = [(900, None), (901, [*data[0][:39].tolist(), None]), (902, [float("nan")] * 40), (903, [float("inf")] * 40), (904, [])]
    df = spark.createDataFrame(rows + [(*b, 1, 5, "x") for b in bad], SCHEMA).repartition(7)
    got = W.whiten(df).collect()
    n, deviations, whitened, explained = plain(data, 32)
    assert len(got) == 700 * 32 and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert got[0].identity_error < 1e-9
    ours = np.zeros((700, 32))
    for r in got:
        ours[r.vec_id, r.component - 1] = r.whitened
        assert int(r.deviation) == deviations[r.vec_id]
        assert abs(r.explained - explained[r.component - 1]) <= 1e-9 * explained[r.component - 1]
    signs = np.sign((ours * whitened).sum(axis=0))
    assert np.allclose(ours * signs, whitened, atol=1e-8)


def test_edges(spark):
    # equal vectors, a single one, another length, repeats, huge entries
    same = [(i, [1.0, 2.0, 3.0], 0, 0, "x") for i in range(4)]
    got = W.whiten(spark.createDataFrame(same, SCHEMA)).collect()
    assert len(got) == 12 and all(r.whitened is None and r.deviation == 0 and r.explained is None for r in got)
    assert {r.identity_error for r in got} == {0.0}
    mixed = [(1, [0.0, 1.0], 0, 0, "x"), (1, [0.0, 1.0], 0, 0, "x"), (None, [1.0, 0.5], 0, 0, "x"), (4, [9.0], 0, 0, "x"), (5, [1e30, 0.0], 0, 0, "x")]
    got = W.whiten(spark.createDataFrame(mixed, SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.component, r.n) for r in got) == sorted(
        [(str(v), k, 4) for v in (1, 1, None, 5) for k in (1, 2)] + [("4", 1, 1)]
    )
    assert all(r.identity_error <= 1e-4 for r in got)
    assert W.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_large_deviations_stay_exact():
    fit = W.Fit(10**9, [3 * 10**9 + 1, 5], np.ones(2), np.eye(2), 2.0)
    x = np.array([[400, 7], [3, 0]])
    assert fit.deviations(x) == [sum((10**9 * int(a) - s) ** 2 for a, s in zip(r, fit.sums)) for r in x]
