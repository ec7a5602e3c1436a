import math

import numpy as np
import pytest

from sitefacts.llm import embedding_dedup, neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, id long, vec string, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "x", 0.5) for i, v, lab in rows], SCHEMA)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(900, 24))
    near = [base[k % 7] + rng.normal(size=24) * (0.02 + 0.03 * (k % 5)) * np.linalg.norm(base[k % 7]) / 5 for k in range(300)]
    every = np.concatenate([base, near, base[:40], base[8:9].repeat(60, 0)]).astype(np.float32)
    rows = [(k * 5, v.tolist(), k % 2 if k >= 900 else k % 3) for k, v in enumerate(every)]
    odd = [(90_001, None, 1), (90_002, [], 1), (90_003, [0.0] * 24, 1), (90_004, [float("nan")] * 24, 1),
           (90_005, [float("inf")] * 24, 0), (90_006, [None] * 24, 0), (90_007, rows[0][1], None), (90_050, [1e-38] * 24, 0)]
    return rows + odd


def usable(rows):
    keep = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    x = np.array([r[1] for r in keep], np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return keep, x / np.linalg.norm(x, axis=1, keepdims=True)


def test_near_copies_equal_brute_force(spark, vectors, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    keep, x = usable(vectors)
    root = {r[0]: r[0] for r in vectors}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = dict.fromkeys(root, 0)
    for a, b in zip(*np.nonzero(x @ x.T >= 0.93), strict=True):
        if a < b and keep[a][2] == keep[b][2] is not None:
            i, j = keep[a][0], keep[b][0]
            links[i] += 1
            links[j] += 1
            if find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    got = {r.vec_id: r for r in embedding_dedup.near_copies(frame(spark, vectors), leaf=100).collect()}
    assert len(got) == len(vectors)
    for k, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == (links[k], find(k), find(k) == k)


def test_near_copies_nulls_and_no_rows(spark):
    one = [1.0, 0.0]
    rows = [(None, one, 1), (3, one, 1), (3, one, 1), (5, [1.0, 0.01], 1), (6, [1.0, 0.0, 0.0], 1)]
    got = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_copies(frame(spark, rows)).collect())
    assert got == [(-1, 0, None, False), (3, 2, 3, True), (3, 2, 3, True), (5, 2, 3, False), (6, 0, 6, True)]
    assert embedding_dedup.near_copies(frame(spark, [])).count() == 0


def test_forest_finds_close_pairs_that_cuts_part():
    rng = np.random.default_rng(1)
    x = embedding_dedup.unit(rng.normal(size=(4000, 64)))
    y = embedding_dedup.unit(x + rng.normal(size=x.shape) * 0.045)
    forest = embedding_dedup.grow(x, 100_000)
    pairs = zip(forest.leaves(x), forest.leaves(y), strict=True)
    assert np.mean([bool(set(a) & set(b)) for a, b in pairs]) > 0.999


def exact(rows, every, top):
    keep, x = usable(rows)
    keep = list({(r[0], tuple(r[1])): r for r in keep}.values())
    _, x = usable(keep)
    ids = np.array([r[0] for r in keep])
    out = {}
    for k in np.flatnonzero(ids % every == 0):
        s = np.round(x @ x[k], 9)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[k]][:top]
        out[int(ids[k])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_neighbours_recall(spark, vectors):
    want = exact(vectors, 50, 5)
    got = {}
    for r in sorted(neighbours.nearest(frame(spark, vectors)).collect()):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for query, rows in got.items():
        assert [r[0] for r in rows] == list(range(1, len(want[query]) + 1))
        assert all(a[2] >= b[2] for a, b in zip(rows, rows[1:], strict=False)) and query not in {r[1] for r in rows}
        worst = want[query][-1][1] - 1e-8
        hits += sum(r[2] >= worst for r in rows)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_search_goes_on_until_nothing_is_left_to_expand(spark):
    # a chain of 20 nodes, the nearest to the start at its far end
    angles = [0.0] + [math.radians(42 - 2 * k) for k in range(1, 21)]
    vectors = spark.createDataFrame([(k, [math.cos(a), math.sin(a)]) for k, a in enumerate(angles)], "node long, vec array<double>")
    chain = spark.createDataFrame([(k, k + 1, 0.5, False) for k in range(20)], "node long, nbr long, score float, new boolean")
    queries = spark.createDataFrame([(0, 0)], "query long, node long")
    got = sorted(neighbours.search(vectors, chain, queries).collect(), key=lambda r: r.rank)
    assert [r.node for r in got] == [20, 19, 18, 17, 16]
    assert [r.score for r in got] == pytest.approx([math.cos(math.radians(2 * k)) for k in range(1, 6)])


def test_graph_goes_on_until_hardly_an_edge_changes(spark):
    # short lists need many rounds
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 8))
    frame_ = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "node long, vec array<double>")
    graph = neighbours.neighbour_graph(frame_, 4, reverse=2)
    assert graph.filter("new").count() * 1000 < 3000 * 4


def test_every_length_has_its_neighbours(spark):
    """Vectors of a rare length are searched among their like, however few they are."""
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(size=16).tolist(), 1) for k in range(700)] + [(1000 + 10 * k, rng.normal(size=7).tolist(), 1) for k in range(40)]
    rows += [(2000, [1.0, 2.0], 1), (2001, [1.0, 2.5], 1), (2050, [1.0, 2.0, 3.0], 1)]
    got = {}
    for r in neighbours.nearest(frame(spark, rows)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got[2000] == {2001} and 2050 not in got
    for part in (rows[:700], rows[700:740]):
        want = exact(part, 50, 5)
        hits = sum(len(got[q] & {v for v, _ in found}) for q, found in want.items())
        assert hits >= 0.9 * 5 * len(want)


def test_few_candidates(spark):
    rows = [(0, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (7, [0.0, 1.0], 2), (None, [1.0, 1.0], 1), (8, [1.0], 1)]
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in neighbours.nearest(frame(spark, rows)).collect())
    assert got == [(0, 1, 50, 1.0), (0, 2, 7, 0.0), (50, 1, 0, 1.0), (50, 2, 7, 0.0)]
    assert neighbours.nearest(frame(spark, [])).count() == 0
    assert neighbours.nearest(frame(spark, [(0, [1.0], 1)])).count() == 0
