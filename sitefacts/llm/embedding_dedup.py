"""Near copies of embeddings by a forest of random-projection trees.

Each tree halves the space again and again at the median along a random direction; a vector close to
a cut goes down both sides. Vectors that share a leaf of any tree are compared, and pairs that reach
the threshold are counted and united. A pair that shares several leaves counts in the smallest of
them, so no list of pairs is made. Equal vectors are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts.llm.common import block_cells, components
from sitefacts.sources.storage import staged

#: Vectors that the trees' directions and medians are fitted on, at most; every vector is then placed.
SAMPLE = 16_384
TREES, LEAF, DEEPEST, SEED = 6, 2000, 12, 11
#: Half the width of the overlap at a cut, for vectors of length 1.
SPILL = 0.03
#: Rows of a leaf that are compared in one task; larger leaves are compared by pairs of blocks.
BLOCK = 2000
_PAIRS = 100_000


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite numbers, not all 0."""
    value = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(value, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled by their largest component first so that squares stay in range."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


@dataclass
class Forest:
    """Inner nodes of all trees; ``left`` and ``right`` are nodes, or leaves as ``-1 - leaf``."""

    directions: np.ndarray
    cuts: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: list[int]

    def leaves(self, vectors: np.ndarray) -> list[list[int]]:
        """Leaves of each vector over all trees, ascending."""
        found: list[list[int]] = [[] for _ in vectors]
        rows = np.tile(np.arange(len(vectors)), len(self.roots))
        nodes = np.repeat(np.array(self.roots), len(vectors))
        while len(rows):
            ended = nodes < 0
            for r, n in zip(rows[ended].tolist(), nodes[ended].tolist(), strict=True):
                found[r].append(-1 - n)
            rows, nodes = rows[~ended], nodes[~ended]
            side = np.einsum("ij,ij->i", vectors[rows], self.directions[nodes]) - self.cuts[nodes]
            left, right = side <= SPILL, side >= -SPILL
            rows, nodes = (
                np.concatenate([rows[left], rows[right]]),
                np.concatenate([self.left[nodes[left]], self.right[nodes[right]]]),
            )
        return [sorted(f) for f in found]


def grow(sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF) -> Forest:
    """Trees whose leaves hold about ``leaf`` of ``rows`` vectors, before overlap."""
    rng = np.random.default_rng(SEED)
    small = max(8.0, leaf * len(sample) / max(rows, 1))
    directions, cuts, left, right, roots = [], [], [], [], []
    leaf_count = 0

    def node(members: np.ndarray, depth: int) -> int:
        nonlocal leaf_count
        if len(members) > small and depth < DEEPEST:
            direction = rng.normal(size=sample.shape[1])
            direction /= np.linalg.norm(direction)
            along = sample[members] @ direction
            cut = float(np.median(along))
            if along.min() < along.max():
                at = len(cuts)
                directions.append(direction)
                cuts.append(cut)
                left.append(0)
                right.append(0)
                left[at] = node(members[along <= cut], depth + 1)
                right[at] = node(members[along > cut], depth + 1)
                return at
        leaf_count += 1
        return -leaf_count

    for _ in range(trees):
        roots.append(node(np.arange(len(sample)), 0))
    width = sample.shape[1] if sample.ndim == 2 else 0
    return Forest(np.array(directions).reshape(-1, width), np.array(cuts), np.array(left, np.int64), np.array(right, np.int64), roots)


def compare(cell: pd.DataFrame, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each row of a cell by class sizes, and a spanning forest of its links."""
    x = unit(np.array(cell["vec"].tolist(), np.float64))
    own, sizes, code = cell["cell_own"].to_numpy(), cell["copies"].to_numpy(), int(cell["leaf"].iloc[0])
    wide = max(map(len, cell["leaves"]))
    leaves = np.array([[*c, *[-1] * (wide - len(c))] for c in cell["leaves"]])
    i, j = int(cell["cell_i"].iloc[0]), int(cell["cell_j"].iloc[0])
    links, edges = np.zeros(len(x), np.int64), []
    root = list(range(len(x)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for at in range(0, len(x), 512):
        a, b = np.nonzero(x[at : at + 512] @ x.T >= threshold)
        a = a + at
        here = (a < b) & (np.minimum(own[a], own[b]) == i) & (np.maximum(own[a], own[b]) == j)
        a, b = a[here], b[here]
        for start in range(0, len(a), _PAIRS):
            p, q = a[start : start + _PAIRS], b[start : start + _PAIRS]
            smallest = np.full(len(p), np.iinfo(np.int64).max)
            for k in range(wide):
                column = leaves[p, k]
                shared = (column >= 0) & (leaves[q] == column[:, None]).any(axis=1)
                smallest = np.where(shared, np.minimum(smallest, column), smallest)
            p, q = p[smallest == code], q[smallest == code]
            np.add.at(links, p, sizes[q])
            np.add.at(links, q, sizes[p])
            for u, v in zip(p.tolist(), q.tolist(), strict=True):
                ru, rv = find(u), find(v)
                if ru != rv:
                    root[rv] = ru
                    edges.append((u, v))
    return links, edges


def near_copies(
    rows: DataFrame, threshold: float = 0.93, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE
) -> DataFrame:
    """One row per vector (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors are compared if their labels are equal and not null. A vector that is null, empty, all
    zeros or not finite, or whose vec_id or label is null, links with nothing and is its own
    component. Vectors of different lengths don't link. Rows that repeat a vec_id count as vectors of
    their own, but what links to one of them is told of all. Further columns are not read.
    """
    vec = F.transform("embedding", lambda x: x.cast("double"))
    all_rows = rows.select("vec_id", "label", vec.alias("vec"))
    part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec"))
    classes = staged(
        all_rows.filter(part).groupBy("label", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")),
        "vectors",
    )
    lengths = [r.n for r in classes.select(F.size("vec").alias("n")).distinct().orderBy("n").limit(1000).collect()]
    if len(lengths) == 1000:
        raise ValueError("embeddings of 1000 lengths or more")
    told = None
    for length in lengths:
        own = classes.filter(F.size("vec") == length)
        chosen = own.orderBy(F.xxhash64("id", "label"), "id").limit(sample).select("vec").collect()
        forest = grow(unit(np.array([r.vec for r in chosen], np.float64)), own.count(), trees, leaf)
        shared = rows.sparkSession.sparkContext.broadcast(forest)

        def place(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    leaves = shared.value.leaves(unit(np.array(batch["vec"].tolist(), np.float64)))
                    yield batch.assign(leaves=leaves)

        def cell(part: pd.DataFrame) -> pd.DataFrame:
            links, edges = compare(part, threshold)
            ids = part["id"].to_numpy()
            some = np.flatnonzero(links)
            counted = pd.DataFrame({"a": ids[some], "b": ids[some], "links": links[some]})
            united = pd.DataFrame([(ids[u], ids[v], 0) for u, v in edges], columns=["a", "b", "links"], dtype="int64")
            return pd.concat([counted, united])

        label = classes.schema["label"].dataType.simpleString()
        placed = own.mapInPandas(
            place, f"label {label}, vec array<double>, id long, copies long, leaves array<int>"
        ).withColumn("leaf", F.explode("leaves")).withColumn("key", F.concat_ws(" ", "leaf", F.col("label").cast("string")))
        found = block_cells(placed, "key", "id", BLOCK).groupBy("key", "cell_i", "cell_j").applyInPandas(
            cell, "a long, b long, links long"
        )
        told = found if told is None else told.unionByName(found)
    if told is None:
        told = rows.sparkSession.createDataFrame([], "a long, b long, links long")
    told = staged(told, "links")
    counts = told.filter("links > 0").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    united = components(classes.select("id").distinct(), told.filter("links = 0"))
    known = classes.join(counts, "id", "left").join(united, "id").select(
        F.col("label").alias("__label"), F.col("vec").alias("__vec"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component",
    )
    same = F.col("vec_id").isNotNull() & (F.col("label") == F.col("__label")) & (F.col("vec") == F.col("__vec"))
    out = all_rows.join(known, same, "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
