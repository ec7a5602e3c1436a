"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily from the queries.

The graph starts from random groups. In each round every vector joins its neighbours and some of the
vectors that have it as a neighbour, all of them are compared with each other, and each keeps the
nearest it has seen: neighbours of neighbours are likely neighbours. Rounds are Spark joins on the
middle vector. A query then walks the graph: the nearest vectors seen so far that were not yet
expanded are expanded, until the nearest ones all are. Both loops run until they have converged. The
graph is built and walked on copies with one byte per component; the nearest of a walk are ranked by
cosines of the original vectors in double precision.

A vector has one row with its list, a query one row with its beam: what is told to them is merged into
that row. Widths are the same for every number of vectors, and a walk compares only what its
expanded vectors name, so work grows in proportion. For the walk each vector's links lie beside their
codes in a table bucketed by vector, which no hop shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefacts.llm.embedding_dedup import unit, usable
from sitefacts.sources.storage import bucketed, forget, staged

#: Neighbours kept, reverse neighbours that join, size of the random groups at the start.
NEIGHBOURS, REVERSE, GROUP = 32, 24, 256
#: Candidates that a member is told of by one middle vector in a round.
TOLD = 6
#: Nearest vectors of a query that must all be expanded before its search ends, and how many it expands in a hop.
BEAM, STEP = 160, 32
#: Rounds or hops beyond which something is wrong; an error, never an end.
ENDLESS = 1_000
_LOW = -1.5
_LIST = "ids array<long>, scores array<float>, flags array<boolean>"
_TOLD = "node long, ids array<long>, scores array<float>"


def _codes(vectors: DataFrame) -> DataFrame:
    """(node, code): each vector as one signed byte per component, the largest of them 127."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                codes = []
                for v in batch["vec"]:
                    x = np.asarray(v, np.float64)
                    codes.append(np.rint(x / np.abs(x).max() * 127).astype(np.int8).tobytes())
                yield pd.DataFrame({"node": batch["node"], "code": codes})

    return vectors.select("node", "vec").mapInPandas(run, "node long, code binary")


def _unit_codes(codes: pa.Array) -> np.ndarray:
    """Rows of length 1; shorter vectors are filled up with zeros, which changes no cosine between equal lengths."""
    rows = codes.to_pylist()
    wide = max(map(len, rows))
    x = np.frombuffer(b"".join(r if len(r) == wide else r.ljust(wide, b"\0") for r in rows), np.int8)
    x = x.reshape(len(rows), wide).astype(np.float32)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)).clip(1e-9)


def _lists(offsets: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    at = pa.array(offsets, pa.int32())
    return [pa.ListArray.from_arrays(at, pa.array(v)) for v in values]


def _merge(rows: DataFrame, keep: int, more: tuple[str, ...] = ()) -> DataFrame:
    """One row per key with the ``keep`` best of its own list and of what it is told, best first.

    ``rows`` has key, the columns ``more``, ids, scores, flags and ``told``, an array of lists. Of an
    id that comes several times its own entry stays; what is new gets the flag. Ties to the smaller id.
    """
    names = [rows.columns[0], *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = len(names)
            own = [batch.column(at + k) for k in range(3)]
            told = batch.column(at + 3)
            owner = [np.repeat(np.arange(n), own[0].value_lengths().fill_null(0).to_numpy())]
            entries = [[c.flatten().to_numpy(zero_copy_only=False) for c in own]]
            parts = told.flatten()
            if len(parts):
                lists = [parts.field(k) for k in range(2)]
                sizes = lists[0].value_lengths().fill_null(0).to_numpy()
                row = np.repeat(np.arange(n), told.value_lengths().fill_null(0).to_numpy())
                owner.append(np.repeat(row, sizes))
                ids, scores = (c.flatten().to_numpy(zero_copy_only=False) for c in lists)
                entries.append([ids, scores, np.ones(len(ids), bool)])
            row = np.concatenate(owner)
            ids, scores, flags = (np.concatenate([e[k] for e in entries]) for k in range(3))
            fresh = np.repeat([0, 1][: len(owner)], [len(o) for o in owner])
            order = np.lexsort((fresh, ids, row))
            row, ids, scores, flags = row[order], ids[order], scores[order], flags[order]
            once = np.ones(len(row), bool)
            once[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
            row, ids, scores, flags = row[once], ids[once], scores[once], flags[once]
            order = np.lexsort((ids, -scores, row))
            row, ids, scores, flags = row[order], ids[order], scores[order], flags[order]
            starts = np.searchsorted(row, np.arange(n))
            best = np.arange(len(row)) - starts[row] < keep
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row[best], minlength=n))])
            out = _lists(offsets, ids[best].astype(np.int64), scores[best].astype(np.float32), flags[best].astype(bool))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(at)), *out], names=[*names, "ids", "scores", "flags"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.select(*names, "ids", "scores", "flags", "told").mapInArrow(run, f"{schema}, {_LIST}")


def _compare(groups: DataFrame, most: int) -> DataFrame:
    """Compare the members of each group; tell each member of the ``most`` best others above its limit.

    A row of ``groups`` is one group: members as an array of (id, code, limit, new). Pairs without a
    new member were compared before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            offsets = column.offsets.to_numpy()
            base, flat = int(offsets[0]), column.flatten()
            if not len(flat):
                continue
            ids = flat.field("id").to_numpy()
            limits = flat.field("limit").to_numpy()
            new = flat.field("new").to_numpy(zero_copy_only=False)
            x = _unit_codes(flat.field("code"))
            nodes, sizes, nbrs, scores = [], [], [], []
            for a, b in zip((offsets[:-1] - base).tolist(), (offsets[1:] - base).tolist(), strict=True):
                if b - a < 2:
                    continue
                s = x[a:b] @ x[a:b].T
                fresh = new[a:b]
                s[~(fresh[:, None] | fresh[None, :])] = -2
                s[ids[a:b, None] == ids[None, a:b]] = -2
                s[s <= limits[a:b, None]] = -2
                keep = min(most, b - a - 1)
                best = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                value = np.take_along_axis(s, best, axis=1)
                row, col = np.nonzero(value > -2)
                count = np.bincount(row, minlength=b - a)
                nodes.append(ids[a:b][count > 0])
                sizes.append(count[count > 0])
                nbrs.append(ids[a:b][best[row, col]])
                scores.append(value[row, col])
            if nodes:
                at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
                lists = _lists(at, np.concatenate(nbrs), np.concatenate(scores).astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), *lists], names=["node", "ids", "scores"])

    return groups.mapInArrow(run, _TOLD)


def _members(id_: Column, code: Column, limit: Column, new: Column) -> Column:
    return F.struct(
        id_.cast("long").alias("id"), code.alias("code"), limit.cast("float").alias("limit"), new.alias("new")
    )


def _collected(told: DataFrame, key: str) -> DataFrame:
    return told.groupBy(key).agg(F.collect_list(F.struct("ids", "scores")).alias("told"))


def _edges(lists: DataFrame) -> DataFrame:
    """Lists as rows (node, nbr, score, new)."""
    zipped = F.explode(F.arrays_zip("ids", "scores", "flags"))
    return lists.select("node", zipped.alias("e")).select(
        "node", F.col("e.ids").alias("nbr"), F.col("e.scores").alias("score"), F.col("e.flags").alias("new")
    )


def _reversed(edges: DataFrame, most: int, *order: Column) -> DataFrame:
    """(node, id, new): up to ``most`` of the vectors that have each vector in their list."""
    back = Window.partitionBy("nbr").orderBy(*order)
    ranked = edges.withColumn("__rank", F.row_number().over(back)).filter(F.col("__rank") <= most)
    return ranked.select(F.col("nbr").alias("node"), F.col("node").alias("id"), "new")


def _descent(codes: DataFrame, neighbours: int, reverse: int) -> DataFrame:
    """Lists (node, ids, scores, flags) of ``neighbours`` for each node of (node, code)."""
    length = F.length("code")
    sizes = codes.groupBy(length.alias("n")).agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    sized = codes.join(sizes, length == F.col("n")).withColumn("limit", F.lit(_LOW))
    everyone = _members(F.col("node"), F.col("code"), F.col("limit"), F.lit(True))
    told = None
    for salt in (1, 2):
        group = F.pmod(F.xxhash64("node", F.lit(salt)), F.col("groups"))
        dealt = sized.groupBy("n", group.alias("g")).agg(F.collect_list(everyone).alias("members"))
        start = _compare(dealt.select("members"), neighbours)
        told = start if told is None else told.unionByName(start)
    nothing = {"ids": "array<long>", "scores": "array<float>", "flags": "array<boolean>"}
    empty = codes.select("node", *[F.array().cast(t).alias(c) for c, t in nothing.items()])
    lists = staged(_merge(empty.join(_collected(told, "node"), "node", "left"), neighbours), "graph")
    count = codes.count()
    for _ in range(ENDLESS):
        limit = F.when(F.size("ids") < neighbours, F.lit(_LOW)).otherwise(F.element_at("scores", -1)).alias("limit")
        facts = codes.join(lists.select("node", limit), "node").select(F.col("node").alias("id"), "code", "limit")
        edges = _edges(lists)
        around = edges.select("node", F.col("nbr").alias("id"), "new").union(
            _reversed(edges, reverse, F.col("new").desc(), F.xxhash64("node", "nbr"))
        ).groupBy("node", "id").agg(F.max("new").alias("new"))
        met = around.join(facts, "id").groupBy("node").agg(
            F.collect_list(_members(F.col("id"), F.col("code"), F.col("limit"), F.col("new"))).alias("members")
        )
        told = _collected(_compare(met.select("members"), TOLD), "node")
        old = lists.select("node", "ids", "scores", F.transform("flags", lambda _: F.lit(False)).alias("flags"))
        before, lists = lists, staged(_merge(old.join(told, "node", "left"), neighbours), "graph")
        forget(before)
        changed = lists.agg(F.sum(F.size(F.filter("flags", lambda x: x))).alias("n")).first()["n"] or 0
        if not changed or changed * 1000 < count * neighbours:
            return lists
    raise RuntimeError("the neighbour graph does not converge")


def neighbour_graph(
    vectors: DataFrame, neighbours: int = NEIGHBOURS, reverse: int = REVERSE
) -> DataFrame:
    """NN-descent over (node, vec): edges (node, nbr, score, new), ``neighbours`` for each node.

    Every node is in the graph; vectors of different lengths are never neighbours. Ends when a round
    changes less than one edge in a thousand. Lists are staged between rounds.
    """
    return _edges(_descent(staged(_codes(vectors), "codes"), neighbours, reverse))


def _scores(pairs: DataFrame) -> DataFrame:
    """(query, node, qvec, vec) to (query, node, score): cosines in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.zeros(batch.num_rows)
            lengths = batch.column(2).value_lengths().to_numpy()
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                x, y = (unit(batch.column(k).take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)) for k in (2, 3))
                score[at] = np.clip((x * y).sum(axis=1), -1.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["query", "node", "score"])

    return pairs.select("query", "node", "qvec", "vec").mapInArrow(run, "query long, node long, score double")


def _expand(front: DataFrame) -> DataFrame:
    """Of the links of each expanded node those nearer to the query than its limit: query, ids, scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            links = batch.column(3)
            flat = links.flatten()
            if not len(flat):
                continue
            owner = np.repeat(np.arange(batch.num_rows), links.value_lengths().to_numpy())
            x = _unit_codes(pa.concat_arrays([flat.field("code"), batch.column(1)]))
            y, x = x[len(flat) :], x[: len(flat)]
            score = np.empty(len(flat), np.float32)
            starts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            for k in range(batch.num_rows):
                score[starts[k] : starts[k + 1]] = x[starts[k] : starts[k + 1]] @ y[k]
            near = score > batch.column(2).to_numpy()[owner]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[near], minlength=batch.num_rows))])
            lists = _lists(offsets, flat.field("id").to_numpy()[near], score[near])
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["query", "ids", "scores"])

    return front.select("query", "qvec", "limit", "links").mapInArrow(run, "query long, ids array<long>, scores array<float>")


def search(
    vectors: DataFrame, graph: DataFrame, queries: DataFrame, top: int = 5, beam: int = BEAM, reverse: int = REVERSE
) -> DataFrame:
    """Greedy search of (query, node) starts over the graph: query, rank, node, score.

    Each hop expands the STEP nearest of a query's ``beam`` that were not expanded, over neighbours and
    up to ``reverse`` of the nodes that have them as neighbours. Ends when no query has anything left
    to expand: every node of its beam is expanded. A query's start node is no candidate. Hops
    compare codes; the ``beam`` nearest by codes are ranked by exact cosines.
    """
    codes = staged(_codes(vectors), "codes")
    edges = graph.select("node", "nbr", "score", F.lit(False).alias("new"))
    around = edges.select("node", F.col("nbr").alias("id")).union(
        _reversed(edges, reverse, F.col("score").desc(), F.col("node")).select("node", "id")
    ).distinct()
    named = around.join(codes.withColumnRenamed("node", "id"), "id").groupBy("node").agg(
        F.collect_list(F.struct("id", "code")).alias("links")
    )
    index = bucketed(named, "neighbour_index", ["node"], dealt=True)
    starts = queries.join(codes, "node").select("query", F.col("code").alias("qvec"), F.col("node").alias("start"))
    # flags: not expanded yet; the start is its own nearest
    state = staged(
        starts.select(
            "query", "qvec", F.array("start").alias("ids"), F.array(F.lit(2.0).cast("float")).alias("scores"),
            F.array(F.lit(True)).alias("flags"),
        ),
        "beams",
    )
    for _ in range(ENDLESS):
        limit = F.when(F.size("ids") <= beam, F.lit(_LOW)).otherwise(F.element_at("scores", -1)).alias("limit")
        open_ = F.slice(F.filter("ids", lambda _, i: F.get("flags", i)), 1, STEP)
        front = state.select("query", "qvec", limit, F.explode(open_).alias("node"))
        if front.isEmpty():
            break
        told = _collected(_expand(front.join(index, "node")), "query")
        # what is expanded now is so afterwards; only what comes in is open
        places = F.transform("ids", lambda x: ~F.array_contains("open", x))
        rest = state.withColumn("open", open_).withColumn(
            "flags", F.zip_with("flags", places, lambda f, p: f & p)
        ).drop("open")
        before, state = state, staged(_merge(rest.join(told, "query", "left"), beam + 1, ("qvec",)), "beams")
        forget(before)
    else:
        raise RuntimeError("a search does not end")
    close = state.select("query", F.explode("ids").alias("node")).join(queries.select("query", F.col("node").alias("start")), "query")
    close = close.filter(F.col("node") != F.col("start"))
    own = queries.join(vectors, "node").select("query", F.col("vec").alias("qvec"))
    found = _scores(close.join(vectors, "node").join(own, "query"))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("node"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "query", "rank", "node", "score"
    )


def nearest(rows: DataFrame, every: int = 50, top: int = 5) -> DataFrame:
    """Nearest vectors of every row whose vec_id is divisible by ``every``, among all other rows.

    Returns query_id, rank, vec_id, score. Vectors that are null, empty, all zeros or not finite, and
    rows without a vec_id, take no part; vectors of each length are neighbours of each other only. Equal vectors
    are one node of the graph, so a large group of copies crowds out nothing: every member of a found
    node is ranked, nearest first, ties to the smaller vec_id. Rows that repeat a vec_id with the
    same vector count once. A query has fewer rows if there are fewer candidates, none if there is
    none. Further columns are not read.
    """
    vec = F.transform("embedding", lambda x: x.cast("double"))
    used = rows.select("vec_id", vec.alias("vec")).filter(F.col("vec_id").isNotNull() & usable(F.col("vec"))).distinct()
    firsts = used.groupBy("vec").agg(F.min("vec_id").alias("node"))
    vectors = staged(firsts.select("node", "vec"), "vectors")
    members = staged(
        used.join(vectors, "vec").select("node", "vec_id"), "members"
    )
    graph = neighbour_graph(vectors)
    queries = members.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query"), "node")
    found = search(vectors, graph, queries, top)
    # members of a node are equally near: its first top + 1 by id are enough, the query may be one of them
    order = Window.partitionBy("node").orderBy("vec_id")
    first = members.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= top + 1).drop("__n")
    own = queries.select("query", "node").withColumn("score", F.lit(1.0))
    candidates = found.select("query", "node", "score").unionByName(own).join(first, "node").filter(
        F.col("vec_id") != F.col("query")
    )
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id"))
    return candidates.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select(
        F.col("query").alias("query_id"), F.col("rank").cast("int"), "vec_id", "score"
    )
