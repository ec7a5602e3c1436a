"""Exact Jaccard self-join of documents on word shingles, with adaptive multi-match prefixes.

A document's shingles are put in one global order, rare ones first. Two documents that reach the
threshold share at least ``m`` of their first ``p + m - 1`` shingles, for every ``m``. Each document chooses
its own ``m``: the longer the lists its prefix meets, the longer the prefix and the more shared tokens it
asks for; a pair asks for the smaller of its two. Pairs that share enough are verified on whole sets.

Documents with equal sets are one class from the start. In a list of many documents, pairs aren't
counted but sieved by parity bitmaps, whose distance never exceeds that of the sets, and joined star by
star; then only pairs between different components are left to verify. So groups of near copies cost
links in proportion to their size, and still no component is missed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefacts.llm.common import block_cells, components, in_slices
from sitefacts.sources.storage import bucketed, forget, staged

#: Tokens that are known as frequent, at most: those that most documents hold. It only decides the order
#: of tokens, which may be any; beyond it tokens count as rare and cost more comparisons.
FREQUENT = 200_000
#: Longest multi-match prefix, cost of a verification and of a longer prefix, in list entries.
MOST_MATCHES, VERIFY_COST, PREFIX_COST = 4, 20, 8
#: Lists up to this size are joined pair by pair, longer ones by stars of bitmaps.
SMALL_LIST = 16
BITS = 2048
#: Words of a bitmap that are compared first: parts of bitmaps differ in no more bits than the whole.
HEAD = 8
#: Partners of a member in the turns that unite what stars left apart; the last turn tries all pairs left.
PARTNERS = (3, 12, None)
#: Members of a list that are compared in one task; longer lists are compared by pairs of blocks.
BLOCK = 4096
#: Blocks into which the pairs of a document are dealt to be verified.
VERIFY_BLOCKS = 16
_FLUSH = 4_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingles(text: str | bytes | None, size: int = 3) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a text (bytes: UTF-8), A-Z in lower case."""
    data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    # bytes split at exactly the blanks that separate words
    words = data.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total = (total ^ hashes[k : len(words) - size + 1 + k]) * _ODD[k % 3]
        total ^= total >> np.uint64(29)
    total.sort()
    return total[np.append(True, total[1:] != total[:-1])]


def distances(bits: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Bits in which rows of bitmaps differ."""
    return np.bitwise_count(bits ^ other).sum(axis=-1, dtype=np.int64)


def needed(n: int, percent: int) -> int:
    """Smallest overlap of a set of ``n`` with any set that reaches the threshold."""
    return -(-percent * n // 100)


def frequent_tokens(docs: DataFrame, size: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of many different sets, ascending, with how many were seen.

    A task counts tokens over its documents, equal sets once, and tells those it met three times or
    more; a token of many documents is told by some tasks, however many there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, sets = [], 0, set()

        def tell() -> pa.RecordBatch:
            every = np.concatenate(held)
            held.clear()
            every.sort()
            tokens = np.unique(every[2:][every[2:] == every[:-2]])
            counts = np.searchsorted(every, tokens, side="right") - np.searchsorted(every, tokens)
            return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts)], names=["token", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                tokens = shingles(text.as_py(), size)
                mark = xxhash.xxh64_intdigest(tokens.tobytes())
                if mark in sets or not len(tokens):
                    continue
                sets.add(mark)
                held.append(tokens)
                waiting += len(tokens)
                if waiting >= _FLUSH:
                    yield tell()
                    waiting, sets = 0, set()
        if held:
            yield tell()

    told = docs.select("text").mapInArrow(run, "token long, n long")
    total = told.groupBy("token").agg(F.sum("n").alias("n")).filter("n >= 6")
    rows = total.orderBy(F.col("n").desc(), "token").limit(most).toPandas()
    tokens, counts = rows["token"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def features(docs: DataFrame, size: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n, mark, bits, prefix of every document; no mark, bits and prefix for empty sets."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for batch in in_slices(batches):
            ns, marks, bits, prefixes = [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                tokens = shingles(text.as_py(), size)
                n = len(tokens)
                ns.append(n)
                if not n:
                    marks.append(None)
                    bits.append(None)
                    prefixes.append(None)
                    continue
                weight = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    weight = np.where(known[at] == tokens, counts[at], 0)
                keep = n - needed(n, percent) + MOST_MATCHES
                marks.append(xxhash.xxh128_digest(tokens.tobytes()))
                parity = np.bincount((tokens >> np.uint64(17)).astype(np.int64) % BITS, minlength=BITS) & 1
                bits.append(np.packbits(parity.astype(np.uint8)).tobytes())
                # tokens ascend already
                prefixes.append(tokens[np.argsort(weight, kind="stable")[:keep]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(marks, pa.binary()), pa.array(bits, pa.binary()),
                 pa.array(prefixes, pa.list_(pa.int64()))],
                names=["doc_id", "n", "mark", "bits", "prefix"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, mark binary, bits binary, prefix array<long>"
    )


def listed(postings: DataFrame) -> DataFrame:
    """Add ``size``, the length of its token's list, to (token, doc_id, n, pos); tokens of one document go.

    One pass over lists in order of tokens. A list is held in the worker as three numbers per entry.
    """
    names = ["token", "doc_id", "n", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def tell(rows: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.diff(rows[0], prepend=~rows[0][:1]))
            lengths = np.diff(np.append(starts, rows.shape[1]))
            sizes = np.repeat(lengths, lengths)
            some = sizes > 1
            return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (*rows, sizes)], names=[*names, "size"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(k).to_numpy() for k in range(4)])
            last = rows[0, -1]
            if held and held[-1][0, -1] == rows[0, 0] == last:
                held.append(rows)
                continue
            rows = np.concatenate([*held, rows], axis=1)
            cut = int(np.searchsorted(rows[0], last))
            if cut:
                yield tell(rows[:, :cut])
            held = [rows[:, cut:]]
        if held:
            yield tell(np.concatenate(held, axis=1))

    dealt = postings.select(*names).repartition(F.col("token")).sortWithinPartitions("token")
    return dealt.mapInArrow(run, "token long, doc_id long, n long, pos long, size long")


def matches(lists: DataFrame, percent: int) -> DataFrame:
    """The entries (token, doc_id, n, size, asks) that each document uses, and how many shared ones it asks for.

    A document's own number of matches comes from the lengths of the lists that its prefixes meet. Entries are
    dealt by document once, for both.
    """
    own, document = Window.partitionBy("doc_id", "n"), Window.partitionBy("doc_id")
    plain = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    met = lists.repartition("doc_id").select("token", "doc_id", "n", "pos", "size", *[
        F.coalesce(F.sum(F.when(F.col("pos") < plain + m - 1, F.col("size"))).over(own), F.lit(0)).alias(f"s{m}")
        for m in range(1, MOST_MATCHES + 1)
    ])
    cost = {m: PREFIX_COST * (m - 1) + F.col(f"s{m}") + VERIFY_COST * F.col(f"s{m}") / m for m in range(1, MOST_MATCHES + 1)}
    # a set can't be asked for more shared tokens than it needs to link
    enough_tokens = F.ceil(F.col("n") * percent / 100)
    costs = [F.when(F.lit(m) <= enough_tokens, F.struct(c.alias("cost"), F.lit(m).alias("m"))) for m, c in cost.items()]
    chosen = met.withColumn("matches", F.least(*costs)["m"])
    asked = chosen.withColumn("asks", F.min("matches").over(document))
    return asked.filter(F.col("pos") < plain + F.col("matches") - 1).select("token", "doc_id", "n", "size", "asks")


def small_pairs(used: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share as many lists up to SMALL_LIST as they ask for; a < b.

    Sizes that differ too much to link are left out at once.
    """
    entry = F.struct("doc_id", "n", "asks")
    each = used.filter(F.col("size") <= SMALL_LIST).groupBy("token").agg(F.sort_array(F.collect_list(entry)).alias("m"))
    pairs = F.flatten(
        F.transform("m", lambda x, i: F.transform(
            F.filter(
                F.slice(F.col("m"), i + 2, F.size("m")),
                lambda y: (x["doc_id"] < y["doc_id"]) & (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])),
            ),
            lambda y: F.struct(x["doc_id"].alias("a"), y["doc_id"].alias("b"), F.least(x["asks"], y["asks"]).alias("asks")),
        ))
    )
    shared = each.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared"), F.min("p.asks").alias("asks"))
    return shared.filter("shared >= asks").select("a", "b")


def sieve(cells: DataFrame, percent: int, across: bool, partners: int | None = None, turn: int = 0) -> DataFrame:
    """Pairs (a, b) of long lists that bitmaps can't tell apart, and the members of cells that may have more of them.

    By stars: a member is paired with the first one it may link to, and is no centre then. ``across``:
    instead, such pairs between members of different components, ``partners`` for each member and
    list, picked by a hash of the pair and ``turn``, or all of them.

    Every other pair that bitmaps can't tell apart lies between two members of the cell that are returned
    too, as rows of ``cells`` with ``left``. After stars these are the members of a star and what is so near its
    centre that it may be near a member, by the triangle inequality; so a list without such pairs is done.
    """
    columns = ["token", "cell_i", "cell_j", "cell_own", "doc_id", "n"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n", "doc_id"], ignore_index=True)
        ids, n, own = (part[c].to_numpy() for c in ("doc_id", "n", "cell_own"))
        group = part["component"].to_numpy()
        bits = np.frombuffer(b"".join(part["bits"]), np.uint64).reshape(len(part), -1)
        head = np.ascontiguousarray(bits[:, :HEAD].T)
        i, j = int(part["cell_i"].iloc[0]), int(part["cell_j"].iloc[0])
        free, more = np.ones(len(part), bool), np.zeros(len(part), bool)
        found = []

        def closest(k: int, start: int, end: int, size: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
            """Members from start to end whose bitmaps are apart by ``radius`` more than a link to ``size`` allows, or less."""
            # |A xor B| <= (n + m) (1 - t) / (1 + t)
            first = np.bitwise_count(head[:, start:end] ^ head[:, k, None]).sum(axis=0, dtype=np.uint16)
            at = start + np.flatnonzero(first <= (n[start:end] + size) * ((100 - percent) / (100 + percent)) + radius + 0.5)
            apart = distances(bits[at], bits[k])
            close = (apart - radius) * (100 + percent) <= (n[at] + size) * (100 - percent)
            return at[close], apart[close]

        for k in range(len(part)):
            if not across and not free[k]:
                continue
            end = int(np.searchsorted(n, 100 * n[k] // percent, side="right"))
            near, apart = closest(k, k + 1, end, n[k], 0)
            met = (np.minimum(own[near], own[k]) == i) & (np.maximum(own[near], own[k]) == j)
            met &= (ids[near] != ids[k]) & (group[near] != group[k] if across else free[near])
            near, apart = near[met], apart[met]
            if not len(near):
                continue
            if not across:
                free[near] = False
                around, _ = closest(k, 0, len(part), n[near].max(), int(apart.max()))
                around = around[around != k]
                if len(around) > 1:
                    more[around] = True
            elif partners is not None and len(near) > partners:
                mixed = ((ids[near] + ids[k]) * (2 * turn + 1) * 0x9E3779B1 ^ (ids[near] ^ ids[k]) * 0x85EBCA6B) & 0x7FFFFFFF
                order = np.argpartition(mixed, partners)
                more[k] = more[near[order[partners:]]] = True
                near = near[order[:partners]]
            found += [(min(ids[k], x), max(ids[k], x)) for x in ids[near].tolist()]
        pairs = pd.DataFrame(found, columns=["a", "b"], dtype="int64").assign(left=False, **dict.fromkeys(columns, 0))
        rest = part.loc[more, columns].drop_duplicates().assign(left=True, a=0, b=0)
        return pd.concat([x[["left", "a", "b", *columns]] for x in (pairs, rest) if len(x)] or [rest[["left", "a", "b", *columns]]])

    return cells.groupBy("token", "cell_i", "cell_j").applyInPandas(
        run, "left boolean, a long, b long, token long, cell_i int, cell_j int, cell_own int, doc_id long, n long"
    )


def sieved(cells: DataFrame, percent: int, across: bool, partners: int | None = None, turn: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``sieve`` tells, staged; its pairs; and the members of its cells that are left."""
    told = staged(sieve(cells, percent, across, partners, turn), "sieved")
    return told, told.filter("NOT left").select("a", "b").distinct(), told.filter("left").drop("left", "a", "b")


def with_bitmaps(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """Cells with the bitmaps of their members. Joined by doc_id alone, by which ``sets`` are dealt; n only has to fit."""
    own = sets.select(F.col("doc_id").alias("__id"), F.col("n").alias("__n"), "bits")
    return cells.join(own, (F.col("doc_id") == F.col("__id")) & F.col("n").between(F.col("__n"), F.col("__n"))).drop("__id", "__n")


def close_bitmaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose bitmaps don't rule out a link."""
    sides = [sets.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "na", "nb", "bitsa", "bitsb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c]), np.uint64).reshape(len(batch), -1) for c in ("bitsa", "bitsb"))
                bound = (batch["na"] + batch["nb"]).to_numpy() * (100 - percent)
                yield batch.loc[distances(x, y) * (100 + percent) <= bound, ["a", "b"]]

    return both.mapInPandas(run, "a long, b long").distinct()


def verify(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose whole sets reach the threshold, exactly.

    Of a pair only one set travels with it, that of the document in fewer pairs; the other's, a star's centre
    say, is sent once for each block of its pairs.
    """
    ids = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count("*").alias("times")), "ids")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = own.join(ids.select("id"), own["doc_id"] == ids["id"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            sets = [shingles(t.as_py(), size).tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "tokens"])

    # sets are dealt by id once, and so they stay for both joins
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.mapInArrow(run, "id long, tokens binary").repartition(parts, "id").dropDuplicates(["id", "tokens"])
    sets = bucketed(dealt, "sets", ["id"], buckets=parts, dealt=True)
    times = [ids.select(F.col("id").alias(c), F.col("times").alias(f"n{c}")) for c in "ab"]
    turned = pairs.join(times[0], "a").join(times[1], "b")
    swap = F.struct("na", "a") < F.struct("nb", "b")
    turned = turned.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("centre"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("other"))
    turned = turned.withColumn("block", F.pmod(F.xxhash64("other"), F.lit(VERIFY_BLOCKS)).cast("int"))
    blocks = turned.select(F.col("centre").alias("id"), "block").distinct()
    centres = blocks.join(sets, "id").select(
        F.col("id").alias("of"), F.col("block").alias("part"), F.col("tokens").alias("set")
    ).repartition("of", "part")
    others = turned.join(sets.withColumnRenamed("id", "other"), "other").select("centre", "block", "other", "tokens")

    def linked(one: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        found = []
        known = [np.frombuffer(x, np.uint64) for x in one["set"]]
        for id_, tokens in zip(many["other"].tolist(), many["tokens"], strict=True):
            y = np.frombuffer(tokens, np.uint64)
            for x in known:
                merged = np.sort(np.concatenate([x, y]), kind="stable")
                overlap = int((merged[1:] == merged[:-1]).sum())
                if overlap and 100 * overlap >= percent * (len(x) + len(y) - overlap):
                    found.append((min(int(many["centre"].iloc[0]), id_), max(int(many["centre"].iloc[0]), id_)))
                    break
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    met = centres.groupBy("of", "part").cogroup(others.groupBy("centre", "block")).applyInPandas(linked, "a long, b long")
    links = staged(met.distinct(), "linked")
    forget(ids, sets)
    return links


def classes(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_shingles, component_id.

    Null texts and texts without words have no shingles and link with nothing; equal sets link. A
    document with a null doc_id gets its count and no component. Rows that repeat a doc_id are one
    document to the links, with the texts of all of them. Empty tables give no rows. Further columns are
    not read.
    """
    frequent = frequent_tokens(docs, size)
    all_rows = staged(features(docs, size, percent, frequent), "features")
    marked = all_rows.filter("mark IS NOT NULL AND doc_id IS NOT NULL")
    firsts = staged(marked.groupBy("mark").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "firsts")
    copies = marked.select("doc_id", "mark").join(firsts.filter("copies > 1"), "mark").filter("doc_id != first").select(
        F.col("first").alias("a"), F.col("doc_id").alias("b")
    )
    copies = staged(copies, "copies")
    vertices = staged(marked.select(F.col("doc_id").alias("id")).distinct(), "vertices")
    sizes = staged(all_rows.select("doc_id", F.col("n").alias("n_shingles")), "sizes")
    # sets of fewer than 9 link with equal ones only: two different sets that link have at least
    # 100 / (100 - percent) shingles together
    least = needed(-(-100 // max(1, 100 - percent)), percent) if percent < 100 else sys.maxsize
    later = marked.select("doc_id", "mark").join(firsts.filter("copies > 1"), "mark").filter("doc_id != first")
    # dealt by doc_id once, and joined by it alone (mark only has to fit): bitmaps stay where they are in later joins
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    single = marked.filter(F.col("n") >= least).repartition(parts, "doc_id").join(
        later.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")),
        (F.col("doc_id") == F.col("__id")) & F.col("mark").between(F.col("__mark"), F.col("__mark")), "left_anti",
    )
    single = bucketed(single.select("doc_id", "n", "bits", "prefix"), "single", ["doc_id"], buckets=parts, dealt=True)
    forget(all_rows, firsts)
    lists = staged(listed(single.select("doc_id", "n", F.posexplode("prefix").alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))), "lists")

    used = staged(matches(lists, percent), "used")
    enough = close_bitmaps(small_pairs(used, percent), single.select("doc_id", "n", "bits"), percent)
    bitmaps = single.select("doc_id", "n", "bits")
    # members of long lists without their bitmaps, which only follow where members are compared
    cells = staged(block_cells(used.filter(F.col("size") > SMALL_LIST).drop("size", "asks"), "token", "doc_id", BLOCK), "cells")
    told, stars, open_cells = sieved(
        with_bitmaps(cells, bitmaps).withColumn("component", F.col("doc_id")), percent, across=False
    )
    tried = staged(enough.unionByName(stars).distinct(), "pairs")
    forget(lists, used, cells)
    links = staged(verify(docs, tried, size, percent).unionByName(copies), "links")
    united = staged(components(vertices, links), "components")
    # what stars left open: pairs of one list in different components. A few partners for each member
    # first, which unite most of a large group; the last turn leaves no pair out. A list that is one
    # component stays one, and one of which all pairs were tried is done, so each turn looks at what the
    # last one left open only.
    for turn, partners in enumerate(PARTNERS):
        met = staged(open_cells.join(united.withColumnRenamed("id", "doc_id"), "doc_id"), "met")
        forget(told)
        if met.isEmpty():
            break
        cell = ["token", "cell_i", "cell_j"]
        several = met.groupBy(*cell).agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y")
        left = met.join(several.select(*cell), cell, "left_semi")
        told, rest, open_cells = sieved(with_bitmaps(left, bitmaps), percent, True, partners, turn)
        forget(met)
        rest = staged(rest.join(tried, ["a", "b"], "left_anti"), "rest")
        if rest.isEmpty():
            continue
        tried = tried.unionByName(rest)
        more = verify(docs, rest, size, percent)
        if not more.isEmpty():
            # one edge from each old component to another is enough
            moved = more.join(united.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(
                united.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b"
            ).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
            merged = components(united.select(F.col("component").alias("id")).distinct(), moved)
            merged = merged.select(F.col("id").alias("component"), F.col("component").alias("merged"))
            united = staged(united.join(merged, "component").select("id", F.col("merged").alias("component")), "components")
    return sizes.join(
        united.withColumnRenamed("id", "__id"), F.col("doc_id") == F.col("__id"), "left"
    ).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
