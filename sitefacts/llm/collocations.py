"""Phrase collocations from FM-indexes over word ids, one index per shard of the corpus.

A shard holds about a million words of one language as numbers. Its index knows, for any phrase of
bounded length, the interval of places where the phrase begins and the interval of places where it
ends, and extends both at once by a word to the right or to the left. All phrases of m words of a
shard are enumerated that way; their counts are summed over all shards.

Lengths are taken one after the other: a phrase of m words can only reach the least count if its first
m - 1 and its last m - 1 words do, so each shard drops what cannot be part of one before its next index
is built. That is exact, and after two words little is left. Phrases travel between shards as the
numbers of their two parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefacts.sources.storage import bucketed, forget, spread, staged

#: Words in a phrase at most, occurrences at least, phrases reported per language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Words of a shard; also what a task holds of one index.
SHARD = 1 << 20

#: Characters that end a piece, and white space inside one (fixed values).
PIECE_ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b" \x09"
_TABLE = bytes(
    10 if c in PIECE_ENDS else 32 if c in BLANKS else c + 32 if 65 <= c <= 90 else c for c in range(256)
)


# --- index ----------------------------------------------------------------------------


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the runs of equal neighbours."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.concatenate([starts, [len(keys)]]))


def _order(keys: np.ndarray) -> np.ndarray:
    """Stable order of keys from 0 on. Key and place are sorted as one number where they fit, which is much faster."""
    bits = max(len(keys) - 1, 0).bit_length()
    if int(keys.max(initial=0)).bit_length() + bits > 63:
        return np.argsort(keys, kind="stable")
    both = keys.astype(np.int64) << bits
    both |= np.arange(len(keys))
    both.sort()
    return both & ((1 << bits) - 1)


def _context_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``ids`` ordered by the ``depth`` numbers from there on; 0 stands behind the end."""
    rank, known = ids, 1
    order = _order(rank) if depth == 1 else None
    while known < depth:
        step = min(known, depth - known)
        later = np.zeros(len(ids), np.int64)
        later[: len(ids) - step] = rank[step:] + 1
        key = rank.astype(np.int64) * (int(rank.max(initial=0)) + 2) + later
        order = _order(key)
        known += step
        if known < depth:
            starts, sizes = _runs(key[order])
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.repeat(np.arange(len(starts)), sizes)
    return order


class _Side:
    """Places in the order of what follows them, the number before each (BWT) and its last-to-first map."""

    def __init__(self, ids: np.ndarray, depth: int):
        self.places = _context_order(ids, depth)
        self.before = np.where(self.places > 0, ids[self.places - 1], 0)
        self.to_first = np.empty(len(ids), np.int64)
        self.to_first[_order(self.before)] = np.arange(len(ids))


class Nodes:
    """Phrases of one length: where they begin in the forward order, where they end in the backward one."""

    def __init__(self, begin: np.ndarray, end: np.ndarray, size: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.begin, self.end, self.size = begin, end, size
        #: Number among the next shorter phrases of all but the last, all but the first word.
        self.first, self.last = first, last

    def __len__(self) -> int:
        return len(self.size)


class PhraseIndex:
    """Bidirectional index over numbers; 0 separates stretches and belongs to no phrase.

    Contexts are ordered to ``depth`` numbers, which is enough to extend phrases up to that length.
    """

    def __init__(self, ids: np.ndarray, depth: int):
        #: With a separator at both ends, so that both orders begin with as many separators as they precede.
        self.ids, self.depth = np.concatenate([[0], ids, [0]]), depth
        self.ahead = _Side(self.ids, depth)
        self.behind = _Side(self.ids[::-1], depth)

    def words(self) -> Nodes:
        """Intervals of single numbers; the same in both orders."""
        sorted_ids = self.ids[self.ahead.places]
        starts, sizes = _runs(sorted_ids)
        real = sorted_ids[starts] > 0
        none = np.zeros(int(real.sum()), np.int64)
        return Nodes(starts[real], starts[real], sizes[real], none, none)

    def extend(self, nodes: Nodes, right: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All extensions by one word that occur: node, begin, end and size of each.

        To the right, the numbers that follow a phrase stand before its ends in the backward order.
        Those of an interval, sorted, split its forward interval in that order; the first of each
        leads to the new backward interval. To the left it is the other way round.
        """
        side = self.behind if right else self.ahead
        own, other = (nodes.end, nodes.begin) if right else (nodes.begin, nodes.end)
        node = np.repeat(np.arange(len(nodes)), nodes.size)
        before = np.cumsum(nodes.size) - nodes.size
        at = np.repeat(own - before, nodes.size) + np.arange(len(node))
        key = node * (int(self.ids.max(initial=0)) + 1) + side.before[at]
        order = _order(key)
        starts, sizes = _runs(key[order])
        head = order[starts]
        child = node[head]
        own_new = side.to_first[at[head]]
        other_new = other[child] + starts - before[child]
        real = side.before[at[head]] > 0
        begin, end = (other_new, own_new) if right else (own_new, other_new)
        return child[real], begin[real], end[real], sizes[real]

    def phrases(self, length: int) -> Nodes:
        """All phrases of ``length`` words in the order of their beginnings.

        Extensions to the right name a phrase's first part, those to the left its last; both are the
        same phrases and meet by their place in the forward order.
        """
        nodes = self.words()
        for _ in range(length - 1):
            first, begin, end, size = self.extend(nodes)
            last, same, _, _ = self.extend(nodes, right=False)
            a, b = _order(begin), _order(same)
            nodes = Nodes(begin[a], end[a], size[a], first[a], last[b])
        return nodes


def keep_alive(ids: np.ndarray, length: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``ids`` in which every phrase of ``length`` words is alive, and which phrases those are.

    ``alive`` holds numbers of ``PhraseIndex(ids, length).phrases(length)``. Stretches that hold one
    phrase only cannot hold a longer one and are left out. The new sequence has the returned phrases
    of that length, in the same order, and no others.
    """
    places = np.full(len(ids) + 1, -1, np.int64)
    if length == 1:
        nodes_at = ids[ids > 0]
        _, nodes_at = np.unique(nodes_at, return_inverse=True)
        places[np.flatnonzero(ids > 0)] = nodes_at
    elif len(ids):
        # the forward order alone tells which places begin the same phrase
        padded = np.concatenate([ids, np.zeros(length, ids.dtype)])
        begins = _context_order(ids, length)
        real, first = np.ones(len(ids), bool), np.zeros(len(ids), bool)
        first[0] = True
        for k in range(length):
            word = padded[begins + k]
            real &= word > 0
            first[1:] |= word[1:] != word[:-1]
        places[begins[real]] = np.cumsum(first[real]) - 1
    wanted = np.zeros(max(int(places.max()), int(alive.max(initial=0))) + 2, bool)
    wanted[alive] = True
    on = (places >= 0) & wanted[places]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    several = ends - starts >= 2
    starts, ends = starts[several], ends[several]
    sizes = ends - starts + length  # the words, and a separator
    offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    take = np.repeat(starts, sizes) + offset
    out = np.where(offset == np.repeat(sizes, sizes) - 1, 0, ids[np.minimum(take, max(len(ids) - 1, 0))] if len(ids) else 0)
    held = places[np.repeat(starts, ends - starts) + np.arange((ends - starts).sum()) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)]
    return out.astype(np.int64), np.unique(held)


# --- shards ---------------------------------------------------------------------------


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 1
        return number


def _numbers() -> _Numbers:
    """Word numbers from 1; 0 is the end of a piece, -1 nothing between two blanks."""
    return _Numbers({b"": -1, b"\n": 0})


def _pack(ids: np.ndarray) -> bytes:
    return zstandard.compress(ids.astype(np.int32).tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), np.int32).astype(np.int64)


def _stretches(data: bytes, most: int) -> Iterator[tuple[list[bytes], bool]]:
    """Words and piece ends of a text, ``most`` bytes at a time; whether a piece ends there.

    Cut behind a piece if one ends there, else between words; a longer word is whole.
    """
    at = 0
    while at < len(data):
        end = min(len(data), at + most)
        if end < len(data):
            cut = data.rfind(b"\n", at, end) + 1 or data.rfind(b" ", at, end) + 1
            if not cut:
                later = [e + 1 for e in (data.find(b" ", end), data.find(b"\n", end)) if e >= 0]
                cut = min(later, default=len(data))
            end = cut
        piece = data[at:end] if end < len(data) else data[at:] + b"\n"
        yield piece.replace(b"\n", b" \n ").split(b" "), piece.endswith(b"\n")
        at = end


_SHARD = pa.schema([
    ("shard", pa.int64()), ("lang", pa.string()), ("total", pa.int64()), ("ids", pa.binary()),
    ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())),
])


def _to_shards(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        waiting: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal made
            numbers, parts = held.pop(lang)
            waiting.pop(lang)
            ids = np.concatenate(parts)
            counts = np.bincount(ids, minlength=len(numbers) - 1)[1:]
            shard = part << 16 | made
            made += 1
            words = [w for w, n in numbers.items() if n > 0]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(
                    ([shard], [lang], [int(counts.sum())], [_pack(ids)], [words], [counts.tolist()]), _SHARD, strict=True
                )],
                schema=_SHARD,
            )

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for found, ended in _stretches(text.translate(_TABLE), 8 * size):
                    if lang not in held:
                        held[lang], waiting[lang] = (_numbers(), []), 0
                    numbers, parts = held[lang]
                    ids = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
                    parts.append(ids[ids >= 0])
                    waiting[lang] += len(parts[-1])
                    if ended and waiting[lang] >= size:
                        yield flush(lang)
            while sum(waiting.values()) >= 2 * size:
                yield flush(max(waiting, key=waiting.get))
        for lang in list(held):
            yield flush(lang)

    return run


def _survivors(counted: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of phrases with ``least`` occurrences over all shards, with their total and a number.

    A phrase's number is the smallest ``code`` of its rows: a shard names it, as no two phrases of a
    length share a code. One row per shard and phrase is shuffled; nothing is collected. Only the row
    that gives the number keeps ``keys`` and total, which speak for the others too.
    """
    over = Window.partitionBy(*keys)
    totals = counted.withColumn("total", F.sum("count").over(over)).withColumn("id", F.min("code").over(over))
    named = F.col("id") == F.col("code")
    return totals.filter(F.col("total") >= least).select(
        "code", "id", *[F.when(named, F.col(c)).alias(c) for c in (*keys, "total")]
    )


_CODE = 27  # bits of a node's number inside its shard


def _count_phrases(length: int):
    """Rows of all phrases of ``length`` words of each shard."""
    schema = pa.schema([(c, pa.int64()) for c in ("head", "tail", "code", "count")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, blob, parts in zip(batch["shard"].to_pylist(), batch["ids"].to_pylist(), batch["parts"], strict=True):
                ids = _unpack(blob)
                if not len(ids):
                    continue
                known = np.frombuffer(zstandard.decompress(parts.as_py()), np.int64)
                nodes = PhraseIndex(ids, length).phrases(length)
                code = (shard << _CODE) + np.arange(len(nodes))
                columns = known[nodes.first], known[nodes.last], code, nodes.size
                for at in range(0, len(nodes), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], schema=schema)

    return run


def _reduce(length: int):
    """A shard without what cannot be part of a longer phrase, from the surviving phrases of ``length`` words."""

    def run(shard: pd.DataFrame, alive: pd.DataFrame) -> pd.DataFrame:
        ids = _unpack(shard["ids"].iloc[0]) if len(shard) else np.zeros(0, np.int64)
        if not len(ids) or not len(alive):
            return pd.DataFrame({"shard": [], "ids": [], "parts": []})
        node, order = np.unique(alive["node"].to_numpy(), return_index=True)
        ids, left = keep_alive(ids, length, node)
        if not len(ids):
            return pd.DataFrame({"shard": [], "ids": [], "parts": []})
        known = alive["id"].to_numpy()[order][np.searchsorted(node, left)]
        parts = zstandard.compress(known.astype(np.int64).tobytes(), 1)
        return pd.DataFrame({"shard": [shard["shard"].iloc[0]], "ids": [_pack(ids)], "parts": [parts]})

    return run


def phrase_tables(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, shard_words: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Word counts per language, and every phrase of 1 to ``longest`` words that occurs ``least`` times.

    Columns of the second: lang, m (its words), words array<string>, a (its occurrences), heads and
    tails (occurrences of its first and its last 1 to m - 1 words), id, head and tail (the ids of its
    first and last m - 1 words).
    """
    if shard_words >= 1 << (_CODE - 1):
        raise ValueError(f"a shard holds fewer than {1 << (_CODE - 1)} words")
    texts = spread(
        docs.select(
            F.coalesce(F.col("lang"), F.lit("und")).alias("lang"),
            F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text"),
        )
    )
    schema = "shard long, lang string, total long, ids binary, words array<binary>, counts array<long>"
    shards = staged(texts.mapInArrow(_to_shards(shard_words), schema), "shards")
    totals = staged(shards.groupBy("lang").agg(F.sum("total").alias("n")), "totals")
    counted = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("node", "w")).select(
        "lang", F.col("w.words").alias("word"), F.shiftleft("shard", _CODE).bitwiseOR(F.col("node")).alias("code"),
        F.col("w.counts").alias("count"),
    )
    alive = staged(_survivors(counted, ["lang", "word"], least), "phrases-1")
    found = staged(
        alive.filter("id = code").select(
            "id", "lang", F.array(F.col("word").cast("string")).alias("words"), F.col("total").alias("a"),
            F.array().cast("array<long>").alias("heads"), F.array().cast("array<long>").alias("tails"),
            F.lit(None).cast("long").alias("head"), F.lit(None).cast("long").alias("tail"),
        ),
        "known-1",
    )
    every = [found]
    sequences = shards.select("shard", "ids")
    for length in range(2, longest + 1):
        back = alive.select(F.shiftright("code", _CODE).alias("shard"), F.col("code").bitwiseAND(F.lit((1 << _CODE) - 1)).alias("node"), "id")
        reduced = sequences.groupBy("shard").cogroup(back.groupBy("shard")).applyInPandas(
            _reduce(length - 1), "shard long, ids binary, parts binary"
        )
        # by shard, as the next round wants them: that one shuffles its phrases only
        earlier, sequences = sequences, bucketed(reduced, f"sequences_{length}", ["shard"], dealt=True)
        del reduced, back
        forget(earlier, alive)
        counted = sequences.mapInArrow(_count_phrases(length), "head long, tail long, code long, count long")
        alive = staged(_survivors(counted, ["head", "tail"], least), f"phrases-{length}")
        first = found.select(F.col("id").alias("head"), "lang", F.col("words").alias("start"), F.col("a").alias("of_head"), "heads")
        last = found.select(F.col("id").alias("tail"), F.element_at("words", -1).alias("end"), F.col("a").alias("of_tail"), "tails")
        found = staged(
            alive.filter("id = code").join(first, "head").join(last, "tail").select(
                "id", "lang", F.array_append("start", F.col("end")).alias("words"), F.col("total").alias("a"),
                F.array_append("heads", F.col("of_head")).alias("heads"), F.array_append("tails", F.col("of_tail")).alias("tails"),
                "head", "tail",
            ),
            f"known-{length}",
        )
        every.append(found)
        del counted, first, last
    forget(sequences, alive)
    tables = every[0].withColumn("m", F.lit(1))
    for m, more in enumerate(every[1:], 2):
        tables = tables.unionByName(more.withColumn("m", F.lit(m)))
    return totals, tables


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int | None = TOP, shard_words: int = SHARD
) -> DataFrame:
    """Best phrases of each language: lang, rank, phrase, a, l, r, n, score, cut.

    ``cut`` is the number of words before the lowest-scoring cut. A null text is empty, a null lang is
    ``und``; languages without such phrases, and an empty table, give no rows. Repeated rows count each. ``top``
    None reports all. Further columns are not read. Long texts are cut
    behind pieces only.
    """
    totals, tables = phrase_tables(docs, longest, least, shard_words)
    # a phrase one word longer than another has at most its occurrences, and any longer one no more
    around = tables.filter("m > 2").select("m", "a", F.explode(F.array_distinct(F.array("head", "tail"))).alias("id"))
    around = around.groupBy((F.col("m") - 1).alias("m"), "id").agg(F.max("a").alias("outside"))
    own = tables.filter("m > 1").join(around, ["m", "id"], "left").filter("outside IS NULL OR outside < a")
    big = lambda c: c.cast("decimal(19,0)")  # noqa: E731  products of two fit 38 digits
    top_half = F.lit(1000).cast("decimal(4,0)") * big(F.col("a")) * big(F.col("n"))
    cuts = F.transform(
        F.arrays_zip("heads", F.reverse("tails").alias("rests")),
        lambda z, k: F.struct(
            F.call_function("div", top_half, big(z["heads"]) * big(z["rests"])).alias("score"),
            (k + 1).alias("cut"), z["heads"].alias("l"), z["rests"].alias("r"),
        ),
    )
    scored = own.join(totals, "lang").withColumn("best", F.array_min(cuts))
    flat = scored.select("lang", F.array_join("words", " ").alias("phrase"), "a", "best.l", "best.r", "n", "best.score", "best.cut")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = flat.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")


#: The same from the rules, for a second engine: every phrase counted, every longer phrase compared.
ORACLE = f"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(x, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM worded GROUP BY lang),
places AS (
  SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
  FROM worded, (SELECT unnest(range(1, {LONGEST} + 1)) AS m) WHERE len(ws) >= m),
grams AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL),
often AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, f AS a FROM grams WHERE m > 1 AND f >= {LEAST}),
inner_ones AS (
  SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, max(a) AS outside
  FROM (SELECT *, unnest(range(1, m - k + 2)) AS i FROM often, (SELECT unnest(range(2, {LONGEST})) AS k) WHERE k < m)
  GROUP BY ALL),
kept AS (
  SELECT o.* FROM often o LEFT JOIN inner_ones i USING (lang, phrase) WHERE i.outside IS NULL OR 100 * i.outside < 100 * o.a),
cuts AS (
  SELECT k.lang, k.phrase, k.a, c AS cut, l.f AS l, r.f AS r, t.n,
         (1000::HUGEINT * k.a * t.n // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS c FROM kept) k JOIN totals t USING (lang)
  JOIN grams l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[1:c], ' ')
  JOIN grams r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[c + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score, cut::INTEGER AS cut
FROM best QUALIFY rank <= {TOP}
"""
