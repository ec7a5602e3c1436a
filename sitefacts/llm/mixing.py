"""Mixing sources to target weights by a low-discrepancy schedule.

Every source has a target in words. Slot ``i`` of the schedule is the point ``frac((i + 1) / golden ratio)``
mapped through the cumulative shares of the targets, so each source's slots are spread evenly over the
mix. Slots are ranked per source, and rank ``k`` takes block ``k`` of that source: its documents in a
shuffled order laid end to end and cut into blocks of equal words, again from the start when all are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefacts.llm.common import WORD, running_totals
from sitefacts.sources.storage import staged

#: Weights of the sources in code point order, repeating (fixed values).
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
BLOCK = 1024
#: Slots that are ranked together, and cells in which points and sources meet.
PART = 4096
GRID = 1024
_GOLDEN = 0.6180339887498949


def word_count(text: Column) -> Column:
    """Words of a text, null counts 0: one letter is left for each word and the rest removed."""
    marked = F.regexp_replace(text, WORD, "x")
    return F.coalesce(F.length(F.translate(marked, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def with_sizes(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, size): ``row`` tells repeated rows apart and orders the shuffle.

    ``row`` is the MD5 of the doc_id, so reruns shuffle alike; rows that share a doc_id are alike
    but for their order, which only size and source decide.
    """
    return docs.select(
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("row"),
        "doc_id", "source", word_count(F.col("text")).alias("size"),
    )


def source_targets(sizes: DataFrame, share: float = SHARE, passes: int = MOST_PASSES) -> DataFrame:
    """Target words of each source: source, source_size, weight, target. One row per source.

    Targets are proportional to the weights and stop at ``passes`` times the source's size; what is
    above goes to the other sources by weight until none is above. Sources reach their stop in the
    order of stop by weight, so the level at which the rest share follows from running sums.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = totals.withColumn("source_no", F.row_number().over(order))
    place = (F.col("source_no") - 1) % len(WEIGHTS)
    weighted = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), place + 1))
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_stop = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    stopped = F.coalesce(F.sum("source_size").over(earlier), F.lit(0)) * passes
    level = (F.sum("source_size").over(all_rows) * F.lit(share) - stopped) / F.sum("weight").over(from_here)
    shared = weighted.withColumn("__level", level)
    # the first source that stays below its stop sets the level of all after it
    below = F.when(F.col("__level") * F.col("weight") < F.col("source_size") * passes, F.col("__level"))
    final = F.first(below, ignorenulls=True).over(by_stop.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    target = F.when(final.isNull(), (F.col("source_size") * passes).cast("double")).otherwise(final * F.col("weight"))
    return shared.select("source", "source_no", "source_size", "rows", "weight", target.alias("target"))


def planned_slots(targets: DataFrame, block: int) -> DataFrame:
    """Add ``words`` (the target in whole words), ``blocks`` of one pass, ``slots`` that take the words,
    ``rest`` (words after full passes) and ``last_words`` (those of the last slot, if there is a rest)."""
    size = F.greatest(F.col("source_size"), F.lit(1))
    words = F.least(F.round("target").cast("long"), F.col("source_size") * MOST_PASSES)
    out = targets.withColumn("words", words).withColumn("blocks", F.ceil(F.col("source_size") / block))
    full = F.floor(F.col("words") / size)
    out = out.withColumn("rest", F.col("words") - full * F.col("source_size"))
    rest_slots = F.ceil(F.col("rest") / block)
    return out.withColumn("slots", full * F.col("blocks") + rest_slots).withColumn(
        "last_words", F.col("rest") - F.greatest(rest_slots - 1, F.lit(0)) * block
    )


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as slots: slot, source_no, rank, block_no, words.

    As many points are drawn as all sources need slots. A source that the points give a few slots too
    many loses its last ones; one that they give a few too few gets them at the end. So every source
    takes exactly its target, rounded to words. The last slot of a source takes only the words that it
    still lacks. Slots are made and ranked in parts, so no source is ranked in one task.
    """
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = planned_slots(targets, block).filter("slots > 0").select(
        "source_no", "source_size", "blocks", "rest", "last_words", "slots",
        F.sum("slots").over(upto).alias("upper"), F.sum("slots").over(whole).alias("all_slots"),
    )
    shares = staged(shares, "shares")

    def part_of(slot: Column) -> Column:
        return F.floor(slot / PART)

    total = shares.agg(F.max("all_slots").alias("n")).filter("n > 0")
    parts = total.select("n", F.explode(F.sequence(F.lit(0).cast("long"), part_of(F.col("n") - 1))).alias("part"))
    first, end = F.col("part") * PART, F.least(F.col("part") * PART + PART, F.col("n"))
    slots = parts.repartition(F.col("part")).select("n", F.explode(F.sequence(first, end - 1)).alias("slot"))
    # points and sources meet by cell of a grid, and in the cell by the source's exact range
    slots = slots.withColumn("point", ((F.col("slot") + 1) * F.lit(_GOLDEN)) % 1.0 * F.col("n"))
    slots = slots.withColumn("cell", F.floor(F.col("point") / F.col("n") * GRID))
    cells = F.sequence(
        F.floor((F.col("upper") - F.col("slots")) / F.col("all_slots") * GRID),
        F.floor(F.col("upper") / F.col("all_slots") * GRID),
    )
    ranges = shares.select("source_no", "slots", "upper", F.explode(cells).alias("cell"))
    inside = (F.col("point") < F.col("upper")) & (F.col("point") >= F.col("upper") - F.col("slots"))
    drawn = slots.join(ranges, "cell").filter(inside).select("slot", "source_no", "slots")
    ranked = running_totals(
        drawn, "source_no", part_of(F.col("slot")), [F.col("slot")], F.lit(1), "rank"
    ).filter("rank < slots").select("slot", "source_no", "rank")
    got = ranked.groupBy("source_no").agg(F.count("*").alias("got"))
    lacking = shares.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < slots")
    added = lacking.select(
        "all_slots", "source_no", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("rank")
    ).select((F.col("all_slots") + F.col("rank")).alias("slot"), "source_no", "rank")
    block_no = F.col("rank") % F.col("blocks")
    length = F.least(F.lit(block), F.col("source_size") - block_no * block)
    last = (F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0)
    return ranked.unionByName(added).join(shares, "source_no").select(
        "slot", "source_no", "rank", block_no.alias("block_no"),
        F.when(last, F.col("last_words")).otherwise(length).cast("long").alias("words"),
    )


def placements(docs: DataFrame, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """Where each document's words go: its row, its source's facts, and slot, from_word and words per stretch.

    A stretch is ``words`` words of the document from word ``from_word`` (from 0) on. A document that
    the mix doesn't take has one row with a null slot and 0 words.

    Documents are placed in their source's shuffled order by sums over parts of it, of the square root
    of the source's rows each, so a hot source is many window groups.
    """
    sizes = staged(with_sizes(docs), "sizes")
    targets = staged(source_targets(sizes, share), "targets")
    known = targets.select(F.col("source").alias("__source"), "source_no", "source_size", "target", "rows")
    rows = sizes.join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    hashed = F.conv(F.substring("row", 1, 8), 16, 10).cast("double") / 4294967296.0
    part = F.floor(hashed * F.greatest(F.floor(F.sqrt("rows")), F.lit(1)))
    placed = running_totals(rows, "source_no", part, [F.col("row"), F.col("size")], F.col("size"), "start")
    end = F.col("start") + F.col("size")
    touched = F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))
    pieces = placed.withColumn("block_no", F.explode_outer(F.when(F.col("size") > 0, touched)))
    slots = schedule(targets, block).drop("rank")
    met = pieces.join(slots, ["source_no", "block_no"], "left")
    begin = F.col("block_no") * block
    overlap = F.least(end, begin + F.col("words")) - F.greatest("start", begin)
    overlap = F.when(F.col("words").isNull(), F.lit(0)).otherwise(F.greatest(overlap, F.lit(0)))
    return met.select(
        "row", "doc_id", "source", "size", "source_no", "source_size", "target", "start", "slot",
        (F.greatest("start", begin) - F.col("start")).alias("from_word"), overlap.alias("words"),
    )


def mix(docs: DataFrame, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """Words that the mix takes from each document: doc_id, source, size, source_size, target, taken.

    Null texts have size 0 and take nothing; the null source is a source, last in order. Rows that
    repeat a doc_id count each. An empty table gives no rows. Further columns are not read.
    """
    keys = ["row", "doc_id", "source", "size", "source_no", "source_size", "target", "start"]
    # rows without words share their place; numbered, they stay apart
    placed = placements(docs, share, block).withColumn(
        "apart", F.when(F.col("size") == 0, F.monotonically_increasing_id())
    )
    return placed.groupBy(*keys, "apart").agg(F.sum("words").alias("taken")).select(
        "doc_id", "source", "size", "source_size", "target", "taken"
    )


#: The mix as plain SQL: a source's documents in shuffled order take full passes, then the rest of its target.
ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS row,
         CAST(coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]', '', 'g')), 0) AS BIGINT) AS size
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), weighted AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM totals
), levels AS (
  SELECT *, row_number() OVER w AS k,
         (CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE
          - CAST(coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) * 2)
         / CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM weighted WINDOW w AS (ORDER BY source_size / weight::DOUBLE, source NULLS LAST)
), finals AS (
  SELECT *, (SELECT arg_min(level, k) FROM levels b WHERE b.level * b.weight < b.source_size * 2 AND b.k <= a.k) AS final
  FROM levels a
), targets AS (
  SELECT source, source_size,
         CASE WHEN final IS NULL THEN CAST(source_size * 2 AS DOUBLE) ELSE final * weight END AS target
  FROM finals
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(least(round(t.target), 2 * t.source_size) AS BIGINT) AS words,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.row, s.size
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE
         words // source_size * size + greatest(0, least(start + size, words % source_size) - start) END AS BIGINT) AS taken
FROM placed
"""
