"""Conversations from quoting messages.

Messages are cut into their own lines and quoted lines by nested quote marks. Quoted lines are
normalised, hashed and joined to the latest earlier message of the conversation that wrote such a line
itself; the message whose lines make up most of the directly quoted text is the one replied to. Replies
then form threads, in which every message follows the one it answers and holds no quotes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefacts.llm.common import running_totals
from sitefacts.sources.storage import staged

#: A quote mark as mail programs write it, up to the last one of a line.
_QUOTE = re.compile(r"^[ \t]*(?:>[ \t]?)+")
#: The line by which mail programs lead in a quote.
_LEAD = re.compile(r"^(?:[Oo]n\b.*\b)?wrote:$|^.{0,200}\bwrote:$")
#: Turns that are searched together; a long conversation is many groups.
PART = 1024


def normalise(line: str) -> str:
    """Lower case, letters and digits only, one blank between words; a line without any keeps its marks."""
    words = " ".join(re.findall(r"\w+", line.lower()))
    return words or " ".join(line.split())


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(normalise(line).encode("utf-8", "surrogatepass")) - (1 << 63)


def split_quotes(text: str | None) -> tuple[str, list[tuple[int, int, int]], list[int], int]:
    """Own text, quoted lines as (level, hash, characters), hashes of own lines, number of quoted passages.

    The level is the number of quote marks. A lead-in right before a quote belongs to the quote. Blank
    lines around the own text go, and those around cut-out quotes are one.
    """
    own: list[str] = []
    quoted: list[tuple[int, int, int]] = []
    passages, before = 0, 0
    for line in (text or "").replace("\r\n", "\n").split("\n"):
        mark = _QUOTE.match(line)
        if not mark:
            own.append(line)
            before = 0
            continue
        level = mark.group().count(">")
        if level != before:
            passages += 1
        if not before:
            while own and not own[-1].strip():
                own.pop()
            if own and _LEAD.match(own[-1].strip()):
                own.pop()
            own.append("")
        before = level
        body = line[mark.end() :]
        if body.strip():
            quoted.append((level, line_hash(body), len(body.strip())))
    kept: list[str] = []
    for line in own:
        if line.strip() or passages == 0 or (kept and kept[-1].strip()):
            kept.append(line)
    clean = "\n".join(kept).strip()
    return clean, quoted, sorted({line_hash(x) for x in clean.split("\n") if x.strip()}), passages


def parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, quoted, lines, quotes) of every row; null texts are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cut = [split_quotes(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "conv_id": batch["conv_id"].astype("Int64"), "turn": batch["turn"].astype("Int64"), "role": batch["role"],
                    "text": [c[0] for c in cut],
                    "quoted": [[{"level": a, "hash": b, "chars": n} for a, b, n in c[1]] for c in cut],
                    "lines": [c[2] for c in cut], "quotes": [c[3] for c in cut],
                }
            )

    return messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInPandas(
        run,
        "conv_id long, turn long, role string, text string, "
        "quoted array<struct<level:int,hash:long,chars:long>>, lines array<long>, quotes int",
    )


def latest_before(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``origin``: the latest earlier turn with ``wrote`` among the rows of the same keys.

    One pass over each key's rows by parts of PART turns; what earlier parts wrote last is added from a
    table of parts. A line that many messages wrote and quoted so costs its rows, not their square.
    """
    part = F.floor(F.col("turn") / PART)
    rows = rows.withColumn("__part", part)
    inside = Window.partitionBy(*keys, "__part").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    wrote = F.when(F.col("wrote"), F.col("turn"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*keys, "__part").agg(F.max(wrote).alias("__last"))
    parts = parts.select(*keys, "__part", F.max("__last").over(before).alias("__before"))
    found = rows.withColumn("__inside", F.max(wrote).over(inside)).join(parts, [*keys, "__part"])
    return found.withColumn("origin", F.coalesce("__inside", "__before")).drop("__part", "__inside", "__before")


def reply_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, origin, linked): the message each message of ``parsed`` replies to.

    That is the origin of most of its quoted characters on the lowest level that has any origin, ties to
    the later turn. A message without a known quote replies to the message before it, ``linked`` false.
    """
    keyed = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    none = F.lit(None)
    wrote = keyed.select("conv_id", "turn", F.explode("lines").alias("hash")).distinct().select(
        "conv_id", "hash", "turn", F.lit(True).alias("wrote"), none.cast("int").alias("level"), none.cast("long").alias("chars")
    )
    quotes = keyed.select("conv_id", "turn", F.explode("quoted").alias("q")).groupBy("conv_id", "q.hash", "turn", "q.level").agg(
        F.max("q.chars").alias("chars")
    ).select("conv_id", "hash", "turn", F.lit(False).alias("wrote"), "level", "chars")
    found = latest_before(wrote.unionByName(quotes), ["conv_id", "hash"]).filter(~F.col("wrote") & F.col("origin").isNotNull())
    sums = found.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("chars").alias("chars"))
    best = sums.groupBy("conv_id", "turn").agg(
        F.max(F.struct(-F.col("level"), "chars", "origin")).alias("best")
    ).select("conv_id", "turn", F.col("best.origin").alias("quoted_turn"))
    turns = keyed.select("conv_id", "turn").distinct().withColumn("wrote", F.lit(True))
    last = latest_before(turns, ["conv_id"]).select("conv_id", "turn", F.col("origin").alias("last"))
    return last.join(best, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce("quoted_turn", "last").alias("origin"), F.col("quoted_turn").isNotNull().alias("linked")
    )


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth): first message and number of ancestors of each message.

    Every round each message that isn't at its thread's first one jumps to the ancestor of its ancestor,
    so rounds grow with the logarithm of the depth. Replies always point to earlier turns, so there are no cycles.
    """
    first = F.col("origin").isNull()
    state = staged(
        links.select(
            "conv_id", "turn", F.coalesce("origin", "turn").alias("up"), F.when(first, 0).otherwise(1).cast("long").alias("steps"),
            first.alias("ended"),
        ),
        "threads",
    )
    while not state.filter("NOT ended").isEmpty():
        above = state.select(
            "conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("ended").alias("last")
        )
        jumped = state.filter("NOT ended").join(above, ["conv_id", "up"]).select(
            "conv_id", "turn", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("last").alias("ended")
        )
        state = staged(state.filter("ended").unionByName(jumped), "threads")
    return state.select("conv_id", "turn", F.col("up").alias("thread"), F.col("steps").alias("depth"))


def chats(messages: DataFrame) -> DataFrame:
    """Reply-ordered conversations without quotes, one row per message of (conv_id, turn, role, text).

    Returns conv_id, turn, role, reply_to, linked, thread, depth, position, quotes, text. ``position``
    orders a thread by turn, so a message follows the one it answers. Texts that only quote stay as empty
    messages, null texts are empty. Rows that repeat a (conv_id, turn) share their links, each with its
    text. A message without conv_id or turn is a thread of its own with null thread, position 0.
    Further columns are not read.
    """
    rows = staged(parsed(messages), "messages")
    links = staged(reply_links(rows), "links")
    placed = threads(links)
    key = F.concat_ws(" ", F.col("conv_id").cast("string"), F.col("thread").cast("string"))
    ranked = running_totals(
        placed.withColumn("key", key), "key", F.floor(F.col("turn") / PART), [F.col("turn")], F.lit(1), "position"
    ).drop("key")
    known = links.join(ranked, ["conv_id", "turn"])
    return rows.drop("quoted", "lines").join(known, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.col("origin").alias("reply_to"), F.coalesce("linked", F.lit(False)).alias("linked"),
        "thread", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("position", F.lit(0)).cast("long").alias("position"),
        "quotes", "text",
    )


def as_mails(conversations: DataFrame) -> DataFrame:
    """Conversations as mail threads: every message quotes the one it answers, and what that one quoted.

    Every third message answers the one before the last. Lines are quoted with a mark per level.
    Messages without conv_id or turn quote nothing.
    """
    text = F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", "role", text.alias("text"))
    placed = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    # numbered by parts of turns and joined by number, so a long conversation is no single task
    placed = running_totals(placed, "conv_id", F.floor(F.col("turn") / PART), [F.col("turn")], F.lit(1), "__n")
    placed = staged(placed, "numbered")
    back = F.when(F.col("turn") % 3 == 2, 2).otherwise(1)

    def before(name: str) -> DataFrame:
        return placed.select(F.col("conv_id").alias(f"c_{name}"), F.col("__n").alias(f"n_{name}"), F.col("text").alias(name))

    def quote(c, mark: str):
        return F.regexp_replace(c, "(?m)^", mark)

    met = placed
    for name, steps in (("up", back), ("further", back + 1)):
        other = before(name)
        met = met.join(other, (F.col("conv_id") == F.col(f"c_{name}")) & (F.col("__n") - steps == F.col(f"n_{name}")), "left")
    nested = F.coalesce(F.concat(F.lit("\n"), quote(F.col("further"), "> > ")), F.lit(""))
    mail = F.when(F.col("up").isNull(), F.col("text")).otherwise(
        F.concat(F.lit("Someone wrote:\n"), quote(F.col("up"), "> "), nested, F.lit("\n\n"), F.col("text"))
    )
    mails = met.select("conv_id", "turn", "role", mail.alias("text"))
    return mails.unionByName(rows.filter("conv_id IS NULL OR turn IS NULL"))


#: What ``chats(as_mails(conversations))`` must give back, from the conversations themselves.
ORACLE = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT *, CASE WHEN turn % 3 = 2 THEN lag(text, 2) OVER w ELSE lag(text, 1) OVER w END AS up,
         CASE WHEN turn % 3 = 2 THEN lag(text, 3) OVER w ELSE lag(text, 2) OVER w END AS further,
         lag(turn, 1) OVER w AS last
  FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), r AS (
  SELECT p.*, (SELECT max(m.turn) FROM m WHERE m.conv_id = p.conv_id AND m.turn < p.turn AND m.text = p.up) AS quoted
  FROM p
), links AS (
  SELECT *, coalesce(quoted, last) AS reply_to FROM r
), threads AS (
  SELECT conv_id, turn, turn AS thread, 0::BIGINT AS depth FROM links WHERE reply_to IS NULL
  UNION ALL
  SELECT l.conv_id, l.turn, t.thread, t.depth + 1 FROM links l JOIN threads t ON l.conv_id = t.conv_id AND l.reply_to = t.turn
)
SELECT l.conv_id, l.turn, l.role, l.reply_to, l.quoted IS NOT NULL AS linked, t.thread, t.depth,
       row_number() OVER (PARTITION BY l.conv_id, t.thread ORDER BY l.turn) - 1 AS position,
       (l.up IS NOT NULL)::INT + (l.up IS NOT NULL AND l.further IS NOT NULL)::INT AS quotes,
       trim(l.text, E' \n\t\r') AS text
FROM links l JOIN threads t USING (conv_id, turn)
"""
