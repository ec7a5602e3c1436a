"""Text of a page straight from its HTML by regular expressions: no Python worker involved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts.functions.regex import collapse, find_all, strip, unnest

# The entities the regex path decodes (the parser decodes all of them).
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
)
# Each pattern also takes what is never closed, up to the end: else every start would search it again.
OPAQUE = (
    r"(?is)<!--(?:.*?-->|.*\z)|<script\b[^>]*+(?:>(?:.*?</script\s*>|.*\z)|\z)|<style\b[^>]*+(?:>(?:.*?</style\s*>|.*\z)|\z)"
)
TAG = r"(?s)</?[A-Za-z!?][^>]*+(?:>|\z)"
TITLE = r"(?is)<title[^>]*+(?:>(.*?)(?:(</title>)|\z)|\z)"
H1 = r"(?is)<h1[^>]*+(?:>.*?(?:</h1>|\z)|\z)"
H1_TAGS = r"(?i)^<h1[^>]*>|</h1>$"
TOKEN = r"(?s)<!--(?:.*?-->|.*\z)|<[^>]*+(?:>|\z)|[^<]+"


def decode_entities(c: Column) -> Column:
    """Decode ``ENTITIES``; the semicolon may be missing where the name clearly ends."""
    decoded = c
    for entity, char in ENTITIES:
        name = entity.removesuffix(";")
        decoded = F.regexp_replace(decoded, rf"{name}(?:;|(?![-.a-zA-Z0-9]))", char)
    return F.when(c.contains("&"), decoded).otherwise(c)


def without_opaque(html: Column) -> Column:
    """HTML without comments, scripts and styles."""
    return F.regexp_replace(html, OPAQUE, " ")


def page_text(html: Column) -> Column:
    """Visible text, white space collapsed."""
    return collapse(decode_entities(F.regexp_replace(without_opaque(html), TAG, " ")))


def glued_text(inner_html: Column) -> Column:
    """Text of an element's inner HTML with its pieces stripped and joined without a blank."""
    pieces = F.split(F.regexp_replace(inner_html, TAG, "\u0000"), "\u0000")
    return F.array_join(F.transform(pieces, lambda p: strip(decode_entities(p))), "")


def page_title(html: Column) -> Column:
    """Text of the first ``<title>``, null without one."""
    closed = F.regexp_extract(html, TITLE, 2) != ""
    return F.when(closed, glued_text(F.regexp_extract(html, TITLE, 1)))


def page_headings(html: Column, limit: int = 3) -> Column:
    """Glued texts of the first ``h1`` elements that are closed."""
    found = F.filter(find_all(without_opaque(html), H1), lambda h: h.rlike("(?i)</h1>$"))
    return F.transform(F.slice(found, 1, limit), lambda h: glued_text(F.regexp_replace(h, H1_TAGS, "")))


def html_tokens(pages: DataFrame) -> DataFrame:
    """One row per comment, tag or text run: ``pos``, ``token``, ``kind`` and ``tag``."""
    return (
        unnest(pages, find_all(F.col("html"), TOKEN), "pos", "token")
        .drop("html")
        .withColumn(
            "kind",
            F.when(F.col("token").startswith("<!--"), "comment")
            .when(F.col("token").startswith("</"), "end")
            .when(F.col("token").startswith("<!"), "declaration")
            .when(F.col("token").startswith("<"), "start")
            .otherwise("text"),
        )
        .withColumn("tag", F.lower(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9]*)", 1)))
    )
