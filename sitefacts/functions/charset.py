"""Text of byte bodies: the charset is found by column functions, and most bodies are decoded by them."""

from __future__ import annotations

import codecs
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Send this module's code along with the tasks: workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Labels that mean UTF-8 and Windows-1252, and the characters of the latter's bytes 0x80 to 0x9F.
UTF8_LABELS = ("utf-8", "utf8", "unicode-1-1-utf-8")
WESTERN_LABELS = (
    "windows-1252", "cp1252", "x-cp1252", "iso-8859-1", "iso8859-1", "iso_8859-1", "latin1", "latin-1", "l1",
    "us-ascii", "ascii",
)
WESTERN_HIGH = (
    "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f"
    "\x90‘’“”•–—˜™š›œ\x9džŸ"
)
#: Bytes of a body in which a declaration is looked for.
HEAD = 1024


def _label(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def header_charset(content_type: Column) -> Column:
    """Charset of a content type such as ``text/html; charset="utf-8"``, null for none."""
    return _label(F.regexp_extract(content_type, r"(?i)charset\s*=\s*[\"']?\s*([\w.:-]+)", 1))


def meta_charset(body: Column) -> Column:
    """Charset that a body declares in its first bytes, null for none."""
    head = F.decode(F.substring(body, 1, HEAD), "ISO-8859-1")
    return _label(F.regexp_extract(head, r"(?i)<meta[^>]+charset\s*=\s*[\"']?\s*([\w.:-]+)", 1))


def mark_charset(body: Column) -> Column:
    """Charset by byte order mark, null for none."""
    start = F.hex(F.substring(body, 1, 4))
    return (
        F.when(start.startswith("EFBBBF"), "utf-8")
        .when(start == "0000FEFF", "utf-32-be").when(start == "FFFE0000", "utf-32-le")
        .when(start.startswith("FEFF"), "utf-16-be").when(start.startswith("FFFE"), "utf-16-le")
    )


@F.pandas_udf(T.StringType())
def _other(body: pd.Series, label: pd.Series) -> pd.Series:
    """Strict text in a charset that Spark has no function for; null if it doesn't fit or isn't known."""

    def read(data: bytes | None, name: str | None) -> str | None:
        if data is None or name is None:
            return None
        try:
            if codecs.lookup(name).name in ("base64", "bz2", "hex", "quopri", "rot13", "uu", "zlib"):
                return None
            # what UTF-8 cannot hold is malformed too
            return bytes(data).decode(name).encode("utf-8").decode("utf-8")
        except (LookupError, UnicodeError, ValueError):
            return None

    return pd.Series([read(d, n) for d, n in zip(body, label, strict=True)], dtype=object)


def _western(body: Column) -> Column:
    return F.translate(F.decode(body, "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), WESTERN_HIGH)


def _utf8(body: Column) -> Column:
    """Strict, null if malformed."""
    text = body.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def body_parts(body: Column, content_type: Column) -> Column:
    """``text`` of a body and the ``charset`` it was read in.

    Tried in order, each strictly: a byte order mark, the body's own declaration, the content type's, UTF-8.
    A body that none fits is read as Windows-1252, which fits any bytes. Null bodies give nulls.
    """
    body = body.cast("binary")
    labels = F.filter(
        F.array(mark_charset(body), meta_charset(body), header_charset(F.coalesce(content_type, F.lit(""))), F.lit("utf-8")),
        lambda x: x.isNotNull(),
    )
    # the first label decides in nearly all cases; a strict failure falls through to the rest
    attempts = []
    for k in range(4):
        label = F.get(labels, F.lit(k))
        foreign = label.isNotNull() & ~label.isin(*UTF8_LABELS, *WESTERN_LABELS)
        text = (
            F.when(label.isin(*UTF8_LABELS), _utf8(body))
            .when(label.isin(*WESTERN_LABELS), _western(body))
            .when(foreign, _other(F.when(foreign, body), F.when(foreign, label)))
        )
        name = F.when(label.isin(*UTF8_LABELS), "utf-8").when(label.isin(*WESTERN_LABELS), "windows-1252").otherwise(label)
        attempts.append(F.when(text.isNotNull(), F.struct(text.alias("text"), name.alias("charset"))))
    last = F.struct(_western(body).alias("text"), F.lit("windows-1252").alias("charset"))
    found = F.coalesce(*attempts, F.when(body.isNotNull(), last))
    # the mark itself is no text
    return F.struct(F.regexp_replace(found["text"], "^﻿", "").alias("text"), found["charset"].alias("charset"))


def decode_body(body: Column, content_type: Column) -> Column:
    """Text of a body; see ``body_parts``."""
    return body_parts(body, content_type)["text"]
