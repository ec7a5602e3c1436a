"""Python-dialect patterns on the JVM regex engine, plus small string predicates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What Python's str.strip() and \s treat as white space.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    map(chr, range(0x2000, 0x200B))
) + "\u2028\u2029\u202f\u205f\u3000"
_SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CLASSES = {
    True: {"w": r"\p{L}\p{N}_", "s": _SPACE, "d": r"\p{Nd}"},
    False: {"w": r"A-Za-z0-9_", "s": r"\t-\r ", "d": r"0-9"},
}


def jvm(pattern: str, unicode: bool = True, ignore_case: bool = False) -> str:
    """Rewrite ``\\w \\s \\d \\b`` of a Python pattern into explicit classes."""
    classes = _CLASSES[unicode]
    word = f"[{classes['w']}]"
    boundary = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    out, in_class = [], False
    for piece in re.findall(r"\\.|.", pattern, re.S):
        if piece[0] == "\\" and piece[1] in classes:
            out.append(classes[piece[1]] if in_class else f"[{classes[piece[1]]}]")
        elif piece == "\\b" and not in_class:
            out.append(boundary)
        else:
            if piece == "[":
                in_class = True
            elif piece == "]":
                in_class = False
            out.append(piece)
    return ("(?diu)" if ignore_case else "(?d)") + "".join(out)


def any_of(words: Iterable[str]) -> str:
    """Alternation of literal words."""
    return "|".join(re.sub(r"([.+*?^$()\[\]{}|\\])", r"\\\1", w) for w in words)


def strip(c: Column) -> Column:
    """Trim every white-space character, as ``str.strip`` does (``trim`` cuts blanks only)."""
    return F.trim(c, F.lit(WHITESPACE))


def collapse(c: Column) -> Column:
    """Runs of white space to one blank, ends trimmed."""
    return strip(F.regexp_replace(c, f"[{_SPACE}]+", " "))


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches of an (already JVM) pattern, empty array for none."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def len_between(c: Column, lo: int, hi: int) -> Column:
    """Strict bounds on the length."""
    return (F.length(c) > lo) & (F.length(c) < hi)


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """True when the lower-cased text holds one of the words as a substring."""
    return F.lower(c).rlike(any_of(words))


def title_case(c: Column) -> Column:
    """``str.title``: a new word starts after every character that has no case."""
    cased = r"[\p{Lu}\p{Ll}\p{Lt}]"
    pieces = find_all(c, f"{cased}+|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+")
    return F.array_join(F.transform(pieces, F.initcap), "")


def first(arr: Column) -> Column:
    """First array element, null when there is none."""
    return F.get(arr, F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name inside ``body`` so that it is computed once."""
    return first(F.transform(F.array(value), body))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def unnest(df: DataFrame, items: Column | str, pos: str, value: str) -> DataFrame:
    """Add one row per array item with its position; rows without items are dropped.

    The outer generator with a null test afterwards: the inner one lets the optimizer test the
    array's size beforehand, which computes an expensive array twice.
    """
    return df.select("*", F.posexplode_outer(items).alias(pos, value)).filter(F.col(pos).isNotNull())
