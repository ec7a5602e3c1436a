"""Facts found in plain text. Each rule scans the whole text in time linear in its length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitefacts import config as C
from sitefacts.functions.regex import (
    any_of, contains_any, empty_strings, find_all, jvm, len_between, let, strip, title_case,
)


def email_matches(text: Column, skip: Sequence[str], unicode: bool = True) -> Column:
    """Addresses in order of appearance, placeholders left out, repeats kept.

    An address holds no blank, so only blank-separated tokens with an ``@`` are searched. Before the
    search, an ``@`` that no domain follows is blotted out, and of a run of name characters that no
    ``@`` follows only the first is left (what stands before it may ask for a word end there). No match
    is lost or made by that, and every run that is left is tried once.
    """
    name, domain = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9.-]"
    lost = jvm(rf"@(?!{domain}+\.[A-Z|a-z]{{2,}}\b)", unicode)
    tokens = F.filter(F.split(text, jvm(r"\s+")), lambda t: t.contains("@"))
    tokens = F.transform(tokens, lambda t: F.regexp_replace(t, lost, "\u0001"))
    tokens = F.filter(tokens, lambda t: t.contains("@"))
    runs = rf"({name}*+@[A-Za-z0-9.|-]*+)|({name}){name}*+"
    tokens = F.transform(tokens, lambda t: F.regexp_replace(t, runs, "$1$2"))
    found = F.flatten(F.transform(tokens, lambda t: find_all(t, jvm(C.EMAIL_PATTERN, unicode))))
    kept = F.filter(found, lambda e: ~contains_any(e, skip)) if skip else found
    return F.when(text.contains("@"), kept).otherwise(empty_strings())


def phone_matches(text: Column, patterns: Sequence[str], unicode: bool = True) -> Column:
    """Number spellings with ten or more digits (a plus sign counts), pattern by pattern."""
    # No pattern reaches ten without nine digits that are at most two separators apart.
    plausible = text.rlike(jvm(r"(?:\d[-.\s()]{0,2}){8}\d", unicode))
    found = F.flatten(F.array(*[find_all(text, jvm(p, unicode)) for p in patterns]))
    kept = F.filter(
        found, lambda m: F.length(F.regexp_replace(m, jvm(r"[^\d+]", unicode), "")) >= 10
    )
    return F.when(plausible, F.transform(kept, strip)).otherwise(empty_strings())


def role_mentions(text: Column, unicode: bool = True) -> Column:
    """Job words with one or two neighbouring words, title-cased, without repeats."""
    lower = F.lower(text)
    found = [
        F.when(
            lower.contains(word),
            F.concat(*[find_all(lower, jvm(p.format(word=word), unicode)) for p in C.ROLE_PATTERNS]),
        ).otherwise(empty_strings())
        for word in C.JOB_WORDS
    ]
    titled = F.transform(F.flatten(F.array(*found)), lambda m: title_case(strip(m)))
    return F.array_distinct(F.filter(titled, lambda m: len_between(m, 5, 50)))


_TARGET_LEAD = r"(?:serving|targeting|focusing on|for)"
_TARGET_END = r"(?:industry|market|sector)"


def target_mentions(text: Column, unicode: bool = True) -> Column:
    """Industries named in the text (the two ``TARGET_PATTERNS``), without repeats.

    The first pattern can only match inside one chain "lead word, words of letters"; the chain is
    taken whole (possessively, so a long one cannot overflow the regex stack) and cut at its last
    industry word.
    """
    chain = jvm(_TARGET_LEAD + r"(?:\s+[A-Z][a-z]++)++", unicode, ignore_case=True)
    cut = jvm(_TARGET_LEAD + r"\s+((?s:.*)[a-z])\s+" + _TARGET_END, unicode, ignore_case=True)
    named = F.transform(
        F.when(F.lower(text).rlike(_TARGET_END), find_all(text, chain)).otherwise(empty_strings()),
        lambda c: F.regexp_extract(c, cut, 1),
    )
    listed = find_all(text, jvm(C.TARGET_PATTERNS[1], unicode, ignore_case=True), 1)
    stripped = F.transform(F.concat(named, listed), strip)
    return F.array_distinct(F.filter(stripped, lambda m: len_between(m, 3, 100)))


def longest(matches: Column) -> Column:
    """Longest string of an array, the first one on ties, null for an empty array."""
    return F.aggregate(
        matches,
        F.lit(None).cast("string"),
        lambda best, m: F.when(best.isNull() | (F.length(m) > F.length(best)), m).otherwise(best),
    )


def longest_match(text: Column, pattern: str) -> Column:
    return longest(find_all(text, pattern))


def _address_matches(
    text: Column, words: Sequence[str], last: str, lead: str, unicode: bool
) -> Column:
    """Matches of an address pattern, one at most per run of word characters, blanks and commas.

    A match never leaves its run and always ends at the last place where ``last`` fits, so the end
    is one greedy search. It starts in the first comma-free segment that holds a street word before
    that end. Searching run by run keeps the work linear, where the plain pattern tries every start.
    """
    street = any_of(words)
    runs = F.filter(
        find_all(text, jvm(r"[\w\s,]++", unicode)), lambda r: r.rlike(f"(?iu){street}")
    )
    closing = jvm(rf"^((?s:.*)){last}", unicode, ignore_case=True)
    ending = jvm(rf"^(?s:.*){last}" + ("" if lead else r"\s?"), unicode, ignore_case=True)
    opening = jvm(rf"(?:^|,)({lead}[\w\s]+(?:{street})[\s\w,])", unicode, ignore_case=True)
    skipped = jvm(rf"(?:^|,)([^,\d]*+)\d[\w\s]+(?:{street})[\s\w,]", unicode, ignore_case=True)

    def cut(run: Column) -> Column:
        head = F.regexp_extract(run, closing, 1)
        whole = F.regexp_extract(run, ending, 0)
        at = F.regexp_instr(head, F.lit(opening))
        comma = F.when(F.substr(head, at, F.lit(1)) == ",", 1).otherwise(0)
        lead_length = F.length(F.regexp_extract(head, skipped, 1)) if lead else F.lit(0)
        return F.when(at > 0, F.substr(whole, at + comma + lead_length))

    return F.filter(F.transform(runs, cut), lambda m: m.isNotNull())


def address_candidates(text: Column, unicode: bool = True) -> tuple[Column, Column]:
    """All matches of the two ``ADDRESS_PATTERNS``, as two arrays."""
    has_digits = text.rlike(jvm(r"\d{5}", unicode))
    zipped = F.when(
        has_digits,
        _address_matches(text, C.ADDRESS_WORDS_ZIP, r"\d{5}", r"[^,\d]*+\d", unicode),
    ).otherwise(empty_strings())
    named = _address_matches(text, C.ADDRESS_WORDS_CITY, r"[A-Z][a-z]", "", unicode)
    return zipped, named


def choose_address(zipped: Column, named: Column) -> Column:
    """Longest match of the first pattern when its length fits, else of the second."""
    fitting = [
        let(longest(found), lambda a: F.when(len_between(a, 10, 300), a)) for found in (zipped, named)
    ]
    return F.coalesce(*fitting)


def address_in_text(text: Column, unicode: bool = True) -> Column:
    return choose_address(*address_candidates(text, unicode))


def is_promotional(text: Column, patterns: Sequence[str] = C.PROMOTIONAL_PATTERNS) -> Column:
    return F.lower(text).rlike("|".join(jvm(p) for p in patterns))


