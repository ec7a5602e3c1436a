"""URL columns. Built from the RFC 3986 split by regular expression: ``parse_url`` raises or
returns null for many links found in the wild."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitefacts.config import TRACKING_MARKS
from sitefacts.functions.regex import any_of, let, title_case

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
# Optional scheme and authority; what is left starts at the path.
_HEAD = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?"
_C0_AND_BLANK = "".join(map(chr, range(0x21)))


def _clean(url: Column) -> Column:
    """Leading control characters and blanks go, tabs and line breaks go everywhere."""
    return F.translate(F.ltrim(url, F.lit(_C0_AND_BLANK)), "\t\r\n", "")


def url_scheme(url: Column) -> Column:
    """Lower-case scheme, empty when there is none."""
    return F.lower(F.regexp_extract(_clean(url), _SCHEME, 1))


def url_host(url: Column) -> Column:
    """Authority part as written (port and ``www.`` kept), empty when there is none."""
    return F.regexp_extract(_clean(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    """Path without parameters of the last segment, empty when there is none."""
    path = F.regexp_extract(_clean(url), _HEAD + r"([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*$", "")


def split_url(url: Column) -> Column:
    """All parts of a URL in one struct: ``raw, scheme, host, path, params, query, fragment``."""

    def parts(c: Column) -> Column:
        path = F.regexp_extract(c, _HEAD + r"([^?#]*)", 1)
        return F.struct(
            c.alias("raw"),
            F.lower(F.regexp_extract(c, _SCHEME, 1)).alias("scheme"),
            F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1).alias("host"),
            F.regexp_replace(path, r";[^/]*$", "").alias("path"),
            F.regexp_extract(path, r";([^/]*)$", 1).alias("params"),
            F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1).alias("query"),
            F.regexp_extract(c, r"^[^#]*#(?s:(.*))$", 1).alias("fragment"),
        )

    return let(_clean(url), parts)


def _after(mark: str, part: Column) -> Column:
    return F.when(part != "", F.concat(F.lit(mark), part)).otherwise("")


def canonical_url(url: Column) -> Column:
    """``scheme://host/path`` only; null without a host."""
    host, path = url_host(url), url_path(url)
    return F.when(
        host != "",
        F.concat(url_scheme(url), F.lit("://"), host, F.when(path == "", "/").otherwise(path)),
    )


def normalize_url(url: Column) -> Column:
    """Seed form: ``https://`` is assumed when the scheme is missing; null for an invalid seed."""
    with_scheme = F.when(url.rlike(r"^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    return canonical_url(with_scheme)


def _drop_dot_segments(path: Column) -> Column:
    segments = F.split(path, "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    closed = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit(""))))
    return F.array_join(F.coalesce(closed, kept), "/")


def resolve_parts(base: Column, href: Column) -> Column:
    """Parts of a link found on a page whose URL parts are ``base`` (an http or https URL).

    ``raw`` is set only where the link stays as written: another scheme, or an empty link.
    """

    def resolve(ref: Column) -> Column:
        foreign = (ref["scheme"] != "") & (ref["scheme"] != base["scheme"])
        own_host = foreign | (ref["host"] != "")
        no_path = (ref["path"] == "") & (ref["params"] == "")
        # A relative path continues after the last slash of the base; empty inner segments vanish.
        folder = F.regexp_extract(base["path"], r"^(?:/|(.*/)[^/]*)$", 1)
        joined = F.concat(F.when(folder == "", "/").otherwise(folder), ref["path"])
        merged = F.when(ref["path"].startswith("/"), ref["path"]).otherwise(
            F.regexp_replace(joined, "//+", "/")
        )
        walked = let(
            merged,
            lambda p: F.when(p.rlike(r"(?:^|/)\.\.?(?:/|$)"), _drop_dot_segments(p)).otherwise(p),
        )
        path = (
            F.when(own_host, ref["path"])
            .when(no_path, base["path"])
            .otherwise(F.regexp_replace(walked, r"^(?!/)", "/"))
        )
        inherits = ~own_host & no_path & (ref["query"] == "")
        return F.struct(
            F.when(ref["raw"] == "", base["raw"]).when(foreign, href).alias("raw"),
            F.when(foreign, ref["scheme"]).otherwise(base["scheme"]).alias("scheme"),
            F.when(own_host, ref["host"]).otherwise(base["host"]).alias("host"),
            path.alias("path"),
            ref["params"].alias("params"),
            F.when(inherits, base["query"]).otherwise(ref["query"]).alias("query"),
            ref["fragment"].alias("fragment"),
        )

    return let(split_url(F.coalesce(href, F.lit(""))), resolve)


def join_url(parts: Column) -> Column:
    """URL text of resolved parts."""
    return F.coalesce(
        parts["raw"],
        F.concat(
            parts["scheme"], F.lit("://"), parts["host"], parts["path"],
            _after(";", parts["params"]), _after("?", parts["query"]), _after("#", parts["fragment"]),
        ),
    )


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found on the page ``base``."""
    return let(split_url(base), lambda b: let(resolve_parts(b, href), join_url))


def domain_name(url: Column) -> Column:
    """First host label without ``www.``, capitalised; null when empty."""
    label = F.regexp_extract(F.regexp_replace(url_host(url), r"^www\.", ""), r"^([^.]*)", 1)
    parts = F.filter(F.split(label, "-"), lambda p: p != "")
    return F.when(label.contains("-"), F.array_join(F.transform(parts, F.initcap), "-")).when(
        label != "", title_case(label)
    )


def is_tracking_url(url: Column) -> Column:
    return F.lower(url).rlike(any_of(TRACKING_MARKS))


def without_port(host: Column) -> Column:
    """Host name alone, lower case."""
    return F.lower(F.regexp_extract(host, r"^(?:[^@]*@)?([^:]*)", 1))

