"""Element look-ups on the ``nodes`` array of a page (see ``operators.parse``).

A node's ``id`` is its array index and ``end`` the index of its last descendant, so an element's
content is one ``slice`` and every look-up is a narrow column expression: no explode, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitefacts.functions.regex import first, let, strip

NODE_TYPE = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
    ]
)
REMOVED = ("script", "style", "meta", "link")

Test = Callable[[Column], Column]


def tag_is(tags: str | Sequence[str]) -> Test:
    if isinstance(tags, str):
        return lambda n: n["tag"] == tags
    return lambda n: n["tag"].isin(*tags)


def attr(node: Column, name: str, default: str = "") -> Column:
    """Attribute value, ``default`` when the attribute is missing."""
    return F.coalesce(F.try_element_at(node["attrs"], F.lit(name)), F.lit(default))


def has_attr(name: str) -> Test:
    return lambda n: F.map_contains_key(n["attrs"], name)


def attr_like(name: str, pattern: str) -> Test:
    """Attribute present and matching a pattern, case ignored."""
    return lambda n: F.coalesce(
        F.try_element_at(n["attrs"], F.lit(name)).rlike(f"(?i){pattern}"), F.lit(False)
    )


def attr_is(name: str, value: str) -> Test:
    return lambda n: F.coalesce(F.try_element_at(n["attrs"], F.lit(name)) == value, F.lit(False))


def both(*tests: Test) -> Test:
    def check(n: Column) -> Column:
        result = tests[0](n)
        for t in tests[1:]:
            result = F.when(result, t(n)).otherwise(F.lit(False))
        return result

    return check


def either(*tests: Test) -> Test:
    def check(n: Column) -> Column:
        result = tests[0](n)
        for t in tests[1:]:
            result = result | t(n)
        return result

    return check


def find_nodes(nodes: Column, *tests: Test) -> Column:
    """All nodes that pass every test, in document order."""
    return F.filter(nodes, both(*tests))


def first_node(nodes: Column, *tests: Test) -> Column:
    return first(find_nodes(nodes, *tests))


def inside(nodes: Column, node: Column) -> Column:
    """Everything below ``node``; null when ``node`` is null."""
    return F.slice(nodes, node["id"] + 2, node["end"] - node["id"])


def descendants(nodes: Column, node: Column, *tests: Test, limit: int | None = None) -> Column:
    """Matching descendants; ``limit`` counts before any later filter."""
    found = find_nodes(inside(nodes, node), *tests)
    return found if limit is None else F.slice(found, 1, limit)


def contains_node(outer: Column, inner: Column) -> Column:
    return (outer["id"] < inner["id"]) & (inner["id"] <= outer["end"])


def selector(css: str) -> Test:
    """``tag.class``, ``.class`` or ``#id``; classes and ids compare whole and case-sensitive."""
    if css.startswith("#"):
        return attr_is("id", css[1:])
    tag, _, cls = css.partition(".")
    has_class: Test = lambda n: F.array_contains(F.split(attr(n, "class"), r"\s+"), cls)
    is_element: Test = lambda n: F.map_contains_key(n["attrs"], "class")
    return both(tag_is(tag), is_element, has_class) if tag else both(is_element, has_class)


def select_first(nodes: Column, css: str) -> Column:
    return first_node(nodes, selector(css))


def next_sibling(nodes: Column, node: Column, tag: str) -> Column:
    """First later sibling of that tag."""
    later = F.slice(nodes, node["end"] + 2, F.size(nodes))
    return first(F.filter(later, lambda n: (n["parent"] == node["parent"]) & (n["tag"] == tag)))


def texts(nodes: Column) -> Column:
    """Stripped, non-empty text pieces."""
    pieces = F.transform(F.filter(nodes, tag_is("#text")), lambda n: strip(n["text"]))
    return F.filter(pieces, lambda t: t != "")


def node_text(nodes: Column, node: Column, sep: str = "") -> Column:
    """Whole text of an element, pieces stripped and joined by ``sep``."""
    return F.array_join(texts(inside(nodes, node)), sep)


def raw_text(nodes: Column) -> Column:
    """Text as written, nothing stripped."""
    return F.array_join(F.transform(F.filter(nodes, tag_is("#text")), lambda n: n["text"]), "")


#: Nodes of an element that are looked at before all of them are.
FIRST_LOOK = 64


def only_string(nodes: Column, node: Column) -> Column:
    """The string of an element that holds exactly one string down a chain of only children.

    Whether it may be a chain is decided from its first nodes. So elements that are never closed, and
    hold the rest of the page each, cost a fixed look and not their size.
    """

    def kept(below: Column) -> Column:
        return F.filter(below, lambda n: ~n["tag"].isin(*REMOVED) & (n["tag"] != "#raw"))

    def is_chain(below: Column) -> Column:
        return F.size(F.array_distinct(F.transform(below, lambda n: n["parent"]))) == F.size(below)

    def only(below: Column) -> Column:
        last = F.try_element_at(below, F.lit(-1))
        return F.when(is_chain(below) & last["tag"].startswith("#"), last["text"])

    start = F.slice(nodes, node["id"] + 2, F.least(node["end"] - node["id"], F.lit(FIRST_LOOK)))
    return F.when(let(kept(start), is_chain), let(kept(inside(nodes, node)), only))


def links_by_text(nodes: Column, pattern: str) -> Column:
    """``a[href]`` elements whose only string matches, case ignored."""
    links = find_nodes(nodes, tag_is("a"), has_attr("href"))
    return F.filter(
        links, lambda n: F.coalesce(only_string(nodes, n).rlike(f"(?i){pattern}"), F.lit(False))
    )


def json_ld(nodes: Column) -> Column:
    """Parsed JSON-LD blocks as variants, bad JSON skipped."""
    blocks = find_nodes(nodes, tag_is("script"), attr_is("type", "application/ld+json"))
    bodies = F.transform(
        blocks, lambda b: F.array_join(F.transform(inside(nodes, b), lambda n: n["text"]), "")
    )
    return F.filter(F.transform(bodies, F.try_parse_json), lambda v: v.isNotNull())


def json_text(value: Column, path: str) -> Column:
    """String member of a JSON object; null for another type, a missing key or an empty string."""
    member = F.try_variant_get(value, path, "variant")
    is_text = F.schema_of_variant(member) == "STRING"
    return F.when(is_text, F.nullif(F.try_variant_get(value, path, "string"), F.lit("")))


def json_number_or_text(value: Column, path: str) -> Column:
    """The same, with numbers as text; null for 0."""
    member = F.try_variant_get(value, path, "variant")
    is_number = F.schema_of_variant(member).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    number = F.when(F.try_variant_get(value, path, "double") != 0, F.try_variant_get(value, path, "string"))
    return F.when(is_number, number).otherwise(json_text(value, path))
