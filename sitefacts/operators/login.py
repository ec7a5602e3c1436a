"""Login walls and robots notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefacts import config as C
from sitefacts.config import ExtractConfig
from sitefacts.functions import nodes as N
from sitefacts.functions.regex import contains_any, jvm
from sitefacts.functions.urls import url_host, url_path
from sitefacts.operators.joins import salted_join

LOGIN_SIGNALS = ("by_url", "by_title", "by_form", "by_text", "by_refresh", "by_header")


def login_by_url(url: Column) -> Column:
    return contains_any(url_path(url), C.LOGIN_PATHS)


def login_by_title(title: Column) -> Column:
    return F.coalesce(contains_any(title, C.LOGIN_TITLE_WORDS), F.lit(False))


def login_by_text(text: Column) -> Column:
    return F.lower(text).rlike("|".join(jvm(p) for p in C.LOGIN_TEXT_PATTERNS))


def login_by_form(nodes: Column) -> Column:
    """A form with a password field that sits in the main content or talks about signing in."""
    passwords = N.find_nodes(nodes, N.tag_is("input"), N.attr_is("type", "password"))
    forms = N.find_nodes(nodes, N.tag_is("form"))
    named = N.either(*[N.attr_like(a, C.LOGIN_FORM_ATTR) for a in ("id", "class", "action")])
    gate = F.exists(forms, named) | F.exists(
        passwords, N.attr_like("name", C.LOGIN_PASSWORD_NAME)
    )
    main = N.first_node(
        nodes, N.tag_is(("main", "article", "div")), N.attr_like("class", C.LOGIN_MAIN_CLASS)
    )

    def prominent(form: Column) -> Column:
        has_password = F.exists(passwords, lambda p: N.contains_node(form, p))
        in_main = F.coalesce(N.contains_node(main, form), F.lit(False))
        words = contains_any(N.raw_text(N.inside(nodes, form)), C.LOGIN_FORM_WORDS)
        return has_password & (in_main | words)

    return F.when(F.size(passwords) > 0, gate & F.exists(forms, prominent)).otherwise(False)


def login_by_refresh(nodes: Column) -> Column:
    refresh = N.first_node(nodes, N.tag_is("meta"), N.attr_like("http-equiv", "refresh"))
    return F.coalesce(contains_any(N.attr(refresh, "content"), C.LOGIN_PATHS), F.lit(False))


def login_by_header(headers: Column) -> Column:
    names = F.transform(F.map_keys(headers), F.lower)
    return F.coalesce(F.array_contains(names, "www-authenticate"), F.lit(False))


def login_columns(cfg: ExtractConfig = ExtractConfig()) -> dict[str, Column]:
    """The six signals over ``url``, ``nodes``, ``text`` and ``headers``."""
    nodes = F.col("nodes")
    title = N.first_node(nodes, N.tag_is("title"))
    body = N.raw_text(nodes) if cfg.compat else F.col("text")
    return {
        "by_url": login_by_url(F.col("url")),
        "by_title": login_by_title(N.node_text(nodes, title)),
        "by_form": login_by_form(nodes),
        "by_text": login_by_text(body),
        "by_refresh": login_by_refresh(nodes),
        "by_header": login_by_header(F.col("headers")),
    }


def login_signals(pages: DataFrame, cfg: ExtractConfig = ExtractConfig()) -> DataFrame:
    """Add the six signal columns."""
    return pages.withColumns(login_columns(cfg))


def login_required() -> Column:
    """Verdict over the signal columns."""
    verdict = F.lit(False)
    for name in LOGIN_SIGNALS:
        verdict = verdict | F.col(name)
    return verdict


def robots_rules(rules: DataFrame, agent: str = C.USER_AGENT) -> DataFrame:
    """The rules that apply to an agent: ``host, prefix, rule``, the first one of each prefix.

    The group of a host's first rule that names the agent applies, else its ``*`` group. The prefix ``*``
    fits every path.
    """
    token = agent.split("/")[0].lower()
    named = (F.col("agent") != "*") & F.lit(token).contains(F.lower("agent"))
    usable = rules.filter((named | (F.col("agent") == "*")) & F.col("path_prefix").isNotNull())
    first_named = F.min(F.when(named, F.struct("seq", "agent"))).over(Window.partitionBy("host"))
    usable = usable.withColumn("group", F.coalesce(first_named["agent"], F.lit("*"))).filter(F.col("agent") == F.col("group"))
    prefix = F.when(F.col("path_prefix") == "*", "").otherwise(F.col("path_prefix"))
    return usable.groupBy("host", prefix.alias("prefix")).agg(F.min(F.struct("seq", "allow", "path_prefix")).alias("rule"))


def robots_annotate(pages: DataFrame, rules: DataFrame, agent: str = C.USER_AGENT) -> DataFrame:
    """Add ``robots_note`` to the disallowed URLs; nothing is ever removed.

    ``rules(host, agent, seq, allow, path_prefix)``: within the group that applies (``robots_rules``) the
    first rule whose prefix fits decides. A prefix join: each different URL is exploded to the prefixes
    of its path, of the lengths that rules have, and these meet the rules by equality, the lowest ``seq``
    winning. A host with most of the URLs is split by salt; no host's rules are ever one row.
    """
    own = robots_rules(rules, agent)
    # one number for each length a prefix has
    lengths = sorted(r["n"] for r in own.select(F.length("prefix").alias("n")).distinct().collect())
    if not lengths:
        return pages.withColumn("robots_note", F.lit(None).cast("string"))
    urls = pages.select("url").distinct().select(
        "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")
    )
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    prefixes = urls.select("url", "host", F.explode(F.transform(fitting, lambda n: F.substring("path", F.lit(1), n))).alias("prefix"))
    met = salted_join(prefixes, own, ["host", "prefix"], F.col("url"))
    decided = met.groupBy("url").agg(F.min("rule").alias("rule")).filter(~F.col("rule.allow"))
    notes = decided.select("url", F.concat(F.lit("robots.txt restriction noted for "), F.col("url")).alias("robots_note"))
    return pages.join(notes, "url", "left")
