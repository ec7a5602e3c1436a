"""Links of a page. The array forms stay inside the page's row; the table forms serve link tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitefacts.config import ExtractConfig
from sitefacts.functions import nodes as N
from sitefacts.functions.regex import any_of, let, unnest
from sitefacts.functions.urls import is_tracking_url, join_url, resolve_parts, split_url, url_path, without_port
from sitefacts.operators.joins import salted_join

DEFAULT = ExtractConfig()


def is_priority(url: Column, cfg: ExtractConfig = DEFAULT) -> Column:
    return F.lower(url_path(url)).rlike(any_of(cfg.priority_paths))


def internal_url(link: Column, site: Column, cfg: ExtractConfig = DEFAULT) -> Column:
    """Canonical form of a link inside the site from its resolved parts, null for any other link.

    A link without a host (``mailto:`` and the like) is not a page; under ``compat`` it counts as
    internal and takes up a slot, as a URL that no page has.
    """
    rooted = F.concat(
        link["scheme"], F.lit("://"), site, F.regexp_replace(link["path"], r"^(?!/)", "/")
    )
    if cfg.compat:
        return F.when((link["host"] == site) | (link["host"] == ""), rooted)
    return F.when((link["host"] == site) & link["scheme"].isin("http", "https"), rooted)


def prioritize_links(links: Column, cfg: ExtractConfig = DEFAULT) -> Column:
    """Priority paths first, page order otherwise kept."""
    flagged = F.transform(
        links, lambda u: F.struct(u.alias("url"), is_priority(u, cfg).alias("first"))
    )

    def regroup(pairs: Column) -> Column:
        ahead = F.filter(pairs, lambda p: p["first"])
        behind = F.filter(pairs, lambda p: ~p["first"])
        return F.transform(F.concat(ahead, behind), lambda p: p["url"])

    return let(flagged, regroup)


def page_links(anchors: Column, url: Column, site: Column, cfg: ExtractConfig = DEFAULT) -> Column:
    """Internal links in visiting order, without repeats, all of them."""
    internal = let(
        split_url(url),
        lambda base: F.transform(
            anchors,
            lambda n: let(
                resolve_parts(base, N.attr(n, "href")), lambda link: internal_url(link, site, cfg)
            ),
        ),
    )
    distinct = F.array_distinct(F.filter(internal, lambda u: u.isNotNull()))
    return prioritize_links(distinct, cfg)


def walk_links(links: Column, cfg: ExtractConfig = DEFAULT) -> Column:
    """Those of a page's links that a walk can reach.

    A visit follows ``links_per_page`` links that are not visited yet and never more than
    ``max_pages`` are, so no link after the first ``cfg.link_bound`` can be followed.
    """
    return F.slice(links, 1, cfg.link_bound)


def link_table(pages: DataFrame) -> DataFrame:
    """One row per link: ``page_id, site, src_url, pos, href, link`` with the resolved parts in ``link``.

    Copies of a URL stay apart by their ``page_id``. Links are resolved in the page's row: behind the
    generator, a filter on ``link`` would be pushed below it and resolve each link once for every part it names.
    """
    resolved = let(
        split_url(F.col("url")),
        lambda base: F.transform(
            "anchors",
            lambda n: let(N.attr(n, "href"), lambda href: F.struct(href.alias("href"), resolve_parts(base, href).alias("link"))),
        ),
    )
    pages = pages.select("page_id", "site", F.col("url").alias("src_url"), resolved.alias("anchors"))
    rows = unnest(pages, "anchors", "pos", "anchor")
    return rows.select("page_id", "site", "src_url", "pos", "anchor.href", "anchor.link")


def internal_links(links: DataFrame, cfg: ExtractConfig = DEFAULT) -> DataFrame:
    """Links of a link table that stay inside their site, as ``dst_url``."""
    return links.withColumn("dst_url", internal_url(F.col("link"), F.col("site"), cfg)).filter(
        F.col("dst_url").isNotNull()
    )


def distinct_links(links: DataFrame) -> DataFrame:
    """First occurrence of each target on its page."""
    return links.groupBy("page_id", "site", "src_url", "dst_url").agg(F.min("pos").alias("pos"))


def top_links(links: DataFrame, n: int = DEFAULT.links_per_page, cfg: ExtractConfig = DEFAULT) -> DataFrame:
    """First ``n`` links of each page in visiting order, as ``rank`` 1 to ``n``."""
    order = Window.partitionBy("page_id", "site", "src_url").orderBy(
        F.col("is_priority").desc(), F.col("pos")
    )
    return (
        links.withColumn("is_priority", is_priority(F.col("dst_url"), cfg))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
    )


def social_rules(spark: SparkSession, cfg: ExtractConfig = DEFAULT) -> DataFrame:
    """The configured platforms as a rule table ``platform, domain``, broadcast: it is as long as the setting."""
    rows = [(platform, domain) for platform, domains in cfg.social_domains for domain in domains]
    return F.broadcast(spark.createDataFrame(rows, "platform string, domain string"))


def social_table(links: DataFrame, rules: DataFrame) -> DataFrame:
    """First link of each page to each platform: ``page_id, site, platform, url``.

    ``links`` is a link table resolved against the site's start URL, ``rules(platform, domain)`` may have
    any size; each domain belongs to one platform. A suffix join: a link's host is exploded to its label suffixes
    (``www.a.com``, ``a.com``, ``com``), which meet the domains by equality. A domain that most links lead to is
    split by salt.
    """
    host = without_port(F.col("link.host"))
    rows = links.select("page_id", "site", "pos", join_url(F.col("link")).alias("url"), host.alias("host"))
    rows = rows.filter((F.col("host") != "") & ~is_tracking_url(F.col("url")))
    suffixes = let(
        F.split("host", r"\."),
        lambda labels: F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")),
    )
    keyed = rows.select("page_id", "site", "pos", "url", F.explode(suffixes).alias("domain"))
    met = salted_join(keyed, rules.select("platform", F.lower("domain").alias("domain")), ["domain"], F.struct("page_id", "pos"))
    return met.groupBy("page_id", "site", "platform").agg(F.min_by("url", "pos").alias("url"))
