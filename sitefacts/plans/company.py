"""Page corpus to company records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts.config import ExtractConfig
from sitefacts.functions.urls import url_scheme
from sitefacts.operators.crawl import bucketed_index, crawl_attempts, visits
from sitefacts.operators.extract import FACTS, page_facts, walk_facts
from sitefacts.operators.fold import site_records
from sitefacts.operators.login import robots_annotate
from sitefacts.operators.parse import WALK_ATTRS, parse_pages
from sitefacts.sources.pages import failed_pages, first_page_seeds, valid_pages
from sitefacts.sources.storage import spread, staged

DEFAULT = ExtractConfig()


def with_site_url(pages: DataFrame) -> DataFrame:
    """Add the site's start URL as far as a page can tell: the root of its host."""
    root = F.concat(url_scheme(F.col("url")), F.lit("://"), F.col("site"), F.lit("/"))
    return pages.withColumn("site_url", root)


def page_copy() -> Column:
    """Tells copies of a page with equal ``page_id`` apart by what the facts are made of."""
    return F.xxhash64("html", F.array_sort(F.map_entries("headers")))


def _outcomes(facts: DataFrame, names: tuple[str, ...]) -> DataFrame:
    failed_parse = F.col("parse_error").isNotNull()
    outcome = F.when(failed_parse, "error").when(F.col("login"), "login").otherwise("ok")
    note = F.concat(F.lit("Unexpected error: "), F.col("url"), F.lit(" - "), F.col("parse_error"))
    return facts.select(
        "page_id", "copy", "site", "url", outcome.alias("outcome"), F.when(failed_parse, note).alias("note"),
        "links", *names,
    )


def _readable(pages: DataFrame) -> DataFrame:
    return with_site_url(valid_pages(pages)).withColumn("copy", page_copy()).select(
        "page_id", "copy", "site", "site_url", "url", "headers", "html"
    )


def corpus_facts(pages: DataFrame, cfg: ExtractConfig = DEFAULT) -> DataFrame:
    """Facts table of a page table: one row per page with its ``outcome``.

    ``ok`` and ``login`` pages were parsed; ``error`` and ``skipped`` pages never reach the parser.
    Narrow from scan to result, apart from spreading a scan of too few tasks.
    """
    facts = page_facts(parse_pages(spread(_readable(pages))), cfg)
    return _outcomes(facts, FACTS).unionByName(failed_pages(pages), allowMissingColumns=True)


def corpus_links(pages: DataFrame, cfg: ExtractConfig = DEFAULT) -> DataFrame:
    """First pass over a corpus: outcome and links of every page, nothing else is extracted."""
    good = spread(_readable(pages)).drop("site_url")
    facts = walk_facts(parse_pages(good, attrs=WALK_ATTRS), cfg)
    return _outcomes(facts, ()).unionByName(failed_pages(pages), allowMissingColumns=True)


def picked_pages(pages: DataFrame, picked: DataFrame) -> DataFrame:
    """The picked copies of pages; ``picked`` (site, url, page_id, copy) is unique by ``(site, url)``.

    Where the join shuffles, Spark's runtime Bloom filter of the picked URLs drops the other pages at
    their scan, so only picked HTML moves.
    """
    wanted = picked.select("site", "url", F.col("page_id").alias("__page_id"), F.col("copy").alias("__copy"))
    met = _readable(pages).join(wanted, ["site", "url"])
    same = F.col("page_id").eqNullSafe(F.col("__page_id")) & F.col("copy").eqNullSafe(F.col("__copy"))
    return met.filter(same).drop("__page_id", "__copy")


def picked_facts(pages: DataFrame, picked: DataFrame, cfg: ExtractConfig = DEFAULT) -> DataFrame:
    """Second pass: facts of the picked copies only. The join stands before the parser, so no other page is parsed."""
    good = spread(picked_pages(pages, picked))
    return unique_pages(_outcomes(page_facts(parse_pages(good), cfg), FACTS))


def _copy_order(columns: list[str]) -> Column:
    """By ``page_id``, then by content; a facts table without ``copy`` goes by outcome and links."""
    # a null struct would lose the URL; a null id only comes first
    names = [c for c in ("page_id", "copy", "outcome", "note") if c in columns]
    return F.struct(*names, *([] if "copy" in columns else [F.xxhash64("outcome", "links")]))


def unique_pages(facts: DataFrame) -> DataFrame:
    """One row per ``(site, url)``: the copy with the lowest ``page_id``, equal ids by a hash.

    Copies of a URL collapse before the shuffle, so a URL that holds any share of the rows costs one
    row per task; the later joins on ``(site, url)`` then meet each key once.
    """
    rest = [c for c in facts.columns if c not in ("site", "url")]
    picked = facts.groupBy("site", "url").agg(F.min_by(F.struct(*rest), _copy_order(rest)).alias("f"))
    return picked.select("site", "url", "f.*")


def company_records(
    pages: DataFrame,
    seeds: DataFrame | None = None,
    robots: DataFrame | None = None,
    crawl_ts: datetime = datetime(1970, 1, 1),
    cfg: ExtractConfig = DEFAULT,
    order: str = "dfs",
    work_dir: str | None = None,
) -> DataFrame:
    """One company record per seed; a site with several seeds has as many records.

    ``crawl_ts`` is a parameter and not the clock, so a rerun gives equal records. Without ``seeds``
    each site starts at its page with the lowest ``page_id``.

    Two passes over the pages: links and login walls of all, then the other facts of those that the
    walks visit, at most ``max_pages`` of a walk.
    """
    seeds = staged(first_page_seeds(pages) if seeds is None else seeds, "seeds", work_dir)
    links = unique_pages(corpus_links(pages, cfg))
    index = bucketed_index(links, cfg, ("page_id", "copy", "note"), work_dir, dealt=True)
    attempts = staged(crawl_attempts(seeds, index, cfg, order), "attempts", work_dir)
    seen = attempts.filter(F.col("outcome") == "ok").select("site", "url").distinct()
    picked = staged(seen.join(index, ["site", "url"]).select("site", "url", "page_id", "copy", F.lit("ok").alias("kind")), "picked", work_dir)
    facts = staged(picked_facts(pages, picked.filter("kind = 'ok'"), cfg), "page_facts", work_dir)
    return _records(seeds, attempts, index, facts, robots, crawl_ts, cfg)


def records_from_facts(
    facts: DataFrame,
    seeds: DataFrame,
    robots: DataFrame | None = None,
    crawl_ts: datetime = datetime(1970, 1, 1),
    cfg: ExtractConfig = DEFAULT,
    order: str = "dfs",
    work_dir: str | None = None,
) -> DataFrame:
    """Records from a table of all facts of all pages, one or more copies of each.

    The table is staged once; the walk then reads only the link columns, and the fold joins only the
    rows that were visited.
    """
    facts = staged(unique_pages(facts), "page_facts", work_dir)
    seeds = staged(seeds, "seeds", work_dir)
    index = bucketed_index(facts, cfg, ("note",), work_dir)
    attempts = staged(crawl_attempts(seeds, index, cfg, order), "attempts", work_dir)
    return _records(seeds, attempts, index, facts, robots, crawl_ts, cfg)


def _records(
    seeds: DataFrame, attempts: DataFrame, index: DataFrame, facts: DataFrame, robots: DataFrame | None,
    crawl_ts: datetime, cfg: ExtractConfig,
) -> DataFrame:
    visited = visits(attempts).join(facts.select("site", "url", *FACTS), ["site", "url"])
    failed = attempts.filter(F.col("outcome") == "error").select("site", "url").distinct()
    notes = failed.join(index.select("site", "url", "note"), ["site", "url"])
    tried = attempts.join(notes, ["site", "url"], "left")
    if robots is None:
        tried = tried.withColumn("robots_note", F.lit(None).cast("string"))
    else:
        tried = robots_annotate(tried, robots, cfg.user_agent)
    return site_records(seeds, visited, tried, crawl_ts, cfg)
