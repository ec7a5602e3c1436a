"""Per-page facts to one record per site."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefacts import config as C
from sitefacts.config import ExtractConfig
from sitefacts.functions.regex import unnest

DEFAULT = ExtractConfig()


def first_nonempty(c: Column, seq: Column) -> Column:
    """Aggregate: value of the lowest ``seq`` that is neither null nor empty."""
    return F.min_by(c, F.when(c != "", seq))


def ordered_union(c: Column, seq: Column) -> Column:
    """Aggregate: distinct items of the lists in first-seen order.

    Collects a group's lists, so it belongs behind the page budget; ``ordered_union_rows`` is the
    form for groups of any size.
    """
    lists = F.array_sort(F.collect_list(F.struct(seq.alias("seq"), c.alias("list"))))
    return F.array_distinct(F.flatten(F.transform(lists, lambda x: x["list"])))


def ordered_union_rows(df: DataFrame, keys: list[str], items: str, seq: str) -> DataFrame:
    """Distinct items per key with the place of their first appearance, ``first_seq`` and ``first_pos``.

    ``first_pos`` counts the distinct items of the list. The shuffle key holds the item and fixed-size
    minima run before the shuffle, so a key with any share of the rows stays spread.
    """
    lists = df.select(*keys, F.col(seq).alias("seq"), F.array_distinct(items).alias("items"))
    return (
        unnest(lists, "items", "pos", "item")
        .groupBy(*keys, "item")
        .agg(F.min("seq").alias("first_seq"), F.min_by("pos", "seq").alias("first_pos"))
    )


def merge_maps_last(df: DataFrame, keys: list[str], mapping: str, seq: str) -> DataFrame:
    """Merged maps as rows ``name, value`` per key: the last page that has an entry sets it.

    Rows and not one map per key, so a key may have any number of entries; ``fold_pages`` builds the
    map itself for the few social platforms.
    """
    entries = df.select(*keys, seq, F.explode(mapping).alias("name", "value"))
    return entries.groupBy(*keys, "name").agg(F.max_by("value", seq).alias("value"))


def first_n_per_key(df: DataFrame, keys: list[str], order: str, n: int, salts: int = 64) -> DataFrame:
    """First ``n`` rows of each key, as ``rank`` from 1; ``order`` must be unique within a key.

    Ranks within salted parts of a key first, so no task sorts a whole hot key; every row among the
    first ``n`` of the key is among the first ``n`` of its part.
    """
    part = F.pmod(F.xxhash64(order), F.lit(salts))
    local = Window.partitionBy(*keys, "__part").orderBy(order)
    whole = Window.partitionBy(*keys).orderBy(order)
    return (
        df.withColumn("__part", part)
        .withColumn("rank", F.row_number().over(local))
        .filter(F.col("rank") <= n)
        .drop("__part")
        .withColumn("rank", F.row_number().over(whole))
        .filter(F.col("rank") <= n)
    )


def limitations(attempts: DataFrame) -> DataFrame:
    """Notes of each walk's attempts in order: ``site, seed, notes``; needs ``robots_note`` and ``note``."""
    notes = F.filter(F.array("robots_note", "note"), lambda n: n.isNotNull())
    return (
        attempts.select("site", "seed", "attempt", notes.alias("notes"))
        .filter(F.size("notes") > 0)
        .groupBy("site", "seed")
        .agg(F.array_sort(F.collect_list(F.struct("attempt", "notes"))).alias("ordered"))
        .select("site", "seed", F.flatten(F.transform("ordered", lambda x: x["notes"])).alias("notes"))
    )


_SCALARS = ("company_name", "tagline", "what_they_do", "address", "contact_page", "careers_page")
_LISTS = ("key_pages", "offerings", "targets", "emails", "phones", "roles")
_SIGNALS = ("clients", "case_studies", "testimonials", "certifications_awards")


def fold_partial(visited: DataFrame, cfg: ExtractConfig = DEFAULT) -> DataFrame:
    """Fold state of any part of the visited pages of each walk: ``site, seed, state``.

    For a scalar the state holds the earliest page that has it, for a list the list of each page, for
    a platform the latest page that links it; so two states can be merged, in any order and grouping,
    and a page that is in both counts once. A walk visits ``max_pages`` pages at most, which bounds
    its state. Name and tagline may come from the start page and from ``about`` pages only.
    """
    seq = F.col("seq")
    names_it = (F.col("depth") == 0) | F.array_contains("key_pages", "about")

    def scalar(name: str) -> Column:
        usable = F.col(name) != ""
        usable = usable & names_it if name in ("company_name", "tagline") else usable
        return F.when(usable, F.struct(seq.alias("seq"), F.col(name).alias("value"))).alias(name)

    def last(platform: str) -> Column:
        value = F.col("social")[platform]
        return F.when(value.isNotNull(), F.struct(seq.alias("seq"), value.alias("value"))).alias(platform)

    single = visited.select(
        "site", "seed",
        F.struct(
            F.struct(*[scalar(n) for n in _SCALARS]).alias("scalars"),
            F.struct(
                *[F.array(F.struct(seq.alias("seq"), F.col(n).alias("list"))).alias(n) for n in _LISTS]
            ).alias("lists"),
            F.struct(*[F.col("proof")[n].alias(n) for n in _SIGNALS]).alias("signals"),
            F.struct(*[last(p) for p, _ in cfg.social_domains]).alias("social"),
            F.array(F.struct(seq.alias("seq"), "url", "depth")).alias("pages"),
        ).alias("state"),
    )
    return fold_merge(single, cfg)


def fold_merge(states: DataFrame, cfg: ExtractConfig = DEFAULT) -> DataFrame:
    """One state per walk from any number of them. Associative, commutative and idempotent."""

    def each(group: str, names, aggregate) -> Column:
        return F.struct(*[aggregate(F.col(f"state.{group}.{n}")).alias(n) for n in names]).alias(group)

    def union(c: Column) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))

    return states.groupBy("site", "seed").agg(
        F.struct(
            each("scalars", _SCALARS, F.min),
            each("lists", _LISTS, union),
            each("signals", _SIGNALS, F.bool_or),
            each("social", [p for p, _ in cfg.social_domains], F.max),
            union(F.col("state.pages")).alias("pages"),
        ).alias("state")
    )


def fold_finish(states: DataFrame, cfg: ExtractConfig = DEFAULT) -> DataFrame:
    """One flat row per walk from its whole state."""
    platforms = [p for p, _ in cfg.social_domains]
    pages = F.col("state.pages")

    def listed(name: str) -> Column:
        return F.array_distinct(F.flatten(F.transform(f"state.lists.{name}", lambda x: x["list"])))

    return states.select(
        "site", "seed",
        *[F.col(f"state.scalars.{n}.value").alias(n) for n in _SCALARS],
        *[listed(n).alias(n) for n in _LISTS],
        *[F.col(f"state.signals.{n}").alias(n) for n in _SIGNALS],
        F.map_filter(
            F.map_from_arrays(
                F.array(*[F.lit(p) for p in platforms]),
                F.array(*[F.col(f"state.social.{p}.value") for p in platforms]),
            ),
            lambda _, v: v.isNotNull(),
        ).alias("social"),
        F.array_distinct(F.transform(pages, lambda x: x["url"])).alias("pages_visited"),
        F.array_max(F.transform(pages, lambda x: x["depth"])).alias("depth"),
        F.size(pages).cast("long").alias("n_pages"),
    )


def fold_pages(visited: DataFrame, cfg: ExtractConfig = DEFAULT) -> DataFrame:
    """One flat row per walk from its visited pages (``max_pages`` at most), in one shuffle."""
    return fold_finish(fold_partial(visited, cfg), cfg)


def apply_login_override(sites: DataFrame) -> DataFrame:
    """Empty the record of every site with ``login`` set: only its URL and the login note stay."""
    kept = ("site", "seed", "website_url", "login")
    emptied = {
        name: F.when(~F.col("login"), F.col(name)) for name in sites.columns if name not in kept
    }
    emptied["notes"] = F.when(F.col("login"), F.array(F.lit(C.LOGIN_NOTE))).otherwise(F.col("notes"))
    return sites.withColumns(emptied)


def assemble(sites: DataFrame, crawl_ts: datetime) -> DataFrame:
    """The nested record: missing scalars are null, missing lists and maps are empty."""

    def lists(name: str, alias: str) -> Column:
        return F.coalesce(F.col(name), F.array().cast("array<string>")).alias(alias)

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)).alias(name)

    no_social = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    return sites.select(
        "site",
        F.struct("company_name", "website_url", "tagline").alias("identity"),
        F.struct(
            F.col("what_they_do"),
            lists("offerings", "primary_offerings"),
            lists("targets", "target_customers_or_industries"),
        ).alias("business_summary"),
        F.struct(
            lists("key_pages", "key_pages_detected"),
            F.struct(
                flag("clients"), flag("case_studies"), flag("testimonials"),
                flag("certifications_awards"),
            ).alias("proof_signals_found"),
            F.coalesce("social", no_social).alias("social_links"),
        ).alias("evidence_proof_signals"),
        F.struct(
            lists("emails", "emails"),
            lists("phones", "phone_numbers"),
            F.col("address").alias("physical_address"),
            F.col("contact_page").alias("contact_page_url"),
        ).alias("contact_location"),
        F.struct(
            F.col("careers_page").alias("careers_page_url"),
            lists("roles", "roles_or_departments_mentioned"),
        ).alias("team_hiring_signals"),
        F.struct(
            F.lit(crawl_ts).cast("timestamp").alias("timestamp_of_scrape"),
            lists("pages_visited", "pages_visited"),
            F.coalesce("depth", F.lit(0)).alias("crawl_depth_used"),
            lists("notes", "errors_or_limitations"),
            F.coalesce("login", F.lit(False)).alias("login_required"),
        ).alias("metadata"),
    )


def site_records(
    seeds: DataFrame,
    visited: DataFrame,
    attempts: DataFrame,
    crawl_ts: datetime,
    cfg: ExtractConfig = DEFAULT,
) -> DataFrame:
    """One record per seed from its visited pages (with facts) and its attempts (with notes)."""
    counts = F.col("outcome") == "login"
    if cfg.login_scope == "seed":
        counts = counts & (F.col("depth") == 0)
    walls = attempts.groupBy("site", "seed").agg(F.bool_or(counts).alias("login"))
    sites = (
        seeds.select("site", F.col("url").alias("seed"), F.col("url").alias("website_url"))
        .join(fold_pages(visited, cfg), ["site", "seed"], "left")
        .join(limitations(attempts), ["site", "seed"], "left")
        .join(walls, ["site", "seed"], "left")
        .withColumn("login", F.coalesce("login", F.lit(False)))
    )
    return assemble(apply_login_override(sites), crawl_ts)
