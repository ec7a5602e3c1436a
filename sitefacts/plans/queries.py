"""Named queries over the given tables; ``oracles`` states most of them again as plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from sitefacts import config as C
from sitefacts.functions import nodes as N
from sitefacts.functions import patterns as P
from sitefacts.functions import text as T
from sitefacts.functions import urls as U
from sitefacts.functions.charset import body_parts
from sitefacts.functions.regex import unnest
from sitefacts.operators import extract as X
from sitefacts.operators import fold, links, login
from sitefacts.operators.crawl import bucketed_index, crawl_attempts
from sitefacts.operators.joins import contained_in
from sitefacts.operators.parse import dom_nodes, exploded_nodes, parse_pages
from sitefacts.plans.company import company_records, corpus_links, unique_pages, with_site_url
from sitefacts.plans.supplier_sites import supplier_pages, supplier_robots, supplier_seeds
from sitefacts.sources import pages as S
from sitefacts.sources.storage import spread, staged

SEP = " ; "
#: Documents are read without the bounds of a page.
WHOLE = C.ExtractConfig(max_emails=None, max_phones=None)
Query = Callable[[SparkSession, str], DataFrame]


def joined(c: Column | str) -> Column:
    return F.array_join(c, SEP)


def _raw(spark: SparkSession, sf_dir: str, table: str = "pages") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the regex path, spread over the cores when the file is one row group."""
    return spread(_raw(spark, sf_dir).select("page_id", "html"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_raw(spark, sf_dir, "documents").select("doc_id", "text"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.load_pages(spark, f"{sf_dir}/pages.parquet")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_site_url(spread(S.valid_pages(_pages(spark, sf_dir))))
    used = pages.select("page_id", "site", "site_url", "url", "headers", "html")
    return X.structured_pages(parse_pages(used))


# --- URLs -----------------------------------------------------------------------------


def url_canonical(spark, d):
    return _raw(spark, d).select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


def seed_normalize(spark, d):
    bare = F.regexp_replace("url", r"^https?://", "")
    return _raw(spark, d).select("page_id", U.normalize_url(bare).alias("seed"))


def url_host_path(spark, d):
    url = F.col("url")
    return _raw(spark, d).select(
        "page_id", U.url_scheme(url).alias("scheme"), U.url_host(url).alias("host"), U.url_path(url).alias("path")
    )


def url_resolution(spark, d):
    """Each page URL as the base of several relative links made of its own path."""
    tail = F.regexp_extract(U.url_path(F.col("url")), r"([^/]*)/?$", 1)
    forms = F.array(
        F.concat(F.lit("/"), tail), F.concat(tail, F.lit("/x")), F.concat(F.lit("../"), tail),
        F.concat(F.lit("./"), tail, F.lit("/../y")), F.lit("?k=v"), F.lit("#top"),
        F.concat(F.lit("//cdn.example.org/"), tail), F.lit("mailto:x@y.z"),
    )
    rows = unnest(_raw(spark, d).select("page_id", "url"), forms, "form", "href")
    return rows.select(
        "page_id", "form", "href", U.resolve_url(F.col("url"), F.col("href")).alias("resolved")
    )


def domain_name(spark, d):
    return _raw(spark, d).select("page_id", U.domain_name(F.col("url")).alias("name"))


def tracking_urls(spark, d):
    return _raw(spark, d).select("page_id", U.is_tracking_url(F.col("url")).alias("tracking"))


def key_pages(spark, d):
    return _raw(spark, d).select("page_id", joined(X.key_pages(F.col("url"))).alias("labels"))


def key_page_counts(spark, d):
    """Labels over all pages of the supplier sites."""
    labels = unnest(supplier_pages(spark, d), X.key_pages(F.col("url")), "pos", "label")
    return labels.groupBy("label").agg(F.count("*").alias("n"))


# --- Page text ------------------------------------------------------------------------


def page_title(spark, d):
    return _html(spark, d).select("page_id", T.page_title(F.col("html")).alias("title"))


def page_text(spark, d):
    return _html(spark, d).select("page_id", T.page_text(F.col("html")).alias("text"))


def page_text_parsed(spark, d):
    return _parsed(spark, d).select("page_id", "text")


def page_h1(spark, d):
    return _html(spark, d).select("page_id", joined(T.page_headings(F.col("html"))).alias("h1"))


def html_tokens_by_tag(spark, d):
    return T.html_tokens(_html(spark, d)).groupBy("kind", "tag").agg(F.count("*").alias("n"))


def dom_tag_counts(spark, d):
    elements = exploded_nodes(_parsed(spark, d)).filter(~F.col("tag").startswith("#"))
    return elements.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def dom_nodes_lateral(spark, d):
    """The table function over a table: depth-free shape facts of every page."""
    pages = spread(_raw(spark, d).select("page_id", "html"))
    spark.udtf.register("site_dom_nodes", dom_nodes())
    pages.createOrReplaceTempView("site_pages_in")
    rows = spark.sql("SELECT * FROM site_dom_nodes(TABLE(site_pages_in))")
    return rows.groupBy("page_id").agg(
        F.count_if(~F.col("tag").startswith("#")).alias("elements"),
        F.count_if(F.col("tag") == "a").alias("links"),
        F.max(F.when(F.col("tag") == "title", F.col("end") - F.col("id"))).alias("title_size"),
    )


def nav_links(spark, d):
    """Links inside a navigation and inside its items, by containment on the node rows."""
    nodes = exploded_nodes(_parsed(spark, d)).select("page_id", "id", "end", "tag")
    link = F.col("tag") == "a"
    inside_nav = contained_in(nodes, ["page_id"], F.col("tag") == "nav", link).groupBy("page_id").agg(
        F.count("*").alias("in_nav")
    )
    in_item = contained_in(nodes, ["page_id"], F.col("tag").isin("li", "p", "article"), link, nearest=True)
    in_item = in_item.groupBy("page_id").agg(F.count("*").alias("in_block"), F.countDistinct("outer_id").alias("blocks"))
    return inside_nav.join(in_item, "page_id", "full").select(
        "page_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("in_nav", "in_block", "blocks")]
    )


def byte_bodies(spark, d):
    """Pages as servers send them: encoded in several charsets, declared in several ways, and some with bad bytes."""
    pages = spread(_raw(spark, d).select("page_id", "html"))
    western = F.col("html").rlike("^[\\x00-\\x7f\\xa0-\\xff]*$")
    bare = F.regexp_replace("html", r'<meta charset="utf-8">', "")
    kind = F.pmod("page_id", F.lit(5))
    pages = pages.withColumns({"kind": F.when((kind == 1) & ~western, 0).otherwise(kind), "bare": bare})
    k = F.col("kind")
    body = (
        F.when(k == 1, F.encode("bare", "ISO-8859-1"))
        .when(k == 2, F.concat(F.lit(bytearray(b"\xff\xfe")), F.encode("bare", "UTF-16LE")))
        .when(k == 3, F.concat(F.encode("bare", "UTF-8"), F.lit(bytearray(b"\x80\xff"))))
        .when(k == 4, F.encode("bare", "UTF-8"))
        .otherwise(F.encode("html", "UTF-8"))
    )
    sent = pages.select(
        "page_id", body.alias("html"), F.concat(F.lit("https://bytes.example/"), "page_id").alias("url"),
        F.when(k == 1, "text/html; charset=latin1").otherwise("text/html").alias("content_type"),
    )
    read = sent.select("page_id", body_parts(F.col("html"), F.col("content_type")).alias("b"))
    texts = S.as_pages(sent).select("page_id", F.md5("html").alias("text_md5"))
    return texts.join(read.select("page_id", "b.charset"), "page_id")


# --- Contacts and mentions ------------------------------------------------------------


def _no_links() -> Column:
    return F.array().cast(ArrayType(N.NODE_TYPE))


def emails_pages(spark, d):
    page = _parsed(spark, d)
    return page.select("page_id", joined(X.extract_emails(F.col("anchors"), F.col("text"))).alias("emails"))


def emails_documents(spark, d):
    return _documents(spark, d).select(
        "doc_id", joined(X.extract_emails(_no_links(), F.col("text"), WHOLE)).alias("emails")
    )


def phones_pages(spark, d):
    page = _parsed(spark, d)
    return page.select("page_id", joined(X.extract_phones(F.col("anchors"), F.col("text"))).alias("phones"))


def phones_documents(spark, d):
    return _documents(spark, d).select(
        "doc_id", joined(X.extract_phones(_no_links(), F.col("text"), WHOLE)).alias("phones")
    )


def email_domains_topk(spark, d):
    found = unnest(_documents(spark, d), P.email_matches(F.col("text"), skip=()), "pos", "email")
    domains = found.select(F.lower(F.substring_index("email", "@", -1)).alias("domain"))
    counts = domains.groupBy("domain").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "domain").limit(10)


def role_mentions(spark, d):
    return _documents(spark, d).select("doc_id", joined(P.role_mentions(F.col("text"))).alias("roles"))


def target_mentions(spark, d):
    return _documents(spark, d).select("doc_id", joined(P.target_mentions(F.col("text"))).alias("targets"))


def address_candidates(spark, d):
    zipped, named = P.address_candidates(F.col("text"))
    found = _documents(spark, d).select("doc_id", zipped.alias("zipped"), named.alias("named"))
    return found.select(
        "doc_id",
        F.size("zipped").alias("n_zip"),
        F.size("named").alias("n_city"),
        P.longest(F.col("named")).alias("longest_city"),
        P.choose_address(F.col("zipped"), F.col("named")).alias("address"),
    )


def promotional_docs(spark, d):
    return _documents(spark, d).select("doc_id", P.is_promotional(F.col("text")).alias("promotional"))


def promotional_turns(spark, d):
    turns = _raw(spark, d, "conversations")
    return turns.select("conv_id", "turn", P.is_promotional(F.col("text")).alias("promotional"))


# --- Page facts -----------------------------------------------------------------------


def login_signals(spark, d):
    signals = login.login_signals(_parsed(spark, d))
    return signals.select("page_id", *login.LOGIN_SIGNALS, login.login_required().alias("login"))


def proof_signals(spark, d):
    proof = X.proof_signals(F.col("nodes"), F.col("marked"), F.col("text"))
    return _parsed(spark, d).withColumn("proof", proof).select("page_id", "proof.*")


def company_name(spark, d):
    return _parsed(spark, d).select(
        "page_id", X.company_name(F.col("nodes"), F.col("url")).alias("company_name")
    )


def tagline(spark, d):
    return _parsed(spark, d).select("page_id", X.tagline(F.col("nodes"), F.col("marked")).alias("tagline"))


def what_they_do(spark, d):
    return _parsed(spark, d).select(
        "page_id", X.what_they_do(F.col("nodes"), F.col("marked")).alias("summary")
    )


def offerings(spark, d):
    found = X.primary_offerings(F.col("nodes"), F.col("marked"))
    return _parsed(spark, d).select("page_id", joined(found).alias("offerings"))


def targets(spark, d):
    found = X.target_customers(F.col("nodes"), F.col("marked"), F.col("text"))
    return _parsed(spark, d).select("page_id", joined(found).alias("targets"))


def physical_address(spark, d):
    found = X.physical_address(F.col("nodes"), F.col("marked"), F.col("text"))
    return _parsed(spark, d).select("page_id", found.alias("address"))


def footer_contacts(spark, d):
    found = _parsed(spark, d).withColumn("f", X.footer_contacts(F.col("nodes")))
    return found.select("page_id", joined("f.emails").alias("emails"), joined("f.phones").alias("phones"))


def social_links(spark, d):
    found = X.social_links(F.col("anchors"), F.col("site_url"))
    return _parsed(spark, d).select("page_id", F.size(found).alias("n_social"))


def social_profiles(spark, d):
    """Profiles that the supplier sites link to, by a join of host suffixes with the rule table."""
    parsed = X.structured_pages(parse_pages(with_site_url(S.valid_pages(_supplier_corpus(spark, d))).select("page_id", "site", "site_url", "url", "headers", "html")))
    pages = parsed.select("page_id", "site", F.col("site_url").alias("url"), "anchors")
    return links.social_table(links.link_table(pages), links.social_rules(spark)).drop("site")


def contact_page(spark, d):
    found = X.contact_page(F.col("nodes"), F.col("url"), X.key_pages(F.col("url")))
    return _parsed(spark, d).select("page_id", found.alias("contact_page"))


# --- Links ----------------------------------------------------------------------------


def page_links(spark, d):
    table = links.link_table(_parsed(spark, d))
    return table.select("src_url", "pos", "href", U.join_url(F.col("link")).alias("link"))


def internal_links(spark, d):
    table = links.internal_links(links.link_table(_parsed(spark, d)))
    return links.distinct_links(table).select("src_url", "dst_url", "pos")


def prioritized_top5(spark, d):
    table = links.distinct_links(links.internal_links(links.link_table(_parsed(spark, d))))
    return links.top_links(table).select("src_url", "dst_url", "is_priority", "rank")


def followed_links(spark, d):
    """The same order from the array form, whole lists."""
    found = links.page_links(F.col("anchors"), F.col("url"), F.col("site"))
    return _parsed(spark, d).select("url", joined(found).alias("links"))


# --- Sites ----------------------------------------------------------------------------


def _named_pages(spark: SparkSession, d: str) -> DataFrame:
    name = X.company_name(F.col("nodes"), F.col("url"))
    return _parsed(spark, d).select("site", "page_id", name.alias("name"))


def site_first_nonempty(spark, d):
    named = _named_pages(spark, d)
    return named.groupBy("site").agg(fold.first_nonempty(F.col("name"), F.col("page_id")).alias("name"))


def site_ordered_union(spark, d):
    found = links.page_links(F.col("anchors"), F.col("url"), F.col("site"))
    lists = _parsed(spark, d).select("site", "page_id", found.alias("links"))
    return fold.ordered_union_rows(lists, ["site"], "links", "page_id")


def site_bool_or(spark, d):
    proof = X.proof_signals(F.col("nodes"), F.col("marked"), F.col("text"))
    flags = _parsed(spark, d).select("site", proof.alias("proof")).select("site", "proof.*")
    return flags.groupBy("site").agg(
        *[F.bool_or(c).alias(c) for c in flags.columns if c != "site"]
    )


def site_map_last(spark, d):
    """Query parameters of a site's pages: the last page that has a parameter sets it."""
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    pages = _raw(spark, d).select(
        U.url_host(F.col("url")).alias("site"),
        "page_id",
        F.when(query != "", F.str_to_map(query, F.lit("&"), F.lit("="))).alias("params"),
    )
    return fold.merge_maps_last(pages, ["site"], "params", "page_id")


def site_pages(spark, d):
    pages = _pages(spark, d).withColumn("depth", F.size(F.filter(F.split(U.url_path(F.col("url")), "/"), lambda s: s != "")))
    return pages.groupBy("site").agg(
        F.count("*").alias("n_pages"), F.max("depth").alias("depth"), F.min_by("url", "page_id").alias("first_url")
    )


def site_budget(spark, d):
    pages = _pages(spark, d).select("site", "page_id", "url")
    return fold.first_n_per_key(pages, ["site"], "page_id", C.ExtractConfig().max_pages).select(
        "site", "rank", "url"
    )


def fetch_outcomes(spark, d):
    """Pages with a fetch result derived from their number: good, HTTP error, PDF or timeout."""
    pages = _pages(spark, d).withColumns(
        {
            "status": F.when(F.col("page_id") % 5 == 1, 503).otherwise(200),
            "content_type": F.when(F.col("page_id") % 5 == 2, "application/pdf").otherwise("Text/HTML"),
            "fetch_error_kind": F.when(F.col("page_id") % 5 == 3, "timeout"),
        }
    )
    good = S.valid_pages(pages).select("page_id", F.lit("ok").alias("outcome"), F.lit(None).cast("string").alias("note"))
    return good.unionByName(S.failed_pages(pages).select("page_id", "outcome", "note"))


def robots_notes(spark, d):
    """Every site disallows the first path segment of its first page, but allows ``/en/1``."""
    pages = _pages(spark, d).select("site", "page_id", "url")
    segment = F.regexp_extract(U.url_path(F.col("url")), r"^(/[^/]*)", 1)
    first_paths = pages.groupBy("site").agg(F.min_by(segment, "page_id").alias("path_prefix"))
    base = first_paths.select(F.col("site").alias("host"), F.lit("*").alias("agent"), "path_prefix")
    rules = base.withColumns({"seq": F.lit(2), "allow": F.lit(False)}).unionByName(
        base.withColumns({"seq": F.lit(1), "allow": F.lit(True), "path_prefix": F.lit("/en/1")})
    )
    return login.robots_annotate(pages, rules).select("page_id", "robots_note")


def _walk(spark: SparkSession, d: str, order: str) -> DataFrame:
    facts = _parsed(spark, d).select(
        "site", "url", "page_id", F.lit("ok").alias("outcome"),
        links.page_links(F.col("anchors"), F.col("url"), F.col("site")).alias("links"),
    )
    index = bucketed_index(unique_pages(facts), dealt=True)
    return crawl_attempts(S.first_page_seeds(_pages(spark, d)), index, order=order).drop("seed")


def crawl_dfs(spark, d):
    return _walk(spark, d, "dfs")


def crawl_bfs(spark, d):
    return _walk(spark, d, "bfs")


def flat_records(records: DataFrame) -> DataFrame:
    """Record with one plain column per fact."""
    b, e = "business_summary", "evidence_proof_signals"
    c, t, m = "contact_location", "team_hiring_signals", "metadata"
    social = F.transform(
        F.array_sort(F.map_entries(f"{e}.social_links")),
        lambda x: F.concat(x["key"], F.lit("="), x["value"]),
    )
    return records.select(
        "site", "identity.*", f"{b}.what_they_do",
        joined(f"{b}.primary_offerings").alias("offerings"),
        joined(f"{b}.target_customers_or_industries").alias("targets"),
        joined(f"{e}.key_pages_detected").alias("key_pages"),
        f"{e}.proof_signals_found.*",
        joined(social).alias("social"),
        joined(f"{c}.emails").alias("emails"),
        joined(f"{c}.phone_numbers").alias("phones"),
        f"{c}.physical_address", f"{c}.contact_page_url", f"{t}.careers_page_url",
        joined(f"{t}.roles_or_departments_mentioned").alias("roles"),
        joined(f"{m}.pages_visited").alias("pages_visited"),
        f"{m}.crawl_depth_used",
        joined(f"{m}.errors_or_limitations").alias("limitations"),
        f"{m}.login_required",
    )


def site_records(spark, d):
    return flat_records(company_records(_pages(spark, d)))


def _supplier_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The derived pages as a written table, like any crawled corpus."""
    return staged(supplier_pages(spark, d), "supplier_pages")


def _supplier_walk(spark: SparkSession, d: str, order: str) -> DataFrame:
    index = bucketed_index(unique_pages(corpus_links(_supplier_corpus(spark, d))), dealt=True)
    return crawl_attempts(supplier_seeds(spark, d), index, order=order).drop("seed")


def supplier_walk_dfs(spark, d):
    return _supplier_walk(spark, d, "dfs")


def supplier_walk_bfs(spark, d):
    return _supplier_walk(spark, d, "bfs")


def supplier_records(spark, d):
    return flat_records(
        company_records(_supplier_corpus(spark, d), supplier_seeds(spark, d), supplier_robots(spark, d))
    )


def login_override(spark, d):
    """Sites whose walk met a login wall, and what is left of their records."""
    records = company_records(_supplier_corpus(spark, d), supplier_seeds(spark, d))
    flat = flat_records(records)
    return flat.select(
        "site", "login_required", "company_name", F.col("offerings") == "", "limitations"
    ).toDF("site", "login_required", "company_name", "no_offerings", "limitations")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        url_canonical, seed_normalize, url_host_path, url_resolution, domain_name, tracking_urls,
        key_pages, key_page_counts, page_title, page_text, page_text_parsed, page_h1,
        html_tokens_by_tag, dom_tag_counts, dom_nodes_lateral, nav_links, byte_bodies, emails_pages, emails_documents,
        phones_pages, phones_documents, email_domains_topk, role_mentions, target_mentions,
        address_candidates, promotional_docs, promotional_turns, login_signals, proof_signals,
        company_name, tagline, what_they_do, offerings, targets, physical_address, footer_contacts,
        social_links, social_profiles, contact_page, page_links, internal_links, prioritized_top5, followed_links,
        site_first_nonempty, site_ordered_union, site_bool_or, site_map_last, site_pages, site_budget,
        fetch_outcomes, robots_notes, crawl_dfs, crawl_bfs, site_records, supplier_walk_dfs,
        supplier_walk_bfs, supplier_records, login_override,
    )
}
