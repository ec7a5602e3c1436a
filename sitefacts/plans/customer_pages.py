"""Pages derived from the customer table that put a fact in a different place by customer number.

Each query reads one fact back from every place where a page can state it, so plain SQL over the
table says which customer has the fact, and from where.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefacts.operators import extract as X
from sitefacts.operators import login
from sitefacts.operators.parse import parse_pages
from sitefacts.plans.company import company_records, with_site_url
from sitefacts.sources.pages import as_pages, valid_pages
from sitefacts.sources.sinks import write_records
from sitefacts.sources.storage import checkpoint_dir, spread

def _k() -> Column:
    """Customer number."""
    return F.col("k")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _case(by: int, *values: Column | str) -> Column:
    """Value number ``k % by``, empty beyond the last one."""
    out = F.lit("")
    for n, value in reversed(list(enumerate(values))):
        out = F.when(_k() % by == n, _text(value)).otherwise(out)
    return out


def _corpus(spark: SparkSession, d: str, head: Column | str, body: Column | str, path: Column | str = "/", headers: Column | None = None) -> DataFrame:
    """One site per customer ``k`` with one page; ``segment`` is its market segment in lower case with a capital."""
    customers = spread(spark.read.parquet(f"{d}/customer.parquet").select(
        F.col("c_custkey").alias("k"), F.initcap("c_mktsegment").alias("segment")
    ))
    html = _text("<!DOCTYPE html><html><head>", head, "</head><body>", body, "</body></html>")
    return as_pages(customers.select(
        _k().alias("page_id"), _text("https://www.acme-", _k().cast("string"), ".example", path).alias("url"), html.alias("html"),
        (F.lit(None).cast("map<string,string>") if headers is None else headers).alias("headers"),
    ))


def _parsed(pages: DataFrame) -> DataFrame:
    used = with_site_url(valid_pages(pages)).select("page_id", "site", "site_url", "url", "headers", "html")
    return X.structured_pages(parse_pages(used))


def customer_logins(spark: SparkSession, d: str) -> DataFrame:
    """Each of the six login signals on its own."""
    head = _case(
        9, "", _text("<title>Sign in, ", F.col("segment"), "</title>"), "",
        '<meta http-equiv="Refresh" content="0; url=/signin">',
    )
    body = _case(
        9, "", "", "<p>You must be logged in here.</p>", "", "",
        '<div class="main"><form id="f"><input type="password" name="password"></form></div>',
        '<form><input type="text" name="q"></form>',
    )
    path = _case(9, _text("/Login/", _k().cast("string")), "/", "/", "/", "/", "/", "/", "/logistics", "/blogs/in")
    headers = F.when(_k() % 9 == 4, F.create_map(F.lit("WWW-Authenticate"), F.lit("Basic")))
    signals = login.login_signals(_parsed(_corpus(spark, d, head, body, path, headers)))
    return signals.select("page_id", *login.LOGIN_SIGNALS, login.login_required().alias("login"))


def customer_names(spark: SparkSession, d: str) -> DataFrame:
    """Company name from JSON-LD, meta data, title, heading, logo or domain."""
    k, segment = _k().cast("string"), F.col("segment")
    head = _case(
        7, _text('<script type="application/ld+json">{"name": "', segment, " Ltd ", k, '"}</script><title>Other</title>'),
        _text('<script type="application/ld+json">[1]</script><script type="application/ld+json">{"legalName": "', segment, " Inc ", k, '"}</script>'),
        _text('<meta property="og:site_name" content=" ', segment, " Group ", k, ' ">'),
        _text("<title>", segment, " House ", k, "</title>"),
    )
    body = _case(
        7, "", "", "", "", _text("<h1>Shop now</h1><h1>", segment, " of ", k, "</h1>"),
        _text('<img alt="Icon logo"><img alt="', segment, " Works ", k, ' logo 2x">'),
    )
    return _parsed(_corpus(spark, d, head, body)).select(
        "page_id", X.company_name(F.col("nodes"), F.col("url")).alias("company_name")
    )


def customer_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Tagline and summary from every place a page may have them."""
    k, segment = _k().cast("string"), F.col("segment")
    long = _text("We make ", segment, " goods for customer ", k, " and for all of the others as well.")
    head = _case(6, "", _text('<meta name="description" content=" ', long, ' ">'))
    body = _case(
        6, _text('<section class="hero"><h1>Hi</h1><p>', segment, " first ", k, "</p><p>Second line</p></section>"), "",
        _text("<h1>Hi</h1><p>x</p><h2>", segment, " second ", k, "</h2>"),
        _text('<p class="big slogan">', segment, " third ", k, "</p>"),
        _text('<div class="our-mission"><p>Order now!</p><p>', long, "</p></div>"),
    )
    page = _parsed(_corpus(spark, d, head, body))
    return page.select(
        "page_id", X.tagline(F.col("nodes"), F.col("marked")).alias("tagline"),
        X.what_they_do(F.col("nodes"), F.col("marked")).alias("summary"),
    )


def customer_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Address from JSON-LD, with a number among its parts, an address element or a named block."""
    k, segment = _k().cast("string"), F.col("segment")
    head = _case(4, _text(
        '<script type="application/ld+json">{"address": {"streetAddress": "', k, ' Main Road", "addressLocality": "', segment,
        ' Town", "postalCode": ', (_k() + 10000).cast("string"), ', "addressCountry": ""}}</script>',
    ))
    body = _case(
        4, "", _text("<address>", k, " Side Lane<br>", segment, " Bay</address>"),
        _text('<p class="locations">Somewhere nice</p><div class="office">', k, " Harbour <b>Row</b> ", segment, "</div>"),
        "<p>nothing here</p>",
    )
    page = _parsed(_corpus(spark, d, head, body))
    return page.select("page_id", X.physical_address(F.col("nodes"), F.col("marked"), F.col("text")).alias("address"))


def customer_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Proof signals and target customers that the text mentions."""
    segment = F.col("segment")
    body = _case(
        6, "<p>Read our success stories.</p>", "<p>What our visitors say</p>", '<p>Trusted by many</p><img alt="Client wall">',
        _text("<p>We are serving ", segment, " industry.</p>"), _text("<p>Markets: ", segment, ", Trade. More.</p>"),
        "<p>Accredited for years</p>",
    )
    page = _parsed(_corpus(spark, d, "", body))
    proof = X.proof_signals(F.col("nodes"), F.col("marked"), F.col("text"))
    targets = X.target_customers(F.col("nodes"), F.col("marked"), F.col("text"))
    return page.withColumn("proof", proof).select("page_id", "proof.*", F.array_join(targets, " ; ").alias("targets"))


def customer_records_json(spark: SparkSession, d: str) -> DataFrame:
    """Records of one-page sites written as JSON lines and read back as text."""
    k = _k().cast("string")
    body = _text("<p>", F.col("segment"), "</p><a href='mailto:k", k, "@acme.example'>m</a>")
    pages = _corpus(spark, d, _text("<title>", F.col("segment"), " House ", k, _case(2, "é"), "</title>"), body)
    path = f"{checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"
    write_records(company_records(pages, crawl_ts=datetime(2025, 1, 2, 3, 4, 5, 678)), path, "json")
    line = spark.read.text(path)
    read = lambda p: F.get_json_object("value", p)
    return line.select(
        read("$.site").alias("site"), read("$.identity.company_name").alias("company_name"),
        read("$.contact_location.emails[0]").alias("email"), read("$.metadata.pages_visited[0]").alias("page"),
        read("$.metadata.timestamp_of_scrape").alias("stamp"),
        F.col("value").contains('"tagline":null').alias("keeps_nulls"), F.col("value").contains("é").alias("has_accent"),
    )


QUERIES = {
    f.__name__: f
    for f in (customer_logins, customer_names, customer_summaries, customer_addresses, customer_mentions, customer_records_json)
}

_FROM = "FROM (SELECT c_custkey AS k, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS segment FROM customer)"
ORACLES = {
    "customer_logins": f"""
        SELECT k AS page_id, k % 9 = 0 AS by_url, k % 9 = 1 AS by_title, k % 9 = 5 AS by_form, k % 9 = 2 AS by_text,
               k % 9 = 3 AS by_refresh, k % 9 = 4 AS by_header, k % 9 <= 5 AS login {_FROM}""",
    "customer_names": f"""
        SELECT k AS page_id, CASE k % 7 WHEN 0 THEN segment || ' Ltd ' || k WHEN 1 THEN segment || ' Inc ' || k
          WHEN 2 THEN segment || ' Group ' || k WHEN 3 THEN segment || ' House ' || k WHEN 4 THEN segment || ' of ' || k
          WHEN 5 THEN segment || ' Works ' || k ELSE 'Acme-' || k END AS company_name {_FROM}""",
    "customer_summaries": f"""
        SELECT k AS page_id, CASE k % 6 WHEN 0 THEN segment || ' first ' || k WHEN 1 THEN long WHEN 2 THEN segment || ' second ' || k
                 WHEN 3 THEN segment || ' third ' || k END AS tagline, CASE WHEN k % 6 IN (1, 4) THEN long END AS summary
        FROM (SELECT *, 'We make ' || segment || ' goods for customer ' || k || ' and for all of the others as well.' AS long {_FROM})""",
    "customer_addresses": f"""
        SELECT k AS page_id, CASE k % 4 WHEN 0 THEN k || ' Main Road, ' || segment || ' Town, ' || (k + 10000)
          WHEN 1 THEN k || ' Side Lane, ' || segment || ' Bay' WHEN 2 THEN k || ' Harbour, Row, ' || segment END AS address {_FROM}""",
    "customer_mentions": f"""
        SELECT k AS page_id, k % 6 = 2 AS clients, k % 6 = 0 AS case_studies, k % 6 = 1 AS testimonials, k % 6 = 5 AS certifications_awards,
               CASE k % 6 WHEN 3 THEN segment WHEN 4 THEN segment || ', Trade' ELSE '' END AS targets {_FROM}""",
    "customer_records_json": f"""
        SELECT 'www.acme-' || k || '.example' AS site, segment || ' House ' || k || CASE WHEN k % 2 = 0 THEN 'é' ELSE '' END AS company_name, 'k' || k || '@acme.example' AS email,
               'https://www.acme-' || k || '.example/' AS page, '2025-01-02T03:04:05.000678Z' AS stamp, true AS keeps_nulls,
               k % 2 = 0 AS has_accent {_FROM}""",
}
