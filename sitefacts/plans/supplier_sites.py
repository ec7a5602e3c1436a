"""A page corpus derived from the star-schema tables: one company site per supplier.

Every fact on these pages comes from a table, so plain SQL over the tables can state the record that
the whole pipeline (parse, extract, walk, fold) has to return. Pages per site: start, about,
products, contact, careers, three news pages and one page per brand the supplier ships. Some sites
miss a page, answer with an error or a PDF, or lead to a login wall, by supplier number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefacts.functions.regex import unnest
from sitefacts.sources.pages import as_pages, as_seeds
from sitefacts.sources.storage import spread_rows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier number ``k``, nation, region, shipped lines and the nation's market segments."""
    nations = _table(spark, sf_dir, "nation").join(
        _table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    lines = (
        _table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("s_suppkey"))
        .agg(F.count("*").alias("lines"))
    )
    segments = (
        _table(spark, sf_dir, "customer")
        .groupBy("c_nationkey")
        .agg(F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))
    )
    return (
        _table(spark, sf_dir, "supplier")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(lines, "s_suppkey", "left")
        .join(segments, F.col("s_nationkey") == F.col("c_nationkey"), "left")
        .select(
            F.col("s_suppkey").alias("k"),
            F.col("n_name").alias("nation"),
            F.col("r_name").alias("region"),
            F.coalesce("lines", F.lit(0)).alias("lines"),
            F.coalesce("segments", F.array().cast("array<string>")).alias("segments"),
        )
    )


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand number ``b`` and distinct parts ``n`` that each supplier ships."""
    parts = _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("b"),
    )
    return (
        _table(spark, sf_dir, "lineitem")
        .select("l_suppkey", "l_partkey")
        .distinct()
        .join(parts, "l_partkey")
        .groupBy(F.col("l_suppkey").alias("k"), "b")
        .agg(F.count("*").alias("n"))
    )


def _html(title: Column, body: Column) -> Column:
    """Frame shared by all pages: head, navigation and footer; ``title`` and ``body`` go between."""
    k = F.col("k")
    portal = F.when(k % 10 == 3, '<li><a href="/portal">Portal</a></li>').otherwise("")
    return F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), title,
        F.lit('</title><script>var t="<p>not text</p>";</script></head><body><nav><ul>'),
        F.lit('<li><a href="/news/1">News</a></li><li><a href="/about">About</a></li>'),
        F.lit('<li><a href="/products">Products</a></li>'), portal,
        F.lit('<li><a href="/contact?from=nav">Contact</a></li>'),
        F.lit('<li><a href="/careers#jobs">Careers</a></li></ul></nav>'), body,
        F.lit('<div class="footer"><div class="address">'), k,
        F.lit(" Main&nbsp;Street<br>"), F.col("nation"),
        F.lit("</div><p>info"), k, F.lit("@supplier-"), k, F.lit(".com</p></div></body></html>"),
    )


def supplier_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page table of all supplier sites."""
    k = F.col("k")
    suppliers = _suppliers(spark, sf_dir)
    brands = _brands(spark, sf_dir)
    catalogues = brands.groupBy("k").agg(
        F.array_sort(F.collect_list(F.struct("b", "n"))).alias("brands")
    )
    sites = suppliers.join(catalogues, "k", "left").withColumn(
        "brands", F.coalesce("brands", F.array().cast("array<struct<b:int,n:bigint>>"))
    )
    name = F.concat(F.lit("Supplier "), k)

    home = F.concat(
        F.lit('<section class="hero"><h1>'), name, F.lit('</h1><p class="lead">Parts <b>from</b> '),
        F.col("nation"), F.lit("</p></section>"),
        F.when(k % 5 == 0, "<p>Award winner</p>").otherwise(""),
        F.lit('<a href="https://www.linkedin.com/company/supplier-'), k, F.lit('">Follow</a>'),
        F.when(
            k % 3 == 0, F.concat(F.lit('<a href="https://x.com/supplier'), k, F.lit('">X</a>'))
        ).otherwise(""),
        F.lit('<a href="https://facebook.com/s?utm_source=site">F</a>'),
        F.lit('<a href="https://www.netflix.com/s">N</a>'),
    )
    about = F.concat(
        F.lit('<h2>Our story</h2><section class="about"><p>Use code SAVE today and pay less.</p><p>'),
        name, F.lit(" has shipped "), F.col("lines"), F.lit(" lines of parts to its buyers.</p><p>It sits in "),
        F.col("nation"), F.lit(" and works across the region "), F.col("region"), F.lit(".</p></section>"),
    )
    items = F.transform(
        "brands",
        lambda x: F.concat(
            F.lit('<li><a href="/brands/'), x["b"], F.lit('">Brand '), x["b"], F.lit(": "), x["n"],
            F.lit(" parts</a></li>"),
        ),
    )
    spans = F.transform("segments", lambda s: F.concat(F.lit("<span>"), s, F.lit("</span>")))
    products = F.concat(
        F.lit('<section class="products"><ul>'), F.array_join(items, ""),
        F.lit('</ul></section><div class="customers">our clients'), F.array_join(spans, " "), F.lit("</div>"),
    )
    contact = F.concat(
        F.lit('<h2>Write to us</h2><a href="mailto:sales'), k, F.lit("@supplier-"), k,
        F.lit('.com?subject=hello">mail</a><a href="tel:+1-555-'), F.format_string("%07d", k),
        F.lit('">call</a>'),
    )
    jobs = F.array(*[F.lit(j) for j in ("engineer", "analyst", "designer", "scientist", "director")])
    careers = F.concat(
        F.lit('<div class="departments"><h3>Clinical research</h3><h3>Supply in '), F.col("nation"),
        F.lit("</h3><h3>Canteen</h3></div><p>Open now: senior "),
        F.get(jobs, (k % 5).cast("int")), F.lit(" wanted.</p>"),
    )
    portal = F.lit('<div class="content"><form><input type="password" name="password"></form></div>')

    def page(path, number, title, body, keep=True, status=200, content_type="text/html; charset=utf-8"):
        """A page of the site as a struct; all pages of a site come from one row, exploded once."""
        parts = {
            "path": path, "number": number, "title": title, "body": body, "keep": keep,
            "status": status, "content_type": content_type,
        }
        columns = {n: c if isinstance(c, Column) else F.lit(c) for n, c in parts.items()}
        columns["number"] = columns["number"].cast("bigint")
        return F.struct(*[c.alias(n) for n, c in columns.items()])

    def brand_page(x: Column) -> Column:
        later = F.slice(F.filter("brands", lambda y: y["b"] > x["b"]), 1, 5)
        links = F.transform(
            later, lambda y: F.concat(F.lit('<a href="./'), y["b"], F.lit('">more</a>'))
        )
        return page(F.concat(F.lit("/brands/"), x["b"]), x["b"] + 10, plain, F.array_join(links, ""))

    plain = F.concat(name, F.lit(" | News"))
    next_news = lambda i: F.concat(F.lit('<p>News</p><a href="'), i + 1, F.lit('">next</a>'))
    fixed = F.array(
        page("/", 0, F.concat(name, F.lit(" | Home")), home),
        page(
            "/about", 1, F.concat(F.lit("About | "), name), about,
            content_type=F.when(k % 9 == 2, "application/pdf").otherwise("text/html"),
        ),
        page("/products", 2, plain, products),
        page("/contact", 3, plain, contact, status=F.when(k % 7 == 0, 404).otherwise(200)),
        page("/careers", 4, plain, careers, keep=k % 4 != 1),
        page("/portal", 5, plain, portal, keep=k % 10 == 3),
    )
    news = F.transform(
        F.array(F.lit(1), F.lit(2), F.lit(3)),
        lambda i: page(F.concat(F.lit("/news/"), i), i + 5, plain, next_news(i)),
    )
    every = F.concat(fixed, news, F.transform("brands", brand_page))
    pages = (
        unnest(spread_rows(sites), F.filter(every, lambda p: p["keep"]), "pos", "p")
        .select("k", "nation", "p.*")
        .select(
            (k * 1000 + F.col("number")).alias("page_id"),
            F.concat(F.lit("https://www.supplier-"), k, F.lit(".com"), F.col("path")).alias("url"),
            _html(F.col("title"), F.col("body")).alias("html"),
            "status",
            "content_type",
        )
    )
    return as_pages(pages)


def supplier_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = _table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("www.supplier-"), "s_suppkey", F.lit(".com")).alias("url")
    )
    return as_seeds(hosts)


def supplier_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots rules: every sixth site disallows the brand paths that start with ``/brands/1``."""
    k = F.col("s_suppkey")
    return (
        _table(spark, sf_dir, "supplier")
        .filter(k % 6 == 0)
        .select(
            F.concat(F.lit("www.supplier-"), k, F.lit(".com")).alias("host"),
            F.lit("*").alias("agent"),
            F.lit(0).alias("seq"),
            F.lit(False).alias("allow"),
            F.lit("/brands/1").alias("path_prefix"),
        )
    )
