"""Page and seed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitefacts.functions.charset import decode_body
from sitefacts.functions.urls import canonical_url, normalize_url, url_host

# Columns of a page table; a corpus needs ``url`` and ``html``, the others default to null.
PAGE_COLUMNS = {
    "page_id": "bigint",
    "site": "string",
    "url": "string",
    "html": "string",
    "status": "int",
    "content_type": "string",
    "headers": "map<string,string>",
    "fetch_error_kind": "string",
    "fetch_error_msg": "string",
}
PAGE_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in PAGE_COLUMNS.items())


def as_pages(df: DataFrame) -> DataFrame:
    """Give a corpus the page-table columns: canonical ``url``, ``site`` = host of the URL.

    ``page_id`` orders pages that share a URL; without the column the HTML's hash does. Byte bodies, a
    binary ``html``, are decoded; see ``functions.charset``.
    """
    present = set(df.columns)
    derived = {"url": canonical_url(F.col("url"))}
    if "html" in present and isinstance(df.schema["html"].dataType, T.BinaryType):
        kind = F.col("content_type") if "content_type" in present else F.lit(None).cast("string")
        df = df.withColumn("html", decode_body(F.col("html"), kind))
    if "page_id" not in present:
        derived["page_id"] = F.xxhash64("url", "html")
    if "site" not in present:
        derived["site"] = url_host(F.col("url"))
    for name, kind in PAGE_COLUMNS.items():
        if name not in present and name not in derived:
            derived[name] = F.lit(None).cast(kind)
    return df.withColumns(derived).select(*PAGE_COLUMNS)


def load_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page table from Parquet."""
    return as_pages(spark.read.parquet(path))


def stream_pages(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """The same table as a stream over a landing folder of Parquet files with all page columns."""
    return as_pages(
        spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)
    )


def as_seeds(urls: DataFrame) -> DataFrame:
    """Start pages ``site, url`` from raw seed URLs; invalid ones are left out (see ``invalid_seeds``).

    A site has as many start pages as different URLs are given; each is walked on its own.
    """
    normal = urls.select(normalize_url(F.col("url")).alias("url")).filter(F.col("url").isNotNull())
    return normal.select(url_host(F.col("url")).alias("site"), "url").distinct()


def invalid_seeds(urls: DataFrame) -> DataFrame:
    """Seeds without a host."""
    return urls.select("url").filter(normalize_url(F.col("url")).isNull())


def load_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seeds from a text file with one URL per line."""
    lines = spark.read.text(path).select(F.trim("value").alias("url"))
    return as_seeds(lines.filter(F.col("url") != ""))


def first_page_seeds(pages: DataFrame) -> DataFrame:
    """For a corpus without a seed list: each site's page with the lowest ``page_id``.

    Pages whose URL has no host belong to no site.
    """
    return pages.filter(has_site()).groupBy("site").agg(
        F.min_by("url", F.struct("page_id", "url")).alias("url")
    )


def fetch_error() -> Column:
    """Text of the fetch error of a page row, null when the response was fine."""
    url, message = F.col("url"), F.col("fetch_error_msg")
    side = F.when(F.col("status") < 500, "Client").otherwise("Server")
    of_status = F.concat(F.col("status"), F.lit(" "), side, F.lit(" Error for url: "), url)
    request = F.concat(F.lit("Request error: "), url, F.lit(" - "))
    return (
        F.when(F.col("fetch_error_kind") == "timeout", F.concat(F.lit("Timeout: "), url))
        .when(F.col("fetch_error_kind") == "request", F.concat(request, F.coalesce(message, F.lit(""))))
        .when(
            F.col("fetch_error_kind").isNotNull(),
            F.concat(F.lit("Unexpected error: "), url, F.lit(" - "), F.coalesce(message, F.lit(""))),
        )
        .when(F.col("status").between(400, 599), F.concat(request, F.coalesce(message, of_status)))
    )


def is_html() -> Column:
    """Content type is HTML; unknown (null) passes."""
    return F.coalesce(F.lower("content_type").contains("text/html"), F.lit(True))


def has_site() -> Column:
    """The page's URL has a host."""
    return F.coalesce(F.col("site") != "", F.lit(False))


def valid_pages(pages: DataFrame) -> DataFrame:
    """Successful HTML responses of a site. Runs before the parser, so nothing else is ever parsed."""
    return pages.filter(has_site() & fetch_error().isNull() & is_html())


def failed_pages(pages: DataFrame) -> DataFrame:
    """The other pages with ``outcome`` and the ``note`` to log.

    The outcome is ``invalid`` for a URL without a host, else ``error`` or ``skipped``.

    Reads no HTML, so the second pass over a corpus costs only its small columns.
    """
    error = fetch_error()
    return pages.filter(~has_site() | error.isNotNull() | ~is_html()).select(
        "page_id",
        "site",
        "url",
        F.when(~has_site(), "invalid").when(error.isNotNull(), "error").otherwise("skipped").alias("outcome"),
        error.alias("note"),
    )
