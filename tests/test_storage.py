"""Staged tables, even scans, and inputs that belong to no site."""

import pytest
from pyspark.sql import functions as F

from sitefacts.plans.company import unique_pages
from sitefacts.sources import pages as S
from sitefacts.sources import storage


class _Context:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None


class _Session:
    sparkContext = _Context()

    class conf:
        @staticmethod
        def get(key, default):
            return default


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.checkpoint_dir(_Session())
    assert storage.is_local("local[8]") and storage.is_local("local") and not storage.is_local("local-cluster[2,1,1024]")


def test_staged_tables_can_be_dropped(spark):
    storage.drop_staged(spark)
    table = storage.staged(spark.range(5), "five")
    assert table.count() == 5 and storage.drop_staged(spark) == 1 and storage.drop_staged(spark) == 0


def test_copies_of_one_url_are_dealt_evenly(spark):
    rows = spark.range(10_000).select(F.lit("http://a.io/").alias("url"), "id").coalesce(1)
    sizes = storage.spread(rows).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 2_000


def test_pages_without_a_host_or_an_id(spark):
    rows = [(None, "http://a.io/x", "<p>1</p>"), (None, "http://a.io/x", "<p>2</p>"), (3, "no host", "<p>3</p>")]
    pages = S.as_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert [(r.page_id, r.outcome) for r in S.failed_pages(pages).collect()] == [(3, "invalid")]
    assert [r.site for r in S.first_page_seeds(pages).collect()] == ["a.io"]
    facts = S.valid_pages(pages).select(
        "site", "url", "page_id", F.lit("ok").alias("outcome"), F.array(F.lit("u")).alias("links")
    )
    assert [(r.url, r.outcome) for r in unique_pages(facts).collect()] == [("http://a.io/x", "ok")]


def test_forget_deletes_single_tables(spark, tmp_path):
    kept, gone = (storage.staged(spark.range(5), name, str(tmp_path)) for name in ("kept", "gone"))
    table = storage.bucketed(spark.range(9).selectExpr("id", "id % 3 AS k"), "sorted", ["k"], str(tmp_path), buckets=3)
    assert sorted(r.id for r in table.collect()) == list(range(9)) and kept.count() == 5
    storage.forget(gone, table, spark.range(3))
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["kept"]
    assert not any(t.name.startswith("sorted_") for t in spark.catalog.listTables())
