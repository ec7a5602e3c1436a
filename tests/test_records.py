"""Fold, record schema, sources, sinks and the stream, on a few hand-written sites."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sitefacts.config import LOGIN_NOTE, ExtractConfig
from sitefacts.operators import fold
from sitefacts.operators.login import robots_annotate
from sitefacts.plans import company
from sitefacts.plans.company import company_records
from sitefacts.sources import pages as S
from sitefacts.sources.sinks import record_json, write_records
from sitefacts.streaming.facts import refresh_records, refresh_touched, start_facts_stream, start_winner_stream

NOW = datetime(2025, 12, 24, 12, 16, 8, 180148)
PAGE = "page_id long, url string, html string, status int, content_type string, fetch_error_kind string, fetch_error_msg string"


def offers(prefix, more=""):
    items = "".join(f"<li>{prefix} {i:02}</li>" for i in range(15))
    return f'<ul class="offerings">{items}</ul>{more}'


SITES = [
    # One site whose facts come from several pages.
    (1, "https://www.acme.io/", '<title>| Xylo</title><a href="/about">a</a><a href="/two">b</a><a href="/bad">c</a>'
        '<a href="/pdf">d</a><a href="/slow">e</a>' + offers("Alpha"), 200, "text/html", None, None),
    (2, "https://www.acme.io/about", '<title>Acme</title><div class="hero"><p>A fine tagline here</p></div>'
        '<a href="https://facebook.com/A">f</a><a href="https://x.com/A">f</a>', 200, "text/html; charset=utf-8", None, None),
    (3, "https://www.acme.io/two", '<title>Other</title><a href="https://facebook.com/B">f</a>' + offers("Beta"), None, None, None, None),
    (4, "https://www.acme.io/bad", "<p>gone</p>", 404, "text/html", None, "404 Not Found"),
    (5, "https://www.acme.io/pdf", "<p>pdf</p>", 200, "application/pdf", None, None),
    (6, "https://www.acme.io/slow", None, None, None, "timeout", None),
    # The login wall is two clicks away.
    (7, "https://wall.io/", '<title>Wall</title><a href="/in">in</a>', 200, "text/html", None, None),
    (8, "https://wall.io/in", '<a href="/authors">x</a>', 200, "text/html", None, None),
    (9, "https://wall.io/authors", "<p>hi</p>", 200, "text/html", None, None),
    # Same URL twice: the earlier page counts.
    (10, "https://twice.io/", "<title>First</title>", 200, "text/html", None, None),
    (11, "https://twice.io/?again=1", "<title>Second</title>", 200, "text/html", None, None),
]
SEEDS = [("www.acme.io",), ("https://wall.io",), ("https://twice.io/?x=1",), ("http://missing.io",), ("https://",)]


@pytest.fixture(scope="module")
def corpus(spark):
    pages = S.as_pages(spark.createDataFrame(SITES, PAGE))
    urls = spark.createDataFrame(SEEDS, "url string")
    return pages, S.as_seeds(urls), urls


@pytest.fixture(scope="module")
def records(spark, corpus):
    pages, seeds, _ = corpus
    rules = spark.createDataFrame(
        [("www.acme.io", "*", 0, False, "/two"), ("www.acme.io", "*", 1, False, "/bad")],
        "host string, agent string, seq int, allow boolean, path_prefix string",
    )
    return company_records(pages, seeds, rules, NOW).cache()


@pytest.fixture(scope="module")
def by_site(records):
    return {r.site: r.asDict(recursive=True) for r in records.collect()}


def test_every_seed_has_a_record(by_site):
    assert set(by_site) == {"www.acme.io", "wall.io", "twice.io", "missing.io"}


def test_invalid_seeds(corpus):
    assert [r.url for r in S.invalid_seeds(corpus[2]).collect()] == ["https://"]


def test_facts_of_several_pages(by_site):
    r = by_site["www.acme.io"]
    assert r["identity"] == {"company_name": "Xylo", "website_url": "https://www.acme.io/", "tagline": "A fine tagline here"}
    offered = r["business_summary"]["primary_offerings"]
    assert offered == [f"Alpha {i:02}" for i in range(15)] + [f"Beta {i:02}" for i in range(15)]
    social = r["evidence_proof_signals"]["social_links"]
    assert social == {"facebook": "https://facebook.com/B", "twitter": "https://x.com/A"}
    meta = r["metadata"]
    assert meta["pages_visited"] == ["https://www.acme.io/" + p for p in ("", "about", "two")]
    assert meta["crawl_depth_used"] == 1
    assert meta["errors_or_limitations"] == [
        "robots.txt restriction noted for https://www.acme.io/two",
        "robots.txt restriction noted for https://www.acme.io/bad",
        "Request error: https://www.acme.io/bad - 404 Not Found",
        "Timeout: https://www.acme.io/slow",
    ]
    assert meta["timestamp_of_scrape"] == NOW


def test_login_wall_empties_the_record(by_site):
    r = by_site["wall.io"]
    assert r["identity"] == {"company_name": None, "website_url": "https://wall.io/", "tagline": None}
    assert r["metadata"]["pages_visited"] == []
    assert r["metadata"]["crawl_depth_used"] == 0
    assert r["metadata"]["errors_or_limitations"] == [LOGIN_NOTE]
    assert r["metadata"]["login_required"] is True


def test_earliest_page_of_a_url(by_site):
    assert by_site["twice.io"]["identity"]["company_name"] == "First"
    assert by_site["twice.io"]["metadata"]["pages_visited"] == ["https://twice.io/"]


def test_missing_site_is_empty_but_whole(by_site):
    r = by_site["missing.io"]
    assert r["contact_location"] == {
        "emails": [], "phone_numbers": [], "physical_address": None, "contact_page_url": None
    }
    assert r["evidence_proof_signals"]["social_links"] == {}


def test_repartition_does_not_change_records(corpus, by_site):
    pages, seeds, _ = corpus
    again = company_records(pages.repartition(5, "html"), seeds.repartition(3), crawl_ts=NOW).collect()
    for r in again:
        expected = json.loads(json.dumps(by_site[r.site], default=str))
        got = json.loads(json.dumps(r.asDict(recursive=True), default=str))
        got["metadata"]["errors_or_limitations"] = expected["metadata"]["errors_or_limitations"]
        assert got == expected


def test_seed_scope_and_compat(corpus):
    pages, seeds, _ = corpus
    cfg = ExtractConfig(compat=True, login_scope="seed")
    got = {r.site: r for r in company_records(pages, seeds, crawl_ts=NOW, cfg=cfg).collect()}
    assert got["wall.io"].identity.company_name == "Wall"
    assert not got["wall.io"].metadata.login_required
    # The empty title part gives no name, so the about page supplies it.
    assert got["www.acme.io"].identity.company_name == "Acme"


SECTIONS = {
    "identity": ["company_name", "website_url", "tagline"],
    "business_summary": ["what_they_do", "primary_offerings", "target_customers_or_industries"],
    "evidence_proof_signals": ["key_pages_detected", "proof_signals_found", "social_links"],
    "contact_location": ["emails", "phone_numbers", "physical_address", "contact_page_url"],
    "team_hiring_signals": ["careers_page_url", "roles_or_departments_mentioned"],
    "metadata": ["timestamp_of_scrape", "pages_visited", "crawl_depth_used", "errors_or_limitations", "login_required"],
}


def test_json_has_every_key(records):
    for row in record_json(records).collect():
        body = json.loads(row.json)
        assert {k: list(v) for k, v in body.items()} == SECTIONS
        assert body["metadata"]["timestamp_of_scrape"] == "2025-12-24T12:16:08.180148Z"


def test_sinks_round_trip(spark, records, tmp_path):
    write_records(records, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert sorted(back.collect(), key=str) == sorted(records.collect(), key=str)
    write_records(records, str(tmp_path / "j"), "json")
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert all(list(line) == ["site", *SECTIONS] for line in lines)
    with pytest.raises(ValueError):
        write_records(records, str(tmp_path / "x"), "xml")


def test_valid_pages_plan_reads_no_html_for_failures(spark, corpus, tmp_path):
    corpus[0].write.parquet(str(tmp_path / "pages"))
    pages = S.load_pages(spark, str(tmp_path / "pages"))
    failed = S.failed_pages(pages)
    plan = failed._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert {r.url[-4:]: r.outcome for r in failed.collect()} == {"/bad": "error", "/pdf": "skipped", "slow": "error"}
    assert S.valid_pages(pages).count() + failed.count() == pages.count()


def test_seed_file(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("acme.io\n\nhttp://b.co/x?y\nnot/a/\n")
    got = {(r.site, r.url) for r in S.load_seeds(spark, str(tmp_path / "seeds.txt")).collect()}
    assert got == {("acme.io", "https://acme.io/"), ("b.co", "http://b.co/x"), ("not", "https://not/a/")}


def test_aggregates(spark):
    df = spark.createDataFrame(
        [("a", 1, None, ["x", "y"]), ("a", 2, "", ["y", "z"]), ("a", 3, "v", []), ("a", 4, "w", ["q", "x"]), ("b", 1, None, [])],
        "k string, seq int, v string, l array<string>",
    )
    seq = F.col("seq")
    rows = df.groupBy("k").agg(
        fold.first_nonempty(F.col("v"), seq).alias("v"), fold.ordered_union(F.col("l"), seq).alias("l")
    )
    assert {r.k: (r.v, r.l) for r in rows.collect()} == {"a": ("v", ["x", "y", "z", "q"]), "b": (None, [])}
    long = fold.ordered_union_rows(df, ["k"], "l", "seq").collect()
    assert [r.item for r in sorted(long, key=lambda r: (r.first_seq, r.first_pos))] == ["x", "y", "z", "q"]


def test_first_n_per_key_is_exact(spark):
    df = spark.range(5000).selectExpr("id AS seq", "if(id % 3 < 2, 0, id % 50) AS k")
    got = {(r.k, r.rank): r.seq for r in fold.first_n_per_key(df, ["k"], "seq", 7, salts=5).collect()}
    groups = {}
    for i in range(5000):
        groups.setdefault(0 if i % 3 < 2 else i % 50, []).append(i)
    assert got == {(k, n + 1): v for k, vs in groups.items() for n, v in enumerate(vs[:7])}


def test_robots_keep_all_rows(spark):
    pages = spark.createDataFrame([("https://a.co/x",), ("https://b.co/x",)], "url string")
    rules = spark.createDataFrame([], "host string, agent string, seq int, allow boolean, path_prefix string")
    assert robots_annotate(pages, rules).count() == 2


def test_stream_of_pages(spark, corpus, records, tmp_path):
    pages, seeds, _ = corpus
    landing, out = str(tmp_path / "landing"), str(tmp_path / "facts")

    def feed(condition):
        pages.filter(condition).coalesce(1).write.mode("append").parquet(landing)
        stream = S.stream_pages(spark, landing)
        start_facts_stream(stream, out, str(tmp_path / "checkpoint")).awaitTermination()

    feed("site <> 'wall.io' OR url = 'https://wall.io/'")
    early = {r.site: r for r in refresh_records(spark, out, seeds, crawl_ts=NOW).collect()}
    assert early["wall.io"].identity.company_name == "Wall"
    feed("site = 'wall.io' AND url <> 'https://wall.io/'")
    late = refresh_records(spark, out, seeds, since_batch=1, crawl_ts=NOW).collect()
    assert late == records.filter("site = 'wall.io'").collect()


def test_hot_site_and_hot_url(spark, by_site):
    """One site with most of the rows, one URL with a third of them, next to many small sites."""
    page = lambda i, url, html: (i, url, html, 200, "text/html", None, None)
    rows = [page(i, f"https://hot.io/p{i}", f'<a href="/p{i + 1}">n</a><a href="/p{i + 7}">m</a>') for i in range(1500)]
    rows += [page(5000 + i, f"https://hot.io/p1?copy={i}", f"<title>Copy {i}</title>") for i in range(1500)]
    rows += [page(9000 + i, f"https://s{i}.io/", f"<title>Site{i}</title>") for i in range(100)]
    pages = S.as_pages(spark.createDataFrame(rows, PAGE)).repartition(8)
    got = {r.site: r for r in company_records(pages, crawl_ts=NOW).collect()}
    assert len(got) == 101
    assert all(got[f"s{i}.io"].identity.company_name == f"Site{i}" for i in range(100))
    visited = got["hot.io"].metadata.pages_visited
    assert visited[:6] == [f"https://hot.io/p{i}" for i in range(6)]
    assert len(visited) == len(set(visited)) == 15


def test_every_seed_of_a_host_has_a_record(spark, corpus):
    pages, _, _ = corpus
    given = ["https://www.acme.io/two", "www.acme.io", "https://www.acme.io/", "https://wall.io/authors", "https://wall.io"]
    seeds = S.as_seeds(spark.createDataFrame([(u,) for u in given], "url string"))
    assert sorted(seeds.collect()) == [
        ("wall.io", "https://wall.io/"), ("wall.io", "https://wall.io/authors"),
        ("www.acme.io", "https://www.acme.io/"), ("www.acme.io", "https://www.acme.io/two"),
    ]
    visited = {r.identity.website_url: r.metadata.pages_visited for r in company_records(pages, seeds).collect()}
    assert len(visited) == 4
    assert visited["https://www.acme.io/two"] == ["https://www.acme.io/two"]
    assert visited["https://www.acme.io/"] == ["https://www.acme.io/", "https://www.acme.io/about", "https://www.acme.io/two"]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_visited_pages_reach_the_extractors(spark, monkeypatch):
    """The second pass parses what the walks visit; the first one extracts links and login walls only."""
    page = lambda i, links, more="": (i, f"https://deep.io/p{i}", "".join(f'<a href="/p{j}">x</a>' for j in links) + more, 200, "text/html", None, None)
    rows = [page(i, [i + 1]) for i in range(200)] + [page(1, [9], "another copy")]
    pages = S.as_pages(spark.createDataFrame(rows, PAGE))
    parsed, real = [], company.parse_pages

    def counting(df, *rest, **more):
        parsed.append((df.columns, df.count()))
        return real(df, *rest, **more)

    monkeypatch.setattr(company, "parse_pages", counting)
    [record] = company_records(pages, crawl_ts=NOW).collect()
    visited = record.metadata.pages_visited
    # the first of both copies of p1 by their hash counts; whichever it is, the walk ends at depth 5
    assert len(visited) == 6
    assert [n for _, n in parsed] == [201, 6]


def test_second_pass_prunes_by_a_bloom_filter(spark, tmp_path):
    """Where the join shuffles, unvisited pages are dropped before their HTML is moved."""
    S.as_pages(spark.createDataFrame(SITES, PAGE)).write.parquet(str(tmp_path / "pages"))
    pages = S.load_pages(spark, str(tmp_path / "pages"))
    spark.createDataFrame([("wall.io", "https://wall.io/", 7, 1, "ok")], "site string, url string, page_id long, copy long, kind string").write.parquet(str(tmp_path / "picked"))
    picked = spark.read.parquet(str(tmp_path / "picked")).filter("kind = 'ok'")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        plan = plan_of(company.picked_pages(pages, picked))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "might_contain" in plan and "bloom_filter_agg" in plan


def test_merged_partial_folds(spark, corpus):
    """States of any parts of the visited pages, merged in any order, give the same record."""
    pages, _, _ = corpus
    facts = company.corpus_facts(pages).filter("outcome = 'ok'").withColumns(
        {"seed": F.lit("s"), "seq": F.col("page_id") % 7, "depth": (F.col("page_id") % 3).cast("int")}
    )
    visited = facts.withColumn("site", F.lit("one")).unionByName(facts).cache()
    whole = sorted(fold.fold_pages(visited).collect(), key=str)
    assert any(r.offerings for r in whole) and any(r.social for r in whole)
    for salt in range(4):
        parts = [visited.filter(F.pmod(F.hash("page_id", F.lit(salt)), F.lit(3)) == k) for k in range(3)]
        states = [fold.fold_partial(p) for p in parts]
        left = fold.fold_merge(states[salt % 3].unionByName(states[(salt + 1) % 3]))
        # merged twice, and one part twice
        merged = fold.fold_merge(left.unionByName(states[(salt + 2) % 3]).unionByName(states[salt % 3]))
        assert sorted(fold.fold_finish(merged).collect(), key=str) == whole


def test_winners_in_a_state_store(spark, corpus, records, tmp_path):
    """Any split of the pages into batches, late better copies included, gives the records of one run."""
    pages, seeds, _ = corpus
    whole = sorted(company_records(pages, seeds, crawl_ts=NOW).collect(), key=str)
    for salt in (1,):
        base = tmp_path / str(salt)
        landing, changes, checkpoint = (str(base / n) for n in ("landing", "changes", "checkpoint"))
        latest, since = {}, 0
        # descending ids first: the copy that counts comes last
        for part in (2, 1, 0):
            late = pages.filter(F.pmod(F.hash("page_id", F.lit(salt)), F.lit(3)) == part)
            late.coalesce(1).write.mode("append").parquet(landing)
            start_winner_stream(S.stream_pages(spark, landing), changes, checkpoint).awaitTermination()
            for r in refresh_touched(spark, changes, checkpoint, seeds, since, NOW).collect():
                latest[r.identity.website_url] = r
            since += 1
        # a repeated page changes nothing, so nothing is touched
        pages.limit(3).coalesce(1).write.mode("append").parquet(landing)
        start_winner_stream(S.stream_pages(spark, landing), changes, checkpoint).awaitTermination()
        assert refresh_touched(spark, changes, checkpoint, seeds, since, NOW).collect() == []
        for r in whole:
            if r.site != "missing.io":  # a site without pages is never touched
                assert latest[r.identity.website_url] == r
