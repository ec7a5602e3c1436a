"""Containment, prefix and suffix joins against plain versions."""

import random
import time

from pyspark.sql import functions as F

from sitefacts.config import ExtractConfig
from sitefacts.operators import extract as X
from sitefacts.operators import links as L
from sitefacts.operators.joins import contained_in, salted_join
from sitefacts.operators.login import robots_annotate
from sitefacts.operators.parse import exploded_nodes, parse_pages


def random_tree(rng, size):
    """Rows (id, end, tag) of a random tree in document order."""
    parents = [-1] + [rng.randint(max(-1, i - 6), i - 1) for i in range(1, size)]
    order, children = [], {}
    for i, p in enumerate(parents):
        children.setdefault(p, []).append(i)

    def walk(i):
        at = len(order)
        order.append([at, at, rng.choice("abc")])
        for child in children.get(i, []):
            walk(child)
        order[at][1] = len(order) - 1

    for root in children[-1]:
        walk(root)
    return [tuple(r) for r in order]


def test_contained_in_random_trees(spark):
    rng = random.Random(5)
    trees = {k: random_tree(rng, rng.randint(1, 80)) for k in range(30)}
    rows = [(k, *r) for k, tree in trees.items() for r in tree]
    rng.shuffle(rows)
    nodes = spark.createDataFrame(rows + [(99, None, 3, "a"), (None, 0, 2, "a"), (None, 1, 1, "b")], "page_id long, id int, end int, tag string")
    outer, inner = F.col("tag") == "a", F.col("tag").isin("b", "a")
    got = {tuple(r) for r in contained_in(nodes, ["page_id"], outer, inner).collect()}
    expected = {
        (k, o[0], i[0]) for k, tree in trees.items() for o in tree for i in tree
        if o[2] == "a" and i[2] in "ab" and o[0] < i[0] <= o[1]
    } | {(None, 0, 1)}
    assert got == expected
    nearest = {tuple(r) for r in contained_in(nodes, ["page_id"], outer, inner, nearest=True).collect()}
    assert nearest == {(k, o, i) for k, o, i in expected if o == max(p for q, p, j in expected if (q, j) == (k, i))}


def test_contained_in_equals_inside(spark):
    html = "<div class='a'><p>x<b>y</b></p><div><p>z</p></div></div><p>w</p><ul><li><p>v"
    page = parse_pages(spark.createDataFrame([(1, html)], "page_id long, html string"))
    from sitefacts.functions import nodes as N

    by_slice = page.select(F.explode(N.find_nodes("nodes", N.tag_is("div"))).alias("o"), "nodes").select(
        F.col("o.id").alias("outer_id"), F.explode(N.find_nodes(N.inside(F.col("nodes"), F.col("o")), N.tag_is("p"))).alias("i")
    ).select("outer_id", "i.id")
    joined = contained_in(exploded_nodes(page), ["page_id"], F.col("tag") == "div", F.col("tag") == "p").select("outer_id", "inner_id")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, by_slice.collect())) != []


def test_deep_pages_are_linear(spark):
    """A page of 200,000 nodes inside each other: one step per node and pair."""
    nodes = spark.range(200_000).selectExpr("1L AS page_id", "id", "199999L AS end", "if(id = 199999, 'b', 'a') AS tag")
    begun = time.time()
    found = contained_in(nodes, ["page_id"], F.col("id") % 1000 == 0, F.col("tag") == "b").count()
    pairs = contained_in(nodes, ["page_id"], F.col("tag") == "a", F.lit(True), nearest=True).count()
    assert found == 200 and pairs == 199_999 and time.time() - begun < 60


def plain_note(url, rules, token):
    host, path = url.split("/")[2], "/" + url.split("/", 3)[3]
    mine = sorted(r for r in rules if r[0] == host)
    by_seq = sorted(mine, key=lambda r: (r[2], r[1]))
    named = [r[1] for r in by_seq if r[1] != "*" and r[1].lower() in token]
    group = named[0] if named else "*"
    fits = [r for r in mine if r[1] == group and (r[4] == "*" or path.startswith(r[4]))]
    rule = min(fits, key=lambda r: (r[2], r[3], r[4]), default=None)
    return f"robots.txt restriction noted for {url}" if rule and not rule[3] else None


def test_robots_by_prefix(spark):
    rng = random.Random(2)
    part = lambda: rng.choice(["", "a", "ab", "b", "a/b", "c"])
    hosts = ["big.io"] * 9 + ["small.io"]
    urls = sorted({f"https://{rng.choice(hosts)}/{part()}/{part()}{rng.randint(0, 400)}" for _ in range(1500)})
    rules = [
        (rng.choice(["big.io", "small.io", "other.io"]), rng.choice(["*", "*", "Mozilla", "mozilla", "bot"]), rng.randint(0, 60),
         rng.random() < 0.5, rng.choice(["/", "/" + part(), "/" + part() + "/", "*"]))
        for _ in range(80)
    ]
    frame = spark.createDataFrame([*rules, ("big.io", "*", 0, False, None)], "host string, agent string, seq int, allow boolean, path_prefix string")
    pages = spark.createDataFrame([(u, i) for i, u in enumerate([*urls, urls[0], None])], "url string, n int")
    got = {(r.url, r.n): r.robots_note for r in robots_annotate(pages, frame).collect()}
    assert len(got) == len(urls) + 2 and got[(None, len(urls) + 1)] is None
    notes = {u: plain_note(u, rules, "mozilla") for u in urls}
    assert got == {(u, i): notes.get(u) for i, u in enumerate([*urls, urls[0], None])}
    assert any(notes.values()) and not all(notes.values())


def test_salt_splits_a_hot_key(spark):
    rows = spark.range(20_000).selectExpr("id", "if(id % 10 < 9, 'hot', concat('k', id)) AS key")
    rules = spark.createDataFrame([("hot", 1), ("k19", 2)], "key string, rule int")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        met = salted_join(rows, rules, ["key"], F.col("id")).withColumn("task", F.spark_partition_id())
        counts = [r["count"] for r in met.groupBy("task").count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(counts) == 18_001 and max(counts) < 18_000 / 2


def test_social_table_equals_the_array_form(spark):
    rng = random.Random(6)
    hosts = ["www.facebook.com", "fb.com", "x.com", "netflix.com", "linkedin.com:443", "de.linkedin.com", "youtu.be", "github.com.evil.io", "a.github.com"]
    link = lambda: rng.choice(["/local", "//x.com/p", "mailto:a@x.com", "https://x.com/a?utm_source=b"] + [f"https://{h}/u{rng.randint(0, 9)}" for h in hosts])
    rows = [(i, f"https://site{i % 4}.io/p{i}", "".join(f'<a href="{link()}">t</a>' for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows.append((90, "https://github.com/me", '<a href="/own">t</a>'))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "page_id", "parse_url(url, 'HOST') AS site", "url", "concat('https://', parse_url(url, 'HOST'), '/') AS site_url", "html"
    )
    parsed = X.structured_pages(parse_pages(pages))
    arrays = {r.page_id: r.social for r in parsed.select("page_id", X.social_links(F.col("anchors"), F.col("site_url")).alias("social")).collect()}
    table = L.link_table(parsed.select("page_id", "site", F.col("site_url").alias("url"), "anchors"))
    got = {}
    for r in L.social_table(table, L.social_rules(spark)).collect():
        got.setdefault(r.page_id, {})[r.platform] = r.url
    assert got == {k: v for k, v in arrays.items() if v} and len(got) > 20


def test_no_cap_keeps_all(spark):
    """Every cap can be lifted, and each is obeyed."""
    items = "".join(f"<li>Item number {i:02}</li>" for i in range(40))
    texts = "".join(f"<p>This paragraph number {i} is long enough to count.</p>" for i in range(9))
    html = f'<section class="products"><ul>{items}</ul></section>' + texts
    page = X.structured_pages(parse_pages(spark.createDataFrame([(html, "https://a.io/")], "html string, url string")))
    free = ExtractConfig(max_items=None, max_section_items=None, max_paragraphs=None, max_summary=8)
    read = lambda cfg: page.select(
        X.primary_offerings(F.col("nodes"), F.col("marked"), cfg).alias("o"), X.what_they_do(F.col("nodes"), F.col("marked"), cfg).alias("w")
    ).first()
    assert len(read(ExtractConfig()).o) == 15 and len(read(free).o) == 40
    assert len(read(ExtractConfig(max_items=None)).o) == 15 and len(read(ExtractConfig(max_section_items=4, max_headings=0)).o) == 4
    assert read(ExtractConfig()).w.count("paragraph") == 3 and read(free).w.count("paragraph") == 8


def test_numeric_address_parts(spark):
    html = (
        '<script type="application/ld+json">{"address": {"streetAddress": "Main 5", "addressLocality": true, '
        '"addressRegion": 0, "postalCode": 53111, "addressCountry": 1.5}}</script>'
    )
    page = X.structured_pages(parse_pages(spark.createDataFrame([(html, "https://a.io/")], "html string, url string")))
    assert page.select(X.physical_address(F.col("nodes"), F.col("marked"), F.col("text")).alias("a")).first().a == "Main 5, 53111, 1.5"


def test_contact_page_of_unclosed_links(spark):
    """Links that are never closed hold the rest of the page each; the look-up stays linear."""
    from sitefacts.functions import nodes as N

    def found(count):
        html = "".join(f'<a href="/p{i}">word {i} <b>x</b>' for i in range(count)) + '<p><a href="/c"><i><b>Contact us</b></i></a></p>'
        page = parse_pages(spark.createDataFrame([(html,)], "html string"))
        begun = time.time()
        link = page.select(N.links_by_text(F.col("nodes"), "contact").alias("l")).first().l
        return [n.attrs["href"] for n in link], time.time() - begun

    assert found(10)[0] == ["/c"]
    links, seconds = found(8000)
    assert links == ["/c"] and seconds < 12
    chain = "<div>" * 90 + "deep contact" + "</div>" * 90
    page = parse_pages(spark.createDataFrame([(f'<a href="/d">{chain}</a><a href="/e">contact<br></a><a href="/f">contact <!-- c --></a>',)], "html string"))
    assert [n.attrs["href"] for n in page.select(N.links_by_text(F.col("nodes"), "contact").alias("l")).first().l] == ["/d"]


def test_rows_are_never_broadcast(spark, tmp_path):
    """Spark knows no size of the rules and takes the written rows for small, whatever is made of them."""
    spark.range(100).selectExpr("concat('k', id % 7) AS key", "id").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    rules = spark.createDataFrame([("k1", 1), ("k3", 2)], "key string, rule int")
    met = salted_join(rows, rules, ["key"], F.col("id"))
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    found = {(r["id"], r["rule"]) for r in met.collect()}
    assert found == {(i, {1: 1, 3: 2}[i % 7]) for i in range(100) if i % 7 in (1, 3)}


def test_bounded_rules_are_broadcast(spark, tmp_path):
    spark.range(100).selectExpr("'x.com' AS domain", "id").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    met = salted_join(rows, L.social_rules(spark), ["domain"], F.col("id"))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "SortMergeJoin" not in plan
    assert met.count() == 100
