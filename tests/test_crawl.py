"""Walks against a plain recursive walk on hand-written and random sites."""

import random
from collections import deque

import pytest

from sitefacts.config import ExtractConfig
from sitefacts.operators import crawl
from sitefacts.operators.crawl import crawl_attempts, visits


def simple_walk(site, seed, cfg, order):
    """``site``: url -> (outcome, links). Returns the list of (url, depth, outcome)."""
    visited, log, queue = [], [], deque([(seed, 0)])
    while queue and len(visited) < cfg.max_pages:
        url, depth = queue.popleft()
        if url in visited:
            continue
        outcome, links = site.get(url, ("absent", []))
        log.append((url, depth, outcome))
        if outcome == "login":
            break
        if outcome != "ok":
            continue
        visited.append(url)
        if depth < cfg.max_depth:
            children = [(u, depth + 1) for u in links if u not in visited][: cfg.links_per_page]
            queue.extend(children) if order == "bfs" else queue.extendleft(reversed(children))
    return log


def run(spark, sites, cfg, order):
    rows = [
        (site, url, outcome, links)
        for site, (_, pages) in sites.items()
        for url, (outcome, links) in pages.items()
    ]
    index = spark.createDataFrame(rows, "site string, url string, outcome string, links array<string>")
    index = index.selectExpr("site", "url", "struct(outcome, links) AS page")
    seeds = spark.createDataFrame([(s, seed) for s, (seed, _) in sites.items()], "site string, url string")
    attempts = crawl_attempts(seeds, index, cfg, order)
    got = {}
    for r in sorted(attempts.collect(), key=lambda r: r.attempt):
        got.setdefault(r.site, []).append((r.url, r.depth, r.outcome))
    return attempts, got


def chain_site(n):
    return {f"p{i}": ("ok", [f"p{i + 1}"]) for i in range(n)}


def random_site(rng):
    names = [f"u{i}" for i in range(rng.randint(2, 60))]
    width = rng.choice([2, 6, 20])
    kinds = ["ok"] * 12 + ["error", "skipped"] + ["login"] * rng.choice([0, 0, 1])
    return names[0], {
        u: (rng.choice(kinds) if u != names[0] else "ok", rng.sample(names, min(len(names), rng.randint(0, width))))
        for u in names
        if rng.random() > 0.1 or u == names[0]
    }


@pytest.mark.parametrize("order", ["dfs", "bfs"])
def test_walks(spark, order):
    rng = random.Random(7)
    star = {"s": ("ok", [f"l{i}" for i in range(20)]), **{f"l{i}": ("ok", []) for i in range(20)}}
    small = {"s": ("ok", ["a", "b"]), "a": ("ok", ["c"]), "b": ("ok", []), "c": ("ok", ["b"])}
    sites = {
        "chain": ("p0", chain_site(20)), "star": ("s", star), "small": ("s", small), "gone": ("x", {"y": ("ok", [])}),
        **{f"random{i}": random_site(rng) for i in range(60)},
    }
    cfg = ExtractConfig()
    attempts, got = run(spark, sites, cfg, order)
    expected = {name: simple_walk(pages, seed, cfg, order) for name, (seed, pages) in sites.items()}
    assert got == expected
    assert [u for u, _, _ in got["chain"]] == [f"p{i}" for i in range(6)]
    assert [u for u, _, _ in got["star"]] == ["s"] + [f"l{i}" for i in range(5)]
    assert [u for u, _, _ in got["small"]] == (["s", "a", "c", "b"] if order == "dfs" else ["s", "a", "b", "c"])
    seen = [r for r in visits(attempts).collect() if r.site == "chain"]
    assert [(r.seq, r.depth) for r in sorted(seen)] == [(i, i) for i in range(6)]
    assert any(len(log) > cfg.max_pages for log in got.values())


def test_unknown_order(spark):
    empty = spark.createDataFrame([], "site string, url string")
    with pytest.raises(ValueError):
        crawl_attempts(empty, empty, order="random")


def pages_frame(spark, sites):
    rows = [
        (site, url, outcome, links) for site, (_, pages) in sites.items() for url, (outcome, links) in pages.items()
    ]
    return spark.createDataFrame(rows, "site string, url string, outcome string, links array<string>")


def counted_rounds(monkeypatch, spark, sites, cfg, order):
    rounds = []
    cut = crawl.cut_lineage
    monkeypatch.setattr(crawl, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    _, got = run(spark, sites, cfg, order)
    monkeypatch.setattr(crawl, "cut_lineage", cut)
    return len(rounds), got


def tree_site(width, depth, path="t"):
    children = [f"{path}{i}" for i in range(width)] if depth else []
    site = {path: ("ok", children)}
    for child in children:
        site |= tree_site(width, depth - 1, child)
    return site


@pytest.mark.parametrize("order", ["dfs", "bfs"])
def test_rounds_follow_the_depth(spark, monkeypatch, order):
    """A walk learns a level of every open branch in a round, however many pages it visits."""
    long = ExtractConfig(max_depth=9, max_pages=40)
    sites = {"chain": ("p0", chain_site(30)), "tree": ("t", tree_site(2, 4)), "wide": ("t", tree_site(4, 2))}
    rounds, got = counted_rounds(monkeypatch, spark, sites, long, order)
    assert got == {s: simple_walk(p, seed, long, order) for s, (seed, p) in sites.items()}
    assert len(got["tree"]) == 31 and len(got["wide"]) == 21
    assert rounds <= long.max_depth + 2
    short = ExtractConfig()
    rounds, _ = counted_rounds(monkeypatch, spark, {"tree": ("t", tree_site(3, 5))}, short, order)
    assert rounds <= short.max_depth + 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_index_is_not_shuffled(spark):
    rng = random.Random(3)
    sites = {f"random{i}": random_site(rng) for i in range(20)}
    facts, cfg = pages_frame(spark, sites), ExtractConfig()
    index = crawl.bucketed_index(facts, cfg)
    seeds = spark.createDataFrame([(s, seed) for s, (seed, _) in sites.items()], "site string, url string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plans = []
    real = crawl.answers

    def watched(state, *rest):
        found = real(state, *rest)
        plans.append(plan_of(found))
        return found

    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        crawl.answers = watched
        attempts = crawl_attempts(seeds, index, cfg).collect()
    finally:
        crawl.answers = real
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans
    for plan in plans:
        join = plan[plan.index("SortMergeJoin"):]
        assert join.count("Exchange") == 1 and "Bucketed: true" in join  # of the requests
    got = {}
    for r in sorted(attempts, key=lambda r: r.attempt):
        got.setdefault(r.site, []).append((r.url, r.depth, r.outcome))
    assert got == {s: simple_walk(p, seed, cfg, "dfs") for s, (seed, p) in sites.items()}


def test_supplier_pages_are_built_on_all_cores(spark, testdata):
    """Short site rows become long pages: adaptive execution would build them all in one task."""
    from sitefacts.plans.supplier_sites import supplier_pages

    assert supplier_pages(spark, testdata).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
