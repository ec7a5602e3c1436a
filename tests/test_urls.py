from itertools import product
from urllib.parse import urljoin

from pyspark.sql import functions as F

from sitefacts.functions import urls as U

SEEDS = {
    "example.com": "https://example.com/",
    "http://a.b/c?x=1#t": "http://a.b/c",
    "https://": None,
    "https://a.b/c/": "https://a.b/c/",
    "a.b:8080/x;p?q": "https://a.b:8080/x",
}
NAMES = {
    "https://www.ab-widgets.com/": "Ab-Widgets",
    "https://www.en.sample.org/": "En",
    "https://acme.io/x": "Acme",
    "https://a1b.io": "A1B",
    "https://localhost:80/": "Localhost:80",
    "/no/host": None,
}


def _map(spark, values, column):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string").select("i", column(F.col("v")).alias("r"))
    return [r.r for r in sorted(df.collect(), key=lambda r: r.i)]


def test_seed_forms(spark):
    assert _map(spark, SEEDS, U.normalize_url) == list(SEEDS.values())


def test_normalize_is_idempotent(spark):
    valid = [v for v in SEEDS.values() if v]
    assert _map(spark, valid, U.normalize_url) == valid


def test_domain_names(spark):
    assert _map(spark, NAMES, U.domain_name) == list(NAMES.values())


def test_resolve_matches_standard_library(spark):
    bases = ["https://a.b/x/y?q=1", "https://a.b/x/y/", "http://a.b", "http://a.b/", "https://u@a.b:8/k;p/l.html"]
    refs = [
        "/z", "z", "../z", "./", "?k=2", "#f", "//h.c/p;x?y#z", "mailto:x@y", "", "../../../z", "a/./c/..",
        " /about", "javascript:void(0)", "/a|b%zz", "/a/../b/", "..", ".", "/..", "z#f", "z?k#f", "q:1",
        "http://o.p/q/../r", "https://o.p", "./a:b",
    ]
    pairs = list(product(bases, refs))
    df = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(pairs)], "i int, b string, r string")
    got = df.select("i", U.resolve_url(F.col("b"), F.col("r")).alias("u")).collect()
    expected = [urljoin(b, r) for b, r in pairs]
    wrong = [(pairs[r.i], r.u, expected[r.i]) for r in got if r.u != expected[r.i]]
    assert wrong == []


def test_tracking_marks(spark):
    values = ["https://a.b/?utm_source=x", "https://a.b/?REF=x", "https://a.b/affiliate/x", "https://a.b/x"]
    assert _map(spark, values, U.is_tracking_url) == [True, True, True, False]
