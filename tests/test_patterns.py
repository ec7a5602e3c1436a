"""Text rules against the plain Python patterns on random texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sitefacts import config as C
from sitefacts.functions import patterns as P
from sitefacts.functions import text as T
from sitefacts.functions.regex import find_all

PIECES = [
    "12", "9", "12345", "St", "street", "road", "ave", "for", "serving", "focusing on", "market", "industry",
    "sectors:", "big", "a", "Éa", "x1", "A", "Main", "dr", "123456789012", "0", "marketing", "therefor", "b2",
    "industries:", "engineer", "sales manager", "the", "product", "x@a.co", "noreply@a.co", "é.b@c-d.org", "@",
    "(555) 123-4567", "+44 20 7946 0958", "91-98765-43210", "a@b.c|d", "१२३४५६७८९०", "don't",
]
GAPS = [" ", " ", " ", ", ", ",", ".", "  ", "\n", " - ", "+", " ", "", "_", "·"]


@pytest.fixture(scope="module")
def mentions(spark):
    rng = random.Random(11)
    texts = [
        "".join(rng.choice(PIECES) + rng.choice(GAPS) for _ in range(rng.randint(1, 30))) for _ in range(3000)
    ]
    text = F.col("t")
    zipped, named = P.address_candidates(text)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    rows = df.select(
        "i", zipped.alias("zipped"), named.alias("named"), P.address_in_text(text).alias("address"),
        P.target_mentions(text).alias("targets"), P.role_mentions(text).alias("roles"),
        P.phone_matches(text, C.PHONE_PATTERNS).alias("phones"),
        P.email_matches(text, C.EMAIL_SKIP_PAGE).alias("emails"),
    ).collect()
    return [(texts[r.i], r) for r in rows]


def unique(items):
    return list(dict.fromkeys(items))


def check(mentions, field, expected, least):
    wrong = [(t, r[field], expected(t)) for t, r in mentions if r[field] != expected(t)]
    assert wrong[:3] == []
    assert sum(bool(r[field]) for _, r in mentions) > least


def test_address_with_zip(mentions):
    check(mentions, "zipped", lambda t: re.findall(C.ADDRESS_PATTERNS[0], t, re.I), 50)


def test_address_with_city(mentions):
    check(mentions, "named", lambda t: re.findall(C.ADDRESS_PATTERNS[1], t, re.I), 500)


def test_address_choice(mentions):
    def choose(t):
        for p in C.ADDRESS_PATTERNS:
            found = re.findall(p, t, re.I)
            if found and 10 < len(max(found, key=len)) < 300:
                return max(found, key=len)
        return None

    check(mentions, "address", choose, 500)


def test_targets(mentions):
    def find(t):
        found = [m.strip() for p in C.TARGET_PATTERNS for m in re.findall(p, t, re.I)]
        return unique(m for m in found if 3 < len(m) < 100)

    check(mentions, "targets", find, 300)


def test_roles(mentions):
    def find(t):
        found = [
            m.strip().title()
            for w in C.JOB_WORDS
            for p in C.ROLE_PATTERNS
            for m in re.findall(p.format(word=w), t.lower())
        ]
        return unique(m for m in found if 5 < len(m) < 50)

    check(mentions, "roles", find, 300)


def test_phones(mentions):
    def find(t):
        found = [m for p in C.PHONE_PATTERNS for m in re.findall(p, t)]
        return [m.strip() for m in found if len(re.sub(r"[^\d+]", "", m)) >= 10]

    check(mentions, "phones", find, 300)


def test_emails(mentions):
    def find(t):
        return [e for e in re.findall(C.EMAIL_PATTERN, t) if not any(s in e.lower() for s in C.EMAIL_SKIP_PAGE)]

    check(mentions, "emails", find, 300)


def test_long_runs_stay_linear(spark):
    """Texts that make the plain patterns backtrack for hours or overflow the regex stack."""
    texts = ["for " + "word " * 100_000, "1 2 3 st " * 30_000, "a-" * 100_000 + " x@a.co", "street Ab " * 50_000]
    text = F.col("t")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(
        F.size(P.target_mentions(text)).alias("targets"),
        F.length(P.longest(P.address_candidates(text)[1])).alias("named"),
        F.size(P.email_matches(text, C.EMAIL_SKIP_PAGE)).alias("emails"),
    ).collect()
    assert [r.emails for r in rows] == [0, 0, 1, 0]
    assert rows[3].named == len(texts[3])


def test_ascii_classes_on_request(spark):
    df = spark.createDataFrame([("Éric engineer", "éa@b.co"), ("big engineer", "a@b.co")], "role string, mail string")
    rows = df.select(
        P.role_mentions(F.col("role"), unicode=False).alias("ascii"),
        P.role_mentions(F.col("role")).alias("roles"),
        P.email_matches(F.col("mail"), (), unicode=False).alias("ascii_mail"),
        P.email_matches(F.col("mail"), ()).alias("mail"),
    ).collect()
    assert [r.ascii for r in rows] == [["Ric Engineer"], ["Big Engineer"]]
    assert [r.roles for r in rows] == [["Éric Engineer"], ["Big Engineer"]]
    assert [r.ascii_mail for r in rows] == [["a@b.co"], ["a@b.co"]]
    assert [r.mail for r in rows] == [[], ["a@b.co"]]


def _plain_emails(text):
    return [m for t in text.split() for m in re.findall(C.EMAIL_PATTERN, t)]


def test_emails_equal_the_plain_pattern(spark):
    rng = random.Random(12)
    pieces = ["a", "b.c", "_", "é", "@", "@", ".", "com", "x.de", "-", "%", "|", "Z9", "!", "@y.org", "q@r.st", "..", "ß@a.bc"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", P.email_matches(F.col("t"), ()).alias("e")).collect()
    assert [(r.t, r.e) for r in got if r.e != _plain_emails(r.t)] == []


@pytest.mark.parametrize("piece", ["a.", "a.@", "<!--", "<title>", "<h1>", "<title", "<script>", "<a@b."])
def test_long_texts_take_seconds(spark, piece):
    text = piece * (1_000_000 // len(piece))
    row = spark.createDataFrame([(text + "@",)], "t string")
    start = time.perf_counter()
    row.select(
        P.email_matches(F.col("t"), ()), T.page_title(F.col("t")), T.page_headings(F.col("t")), T.page_text(F.col("t")),
        F.size(find_all(F.col("t"), T.TOKEN)),
    ).collect()
    assert time.perf_counter() - start < 20


def test_unclosed_parts_end_the_search(spark):
    html = "<title>a</title>x<h1>b<h1>c</h1>y<!-- z <p>w"
    row = spark.createDataFrame([(html,), ("<title>open",)], "t string").select(
        T.page_title(F.col("t")).alias("title"), T.page_headings(F.col("t")).alias("h"), T.page_text(F.col("t")).alias("text")
    ).collect()
    assert (row[0].title, row[0].h, row[0].text) == ("a", ["bc"], "a x b c y") and row[1].title is None
