"""Byte bodies against Python's codecs."""

import pytest
from pyspark.sql import functions as F

from sitefacts.functions import charset as C
from sitefacts.sources import pages as S

PLAIN = "<title>Grüße – “x” €5</title>"
META = '<meta charset="{}">'

CASES = [
    (PLAIN.encode(), None, PLAIN, "utf-8"),
    (b"\xef\xbb\xbf" + PLAIN.encode(), "text/html; charset=iso-8859-1", PLAIN, "utf-8"),
    (PLAIN.encode("cp1252"), None, PLAIN, "windows-1252"),
    (PLAIN.encode("cp1252"), "text/html; charset=ISO-8859-1", PLAIN, "windows-1252"),
    ((META.format("windows-1252") + PLAIN).encode("cp1252"), "text/html; charset=utf-8", META.format("windows-1252") + PLAIN, "windows-1252"),
    ((META.format("latin1") + "é").encode("cp1252"), None, META.format("latin1") + "é", "windows-1252"),
    (b"\xff\xfe" + PLAIN.encode("utf-16-le"), None, PLAIN, "utf-16-le"),
    (b"\xfe\xff" + PLAIN.encode("utf-16-be"), None, PLAIN, "utf-16-be"),
    (b"\x00\x00\xfe\xff" + PLAIN.encode("utf-32-be"), None, PLAIN, "utf-32-be"),
    ((META.format("shift_jis") + "日本").encode("shift_jis"), None, META.format("shift_jis") + "日本", "shift_jis"),
    ("Привет".encode("koi8-r"), 'text/html; charset="KOI8-R"', "Привет", "koi8-r"),
    ('<META http-equiv="Content-Type" content="text/html; charset=gbk">中文'.encode("gbk"), None, '<META http-equiv="Content-Type" content="text/html; charset=gbk">中文', "gbk"),
    # a declaration that the bytes don't fit, one that nobody knows, and bytes that fit nothing
    ((META.format("utf-8") + "é").encode("cp1252"), None, META.format("utf-8") + "é", "windows-1252"),
    ("日本".encode(), "text/html; charset=shift_jis", None, None),
    (PLAIN.encode(), "text/html; charset=nonsense", PLAIN, "utf-8"),
    (b"ab", "text/html; charset=hex", "ab", "utf-8"),
    (b"\xff\xfea", None, "ÿþa", "windows-1252"),
    (b"a\x81\x9d\xff", None, "a\x81\x9dÿ", "windows-1252"),
    (b"", "text/html; charset=utf-16", "", "utf-16"),
    (None, "text/html", None, None),
]


@pytest.fixture(scope="module")
def read(spark):
    rows = [(i, bytearray(b) if b is not None else None, k) for i, (b, k, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "n int, body binary, kind string")
    return {r.n: r.p for r in df.select("n", C.body_parts(F.col("body"), F.col("kind")).alias("p")).collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_bodies(read, n):
    body, _, text, charset = CASES[n]
    if text is None and body is not None:
        return  # whatever it reads as, it is text
    assert (read[n].text, read[n].charset) == (text, charset)


def test_pages_with_bytes(spark):
    rows = [("https://a.io/", bytearray(PLAIN.encode("cp1252")), "text/html"), ("https://a.io/2", None, "text/html")]
    pages = S.as_pages(spark.createDataFrame(rows, "url string, html binary, content_type string"))
    assert [r.html for r in pages.orderBy("url").collect()] == [PLAIN, None]
    assert dict(pages.dtypes)["html"] == "string"
