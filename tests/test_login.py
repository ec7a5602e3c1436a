from pyspark.sql import functions as F

from sitefacts.operators.extract import structured_pages
from sitefacts.operators.login import login_signals, robots_annotate
from sitefacts.operators.parse import parse_pages

PASSWORD = '<input type="password" name="password">'
CASES = {
    "https://a.co/authors": ("", None, {"by_url"}),
    "https://a.co/1": ("<title>Customer Login</title>", None, {"by_title"}),
    "https://a.co/2": (f'<div class="content"><form>{PASSWORD}</form></div>', None, {"by_form"}),
    "https://a.co/3": (f"<form>{PASSWORD}</form>", None, set()),
    "https://a.co/4": (f"<form>E<b>mail</b>{PASSWORD}</form>", None, {"by_form"}),
    "https://a.co/5": ('<form id="auth"><input type="text"></form>', None, set()),
    "https://a.co/6": ('<form id="auth">sign in<input type="password" name="x"></form>', None, {"by_form"}),
    "https://a.co/7": (f"{PASSWORD}<form>email</form>", None, set()),
    "https://a.co/8": ("<p>Please <b>log in</b> to continue</p>", None, {"by_text"}),
    "https://a.co/9": ('<meta http-equiv="Refresh" content="0;url=/SignIn">', None, {"by_refresh"}),
    "https://a.co/10": ("", {"WWW-Authenticate": "Basic"}, {"by_header"}),
    "https://a.co/11": ("<script>access denied</script><p>fine</p>", None, set()),
}


def test_signals(spark):
    rows = [(url, html, headers) for url, (html, headers, _) in CASES.items()]
    pages = spark.createDataFrame(rows, "url string, html string, headers map<string,string>")
    got = login_signals(structured_pages(parse_pages(pages))).collect()
    signals = [c for c in got[0].__fields__ if c.startswith("by_")]
    assert {r.url: {s for s in signals if r[s]} for r in got} == {u: c[2] for u, c in CASES.items()}


def test_robots_first_matching_rule_of_the_named_group(spark):
    rules = spark.createDataFrame(
        [
            ("a.co", "*", 0, False, "/"),
            ("a.co", "Mozilla", 1, True, "/open"),
            ("a.co", "Mozilla", 2, False, "/o"),
            ("b.co", "otherbot", 0, False, "/"),
            ("b.co", "*", 1, False, "/x"),
        ],
        "host string, agent string, seq int, allow boolean, path_prefix string",
    )
    urls = ["https://a.co/open/1", "https://a.co/other", "https://a.co/x", "https://b.co/x1", "https://b.co/y", "https://c.co/"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    noted = {r.url for r in robots_annotate(pages, rules).filter(F.col("robots_note").isNotNull()).collect()}
    assert noted == {"https://a.co/other", "https://b.co/x1"}
