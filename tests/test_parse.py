import random

from pyspark.sql import functions as F

from sitefacts.functions import nodes as N
from sitefacts.functions.text import page_text
from sitefacts.operators.extract import node_page_text
from sitefacts.operators.parse import collect_nodes, dom_nodes, parse_pages


def shape(html):
    return [(end, parent, tag) for end, parent, tag, _, _ in collect_nodes(html)]


def test_unclosed_tags_nest():
    assert shape("<p><b>x<br><p>y</p>") == [
        (5, -1, "p"), (5, 0, "b"), (2, 1, "#text"), (3, 1, "br"), (5, 1, "p"), (5, 4, "#text"),
    ]


def test_end_tags():
    assert shape("<div><b>x</div>y</i>") == [
        (2, -1, "div"), (2, 0, "b"), (2, 1, "#text"), (3, -1, "#text"),
    ]
    assert shape("<p/>x<br/>y") == [(0, -1, "p"), (1, -1, "#text"), (2, -1, "br"), (3, -1, "#text")]


def test_script_is_opaque():
    assert shape('<script>var t="</p>";</script><p>x') == [
        (1, -1, "script"), (1, 0, "#raw"), (3, -1, "p"), (3, 2, "#text"),
    ]


def test_entities_and_attributes():
    nodes = collect_nodes('<a href="/x?a=1&amp;b=2" data-k=1 ID=q>A &amp; B&copy; &#233;&#x41;&#150;</a>')
    assert nodes[0][3] == {"href": "/x?a=1&b=2", "id": "q"}
    assert nodes[1][4] == "A & B© éA–"


def test_intervals_nest():
    rng = random.Random(3)
    parts = ["<div>", "</div>", "<p>", "</p>", "<b>", "x", " ", "<br>", "<!-- c -->", "<a href=u>", "</a>", "</"]
    for _ in range(300):
        nodes = collect_nodes("".join(rng.choice(parts) for _ in range(30)))
        for number, (end, parent, *_rest) in enumerate(nodes):
            assert number <= end < len(nodes)
            assert parent < number
            assert parent == -1 or end <= nodes[parent][0]


def test_parse_stage_keeps_rows_and_text(spark):
    html = "<title>T</title><style>a{}</style><p>managed<b>by</b> us</p><template>no</template> tail&nbsp;x"
    df = spark.createDataFrame([(i, html if i % 3 else None) for i in range(300)], "page_id long, html string")
    parsed = parse_pages(df)
    text = node_page_text(F.col("nodes")).alias("text")
    rows = parsed.select("page_id", text, "parse_error").collect()
    assert {r.page_id for r in rows} == set(range(300))
    assert {r.text for r in rows if r.page_id % 3} == {"T managed by us tail x"}
    assert {r.text for r in rows if r.page_id % 3 == 0} == {""}
    assert all(r.parse_error is None for r in rows)


def test_table_function_equals_array(spark):
    html = "<div class='a'><p>x<br>y</p></div>"
    df = spark.createDataFrame([(html,)], "html string")
    spark.udtf.register("nodes_of", dom_nodes())
    df.createOrReplaceTempView("one_page")
    rows = spark.sql("SELECT n.* FROM one_page, LATERAL nodes_of(html) AS n").collect()
    assert [(r.end, r.parent, r.tag) for r in sorted(rows, key=lambda r: r.id)] == shape(html)


def test_node_helpers(spark):
    html = (
        "<h1>A</h1><h2>no</h2><div><h2 class='x sub'>deep</h2></div><h2>b</h2>"
        "<div id='k' class='card big'><ul><li>1</li><li>2</li><li>3</li></ul></div>"
        "<a href='/c'><b>Contact us</b></a><a href='/d'>Contact <i>x</i></a><a>contact</a>"
        "<a href='/e'><!--contact--></a>"
    )
    parsed = parse_pages(spark.createDataFrame([(html,)], "html string"))
    nodes = F.col("nodes")
    card = N.select_first(nodes, "div.card")
    row = parsed.select(
        N.node_text(nodes, N.next_sibling(nodes, N.first_node(nodes, N.tag_is("h1")), "h2")).alias("sibling"),
        N.node_text(nodes, N.select_first(nodes, "h2.sub")).alias("sub"),
        N.select_first(nodes, ".car").isNull().alias("whole_class"),
        N.node_text(nodes, N.select_first(nodes, "#k"), ", ").alias("by_id"),
        F.size(N.descendants(nodes, card, N.tag_is("li"), limit=2)).alias("limited"),
        F.transform(N.links_by_text(nodes, "contact"), lambda n: N.attr(n, "href")).alias("links"),
    ).first()
    assert row.sibling == "no"
    assert row.sub == "deep"
    assert row.whole_class
    assert row.by_id == "1, 2, 3"
    assert row.limited == 2
    assert row.links == ["/c", "/e"]


def test_regex_text_equals_parsed_text(spark):
    """The path without a parser reads the same text, cut-off entities included."""
    htmls = [
        "<title>a &amp</title><p>x &lt;b&gt; &copy; y&amp;amp; &amp-</p>",
        "<!-- <p>no --><style>p{}</style><p>1<b> 2</b>3</p><script>'<p>'</script>&quot;q&#39;&nbsp;",
    ]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "page_id int, html string")
    both = parse_pages(df, keep_html=True).select(
        "page_id", page_text(F.col("html")).alias("plain"), node_page_text(F.col("nodes")).alias("parsed")
    )
    for row in both.collect():
        assert row.plain == row.parsed
