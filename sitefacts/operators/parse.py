"""HTML to a flat element array, the one stage that needs a Python worker.

Spark partitions the pages; each task streams Arrow batches through the standard library's lenient
tokenizer, which only numbers the nodes. Everything that looks at them is a column expression.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import UserDefinedTableFunction

from sitefacts.functions.nodes import NODE_TYPE

# Elements without content, and elements whose text is not page text.
VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
HIDDEN_TEXT = frozenset("script style template rt rp".split())
KEEPS_BLANKS = frozenset(("pre", "textarea"))
# The attributes some rule reads; the others are not worth carrying through the plan.
USED_ATTRS = frozenset("class id href alt name content property http-equiv type action".split())
# Those that links and login walls read.
WALK_ATTRS = frozenset("class id href name http-equiv content type action".split())

ROWS_PER_BATCH = 64

# Send this module's code along with the tasks: workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class NodeCollector(HTMLParser):
    """Numbers elements, texts and comments of one page in document order."""

    def __init__(self, attrs: frozenset[str] | None) -> None:
        super().__init__(convert_charrefs=False)
        self.kept_attrs = attrs
        self.nodes: list[list] = []  # [end, parent, tag, attrs, text]
        self.open: list[tuple[int, str]] = []
        self.open_count: dict[str, int] = {}
        self.pieces: list[str] = []

    def add(self, tag: str, attrs: dict | None, text: str | None) -> int:
        number = len(self.nodes)
        self.nodes.append([number, self.open[-1][0] if self.open else -1, tag, attrs, text])
        return number

    def flush(self) -> None:
        if not self.pieces:
            return
        text = "".join(self.pieces)
        self.pieces.clear()
        if text.isspace() and not any(self.open_count.get(t) for t in KEEPS_BLANKS):
            text = "\n" if "\n" in text else " "
        hidden = any(self.open_count.get(t) for t in HIDDEN_TEXT)
        self.add("#raw" if hidden else "#text", None, text)

    def handle_starttag(self, tag, attrs):
        self.flush()
        kept = {k: v or "" for k, v in attrs if self.kept_attrs is None or k in self.kept_attrs}
        number = self.add(tag, kept, None)
        if tag not in VOID:
            self.open.append((number, tag))
            self.open_count[tag] = self.open_count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.flush()
        while self.open_count.get(tag):
            number, name = self.open.pop()
            self.open_count[name] -= 1
            self.nodes[number][0] = len(self.nodes) - 1
            if name == tag:
                return

    def handle_data(self, data):
        self.pieces.append(data)

    def handle_entityref(self, name):
        self.pieces.append(html5.get(name + ";") or html5.get(name) or "&" + name)

    def handle_charref(self, name):
        try:
            code = int(name[1:], 16) if name[0] in "xX" else int(name)
            # Numbers in this range usually mean the Windows code page.
            char = bytes([code]).decode("cp1252") if 0x80 <= code < 0xA0 else chr(code)
            char.encode("utf-8")
        except (ValueError, OverflowError, UnicodeError):
            char = "\N{REPLACEMENT CHARACTER}"
        self.pieces.append(char)

    def handle_comment(self, data):
        self.flush()
        self.add("#comment", None, data)

    def handle_decl(self, data):
        self.flush()
        self.add("#other", None, data)

    handle_pi = handle_decl

    def unknown_decl(self, data):
        self.flush()
        if data.upper().startswith("CDATA["):
            self.add("#text", None, data[6:])
        else:
            self.add("#other", None, data)

    def finish(self) -> list[list]:
        self.close()
        self.flush()
        for number, _ in self.open:
            self.nodes[number][0] = len(self.nodes) - 1
        return self.nodes


def collect_nodes(html: str, attrs: frozenset[str] | None = USED_ATTRS) -> list[list]:
    collector = NodeCollector(attrs)
    collector.feed(html)
    return collector.finish()


_ATTR_TYPE = pa.map_(pa.string(), pa.string())
_NODE_TYPE = pa.struct(
    [
        ("id", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()),
        ("tag", pa.string()), ("attrs", _ATTR_TYPE), ("text", pa.string()),
    ]
)


def _node_arrays(htmls: list[str | None], attrs: frozenset[str] | None) -> tuple[pa.Array, pa.Array]:
    """Flat Arrow buffers for a batch: far cheaper than a Python dict per node."""
    ids: list[int] = []
    rows: list[list] = []
    offsets: list[int | None] = [0]
    errors: list[str | None] = []
    starts: list[int | None] = []
    for html in htmls:
        starts.append(len(rows))
        error = None
        if html is None:
            starts[-1] = None
        else:
            try:
                nodes = collect_nodes(html, attrs)
                ids.extend(range(len(nodes)))
                rows.extend(nodes)
            except Exception as problem:  # one bad page must not end the job
                starts[-1], error = None, f"{type(problem).__name__}: {problem}"
        errors.append(error)
    offsets = starts + [len(rows)]

    keys: list[str] = []
    values: list[str] = []
    attr_offsets: list[int | None] = []
    for row in rows:
        attr_offsets.append(None if row[3] is None else len(keys))
        if row[3]:
            keys.extend(row[3].keys())
            values.extend(row[3].values())
    attr_offsets.append(len(keys))

    attr_array = pa.MapArray.from_arrays(
        pa.array(attr_offsets, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string())
    )
    columns = [
        pa.array(ids, pa.int32()),
        pa.array([r[0] for r in rows], pa.int32()),
        pa.array([r[1] for r in rows], pa.int32()),
        pa.array([r[2] for r in rows], pa.string()),
        attr_array,
        pa.array([r[4] for r in rows], pa.string()),
    ]
    structs = pa.StructArray.from_arrays(columns, fields=list(_NODE_TYPE))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs), pa.array(errors, pa.string())


def parse_pages(
    pages: DataFrame, keep_html: bool = False, attrs: frozenset[str] | None = USED_ATTRS
) -> DataFrame:
    """Add ``nodes`` and ``parse_error``; filter before calling, Catalyst cannot push filters through.

    Batches are cut to a few rows each, so worker memory follows the page size and not the
    session's Arrow batch length.
    """
    source = pages.withColumn("__html", F.coalesce("html", F.lit("")))
    passed = pages if keep_html else pages.drop("html")
    source = source if keep_html else source.drop("html")
    schema = T.StructType(
        list(passed.schema.fields)
        + [
            T.StructField("nodes", T.ArrayType(NODE_TYPE)),
            T.StructField("parse_error", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_BATCH):
                part = batch.slice(start, ROWS_PER_BATCH)
                names = part.schema.names
                nodes, errors = _node_arrays(part.column(names.index("__html")).to_pylist(), attrs)
                kept = [n for n in names if n != "__html"]
                yield pa.RecordBatch.from_arrays(
                    [part.column(names.index(n)) for n in kept] + [nodes, errors],
                    names=kept + ["nodes", "parse_error"],
                )

    return source.mapInArrow(run, schema)


class _DomNodes:
    """Arrow batches in, Arrow batches out; a row of the table argument is ``page_id, html``."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        for start in range(0, batch.num_rows, ROWS_PER_BATCH):
            part = batch.slice(start, ROWS_PER_BATCH)
            nodes, _ = _node_arrays(part.column("html").to_pylist(), None)
            sizes = [0 if n is None else n for n in nodes.value_lengths().to_pylist()]
            flat = nodes.flatten()
            owner = pa.array([i for i, n in enumerate(sizes) for _ in range(n)], pa.int64())
            names = [f.name for f in flat.type]
            yield pa.table(
                [part.column("page_id").take(owner), *[flat.field(i) for i in range(len(names))]], names=["page_id", *names]
            )


def dom_nodes() -> UserDefinedTableFunction:
    """Vectorised table function over a table ``page_id, html``: one row per node, all attributes kept."""
    fields = [T.StructField("page_id", T.LongType()), *NODE_TYPE.fields]
    return F.arrow_udtf(_DomNodes, returnType=T.StructType(fields))


def exploded_nodes(parsed: DataFrame) -> DataFrame:
    """Row view of ``nodes``."""
    return parsed.select("*", F.explode("nodes").alias("node")).select(
        *[c for c in parsed.columns if c != "nodes"], "node.*"
    )
