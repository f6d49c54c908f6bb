"""HTML as an array of nodes, queried with higher-order functions.

:func:`html_nodes` is the only Python step: it turns each page into its nodes in
document order. ``no``/``last`` give the span of a node's subtree, so a subtree is a
slice and every selector is a filter. Selection, fallbacks and text assembly are
built-in expressions on that array.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

from stellwerk.functions.text import EDGE_SPACE, bind, fresh_name, quote

# Workers get this module's code with the tasks, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template rt rp".split())

NODE_FIELDS = [
    ("no", T.IntegerType(), pa.int32()),
    ("last", T.IntegerType(), pa.int32()),
    ("parent", T.IntegerType(), pa.int32()),
    ("tag", T.StringType(), pa.string()),
    ("attrs", T.MapType(T.StringType(), T.StringType()), pa.map_(pa.string(), pa.string())),
    ("text", T.StringType(), pa.string()),
    ("raw", T.StringType(), pa.string()),
]
NODES = T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind, _ in NODE_FIELDS]))
NODES_TYPE = NODES.simpleString()
TEXT = ""
HIDDEN_TEXT = "#hidden"
#: Characters of pages that a worker holds as nodes at once, a single longer page aside.
PIECE_CHARS = 1 << 20


class _Nodes(HTMLParser):
    """Collects nodes; an end tag closes everything opened since its start tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        #: How many elements are open by name, and how many of them hide their text.
        self.names: Counter[str] = Counter()
        self.hidden = 0
        self.pending: list[str] = []

    def _flush(self):
        raw = "".join(self.pending)
        self.pending.clear()
        if not raw:
            return
        clean = raw.strip()
        if not clean:
            raw = "\n" if "\n" in raw else " "
        self._add(HIDDEN_TEXT if self.hidden else TEXT, None, clean, None if raw == clean else raw)

    def _add(self, tag, attrs, text=None, raw=None):
        no = len(self.rows) + 1
        self.rows.append([no, no, self.open[-1] + 1 if self.open else 0, tag, attrs, text, raw])

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_starttag(self, tag, attrs, closed=False):
        self._flush()
        values = {k: v or "" for k, v in attrs}
        if "class" in values:
            values["class"] = " ".join(values["class"].split())
        self._add(tag, list(values.items()) or None)
        if not closed and tag not in VOID:
            self.open.append(len(self.rows) - 1)
            self.names[tag] += 1
            self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, closed=True)

    def handle_endtag(self, tag):
        self._flush()
        if self.names[tag]:
            while self._close() != tag:
                pass

    def _close(self):
        row = self.rows[self.open.pop()]
        row[1] = len(self.rows)
        self.names[row[3]] -= 1
        self.hidden -= row[3] in HIDDEN
        return row[3]

    def finish(self) -> list[list]:
        self.close()
        self._flush()
        while self.open:
            self._close()
        return self.rows


def parse_nodes(html: str) -> list[list] | None:
    """Nodes of one page; None when the markup cannot be read at all."""
    parser = _Nodes()
    try:
        parser.feed(html)
        return parser.finish()
    except (AssertionError, ValueError):
        return None


def _node_array(pages: list[str | None]) -> pa.Array:
    """The nodes of some pages as one array; NULL for NULL or unreadable pages.

    A page that follows itself, as several captures or links of one page do, is parsed once.
    """
    columns: list[list] = [[] for _ in NODE_FIELDS]
    offsets: list[int | None] = []
    places: list[int] = []
    total = 0
    for k, html in enumerate(pages):
        if k and html == pages[k - 1]:
            places.append(places[-1])
            continue
        rows = None if html is None else parse_nodes(html)
        places.append(len(offsets))
        offsets.append(None if rows is None else total)
        for column, values in zip(columns, zip(*rows or ())):
            column.extend(values)
        total += len(rows or ())
    offsets.append(total)
    nodes = pa.StructArray.from_arrays(
        [pa.array(c, type=kind) for c, (_, _, kind) in zip(columns, NODE_FIELDS)],
        names=[name for name, _, _ in NODE_FIELDS],
    )
    parsed = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), nodes)
    return parsed if len(parsed) == len(places) else parsed.take(pa.array(places, type=pa.int32()))


@F.arrow_udf(NODES)
def html_nodes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Node array per page, NULL for NULL or unreadable pages.

    A batch goes back in pieces of some ``PIECE_CHARS`` characters, so that a worker's memory follows the
    longest page and not the number of pages in a batch.
    """
    for batch in batches:
        piece: list[str | None] = []
        chars = 0
        for page in batch:
            html = page.as_py()
            piece.append(html)
            chars += len(html or "")
            if chars >= PIECE_CHARS:
                yield _node_array(piece)
                piece, chars = [], 0
        if piece:
            yield _node_array(piece)


def strip_sql(sql: str) -> str:
    """SQL trimming every kind of white space."""
    return f"regexp_replace({sql}, {quote(EDGE_SPACE)}, '')"


#: A selector: SQL condition on a node.
Test = Callable[[str], str]


def attr(node: str, name: str) -> str:
    return f"try_element_at({node}.attrs, {quote(name)})"


def tag(*names: str) -> Test:
    return lambda n: f"{n}.tag IN ({', '.join(quote(t) for t in names)})"


def has_class(name: str) -> Test:
    """Class token equality."""
    return lambda n: f"contains(concat(' ', {attr(n, 'class')}, ' '), {quote(f' {name} ')})"


def class_like(regex: str) -> Test:
    return attr_like("class", regex)


def attr_is(name: str, value: str) -> Test:
    return lambda n: f"{attr(n, name)} = {quote(value)}"


def attr_like(name: str, regex: str) -> Test:
    return lambda n: f"rlike({attr(n, name)}, {quote(regex)})"


def has_attr(name: str) -> Test:
    return lambda n: f"{attr(n, name)} IS NOT NULL"


def both(*tests: Test) -> Test:
    return lambda n: "(" + " AND ".join(t(n) for t in tests) + ")"


class Dom:
    """SQL over a contiguous run of nodes: a page, or the subtree of one of its nodes.

    ``nodes`` is a column or lambda variable. Methods return SQL text for ``F.expr``;
    built as text, a portal's rules cost one parse instead of a call per operation.
    """

    def __init__(self, nodes: str):
        self.nodes = nodes

    @property
    def node(self) -> str:
        """The run's first node: the root of a subtree."""
        return f"{self.nodes}[0]"

    def matching(self, test: Test) -> str:
        n = fresh_name()
        return f"filter({self.nodes}, {n} -> {test(n)})"

    def subtree(self, node: str) -> str:
        return f"slice({self.nodes}, {node}.no - {self.nodes}[0].no + 1, {node}.last - {node}.no + 1)"

    def _take(self, found: str, take: Callable[[Dom], str]) -> str:
        n, d = fresh_name(), fresh_name()
        return f"transform(transform({found}, {n} -> {self.subtree(n)}), {d} -> {take(Dom(d))})"

    def each(self, test: Test, take: Callable[[Dom], str]) -> str:
        """``take`` of every matching subtree, in document order."""
        return self._take(self.matching(test), take)

    def first(self, test: Test, take: Callable[[Dom], str]) -> str:
        """``take`` of the first match, NULL without one."""
        return f"try_element_at({self._take(f'slice({self.matching(test)}, 1, 1)', take)}, 1)"

    def last(self, test: Test, take: Callable[[Dom], str]) -> str:
        return f"try_element_at({self._take(f'slice(reverse({self.matching(test)}), 1, 1)', take)}, 1)"

    def first_text(self, test: Test, sep: str = "") -> str:
        return self.first(test, lambda d: d.text(sep))

    def first_of(self, tests: list[Test], take: Callable[[Dom], str]) -> str:
        """Selectors tried in order."""
        return "coalesce(" + ", ".join(self.first(t, take) for t in tests) + ")"

    def first_attr(self, test: Test, name: str) -> str:
        n = fresh_name()
        return f"try_element_at(transform(slice({self.matching(test)}, 1, 1), {n} -> {attr(n, name)}), 1)"

    def parent_text(self, root: Dom) -> str:
        """Text of the parent of a subtree of ``root``; all of ``root`` for a node at the top."""
        inside = bind(
            root.subtree(f"try_element_at({root.nodes}, nullif({self.node}.parent, 0))"), lambda d: Dom(d).text()
        )
        return f"CASE WHEN {self.node}.parent > 0 THEN {inside} ELSE {root.text()} END"

    def text(self, sep: str = "", without: tuple[str, ...] = ()) -> str:
        """Stripped, non-blank visible texts joined by ``sep``; '' when there are none."""
        n, t = fresh_name(), fresh_name()
        visible = f"filter({self.nodes}, {n} -> {n}.tag = '{TEXT}' AND {n}.text <> '')"
        if without:
            n, c = fresh_name(), fresh_name()
            hides = lambda cut: f"NOT exists({cut}, {c} -> {n}.no > {c}.no AND {n}.no <= {c}.last)"
            visible = bind(self.matching(tag(*without)), lambda cut: f"filter({visible}, {n} -> {hides(cut)})")
        return f"array_join(transform({visible}, {t} -> {t}.text), {quote(sep)})"

    def _as_written(self, kind: str) -> str:
        n, t = fresh_name(), fresh_name()
        kept = f"filter({self.nodes}, {n} -> {n}.tag = '{kind}')"
        return f"array_join(transform({kept}, {t} -> coalesce({t}.raw, {t}.text)), '')"

    def raw_text(self) -> str:
        """Visible text as written, nothing stripped."""
        return self._as_written(TEXT)

    def script_text(self) -> str:
        """Text of a script element."""
        return self._as_written(HIDDEN_TEXT)

    def mentions(self, *needles: str) -> str:
        """True when tag, attribute or text of any node holds one of the needles."""
        n = fresh_name()
        markup = (
            f"concat_ws(' ', {n}.tag, array_join(map_keys({n}.attrs), ' '), "
            f"array_join(map_values({n}.attrs), ' '), {n}.text)"
        )
        holds = " OR ".join(f"contains({markup}, {quote(needle)})" for needle in needles)
        return f"exists({self.nodes}, {n} -> {holds})"


def whole_references(html: Column) -> Column:
    """Markup in which only a reference that ends with a semicolon is one.

    Browsers, and :func:`html_nodes`, also read some older names without it, so that a text cut off after
    ``&amp`` shows an ampersand. With this every other ampersand stands for itself. The text of scripts and
    styles changes too.
    """
    return F.regexp_replace(html, r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);)", "&amp;")


def page_title(html: Column) -> Column:
    """Text of the first ``title`` element, read by pattern."""
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def page_heading(html: Column) -> Column:
    """Markup of the first ``h1`` element, read by pattern."""
    return F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)


def list_items(html: Column) -> Column:
    """Markup of every ``li`` element, read by pattern."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<li[^>]*>(.*?)</li>"), 1)
