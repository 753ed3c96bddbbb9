"""Pages as rows: nodes in document order, text nodes, headers, links and frames.

One Python pass parses the markup (unclosed tags included); everything after it is relational.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import squash
from ..operators.identify import cap_per_group
from ..operators.nodes import INTERACTIVE_TAGS, SEARCH_WORDS, WIDGET_ATTRIBUTES

NODES = (
    "page_id long, node_id int, parent_id int, last int, depth int, pos int, tag string, attrs map<string,string>, "
    "own_texts array<string>, inline_text string, desc_text string, shadow boolean, shown double, label_id int, select_id int"
)
#: Tags that are no nodes, and those that have no content.
SKIPPED = frozenset("style script noscript link meta head br hr template".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A new one of these closes an open one of the group.
CLOSED_BY = {"p": ("p",), "li": ("li",), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
BLOCKS = frozenset("article aside div dl fieldset footer form h1 h2 h3 h4 h5 h6 header main nav ol section table ul".split())
#: Inline tags, whose text belongs to the parent's name; and controls, whose text is their own.
INLINE = frozenset("span em strong b i small abbr code mark sub sup cite q u s del ins time kbd var samp a".split())
CONTROLS = frozenset("a button input select textarea summary option".split())
NO_TEXT = ("script", "style", "noscript", "template", "title")
MIN_TEXT = 10
#: Attributes that may make a control of any tag (others do so by what they say), and tags that have a name to be asked for.
TELLING = frozenset(("role", "tabindex", "contenteditable", "href", "onclick", *WIDGET_ATTRIBUTES))
NAMED = frozenset((*INTERACTIVE_TAGS, "label", "summary", "iframe", "area"))
_SEARCH = re.compile(SEARCH_WORDS)
_OPACITY = re.compile(r"(?:^|;)\s*opacity\s*:\s*([0-9.]+)")
_BLANKS = re.compile(r"\s+")


class _Element:
    """An open or closed element; its texts are ``first:end`` of the page's text pieces."""

    __slots__ = ("attrs", "end", "first", "hidden", "node", "outside", "parent", "parts", "shadow", "shown", "skips", "tag", "texts")

    def __init__(self, tag: str, attrs: dict[str, str], parent: _Element | None, shadow: bool, first: int):
        self.tag, self.attrs, self.parent, self.shadow = tag, attrs, parent, shadow
        self.parts: list[int | _Element] = []
        self.node, self.first, self.end = -1, first, None
        own = tag in SKIPPED and not (tag == "template" and "shadowrootmode" in attrs)
        #: Within a tag that is not walked; a declared shadow root is.
        self.hidden = own or (parent is not None and parent.hidden)
        #: Elements up to this one whose text is nobody's above them: that of skipped tags, and that of these and of controls.
        self.skips = (parent.skips if parent else 0) + (tag in SKIPPED)
        self.outside = (parent.outside if parent else 0) + (tag in SKIPPED or tag in CONTROLS or "role" in attrs)
        self.shown = (parent.shown if parent else 1.0) * _opacity(attrs)


def _opacity(attrs: dict[str, str]) -> float:
    found = _OPACITY.search(attrs["style"].lower()) if "style" in attrs else None
    try:
        return float(found.group(1)) if found else 1.0
    except ValueError:
        return 1.0


class _Parser(HTMLParser):
    """Elements in document order, to any depth. Text is kept once, in pieces; an element knows which are within it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.open = _Element("", {}, None, False, 0)
        self.order: list[_Element] = []
        self.pieces: list[str] = []
        #: Of each piece the element that it stands in.
        self.owners: list[_Element] = []
        self.opened: Counter[str] = Counter()
        self.cut = False

    def end(self, at: _Element) -> None:
        """Ends the innermost elements up to and with ``at``."""
        while True:
            ended = self.open
            ended.end, self.open = len(self.pieces), ended.parent
            self.opened[ended.tag] -= 1
            if ended is at:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes = CLOSED_BY.get(tag, ("p",) if tag in BLOCKS else ())
        if any(self.opened[c] for c in closes):
            at = self.open
            while at.parent is not None and at.tag not in BLOCKS:
                if at.tag in closes:
                    self.end(at)
                    break
                at = at.parent
        values = {k: v or "" for k, v in reversed(attrs)}
        root = tag == "template" and "shadowrootmode" in values
        element = _Element(tag, values, self.open, self.open.shadow or root, len(self.pieces))
        self.open.parts.append(element)
        self.order.append(element)
        self.open = element
        self.opened[tag] += 1
        if tag in VOID:
            self.end(element)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.opened[tag]:
            return
        at = self.open
        while at.tag != tag:
            at = at.parent
        self.end(at)

    def handle_comment(self, data: str) -> None:
        self.cut = True  # a comment ends a text node

    def handle_data(self, data: str) -> None:
        parts = self.open.parts
        if parts and isinstance(parts[-1], int) and not self.cut:
            self.pieces[parts[-1]] += data
        else:
            parts.append(len(self.pieces))
            self.pieces.append(data)
            self.owners.append(self.open)
        self.cut = False

    def close(self) -> None:
        super().close()
        while self.open.parent is not None:
            self.end(self.open)

    def whole(self, e: _Element) -> list[str]:
        """Text within an element, without that of skipped tags."""
        return [] if e.tag in SKIPPED else [self.pieces[i] for i in range(e.first, e.end) if self.owners[i].skips == e.skips]

    def inline_text(self, e: _Element) -> str:
        """An element's own text and that of its inline children, in order."""
        texts: list[str] = []
        for part in e.parts:
            if isinstance(part, int):
                texts.append(self.pieces[part])
            elif part.tag in INLINE:
                texts += self.whole(part)
        return _BLANKS.sub(" ", "".join(texts))

    def outer_text(self, e: _Element) -> str:
        """Text within an element, without that of skipped tags, controls and elements with a role of their own."""
        return _BLANKS.sub(" ", "".join(self.pieces[i] for i in range(e.first, e.end) if self.owners[i].outside == e.outside))


def _may_be_asked(e: _Element, referred: set[str]) -> bool:
    """Whether anything asks for an element's text: labels, what others refer to, and whatever may be a control."""
    if e.tag in NAMED or not TELLING.isdisjoint(e.attrs) or e.attrs.get("id") in referred or "cursor" in e.attrs.get("style", ""):
        return True
    return any(_SEARCH.search(v.lower()) for k, v in e.attrs.items() if k in ("class", "id") or k.startswith("data-"))


def parsed(html: str | None) -> list[dict]:
    """Nodes of one page, in document order; null or empty markup has none.

    ``last`` is the last node of a node's subtree, ``shown`` the product of the opacities from the
    root down, ``label_id`` the nearest label with a text above and ``select_id`` the nearest list.
    ``inline_text`` and ``desc_text`` are whole, and gathered only where something can ask for them
    (the second only where the first is blank); elsewhere they are null.
    """
    parser = _Parser()
    parser.feed(html or "")
    parser.close()
    referred = {word for e in parser.order for word in e.attrs.get("aria-labelledby", "").split()}
    rows: list[dict] = []
    for e in parser.order:
        if e.hidden or e.tag == "template":
            continue
        e.node = len(rows)
        up = e.parent
        while up.parent is not None and up.node < 0:
            up = up.parent
        above = rows[up.node] if up.node >= 0 else None
        inherited = lambda tag, name: above["node_id"] if above["tag"] == tag and (tag != "label" or above["inline_text"].strip()) else above[name]
        asked = _may_be_asked(e, referred)
        inline = parser.inline_text(e) if asked else None
        rows.append({
            "node_id": e.node, "parent_id": up.node if above else None, "last": e.node, "depth": above["depth"] + 1 if above else 0, "pos": e.node, "tag": e.tag, "attrs": e.attrs,
            "own_texts": [parser.pieces[x] for x in e.parts if isinstance(x, int)], "inline_text": inline, "desc_text": parser.outer_text(e) if asked and not inline.strip() else None, "shadow": e.shadow,
            "shown": e.shown, "label_id": inherited("label", "label_id") if above else None, "select_id": inherited("select", "select_id") if above else None,
        })
    for row in reversed(rows):
        if row["parent_id"] is not None:
            above = rows[row["parent_id"]]
            above["last"] = max(above["last"], row["last"])
    return rows


_ARROW = pa.schema([
    ("page_id", pa.int64()), *[(c, pa.int32()) for c in ("node_id", "parent_id", "last", "depth", "pos")], ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("own_texts", pa.list_(pa.string())),
    ("inline_text", pa.string()), ("desc_text", pa.string()), ("shadow", pa.bool_()), ("shown", pa.float64()), ("label_id", pa.int32()), ("select_id", pa.int32()),
])
#: Nodes that go to Spark at a time.
BATCH_NODES = 20_000


def page_nodes(pages: DataFrame) -> DataFrame:
    """``pages`` as node rows, numbered in document order. Pages are independent, and nothing is shuffled unless the input has fewer partitions than there are cores: parsing is what takes time, and one small file would keep one core busy."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    if not pages.isStreaming and pages.rdd.getNumPartitions() < cores:
        pages = pages.select("page_id", "html").repartition(cores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[str, list] = {name: [] for name in _ARROW.names}

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(values, _ARROW.field(name).type) for name, values in columns.items()], schema=_ARROW)
            for values in columns.values():
                values.clear()
            return made

        for batch in batches:
            for page, html in zip(batch.column(0), batch.column(1), strict=True):
                for row in parsed(html.as_py()):
                    columns["page_id"].append(page.as_py())
                    for name, value in row.items():
                        columns[name].append(list(value.items()) if name == "attrs" else value)
                if len(columns["page_id"]) >= BATCH_NODES:
                    yield batch_of()
        yield batch_of()

    return pages.select("page_id", "html").mapInArrow(run, NODES)


def page_text_nodes(nodes: DataFrame, min_len: int = MIN_TEXT, cap: int | None = None) -> DataFrame:
    """``page_id, node_id, nth, text``: each text node by itself, if long enough; ``nth`` counts those of its element.

    What stands before and after a child, a line break or a comment is two text nodes, never one.
    With ``cap`` the first so many of each page.
    """
    rows = nodes.where(~F.col("tag").isin(*NO_TEXT)).select("page_id", "node_id", F.posexplode("own_texts").alias("nth", "text"))
    rows = rows.withColumn("text", squash(F.col("text"))).where(F.char_length("text") >= min_len)
    return rows if cap is None else cap_per_group(rows, ["page_id"], ["node_id", "nth"], cap)


def page_header(pages: DataFrame) -> DataFrame:
    """``page_id, url, title, host``."""
    title = squash(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.select("page_id", "url", title.alias("title"), F.expr("try_parse_url(url, 'HOST')").alias("host"))


def page_links(pages: DataFrame) -> DataFrame:
    """``page_id, pos, href, text`` of anchors, in order."""
    link = r'(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
    part = lambda n: F.regexp_extract_all("html", F.lit(link), F.lit(n))
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(part(1).alias("href"), part(2).alias("text"))).alias("pos", "l"))
    return rows.select("page_id", "pos", "l.href", squash(F.regexp_replace("l.text", "<[^>]*>", "")).alias("text"))


def page_frames(nodes: DataFrame) -> DataFrame:
    """``page_id, node_id, src, label`` of embedded documents; the label does not show a query string."""
    src = F.try_element_at("attrs", F.lit("src"))
    title = F.nullif(squash(F.try_element_at("attrs", F.lit("title"))), F.lit(""))
    rows = nodes.where(F.col("tag").isin("iframe", "frame")).select("page_id", "node_id", src.alias("src"), title.alias("title"))
    return rows.select("page_id", "node_id", "src", F.coalesce("title", F.expr("try_parse_url(src, 'HOST')"), F.lit("embedded frame")).alias("label"))
