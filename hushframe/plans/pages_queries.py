"""Queries over raw pages: nodes, predicates, names, containers and outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.materialize import materialized
from ..operators import identify, nodes, outline, redact
from ..operators.fields import fields_to_mask as mask_fields
from ..sources import pages as source
from ..sources.tables import src_pages as read_pages
from ..sources.tables import src_text as read_text
from ..sources.tables import src_truth as read_truth
from ..sources.tables import spread, table
from . import markup, sql
from .markup import FORMED, with_forms
from .registry import query


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of all pages, parsed once however many joins read them."""
    return materialized(source.page_nodes(with_forms(spark, sf_dir)))


def kept_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = page_rows(spark, sf_dir)
    kept = materialized(nodes.name_dominance(nodes.candidates(rows)))
    return rows, materialized(nodes.without_weak_inside(kept))


@query("SELECT page_id, url, html FROM pages")
def src_pages(spark, sf_dir):
    return read_pages(spark, sf_dir)


@query("SELECT doc_id, text FROM documents")
def src_text(spark, sf_dir):
    return read_text(spark, sf_dir, "documents", "doc_id")


@query(f"SELECT page_id, 'email' AS kind, NULL AS decoy, 'user' || CAST(page_id AS VARCHAR) || '@example.com' AS text FROM {FORMED} WHERE contains(html, 'data-pii') UNION ALL SELECT page_id, NULL, 'price', '450' FROM {FORMED} WHERE contains(html, 'data-decoy')")
def src_truth(spark, sf_dir):
    return read_truth(with_forms(spark, sf_dir))


_TITLE = sql.squash("regexp_extract(html, $$(?is)<title[^>]*>(.*?)</title>$$, 1)")


@query(f"SELECT page_id, url, {_TITLE} AS title, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages")
def page_header(spark, sf_dir):
    return source.page_header(read_pages(spark, sf_dir))


_LINK = """$$(?is)<a\\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>$$"""


@query(
    f"""SELECT page_id, CAST(pos AS BIGINT) AS pos, href, {sql.squash("regexp_replace(raw, '<[^>]*>', '', 'g')")} AS text FROM (SELECT page_id, unnest(regexp_extract_all(html, {_LINK}, 1)) AS href, unnest(regexp_extract_all(html, {_LINK}, 2)) AS raw,
    unnest(range(len(regexp_extract_all(html, {_LINK}, 1)))) AS pos FROM pages)"""
)
def page_links(spark, sf_dir):
    return source.page_links(read_pages(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT page_id, url, regexp_matches(url, '^(chrome|edge|about|chrome-extension|devtools|view-source):') AS internal FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'about:blank' ELSE url END AS url FROM pages)")
def internal_url(spark, sf_dir):
    pages = read_pages(spark, sf_dir).select("page_id", F.when(F.col("page_id") % 5 == 0, "about:blank").otherwise(F.col("url")).alias("url"))
    return nodes.internal_url(pages)


@query(f"SELECT page_id, node_id, tag FROM {markup.NODES}")
def page_nodes(spark, sf_dir):
    return source.page_nodes(with_forms(spark, sf_dir)).select("page_id", F.col("node_id").cast("long").alias("node_id"), "tag")


@query(f"SELECT page_id, node_id AS pos, tag FROM {markup.NODES}")
def document_order(spark, sf_dir):
    return nodes.document_order(page_rows(spark, sf_dir)).select("page_id", F.col("pos").cast("long").alias("pos"), "tag")


@query(f"SELECT page_id, text FROM {markup.WHOLE_TEXTS}")
def page_text_nodes(spark, sf_dir):
    return source.page_text_nodes(page_rows(spark, sf_dir)).select("page_id", "text")


@query(f"{sql.found_ctes(markup.TEXTS, 'page_id, k', 'text')} SELECT page_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\", kind FROM found")
def find_in_pages(spark, sf_dir):
    found = identify.find_in_pages(source.page_text_nodes(page_rows(spark, sf_dir)))
    return found.select("page_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "kind")


@query(f"SELECT page_id, 'https://ads.example.com/a?b=1' AS src, 'ads.example.com' AS label FROM {FORMED} WHERE contains(html, '<iframe')")
def page_frames(spark, sf_dir):
    return source.page_frames(page_rows(spark, sf_dir)).select("page_id", "src", "label")


def _flag(name: str, function, column: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = nodes.node_role(page_rows(spark, sf_dir))
        return function(rows).groupBy("page_id", "tag", column).agg(F.count("*").alias("n"))

    run.__name__ = name
    query(f"SELECT page_id, tag, {markup.FLAGS[column]} AS {column}, count(*) AS n FROM {markup.NODES} GROUP BY ALL")(run)


for _name, _function, _column in (
    ("node_interactive", nodes.node_interactive, "interactive"),
    ("node_strong_signal", nodes.node_strong_signal, "strong"),
    ("node_strong_element", nodes.node_strong_element, "strong_element"),
    ("node_link_or_button", nodes.node_link_or_button, "link_or_button"),
    ("node_focusable", nodes.node_focusable, "focusable"),
    ("node_widget_state", nodes.node_widget_state, "widget_state"),
    ("node_search_hint", nodes.node_search_hint, "search_hint"),
):
    _flag(_name, _function, _column)


def _long_id(df: DataFrame) -> DataFrame:
    return df.withColumn("node_id", F.col("node_id").cast("long"))


@query(f"SELECT page_id, node_id, tag, {markup.ROLE} AS role FROM {markup.NODES}")
def node_role(spark, sf_dir):
    return _long_id(nodes.node_role(page_rows(spark, sf_dir))).select("page_id", "node_id", "tag", "role")


@query(f"SELECT page_id, role, count(*) AS elements FROM (SELECT page_id, {markup.ROLE} AS role FROM {markup.NODES}) WHERE role <> '' GROUP BY ALL")
def role_counts(spark, sf_dir):
    return nodes.role_counts(nodes.node_role(page_rows(spark, sf_dir)).where("role <> ''"))


@query(f"SELECT page_id, node_id, tag FROM {markup.NODES} WHERE {markup.VISIBLE}")
def node_visible(spark, sf_dir):
    return _long_id(nodes.node_visible(page_rows(spark, sf_dir))).select("page_id", "node_id", "tag")


_BOX = "CAST(node_id % 7 * 20 - 60 AS DOUBLE) AS x, CAST(node_id * 11 - 40 AS DOUBLE) AS y, CAST(5 + page_id % 9 * 3 AS DOUBLE) AS width, CAST(8 + node_id % 5 AS DOUBLE) AS height, CASE WHEN node_id % 10 = 0 THEN 'fixed' ELSE 'static' END AS position"


def _boxed(rows: DataFrame) -> DataFrame:
    """Bounds that follow from each node's place: a rendered crawl would bring them."""
    return rows.selectExpr("page_id", "node_id", *_split(_BOX))


def _split(columns: str) -> list[str]:
    return [c.strip() for c in columns.split(", CA")[:1]] + [f"CA{c.strip()}" for c in columns.split(", CA")[1:]]


@query(
    f"""SELECT page_id, node_id, tag FROM (SELECT page_id, node_id, tag, {_BOX} FROM {markup.NODES}) WHERE width >= 10 AND height >= 10
    AND (position = 'fixed' OR (y + height > -200 AND x + width > -200 AND y < 300 + 200 AND x < 100 + 200))"""
)
def node_near_viewport(spark, sf_dir):
    rows = _long_id(page_rows(spark, sf_dir)).select("page_id", "node_id", "tag")
    return nodes.node_near_viewport(rows, _boxed(rows), 100, 300).select("page_id", "node_id", "tag")


@query(
    f"""WITH n AS (SELECT *, max(CASE WHEN tag = 'nav' THEN node_id END) OVER (PARTITION BY page_id ORDER BY node_id) AS nav, max(CASE WHEN tag IN ('div', 'article') THEN node_id END) OVER (PARTITION BY page_id ORDER BY node_id) AS past FROM {markup.NODES})
    SELECT page_id, node_id, tag FROM n WHERE page_id % 2 = 0 AND nav IS NOT NULL AND past IS NULL"""
)
def node_scrollable(spark, sf_dir):
    """Navigation bars that have more content than they show, on every other page."""
    rows = page_rows(spark, sf_dir)
    metrics = rows.where("tag in ('nav', 'body')").select("page_id", "node_id", F.lit("auto").alias("overflow_y"), F.lit("visible").alias("overflow_x"), F.when(F.col("page_id") % 2 == 0, 500).otherwise(101).alias("scroll_height"), F.lit(100).alias("client_height"), F.lit(50).alias("scroll_width"), F.lit(50).alias("client_width"))
    return _long_id(nodes.node_scrollable(rows, metrics).where("scrollable")).select("page_id", "node_id", "tag")


@query(f"SELECT page_id, node_id, tag, name FROM {markup.NAMED} WHERE tag <> 'div'")
def node_name(spark, sf_dir):
    """Names of controls."""
    named = redact.redact_names(nodes.node_name(page_rows(spark, sf_dir)))
    return _long_id(named.where(F.col("tag").isin("input", "button", "a", "select", "textarea", "option"))).select("page_id", "node_id", "tag", "name")


_LONG_NAME = "repeat('word ', CAST(page_id % 25 AS INT)) || 'to user' || CAST(page_id AS VARCHAR) || '@example.com at last'"
_MASKED_NAME = "repeat('word ', CAST(page_id % 25 AS INT)) || 'to [redacted:email] at last'"


def _cut(text: str, limit: int) -> str:
    return f"CASE WHEN length({text}) > {limit} THEN substr({text}, 1, {limit - 1}) || '…' ELSE {text} END"


def _long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of every length, with an address that cutting first would cut through."""
    return table(spark, sf_dir, "pages").selectExpr("page_id", "repeat('word ', cast(page_id % 25 as int)) || 'to user' || cast(page_id as string) || '@example.com at last' as name")


@query(f"SELECT page_id, {_cut(_MASKED_NAME, 80)} AS name FROM pages")
def redact_names(spark, sf_dir):
    return redact.redact_names(_long_names(spark, sf_dir))


@query(f"SELECT page_id, node_id, 'Mail [redacted:email] now' AS label FROM {markup.NODES} WHERE tag = 'section'")
def redact_container_labels(spark, sf_dir):
    rows = nodes.container_labels(page_rows(spark, sf_dir)).where(F.col("tag").isin(*nodes.STRUCTURAL_TAGS) & F.col("label").isNotNull())
    return _long_id(redact.redact_container_labels(rows)).select("page_id", "node_id", "label")


@query(f"SELECT page_id, node_id, CASE WHEN tag = 'input' THEN 'user' || CAST(page_id AS VARCHAR) || '@example.com' WHEN tag = 'textarea' THEN 'call 9876543210' ELSE 'Two' END AS value FROM {markup.NODES} WHERE tag IN ('textarea', 'select') OR {markup.value('id')} = 'mail'")
def node_value(spark, sf_dir):
    return _long_id(nodes.node_value(page_rows(spark, sf_dir)).where("value <> ''")).select("page_id", "node_id", "value")


def _valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nodes.node_sensitive(nodes.node_value(page_rows(spark, sf_dir)))
    return nodes.node_states(redact.redact_values(rows))


_VALUE_STATE = f"""CASE WHEN {markup.value('id')} = 'mail' THEN 'value=[redacted:email]' WHEN tag = 'textarea' THEN 'value="call [redacted:tel]"' WHEN tag = 'select' THEN 'value="Two"' ELSE replace({markup.STATES}, ', ', ',') END"""


@query(f"SELECT * FROM (SELECT page_id, node_id, tag, {_VALUE_STATE} AS states FROM {markup.NODES}) WHERE states <> ''")
def node_states(spark, sf_dir):
    return _long_id(_valued(spark, sf_dir).where(F.size("states") > 0)).select("page_id", "node_id", "tag", F.array_join("states", ",").alias("states"))


@query(f"SELECT page_id, CASE WHEN tag = 'input' THEN 'email' END AS kind, CASE WHEN tag = 'input' THEN '[redacted:email]' WHEN tag = 'textarea' THEN 'call [redacted:tel]' ELSE 'Two' END AS value FROM {markup.NODES} WHERE tag IN ('textarea', 'select') OR {markup.value('id')} = 'mail'")
def redact_values(spark, sf_dir):
    return _valued(spark, sf_dir).where("value <> ''").select("page_id", F.col("sensitive").alias("kind"), "value")


@query(f"SELECT page_id, 'email' AS kind, CAST(page_id AS DOUBLE) AS x FROM {FORMED} WHERE contains(html, 'type=\"email\"')")
def fields_to_mask(spark, sf_dir):
    rows = _valued(spark, sf_dir).withColumn("bounds", F.struct(F.col("page_id").cast("double").alias("x")))
    return mask_fields(rows).select("page_id", "kind", F.col("bounds.x").alias("x"))


@query(f"SELECT page_id, 'email' AS kind, CAST(1 AS BIGINT) AS fields FROM {FORMED} WHERE contains(html, 'type=\"email\"')")
def classified_counts(spark, sf_dir):
    return nodes.classified_counts(nodes.node_sensitive(page_rows(spark, sf_dir)))


@query(f"SELECT page_id, node_id, 'E mail' AS label FROM {markup.NODES} WHERE {markup.value('id')} = 'mail' AND page_id % 4 <> 3")
def label_for(spark, sf_dir):
    return _long_id(nodes.label_for(page_rows(spark, sf_dir))).select("page_id", "node_id", "label")


@query(f"SELECT page_id, node_id, 'Beta Alpha' AS label FROM {markup.NODES} WHERE {markup.has('aria-labelledby')}")
def labelled_by(spark, sf_dir):
    return _long_id(nodes.labelled_by(page_rows(spark, sf_dir))).select("page_id", "node_id", "label")


@query(f"SELECT page_id, node_id, tag, name FROM {markup.KEPT}")
def name_dominance(spark, sf_dir):
    kept = redact.redact_names(nodes.name_dominance(nodes.candidates(page_rows(spark, sf_dir))))
    return _long_id(kept).select("page_id", "node_id", "tag", "name")


@query(
    f"""WITH n AS (SELECT page_id, node_id, tag, attrs, max(CASE WHEN {markup.has('onclick')} THEN node_id END) OVER w AS box, max(CASE WHEN tag = 'select' THEN node_id END) OVER w AS sel FROM {markup.NODES} WINDOW w AS (PARTITION BY page_id ORDER BY node_id))
    SELECT page_id, node_id, CASE WHEN tag = 'option' THEN sel ELSE box END AS ancestor FROM n WHERE tag = 'option' OR (box IS NOT NULL AND node_id IN (box + 1, box + 2))"""
)
def nearest_kept_ancestor(spark, sf_dir):
    rows, kept = kept_nodes(spark, sf_dir)
    return _long_id(nodes.nearest_kept_ancestor(rows, kept)).withColumn("ancestor", F.col("ancestor").cast("long"))


@query(f"SELECT page_id, node_id, tag FROM {markup.CONTAINERS}")
def structural_containers(spark, sf_dir):
    return _long_id(nodes.structural_containers(*kept_nodes(spark, sf_dir))).select("page_id", "node_id", "tag")


@query(f"SELECT page_id, node_id, parent, CAST(level AS BIGINT) AS level FROM {markup.PLACED}")
def attach_parents(spark, sf_dir):
    placed = nodes.attach_parents(*kept_nodes(spark, sf_dir))
    return placed.select("page_id", *[F.col(c).cast("long").alias(c) for c in ("node_id", "parent", "level")])


@query(f"SELECT page_id, node_id, tag FROM {markup.NAMED}")
def collapse_wrappers(spark, sf_dir):
    """With boxes that follow from each node's place: deeper nodes lie within the ones above."""
    rows = nodes.node_link_or_button(nodes.node_strong_element(nodes.candidates(page_rows(spark, sf_dir))))
    level = F.col("depth").cast("double")
    rows = rows.withColumns({"x": level, "y": level, "width": 200 - 2 * level, "height": 100 - 2 * level})
    return _long_id(nodes.collapse_wrappers(rows.select("page_id", "node_id", "last", "pos", "tag", "strong_element", "link_or_button", "x", "y", "width", "height"))).select("page_id", "node_id", "tag")


#: A page laid out in rows of ten boxes that do not overlap; a page's section lies over the first five rows.
_HIDDEN = "node_id < 50 AND page_id IN (SELECT page_id FROM {0} WHERE tag = 'section')"


@query(
    f"""SELECT page_id, count(*) AS visited, count(*) FILTER ({markup.FLAGS['interactive']} AND {markup.VISIBLE}) AS interactive, count(k.node_id) AS after_name,
    count(k.node_id) FILTER (NOT ({_HIDDEN.format(markup.NODES)})) AS after_occlusion, count(k.node_id) FILTER (NOT ({_HIDDEN.format(markup.NODES)})) AS final
    FROM {markup.NODES} n LEFT JOIN (SELECT page_id, node_id FROM {markup.KEPT}) k USING (page_id, node_id) GROUP BY page_id"""
)
def scan_funnel(spark, sf_dir):
    rows = page_rows(spark, sf_dir)
    over = F.col("tag") == "section"
    box = lambda own, covering: F.when(over, F.lit(float(covering))).otherwise(own.cast("double"))
    row, column = F.floor(F.col("node_id") / 10), F.col("node_id") % 10
    bounds = rows.select("page_id", "node_id", box(column * 50, 0).alias("x"), box(row * 40, 0).alias("y"), box(F.lit(45), 600).alias("w"), box(F.lit(35), 200).alias("h"), F.when(over, 1 << 30).otherwise(F.col("node_id")).alias("paint_order"))
    return nodes.scan_funnel(rows, materialized(bounds), 500, 400)


@query(
    f"""{sql.found_ctes(markup.TEXTS, 'page_id, k', 'text')} SELECT p.page_id, url, coalesce(n.elements, 0) AS elements, coalesce(f.regions, 0) AS regions, coalesce(n.frames, 0) AS frames, coalesce(n.frames, 0) AS fields FROM pages p
    LEFT JOIN (SELECT page_id, count(*) FILTER ({markup.FLAGS['interactive']}) AS elements, count(*) FILTER (tag = 'iframe') AS frames FROM {markup.NODES} GROUP BY page_id) n ON p.page_id = n.page_id
    LEFT JOIN (SELECT page_id, count(*) AS regions FROM found GROUP BY page_id) f ON p.page_id = f.page_id"""
)
def page_scan_report(spark, sf_dir):
    rows = materialized(nodes.node_sensitive(nodes.node_role(page_rows(spark, sf_dir))))
    found = identify.find_in_pages(source.page_text_nodes(rows))
    return nodes.page_scan_report(read_pages(spark, sf_dir), nodes.node_interactive(rows).where("interactive"), found, source.page_frames(rows))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = nodes.placed_controls(page_rows(spark, sf_dir)).withColumn("scrollable", F.lit(False))
    return outline.element_line(nodes.node_states(redact.redact_controls(placed)))


@query(f"SELECT page_id, node_id, line FROM {markup.LINES}")
def element_line(spark, sf_dir):
    return _long_id(_lines(spark, sf_dir)).select("page_id", "node_id", "line")


@query(f"SELECT page_id, outline FROM {markup.OUTLINES}")
def page_outline(spark, sf_dir):
    return outline.page_outline(_lines(spark, sf_dir))


#: Tabs of a page's browser: one to three, the second with an address in its title; where the page is scrolled to.
_TABS = "SELECT page_id, CAST(k AS BIGINT) AS tab_id, CASE k WHEN 1 THEN 'Mail of u' || CAST(page_id AS VARCHAR) || '@example.com' ELSE 'Tab' END AS title, 'https://x.example.com/' || CAST(k AS VARCHAR) AS url, k = page_id % 2 AS active FROM pages, range(3) t(k) WHERE k <= page_id % 3"
_TAB_LINES = f"""(SELECT page_id, 'Tabs:' || chr(10) || string_agg(CASE WHEN active THEN '*' ELSE ' ' END || ' [' || CAST(tab_id AS VARCHAR) || '] ' || CAST(to_json(regexp_replace(title, '{sql.EMAIL}', '[redacted:email]', 'g')) AS VARCHAR) || ' ' || url, chr(10) ORDER BY tab_id) || chr(10) AS tabs
    FROM ({_TABS}) GROUP BY page_id HAVING count(*) > 1)"""


#: A page's title (k = 0) and address (k = 1) stand in its observation as they are redacted.
_SHOWN = f"(SELECT page_id, 0 AS k, {_TITLE} AS text FROM pages UNION ALL SELECT page_id, 1, url FROM pages)"


@query(
    f"""{sql.redacted_ctes(_SHOWN, 'page_id, k', 'text')}, header AS (SELECT page_id, coalesce(max(out) FILTER (k = 0), '') AS title, coalesce(max(out) FILTER (k = 1), '') AS url FROM redacted GROUP BY page_id)
    SELECT p.page_id, 'Browser state:' || chr(10) || coalesce(tabs, '') || 'Page: ' || CAST(to_json(p.title) AS VARCHAR) || ' — ' || p.url || chr(10) || 'Viewport: ' || CAST(800 + p.page_id % 5 AS VARCHAR) || 'x600, scrolled to (0, ' || CAST(p.page_id * 3 AS VARCHAR) || ')'
    || chr(10) || chr(10) || CASE WHEN coalesce(outline, '') = '' THEN 'The page shows no control.' ELSE '{outline.HEADING}' || chr(10) || outline END AS observation
    FROM header p LEFT JOIN {markup.OUTLINES} o ON p.page_id = o.page_id LEFT JOIN {_TAB_LINES} t ON p.page_id = t.page_id"""
)
def page_observation(spark, sf_dir):
    pages = read_pages(spark, sf_dir)
    each = pages.select("page_id", F.explode(F.sequence(F.lit(0), (F.col("page_id") % 3).cast("int"))).alias("tab_id"))
    title = F.when(F.col("tab_id") == 1, F.concat(F.lit("Mail of u"), F.col("page_id").cast("string"), F.lit("@example.com"))).otherwise("Tab")
    tabs = each.select("page_id", "tab_id", F.col("tab_id").alias("pos"), title.alias("title"), F.concat(F.lit("https://x.example.com/"), F.col("tab_id").cast("string")).alias("url"), (F.col("tab_id") == F.col("page_id") % 2).alias("active"))
    views = pages.select("page_id", (F.lit(800) + F.col("page_id") % 5).alias("width"), F.lit(600).alias("height"), F.lit(-0.4).alias("scroll_x"), (F.col("page_id") * 3 + 0.25).alias("scroll_y"))
    return outline.page_observation(source.page_header(pages), page_outline(spark, sf_dir), "both", tabs, views)


_FRAME = "page_id + 1 AS child, CAST(page_id % 5 AS DOUBLE) AS fx, 3.0 AS fy, 120.0 AS fw, 80.0 AS fh"
#: Chains of eleven frames, one in the other.
_CHAINED = "page_id % 12 <> 0"


def _inlined(rows: str, more: str) -> str:
    """``rows(page_id, node_id, x, y, w, h, text)`` in every page above, level by level."""
    return f"""WITH RECURSIVE e AS ({rows}),
    f AS (SELECT page_id AS host, {_FRAME} FROM {markup.NODES} WHERE tag = 'iframe' AND {_CHAINED}),
    l AS (SELECT page_id, node_id, x, y, w, h, text, '' AS tag, 0 AS depth FROM e UNION ALL
        SELECT host, node_id, greatest(fx + 2 + x, fx), greatest(fy + 2 + y, fy), least(fx + 2 + x + w, fx + fw) - greatest(fx + 2 + x, fx), least(fy + 2 + y + h, fy + fh) - greatest(fy + 2 + y, fy), text, 'f1-' || l.tag, depth + 1
        FROM l JOIN f ON f.child = l.page_id WHERE least(fx + 2 + x + w, fx + fw) > greatest(fx + 2 + x, fx) AND least(fy + 2 + y + h, fy + fh) > greatest(fy + 2 + y, fy))
    SELECT page_id, node_id, {more}, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS width, round(h, 6) AS height, tag, CAST(depth AS BIGINT) AS depth FROM l"""


def _chain_of_frames(rows: DataFrame) -> DataFrame:
    return source.page_frames(rows).where(_CHAINED).selectExpr("page_id", "node_id as pos", "page_id + 1 as child_page_id", "cast(page_id % 5 as double) as x", "3.0D as y", "120.0D as width", "80.0D as height", "2.0D as border_left", "2.0D as border_top")


def _rounded(out: DataFrame, *first: str) -> DataFrame:
    return out.select(*first, *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")], "tag", F.col("depth").cast("long").alias("depth"))


_ELEMENTS = f"SELECT page_id, node_id, CAST(node_id * 9 % 140 AS DOUBLE) AS x, CAST(node_id % 6 * 15 AS DOUBLE) AS y, 30.0 AS w, 20.0 AS h, tag AS text FROM {markup.NODES} WHERE tag IN ('a', 'button')"


@query(_inlined(_ELEMENTS, "text || ' [redacted:email#' || tag || CAST(node_id AS VARCHAR) || ']' AS name"))
def inline_frames(spark, sf_dir):
    """Links and buttons of pages whose frames hold the page of the next number, a handle in each name; bounds follow from the nodes' places."""
    rows = _long_id(page_rows(spark, sf_dir))
    elements = rows.where("tag in ('a', 'button')").selectExpr("page_id", "node_id as element_id", "concat(tag, ' [redacted:email#', node_id, ']') as name", "cast(node_id * 9 % 140 as double) as x", "cast(node_id % 6 * 15 as double) as y", "30.0D as width", "20.0D as height")
    return _rounded(nodes.inline_frames(elements, _chain_of_frames(rows)), "page_id", F.col("element_id").alias("node_id"), "name")


@query(_inlined(f"SELECT page_id, node_id, CAST(node_id * 7 % 110 AS DOUBLE) AS x, CAST(node_id % 8 * 9 AS DOUBLE) AS y, 25.0 AS w, 12.0 AS h, 'email' AS text FROM {markup.NODES} WHERE {markup.has('data-pii')}", "text AS kind"))
def inline_regions(spark, sf_dir):
    """Regions of what is marked as personal, in the page itself and in those that embed it."""
    rows = _long_id(page_rows(spark, sf_dir))
    regions = rows.where(F.map_contains_key("attrs", F.lit("data-pii"))).selectExpr("page_id", "node_id as region_id", "'email' as kind", "cast(node_id * 7 % 110 as double) as x", "cast(node_id % 8 * 9 as double) as y", "25.0D as width", "12.0D as height")
    return _rounded(nodes.inline_regions(regions, _chain_of_frames(rows)), "page_id", F.col("region_id").alias("node_id"), "kind")


@query("SELECT c_custkey AS user_id, '[redacted:email] — https://x.example.com/' || CAST(c_custkey AS VARCHAR) || chr(10) || 'Orders — https://x.example.com/?m=[redacted:email]' AS tabs FROM customer")
def redact_tabs(spark, sf_dir):
    users = spread(table(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("mail"))
    first = F.struct(F.lit(1).alias("pos"), F.col("mail").alias("title"), F.concat(F.lit("https://x.example.com/"), F.col("user_id").cast("string")).alias("url"))
    second = F.struct(F.lit(2).alias("pos"), F.lit("Orders").alias("title"), F.concat(F.lit("https://x.example.com/?m="), F.col("mail")).alias("url"))
    return redact.redact_tabs(users.select("user_id", F.explode(F.array(first, second)).alias("t")).select("user_id", "t.*"))
