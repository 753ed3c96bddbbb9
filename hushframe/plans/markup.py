"""What the queries over pages know of the markup, stated once for Spark and once for DuckDB.

Pages get a form before their end, written from their own numbers and in four orders, some with
unclosed tags. ``NODES`` numbers the nodes of a page in SQL: by their start tags, in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import nodes
from ..sources.tables import src_pages
from . import sql

_P = "cast(page_id as string)"
_MAIL = f"user' || {_P} || '@example.com"
_INPUT = f'<input id="mail" type="email" value="{_MAIL}">'
_LABELLED = f"""case page_id % 4 when 0 then '<label for="mail">E mail</label>{_INPUT}' when 1 then '{_INPUT}<label for="mail">E mail</label>'
    when 2 then '<label>E mail{_INPUT}</label>' else '{_INPUT.replace("type=", 'aria-label="E mail" type=')}' end"""
#: A form with a labelled field, stacked controls, an embedded page, states, values, references, hidden parts and a named section.
FORM = f"""'<form id="f' || {_P} || '">' || {_LABELLED} || '<input type="checkbox" checked aria-label="Agree"><div onclick="go()"><a href="/p' || {_P} || '"><span tabindex="0">Go on</span></a></div>'
    || case when page_id % 5 = 0 then '<p>see<b>this' else '' end || '<iframe src="https://ads.example.com/a?b=1"></iframe><button aria-expanded="false" disabled>Send now</button><span data-pii="email">{_MAIL}</span><em data-decoy="price">450</em>'
    || '<textarea id="t' || {_P} || '">call 9876543210</textarea><select id="s' || {_P} || '"><option>One<option selected>Two</select><i id="l1">Alpha</i><i id="l2">Beta</i><button aria-labelledby="l2 l1">x</button>'
    || '<div style="display:none">gone</div><div style="opacity:0"><i class="dim">faded words here</i></div><section aria-label="Mail {_MAIL} now"><a href="/q' || {_P} || '">In</a></section></form>'"""
FORMED = f"(SELECT page_id, url, replace(html, '</body>', {FORM} || '</body>') AS html FROM pages)"


def with_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src_pages(spark, sf_dir).selectExpr("page_id", "url", f"replace(html, '</body>', {FORM} || '</body>') as html")


_BODY = "regexp_replace(html, '(?s)<!--.*?-->|<head>.*?</head>|<script.*?</script>|<style.*?</style>', '<!>', 'g')"
_START = r"<([a-z][a-z0-9]*)(\s[^>]*)?>"
#: page_id, node_id, tag, attrs (as written); nothing that is no node or stands in a hidden part.
NODES = f"""(SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS BIGINT) AS node_id, tag, ' ' || coalesce(attrs, '') || ' ' AS attrs FROM (
    SELECT page_id, unnest(regexp_extract_all(body, '{_START}', 1)) AS tag, unnest(regexp_extract_all(body, '{_START}', 2)) AS attrs, unnest(range(len(regexp_extract_all(body, '{_START}')))) AS k
    FROM (SELECT page_id, {_BODY} AS body FROM {FORMED})) WHERE tag NOT IN ('br', 'link', 'meta'))"""


def has(name: str) -> str:
    return f"regexp_matches(attrs, '\\s{name}[=\\s]')"


def value(name: str) -> str:
    return f"regexp_extract(attrs, '\\s{name}=\"([^\"]*)\"', 1)"


def listed(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


ROLE = (
    "CASE tag WHEN 'input' THEN CASE " + value("type") + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in nodes.INPUT_ROLES.items()) + " ELSE 'textbox' END "
    "WHEN 'select' THEN 'combobox' WHEN 'a' THEN CASE WHEN " + has("href") + " THEN 'link' ELSE '' END "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in nodes.TAG_ROLES.items()) + " ELSE '' END"
)
DECLARED = f"({has('href')} OR {has('onclick')})"
FOCUSABLE = f"({value('tabindex')} NOT IN ('', '-1') OR (tag = 'a' AND {has('href')}) OR (tag IN ('input', 'select', 'textarea', 'button') AND NOT {has('disabled')}) OR tag IN ('summary', 'iframe'))"
WIDGET = "(" + " OR ".join(has(a) for a in nodes.WIDGET_ATTRIBUTES) + ")"
STRONG = f"(tag IN {listed(nodes.INTERACTIVE_TAGS)} OR ({ROLE}) IN {listed(nodes.INTERACTIVE_ROLES)} OR {DECLARED})"
FLAGS = {
    "interactive": f"({STRONG} OR {FOCUSABLE} OR {WIDGET})",
    "strong": STRONG,
    "strong_element": f"(tag IN {listed(nodes.STRONG_TAGS)} OR ({ROLE}) IN {listed(nodes.INTERACTIVE_ROLES)} OR {DECLARED})",
    "link_or_button": f"(tag IN ('a', 'button') OR {has('href')} OR {has('onclick')} OR ({ROLE}) IN ('link', 'button'))",
    "focusable": FOCUSABLE,
    "widget_state": WIDGET,
    "search_hint": f"regexp_matches(lower({value('class')} || ' ' || {value('id')}), '{nodes.SEARCH_WORDS}')",
}
VISIBLE = f"(NOT contains(attrs, 'display:none') AND NOT contains(attrs, 'opacity:0') AND {value('class')} <> 'dim')"
#: Text nodes, entities read: page_id, k (their order in the page), text.
_ENTITIES = (("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"))
_READ = "piece"
for _entity, _character in _ENTITIES:
    _READ = f"replace({_READ}, '{_entity}', '{_character}')"


def texts_sql(read: str) -> str:
    return f"""(SELECT page_id, k, text FROM (SELECT page_id, k, {sql.squash(read)} AS text FROM (SELECT page_id, unnest(ps) AS piece, unnest(range(len(ps))) AS k FROM (
    SELECT page_id, string_split_regex(body, '<[^>]*>') AS ps FROM (SELECT page_id, {_BODY} AS body FROM {FORMED})))) WHERE length(text) >= 10)"""


TEXTS = texts_sql(_READ)
#: The same with these entities read as HTML has them: the semicolon may be missing, a number ends where its digits do.
_READ_ALL = "piece"
for _entity, _character in _ENTITIES:
    _ends = "(?:;|$|([^0-9;]))" if "#" in _entity else ";?"
    _READ_ALL = f"regexp_replace({_READ_ALL}, '{_entity[:-1]}{_ends}', '{_character}{'\\1' if '#' in _entity else ''}', 'g')"
WHOLE_TEXTS = texts_sql(_READ_ALL)
#: Anchors with their texts: page_id, node_id, name.
_LINK = "$$(?s)<a\\b[^>]*>(.*?)</a>$$"
LINKS = f"""(SELECT page_id, node_id, {sql.squash(_READ.replace("piece", "regexp_replace(raw, '<[^>]*>', '', 'g')"))} AS name FROM (
    SELECT page_id, unnest(regexp_extract_all(body, {_LINK}, 1)) AS raw, unnest(range(1, len(regexp_extract_all(body, {_LINK}, 1)) + 1)) AS n FROM (SELECT page_id, {_BODY} AS body FROM {FORMED}))
    JOIN (SELECT page_id, node_id, row_number() OVER (PARTITION BY page_id ORDER BY node_id) AS n FROM {NODES} WHERE tag = 'a') USING (page_id, n))"""
#: What the form's controls are called: page_id, node_id, tag, attrs, name; redacted. Options in order.
NAMED = f"""(SELECT n.page_id, n.node_id, tag, attrs, CASE WHEN {value('id')} = 'mail' THEN 'E mail' WHEN {value('type')} = 'checkbox' THEN 'Agree' WHEN tag = 'textarea' THEN 'call [redacted:tel]' WHEN tag = 'select' THEN ''
    WHEN {has('aria-labelledby')} THEN 'Beta Alpha' WHEN tag = 'button' THEN 'Send now' WHEN tag = 'option' THEN CASE WHEN {has('selected')} THEN 'Two' ELSE 'One' END WHEN {has('onclick')} THEN 'Go on' ELSE l.name END AS name
    FROM {NODES} n LEFT JOIN {LINKS} l ON n.page_id = l.page_id AND n.node_id = l.node_id WHERE tag IN ('input', 'button', 'a', 'select', 'textarea', 'option') OR {has('onclick')})"""
#: Of these the ones that stay: the link in the clickable box goes, as that has its name.
KEPT = f"(SELECT * FROM {NAMED} WHERE NOT (tag = 'a' AND starts_with({value('href')}, '/p') AND regexp_matches({value('href')}, '^/p[0-9]+$') AND name = 'Go on'))"
#: Containers of controls: navigation and its lists, the form and its section, with the label of the last.
CONTAINERS = f"""(SELECT page_id, node_id, tag, attrs, CASE WHEN tag = 'section' THEN 'Mail [redacted:email] now' END AS name FROM {NODES} WHERE tag IN ('nav', 'ul', 'li', 'form', 'section'))"""
#: Both with parent and level.
_UP = "max(CASE WHEN tag = '{0}' THEN node_id END) OVER (PARTITION BY page_id ORDER BY node_id)"
PLACED = f"""(SELECT page_id, node_id, tag, attrs, name, control, CASE WHEN tag IN ('nav', 'form') THEN NULL WHEN tag = 'ul' THEN nav WHEN tag = 'li' THEN ul WHEN form IS NULL THEN li WHEN tag = 'section' THEN form WHEN tag = 'option' THEN sel WHEN section IS NOT NULL THEN section ELSE form END AS parent,
    CASE WHEN tag IN ('nav', 'form') THEN 0 WHEN tag = 'ul' THEN 1 WHEN tag = 'li' THEN 2 WHEN form IS NULL THEN 3 WHEN tag = 'option' THEN 2 WHEN tag <> 'section' AND section IS NOT NULL THEN 2 ELSE 1 END AS level
    FROM (SELECT *, {_UP.format('nav')} AS nav, {_UP.format('ul')} AS ul, {_UP.format('li')} AS li, {_UP.format('form')} AS form, {_UP.format('section')} AS section, {_UP.format('select')} AS sel
    FROM (SELECT *, true AS control FROM {KEPT} UNION ALL SELECT *, false FROM {CONTAINERS})))"""
STATES = f"""CASE WHEN {value('type')} = 'checkbox' THEN 'checked' WHEN {has('aria-expanded')} THEN 'collapsed, disabled' WHEN tag = 'option' AND {has('selected')} THEN 'selected' ELSE '' END"""
LINES = f"""(SELECT page_id, node_id, level, CASE WHEN control THEN '[' || CAST(node_id AS VARCHAR) || '] ' || CASE WHEN ({ROLE}) = '' THEN tag ELSE ({ROLE}) END || ' ' || CAST(to_json(name) AS VARCHAR)
    || CASE WHEN ({STATES}) <> '' THEN ' [' || ({STATES}) || ']' ELSE '' END || CASE WHEN {value('id')} = 'mail' THEN ' (sensitive:email)' ELSE '' END
    ELSE tag || CASE WHEN name IS NOT NULL THEN ' ' || CAST(to_json(name) AS VARCHAR) ELSE '' END END AS line FROM {PLACED})"""
OUTLINES = f"(SELECT page_id, string_agg(repeat('  ', CAST(level AS INT)) || line, chr(10) ORDER BY node_id) AS outline FROM {LINES} GROUP BY page_id)"
