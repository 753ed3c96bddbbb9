"""Queries of boxes, field classification and chat logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.materialize import materialized
from ..operators import boxes, chat, fields, identify, nodes, score
from ..operators.vault import expected_kind_check as check
from ..sources.tables import spread, table
from ..streaming.streams import reply_match as match_replies
from . import sql
from .derived import CARD, MAIL, PAN, PHONE, PHONE_TEXT, derived, derived_sql, pieces, pieces_sql
from .registry import query

_BOXES, _IMAGES = derived_sql("boxes"), derived_sql("images")
_MASKED = f"""(SELECT image_id, CAST(greatest(0, floor(x * dpr - 3)) AS BIGINT) AS x0, CAST(greatest(0, floor(y * dpr - 3)) AS BIGINT) AS y0,
    CAST(least(width, ceil((x + w) * dpr + 3)) AS BIGINT) AS x1, CAST(least(height, ceil((y + h) * dpr + 3)) AS BIGINT) AS y1 FROM {_BOXES} JOIN {_IMAGES} USING (image_id))"""


@query(f"SELECT * FROM {_MASKED} WHERE x1 > x0 AND y1 > y0")
def mask_boxes(spark, sf_dir):
    return boxes.mask_boxes(derived(spark, sf_dir, "boxes"), derived(spark, sf_dir, "images").withColumn("factor", F.col("dpr")))


@query(f"SELECT image_id, CASE WHEN w > 800 THEN 800.0 / w ELSE 1.0 END AS scale, dpr * CASE WHEN w > 800 THEN 800.0 / w ELSE 1.0 END AS factor FROM (SELECT image_id, dpr, 640 + image_id % 400 AS w FROM {_IMAGES})")
def capture_scale(spark, sf_dir):
    images = derived(spark, sf_dir, "images").withColumn("width", 640 + F.col("image_id") % 400)
    return boxes.capture_scale(images, 800).select("image_id", "scale", "factor")


_PAIRS = f"(SELECT a.image_id, a.box_id AS a_id, b.box_id AS b_id, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS by_, b.w AS bw, b.h AS bh FROM {_BOXES} a JOIN {_BOXES} b USING (image_id) WHERE a.box_id < b.box_id)"
_BOTH = "(greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, by_ + bh) - greatest(ay, by_)))"


def _pairs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    both = materialized(derived(spark, sf_dir, "boxes").drop("score"))
    return both, both


@query(f"SELECT image_id, a_id, b_id, round({_BOTH} / (aw * ah + bw * bh - {_BOTH}), 9) AS iou FROM {_PAIRS}")
def box_iou(spark, sf_dir):
    out = boxes.box_iou(*_pairs(spark, sf_dir), ["image_id"], below="box_id")
    return out.select("image_id", F.col("box_id").alias("a_id"), F.col("b_box_id").alias("b_id"), F.round("iou", 9).alias("iou"))


@query(f"SELECT image_id, a_id, b_id, round({_BOTH} / (bw * bh), 9) AS fraction FROM {_PAIRS} WHERE ax < bx + bw AND bx < ax + aw AND ay < by_ + bh AND by_ < ay + ah")
def box_contained_fraction(spark, sf_dir):
    out = boxes.box_contained_fraction(score.boxes_intersect(*_pairs(spark, sf_dir), ["image_id"]).where("box_id < b_box_id"))
    return out.select("image_id", F.col("box_id").alias("a_id"), F.col("b_box_id").alias("b_id"), F.round("fraction", 9).alias("fraction"))


@query(f"SELECT image_id, a_id, b_id FROM {_PAIRS} WHERE ax < bx + bw AND bx < ax + aw AND ay < by_ + bh AND by_ < ay + ah")
def boxes_intersect(spark, sf_dir):
    out = score.boxes_intersect(*_pairs(spark, sf_dir), ["image_id"]).where("box_id < b_box_id")
    return out.select("image_id", F.col("box_id").alias("a_id"), F.col("b_box_id").alias("b_id"))


@query(f"SELECT image_id, box_id, x, y, w, h FROM {_BOXES} WHERE w > 0 AND h > 0 AND x + w >= -20 AND x <= 320 AND y + h >= -20 AND y <= 240")
def onscreen_regions(spark, sf_dir):
    return boxes.onscreen_regions(derived(spark, sf_dir, "boxes"), 300, 220, 20).drop("score")


@query(
    f"""SELECT image_id, i, round((((i % 20) + dx) * 16 - exp(lw) * 8) / 2, 6) AS x, round(((floor(i / 20) + dy) * 16 - exp(lh) * 8) / 2, 6) AS y, round(exp(lw) * 8, 6) AS w, round(exp(lh) * 8, 6) AS h, round(score, 9) AS score
    FROM (SELECT *, sqrt(least(1, greatest(0, cls)) * least(1, greatest(0, obj))) AS score FROM {derived_sql('anchors')}) WHERE score >= 0.5"""
)
def decode_anchors(spark, sf_dir):
    heads = derived(spark, sf_dir, "anchors").withColumn("bbox", F.array("dx", "dy", "lw", "lh"))
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.lit(320).alias("columns"), F.lit(2.0).alias("ratio"))
    out = boxes.decode_anchors(heads, images)
    return out.select("image_id", "i", *[F.round(c, 6).alias(c) for c in ("x", "y", "w", "h")], F.round("score", 9).alias("score"))


_CROSS = "(greatest(0, least(b.x + b.w, k.x + k.w) - greatest(b.x, k.x)) * greatest(0, least(b.y + b.h, k.y + k.h) - greatest(b.y, k.y)))"


@query(
    f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, x, y, box_id) AS n FROM {_BOXES}),
    s AS (SELECT image_id, n, [n] AS kept FROM b WHERE n = 1 UNION ALL SELECT b.image_id, b.n, CASE WHEN EXISTS (SELECT 1 FROM b k WHERE k.image_id = b.image_id AND list_contains(s.kept, k.n) AND {_CROSS} / (b.w * b.h + k.w * k.h - {_CROSS}) > 0.3) THEN s.kept ELSE list_append(s.kept, b.n) END
        FROM s JOIN b ON b.image_id = s.image_id AND b.n = s.n + 1)
    SELECT image_id, box_id, x, y, w, h, score FROM b SEMI JOIN (SELECT image_id, unnest(max_by(kept, n)) AS n FROM s GROUP BY image_id) USING (image_id, n)"""
)
def nms(spark, sf_dir):
    return boxes.nms(derived(spark, sf_dir, "boxes").withColumn("box_id", F.col("box_id")))


@query(
    f"""SELECT CAST(page_id AS BIGINT) AS page_id, CAST(count(box_id) AS BIGINT) AS masked, CASE count(box_id) WHEN 0 THEN 'nothing to withhold' WHEN 1 THEN '1 region withheld' ELSE CAST(count(box_id) AS VARCHAR) || ' regions withheld' END AS summary
    FROM pages LEFT JOIN {_BOXES} b ON b.image_id = page_id GROUP BY page_id"""
)
def masked_receipt(spark, sf_dir):
    return boxes.masked_receipt(derived(spark, sf_dir, "boxes").withColumnRenamed("image_id", "page_id"), table(spark, sf_dir, "pages"))


@query(f"SELECT source, count(*) AS regions, round(sum(w * h), 3) AS area FROM (SELECT 'dom' AS source, w, h FROM {_BOXES} WHERE box_id = 1 UNION ALL SELECT 'regex', w, h FROM {_BOXES} WHERE box_id = 2 UNION ALL SELECT 'vision', w, h FROM {_BOXES} WHERE score >= 0.5) GROUP BY source")
def union_regions(spark, sf_dir):
    own = derived(spark, sf_dir, "boxes")
    out = boxes.union_regions(dom=own.where("box_id = 1").drop("score"), regex=own.where("box_id = 2").drop("score"), vision=own.where("score >= 0.5"))
    return out.groupBy("source").agg(F.count("*").alias("regions"), F.round(F.sum(F.col("w") * F.col("h")), 3).alias("area"))


@query(f"SELECT image_id AS page_id, box_id, 'r' || CAST(row_number() OVER (PARTITION BY image_id ORDER BY y, x, box_id) AS VARCHAR) AS id FROM {_BOXES}")
def redaction_manifest(spark, sf_dir):
    regions = derived(spark, sf_dir, "boxes").withColumnRenamed("image_id", "page_id")
    return boxes.redaction_manifest(regions, order=("y", "x", "box_id")).select("page_id", "box_id", "id")


@query(
    f"""WITH c AS (SELECT image_id AS page_id, box_id AS node_id, x, y, w, h, x + w / 2 AS cx, y + h / 2 AS cy FROM {_BOXES}),
    t AS (SELECT c.page_id, c.node_id, max(o.node_id) AS top FROM c JOIN c o ON c.page_id = o.page_id AND c.cx BETWEEN o.x AND o.x + o.w AND c.cy BETWEEN o.y AND o.y + o.h WHERE c.cx BETWEEN 0 AND 300 AND c.cy BETWEEN 0 AND 200 GROUP BY c.page_id, c.node_id)
    SELECT page_id, node_id, x, y, w, h FROM c ANTI JOIN (SELECT * FROM t WHERE top <> node_id AND NOT (top % 2 = 0 AND top - 1 = node_id)) USING (page_id, node_id)"""
)
def occlusion(spark, sf_dir):
    own = derived(spark, sf_dir, "boxes").select(F.col("image_id").alias("page_id"), F.col("box_id").cast("int").alias("node_id"), "x", "y", "w", "h")
    own = materialized(own.withColumn("last", F.when(F.col("node_id") % 2 == 1, F.col("node_id") + 1).otherwise(F.col("node_id"))))
    out = boxes.occlusion(own, own.withColumn("paint_order", F.col("node_id")), 300, 200).drop("last")
    return out.withColumn("node_id", F.col("node_id").cast("long"))


# --- fields

_FIELDS = derived_sql("field_rows")
_WORDS = r"regexp_replace(regexp_replace(label, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_.\-]+', ' ', 'g')"
_LABEL = "CASE " + " ".join(f"WHEN regexp_matches(words, '(?i)\\b(?:{pattern})\\b') THEN '{kind}'" for kind, pattern in fields.LABEL_WORDS) + " END"
_AUTO = "CASE " + " ".join(f"WHEN token = '{token}' THEN '{kind}'" for token, kind in fields.AUTOCOMPLETE.items()) + " END"
_TYPE = "CASE WHEN tag = 'input' AND lower(type) IN ('password', 'email', 'tel') THEN lower(type) END"


@query(f"SELECT id, label, {_WORDS} AS words FROM {_FIELDS}")
def split_identifier(spark, sf_dir):
    return fields.split_identifier(derived(spark, sf_dir, "field_rows"), "label").select("id", "label", "words")


@query(f"SELECT id, {_TYPE} AS kind FROM {_FIELDS}")
def classify_type(spark, sf_dir):
    return fields.classify_type(derived(spark, sf_dir, "field_rows")).select("id", "kind")


_LAST_TOKEN = f"(SELECT id, max_by({_AUTO}, n) FILTER ({_AUTO} IS NOT NULL) AS kind FROM (SELECT id, unnest(string_split(autocomplete, ' ')) AS token, unnest(range(len(string_split(autocomplete, ' ')))) AS n FROM {_FIELDS}) GROUP BY id)"


@query(f"SELECT f.id, a.kind FROM {_FIELDS} f LEFT JOIN {_LAST_TOKEN} a USING (id)")
def classify_autocomplete(spark, sf_dir):
    return fields.classify_autocomplete(derived(spark, sf_dir, "field_rows")).select("id", "kind")


@query(f"SELECT id, {_LABEL} AS kind FROM (SELECT id, {_WORDS} AS words FROM {_FIELDS})")
def classify_label(spark, sf_dir):
    return fields.classify_label(derived(spark, sf_dir, "field_rows"), "label").select("id", "kind")


@query(
    f"""SELECT f.id, CASE WHEN tag = 'input' AND lower(type) IN ('checkbox', 'radio', 'submit', 'button') THEN NULL
    ELSE coalesce({_TYPE}, a.kind, CASE WHEN tag IN ('input', 'textarea') THEN {_LABEL} END) END AS sensitive
    FROM (SELECT *, {_WORDS} AS words FROM {_FIELDS}) f LEFT JOIN {_LAST_TOKEN} a USING (id)"""
)
def classify_fields(spark, sf_dir):
    rows = derived(spark, sf_dir, "field_rows").withColumnRenamed("id", "key")
    none = F.lit(None).cast("string")
    rows = rows.withColumns({"aria_label": none, "name": none, "placeholder": none, "id": F.col("label"), "label": none})
    return fields.classify_fields(rows).select(F.col("key").alias("id"), "sensitive")


#: Columns of personal data under telling and other names: name, contents, what the name suggests.
_COLUMNS = (("contact", MAIL, None), ("userPhone", PHONE_TEXT, "tel"), ("cardNumber", CARD, "cc-number"), ("taxCode", f"case when c_custkey % 3 = 0 then {PAN} end", None), ("note", f"case when c_custkey % 2 = 0 then 'call ' || {PHONE} || ' or ' || {MAIL} end", None), ("emailAddress", "c_mktsegment", "email"))


def _columns_sql() -> str:
    source = "(SELECT c_custkey AS id, " + ", ".join(f"{content} AS {name}" for name, content, _ in _COLUMNS) + " FROM customer)"
    counts = " UNION ALL ".join(f"SELECT '{name}' AS name, {rank} AS rank, '{kind}' AS kind, (SELECT count(DISTINCT id) FROM {sql.detected(source, 'id', name, kind)}) AS n" for name, _, _ in _COLUMNS for rank, kind in enumerate(sql.PATTERNS))
    values = " UNION ALL ".join(f"SELECT '{name}' AS name, {f"'{told}'" if told else 'CAST(NULL AS VARCHAR)'} AS by_name, count({name}) AS n_values FROM {source}" for name, _, told in _COLUMNS)
    best = f"(SELECT name, max(n) AS n_found, arg_max(kind, n * 100 - rank) AS kind FROM ({counts}) GROUP BY name)"
    return f"SELECT name AS \"column\", by_name, CASE WHEN n_found > 0 AND n_found >= 0.5 * n_values THEN kind END AS by_value, n_values, n_found FROM ({values}) JOIN {best} USING (name)"


@query(_columns_sql())
def classify_columns(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "customer"), "c_custkey").selectExpr(*[f"{content} as {name}" for name, content, _ in _COLUMNS])
    return fields.classify_columns(rows)


# --- chat logs

_MARKED = derived_sql("marked")


@query(
    rf"""SELECT conv_id, turn, CASE WHEN contains(text, '<|') OR contains(text, '|>') THEN regexp_replace(regexp_replace(regexp_replace(text, '(?i)<\|?channel\|?>[ \t]*(?:thought|thinking|analysis|commentary|final)?', '', 'g'),
    '(?i)<\|?(?:channel|message|start|end|return|constrain|assistant|system|user)\|?>', '', 'g'), '^\s+', '') ELSE text END AS text FROM {_MARKED}"""
)
def strip_control_tokens(spark, sf_dir):
    return chat.strip_control_tokens(derived(spark, sf_dir, "marked"), "text")


@query(
    f"""SELECT conv_id, turn, CASE WHEN n_calls > 0 THEN 'tool_calls' WHEN coalesce(raw, '') = '' THEN 'stop' WHEN raw IN ('stop', 'end_turn') THEN 'stop' WHEN raw = 'max_tokens' THEN 'length' WHEN raw = 'tool_use' THEN 'tool_calls'
    WHEN raw = 'SAFETY' THEN 'content_filter' WHEN raw = 'cancelled' THEN 'abort' ELSE 'error' END AS stop FROM {derived_sql('finishes')}"""
)
def stop_reason(spark, sf_dir):
    return chat.stop_reason(derived(spark, sf_dir, "finishes"), "raw", "n_calls").select("conv_id", "turn", "stop")


_CHUNKS = derived_sql("chunks")


@query(
    f"""SELECT request_id, CAST(idx AS BIGINT) AS idx, coalesce(max(id), 'call_' || CAST(idx AS VARCHAR)) AS id, max_by(name, seq) AS name, string_agg(args_fragment, '' ORDER BY seq) AS args
    FROM {_CHUNKS} WHERE idx IS NOT NULL GROUP BY request_id, idx"""
)
def reassemble_calls(spark, sf_dir):
    return chat.reassemble_calls(derived(spark, sf_dir, "chunks")).withColumn("idx", F.col("idx").cast("long"))


@query(
    f"""SELECT request_id, coalesce(string_agg(args_fragment, '' ORDER BY seq) FILTER (channel = 'content'), '') AS content, coalesce(string_agg(args_fragment, '' ORDER BY seq) FILTER (channel = 'reasoning'), '') AS reasoning,
    count(DISTINCT idx) AS n_calls FROM {_CHUNKS} GROUP BY request_id"""
)
def fold_reasoning(spark, sf_dir):
    return chat.fold_reasoning(derived(spark, sf_dir, "chunks"))


_PIECES = pieces_sql()


@query(
    f"""SELECT request_id, CAST(idx AS BIGINT) AS idx, coalesce(max(id), 'call_' || CAST(idx AS VARCHAR)) AS id, max_by(name, seq) AS name, coalesce(string_agg(args_fragment, '' ORDER BY seq), '') AS args
    FROM {_PIECES} WHERE idx IS NOT NULL GROUP BY request_id, idx"""
)
def reassemble_calls_whole(spark, sf_dir):
    return chat.reassemble_calls(pieces(spark, sf_dir)).withColumn("idx", F.col("idx").cast("long"))


@query(
    f"""SELECT request_id, coalesce(string_agg(args_fragment, '' ORDER BY seq) FILTER (channel = 'content'), '') AS content, coalesce(string_agg(args_fragment, '' ORDER BY seq) FILTER (channel = 'reasoning'), '') AS reasoning,
    count(DISTINCT idx) AS n_calls FROM {_PIECES} GROUP BY request_id"""
)
def fold_reasoning_whole(spark, sf_dir):
    return chat.fold_reasoning(pieces(spark, sf_dir))


@query(
    """WITH r AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS c FROM conversations WHERE role <> 'system'),
    i AS (SELECT conv_id, turn, role, text, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM r UNION ALL SELECT conv_id, turn, role, text, 0 FROM conversations WHERE role = 'system')
    SELECT conv_id, CAST(island AS BIGINT) AS island, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM i GROUP BY conv_id, island, role"""
)
def merge_same_role(spark, sf_dir):
    return chat.merge_same_role(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 1 AND turn >= 1 THEN 'tool' || CAST((turn - 1) % 3 AS VARCHAR) ELSE 'unknown' END AS name FROM conversations WHERE role = 'assistant'")
def pair_tool_results(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    results = rows.where("role = 'assistant'").select("conv_id", "turn", F.when(F.col("turn") % 2 == 1, F.concat(F.lit("c"), (F.col("turn") - 1).cast("string"))).alias("call_id"))
    turns = rows.groupBy("conv_id").agg(F.greatest(F.max("turn"), F.lit(0)).cast("long").alias("last"))
    calls = turns.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("t")).select("conv_id", F.concat(F.lit("c"), F.col("t").cast("string")).alias("call_id"), F.concat(F.lit("tool"), (F.col("t") % 3).cast("string")).alias("name"))
    return chat.pair_tool_results(results, calls).select("conv_id", "turn", "name")


@query(
    f"""SELECT id, CASE id % 10 WHEN 1 THEN 'click needs elementId' WHEN 3 THEN 'action must be one of: click, type, scroll, wait, goto, back, forward, tab, evaluate' WHEN 4 THEN 'direction must be up, down, left or right'
    WHEN 5 THEN 'tab switch needs tabId' WHEN 7 THEN 'payload must be an object' WHEN 8 THEN 'evaluate needs code' END AS error, CASE WHEN id % 10 = 2 THEN CAST(least(30, id % 60) AS DOUBLE) END AS seconds FROM {derived_sql('payloads')}"""
)
def validate_actions(spark, sf_dir):
    rows = chat.checked_actions(derived(spark, sf_dir, "payloads"), "payload")
    return rows.select("id", "error", F.col("call.seconds").alias("seconds"))


@query(
    """SELECT a.event_id, b.event_id AS reply, b.event_id IS NOT NULL AS answered FROM events a LEFT JOIN events b
    ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id <> b.event_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOURS"""
)
def reply_match(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("nonce"), F.col("event_type").alias("source"), "ts", "event_id")
    out = match_replies(events, events, "6 hours", unlike="event_id")  # an event is no reply to itself
    return out.select("event_id", F.col("reply_event_id").alias("reply"), "answered")


# --- windows over scans and actions

@query("SELECT page_id, element_id, scan_id FROM (SELECT l_orderkey AS page_id, l_partkey AS element_id, l_linenumber AS scan_id, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS newest FROM lineitem) WHERE scan_id = newest")
def latest_scan(spark, sf_dir):
    scans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_partkey").alias("element_id"), F.col("l_linenumber").alias("scan_id"))
    return nodes.latest_scan(scans)


@query(
    """WITH e AS (SELECT l_orderkey AS page_id, l_partkey AS element_id, l_linenumber AS scan_id, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS newest FROM lineitem)
    SELECT a.l_orderkey AS page_id, a.l_partkey AS element_id, a.l_linenumber AS line FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.page_id = a.l_orderkey AND e.element_id = a.l_partkey AND e.scan_id = e.newest)"""
)
def stale_action_ids(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_partkey").alias("element_id"), F.col("l_linenumber").alias("scan_id"))
    return nodes.stale_action_ids(lines.withColumnRenamed("scan_id", "line"), lines).select("page_id", "element_id", "line")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 5")
def cap_per_group(spark, sf_dir):
    return identify.cap_per_group(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id")


@query(
    """SELECT o_orderkey AS id, o_orderstatus AS expected_kind, CASE WHEN c_custkey IS NULL THEN NULL ELSE substr(c_mktsegment, 1, 1) END AS field_kind, o_orderstatus = coalesce(substr(c_mktsegment, 1, 1), '') AS ok
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 > 0"""
)
def expected_kind_check(spark, sf_dir):
    actions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("field"), F.col("o_orderstatus").alias("expected_kind"))
    targets = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("field"), F.substring("c_mktsegment", 1, 1).alias("kind"))
    return check(actions, targets, ["field"]).select("id", "expected_kind", "field_kind", "ok")
