"""Queries of detection, redaction, the vault, egress and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detectors import DETECTORS, detector
from ..functions.materialize import materialized
from ..operators import egress, identify, redact, score, vault
from ..sources.tables import src_pages, src_text, table
from . import sql
from .derived import derived, derived_sql
from .markup import FORMED, with_forms
from .registry import QUERIES, ORACLES, query

SPANS = 'CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", m AS text, kind'
IDENTITIES = derived_sql("identity_texts")


def long_places(df: DataFrame) -> DataFrame:
    return df.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})


def _detect(kind: str) -> None:
    """One query per detector, over texts derived from customers; e-mail and card over documents as well."""
    name = f"detect_{ {'cc-number': 'card', 'tel': 'phone'}.get(kind, kind) }"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return long_places(identify.detect(derived(spark, sf_dir, "identity_texts"), "id", "text", kind))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT id, {SPANS} FROM {sql.detected(IDENTITIES, 'id', 'text', kind)}"
    if kind in ("email", "cc-number"):

        def on_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
            return long_places(identify.detect(src_text(spark, sf_dir, "documents", "doc_id"), "doc_id", "text", kind))

        QUERIES[f"{name}_documents"] = on_documents
        ORACLES[f"{name}_documents"] = f"SELECT doc_id, {SPANS} FROM {sql.detected('documents', 'doc_id', 'text', kind)}"


for _kind in sql.PATTERNS:
    _detect(_kind)


@query(f"SELECT id, number FROM {derived_sql('aadhaar_numbers')} WHERE {sql.verhoeff('number')}")
def checksum_verhoeff(spark, sf_dir):
    return identify.checksum_verhoeff(derived(spark, sf_dir, "aadhaar_numbers"), "number")


@query(f"SELECT id, line, number FROM {derived_sql('card_numbers')} WHERE {sql.luhn('number')}")
def checksum_luhn(spark, sf_dir):
    return identify.checksum_luhn(derived(spark, sf_dir, "card_numbers"), "number")


@query(f"SELECT page_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\", m AS text FROM {sql.matches(FORMED, 'page_id', 'html', sql.EMAIL)}")
def span_positions(spark, sf_dir):
    pages = with_forms(spark, sf_dir)
    pattern = detector("email").pattern
    spans = identify.span_positions(pages.where(F.col("html").rlike(pattern)), "html", pattern).select("page_id", F.explode("spans").alias("s"))
    return long_places(spans.select("page_id", "s.start", "s.end", "s.text"))


@query(f"{sql.found_ctes(IDENTITIES, 'id', 'text')} SELECT id, {SPANS} FROM found")
def find_identifiers(spark, sf_dir):
    return long_places(identify.find_identifiers(derived(spark, sf_dir, "identity_texts"), "id", "text"))


@query(f"{sql.found_ctes('documents', 'doc_id', 'text')} SELECT doc_id, {SPANS} FROM found")
def find_identifiers_documents(spark, sf_dir):
    return long_places(identify.find_identifiers(src_text(spark, sf_dir, "documents", "doc_id"), "doc_id", "text"))


@query(f"{sql.found_ctes(IDENTITIES, 'id', 'text')} SELECT id, string_agg(kind, ',' ORDER BY s) AS kinds FROM found GROUP BY id")
def identifier_kinds(spark, sf_dir):
    rows = identify.identifier_kinds(identify.with_spans(derived(spark, sf_dir, "identity_texts"), "text"))
    # An outer explode, as a filter on the spans themselves would be moved to where the table is read and work them out once more there.
    rows = rows.select("id", F.explode_outer(F.array(F.array_join("kinds", ","))).alias("kinds"))
    return rows.where("kinds <> ''")


@query(
    f"""WITH c AS (SELECT id, s, e, m, kind FROM {sql.detected(IDENTITIES, 'id', 'text', 'pan')} UNION ALL SELECT id, s, e, m, kind FROM {sql.detected(IDENTITIES, 'id', 'text', 'gstin')})
    SELECT id, {SPANS} FROM c AS a WHERE NOT EXISTS (SELECT 1 FROM c AS b WHERE a.id = b.id AND b.s <= a.s AND a.e <= b.e AND b.e - b.s > a.e - a.s)"""
)
def resolve_overlaps(spark, sf_dir):
    """The tax number inside a longer one is not reported."""
    two = [d for d in DETECTORS if d.kind in ("pan", "gstin")]
    return long_places(identify.find_identifiers(derived(spark, sf_dir, "identity_texts"), "id", "text", two))


@query(
    f"""{sql.found_ctes('documents', 'doc_id', 'text')}
    SELECT lang, kind, count(*) AS findings, count(DISTINCT doc_id) AS with_findings FROM found JOIN documents USING (doc_id) GROUP BY lang, kind"""
)
def kind_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return identify.kind_counts(identify.find_identifiers(docs, ["doc_id", "lang"], "text"), ["lang"], "doc_id")


@query(f"{sql.redacted_ctes(IDENTITIES, 'id', 'text')} SELECT id, out AS text, kinds FROM redacted")
def redact_drop(spark, sf_dir):
    out = redact.redact_drop(derived(spark, sf_dir, "identity_texts"), "id", "text")
    return out.withColumn("kinds", F.array_join("kinds", ","))


@query(f"{sql.redacted_ctes('documents', 'doc_id', 'text')} SELECT doc_id, md5(out) AS text_md5, kinds FROM redacted")
def redact_drop_documents(spark, sf_dir):
    out = redact.redact_drop(src_text(spark, sf_dir, "documents", "doc_id"), "doc_id", "text")
    return out.select("doc_id", F.md5("text").alias("text_md5"), F.array_join("kinds", ",").alias("kinds"))


@query(f"{sql.found_ctes(IDENTITIES, 'id', 'text')} SELECT (SELECT count(*) FROM {IDENTITIES}) AS rows, (SELECT count(*) FROM found WHERE id % 3 = 0) AS leaks")
def leak_check(spark, sf_dir):
    """Findings in what should be redacted: every third text was forgotten, the others hold none."""
    texts = derived(spark, sf_dir, "identity_texts")
    out = redact.redact_drop(texts.where("id % 3 <> 0"), "id", "text").select("id", "text").union(texts.where("id % 3 = 0").select("id", "text"))
    leaks = identify.leak_check(out, "id", "text").groupBy("id").agg(F.count("*").alias("n"))
    return out.join(leaks.hint("merge"), "id", "left").agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("leaks"))


_TITLED = "(SELECT page_id, url || '?user=u' || CAST(page_id AS VARCHAR) || '@example.com' AS url FROM pages)"


@query(f"SELECT page_id, regexp_replace(url, '{sql.EMAIL}', '[redacted:email]', 'g') AS url FROM {_TITLED}")
def redact_header(spark, sf_dir):
    pages = src_pages(spark, sf_dir).select("page_id", F.concat("url", F.lit("?user=u"), F.col("page_id").cast("string"), F.lit("@example.com")).alias("url"), F.lit("").alias("title"))
    return redact.redact_header(pages).select("page_id", "url")


# --- vault

CHATS = derived_sql("chats")
NUMBERED = f"""{sql.found_ctes(CHATS, 'conv_id, turn', 'text')},
    firsts AS (SELECT conv_id, kind, m AS value, min(turn * 1000000 + s) AS first_at FROM found GROUP BY conv_id, kind, m),
    vault AS (SELECT conv_id, kind, value, row_number() OVER (PARTITION BY conv_id ORDER BY first_at, kind, value) AS n FROM firsts)"""


@query(f"{NUMBERED} SELECT conv_id, kind, value, n, kind || '#' || CAST(n AS VARCHAR) AS handle FROM vault")
def handle_numbering(spark, sf_dir):
    found = identify.find_identifiers(derived(spark, sf_dir, "chats"), ["conv_id", "turn"], "text")
    return vault.handle_numbering(found, "conv_id", ["turn", "start"])


_VAULTED = """firsts AS (SELECT conv_id, kind, m AS value, min(turn * 1000000 + s) AS first_at FROM found GROUP BY conv_id, kind, m),
    vault AS (SELECT conv_id, kind, value, row_number() OVER (PARTITION BY conv_id ORDER BY first_at, kind, value) AS n FROM firsts),
    marked AS (SELECT f.conv_id, f.turn, f.s, f.e, f.kind, v.n FROM found f JOIN vault v ON f.conv_id = v.conv_id AND f.kind = v.kind AND f.m = v.value)"""


@query(
    f"""{sql.redacted_ctes(CHATS, 'conv_id, turn', 'text', "'[redacted:' || kind || '#s' || CAST(n AS VARCHAR) || ']'", _VAULTED)}
    SELECT conv_id, turn, c.role, out AS text FROM redacted JOIN {CHATS} AS c USING (conv_id, turn)"""
)
def redact_conversations(spark, sf_dir):
    return vault.redact_conversations(derived(spark, sf_dir, "chats"))


@query(
    f"""{sql.redacted_ctes(CHATS, 'conv_id, turn', 'text', "'[redacted:' || kind || '#' || CAST(n AS VARCHAR) || ']'", _VAULTED)}
    SELECT conv_id, turn, out AS text, kinds FROM redacted"""
)
def redact_handles(spark, sf_dir):
    """Chats redacted with a vault that was minted before."""
    chats = derived(spark, sf_dir, "chats")
    found = identify.find_identifiers(chats, ["conv_id", "turn"], "text")
    known = vault.handle_numbering(found, "conv_id", ["turn", "start"]).withColumnRenamed("conv_id", "scope")
    return redact.redact_handles(chats, ["conv_id", "turn"], "text", known, "conv_id").withColumn("kinds", F.array_join("kinds", ","))


def _two_mints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early turns minted in generation 1, the others in generation 2."""
    chats = derived(spark, sf_dir, "chats")
    empty = spark.createDataFrame([], vault.SCHEMA)
    found = lambda rows: identify.find_identifiers(rows, ["conv_id", "turn"], "text")
    first = vault.vault_mint(found(chats.where("turn < 2")), empty, "conv_id", ["turn", "start"], gen=1)
    return vault.vault_mint(found(chats.where("turn >= 2")), first, "conv_id", ["turn", "start"], gen=2)


_MINTED = f"""{sql.found_ctes(CHATS, 'conv_id, turn', 'text')},
    firsts AS (SELECT conv_id, kind, m AS value, min(turn * 1000000 + s) AS first_at, max(CASE WHEN turn < 2 THEN 1 ELSE 2 END) AS seen_gen FROM found GROUP BY conv_id, kind, m),
    minted AS (SELECT CAST(conv_id AS VARCHAR) AS scope, kind, value, row_number() OVER (PARTITION BY conv_id ORDER BY first_at, kind, value) AS n, CAST(seen_gen AS BIGINT) AS seen_gen FROM firsts)"""


@query(f"{_MINTED} SELECT scope, kind || '#' || CAST(n AS VARCHAR) AS handle, kind, value, n, seen_gen FROM minted")
def vault_mint(spark, sf_dir):
    return _two_mints(spark, sf_dir)


@query(f"{_MINTED} SELECT scope, kind || '#' || CAST(n AS VARCHAR) AS handle, kind, value, n, seen_gen FROM minted WHERE 3 - seen_gen <= 1")
def vault_expiry(spark, sf_dir):
    return vault.vault_expiry(_two_mints(spark, sf_dir), gen=3)


@query(f"{_MINTED} SELECT scope, 'email#1' AS handle, kind, value, n, seen_gen FROM minted WHERE kind = 'email' AND n = 1")
def vault_lookup(spark, sf_dir):
    wanted = derived(spark, sf_dir, "chats").select(F.col("conv_id").cast("string").alias("scope"), F.lit("email#1").alias("handle")).distinct()
    return vault.vault_lookup(wanted, _two_mints(spark, sf_dir))




@query(f"SELECT conv_id, turn, text, 'email,tel' AS kinds FROM {CHATS}")
def restore_session(spark, sf_dir):
    """Redacted chats with their handles expanded again: the same texts."""
    chats = derived(spark, sf_dir, "chats")
    found = identify.find_identifiers(chats, ["conv_id", "turn"], "text")
    known = vault.handle_numbering(found, "conv_id", ["turn", "start"], tag="s").withColumn("seen_gen", F.lit(0).cast("long")).withColumnRenamed("conv_id", "scope")
    hidden = vault.redact_conversations(chats)
    out = vault.restore_session(hidden, ["conv_id", "turn"], "text", known, scope="conv_id")
    return out.withColumn("kinds", F.array_join("kinds", ","))


@query(
    f"""{NUMBERED} SELECT v.conv_id, CASE WHEN v.conv_id % 3 = 0 THEN 'tel' ELSE 'email' END AS target, v.conv_id % 3 <> 0 AS ok, CASE WHEN v.conv_id % 3 <> 0 THEN 'to ' || v.value || '!' END AS text,
    CASE WHEN v.conv_id % 3 = 0 THEN 'email cannot go into tel' END AS error FROM vault v WHERE v.n = 1 AND v.kind = 'email'"""
)
def rehydrate(spark, sf_dir):
    """The first handle of each conversation, typed into fields of its kind and of another."""
    found = identify.find_identifiers(derived(spark, sf_dir, "chats"), ["conv_id", "turn"], "text")
    known = vault.handle_numbering(found, "conv_id", ["turn", "start"]).withColumn("seen_gen", F.lit(0).cast("long"))
    typed = known.where("n = 1 and kind = 'email'").select("conv_id", F.lit("to [redacted:email#1]!").alias("text"), F.when(F.col("conv_id") % 3 == 0, "tel").otherwise("email").alias("target"))
    out = vault.rehydrate(typed, ["conv_id", "target"], "text", "target", known.withColumnRenamed("conv_id", "scope"), gen=0, scope="conv_id")
    return out.select("conv_id", "target", "ok", "text", "error")


# --- egress

_HOSTS = ("api.example.com", "other.example.com")
_REQUESTS = derived_sql("requests")
JUDGED = f"""(SELECT request_id, host, bytes, logged, reason IS NULL AS allowed, reason, CASE WHEN reason = '{egress.FOUND}' THEN 'email' ELSE '' END AS kinds FROM (
    SELECT request_id, CASE WHEN conv_kind = 0 OR conv_kind = 4 THEN 'api.example.com' WHEN conv_kind = 1 THEN 'evil.example.net' END AS host, CAST(octet_length(CAST(body AS BLOB)) AS BIGINT) AS bytes, conv_kind <> 2 AS logged,
    CASE WHEN conv_kind = 2 THEN NULL WHEN conv_kind = 3 THEN '{egress.NO_HOST}' WHEN conv_kind = 1 THEN 'evil.example.net{egress.STRANGER}' WHEN body = '' THEN NULL
        WHEN NOT starts_with(body, '{{') THEN '{egress.NOT_JSON}' WHEN contains(body, '@') THEN '{egress.FOUND}' END AS reason
    FROM (SELECT *, CASE WHEN starts_with(url, 'data:') THEN 2 WHEN url = 'not a url' THEN 3 WHEN contains(url, 'evil') THEN 1 ELSE 0 END AS conv_kind FROM {_REQUESTS})))"""


def hosts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(h,) for h in _HOSTS], "host string")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "requests").withColumn("at", F.lit("2026-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("request_id").cast("decimal(18,6)")))


@query(f"SELECT request_id, host, bytes, allowed, logged, reason, kinds FROM {JUDGED}")
def egress_verdict(spark, sf_dir):
    out = egress.egress_verdict(requests(spark, sf_dir), hosts(spark))
    return out.select("request_id", "host", "bytes", "allowed", "logged", "reason", F.coalesce(F.array_join("kinds", ","), F.lit("")).alias("kinds"))


@query(f"SELECT coalesce(host, 'not a url') AS host, bytes, allowed, reason, kinds, count(*) AS n FROM {JUDGED} WHERE logged GROUP BY ALL")
def egress_log(spark, sf_dir):
    log = egress.egress_log(requests(spark, sf_dir), hosts(spark)).withColumn("kinds", F.coalesce(F.array_join("kinds", ","), F.lit("")))
    return log.groupBy("host", "bytes", "allowed", "reason", "kinds").agg(F.count("*").alias("n"))


_SIZE = "CASE WHEN bytes < 1024 THEN CAST(bytes AS VARCHAR) || ' B' WHEN bytes < 1048576 THEN CAST(CAST(round(bytes / 1024) AS BIGINT) AS VARCHAR) || ' KB' ELSE printf('%.1f MB', bytes / 1048576) END"


@query(f"SELECT *, {_SIZE} AS size FROM (SELECT coalesce(host, 'not a url') AS host, count(*) FILTER (allowed) AS sent, count(*) FILTER (NOT allowed) AS refused, CAST(coalesce(sum(bytes) FILTER (allowed), 0) AS BIGINT) AS bytes FROM {JUDGED} WHERE logged GROUP BY 1)")
def egress_summary(spark, sf_dir):
    return egress.egress_summary(egress.egress_log(requests(spark, sf_dir), hosts(spark)), by="host")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 200")
def log_tail(spark, sf_dir):
    return egress.log_tail(table(spark, sf_dir, "events").select("event_id", "event_type"), 200, ("event_id",))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) IN ('site0.example', 'site1.example.com', 'www.example.com') AS host_allowed FROM pages")
def allowed_hosts(spark, sf_dir):
    known = spark.createDataFrame([("site0.example",), ("site1.example.com",), ("www.example.com",)], "host string")
    pages = src_pages(spark, sf_dir).select("page_id", F.expr("try_parse_url(url, 'HOST')").alias("host"))
    return egress.allowed_hosts(pages, known).select("page_id", "host", "host_allowed")


@query(f"SELECT request_id, pos, value FROM (SELECT request_id, unnest([regexp_extract(body, '\"role\": \"([^\"]*)\"', 1)] || CASE WHEN contains(body, '@') THEN [regexp_extract(body, '\"note\": \"([^\"]*)\"', 1)] ELSE [] END) AS value, unnest(range(CASE WHEN contains(body, '@') THEN 2 ELSE 1 END)) AS pos FROM {_REQUESTS} WHERE starts_with(body, '{{'))")
def json_strings(spark, sf_dir):
    rows = requests(spark, sf_dir).where(F.col("body").startswith("{"))
    return egress.json_strings(rows).withColumn("pos", F.col("pos").cast("long"))


@query(
    f"""SELECT request_id, starts_with(body, '{{') AND NOT contains(body, '@') AS ok,
    CASE WHEN NOT starts_with(body, '{{') THEN '{egress.NOT_JSON}' WHEN contains(body, '@') THEN '{egress.FOUND}' END AS reason FROM {_REQUESTS}"""
)
def inspect_body(spark, sf_dir):
    return egress.inspect_body(requests(spark, sf_dir)).select("request_id", "ok", "reason")


@query(f"{sql.found_ctes(IDENTITIES, 'id', 'text')} SELECT id AS request_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM found GROUP BY id")
def body_kinds(spark, sf_dir):
    found = identify.find_identifiers(derived(spark, sf_dir, "identity_texts"), "id", "text").withColumnRenamed("id", "request_id")
    return egress.body_kinds(found).withColumn("kinds", F.array_join("kinds", ","))


# --- scores

#: Truth: mails and numbers that the text was made of; decoys: the order stamps at its end.
_TRUTH = f"""(SELECT id, CAST(strpos(text, 'user.') - 1 AS BIGINT) AS s, CAST(strpos(text, ' uid ') - 1 AS BIGINT) AS e, 'email' AS kind, CAST(NULL AS VARCHAR) AS decoy FROM {IDENTITIES}
    UNION ALL SELECT id, CAST(strpos(text, ' uid ') + 4 AS BIGINT), CAST(strpos(text, ' card ') - 1 AS BIGINT), 'aadhaar', NULL FROM {IDENTITIES}
    UNION ALL SELECT id, CAST(strpos(text, ' order ') + 6 AS BIGINT), CAST(length(text) AS BIGINT), NULL, 'order stamp' FROM {IDENTITIES})"""


def _truth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = derived(spark, sf_dir, "identity_texts")
    at = lambda word, more: F.locate(word, F.col("text")) + more
    none = F.lit(None).cast("string")
    places = [("user.", -1, " uid ", -1, F.lit("email"), none), (" uid ", 4, " card ", -1, F.lit("aadhaar"), none), (" order ", 6, None, 0, none, F.lit("order stamp"))]
    ends = lambda word, more: at(word, more) if word else F.length("text")
    spans = F.array(*[F.struct(at(w, m).alias("start"), ends(v, n).alias("end"), kind.alias("kind"), decoy.alias("decoy_reason")) for w, m, v, n, kind, decoy in places])
    truth = texts.select("id", F.explode(spans).alias("t")).select("id", "t.*")
    return identify.find_identifiers(texts, "id", "text"), truth


_COVERED = f"{sql.found_ctes(IDENTITIES, 'id', 'text')}, judged AS (SELECT t.*, EXISTS (SELECT 1 FROM found f WHERE f.id = t.id AND f.s < t.e AND t.s < f.e) AS covered FROM {_TRUTH} AS t)"


_RATIO = "CASE WHEN {1} > 0 THEN {0} / {1} END"
_SHOWN = f"""shown AS (SELECT f.id, f.s, f.e, min(f.kind) AS kind, bool_or(t.id IS NOT NULL) AS good FROM found f LEFT JOIN (SELECT * FROM {_TRUTH} WHERE decoy IS NULL) t ON f.id = t.id AND f.s < t.e AND t.s < f.e GROUP BY f.id, f.s, f.e),
    facts AS (SELECT kind, decoy IS NULL AS real, covered, CAST(NULL AS BOOLEAN) AS good FROM judged UNION ALL SELECT kind, NULL, NULL, good FROM shown),
    counts AS (SELECT kind, grouping(kind) = 1 AS total, count(*) FILTER (real) AS identifiers, count(*) FILTER (real AND covered) AS hit, count(*) FILTER (NOT real) AS decoys, count(*) FILTER (NOT real AND covered) AS decoys_covered,
        count(good) AS shown, count(*) FILTER (good) AS good FROM facts GROUP BY GROUPING SETS ((kind), ())),
    rated AS (SELECT *, {_RATIO.format('hit', 'identifiers')} AS recall, {_RATIO.format('hit', '(hit + decoys_covered)')} AS precision_decoy, {_RATIO.format('good', 'shown')} AS precision_span FROM counts)"""


@query(f"{_COVERED}, {_SHOWN} SELECT identifiers, hit, recall, decoys, decoys_covered, precision_decoy, precision_span FROM rated WHERE total")
def score_detection(spark, sf_dir):
    return score.score_detection(*_truth(spark, sf_dir), on=("id",))


@query(f'{_COVERED}, {_SHOWN} SELECT kind, total, identifiers, hit, decoys, decoys_covered, shown, good AS "right", recall, precision_decoy, precision_span FROM rated')
def score_table(spark, sf_dir):
    return score.score_table(*_truth(spark, sf_dir), on=("id",))


@query(f"{_COVERED} SELECT id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\", kind, CASE WHEN decoy IS NULL THEN 'missed' ELSE 'decoy covered' END AS error FROM judged WHERE (decoy IS NULL) <> covered")
def score_errors(spark, sf_dir):
    return long_places(score.score_errors(*_truth(spark, sf_dir), on=("id",)).drop("decoy_reason"))


@query(f"{_COVERED} SELECT count(*) FILTER (decoy IS NOT NULL AND covered) = 0 AS passed FROM judged")
def quality_gate(spark, sf_dir):
    return score.quality_gate(*_truth(spark, sf_dir), on=("id",))


@query(f"{sql.found_ctes(IDENTITIES, 'id', 'text')} SELECT t.id, t.s AS start, t.e AS \"end\", CAST(f.s AS BIGINT) AS b_start, CAST(f.e AS BIGINT) AS b_end, f.kind AS b_kind FROM {_TRUTH} AS t JOIN found f ON f.id = t.id AND f.s < t.e AND t.s < f.e")
def spans_intersect(spark, sf_dir):
    found, truth = _truth(spark, sf_dir)
    out = score.spans_intersect(truth.select("id", "start", "end"), materialized(found.select("id", "start", "end", "kind")), ["id"])
    return out.select("id", *[F.col(c).cast("long") for c in ("start", "end", "b_start", "b_end")], "b_kind")
