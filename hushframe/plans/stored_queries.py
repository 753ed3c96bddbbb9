"""Queries that write and read back, and queries that run the operators on streams of the given tables."""

from __future__ import annotations

from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.materialize import materialized, new_folder
from ..operators import egress, identify, redact, vault
from ..sources import tables
from ..streaming import streams
from . import sql
from .derived import DERIVED, PIECES, derived, derived_sql, piece_rows, pieces_sql, split_columns
from .records_queries import reassemble_calls_whole
from .registry import ORACLES, query
from .text_queries import CHATS, JUDGED, NUMBERED, hosts, requests

_AT = "TIMESTAMP '2026-01-01 00:00:00' + INTERVAL (request_id) SECOND"


def _stored_requests(spark: SparkSession, sf_dir: str) -> str:
    path = new_folder(spark, "requests")
    requests(spark, sf_dir).withColumn("host", F.expr("try_parse_url(url, 'HOST')")).write.parquet(path)
    return path


@query(f"SELECT request_id, {_AT} AS at, url, CASE WHEN contains(url, '://') THEN regexp_extract(url, '://([^/?]+)', 1) END AS host, body FROM {derived_sql('requests')}")
def src_requests(spark, sf_dir):
    return tables.src_requests(spark, _stored_requests(spark, sf_dir))


@query(f"SELECT image_id, CAST(stride AS BIGINT) AS stride, CAST(i AS BIGINT) AS i, cls, obj, dx, lh FROM {derived_sql('anchors')}")
def src_detections(spark, sf_dir):
    path = new_folder(spark, "detections")
    derived(spark, sf_dir, "anchors").select("image_id", "stride", "i", "cls", "obj", F.array("dx", "dy", "lw", "lh").alias("bbox")).write.parquet(path)
    rows = tables.src_detections(spark, path)
    return rows.select("image_id", F.col("stride").cast("long").alias("stride"), F.col("i").cast("long").alias("i"), "cls", "obj", F.get("bbox", 0).alias("dx"), F.get("bbox", 3).alias("lh"))


@query(f"{sql.redacted_ctes(derived_sql('identity_texts'), 'id', 'text')} SELECT id, segment, out AS redacted FROM redacted JOIN {derived_sql('identity_texts')} AS own USING (id)")
def sink_redacted(spark, sf_dir):
    """What was written: the redacted column, and not the raw one."""
    path = new_folder(spark, "redacted")
    rows = derived(spark, sf_dir, "identity_texts")
    both = rows.select("id", "segment", "text").withColumn("redacted", redact.redacted(F.col("text")))
    tables.sink_redacted(both, path, drop=["text"], partition_by=["segment"])
    return spark.read.parquet(path)


#: Values of turns before 2 are seen in generation 1, the others in 2; a value's last turn says when it was last seen.
_SEEN = "SELECT conv_id, m AS value, kind, max(CASE WHEN turn < 2 THEN 1 ELSE 2 END) AS seen_gen FROM found GROUP BY ALL"


@query(f"{NUMBERED} SELECT CAST(conv_id AS VARCHAR) AS scope, kind, value, n, CAST(seen_gen AS BIGINT) AS seen_gen FROM vault JOIN ({_SEEN}) AS s USING (conv_id, kind, value)")
def sink_vault(spark, sf_dir):
    """The stored vault after two generations, the second appended to the first."""
    path = new_folder(spark, "vault")
    found = materialized(identify.find_identifiers(derived(spark, sf_dir, "chats"), ["conv_id", "turn"], "text"))
    for gen, part in ((1, "turn < 2"), (2, "turn >= 2")):
        store = tables.sink_vault(found.where(part), path, "conv_id", ["turn", "start"], gen, buckets=16)
    return store.vault().select("scope", "kind", "value", "n", "seen_gen")


@query(f"SELECT coalesce(host, 'not a url') AS host, bytes, allowed, reason, count(*) AS n FROM {JUDGED} WHERE logged GROUP BY ALL")
def sink_egress_log(spark, sf_dir):
    """The log of two batches, the second appended to the first."""
    path = new_folder(spark, "log")
    rows = requests(spark, sf_dir)
    for part in ("request_id % 2 = 0", "request_id % 2 = 1"):
        tables.sink_egress_log(egress.egress_log(rows.where(part), hosts(spark)), path)
    return spark.read.parquet(path).groupBy("host", "bytes", "allowed", "reason").agg(F.count("*").alias("n"))


# --- streams


@contextmanager
def state_store(spark: SparkSession):
    """The state store that stateful operators need, for the queries started within."""
    before = {k: spark.conf.get(k, None) for k in streams.STATE_STORE}
    for k, v in streams.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def conversation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As a pattern, the table may be a folder or a single file.
    return spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(f"{sf_dir}/conversations.parque[t]")


def run_through(stream: DataFrame, name: str) -> DataFrame:
    """All that is there of a stream, run to its end into Parquet, and that read."""
    spark = stream.sparkSession
    folder = new_folder(spark, name)
    started = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return conversation_stream(spark, sf_dir).selectExpr(*split_columns(DERIVED[name][1]))


@query(f"{sql.redacted_ctes(CHATS, 'conv_id, turn', 'text')} SELECT conv_id, turn, out AS text, kinds FROM redacted")
def stream_redact(spark, sf_dir):
    out = run_through(streams.stream_redact(stream_of(spark, sf_dir, "chats"), ["conv_id", "turn"], "text"), "redact")
    return out.withColumn("kinds", F.array_join("kinds", ","))


def in_batches(rows: list[DataFrame], name: str) -> DataFrame:
    """Rows as a stream whose batches are the given parts, in their order."""
    path = new_folder(rows[0].sparkSession, name)
    for part in rows:
        part.coalesce(1).write.mode("append").parquet(path)
    return rows[0].sparkSession.readStream.schema(rows[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(f"SELECT request_id, host, allowed, reason, request_id % 3 AS batch, request_id % 3 AS heard FROM {JUDGED}")
def stream_egress(spark, sf_dir):
    """Verdicts of the guard over three batches, each judged once, and the batch in which its listener heard of them."""
    rows = requests(spark, sf_dir)
    folder, heard = new_folder(spark, "egress"), []
    stream = in_batches([rows.where(f"request_id % 3 = {k}") for k in range(3)], "requests")

    def listen(told: DataFrame, number: int) -> None:
        heard.append(f"{folder}/heard-{number}")
        told.select("request_id", F.lit(number).cast("long").alias("heard")).write.mode("overwrite").parquet(heard[-1])

    streams.stream_egress(stream, hosts(spark), f"{folder}/verdicts", f"{folder}/checkpoint", listener=listen).awaitTermination()
    both = streams.passed(spark, f"{folder}/verdicts").unionByName(streams.refused(spark, f"{folder}/verdicts"))
    out = both.join(spark.read.parquet(*heard).hint("merge"), "request_id")
    return out.select("request_id", "host", "allowed", "reason", F.col("batch").cast("long").alias("batch"), "heard")


_REPLIES = """SELECT a.event_id, b.event_id AS reply, b.event_id IS NOT NULL AS answered FROM events a LEFT JOIN events b
    ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id <> b.event_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOURS"""


@query(_REPLIES)
def stream_replies(spark, sf_dir):
    """Events and those that answer them, on two streams in four batches; rows far later move the watermarks past them all."""
    events = materialized(tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("nonce"), F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"), "event_id"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first) / 4
    after = lambda k: F.lit(first + k * step)
    parts = [events.where((F.col("ts") >= after(k) if k else F.lit(True)) & (F.col("ts") < after(k + 1) if k < 3 else F.lit(True))) for k in range(4)]
    closing = spark.range(1).select(F.lit(-1).cast("long").alias("nonce"), F.lit("end").alias("source"), F.lit(last + 400 * step + timedelta(days=30)).alias("ts"), F.lit(-1).cast("long").alias("event_id"))
    asked, said = (in_batches([*parts, closing, closing], name) for name in ("asked", "said"))
    out = run_through(streams.stream_replies(asked, said, "6 hours", "1 minute", unlike="event_id"), "replies")
    return out.where("event_id >= 0").select("event_id", F.col("reply_event_id").alias("reply"), "answered")


@query(f"{NUMBERED} SELECT CAST(conv_id AS VARCHAR) AS scope, kind || '#' || CAST(n AS VARCHAR) AS handle, kind, value, n FROM vault")
def stream_vault(spark, sf_dir):
    with state_store(spark):
        return run_through(streams.stream_vault(stream_of(spark, sf_dir, "chats"), "conv_id", "turn", "text"), "vault")


@query(ORACLES[reassemble_calls_whole.__name__])
def stream_reassemble(spark, sf_dir):
    """Fragments of whole turns; the first turn's row says that the request is finished."""
    rows = piece_rows(conversation_stream(spark, sf_dir)).selectExpr(*split_columns(PIECES), "case when turn = 0 and piece = 0 then 'stop' end as finish")
    with state_store(spark):
        out = run_through(streams.stream_reassemble(rows.drop("channel")), "reassemble")
    return out.select("request_id", F.col("idx").cast("long").alias("idx"), "id", "name", "args")
