"""The operators on streams: redaction, the egress guard, minting, reassembly and reply matching."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.egress import egress_verdict
from ..operators.identify import find_identifiers
from ..operators.redact import redact_drop

#: Stateful queries keep their state in RocksDB.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def stream_redact(stream: DataFrame, key: str | list[str], text: str) -> DataFrame:
    """Rows redacted as they come; stateless, append mode."""
    return redact_drop(stream, key, text)


def stream_egress(stream: DataFrame, hosts: DataFrame, path: str, checkpoint: str, own_host: str | None = None, listener: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Starts the guard on a stream of requests: every batch is judged once and written under ``path``, what passes and what is refused apart.

    A batch has a folder of its own number, so that one that is done again after a failure takes
    the place of what it wrote and adds no row. ``listener(rows, number)`` then gets its verdicts,
    refused ones included, as they were written. ``passed`` and ``refused`` read what is there.
    """

    def judge(batch: DataFrame, number: int) -> None:
        where = f"{path}/batch={number}"
        egress_verdict(batch, hosts, own_host).write.mode("overwrite").partitionBy("allowed").parquet(where)
        if listener is not None:
            listener(judged(batch.sparkSession, where), number)

    return stream.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def judged(spark: SparkSession, path: str) -> DataFrame:
    """All verdicts that the guard wrote under ``path``, with their ``batch``; a condition on ``allowed`` reads that folder only."""
    return spark.read.parquet(path).withColumn("allowed", F.col("allowed").cast("string") == "true")


def passed(spark: SparkSession, path: str) -> DataFrame:
    return judged(spark, path).where("allowed")


def refused(spark: SparkSession, path: str) -> DataFrame:
    return judged(spark, path).where("not allowed")


class Minter(StatefulProcessor):
    """Per scope: each new (kind, value) gets the next number, which is never given again."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.numbers = handle.getMapState("numbers", "kind string, value string", "n long", ttlDurationMs=self.ttl_ms)
        self.last = handle.getValueState("last", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "start"], kind="stable")
        last = self.last.get()[0] if self.last.exists() else 0
        out = []
        for kind, value in zip(frame["kind"], frame["text"], strict=True):
            if not self.numbers.containsKey((kind, value)):
                last += 1
                self.numbers.updateValue((kind, value), (last,))
                out.append((key[0], f"{kind}#{last}", kind, value, last))
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["scope", "handle", "kind", "value", "n"])

    def close(self) -> None:
        pass


def stream_vault(stream: DataFrame, scope: str, at: str, text: str, ttl_ms: int | None = None) -> DataFrame:
    """``scope, handle, kind, value, n`` of values as they are first seen; ``at`` orders rows within a batch.

    With ``ttl_ms`` a value that was minted so long ago leaves the state; seen again, it gets a
    new number, as numbers are never used twice.
    """
    found = find_identifiers(stream, [scope, at], text).select(F.col(scope).cast("string").alias("scope"), F.col(at).alias("at"), "start", "kind", "text")
    return found.groupBy("scope").transformWithStateInPandas(statefulProcessor=Minter(), outputStructType="scope string, handle string, kind string, value string, n long", outputMode="Append", timeMode="None" if ttl_ms is None else "ProcessingTime")


class Assembler(StatefulProcessor):
    """Per request: fragments until a row with ``finish``, then one row per call; given up when no row comes for ``timeout_ms``."""

    COLUMNS = ["request_id", "idx", "id", "name", "args", "finished"]

    def __init__(self, timeout_ms: int | None = None):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "seq long, idx int, id string, name string, args string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        text = lambda v: None if v is None or pd.isna(v) else str(v)
        for r in frame.itertuples():
            if not pd.isna(r.idx):
                self.parts.appendValue((int(r.seq), int(r.idx), text(r.id), text(r.name), text(r.args_fragment)))
        if self.timeout_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if frame["finish"].notna().any():
            yield self.joined(key, True)
        elif self.timeout_ms is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.joined(key, False)

    def joined(self, key, finished: bool) -> pd.DataFrame:
        """What has come of each call; the request's state ends."""
        calls: dict[int, list] = {}
        for _, idx, id_, name, args in sorted(self.parts.get(), key=lambda p: p[0]):
            call = calls.setdefault(idx, [None, None, []])
            call[0], call[1] = id_ or call[0], name or call[1]
            call[2].append(args or "")
        self.parts.clear()
        return pd.DataFrame([(key[0], i, c[0] or f"call_{i}", c[1], "".join(c[2]), finished) for i, c in sorted(calls.items())], columns=self.COLUMNS)

    def close(self) -> None:
        pass


def stream_reassemble(stream: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """``request_id, idx, id, name, args, finished`` of requests whose finish row has come; it must not precede its fragments' batch.

    With ``timeout_ms`` a request for which no row comes for so long is put out unfinished, and its state ends.
    """
    schema = "request_id long, idx int, id string, name string, args string, finished boolean"
    rows = stream.withColumn("request_id", F.col("request_id").cast("long"))
    return rows.groupBy("request_id").transformWithStateInPandas(statefulProcessor=Assembler(timeout_ms), outputStructType=schema, outputMode="Append", timeMode="None" if timeout_ms is None else "ProcessingTime")


def reply_match(requests: DataFrame, replies: DataFrame, within: str = "250 milliseconds", unlike: str | None = None) -> DataFrame:
    """Requests ``(nonce, source, ts, ...)`` with their reply, from the same source and in time; others get none.

    On streams both sides need a watermark on ``ts``; late replies are then dropped. Rows that
    agree in the column ``unlike`` are the same message, which does not answer itself.
    """
    other = replies.select(F.col("nonce").alias("_nonce"), F.col("source").alias("_source"), F.col("ts").alias("reply_ts"), *[F.col(c).alias(f"reply_{c}") for c in replies.columns if c not in ("nonce", "source", "ts")])
    in_time = (F.col("reply_ts") >= F.col("ts")) & (F.col("reply_ts") <= F.col("ts") + F.expr(f"interval {within}"))
    met = (F.col("nonce") == F.col("_nonce")) & (F.col("source") == F.col("_source")) & in_time
    if unlike is not None:
        met = met & (F.col(unlike) != F.col(f"reply_{unlike}"))
    return requests.join(other, met, "left_outer").drop("_nonce", "_source").withColumn("answered", F.col("reply_ts").isNotNull())


def stream_replies(requests: DataFrame, replies: DataFrame, within: str = "250 milliseconds", late: str = "1 minute", unlike: str | None = None) -> DataFrame:
    """``reply_match`` on two running streams, each with a watermark of its own.

    A request that nobody answered comes out once both watermarks have passed the time in which
    an answer could still come; its state ends then. What comes later than ``late`` after newer
    rows of its side is dropped, and counted (see ``late_rows``). A row that can match nothing (a
    null key, or null in ``unlike``) does not move its side's watermark. State holds the requests and
    replies of about ``within`` and ``late``, however long the stream runs.
    """
    return reply_match(requests.withWatermark("ts", late), replies.withWatermark("ts", late), within, unlike)


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query's stateful operators dropped as too late, over the batches whose progress is kept."""
    return sum(operator["numRowsDroppedByWatermark"] for progress in query.recentProgress for operator in progress["stateOperators"])
