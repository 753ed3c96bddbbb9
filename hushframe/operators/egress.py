"""Audit of request logs: anything that cannot be inspected, or still holds an identifier, is refused."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.detectors import DETECTORS, all_detected, without_overlaps, worth_a_search
from ..functions.expressions import human_bytes

#: JSON strings, keys with their colon. Possessive: an alternation in a loop would exhaust Java's stack.
JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?'
#: Long base64 runs are images, not prose.
OPAQUE = "^[A-Za-z0-9+/=]{200,}$"
#: Between values where they are searched together: no identifier goes on over it.
APART = "\u0000"
NOT_JSON = "The body is no JSON: it was refused uninspected."
FOUND = "Personal data stands open in the body."
NO_HOST = "The address names no host."
STRANGER = " is a host that nobody has allowed."


def _no_constant(name: str):
    raise ValueError(name)


@F.pandas_udf(T.BooleanType())
def strict_json(bodies: pd.Series) -> pd.Series:
    """Whether a body is JSON with nothing after it; NaN and Infinity are not JSON. Null is not."""

    def parses(body) -> bool:
        try:
            json.loads(body, parse_constant=_no_constant)
        except (ValueError, TypeError, RecursionError):
            return False
        return True

    return bodies.map(parses).astype(bool)


def string_values(body: Column) -> Column:
    """String values of a JSON text at any depth, unescaped; keys, numbers, data URLs and opaque runs are left out."""
    tokens = F.filter(F.regexp_extract_all(body, F.lit(JSON_STRING), F.lit(0)), lambda t: ~t.endswith(":"))
    plain = F.transform(tokens, lambda t: F.from_json(F.concat(F.lit('{"v":'), t, F.lit("}")), "v string")["v"])
    return F.filter(plain, lambda v: ~v.startswith("data:") & ~v.rlike(OPAQUE))


def json_strings(requests: DataFrame) -> DataFrame:
    """``request_id, pos, value``."""
    return requests.select("request_id", F.posexplode(string_values(F.col("body"))).alias("pos", "value"))


def kinds_in(body: Column) -> Column:
    """Sorted distinct kinds of the identifiers in a body's string values, which are searched as one text.

    Values without escapes stand in the body as they are: where the body as a whole is not worth
    a search and escapes nothing, no value is cut out of it.
    """
    found = without_overlaps(all_detected(F.array_join(string_values(body), APART), DETECTORS))
    worth = F.contains(body, F.lit("\\")) | worth_a_search(body) | F.lit(any(d.hint is None for d in DETECTORS))
    return F.when(worth, F.array_sort(F.array_distinct(F.transform(found, lambda s: s["kind"])))).otherwise(F.array().cast("array<string>"))


def body_kinds(found: DataFrame) -> DataFrame:
    """``request_id, kinds`` from findings per request."""
    return found.groupBy("request_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def inspect_body(requests: DataFrame) -> DataFrame:
    """``request_id, ok, reason, kinds``."""
    rows = requests.withColumn("_json", strict_json("body")).withColumn("_kinds", kinds_in(F.when(F.col("_json"), F.col("body"))))
    held = F.coalesce(F.size("_kinds") > 0, F.lit(True))
    reason = F.when(~F.col("_json"), F.lit(NOT_JSON)).when(held, F.lit(FOUND))
    return rows.select("request_id", reason.isNull().alias("ok"), reason.alias("reason"), F.when(F.col("_json") & held, F.col("_kinds")).alias("kinds"))


#: Hosts that may be broadcast; a longer list is joined by a shuffle.
BROADCAST_HOSTS = 10_000


def allowed_hosts(requests: DataFrame, hosts: DataFrame) -> DataFrame:
    """``requests`` with ``host_allowed``; ``hosts(host)`` is a configured list, broadcast if its counted rows are few."""
    listed = hosts.select("host").distinct().withColumn("host_allowed", F.lit(True))
    few = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    return requests.join(F.broadcast(listed) if few else listed.hint("merge"), "host", "left").withColumn("host_allowed", F.coalesce("host_allowed", F.lit(False)))


def egress_verdict(requests: DataFrame, hosts: DataFrame, own_host: str | None = None) -> DataFrame:
    """``requests(request_id, at, url, body)`` with ``host, bytes, allowed, logged, reason, kinds``.

    In this order: unparseable address refused; in-process address or own host passes without a
    log row; unknown host refused; empty body passes; then the body is inspected. Whatever turns
    out null is refused.
    """
    scheme = F.lower(F.regexp_extract("url", "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.expr("try_parse_url(url, 'HOST')") if "host" not in requests.columns else F.col("host")
    port = F.regexp_extract("url", r"^[^/]+//[^/?#]*?(:\d+)(?:[/?#]|$)", 1)
    rows = requests.withColumns({"_scheme": scheme, "host": F.concat(host, port)})
    rows = allowed_hosts(rows, hosts)
    local = F.col("_scheme").isin("data", "blob") | (F.col("host").eqNullSafe(F.lit(own_host)) if own_host else F.lit(False))
    empty = F.coalesce(F.col("body"), F.lit("")) == ""
    # Only what an allowed host would get is parsed and searched.
    rows = rows.withColumn("_sent", F.when(F.col("host_allowed") & ~F.coalesce(local, F.lit(False)), F.col("body")))
    rows = rows.withColumn("_json", strict_json("_sent")).withColumn("_kinds", kinds_in(F.when(F.col("_json"), F.col("_sent"))))
    held = F.coalesce(F.size("_kinds") > 0, F.lit(True))
    reason = (
        F.when(F.col("_scheme").isin("data", "blob"), F.lit(None).cast("string"))
        .when(F.col("url").isNull() | F.col("host").isNull(), F.lit(NO_HOST))
        .when(local, F.lit(None).cast("string"))
        .when(~F.col("host_allowed"), F.concat("host", F.lit(STRANGER)))
        .when(empty, F.lit(None).cast("string"))
        .when(~F.col("_json"), F.lit(NOT_JSON))
        .when(held, F.lit(FOUND))
    )
    inspected = F.col("host_allowed") & ~empty & ~local & F.col("_json") & held
    out = rows.withColumns({"reason": reason, "logged": ~F.coalesce(local, F.lit(False)), "bytes": F.coalesce(F.octet_length("body"), F.lit(0)).cast("long")})
    return out.withColumns({"allowed": F.col("reason").isNull(), "kinds": F.when(inspected, F.col("_kinds"))}).select(*[c for c in requests.columns if c != "host"], "host", "bytes", "allowed", "logged", "reason", "kinds")


def egress_log(requests: DataFrame, hosts: DataFrame, own_host: str | None = None) -> DataFrame:
    """One row per logged attempt: ``at, host, bytes, allowed, reason, kinds``."""
    return egress_verdict(requests, hosts, own_host).where("logged").select("at", F.coalesce("host", "url").alias("host"), "bytes", "allowed", "reason", "kinds")


def egress_summary(log: DataFrame, by: str | None = None) -> DataFrame:
    """``sent, refused, bytes, size``; bytes of what was allowed."""
    groups = log.groupBy(by) if by else log.groupBy()
    out = groups.agg(F.count_if("allowed").alias("sent"), F.count_if(~F.col("allowed")).alias("refused"), F.coalesce(F.sum(F.when(F.col("allowed"), F.col("bytes"))), F.lit(0)).alias("bytes"))
    return out.withColumn("size", human_bytes(F.col("bytes")))


def log_tail(log: DataFrame, n: int = 200, order: tuple[str, ...] = ("at",)) -> DataFrame:
    """The newest rows, newest first."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(n)
