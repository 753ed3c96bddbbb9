"""Redaction: spans replaced by markers, or by handles of a vault."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.detectors import DETECTORS, all_detected, spliced, without_overlaps
from ..functions.expressions import bound, squash, truncated
from ..functions.materialize import materialized
from .identify import keys_of, with_spans

NAME_CHARS, VALUE_CHARS, LABEL_CHARS = 80, 40, 60


def marker(kind: Column) -> Column:
    return F.concat(F.lit("[redacted:"), kind, F.lit("]"))


def redacted(text: Column, put: Callable[[Column], Column] | None = None) -> Column:
    """``text`` with every identifier replaced."""
    put = put or (lambda s: marker(s["kind"]))
    return bound(text, lambda t: spliced(t, without_overlaps(all_detected(t, DETECTORS)), put))


def redact_drop(df: DataFrame, key: str | list[str], text: str, put: Callable[[Column], Column] | None = None) -> DataFrame:
    """``key, text, kinds``; ``put`` may build another replacement from a span."""
    rows = with_spans(df, text, name="_spans")
    out = spliced(F.col(text), F.col("_spans"), put or (lambda s: marker(s["kind"])))
    return rows.select(*keys_of(key), out.alias(text), F.transform("_spans", lambda s: s["kind"]).alias("kinds"))


def with_handles(rows: DataFrame, keys: list[str], text: str, vault: DataFrame, scope: str) -> DataFrame:
    """``keys, text, kinds`` of rows whose ``_spans`` are known: values that the vault holds become handles, others are dropped."""
    wanted = rows.select(*dict.fromkeys([*keys, scope]), F.explode("_spans").alias("s")).select(*dict.fromkeys([*keys, scope]), F.col("s.kind").alias("kind"), F.col("s.text").alias("value")).distinct()
    known = vault.select(F.col("scope").alias(scope), "kind", "value", "handle")
    met = wanted.join(known.hint("merge"), [scope, "kind", "value"])
    found = met.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0000", "kind", "value"), "handle"))).alias("_handles"))
    rows = rows.join(found.hint("merge"), keys, "left")
    put = lambda s: F.coalesce(F.concat(F.lit("[redacted:"), F.try_element_at(F.col("_handles"), F.concat_ws("\u0000", s["kind"], s["text"])), F.lit("]")), marker(s["kind"]))
    return rows.select(*keys, spliced(F.col(text), F.col("_spans"), put).alias(text), F.transform("_spans", lambda s: s["kind"]).alias("kinds"))


def redact_handles(df: DataFrame, key: str | list[str], text: str, vault: DataFrame, scope: str) -> DataFrame:
    """``key, text, kinds`` with handles of ``vault(scope, kind, value, handle)`` for values that it holds.

    Handles travel to a text as one map per row, built from its own findings; the vault is
    joined by scope, kind and value. A value that the vault lacks is dropped, not shown. Spans
    are found once and written, as both the text and the wanted values need them.
    """
    keys = keys_of(key)
    rows = materialized(with_spans(df.select(*dict.fromkeys([*keys, scope, text])), text, name="_spans"))
    return with_handles(rows, keys, text, vault, scope)


def redact_header(pages: DataFrame, url: str = "url", title: str = "title") -> DataFrame:
    return pages.withColumns({url: redacted(F.col(url)), title: redacted(F.col(title))})


def redact_names(nodes: DataFrame, name: str = "name", limit: int = NAME_CHARS) -> DataFrame:
    """Names are redacted whole and then cut, so that no identifier crosses the cut."""
    return nodes.withColumn(name, bound(redacted(squash(F.col(name))), lambda n: truncated(n, limit)))


def redact_container_labels(nodes: DataFrame, label: str = "label", limit: int = LABEL_CHARS) -> DataFrame:
    return redact_names(nodes, label, limit)


def redact_controls(placed: DataFrame) -> DataFrame:
    """``name`` of controls and, in its place, ``label`` of containers, each redacted whole and cut to its own length."""
    shown = F.coalesce(F.when(F.col("element"), F.col("name")).otherwise(F.col("label")), F.lit(""))
    cut = lambda n: F.when(F.col("element"), truncated(n, NAME_CHARS)).otherwise(truncated(n, LABEL_CHARS))
    return placed.withColumn("name", bound(redacted(squash(shown)), cut))


def redact_values(nodes: DataFrame, value: str = "value", kind: str = "sensitive", handle: str | None = None, limit: int = VALUE_CHARS) -> DataFrame:
    """A declared kind hides the whole value (as ``handle`` if that column has one); others are searched."""
    whole = F.concat(F.lit("[redacted:"), F.coalesce(F.col(handle), F.col(kind)) if handle else F.col(kind), F.lit("]"))
    return nodes.withColumn(value, F.when(F.coalesce(F.col(value), F.lit("")) == "", F.col(value)).when(F.col(kind).isNotNull(), whole).otherwise(bound(redacted(F.col(value)), lambda v: truncated(v, limit))))


def redact_tabs(tabs: DataFrame, user: str = "user_id", order: str = "pos") -> DataFrame:
    """Per user the lines ``title — url`` of the open tabs, redacted, in order."""
    line = F.concat_ws(" — ", redacted(F.col("title")), redacted(F.col("url")))
    lines = tabs.select(user, F.struct(F.col(order).alias("pos"), line.alias("line")).alias("l"))
    return lines.groupBy(user).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("tabs"))
