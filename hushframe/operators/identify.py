"""Identifiers in any text column: one row per finding, without overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.detectors import DETECTORS, Detector, all_detected, detected, detector, pattern_spans, without_overlaps
from ..functions.expressions import luhn_ok, verhoeff_ok


def keys_of(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def exploded(df: DataFrame, key: str | list[str], spans: Column) -> DataFrame:
    """One row per span. An outer explode, as the optimizer would work the spans out twice to filter before an inner one."""
    keys = keys_of(key)
    return df.select(*keys, F.explode_outer(spans).alias("_s")).where(F.col("_s").isNotNull()).select(*keys, "_s.start", "_s.end", "_s.text", "_s.kind")


def detect(df: DataFrame, key: str | list[str], text: str, kind: str) -> DataFrame:
    """``key, start, end, text, kind`` of one detector. Null texts have no findings."""
    return exploded(df, key, detected(F.col(text), detector(kind)))


def span_positions(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """``df`` with ``spans``: places of all matches, in code points, end exclusive."""
    return df.withColumn("spans", pattern_spans(F.col(text), pattern))


def resolve_overlaps(df: DataFrame, spans: str = "spans") -> DataFrame:
    return df.withColumn(spans, without_overlaps(F.col(spans)))


def with_spans(df: DataFrame, text: str, detectors: list[Detector] | None = None, name: str = "spans") -> DataFrame:
    """``df`` with the resolved spans of all detectors, each tried on texts that hold its hint."""
    return df.withColumn(name, without_overlaps(all_detected(F.col(text), detectors or DETECTORS)))


def find_identifiers(df: DataFrame, key: str | list[str], text: str, detectors: list[Detector] | None = None) -> DataFrame:
    """``key, start, end, text, kind`` of every identifier, left to right and never overlapping."""
    return exploded(df, key, without_overlaps(all_detected(F.col(text), detectors or DETECTORS)))


def identifier_kinds(df: DataFrame, spans: str = "spans") -> DataFrame:
    return df.withColumn("kinds", F.transform(spans, lambda s: s["kind"]))


def checksum_luhn(df: DataFrame, column: str) -> DataFrame:
    return df.where(luhn_ok(F.col(column).cast("string")))


def checksum_verhoeff(df: DataFrame, column: str) -> DataFrame:
    return df.where(verhoeff_ok(F.col(column).cast("string")))


def kind_counts(found: DataFrame, by: list[str], key: str) -> DataFrame:
    """Findings and distinct keys per group and kind."""
    return found.groupBy(*by, "kind").agg(F.count("*").alias("findings"), F.countDistinct(key).alias("with_findings"))


def cap_per_group(df: DataFrame, by: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def find_in_pages(text_nodes: DataFrame, cap: int | None = None) -> DataFrame:
    """``page_id, node_id, nth, start, end, kind`` of the findings in a page's text nodes; with ``cap`` the first so many of each page."""
    found = find_identifiers(text_nodes, ["page_id", "node_id", "nth"], "text")
    if cap is not None:
        found = cap_per_group(found, ["page_id"], ["node_id", "nth", "start"], cap)
    return found.select("page_id", "node_id", "nth", "start", "end", "kind")


def leak_check(df: DataFrame, key: str | list[str], text: str) -> DataFrame:
    """Findings in text that should hold none; any row is a leak."""
    return find_identifiers(df, key, text)
