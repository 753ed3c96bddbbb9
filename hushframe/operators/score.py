"""Scores against labelled spans and decoys, and the gate that a covered decoy fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.materialize import materialized
from .cells import box_axes, meeting, span_axes


def spans_intersect(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of spans of one text that share a character; columns of ``b`` get the prefix ``b_``. Both sides are read twice."""
    return meeting(a, b, on, span_axes(), span_axes()).where((F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end")))


def boxes_intersect(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of boxes of one image that share area; columns of ``b`` get the prefix ``b_``. Both sides are read twice."""
    apart = lambda p, size: (F.col(p) < F.col(f"b_{p}") + F.col(f"b_{size}")) & (F.col(f"b_{p}") < F.col(p) + F.col(size))
    return meeting(a, b, on, box_axes(), box_axes()).where(apart("x", "w") & apart("y", "h"))


def covered_truth(found: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """``truth`` with ``covered``: whether any finding overlaps it."""
    key = [*on, "start", "end"]
    truth, found = materialized(truth), materialized(found.select(*key))
    hit = spans_intersect(truth.select(*key), found.select(*key), on).select(*key).distinct().withColumn("covered", F.lit(True))
    return truth.join(hit.hint("merge"), key, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def _facts(found: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """One row for each labelled span (``n`` of them if it is labelled alike more than once) and each found one, with what covers it.

    Columns ``kind, decoy, found, n, met, right``: whether anything found overlaps a label, and
    whether anything truly labelled overlaps what was found. One join tells both.
    """
    key = [*on, "start", "end"]
    own = found.withColumn("kind", F.lit(None).cast("string")) if "kind" not in found.columns else found
    own = materialized(own.groupBy(*key).agg(F.min("kind").alias("kind")))
    labels = materialized(truth.select(*key, "kind", F.col("decoy_reason").isNotNull().alias("decoy")))
    pairs = spans_intersect(labels, own, on)
    row = lambda is_found, n, met, right: [F.lit(is_found).alias("found"), F.lit(n).alias("n"), F.lit(met).alias("met"), F.lit(right).alias("right")]
    labelled = labels.select(*key, "kind", "decoy", *row(False, 1, False, False))
    shown = own.select(*key, "kind", F.lit(False).alias("decoy"), *row(True, 1, False, False))
    ends = lambda way, kind, decoy, is_found, right: F.struct(F.col(f"{way}start").alias("start"), F.col(f"{way}end").alias("end"), F.col(kind).alias("kind"), decoy.alias("decoy"), F.lit(is_found).alias("found"), right.alias("right"))
    both = F.array(ends("", "kind", F.col("decoy"), False, F.lit(False)), ends("b_", "b_kind", F.lit(False), True, ~F.col("decoy")))
    told = pairs.select(*on, F.explode(both).alias("p")).select(*on, "p.start", "p.end", "p.kind", "p.decoy", "p.found", F.lit(0).alias("n"), F.lit(True).alias("met"), "p.right")
    every = labelled.unionByName(shown).unionByName(told)
    return every.groupBy(*key, "kind", "decoy", "found").agg(F.sum("n").alias("n"), F.max("met").alias("met"), F.max("right").alias("right"))


def _counts() -> list[Column]:
    count = lambda told: F.coalesce(F.sum(F.when(told, F.col("n"))), F.lit(0))
    real, decoy = ~F.col("found") & ~F.col("decoy"), ~F.col("found") & F.col("decoy")
    counts = {"identifiers": real, "hit": real & F.col("met"), "decoys": decoy, "decoys_covered": decoy & F.col("met"), "shown": F.col("found"), "right": F.col("found") & F.col("right")}
    return [count(told).alias(name) for name, told in counts.items()]


def _rated(counts: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(b > 0, a / b)
    hit, decoys = F.col("hit"), F.col("decoys_covered")
    return counts.withColumns({"recall": ratio(hit, F.col("identifiers")), "precision_decoy": ratio(hit, hit + decoys), "precision_span": ratio(F.col("right"), F.col("shown"))})


def score_detection(found: DataFrame, truth: DataFrame, on: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row: ``identifiers, hit, recall, decoys, decoys_covered, precision_decoy, precision_span``.

    The decoy precision counts covered decoys only; the span precision counts findings that
    overlap a true identifier among all findings. A ratio of nothing is null.
    """
    out = _rated(_facts(found, truth, list(on)).agg(*_counts()))
    return out.select("identifiers", "hit", "recall", "decoys", "decoys_covered", "precision_decoy", "precision_span")


def score_table(found: DataFrame, truth: DataFrame, on: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The scores of each kind and of all (``total``), from grouping sets over one coverage join; no rows if nothing is labelled or found.

    ``kind`` is that of the label, for findings their own; a decoy's is null.
    """
    sets = _facts(found, truth, list(on)).groupingSets([[F.col("kind")], []], F.col("kind"))
    return _rated(sets.agg(*_counts(), (F.grouping("kind") == 1).alias("total")))


def score_by_kind(found: DataFrame, truth: DataFrame, on: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``kind, identifiers, hit, recall``."""
    return score_table(found, truth, on).where(~F.col("total") & (F.col("identifiers") > 0)).select("kind", "identifiers", "hit", "recall")


def score_errors(found: DataFrame, truth: DataFrame, on: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Missed identifiers and covered decoys: the truth rows with ``error``."""
    judged = covered_truth(found, truth, list(on))
    error = F.when(F.col("decoy_reason").isNull() & ~F.col("covered"), "missed").when(F.col("decoy_reason").isNotNull() & F.col("covered"), "decoy covered")
    return judged.withColumn("error", error).where(F.col("error").isNotNull()).drop("covered")


def quality_gate(found: DataFrame, truth: DataFrame, on: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row ``passed``: no decoy is covered. Misses do not fail it."""
    return covered_truth(found, truth, list(on)).agg((F.count_if(F.col("decoy_reason").isNotNull() & F.col("covered")) == 0).alias("passed"))
