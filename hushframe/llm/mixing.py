"""Mixing sources to target weights by hash-threshold histograms.

A document's place in its source is a hash of its id and text. Sizes are summed by source and
hash bucket; the bucket where the source's budget ends is refined with the next bits, and only
its rows are summed again. What is taken is then a filter on the hash: no sort, no shuffle of
texts, and the same rows on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import joined_by, null_safe, ranked, settle

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash that one histogram level resolves, and the levels there are.
BITS, LEVELS = 12, 5


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: str, text: str) -> Column:
    """60 bits that order a source's documents."""
    return F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.col(text)), 64 - BITS * LEVELS)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes(key, source_size)`` with ``target``.

    Sources in order of ``key`` weigh ``weights`` in turn and share ``share`` times all sizes; a
    target stops at ``most`` times its source's size and the excess is shared again by weight.
    Each round is one sum over the sources; the driver holds three numbers.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    table = settle(ranked(sizes, "key").select("key", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")))
    total, all_weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return table.select("key", "source_size", F.lit(0.0).alias("target"))
    level, stopped = share * total / all_weight, 0
    while True:
        full = F.col("cap") < F.lit(level) * F.col("weight")
        n, held, free = table.agg(F.count_if(full), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == stopped or not free:
            break
        level, stopped = (share * total - held) / free, n
    return table.select("key", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def mix_columns(doc_id: str, text: str, source: str) -> dict[str, Column]:
    return {"__w_size": word_count(text), "__w_place": place(doc_id, text), "__w_key": null_safe(source)}


def budget_ends(rows: DataFrame, budgets: DataFrame, n_sources: int) -> DataFrame:
    """Where each source's budget ends among its rows ``(key, size, place)``: ``key, threshold, edge, rest``; no row for a budget that its source does not reach.

    What lies at or below ``threshold`` is taken. The document on whose words the budget ends is
    taken if that brings the sum nearer to the target; if several share that place, it is
    ``edge`` (else -1), and ``rest`` words of them are still to be taken.
    """
    open_ = budgets.select("key", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    within, ended = rows, None
    for level in range(1, LEVELS + 1):
        bits = BITS * (LEVELS - level)
        within = joined_by(within, open_.select("key", "prefix"), ["key"], n_sources, "inner")
        if level > 1:
            within = within.where(F.shiftright("place", bits + BITS) == F.col("prefix"))
        within = within.drop("prefix")
        sums = within.groupBy("key", F.shiftright("place", bits).alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
        upto = F.sum("size").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        sums = joined_by(sums.withColumn("upto", upto), open_.select("key", "left"), ["key"], n_sources, "inner")
        # The first bucket that passes the budget is where it ends.
        ends = sums.where(F.col("upto") > F.col("left")).groupBy("key").agg(F.min_by(F.struct("bucket", "upto", "size", "docs", "left"), "bucket").alias("end"))
        ends = settle(ends.select("key", "end.*"))
        one, last = F.col("docs") == 1, F.lit(level == LEVELS)
        before = F.col("left") - (F.col("upto") - F.col("size"))
        upper = F.col("bucket") + F.when(one & (before * 2 >= F.col("size")), 1).otherwise(0)
        done = ends.where(one | last).select("key", (F.shiftleft(upper, bits) - 1).alias("threshold"), F.when(one, F.lit(-1)).otherwise(F.col("bucket")).cast("long").alias("edge"), before.alias("rest"))
        ended = done if ended is None else ended.union(done)
        open_ = ends.where(~(one | last)).select("key", F.col("bucket").alias("prefix"), before.alias("left"))
        if level == LEVELS or open_.isEmpty():
            break
    return settle(ended)


def mix_plan(rows: DataFrame, **targets) -> tuple[DataFrame, int]:
    """From rows with ``__w_key, __w_size, __w_place``, per source: ``key, source_size, target, passes, threshold, edge, rest``; and the number of sources.

    Every document of a source is taken ``passes`` times and once more if its place is at most
    ``threshold``, and of those at the place ``edge`` as many as ``rest`` words allow.
    """
    rows = rows.select(F.col("__w_key").alias("key"), F.col("__w_size").alias("size"), F.col("__w_place").alias("place"))
    sources = source_targets(rows.groupBy("key").agg(F.sum("size").alias("source_size")), **targets)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long")
    sources = sources.withColumn("passes", passes).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    sources = settle(sources)
    n_sources = sources.count()
    # No bucket passes the budget of a source whose rest is zero words.
    whole = F.when(F.col("budget") > 0, F.lit((1 << BITS * LEVELS) - 1)).otherwise(-1)
    plan = joined_by(sources, budget_ends(rows, sources, n_sources), ["key"], n_sources)
    return settle(plan.select("key", "source_size", "target", "passes", F.coalesce("threshold", whole).alias("threshold"), F.coalesce("edge", F.lit(-1)).cast("long").alias("edge"), "rest")), n_sources


def mix_taken(rows: DataFrame, plan: tuple[DataFrame, int]) -> DataFrame:
    """``rows`` with ``size, source_size, target, taken`` in place of the working columns."""
    table, n = plan
    own = ("source_size", "target", "passes", "threshold", "edge")
    met = joined_by(rows, table.select(F.col("key").alias("__w_key"), *[F.col(c).alias(f"__w_{c}") for c in own]), ["__w_key"], n)
    tied = table.where(F.col("edge") >= 0)
    if not tied.isEmpty():
        # Rows equal in id and text share a place: as they stand in the input, each gets one of its own, and the rest of the budget ends among these.
        at_edge = F.col("__w_place") == F.col("__w_edge")
        ties = settle(met.where(at_edge).drop("__w_place").withColumn("__w_place", F.monotonically_increasing_id()))
        small = ties.select(F.col("__w_key").alias("key"), F.col("__w_size").alias("size"), F.col("__w_place").alias("place"))
        ends = budget_ends(small, tied.select("key", F.col("rest").alias("budget")), n).select(F.col("key").alias("__w_key"), F.col("threshold").alias("__w_end"))
        ties = joined_by(ties, ends, ["__w_key"], n).withColumn("__w_threshold", F.coalesce("__w_end", "__w_threshold")).drop("__w_end")
        met = met.where(~at_edge).unionByName(ties)
    kept = [c for c in rows.columns if c not in ("size", "source_size", "target", "taken", "__w_size", "__w_place", "__w_key")]
    taken = F.col("__w_size") * (F.col("__w_passes") + F.when(F.col("__w_place") <= F.col("__w_threshold"), 1).otherwise(0))
    return met.select(*kept, F.col("__w_size").alias("size"), F.col("__w_source_size").alias("source_size"), F.col("__w_target").alias("target"), taken.cast("long").alias("taken"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", with_text: bool = True, **targets) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken``, the words that the mix takes of each row.

    Null sources are one source, the last; a null or blank text has size 0 and takes 0; an empty
    table gives none. Rows equal in id and text share a place; if the budget ends among them, as
    many of them are taken as it allows. A text of any length counts all its words. Columns of these four names
    are replaced, others pass through; ``with_text=False`` leaves the text out, and then every
    text is read once instead of twice.
    """
    found = mix_columns(doc_id, text, source)
    small = settle(docs.withColumns(found).select(*(found if with_text else [*[c for c in docs.columns if c != text], *found])))
    return mix_taken(docs.withColumns(found) if with_text else small, mix_plan(small, **targets))
