"""What stands above and below nodes, from intervals instead of lists of ancestors.

Nodes are numbered in document order, and ``last`` is the last node of a node's subtree: what
stands below is the numbers from ``node_id + 1`` to ``last``. Subtrees nest or are apart, so that
one that began before a node and ends no earlier holds it. Every test is a running value over the
rows of a page in their order; rows that are dealt by ``page_id`` once need no other exchange.
Columns: ``page_id, node_id, last`` and whatever else the rows have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)


def within(marked: Column, *same: str) -> Column:
    """Whether a marked node stands above, among the rows that agree in the columns ``same``."""
    before = Window.partitionBy("page_id", *same).orderBy("node_id").rowsBetween(*BEFORE)
    return F.coalesce(F.max(F.when(marked, F.col("last"))).over(before) >= F.col("node_id"), F.lit(False))


def holds(marked: Column) -> Column:
    """Whether a marked node stands below: the next one is no later than the last of the subtree."""
    after = Window.partitionBy("page_id").orderBy(F.desc("node_id")).rowsBetween(*BEFORE)
    return F.coalesce(F.min(F.when(marked, F.col("node_id"))).over(after) <= F.col("last"), F.lit(False))


def innermost(rows: DataFrame, marked: Column, level: str, **given: Column) -> DataFrame:
    """Adds ``level``, the number of marked nodes above, and of the nearest of them what ``given`` names; null where there is none.

    The level is a running sum of subtrees that begin and end. The nearest marked node above one
    of level n is the last one before it that is itself of level n - 1, as any later one would
    have ended that.
    """
    own = rows.columns
    row = F.struct(*own, F.coalesce(marked, F.lit(False)).alias("_marked"), F.struct(*[c.alias(n) for n, c in given.items()]).alias("_given"))
    # A subtree ends after the numbers of its last node, whose own place comes before.
    edge = lambda place, by, there: F.struct(place.alias("place"), by.alias("by"), F.when(F.lit(there), F.col("_row")).alias("row"))
    begins = edge(F.col("node_id").cast("long") * 2, F.when(F.col("_row._marked"), 1).otherwise(0), True)
    ends = F.when(F.col("_row._marked"), edge(F.col("last").cast("long") * 2 + 1, F.lit(-1), False))
    edges = rows.select("page_id", row.alias("_row"), "node_id", "last").select("page_id", F.explode(F.array_compact(F.array(begins, ends))).alias("_e"))
    running = Window.partitionBy("page_id").orderBy("_e.place").rowsBetween(*BEFORE)
    begun = edges.withColumn("_level", F.coalesce(F.sum("_e.by").over(running), F.lit(0)).cast("int")).where(F.col("_e.row").isNotNull())
    # Each row asks at the level above its own; a marked one also answers at its own.
    asks = F.struct((F.col("_level") - 1).alias("at"), F.lit(True).alias("asks"))
    answers = F.when(F.col("_e.row._marked"), F.struct(F.col("_level").alias("at"), F.lit(False).alias("asks")))
    both = begun.select("page_id", F.col("_e.row").alias("_row"), "_level", F.explode(F.array_compact(F.array(asks, answers))).alias("_q")).select("page_id", "_row", "_level", F.col("_q.at").alias("_at"), F.col("_q.asks").alias("_asks"))
    before = Window.partitionBy("page_id", "_at").orderBy("_row.node_id").rowsBetween(*BEFORE)
    near = F.last(F.when(~F.col("_asks"), F.col("_row._given")), ignorenulls=True).over(before)
    met = both.withColumn("_near", near).where("_asks")
    kept = [F.col("page_id") if c == "page_id" else F.col(f"_row.{c}").alias(c) for c in own]
    return met.select(*kept, F.col("_level").alias(level), *[F.col(f"_near.{n}").alias(n) for n in given])


def marked_by(nodes: DataFrame, marks: DataFrame, name: str) -> DataFrame:
    """``page_id, node_id, last`` of nodes, dealt by page, with ``name``: whether ``marks`` has them."""
    own = nodes.select("page_id", "node_id", "last", F.lit(False).alias(name))
    other = marks.select("page_id", F.col("node_id").cast(nodes.schema["node_id"].dataType), F.lit(None).cast(nodes.schema["last"].dataType).alias("last"), F.lit(True).alias(name))
    return own.union(other).repartition("page_id").groupBy("page_id", "node_id").agg(F.max("last").alias("last"), F.max(name).alias(name)).where(F.col("last").isNotNull())
