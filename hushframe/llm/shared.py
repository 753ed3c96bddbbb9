"""Session helpers of the corpus operators: materialised steps, sizes, ranks and components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many rows (some tens of bytes each) may be broadcast.
BROADCAST_ROWS = 100_000
#: Rows from which on a join key is heavy.
HEAVY_ROWS = 1000
#: The same for a side whose bytes were summed.
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one in the warehouse where that is unset."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return own or f"{spark.conf.get('spark.sql.warehouse.dir')}/steps"


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that its lineage ends here."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, by: str, parts: int) -> DataFrame:
    """``df`` written as Parquet in the shared folder, bucketed by ``by``, and read back: groups and joins by it need no shuffle.

    The name in the catalogue goes at once; the files stay as long as the folder does.
    """
    spark = df.sparkSession
    name = f"dealt_{uuid.uuid4().hex}"
    writer = df.repartition(parts, by).write.format("parquet").option("compression", "zstd").bucketBy(parts, by).sortBy(by)
    writer.option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    back = spark.table(name)
    back.schema  # the files are known from here on
    spark.sql(f"DROP TABLE {name}")
    return back


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def joined_by(df: DataFrame, small: DataFrame, on: list[str], rows: int, how: str = "left") -> DataFrame:
    """``df`` joined with a table of one row per key: broadcast if its counted rows allow it, else shuffled."""
    side = F.broadcast(small) if rows <= BROADCAST_ROWS else small.hint("merge")
    return df.join(side, on, how)


def ranked(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``rank``, the 0-based place of each row by ``key``, without one task seeing all rows.

    Rows are range-partitioned and sorted; only the row count of each partition reaches the driver.
    """
    parts = settle(df.repartitionByRange(shuffle_partitions(df.sparkSession), key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, total = [], 0
    counts = {row["part"]: row["n"] for row in parts.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    for i in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(i, 0)
    offset = F.element_at(F.array(*map(F.lit, before or [0])), part.cast("int") + 1)
    return parts.withColumn("rank", place + offset).drop("_at")


def met_by(df: DataFrame, small: DataFrame, on: str, total: int) -> DataFrame:
    """``df`` inner-joined with ``small(on, n, ...)``, one row per key, where ``n`` is about how many of df's ``total`` rows have the key.

    Keys with many rows are few (a share of ``total`` each, so never more than may be broadcast)
    and go to where the rows are; the rest is a sort-merge join without a heavy key.
    """
    heavy = max(HEAVY_ROWS, 2 * total // BROADCAST_ROWS)
    hot, rest = small.where(F.col("n") > heavy).drop("n"), small.where(F.col("n") <= heavy).drop("n")
    light = df.join(F.broadcast(hot.select(on)), on, "left_anti").join(rest.hint("merge"), on)
    return df.join(F.broadcast(hot), on).unionByName(light)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, label)``, label the smallest node reachable.

    Alternates large-star and small-star rewiring (each a grouped minimum and a join on small
    rows) until nothing changes, so the rounds grow with the logarithm of the longest chain and
    no link, component or label leaves the executors. A hub's minimum is pre-aggregated before
    the shuffle, and its rows are not gathered for the join.
    """
    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    n, same = edges.count(), False
    while n and not same:
        both = edges.union(edges.select("b", "a"))
        low = settle(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        large = met_by(both.where("b > a"), low, "a", 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = met_by(large, lower, "a", n)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(lower.select("a", "m")).distinct()
        small = settle(small)
        # A round that changes nothing ends it: every node then hangs on its smallest one.
        now = small.count()
        same = now == n and small.join(edges.hint("merge"), ["a", "b"], "left_anti").isEmpty()
        edges, n = small, now
    hubs = edges.groupBy(F.col("b").alias("node")).agg(F.min("b").alias("label"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(hubs)


def null_safe(name: str) -> Column:
    """A non-null key that equals another's exactly if the values do, nulls included; sorts as the text does, null last."""
    return F.when(F.col(name).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(name).cast("string")))
