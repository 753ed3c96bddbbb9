"""Readers of the given tables and sinks that keep raw values out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vault_store import VaultStore

PAGES = "page_id long, url string, html string"
REQUESTS = "request_id long, at timestamp, url string, host string, body string"
DETECTIONS = "image_id long, stride int, i int, cls double, obj double, bbox array<double>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by their key to all cores, for steps that take long for each row: a small file is few tasks, and one row group is one."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def src_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(f"{sf_dir}/pages.parquet")


def src_text(spark: SparkSession, sf_dir: str, name: str, key: str | list[str], text: str = "text") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return table(spark, sf_dir, name).select(*keys, text)


def src_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A request log, as a batch or as a stream of its files."""
    return (spark.readStream if stream else spark.read).schema(REQUESTS).parquet(path)


def src_detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DETECTIONS).parquet(path)


def src_truth(pages: DataFrame) -> DataFrame:
    """``page_id, kind, decoy, text`` of the elements that markup labels as identifiers or decoys."""
    labelled = r'<(\w+)[^>]*\bdata-(pii|decoy)="([^"]*)"[^>]*>([^<]*)</'
    part = lambda n: F.regexp_extract_all("html", F.lit(labelled), F.lit(n))
    rows = pages.select("page_id", F.explode(F.arrays_zip(part(2).alias("what"), part(3).alias("value"), part(4).alias("text"))).alias("t"))
    return rows.select("page_id", F.when(F.col("t.what") == "pii", F.col("t.value")).alias("kind"), F.when(F.col("t.what") == "decoy", F.col("t.value")).alias("decoy"), F.col("t.text").alias("text"))


def sink_redacted(df: DataFrame, path: str, drop: list[str], partition_by: list[str] | None = None) -> None:
    """Writes ``df`` without its raw columns, which leave the plan before anything is written."""
    writer = df.drop(*drop).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def sink_vault(found: DataFrame, path: str, scope: str, order: list[str], gen: int, tag: str = "", buckets: int = 64) -> VaultStore:
    """Mints for ``found`` into the vault stored under ``path``, a place of its own apart from anything redacted; only new entries and seen marks are written."""
    store = VaultStore(found.sparkSession, path, buckets)
    store.mint(found, scope, order, gen, tag)
    return store


def sink_egress_log(log: DataFrame, path: str, checkpoint: str | None = None):
    """Appends verdict rows; a stream needs a ``checkpoint`` folder and returns its query."""
    if log.isStreaming:
        return log.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").start()
    return log.write.mode("append").parquet(path)
