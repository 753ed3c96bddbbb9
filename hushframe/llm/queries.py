"""Registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, covertree, decontaminate, licences, linededup, mixing, oracles, quality, recompression, secretscan, simhash, suffixes, toxicity, whitening
from .shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha(text: str | Column) -> Column:
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs, with_text=False).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), with_text=False)
    return found.select("doc_id", *quality.STATS, "base_failed", "kept")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.benchmark_overlap(docs, table(spark, sf_dir, "benchmark"))
    items = F.size("item_ids").cast("long").alias("n_items")
    return found.select("doc_id", "n_words", "n_hit", items, sha(F.array_join("item_ids", ",")).alias("items_sha256"), "contaminated")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", sha("text").alias("kept_sha256"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")).select("doc_id", "held_out", "score", "predicted")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.duplicate_bytes(table(spark, sf_dir, "documents"))
    spans = F.expr("size(spans) div 2").cast("long").alias("n_spans")
    return found.select("doc_id", "n_bytes", "n_removed", spans, sha("kept").alias("kept_sha256"))


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recompression.duplicate_windows(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", sha("kept_text").alias("kept_sha256"))


def op11_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as legacy archives of both versions, converted into WARC, and what the WARC files hold."""
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    archives.write_arc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), f"{folder}/arc", "page_id", "url", "html")
    archives.arc_to_warc(spark, f"{folder}/arc", f"{folder}/warc", first=F.col("key").cast("long"))
    found = archives.resolved(archives.read_warc(spark, f"{folder}/warc", with_payload=False))
    return found.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to_key").cast("long").alias("refers_to"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, book = covertree.vector_codes(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(covertree.book_digest(book)).alias("codebooks_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_mix_sources, op2_quality_rules, op3_decontaminate, op4_licences, op5_simhash, op6_line_dedup, op7_secrets, op8_toxicity, op9_suffix_dedup, op10_recompression, op11_archives, op12_vector_codes, op13_whitening)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
