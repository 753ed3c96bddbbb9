"""A training corpus from ``documents`` in five stages, each by one operator of ``hushframe.llm``.

Each stage takes what the one before kept, written as Parquet and read again; its decisions take
effect on the rows or texts. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import decontaminate, linededup, mixing, quality, simhash
from hushframe.llm.shared import shared_folder


#: Columns that stages read or change; all others pass under names that no operator uses.
USED = ("doc_id", "text", "source")


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def apart(docs: DataFrame) -> DataFrame:
    """``docs`` with its other columns under private names, so that nothing an operator adds can replace them."""
    return docs.select(*[_named(c).alias(c if c in USED else f"__own_{i}") for i, c in enumerate(docs.columns)])


def back(found: DataFrame, docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` out of what an operator made of ``apart(docs)``."""
    return [F.col(c if c in USED else f"__own_{i}").alias(c) for i, c in enumerate(docs.columns)]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, rows and columns of the others stay as they are.

    Null, empty and blank texts have no words and go; repeated rows are judged alike, each for
    itself; a null source is no host; an empty table stays empty; a long text is judged whole.
    """
    found = quality.quality_rules(apart(docs)).where("kept")
    return found.select(*back(found, docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; ``n_chars``, if it is there, follows the text.

    All rows stay. A null text becomes the empty one; rows of one doc_id are one document to the
    count, rows without a doc_id lose lines but do not count; an empty table stays empty.
    """
    found = linededup.line_dedup(apart(docs))
    kept = found.select(*back(found, docs))
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the smallest doc_id, ids before null.

    Texts without words are one group, null ones too; of rows that share id and text one stays; an
    empty table stays empty.
    """
    found = simhash.keep_one(apart(docs))
    return found.select(*back(found, docs))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go. Null and empty texts are clean, as all are if ``benchmark`` is empty; repeated rows go or stay together."""
    found = decontaminate.benchmark_overlap(apart(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated")
    return found.select(*back(found, docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``size, source_size, target`` and ``taken``, the words taken of each, repeats counted.

    Texts without words take nothing and go; null sources are one source; where the budget ends
    among equal rows, as many of them stay as it allows. A column of ``documents`` that has one
    of the four names keeps it, and the mix's own is called ``mix_...`` then.
    """
    found = mixing.mix_sources(apart(docs)).where("taken > 0")
    own = [F.col(c).alias(f"mix_{c}" if c in docs.columns else c) for c in ("size", "source_size", "target", "taken")]
    return found.select(*back(found, docs), *own)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicate removal", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing to target weights", mixing_stage),
]

#: The near-duplicate stage's XXH64 fingerprints have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Steps are kept in the cluster's shared folder, under a new name for each run."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
