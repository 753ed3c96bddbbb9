"""Near-duplicates by SimHash and multi-index hashing.

A fingerprint is cut into two 32-bit segments. Two fingerprints that differ in at most three
bits differ in at most one bit of some segment, so each fingerprint looks up the 33 values of
the Hamming ball of radius 1 around each of its segments in the table of all segments, and the
complete distance of what is met is verified inside the join. Equal fingerprints are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import slices, texts
from .shared import components, met_by, settle

SHINGLE_WORDS, MAX_BITS, SEED = 3, 3, 42
SEGMENT_BITS = 32


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of a text's word shingles; 0 if it has no word."""
    words = text.lower().split()  # bytes: A-Z, and the ASCII whitespace only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__w_fp`` (long) in place of the text; nothing is shuffled."""
    kept = [f for f in docs.schema if f.name != text]
    names = [*[f.name for f in kept], "__w_fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                data, offsets = texts(part.column(text))
                raw = data.tobytes()
                found = [fingerprint(raw[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], pa.array(found, pa.int64())], names=names)

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("__w_fp", T.LongType())]))


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of different fingerprints in ``distinct(fp)`` at ``max_bits`` or less."""
    if max_bits > 3:
        raise ValueError("balls of radius 1 around two segments find distances up to 3")
    low = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    high = F.shiftrightunsigned("fp", SEGMENT_BITS)
    table = distinct.select("fp", F.posexplode(F.array(low, high)).alias("segment", "value"))
    # A pair is met from both of its ends if their segments differ; one ball is enough.
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(SEGMENT_BITS)])
    probes = table.select(F.col("fp").alias("other"), "segment", F.explode(F.transform(flips, lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits
    met = probes.join(table.hint("merge"), (probes["segment"] == table["segment"]) & (probes["value"] == table["value"]) & (F.col("other") < F.col("fp")) & near)
    return met.select(F.col("other").alias("a"), F.col("fp").alias("b")).distinct()


def labelled(rows: DataFrame, least: Column, max_bits: int) -> DataFrame:
    """``rows(__w_fp, ...)`` with ``__w_least``, the smallest ``least`` of all rows that links lead to."""
    # All copies of a fingerprint are one node, pre-aggregated before the shuffle.
    nodes = settle(rows.groupBy(F.col("__w_fp").alias("fp")).agg(F.min(least).alias("least"), F.count("*").alias("n")))
    labels = components(links(nodes.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    nodes = settle(nodes.join(labels.hint("merge"), "fp", "left").select("fp", "least", "n", F.coalesce("label", "fp").alias("label")))
    by_label = settle(nodes.groupBy("label").agg(F.min("least").alias("__w_least"), F.count("*").alias("n")))
    named = met_by(nodes.select("fp", "label", F.col("n").alias("rows")), by_label, "label", nodes.count())
    return met_by(rows, settle(named.select(F.col("fp").alias("__w_fp"), F.col("rows").alias("n"), "__w_least")), "__w_fp", rows.count())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    ``component_id`` is the smallest doc_id that links lead to. Texts without words (null ones
    too) share fingerprint zero and link like any other; rows that repeat a doc_id keep a row
    each; a null doc_id belongs to its component but never names it unless all its members are
    null. An empty table gives none.
    """
    rows = settle(fingerprints(docs.select(doc_id, text), text))
    out = labelled(rows, F.col(doc_id), max_bits)
    return out.select(F.col(doc_id), F.lower(F.lpad(F.hex("__w_fp"), 16, "0")).alias("fingerprint"), F.col("__w_least").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: that of the smallest doc_id.

    Rows without a doc_id come after all others; of rows that share their doc_id the one whose
    columns hash smallest stays, and of rows equal in every column any. Texts are shuffled once,
    to meet what is known of them; once more only if some rows are equal in every column.
    """
    whole = F.xxhash64(*[F.col(f.name) for f in docs.schema if not isinstance(f.dataType, T.MapType)])
    rows = settle(fingerprints(docs.select(doc_id, text, whole.alias("__w_row")), text))
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("__w_row").alias("row"))
    keep = settle(labelled(rows, order, max_bits).where(order == F.col("__w_least")).select(F.col(doc_id).alias("__w_id"), F.col("__w_row").alias("__w_hash")))
    once = keep.distinct()
    found = docs.join(once.hint("merge"), (whole == F.col("__w_hash")) & docs[doc_id].eqNullSafe(F.col("__w_id")), "left_semi")
    return found if once.count() == keep.count() else found.dropDuplicates()
