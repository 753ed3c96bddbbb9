"""Line dedup on hashes only, with native functions.

Postings (line hash, document, position) are range-partitioned by hash and document with a
secondary sort by position, so that a line found in a third of all documents spreads over many
partitions, and each partition streams its keys in order: the first occurrence of a key in each
document, and of these the first one and their number, are partial sums there, and one row per
key and partition meets the rest. What returns to the texts is a sparse bitmap of the lines to
leave out, one row per document, never lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, BROADCAST_ROWS, settle, shuffle_partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is stripped from a line's ends.
BLANKS = " \t\n\x0b\f\r"
MIN_CHARS, MIN_DOCS = 1, 10
#: Lines that one number of a bitmap stands for.
WORD_BITS = 64
#: What the second hash of a key starts from.
SECOND_HASH = 1
#: Parts of a frequent key's postings where such keys are too many to broadcast.
SALTS = 16


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z lower-cased; other letters stay as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def text_lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def postings(docs: DataFrame, doc_id: str, text: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(h, g, doc, th, at)``: the two hashes of each line's key, its row and its place."""
    key = F.transform(text_lines(text), lambda line: line_key(line))
    hashed = F.transform(key, lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit(SECOND_HASH), k).alias("g"))))
    keyed = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(F.col(text)).alias("th"), F.posexplode(hashed).alias("at", "key"))
    return keyed.where(F.col("key").isNotNull()).select("key.h", "key.g", "doc", "th", "at")


def drop_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep: str = "none") -> DataFrame:
    """``(doc, th, words)`` for documents that lose lines: a sparse bitmap ``array<struct<word, bits>>``.

    A key found in at least ``min_docs`` documents loses all its lines (``keep="none"``) or all
    but its first one by document and position (``keep="first"``).
    """
    key = ["h", "g"]
    # The partitions' borders never part a key's lines in one document.
    sorted_ = settle(postings(docs, doc_id, text, min_chars)).repartitionByRange(shuffle_partitions(docs.sparkSession), *key, "doc").sortWithinPartitions(*key, "doc", "th", "at")
    firsts = sorted_.groupBy(*key, "doc").agg(F.min(F.struct("th", "at")).alias("place"))
    keys = firsts.groupBy(*key).agg(F.count("doc").alias("docs"), F.min(F.struct("doc", "place.th", "place.at")).alias("place"))
    frequent = settle(keys.where(F.col("docs") >= min_docs).select(*key, "place"))
    lost = sorted_
    if frequent.count() <= BROADCAST_ROWS:
        lost = lost.join(F.broadcast(frequent), key)
    else:  # one line may have a third of all postings: they are dealt by salt too, and each frequent key goes to every salt
        salted = settle(frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
        lost = lost.withColumn("salt", F.pmod(F.xxhash64("doc", "at"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [*key, "salt"]).drop("salt")
    if keep == "first":
        lost = lost.where(~F.struct("doc", "th", "at").eqNullSafe(F.col("place")))
    word = F.floor(F.col("at") / WORD_BITS).cast("int")
    bits = lost.groupBy("doc", "th", word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, at % {WORD_BITS})")).alias("bits"))
    return bits.groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep: str = "none") -> DataFrame:
    """``docs`` with ``text`` cut to the lines that stay, and ``n_lines``, ``n_dropped``.

    A null text is one empty line and becomes the empty text; keys under ``min_chars`` code
    points never lose a line; rows that repeat a doc_id are one document to the count, and share
    a bitmap if their texts are equal; rows without a doc_id lose lines but do not count; an
    empty table stays empty. Keys are told apart by 128 bits of hash: among 10^12 different
    lines the odds of one pair taken for one are about 10^-15. Bitmaps are broadcast if their
    measured size allows it, else they meet the texts in a shuffle.
    """
    lost = settle(drop_bitmaps(docs, doc_id, text, min_chars, min_docs, keep))
    total = lost.agg(F.count("*"), F.sum(F.size("words"))).first()
    small = total[0] * 48 + (total[1] or 0) * 12 <= BROADCAST_BYTES
    lost = lost.select(F.col("doc").alias("__w_doc"), F.col("th").alias("__w_th"), F.col("words").alias("__w_words"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*kept).withColumn("__w_text_hash", F.xxhash64(F.col(text)))
    rows = rows.join(F.broadcast(lost) if small else lost.hint("merge"), rows[doc_id].eqNullSafe(F.col("__w_doc")) & (F.col("__w_text_hash") == F.col("__w_th")), "left")
    zeros = lambda acc, x: F.concat(acc, F.array_repeat(F.lit(0).cast("long"), x["word"] - F.size(acc)), F.array(x["bits"]))
    rows = rows.withColumn("__w_dense", F.when(F.col("__w_words").isNotNull(), F.aggregate("__w_words", F.array().cast("array<long>"), zeros)))
    bit = lambda i: F.coalesce(F.get("__w_dense", F.floor(i / WORD_BITS).cast("int")), F.lit(0).cast("long"))
    shifted = lambda i: F.call_function("shiftrightunsigned", bit(i), i % WORD_BITS).bitwiseAND(F.lit(1).cast("long")) == 0
    whole = F.coalesce(F.col(text), F.lit(""))
    n_lines = (F.char_length(whole) - F.char_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_dropped = F.coalesce(F.aggregate("__w_words", F.lit(0).cast("long"), lambda n, x: n + F.bit_count(x["bits"])), F.lit(0).cast("long"))
    left = F.when(F.col("__w_dense").isNull(), whole).otherwise(F.array_join(F.filter(text_lines(text), lambda _, i: shifted(i)), "\n"))
    return rows.select(*[left.alias(text) if c == text else c for c in kept], n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
