"""Quality rules whose failures are also judged by host.

Each text gets its word statistics and base verdict; failures are summed by host, a host's rate
is shrunk to a beta prior fitted to all hosts, and documents of hosts that fail nearly always
are rejected with those that fail themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import SPACE, Words, counted, covered, numbered, per_doc, pieces, slices, texts
from .shared import joined_by, null_safe, settle

#: The symbols that n_symbols counts.
SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A host whose shrunk failure rate reaches this is rejected.
MAX_HOST_RATE = 0.9


#: Triples of word numbers below this fit one 63-bit number.
TRIPLE = 1 << 21


def _repeats(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys their document holds more than once, and which it held before; documents are in order."""
    order = np.argsort(keys, kind="stable")  # equal keys stay in order, those of a document together
    same = (keys[order][1:] == keys[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    often, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] = same
    often[order[:-1]] = same
    return often | again, again


def _triples(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for the three words from each start, the same exactly for equal words."""
    ids = ids.astype(np.int64)
    most = int(ids.max(initial=0)) + 1
    pair = ids[starts] * most + ids[starts + 1]
    if most > TRIPLE:  # a very long text: pairs are numbered anew
        pair = np.unique(pair, return_inverse=True)[1]
        if int(pair.max(initial=0) + 1) * most >= 1 << 63:
            raise ValueError("a text of more than 2^32 words")
    return pair * most + ids[starts + 2]


def text_stats(column: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = texts(column)
    words = Words(data, offsets)
    symbol, char = np.zeros(256, bool), ~SPACE
    symbol[list(SYMBOLS)] = True
    char[0x80:0xC0] = False  # the later bytes of a character
    stats = {"n_words": words.counts, "word_chars": counted(data, offsets, char), "n_symbols": counted(data, offsets, symbol)}

    breaks = np.concatenate([np.flatnonzero(data[a:b] == 0x0A) + a for a, b in pieces(len(data))] or [np.zeros(0, np.int64)])
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_doc = np.searchsorted(offsets[1:], line_start, side="right")
    line_end = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, line_start)], offsets[line_doc + 1])
    has_word = np.searchsorted(words.start, line_end) > np.searchsorted(words.start, line_start)
    line_start, line_end, line_doc = line_start[has_word], line_end[has_word], line_doc[has_word]
    _, again = _repeats(numbered(data, line_start, line_end)[0], line_doc)
    stats["n_dup_lines"] = np.bincount(line_doc[again], minlength=len(offsets) - 1)

    starts = np.flatnonzero(words.window_starts(3))
    often, _ = _repeats(_triples(numbered(data, words.start, words.end)[0], starts), words.doc()[starts])
    again = starts[often]
    stats["n_repeat_words"] = per_doc(covered(len(words.start), again, again + 3), words.first)
    return stats


def with_text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five statistics and ``base_failed``; nothing is shuffled. Columns of these names are replaced."""
    kept = [f for f in docs.schema if f.name not in (*STATS, "base_failed")]
    schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in STATS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                stats = text_stats(part.column(text))
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + [pa.array(stats[c].astype(np.int64)) for c in STATS], names=[*[f.name for f in kept], *STATS])

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return docs.select(*[f.name for f in kept]).mapInArrow(run, schema).withColumn("base_failed", failed)


def host_verdicts(judged: DataFrame, host: str = "source", failed: str = "base_failed", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: ``host_key, n_docs, n_failed, host_rate, host_rejected``.

    The prior's mean is the rate over all documents; its strength follows, by the method of
    moments, from how much more the hosts' rates differ than sampling explains.
    """
    by = settle(judged.groupBy(null_safe(host).alias("host_key")).agg(F.count("*").alias("n_docs"), F.count_if(F.col(failed)).alias("n_failed")))
    docs, fails, hosts = by.agg(F.sum("n_docs"), F.sum("n_failed"), F.count("*")).first()
    mean = (fails or 0) / docs if docs else 0.0
    spread = by.agg(F.sum(F.col("n_docs") * F.pow(F.col("n_failed") / F.col("n_docs") - mean, 2))).first()[0] if docs else 0.0
    within = mean * (1 - mean)
    between = (spread / docs - within * hosts / docs) if docs else 0.0
    strength = min(max(within / between - 1, 2.0), 1000.0) if between > 0 else 1000.0
    rate = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    # Rows without a host have no neighbours to be judged by.
    return by.withColumn("host_rate", rate).withColumn("host_rejected", (F.col("host_key") != "1") & (F.col("host_rate") >= max_rate))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE, with_text: bool = True) -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``host_rate`` and ``kept``; columns of these names are replaced.

    A null text has no words and fails; a null host is never rejected as one; an empty table
    stays empty; repeated rows count and are judged each. Only hosts that are rejected, or few,
    are joined back; texts are not shuffled unless there are more hosts than may be broadcast.
    ``with_text=False`` leaves the text out, and then every text is read once instead of twice.
    """
    docs = docs.drop("host_rate", "kept")
    if with_text:
        judged, seen = with_text_stats(docs, text), with_text_stats(docs.select(text, host), text)
    else:
        judged = seen = settle(with_text_stats(docs, text).drop(text))
    hosts = settle(host_verdicts(seen.select(host, "base_failed"), host, max_rate=max_rate))
    judged = judged.withColumn("__w_host", null_safe(host))
    out = joined_by(judged, hosts.select(F.col("host_key").alias("__w_host"), "host_rate", F.col("host_rejected").alias("__w_rejected")), ["__w_host"], hosts.count())
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("__w_rejected", F.lit(False))).drop("__w_host", "__w_rejected")
