"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a slice of whole documents. Its words become symbols (the benchmark's words; anything
else only separates, and stretches too short for any phrase are left out, which no phrase can
notice). The shard's Burrows-Wheeler transform, held as a wavelet tree of ranks, is searched
backwards for all phrases at once; occurrences are located by walking to sampled suffix
positions, and their spans merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import LOWER, Words, covered, numbered, slices, texts

PHRASE_WORDS = 13
#: Benchmark words that one pass holds; a larger benchmark takes several passes over the texts.
PASS_WORDS = 2_000_000
SAMPLE = 8
#: Bytes outside [0-9A-Za-z] and non-ASCII separate words.
SEPARATORS = np.ones(256, bool)
SEPARATORS[0x30:0x3A] = SEPARATORS[0x41:0x5B] = SEPARATORS[0x61:0x7B] = SEPARATORS[0x80:] = False


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol must be the only smallest one."""
    _, rank = np.unique(symbols, return_inverse=True)
    n, step = len(symbols), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        pair = rank.astype(np.int64) * (n + 1) + after
        order = np.argsort(pair, kind="stable")
        fresh = np.zeros(n, np.int64)
        fresh[order[1:]] = pair[order[1:]] != pair[order[:-1]]
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(fresh[order])
        rank, step = new, step * 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class WaveletTree:
    """Ranks of integer symbols below 2**bits: one bit plane per bit, each stably split by the bit above."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.planes, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            ones = np.zeros(len(symbols) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.planes.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before place upto[i]."""
        low, high = np.zeros_like(upto), upto
        for ones, zeros, b in zip(self.planes, self.zeros, range(self.bits - 1, -1, -1), strict=True):
            one = ((symbol >> b) & 1).astype(bool)
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low


class FMIndex:
    """Of symbols of at least 1; 0 ends the text."""

    def __init__(self, symbols: np.ndarray):
        text = np.append(symbols, 0).astype(np.int64)
        order = suffix_array(text)
        self.bwt = text[order - 1]
        n_symbols = int(text.max()) + 1
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        self.tree = WaveletTree(self.bwt, max(1, n_symbols.bit_length()))
        self.marked = order % SAMPLE == 0
        self.mark_rank = np.cumsum(self.marked) - 1
        self.sampled = order[self.marked]

    def step(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self.less[symbol] + self.tree.rank(symbol, place)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges low:high of each phrase; phrases are rows, aligned at their last symbol."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        alive = np.flatnonzero(lengths > 0)
        for k in range(phrases.shape[1]):
            alive = alive[(lengths[alive] > k) & (high[alive] > low[alive])]
            if not len(alive):
                break
            symbol = phrases[alive, phrases.shape[1] - 1 - k]
            known = symbol < len(self.less) - 1
            high[alive[~known]] = low[alive[~known]]
            alive, symbol = alive[known], symbol[known]
            low[alive], high[alive] = self.step(symbol, low[alive]), self.step(symbol, high[alive])
        return low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (phrase, text position) of all occurrences."""
        count = high - low
        phrase = np.repeat(np.arange(len(low)), count)
        row = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        walked = np.zeros(len(row), np.int64)
        going = np.flatnonzero(~self.marked[row])
        while len(going):
            row[going] = self.step(self.bwt[row[going]], row[going])
            walked[going] += 1
            going = going[~self.marked[row[going]]]
        return phrase, self.sampled[self.mark_rank[row]] + walked


class Phrases:
    """The windows of some benchmark items, as rows of vocabulary symbols."""

    def __init__(self, items: list[str], texts_: list[str | None], size: int = PHRASE_WORDS):
        data, offsets = texts(pa.array(texts_, pa.string()))
        data = LOWER[data]
        words = Words(data, offsets, SEPARATORS)
        ids, distinct = numbered(data, words.start, words.end)
        self.items, self.size = np.array(items, object), size
        #: The benchmark's words themselves; symbol 1 is any other word.
        self.vocabulary = {w: k + 2 for k, w in enumerate(distinct.to_pylist())}
        symbols = ids.astype(np.int64) + 2
        rows: dict[tuple, set[int]] = {}
        for d in range(len(items)):
            own = symbols[words.first[d] : words.first[d + 1]].tolist()
            for i in range(max(len(own) - size + 1, min(len(own), 1))):
                rows.setdefault(tuple(own[i : i + size]), set()).add(d)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.rows = np.zeros((len(rows), size), np.int64)
        for i, r in enumerate(rows):
            self.rows[i, size - len(r) :] = r
        of_items = [sorted(x) for x in rows.values()]
        self.n_items = np.array([len(x) for x in of_items], np.int64)
        self.of_items = np.array([i for x in of_items for i in x], np.int64)
        self.shortest = int(self.lengths.min()) if rows else 0

    def symbols(self, data: np.ndarray, words: Words) -> np.ndarray:
        """Vocabulary symbol of each word, 1 where there is none: each distinct word of the shard is looked up once."""
        ids, distinct = numbered(data, words.start, words.end)
        known = self.vocabulary
        return np.array([known.get(w, 1) for w in distinct.to_pylist()], np.int64)[ids] if len(ids) else np.ones(0, np.int64)


def find_spans(column: pa.Array, phrases: Phrases) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a shard; and of all occurrences: phrase, first word, word after the last."""
    data, offsets = texts(column)
    data = LOWER[data]
    words = Words(data, offsets, SEPARATORS)
    none = np.zeros(0, np.int64)
    if not len(phrases.lengths) or not len(words.start):
        return words, none, none, none
    symbol = phrases.symbols(data, words)
    # Stretches of vocabulary words within one document, at least as long as the shortest phrase.
    inside = symbol > 1
    first = np.zeros(len(symbol) + 1, bool)
    first[words.first] = True
    begins = np.flatnonzero(inside & (~np.append(False, inside[:-1]) | first[:-1]))
    ends = np.flatnonzero(inside & (~np.append(inside[1:], False) | first[1:])) + 1
    long_enough = ends - begins >= phrases.shortest
    begins, ends = begins[long_enough], ends[long_enough]
    if not len(begins):
        return words, none, none, none
    length = ends - begins + 1  # and the separator after it
    after = np.cumsum(length)
    source = np.arange(int(after[-1])) + np.repeat(begins - (after - length), length)
    text = symbol[np.minimum(source, len(symbol) - 1)]
    text[after - 1] = 1
    index = FMIndex(text)
    phrase, at = index.locate(*index.search(phrases.rows, phrases.lengths))
    start = source[at]
    return words, phrase, start, start + phrases.lengths[phrase]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Lengths and values of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.value_lengths().to_numpy(zero_copy_only=False), column.flatten()


def per_row(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)


def merged_spans(words: Words, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Per document the merged ranges of its covered words: start, end, ... from its own first word."""
    hit = np.zeros(len(words.start) + 1, bool)
    hit[:-1] = covered(len(words.start), start, end)
    opens = np.zeros(len(hit), bool)
    opens[words.first] = True
    before = np.append(False, hit[:-1])
    begins = np.flatnonzero(hit & (~before | opens))
    ends = np.flatnonzero(before & (~hit | opens))
    doc = np.searchsorted(words.first[1:], begins, side="right")
    values = np.stack([begins, ends], 1) - words.first[doc][:, None]
    return per_row(2 * np.bincount(doc, minlength=len(words.first) - 1), pa.array(values.ravel(), pa.int32()))


def items_met(phrases: Phrases, n_docs: int, doc: np.ndarray, phrase: np.ndarray, known: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Per document the ids of the items met, sorted, with those known from an earlier pass."""
    pair = np.unique(doc * len(phrases.lengths) + phrase) if len(doc) else doc
    doc, phrase = (pair // len(phrases.lengths), pair % len(phrases.lengths)) if len(pair) else (pair, pair)
    count = phrases.n_items[phrase] if len(phrase) else phrase
    begins = np.append(0, np.cumsum(phrases.n_items))[phrase]
    which = np.repeat(begins - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    names = phrases.items[phrases.of_items[which]] if len(which) else np.zeros(0, object)
    known_counts, known_names = flat(known)
    table = pa.table({"doc": np.concatenate([np.repeat(doc, count), np.repeat(np.arange(n_docs), known_counts)]), "name": pa.concat_arrays([pa.array(names, pa.string()), known_names.cast(pa.string())])})
    table = table.group_by(["doc", "name"]).aggregate([]).sort_by([("doc", "ascending"), ("name", "ascending")]).combine_chunks()
    column = table.column("name")
    return per_row(np.bincount(table.column("doc").to_numpy(), minlength=n_docs), column.chunk(0) if column.num_chunks else pa.array([], pa.string()))


def _pass(rows: DataFrame, shared, text: str) -> DataFrame:
    """Adds the spans and items of one part of the benchmark to ``__w_words, __w_spans, __w_found``."""
    names = [c for c in rows.columns if c not in ("__w_words", "__w_spans", "__w_found")]
    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("__w_words", T.LongType()), T.StructField("__w_spans", T.ArrayType(T.IntegerType())), T.StructField("__w_found", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for batch in batches:
            for part in slices(batch, text):
                words, phrase, start, end = find_spans(part.column(text), phrases)
                doc = np.searchsorted(words.first[1:], start, side="right")
                counts, earlier = flat(part.column("__w_spans"))
                earlier = earlier.to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(words.first[:-1], counts)
                spans = merged_spans(words, np.concatenate([start, earlier[::2]]), np.concatenate([end, earlier[1::2]]))
                found = items_met(phrases, part.num_rows, doc, phrase, part.column("__w_found"))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(words.counts.astype(np.int64)), spans, found], names=schema.names)

    return rows.mapInArrow(run, schema)


def benchmark_overlap(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = PHRASE_WORDS, pass_words: int = PASS_WORDS) -> DataFrame:
    """``docs`` with ``n_words, n_hit, item_ids, spans, contaminated``.

    ``spans`` holds start, end, start, end ... of the merged ranges of word places. A null or
    empty text has no words and is clean; items without words match nothing; items without an id
    are called ``null``; repeated items count once per id. No text is shuffled: the benchmark is
    broadcast in parts of about ``pass_words`` words, one pass over the texts for each.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "n_hit", "item_ids", "spans", "contaminated", "__w_words", "__w_spans", "__w_found")]
    rows = docs.select(*kept).withColumns({"__w_words": F.lit(0).cast("long"), "__w_spans": F.array().cast("array<int>"), "__w_found": F.array().cast("array<string>")})
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.col(item_text).alias("text"))
    context, part, words = docs.sparkSession.sparkContext, [], 0

    def passed(rows: DataFrame) -> DataFrame:
        return _pass(rows, context.broadcast(Phrases([x["id"] for x in part], [x["text"] for x in part], size)), text)

    for item in items.toLocalIterator():  # holds one part at a time
        part.append(item)
        words += len(item["text"]) // 2 + 1
        if words >= pass_words:
            rows, part, words = passed(rows), [], 0
    rows = passed(rows)
    n_hit = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("__w_spans"), F.lit(1)), F.lit(2)), F.lit(0).cast("long"), lambda n, i: n + F.coalesce(F.try_element_at("__w_spans", i + 1) - F.try_element_at("__w_spans", i), F.lit(0)))
    rows = rows.select(*kept, F.col("__w_words").alias("n_words"), n_hit.alias("n_hit"), F.col("__w_found").alias("item_ids"), F.col("__w_spans").alias("spans"))
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
