"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of rows of one table at the hashes of the word and of its first
letters. Filters of several widths run over all windows of the whole text, their maxima feed a
logistic output. It is trained in numpy on a bounded sample of labelled documents, and its
threshold is calibrated for each language as told by the text's own function words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import BASE, LOWER_VALUES, Words, mix, prefix_sums, slices, span_hash, texts
from .decontaminate import SEPARATORS

#: Bounds of the training sample: documents of each class, and characters of a text. A longer text teaches by so many stretches of it, evenly from its first to its last.
SAMPLE_DOCS, SAMPLE_CHARS, STRETCHES = 1500, 32 << 10, 8
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
#: First letters (bytes) of a word that have embeddings of their own.
STEMS = (4, 5, 6)
EPOCHS, BATCH, RATE, SEED = 6, 32, 0.05, 5
#: Frequent function words, which tell a text's language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was with on as be by",
    "fr": "le la les de des du et un une que qui dans est pour par",
    "de": "der die das und ist von zu mit den dem ein eine nicht auf für",
    "es": "el la los las de del y que en un una por con para se",
}
LANGUAGES = tuple(FUNCTION_WORDS)


def held_out(doc_id: str) -> Column:
    """Whether crc32 of the id as text is 0 modulo 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    rows = [(w, k) for k, lang in enumerate(LANGUAGES) for w in FUNCTION_WORDS[lang].split()]
    data, offsets = texts(pa.array([w for w, _ in rows]))
    hashes = span_hash(prefix_sums(LOWER_VALUES[data], BASE), offsets[:-1], offsets[1:], BASE)
    votes = np.zeros((len(rows), len(LANGUAGES)), np.float32)
    votes[np.arange(len(rows)), [k for _, k in rows]] = 1
    unique, inverse = np.unique(hashes, return_inverse=True)
    summed = np.zeros((len(unique), len(LANGUAGES)), np.float32)
    np.add.at(summed, inverse, votes)
    return unique, summed / summed.sum(1, keepdims=True)


class Tokens:
    """Buckets of the words of some texts, each text followed by as many blanks as the widest filter needs."""

    def __init__(self, column: pa.Array):
        data, offsets = texts(column)
        words = Words(data, offsets, SEPARATORS)
        sums = prefix_sums(LOWER_VALUES[data], BASE)
        ids = np.empty((len(words.start), 1 + len(STEMS)), np.int32)
        for k, n in enumerate((None, *STEMS)):
            end = words.end if n is None else np.minimum(words.start + n, words.end)
            hashes = span_hash(sums, words.start, end, BASE)
            if n is None:
                whole = hashes
            ids[:, k] = (mix(hashes, 61 + k) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1
        pad = max(WIDTHS)
        n = len(offsets) - 1
        self.first = words.first + pad * np.arange(n + 1)
        self.ids = np.zeros((len(ids) + pad * n, ids.shape[1]), np.int32)  # bucket 0 stays zero
        self.ids[np.arange(len(ids)) + pad * words.doc()] = ids
        known, votes = _language_table()
        at = np.minimum(np.searchsorted(known, whole), len(known) - 1)
        hit = np.flatnonzero(known[at] == whole)
        score = np.zeros((n, len(LANGUAGES)), np.float32)
        np.add.at(score, words.doc()[hit], votes[at[hit]])
        #: The language of each text, len(LANGUAGES) where nothing tells.
        self.language = np.where(score.max(1, initial=0) > 0, score.argmax(1), len(LANGUAGES))


def gathered(found: list[str | None]) -> Tokens:
    """Tokens of many texts, hashed a slice at a time."""
    batch = pa.table({"text": pa.array(found, pa.string())})
    parts = [Tokens(part.column("text")) for part in slices(batch, "text")]
    out = parts[0]
    before = np.cumsum([0] + [len(p.ids) for p in parts])
    out.first = np.append(np.concatenate([p.first[:-1] + b for p, b in zip(parts, before, strict=False)]), before[-1])
    out.ids = np.concatenate([p.ids for p in parts])
    out.language = np.concatenate([p.language for p in parts])
    return out


@dataclass
class Network:
    table: np.ndarray
    filters: list[np.ndarray]  # per width (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    offset: np.ndarray | None = None  # per language

    def pooled(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Embeddings, and the filters' responses and maxima over each text."""
        x = self.table[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            x = x + self.table[ids[:, k]]
        responses = []
        for w in self.filters:
            n = len(x) - len(w) + 1
            z = x[:n] @ w[0]
            for j in range(1, len(w)):
                z += x[j : j + n] @ w[j]
            responses.append(z)
        # A window reaches into the next text only from a blank that follows its own text.
        pad = max(WIDTHS)
        bounds = np.stack([first[:-1], first[1:] - pad + 1], 1).ravel()[:-1]
        tops = np.concatenate([np.maximum.reduceat(z, bounds)[::2] for z in responses], axis=1)
        return x, tops + self.bias, responses

    def logit(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(first) < 2:
            return np.zeros(0)
        return np.maximum(self.pooled(ids, first)[1], 0) @ self.out + self.out_bias

    def score(self, tokens: Tokens) -> np.ndarray:
        z = self.logit(tokens.ids, tokens.first)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.offset[tokens.language], -30, 30)))


def _start(tokens: Tokens, toxic: np.ndarray, rng: np.random.Generator) -> Network:
    """The table's first column starts at each bucket's shrunk log odds in the training documents."""
    doc = np.repeat(np.arange(len(toxic)), np.diff(tokens.first))
    table = rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32)
    seen = np.unique(np.concatenate([np.unique(doc * BUCKETS + column) for column in tokens.ids.T]))
    bad, good = (np.bincount(seen % BUCKETS, toxic[seen // BUCKETS] == y, BUCKETS) for y in (1, 0))
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good + 0.5) / ((1 - toxic).sum() + 1))
    table[:, 0] = odds * (bad + good) / (bad + good + 12) / 4
    table[0] = 0
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0, :] = np.abs(f[0, 0, :]) + 0.5
    total = FILTERS * len(WIDTHS)
    return Network(table, filters, np.full(total, -0.3, np.float32), np.full(total, 0.3, np.float32), -2.0)


def _fit(net: Network, tokens: Tokens, toxic: np.ndarray, rng: np.random.Generator) -> None:
    """Adagrad on the logistic loss; only the windows that hold a maximum have gradients."""
    dense = [*net.filters, net.bias, net.out]
    grown = [np.full_like(x, 1e-2) for x in dense]
    table_grown = np.full(BUCKETS, 1e-2, np.float32)
    bias_grown = 1e-2
    for _ in range(EPOCHS):
        for batch in np.array_split(order := rng.permutation(len(toxic)), max(1, len(order) // BATCH)):
            lengths = np.diff(tokens.first)[batch]
            first = np.append(0, np.cumsum(lengths))
            rows = np.arange(first[-1]) + np.repeat(tokens.first[batch] - first[:-1], lengths)
            ids = tokens.ids[rows]
            x, tops, responses = net.pooled(ids, first)
            active = tops > 0
            p = 1 / (1 + np.exp(-np.clip(np.maximum(tops, 0) @ net.out + net.out_bias, -30, 30)))
            error = ((p - toxic[batch]) / len(batch)).astype(np.float32)
            grads = [np.zeros_like(v) for v in dense]
            grads[-1] = np.maximum(tops, 0).T @ error
            back = np.where(active, error[:, None] * net.out, 0)
            grads[-2] = back.sum(0)
            at_ids, at_grad = [], []
            for k, (w, z) in enumerate(zip(net.filters, responses, strict=True)):
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                place = np.stack([z[s : e - max(WIDTHS) + 1].argmax(0) + s for s, e in zip(first[:-1], first[1:], strict=True)])
                for j in range(len(w)):
                    seen = x[place + j]  # (documents, filters, DIM)
                    grads[k][j] = np.einsum("bf,bfd->df", own, seen)
                    at_ids.append(ids[place + j].reshape(-1, ids.shape[1]))
                    at_grad.append((own[:, :, None] * w[j].T[None]).reshape(-1, DIM))
            for v, g, a in zip(dense, grads, grown, strict=True):
                a += g * g
                v -= RATE * g / np.sqrt(a)
            bias_grown += float(error.sum()) ** 2
            net.out_bias -= RATE * float(error.sum()) / bias_grown**0.5
            which, grad = np.concatenate(at_ids), np.concatenate(at_grad)
            bucket, inverse = np.unique(which, return_inverse=True)
            total = np.zeros((len(bucket), DIM), np.float32)
            np.add.at(total, inverse.ravel(), np.repeat(grad, which.shape[1], axis=0))
            table_grown[bucket] += (total * total).mean(1)
            net.table[bucket] -= RATE * total / np.sqrt(table_grown[bucket])[:, None]
            net.table[0] = 0


def _calibrate(net: Network, tokens: Tokens, toxic: np.ndarray, weight: np.ndarray) -> None:
    """Sets scale and offsets so that score 0.5 is, for each language, the threshold of best F1."""
    z = net.logit(tokens.ids, tokens.first)

    def threshold(chosen: np.ndarray) -> float:
        order = np.argsort(-z[chosen], kind="stable")
        zs, y, w = z[chosen][order], toxic[chosen][order], weight[chosen][order]
        hit, shown = np.cumsum(w * y), np.cumsum(w)
        f1 = 2 * hit / (shown + (w * y).sum())
        best = int(f1.argmax())
        low = zs[best + 1] if best + 1 < len(zs) else zs[best] - 1
        return float((zs[best] + low) / 2)

    overall = threshold(np.arange(len(z)))
    net.scale = 1.0
    net.offset = np.full(len(LANGUAGES) + 1, -overall)
    for k in range(len(LANGUAGES)):
        own = np.flatnonzero(tokens.language == k)
        if toxic[own].sum() >= 20 and (1 - toxic[own]).sum() >= 20:
            net.offset[k] = -threshold(own)


def train(found: list[tuple[str | None, int]], counts: dict[int, int]) -> Network | None:
    """A network from (text, label) rows; ``counts`` are all labelled rows by label. None without rows of both labels."""
    toxic = np.array([y for _, y in found], np.float32)
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    rng = np.random.default_rng(SEED)
    share = rng.random(len(toxic)) < 0.25  # for calibration
    if len(toxic) < 400:
        share[:] = False
    column = [t for t, _ in found]
    own = gathered([t for t, s in zip(column, share, strict=True) if not s])
    net = _start(own, toxic[~share], rng)
    _fit(net, own, toxic[~share], rng)
    tuned = gathered([t for t, s in zip(column, share, strict=True) if s]) if share.any() else own
    y = toxic[share] if share.any() else toxic
    weight = np.where(y == 1, counts[1] / max(1, (toxic == 1).sum()), counts[0] / max(1, (toxic == 0).sum()))
    _calibrate(net, tuned, y, weight)
    return net


def excerpt(text: str, most: int) -> Column:
    """A text of at most ``most`` characters as it is; of a longer one STRETCHES stretches, evenly from its first to its last character, a line each."""
    size, piece = F.char_length(text), max(most // STRETCHES, 1)
    start = lambda k: F.floor(k * (size - piece) / (STRETCHES - 1)).cast("int") + 1
    parts = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda k: F.substring(F.col(text), start(k), F.lit(piece)))
    return F.when(size <= most, F.col(text)).otherwise(F.array_join(parts, "\n"))


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int, chars: int) -> tuple[list[tuple], dict[int, int]]:
    """At most ``sample`` labelled texts of each class, the first by a hash of the id, none held out; each text once, long ones as excerpts of ``chars`` characters."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(doc_id).agg(F.max(label).cast("int").alias("y"))
    counts = {0: 0, 1: 0} | {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ids = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64(doc_id), doc_id).limit(sample)
        ids = part if ids is None else ids.union(part)
    # At most 2 * sample ids: a side of proven size.
    rows = docs.select(doc_id, excerpt(text, chars).alias(text)).join(F.broadcast(ids), doc_id).groupBy(doc_id).agg(F.min(text).alias("t"), F.first("y").alias("y"))
    # Copies would count a wrong label as often as there are of them; of a text's labels the more frequent one holds.
    texts_ = rows.groupBy("t").agg((F.avg("y") > 0.5).cast("int").alias("y"), F.min(F.xxhash64(doc_id)).alias("at"))
    return [(r["t"], r["y"]) for r in texts_.orderBy("at", "t").collect()], counts


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """``docs`` with ``held_out, score, predicted``.

    Learns from at most ``sample`` labelled documents of each class that are not held out, equal
    texts once, and from their texts only; of a text of more than ``sample_chars`` characters from
    stretches over its whole length. Every text is scored whole, however long. Null and empty texts get the score of no words; without labels of
    both classes every score is 0; repeated rows score alike; an empty table stays empty.
    """
    net = train(*labelled_sample(docs, labels, doc_id, text, label, sample, sample_chars))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for part in slices(batch, text):
                score = np.zeros(part.num_rows) if net is None else net.score(Tokens(part.column(text)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(score.astype(float))], names=schema.names)

    scored = docs.select(*kept).mapInArrow(run, schema)
    return scored.select(*kept, held_out(doc_id).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
