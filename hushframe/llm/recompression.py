"""Substring dedup by recompression of word sequences.

Rounds of Spark name the words of all documents, then again and again their runs and pairs: the
symbols are split into left and right ones, and each run of one symbol, and each pair of a left
run and a right one, becomes a symbol of its own. A bucket names what all blocks send it and
compares it as it is, so a name stands for one content everywhere, and equal passages have equal
symbols inside, whatever surrounds them. What only one document has gets no name. A window all of
whose inner symbols are shared reveals a possible repeat, and only for such windows the next round
names anything; those left at the end are compared as sequences of named words, and the ones that
also start in a document of smaller id cover the words to remove.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrowtext import BASE, BYTE_VALUES, Words, mix, numbered, prefix_sums, span_hash, texts
from .repeats import NO_DOC, PIECE_BYTES, Blocks, answered, bits, edges, stretches, unbits, window_flags
from .shared import settle

WINDOW, ROUNDS = 50, 3
#: Kinds of messages: words, then one for each round; windows, and what a block tells itself.
WORD, WHOLE, ECHO = 0, 100, 101
#: A word's bytes are sent after their number in this many bytes.
LENGTH = "<u4"


def narrow(values: np.ndarray) -> bytes:
    """Numbers in as few bytes each as all of them fit in; the first byte tells how many."""
    most = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes((width,)) + values.astype(f"<u{width}").tobytes()


def narrow_ids(ids: np.ndarray) -> bytes:
    """The same for document ids, which may be negative."""
    width = 4 if not len(ids) or (ids.min() >= -(1 << 31) and ids.max() < 1 << 31) else 8
    return bytes((width,)) + ids.astype(f"<i{width}").tobytes()


def wide(payload: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    """The ``n`` numbers at place ``at``, and the place after them."""
    width = payload[at]
    return np.frombuffer(payload, f"<u{width}", n, at + 1).astype(np.uint64), at + 1 + n * width


def several(inverse: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Which of n things two documents or more have, by the things' occurrences."""
    low, high = np.full(n, NO_DOC), np.full(n, -1)
    np.minimum.at(low, inverse, docs)
    np.maximum.at(high, inverse, docs)
    return high > low


def names_of(alive: np.ndarray) -> np.ndarray:
    """1, 2, ... for what is alive, 0 for the rest."""
    return np.where(alive, np.cumsum(alive), 0)


def merge_words(payloads: list[bytes], bucket: int) -> list[bytes]:
    """Per run the local names of its words: the same for equal bytes, 0 for a word of one document."""
    counts = [int.from_bytes(p[:4], "little") for p in payloads]
    both = np.concatenate([unbits(p[4 : 4 + -(-n // 8)], n) for p, n in zip(payloads, counts, strict=True)])
    at = [4 + -(-n // 8) for n in counts]
    length = np.concatenate([np.frombuffer(p, LENGTH, n, a) for p, n, a in zip(payloads, counts, at, strict=True)]).astype(np.int64)
    data = np.frombuffer(b"".join(p[a + 4 * n :] for p, n, a in zip(payloads, counts, at, strict=True)), np.uint8)
    ends = np.cumsum(length)
    ids, distinct = numbered(data, ends - length, ends)
    return named(ids.astype(np.int64), len(distinct), both, counts)


def named(inverse: np.ndarray, n: int, both: np.ndarray, counts: list[int]) -> list[bytes]:
    alive = np.bincount(inverse, weights=1 + both, minlength=n) > 1
    name = names_of(alive)[inverse].astype(np.uint64)
    cuts = np.cumsum([0, *counts])
    return [narrow(name[s:e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


def merge_pairs(payloads: list[bytes], bucket: int) -> list[bytes]:
    """Per run the local names of its runs and pairs, each given as two symbols and their numbers."""
    counts = [int.from_bytes(p[:4], "little") for p in payloads]
    both = np.concatenate([unbits(p[4 : 4 + -(-n // 8)], n) for p, n in zip(payloads, counts, strict=True)])
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for p, n in zip(payloads, counts, strict=True):
        at = 4 + -(-n // 8)
        for column in columns:
            part, at = wide(p, n, at)
            column.append(part)
    keys = [np.concatenate(c) for c in columns]
    inverse, first = distinct_rows(keys)
    return named(inverse, len(first), both, counts)


def distinct_rows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its equals in sorted order, and where each of these is first met."""
    order = np.lexsort(columns[::-1])
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[order][1:] != c[order][:-1]
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(fresh) - 1
    return inverse, order[fresh]


class Sequence:
    """The words of a block as symbols, renamed round by round, and the windows that are still possible repeats."""

    def __init__(self, table: pa.Table, size: int, rounds: int, buckets: int):
        self.size, self.rounds, self.buckets = size, rounds, np.uint64(buckets)
        self.data, self.offsets = texts(table.column("text"))
        self.docs = table.column("doc").to_numpy()
        self.words = Words(self.data, self.offsets)
        self.word_doc = self.docs[self.words.doc()]
        self.starts = np.flatnonzero(self.words.window_starts(size))
        self.ids, self.distinct = numbered(self.data, self.words.start, self.words.end)

    # --- words

    def word_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the distinct words in order of their buckets, and the buckets."""
        data, offsets = texts(self.distinct)
        used = np.flatnonzero(np.bincount(self.ids, minlength=len(self.distinct)))
        hashes = span_hash(prefix_sums(BYTE_VALUES[data], BASE), offsets[:-1], offsets[1:], BASE)[used]
        bucket = (mix(hashes, 3) % self.buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return used[order], bucket[order]

    def word_messages(self, block: int) -> list[tuple]:
        if not len(self.ids):
            return []
        used, bucket = self.word_keys()
        both = several(self.ids, self.word_doc, len(self.distinct))[used]
        data, offsets = texts(self.distinct)
        start, length = offsets[used], np.diff(offsets)[used]
        ends = np.cumsum(length)
        flat = data[np.arange(int(ends[-1])) + np.repeat(start - (ends - length), length)]
        return [(WORD, b, block, (e - s).to_bytes(4, "little") + bits(both[s:e]) + length[s:e].astype(LENGTH).tobytes() + flat[ends[s] - length[s] : ends[e - 1]].tobytes()) for b, s, e in stretches(bucket)]

    def global_names(self, kind: int, bucket: np.ndarray, replies: dict) -> np.ndarray:
        """Names that no other bucket or round gives; 0 where there is none."""
        out = np.zeros(len(bucket), np.uint64)
        for b, s, e in stretches(bucket):
            local, _ = wide(replies[(kind, b)], e - s, 0)
            out[s:e] = np.where(local > 0, (local * self.buckets + np.uint64(b)) * np.uint64(self.rounds + 1) + np.uint64(kind), np.uint64(0))
        return out

    def read_words(self, replies: dict) -> None:
        """Words become symbols; windows with a word of one document go."""
        name = np.zeros(len(self.distinct), np.uint64)
        if len(self.ids):
            used, bucket = self.word_keys()
            name[used] = self.global_names(WORD, bucket, replies)
        self.symbol = name[self.ids] if len(self.ids) else np.zeros(0, np.uint64)
        self.opens = np.zeros(len(self.symbol), bool)
        self.opens[self.words.first[:-1][self.words.counts > 0]] = True
        self.doc = self.word_doc
        self.alive = np.arange(len(self.starts))
        self.low, self.high = self.starts.copy(), self.starts + self.size
        self.form = Form(len(self.starts))
        self.drop_windows()

    def drop_windows(self) -> None:
        """Windows with an inner symbol that has no name go."""
        lone = np.append(0, np.cumsum(self.symbol == 0))
        keep = lone[self.high] == lone[self.low]
        self.alive, self.low, self.high = self.alive[keep], self.low[keep], self.high[keep]
        self.form.keep(keep)

    # --- rounds

    def pair_up(self, round_: int) -> None:
        """Runs, and pairs of a left and a right one, as four numbers each: symbol and length, twice; which of them windows need."""
        symbol, opens = self.symbol, self.opens
        begin = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]) | opens) if len(symbol) else np.zeros(0, np.int64)
        length = np.diff(np.append(begin, len(symbol))).astype(np.uint64)
        run, run_opens = symbol[begin], opens[begin]
        of_run = np.cumsum(np.bincount(begin, minlength=len(symbol))) - 1
        right = (mix(run ^ mix(length, 21), 31 + round_) & np.uint64(1)).astype(bool)
        named_run = run > 0
        joined = np.zeros(len(run), bool)  # with the run before
        joined[1:] = right[1:] & ~right[:-1] & ~run_opens[1:] & named_run[1:] & named_run[:-1]
        first = np.flatnonzero(~joined)
        two = np.append(joined[1:], False)[first] if len(first) else np.zeros(0, bool)
        second = np.minimum(first + 1, len(run) - 1)
        zero = np.uint64(0)
        self.parts = [run[first], length[first], np.where(two, run[second], zero), np.where(two, length[second], zero)]
        self.opens, self.doc = run_opens[first], self.doc[begin][first]
        of_pair = np.cumsum(np.bincount(first, minlength=len(run))) - 1
        # Of the windows: the runs at either edge may go on outside, and an edge run may pair with one outside.
        some = self.low < self.high
        self.leave(round_, some, run, length, right, begin, of_run)
        low, high = of_run[np.where(some, self.low, 0)] + 1, of_run[np.where(some, self.high, 1) - 1]
        some &= low < high
        safe = np.where(some, low, 0), np.where(some, high, 1)
        low, high = safe[0] + right[safe[0]], safe[1] - ~right[safe[1] - 1]
        some &= low < high
        self.low = np.where(some, of_pair[np.minimum(low, max(len(run) - 1, 0))], 0)
        self.high = np.where(some, of_pair[np.maximum(high, 1) - 1] + 1, 0)
        need = np.zeros(len(first) + 1, np.int64)
        np.add.at(need, self.low, 1)
        np.add.at(need, self.high, -1)
        to_name = two | (self.parts[1] > 1)
        self.asked = np.flatnonzero((np.cumsum(need[:-1]) > 0) & to_name & (self.parts[0] > 0))
        self.symbol = np.where(to_name, zero, self.parts[0])

    def leave(self, round_: int, some: np.ndarray, run: np.ndarray, length: np.ndarray, right: np.ndarray, begin: np.ndarray, of_run: np.ndarray) -> None:
        """The runs that leave each window in this round go into its form: the outermost as far as they lie in it, and the next where it may pair with them."""
        if not len(run):
            return
        low, high = np.where(some, self.low, 0), np.where(some, self.high, 1)
        a, b = of_run[low], of_run[high - 1]
        end = begin + length.astype(np.int64)
        inner, i, j = b - a - 1, np.minimum(a + 1, len(run) - 1), np.maximum(b - 1, 0)
        edges = (
            (a, np.minimum(end[a], high) - low, some),
            (b, high - np.maximum(begin[b], low), some & (a < b)),
            (i, length[i], some & (inner > 0) & (right[i] | (inner == 1))),
            (j, length[j], some & (inner > 1) & ~right[j]),
        )
        for k, (at, n, there) in enumerate(edges):
            self.form.add(np.where(there, run[at], np.uint64(0)), np.where(there, n, 0).astype(np.uint64), 100 + 4 * round_ + k)

    def finished(self) -> Form:
        """The windows' forms with the symbols that were never left, in order."""
        left = self.high - self.low
        for k in range(int(left.max()) if len(left) else 0):
            there = left > k
            at = np.where(there, self.low + k, 0)
            self.form.add(np.where(there, self.symbol[at], np.uint64(0)), there.astype(np.uint64), 1000 + k, there)
        return self.form

    def pair_keys(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The distinct runs and pairs asked for, their buckets in order, and for each one asked its place among them."""
        asked = [p[self.asked] for p in self.parts]
        inverse, first = distinct_rows(asked)
        keys = [p[first] for p in asked]
        mixed = np.zeros(len(first), np.uint64)
        for k in keys:
            mixed = mix(mixed ^ k, 5)
        bucket = (mixed % self.buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return [k[order] for k in keys], bucket[order], place[inverse]

    def pair_messages(self, kind: int, block: int) -> list[tuple]:
        keys, bucket, inverse = self.pair_keys()
        both = several(inverse, self.doc[self.asked], len(bucket))
        return [(kind, b, block, (e - s).to_bytes(4, "little") + bits(both[s:e]) + b"".join(narrow(k[s:e]) for k in keys)) for b, s, e in stretches(bucket)]

    def read_pairs(self, kind: int, replies: dict) -> None:
        if len(self.asked):
            _, bucket, inverse = self.pair_keys()
            self.symbol[self.asked] = self.global_names(kind, bucket, replies)[inverse]
        self.drop_windows()

    def read(self, upto: int, replies: dict) -> None:
        """All rounds up to ``upto`` whose names have come."""
        self.read_words(replies)
        for r in range(1, upto + 1):
            self.pair_up(r)
            self.read_pairs(r, replies)


class Form:
    """What each window was taken apart into: runs left at its edges by round, and its last symbols; 128 bits over the numbers of these."""

    def __init__(self, n: int):
        self.one, self.two = np.full(n, 1, np.uint64), np.full(n, 2, np.uint64)

    def keep(self, which: np.ndarray) -> None:
        self.one, self.two = self.one[which], self.two[which]

    def add(self, symbol: np.ndarray, n: np.ndarray, salt: int, where: np.ndarray | None = None) -> None:
        for name, more in (("one", 0), ("two", 5000)):
            before = getattr(self, name)
            after = mix(before * np.uint64(0x9E3779B97F4A7C15) ^ mix(mix(symbol, salt + more) ^ n, 7 + more), salt + more + 1)
            setattr(self, name, after if where is None else np.where(where, after, before))


class Repeats:
    """A block's windows by their forms, with the smallest document of the block that has each."""

    def __init__(self, form: Form, docs: np.ndarray, buckets: int):
        one, two = form.one, form.two
        bucket = (mix(one, 13) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((docs, two, one, bucket))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        at = order[fresh]
        self.one, self.two, self.least = one[at], two[at], docs[at]
        self.stretches = stretches(bucket[at])
        self.inverse = np.empty(len(order), np.int64)
        self.inverse[order] = np.cumsum(fresh) - 1
        #: The block itself has it in a smaller document.
        self.within = self.least[self.inverse] < docs

    def told(self, alive: np.ndarray) -> bytes:
        """For the block itself: which windows these are, their numbers, and where the answers of each bucket begin."""
        sizes = np.array([(b, e - s) for b, s, e in self.stretches], "<i8").tobytes()
        return len(self.stretches).to_bytes(4, "little") + sizes + bits(alive) + bits(self.within) + narrow(self.inverse)

    @staticmethod
    def smaller(told: bytes, n: int, replies: dict) -> tuple[np.ndarray, np.ndarray]:
        """Of a block of n windows: which were told of, and of these which start in a document with a smaller id too."""
        k = int.from_bytes(told[:4], "little")
        at, flags = 4 + 16 * k, []
        for bucket, size in np.frombuffer(told, "<i8", 2 * k, 4).reshape(-1, 2).tolist():
            flags.append(unbits(replies[(WHOLE, bucket)], size))
        alive = unbits(told[at : at + -(-n // 8)], n)
        at, m = at + -(-n // 8), int(alive.sum())
        within = unbits(told[at : at + -(-m // 8)], m)
        inverse, _ = wide(told, m, at + -(-m // 8))
        return alive, np.concatenate(flags)[inverse.astype(np.int64)] | within

    def sent(self, block: int) -> list[tuple]:
        return [(WHOLE, b, block, (e - s).to_bytes(4, "little") + self.one[s:e].astype("<u8").tobytes() + self.two[s:e].astype("<u8").tobytes() + narrow_ids(self.least[s:e])) for b, s, e in self.stretches]

    @staticmethod
    def merge(payloads: list[bytes], _: int) -> list[bytes]:
        sizes = [int.from_bytes(p[:4], "little") for p in payloads]
        one, two = (np.concatenate([np.frombuffer(p, "<u8", n, 4 + 8 * k * n) for p, n in zip(payloads, sizes, strict=True)]) for k in (0, 1))
        least = np.concatenate([np.frombuffer(p, f"<i{p[4 + 16 * n]}", n, 5 + 16 * n) for p, n in zip(payloads, sizes, strict=True)]).astype(np.int64)
        order = np.lexsort((two, one))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        all_least = np.minimum.reduceat(least[order], np.flatnonzero(fresh))
        smaller = np.empty(len(order), bool)
        smaller[order] = all_least[np.cumsum(fresh) - 1] < least[order]
        cuts = np.cumsum([0, *sizes])
        return [bits(smaller[s:e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


def duplicate_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW, rounds: int = ROUNDS, **sizes: int) -> DataFrame:
    """Per row of ``docs``: its id, ``n_words``, ``n_removed``, ``spans`` (start, end, ... in words) and ``kept_text``.

    Removes each word that a window of ``size`` words covers which also starts in a document
    of smaller id; kept words are joined by one space. Ids are integers; null and empty texts
    have no words; documents without an id are larger than all others and none of them removes
    from another; rows that repeat an id do not remove from each other; an empty table gives none.
    Words, runs and pairs are compared as they are; windows by 128 bits over the symbols and edges
    that ``rounds`` (one or more) took them apart into, of which at 10^13 windows fewer than 10^-12
    pairs are taken for one by chance.
    Texts of any length are cut into pieces of about ``piece`` bytes.
    """
    if rounds < 1:
        raise ValueError("without a round there are no symbols to compare windows by")
    length = sizes.get("piece", PIECE_BYTES)

    def cuts(data: np.ndarray) -> list[tuple[int, int, int]]:
        words = Words(data, np.array([0, len(data)]))
        n, out, k = len(words.start), [], 0
        while k == 0 or k + size <= n:
            after = max(int(np.searchsorted(words.start, words.start[k] + length)), k + 1) if n else 0
            last = min(after + size - 1, n)
            out.append((int(words.start[k]), int(words.end[last - 1]), k) if n else (0, 0, 0))
            k = max(after, 1)
        return out

    blocks = Blocks(docs, doc_id, text, cuts, **sizes)
    buckets = blocks.buckets
    number = lambda table: table.column("block")[0].as_py()

    def words(table: pa.Table) -> list[tuple]:
        return Sequence(table, size, rounds, buckets).word_messages(number(table))

    def round_of(r: int):
        def ask(table: pa.Table, replies: dict) -> list[tuple]:
            own = Sequence(table, size, rounds, buckets)
            own.read(r - 1, replies)
            own.pair_up(r)
            return own.pair_messages(r, number(table))

        return ask

    def windows(table: pa.Table, replies: dict) -> list[tuple]:
        own, block = Sequence(table, size, rounds, buckets), number(table)
        own.read(rounds, replies)
        if not len(own.alive):
            return []
        found = Repeats(own.finished(), own.word_doc[own.starts[own.alive]], buckets)
        flags = np.zeros(len(own.starts), bool)
        flags[own.alive] = True
        return [(ECHO, block, block, found.told(flags)), *found.sent(block)]

    schema = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("kept_text", T.BinaryType())])

    def spans_of(table: pa.Table, replies: dict) -> list[np.ndarray]:
        echo = replies.get((ECHO, number(table)))
        if echo is None:
            return [np.zeros(0, np.int64)] * table.num_rows
        data, offsets = texts(table.column("text"))
        found = Words(data, offsets)
        starts = np.flatnonzero(found.window_starts(size))
        alive, again = Repeats.smaller(echo, len(starts), replies)
        return edges(window_flags(starts[alive][again], len(found.start), size), found.first)

    asked = [settle(answered(blocks.send(words), {WORD: merge_words}))]
    for r in range(1, rounds + 1):
        asked.append(settle(answered(blocks.ask_again(asked, round_of(r)), {r: merge_pairs})))
    found = settle(answered(blocks.ask_again(asked, windows), {WHOLE: Repeats.merge}))
    return blocks.cut([found], spans_of, without_words, schema)


def without_words(column: pa.Array, spans: list[np.ndarray]) -> list[pa.Array]:
    """``n_words, n_removed, spans, kept_text`` of texts without their spans of words."""
    data, offsets = texts(column)
    words = Words(data, offsets)
    gone = np.array([int((s[1::2] - s[::2]).sum()) for s in spans], np.int64)
    raw, kept = data.tobytes(), []
    for d, s in enumerate(spans):
        own = raw[offsets[d] : offsets[d + 1]].split()
        for a, b in s.reshape(-1, 2)[::-1].tolist():
            del own[a:b]
        kept.append(b" ".join(own))
    return [pa.array(words.counts.astype(np.int64)), pa.array(gone), pa.array([s.tolist() for s in spans], pa.list_(pa.int64())), pa.array(kept, pa.binary())]
