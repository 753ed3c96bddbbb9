"""Suffix-array dedup by common-prefix-aware distributed merge sort.

Suffixes are sampled where a hash of their first bytes is smallest among their neighbours, so
every window of 50 bytes holds a sampled suffix at a place that its own content fixes. A first
exchange tells which of them share their first 16 bytes with another document (the distributed
duplicate detection of prefix-doubling string sort); only those are sorted. Splitters, chosen from
a sample of these prefixes, give each bucket a range of the order. Each block sends sorted,
front-coded runs of distinct suffixes with what stands before them; a bucket merges its runs with
a loser tree whose matches go by known common prefixes and never compare a byte twice; in the
merged order the suffixes that share a prefix stand together, and each run is told which of its
windows also start in a document of smaller id. Contents are compared, never hashes.

A prefix met very often (a passage in a third of all documents) would gather suffixes without
bound; there all suffixes are sorted instead of the sampled ones, each for the one window that it
starts, so that what gathers is one row a block for each distinct window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import BASE, BYTE_VALUES, mix, prefix_sums, rolling_hash, texts
from .repeats import BLOCK_BYTES, PIECE_BYTES, Blocks, Flags, answered, edges, stretches, window_flags
from .shared import ranked, settle

WINDOW, PREFIX = 50, 16
GRAM, RUN, SAMPLE, ECHO = 0, 1, 2, 3
#: Ranges of the order at most; beyond that number of buckets, those of a range are dealt by a hash of the prefix.
MOST_RANGES = 1 << 16
#: Sampled prefixes for each splitter, about.
OVERSAMPLE = 16
#: Anchors whose surroundings are gathered at a time.
CHUNK = 1 << 16


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    while known + 8 <= n and a[known : known + 8] == b[known : known + 8]:
        known += 8
    while a[known] == b[known]:
        known += 1
    return known


def merged_runs(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """Sorted runs of (key, common prefix with the one before) merged: (key, common prefix, run).

    A loser tree: each inner node keeps the run that lost there and the common prefix of its key
    with that of the winner it lost to. Of two runs, the one with the longer common prefix with
    the last winner is smaller; only equal ones are compared, from that length on.
    """
    n = len(runs)
    size = 1 << max(0, (n - 1).bit_length())
    keys: list[bytes | None] = [None] * size
    prefix = [0] * size
    loser = [0] * size

    def pull(r: int) -> int:
        """Moves run r on; the common prefix of its new key with its old one."""
        found = next(runs[r], None) if r < n else None
        if found is None:
            keys[r] = None
            return -1
        keys[r] = found[0]
        return found[1]

    def match(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; the loser's prefix becomes that with the winner."""
        pa_, pb = prefix[a], prefix[b]
        if pa_ > pb:
            return a, b
        if pa_ < pb:
            return b, a
        x, y = keys[a], keys[b]
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        k = common(x, y, pa_)
        if x[k:] <= y[k:]:
            prefix[b] = k
            return a, b
        prefix[a] = k
        return b, a

    for r in range(size):
        prefix[r] = min(pull(r), 0)  # nothing is known at the start; -1 marks a finished run
    winners = list(range(size))
    level = size // 2
    while level:
        following = []
        for i in range(level):
            win, lose = match(winners[2 * i], winners[2 * i + 1])
            loser[level + i] = lose
            following.append(win)
        winners, level = following, level // 2
    win, shared = winners[0], 0
    while keys[win] is not None:
        yield keys[win], shared, win
        prefix[win] = pull(win)
        node = (size + win) // 2
        while node:
            win, loser[node] = match(win, loser[node])
            node //= 2
        shared = prefix[win]


class Runs:
    """Keys of one width as sorted rows of bytes; front coding of runs of them, all at once."""

    @staticmethod
    def coded(rows: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row its common prefix with the row before (0 where a run opens), and the flags of the bytes that remain."""
        shared = np.zeros(len(rows), np.uint8)
        if len(rows) > 1:
            shared[1:] = (rows[1:] != rows[:-1]).argmax(1)
        shared[opens] = 0
        return shared, np.arange(rows.shape[1]) >= shared[:, None]

    @staticmethod
    def decoded(shared: np.ndarray, rests: np.ndarray, width: int) -> np.ndarray:
        """The rows again: each byte of a common prefix comes from the nearest row above that has its own."""
        rows = np.zeros((len(shared), width), np.uint8)
        place = np.arange(len(shared))
        own = np.arange(width) >= shared[:, None]
        rows[own] = rests
        for column in range(int(shared.max(initial=0))):
            rows[:, column] = rows[np.maximum.accumulate(np.where(own[:, column], place, 0)), column]
        return rows


class Keys:
    """The form of a sorted suffix: its first ``size`` bytes, their number, up to ``size - prefix`` bytes before it (nearest first), their number.

    Where text ends sooner, zeros fill up.
    """

    def __init__(self, size: int, prefix: int):
        self.size, self.prefix, self.most = size, prefix, size - prefix
        self.width = size + self.most + 2

    def rows(self, data: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, with_left: bool) -> np.ndarray:
        """Keys of the suffixes at ``at`` of texts ``low:high``."""
        out = np.zeros((len(at), self.width), np.uint8)
        for k in range(0, len(at), CHUNK):
            part = slice(k, k + CHUNK)
            right = at[part, None] + np.arange(self.size)
            there = right < high[part, None]
            out[part, : self.size] = np.where(there, data[np.minimum(right, len(data) - 1)], 0)
            out[part, self.size] = there.sum(1)
            if with_left:
                left = at[part, None] - 1 - np.arange(self.most)
                there = left >= low[part, None]
                out[part, self.size + 1 : -1] = np.where(there, data[np.maximum(left, 0)], 0)
                out[part, -1] = there.sum(1)
        return out

    def reach(self, key: bytes) -> tuple[int, int]:
        """Least and most bytes before the suffix at which windows around it may start."""
        return self.size - key[self.size], key[-1]

    def reaches(self, rows: np.ndarray) -> np.ndarray:
        """The same as flags: one column for each number of bytes before."""
        before = np.arange(self.most + 1)
        return (before >= self.size - rows[:, self.size].astype(np.int64)[:, None]) & (before <= rows[:, -1][:, None])


class Block:
    """Sampled suffixes of a block's texts."""

    def __init__(self, table: pa.Table, keys: Keys):
        self.keys = keys
        size, prefix = keys.size, keys.prefix
        self.data, self.offsets = texts(table.column("text"))
        self.docs = table.column("doc").to_numpy()
        n = len(self.data)
        none = np.zeros(0, np.int64)
        self.anchor = self.first = self.last = none
        self.key = np.zeros(0, np.uint64)
        if n >= size:
            # The smallest hash of a prefix among those in each window, the leftmost of equal ones.
            hashes = rolling_hash(prefix_sums(BYTE_VALUES[self.data], BASE), prefix, BASE)
            smallest = hashes & np.uint64(0xFFFFFFFF00000000)
            smallest |= np.arange(len(hashes), dtype=np.uint64)
            width, want = 1, size - prefix + 1
            while width * 2 <= want:
                smallest = np.minimum(smallest[:-width], smallest[width:])
                width *= 2
            if width < want:
                smallest = np.minimum(smallest[: len(smallest) - (want - width)], smallest[want - width :])
            at = (smallest & np.uint64(0xFFFFFFFF)).astype(np.int64)
            lengths = np.diff(self.offsets)
            start = np.flatnonzero(np.repeat(self.offsets[1:], lengths)[: len(at)] - np.arange(len(at)) >= size)
            at = at[start]
            if len(at):
                fresh = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                self.anchor, self.first = at[fresh], start[fresh]
                self.last = start[np.append(fresh[1:] - 1, len(at) - 1)]
                self.key = hashes[self.anchor]
        self.row = np.searchsorted(self.offsets[1:], self.anchor, side="right")
        self.doc = self.docs[self.row]

    def flags(self, buckets: int) -> Flags:
        return Flags(self.key, self.doc, buckets)

    def samples(self, share: int) -> bytes:
        """First bytes of the anchors that a hash chooses, one in ``share``; those that are equal in the block once."""
        key, which = np.unique(self.key, return_index=True)
        chosen = self.anchor[which[mix(key, 19) % np.uint64(share) == 0]]
        return self.data[chosen[:, None] + np.arange(self.keys.prefix)].tobytes() if len(chosen) else b""

    def choose(self, recurs: np.ndarray, hot: np.ndarray, splitters: np.ndarray, subs: int) -> None:
        """Keeps what is to be sorted: sampled suffixes that recur, and all suffixes that start a window around a hot one. Distinct keys, dealt and in order."""
        cold, hot = np.flatnonzero(recurs & ~hot), np.flatnonzero(recurs & hot)
        count = self.last[hot] - self.first[hot] + 1
        starts = np.repeat(self.first[hot] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        self.at = np.concatenate([self.anchor[cold], starts])
        row = np.concatenate([self.row[cold], np.repeat(self.row[hot], count)])
        low, high = self.offsets[:-1][row], self.offsets[1:][row]
        n = len(cold)
        rows = np.concatenate([self.keys.rows(self.data, self.at[:n], low[:n], high[:n], True), self.keys.rows(self.data, self.at[n:], low[n:], high[n:], False)])
        self.at_doc = self.docs[row]
        whole = np.ascontiguousarray(rows).view(f"S{self.keys.width}").ravel()
        _, which, inverse = np.unique(whole, return_index=True, return_inverse=True)
        distinct = rows[which]
        bucket = self.bucket(distinct, splitters, subs)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.inverse = place[inverse] if len(order) else inverse
        self.rows = distinct[order]
        self.stretches = stretches(bucket[order])
        self.least = np.full(len(order), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.inverse, self.at_doc)

    def bucket(self, rows: np.ndarray, splitters: np.ndarray, subs: int) -> np.ndarray:
        prefix = np.ascontiguousarray(rows[:, : self.keys.prefix])
        out = np.searchsorted(splitters, prefix.view(f"S{self.keys.prefix}").ravel(), side="right").astype(np.int64)
        if subs > 1:
            halves = prefix.view("<u8") if self.keys.prefix % 8 == 0 else prefix.astype(np.uint64)
            sub = np.zeros(len(rows), np.uint64)
            for column in halves.T:
                sub = mix(sub ^ column.astype(np.uint64), 23)
            out = out * subs + (sub % np.uint64(subs)).astype(np.int64)
        return out

    def runs(self, block: int) -> list[tuple]:
        opens = np.array([s for _, s, _ in self.stretches], np.int64)
        shared, rest = Runs.coded(self.rows, opens)
        rests = self.rows[rest]
        ends = np.append(0, np.cumsum(rest.sum(1)))
        least = self.least.astype("<i8")
        return [(RUN, b, block, (e - s).to_bytes(4, "little") + least[s:e].tobytes() + shared[s:e].tobytes() + rests[ends[s] : ends[e]].tobytes()) for b, s, e in self.stretches]

    def again(self, replies: dict) -> np.ndarray:
        """Starts of the windows that a document of smaller id has too."""
        masks = np.zeros(len(self.rows), np.uint64)
        for b, s, e in self.stretches:
            masks[s:e] = np.frombuffer(replies[(RUN, b)], "<u8")
        before = np.arange(self.keys.most + 1)
        found = []
        for k in range(0, len(self.at), CHUNK):
            part = slice(k, k + CHUNK)
            own = self.inverse[part]
            # Where the block itself has the key in a smaller document, all windows around it.
            flags = np.where((self.at_doc[part] > self.least[own])[:, None], self.keys.reaches(self.rows[own]), (masks[own][:, None] >> before.astype(np.uint64)) & np.uint64(1) != 0)
            which, back = np.nonzero(flags)
            found.append(self.at[part][which] - before[back])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def mask_of(low: int, high: int) -> int:
    return ((1 << (high - low + 1)) - 1) << low if low <= high else 0


#: Up to so many distinct keys of a group are compared in pairs, which is quicker than by their windows; both are exact.
PAIRS = 12


def merge_runs(payloads: list[bytes], keys: Keys) -> list[bytes]:
    """Per run one mask per key: bit o is set if the window that starts o bytes before it also starts in a document of smaller id."""
    size, prefix, after = keys.size, keys.prefix, keys.size + 1
    counts = [int.from_bytes(p[:4], "little") for p in payloads]
    leasts = [np.frombuffer(p, "<i8", n, 4).tolist() for p, n in zip(payloads, counts, strict=True)]
    shared = np.concatenate([np.frombuffer(p, np.uint8, n, 4 + 8 * n) for p, n in zip(payloads, counts, strict=True)])
    rests = np.concatenate([np.frombuffer(p, np.uint8, -1, 4 + 9 * n) for p, n in zip(payloads, counts, strict=True)])
    raw, width = Runs.decoded(shared, rests, keys.width).tobytes(), keys.width
    first = np.append(0, np.cumsum(counts)).tolist()
    known = shared.tolist()

    def run(r: int) -> Iterator[tuple[bytes, int]]:
        for i in range(first[r], first[r + 1]):
            yield raw[i * width : (i + 1) * width], known[i]

    masks = [[0] * n for n in counts]
    nth = [0] * len(counts)
    # Distinct keys that share their first bytes: key, smallest document, members, common prefix with the one before.
    group: list[tuple[bytes, int, list[tuple[int, int, int]], int]] = []

    def close() -> None:
        for key, least, members, _ in group:
            if len(members) > 1:
                full = mask_of(*keys.reach(key))
                for r, at, doc in members:
                    if doc > least:
                        masks[r][at] = full
        if 1 < len(group) <= PAIRS:
            in_pairs()
        elif len(group) > PAIRS:
            by_windows()

    def settled(which: int, mask: int) -> None:
        _, least, members, _ = group[which]
        for r, at, doc in members:
            if doc == least:
                masks[r][at] = mask

    def in_pairs() -> None:
        """In sorted order the common prefix of two keys is the least of those between neighbours."""
        found = [0] * len(group)
        for i in range(len(group) - 1):
            a, least_a = group[i][0], group[i][1]
            low_a, high_a = keys.reach(a)
            right = size
            for j in range(i + 1, len(group)):
                b, least_b, _, common_ = group[j]
                right = min(right, common_)
                if least_a == least_b:
                    continue
                low_b, high_b = keys.reach(b)
                low, high = max(size - right, low_a, low_b), min(high_a, high_b)
                if low > high:
                    continue
                if a[after : after + high] != b[after : after + high]:
                    high = common(a[after:-1], b[after:-1])
                found[j if least_a < least_b else i] |= mask_of(low, high)
        for which, mask in enumerate(found):
            if mask:
                settled(which, mask)

    def by_windows() -> None:
        smallest: dict[tuple[int, bytes, bytes], int] = {}
        windows = []
        for key, least, _, _ in group:
            low, high = keys.reach(key)
            windows.append([(o, key[: size - o], key[after : after + o]) for o in range(low, high + 1)])
            for w in windows[-1]:
                if smallest.setdefault(w, least) > least:
                    smallest[w] = least
        for which, own in enumerate(windows):
            least = group[which][1]
            mask = sum(1 << w[0] for w in own if smallest[w] < least)
            if mask:
                settled(which, mask)

    for key, common_, r in merged_runs([run(r) for r in range(len(counts))]):
        at = nth[r]
        doc = leasts[r][at]
        nth[r] = at + 1
        if group:
            last = group[-1]
            if common_ == width:
                last[2].append((r, at, doc))
                if doc < last[1]:
                    group[-1] = (key, doc, last[2], last[3])
                continue
            if common_ < prefix:
                if len(group) > 1 or len(last[2]) > 1:
                    close()
                group = []
        group.append((key, doc, [(r, at, doc)], common_))
    if group:
        close()
    return [np.array(m, "<u8").tobytes() for m in masks]


def chosen_splitters(asked: DataFrame, buckets: int, prefix: int) -> np.ndarray:
    """``buckets - 1`` prefixes at most that divide the sampled ones evenly; the sample is ranked on the executors."""
    schema = T.StructType([T.StructField("prefix", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([payload[i : i + prefix] for i in range(0, len(payload), prefix)], pa.binary())], names=["prefix"])

    sample = ranked(asked.where(F.col("kind") == SAMPLE).select("payload").mapInArrow(cut, schema), "prefix")
    n = sample.count()
    step = max(1, n // buckets)
    rows = sample.where((F.col("rank") > 0) & (F.col("rank") % step == 0)).select("prefix").distinct().collect()
    return np.array(sorted(bytes(r["prefix"]) for r in rows), f"S{prefix}")


def duplicate_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW, prefix: int = PREFIX, **sizes: int) -> DataFrame:
    """Per row of ``docs``: its id, ``n_bytes``, ``n_removed``, ``spans`` (start, end, ... in bytes) and ``kept`` (binary).

    Removes each byte of the UTF-8 text that a string of ``size`` bytes covers which also starts
    in a document of smaller id. Ids are integers; a null text is empty; documents without an id
    are larger than all others and none of them removes from another; rows that repeat an id do
    not remove from each other; an empty table gives none. Texts of any length are cut into
    pieces of ``piece`` bytes, and blocks hold about ``block`` bytes.
    """
    if not prefix < size <= 250 or size - prefix > 63:
        raise ValueError("prefix < size <= 250 and size - prefix <= 63 are needed")
    length = sizes.get("piece", PIECE_BYTES)

    def cuts(data: np.ndarray) -> list[tuple[int, int, int]]:
        return [(a, min(len(data), a + length + size - 1), a) for a in range(0, max(len(data) - size + 1, 1), length)]

    blocks = Blocks(docs, doc_id, text, cuts, **sizes)
    buckets, keys = blocks.buckets, Keys(size, prefix)
    ranges = min(buckets, MOST_RANGES)
    subs = -(-buckets // ranges)
    # About two anchors in each (size - prefix) bytes; one in `share` of them is sampled.
    share = max(1, blocks.blocks * sizes.get("block", BLOCK_BYTES) * 2 // ((size - prefix) * OVERSAMPLE * ranges))
    number = lambda table: table.column("block")[0].as_py()

    def grams(table: pa.Table) -> list[tuple]:
        block = Block(table, keys)
        return [(SAMPLE, number(table), number(table), block.samples(share)), *block.flags(buckets).sent(GRAM, number(table))]

    asked = settle(answered(blocks.send(grams), {GRAM: Flags.merge}))
    shared = docs.sparkSession.sparkContext.broadcast(chosen_splitters(asked, ranges, prefix))

    def runs(table: pa.Table, replies: dict) -> list[tuple]:
        block, own = Block(table, keys), number(table)
        recurs, hot = block.flags(buckets).read(GRAM, replies)
        block.choose(recurs, hot, shared.value, subs)
        return [(ECHO, own, own, np.packbits(recurs).tobytes() + np.packbits(hot).tobytes()), *block.runs(own)]

    schema = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("kept", T.BinaryType())])

    def spans_of(table: pa.Table, replies: dict) -> list[np.ndarray]:
        data, offsets = texts(table.column("text"))
        echo = replies.get((ECHO, number(table)), b"")
        if not any(echo):
            return [np.zeros(0, np.int64)] * (len(offsets) - 1)
        half, found = len(echo) // 2, np.frombuffer(echo, np.uint8)
        block = Block(table, keys)
        recurs, hot = (np.unpackbits(x, count=len(block.anchor)).astype(bool) for x in (found[:half], found[half:]))
        block.choose(recurs, hot, shared.value, subs)
        return edges(window_flags(block.again(replies), len(data), size), offsets)

    found = settle(answered(blocks.ask_again([asked.where(F.col("kind") == GRAM)], runs), {RUN: lambda p, _: merge_runs(p, keys)}))
    return blocks.cut([found], spans_of, without_bytes, schema)


def without_bytes(column: pa.Array, spans: list[np.ndarray]) -> list[pa.Array]:
    """``n_bytes, n_removed, spans, kept`` of texts without their spans."""
    data, offsets = texts(column)
    gone = np.array([int((s[1::2] - s[::2]).sum()) for s in spans], np.int64)
    kept = []
    for d, s in enumerate(spans):
        own = data[offsets[d] : offsets[d + 1]]
        ends = np.concatenate([[0], s, [len(own)]]).reshape(-1, 2)
        kept.append(b"".join(own[a:b].tobytes() for a, b in ends.tolist()))
    return [pa.array(np.diff(offsets)), pa.array(gone), pa.array([s.tolist() for s in spans], pa.list_(pa.int64())), pa.array(kept, pa.binary())]
