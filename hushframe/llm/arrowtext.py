"""Texts of an Arrow batch as one byte array: words, lines and numbers for all documents at once.

Everything here works on whole texts. What is counted, dropped or flagged is told apart by content:
``numbered`` gives equal spans of a slice equal numbers, and others different ones. The hashes are
sketches (polynomials in Z/2^64 over random values, taken from prefix sums and mixed): equal content
has equal hashes anywhere, but not the other way round, so they only sample, deal and filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at a time; only a document that is longer makes a longer slice.
SLICE_BYTES = 2 << 20
#: Bytes of a slice for which there are arrays of one value a byte at the same time.
PIECE_BYTES = 2 << 20

#: The ASCII whitespace that separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_VALUES = BYTE_VALUES[LOWER]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of base, and of its inverse; kept per process, a little beyond what was asked for."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n + n // 8 + 1024, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p, out=p))
        known = _POWERS[base] = out[0], out[1]
    return known[0][:n], known[1][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x ^= x >> np.uint64(33)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(33)
    return x


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """S with S[i] = sum of values[j] * base^j over j < i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, powers(base, len(values))[0], out=out[1:])
    return np.cumsum(out, out=out)


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each pair."""
    down = powers(base, len(sums))[1]
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def rolling_hash(sums: np.ndarray, size: int, base: int) -> np.ndarray:
    """``span_hash`` of values[i:i + size] for every i."""
    out = sums[size:] - sums[:-size]
    out *= powers(base, len(sums))[1][: len(out)]
    out += np.uint64(size)
    return mix(out)


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows (strings or binary) and their offsets (rows + 1); a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch | pa.Table, text: str) -> Iterator[pa.RecordBatch | pa.Table]:
    """``batch`` in runs of whole rows of about SLICE_BYTES of text."""
    _, offsets = texts(batch.column(text))
    row, n = 0, batch.num_rows
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES)))
        yield batch.slice(row, min(end, n) - row)
        row = end


def pieces(n: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n, PIECE_BYTES):
        yield a, min(a + PIECE_BYTES, n)


def counted(data: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Bytes of each document that are set in the table ``which``."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for a, b in pieces(len(data)):
        total = np.zeros(b - a + 1, np.int64)
        np.cumsum(which[data[a:b]], out=total[1:])
        at = np.clip(offsets, a, b) - a
        out += total[at[1:]] - total[at[:-1]]
    return out


def numbered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each span start:end (ascending, disjoint), the same exactly for equal bytes; and the distinct spans and gaps by number."""
    if not len(start):
        return np.zeros(0, np.int32), pa.array([], pa.large_binary())
    edges = np.empty(2 * len(start) + 1, np.int64)
    edges[:-1:2], edges[1::2], edges[-1] = start, end, end[-1]
    # Spans and the gaps between them lie end to end in the bytes as they are.
    whole = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    coded = whole.dictionary_encode()
    return coded.indices.to_numpy()[::2], coded.dictionary


class Words:
    """Words of all documents of a slice, in order; those of document d are ``first[d]:first[d + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
        starts, ends = [], []
        for a, b in pieces(len(data)):
            # One byte more on either side, so that a word goes on from piece to piece.
            low, high = max(a - 1, 0), min(b + 1, len(data))
            inside = ~separators[data[low:high]]
            edge = np.zeros(high - low + 1, bool)
            edge[offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high, side="right")] - low] = True
            before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
            before[1:], after[:-1] = inside[:-1], inside[1:]
            own = slice(a - low, b - low)
            starts.append(np.flatnonzero((inside & (~before | edge[:-1]))[own]) + a)
            ends.append(np.flatnonzero((inside & (~after | edge[1:]))[own]) + a + 1)
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def window_starts(self, size: int) -> np.ndarray:
        """Whether a window of ``size`` words of one document starts at each word."""
        left = np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))
        return left >= size


def window_hash(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    sums = prefix_sums(hashes, WORD_BASE)
    return span_hash(sums, starts, starts + size, WORD_BASE)


def per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of set flags within each bounds[i]:bounds[i + 1]."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any starts[i]:ends[i]."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0
