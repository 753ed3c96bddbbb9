"""Blocks of documents and the exchanges by which they learn what others also have.

Repeat finding runs on blocks: sets of texts, about 2 MB each at any scale, dealt by a hash and
written once as a table bucketed by block. A block sends what it has as sorted runs, one row per
(block, bucket); each bucket merges its runs and answers every block with as many values as it
sent. What thousands of documents of a block share is sent once. Texts longer than a piece are cut
into pieces that overlap by a window less one unit, so that every window starts in exactly one;
their spans meet again at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import mix
from .shared import dealt, settle, shuffle_partitions

#: Bytes of a block, and of a text from which on it is cut.
BLOCK_BYTES, PIECE_BYTES = 2 << 20, 4 << 20
NO_DOC = np.iinfo(np.int64).max
MESSAGE = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("payload", T.BinaryType())])
MESSAGE_NAMES = MESSAGE.names
#: Pieces as blocks hold them: first is the unit of the text that a piece starts with.
PIECE = "doc long, row long, first long, whole boolean, text binary"


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


class Blocks:
    """``docs`` as blocks; a null doc_id is larger than every other, a null text empty."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, cuts: Callable[[np.ndarray], list[tuple[int, int, int]]], piece: int = PIECE_BYTES, block: int = BLOCK_BYTES):
        """``cuts`` gives the pieces of a long text: first and last byte, and the number of the first unit."""
        if not isinstance(docs.schema[doc_id].dataType, T.IntegralType):
            raise TypeError(f"{doc_id} must be of an integer type, as smaller ids go first")
        total, longest = docs.agg(F.sum(F.octet_length(text)), F.max(F.octet_length(text))).first()
        self.blocks = max(1, -(-(total or 0) // block))
        self.buckets = max(1, self.blocks // 2)
        self.partitions = max(shuffle_partitions(docs.sparkSession), 1)
        self.docs, self.doc_id, self.has_long = docs, doc_id, (longest or 0) > piece
        id_ = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_DOC))
        self.source = docs.select(id_.alias("doc"), F.xxhash64(id_, F.col(text)).alias("row"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
        short = F.octet_length("text") <= piece
        rows = self.source.where(short).select("doc", "row", F.lit(0).cast("long").alias("first"), F.lit(True).alias("whole"), "text")
        if self.has_long:
            self.long = self.source.where(~short)

            def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for i in range(batch.num_rows):
                        data = np.frombuffer(batch.column("text")[i].as_py(), np.uint8)
                        for low, high, first in cuts(data):
                            own = [batch.column("doc").slice(i, 1), batch.column("row").slice(i, 1), pa.array([first]), pa.array([False]), pa.array([data[low:high].tobytes()], pa.binary())]
                            yield pa.RecordBatch.from_arrays(own, names=["doc", "row", "first", "whole", "text"])

            rows = rows.unionByName(self.long.mapInArrow(cut, PIECE))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("row", "first"), F.lit(self.blocks)).cast("int"))
        self.rows = dealt(rows, "block", self.partitions)

    def send(self, run: Callable[[pa.Table], list[tuple]]) -> DataFrame:
        """Messages that ``run`` makes of each block."""

        def per_block(table: pa.Table) -> pa.Table:
            return messages(run(in_order(table)))

        return self.rows.groupBy("block").applyInArrow(per_block, MESSAGE)

    def with_answers(self, answers: list[DataFrame], run: Callable[[pa.Table, dict], pa.Table], schema: T.StructType) -> DataFrame:
        """What ``run`` makes of each block and its answers ``{(kind, bucket): payload}``."""

        def per_block(table: pa.Table, own: pa.Table) -> pa.Table:
            if not table.num_rows:
                return pa.Table.from_pylist([], schema=to_arrow(schema))
            replies = dict(zip(zip(own.column("kind").to_pylist(), own.column("bucket").to_pylist(), strict=True), own.column("payload").to_pylist(), strict=True))
            return run(in_order(table), replies)

        return self.rows.groupBy("block").cogroup(reduce(DataFrame.union, answers).groupBy("block")).applyInArrow(per_block, schema)

    def ask_again(self, answers: list[DataFrame], run: Callable[[pa.Table, dict], list[tuple]]) -> DataFrame:
        return self.with_answers(answers, lambda table, own: messages(run(table, own)), MESSAGE)

    def cut(self, answers: list[DataFrame], spans_of: Callable[[pa.Table, dict], list[np.ndarray]], finish: Callable[[pa.Array, list[np.ndarray]], list[pa.Array]], schema: T.StructType) -> DataFrame:
        """``doc_id`` and the columns of ``schema`` that ``finish`` makes of each text and its flat spans (start, end, ...), which ``spans_of`` gives for each piece of a block."""
        id_type = self.docs.schema[self.doc_id].dataType
        own_schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("row", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("cover", T.ArrayType(T.LongType())), *schema])

        def per_block(table: pa.Table, replies: dict) -> pa.Table:
            spans, whole = spans_of(table, replies), table.column("whole").to_numpy(zero_copy_only=False)
            done = finish(table.column("text"), spans)
            masked = [pc.if_else(pa.array(whole), c, pa.scalar(None, c.type)) for c in done]
            first = table.column("first").to_numpy()
            cover = pa.array([None if w else (s + f).tolist() for s, w, f in zip(spans, whole, first, strict=True)], pa.list_(pa.int64()))
            return pa.table([table.column("doc"), table.column("row"), table.column("whole"), cover, *masked], schema=to_arrow(own_schema))

        names = [f.name for f in schema]
        found = self.with_answers(answers, per_block, own_schema)
        id_ = F.when(F.col("doc") != NO_DOC, F.col("doc")).cast(id_type).alias(self.doc_id)
        if not self.has_long:
            return found.select(id_, *names)
        found = settle(found)
        cover = found.where("not whole").groupBy("doc", "row").agg(F.flatten(F.collect_list("cover")).alias("cover"))
        whole_texts = self.long.join(cover.hint("merge"), ["doc", "row"])

        def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    part = batch.slice(i, 1)
                    done = finish(part.column("text"), [joined(np.array(part.column("cover")[0].as_py(), np.int64))])
                    yield pa.RecordBatch.from_arrays([part.column("doc"), *done], schema=to_arrow(long_schema))

        long_schema = T.StructType([T.StructField("doc", T.LongType()), *schema])
        return found.where("whole").select(id_, *names).unionByName(whole_texts.mapInArrow(finished, long_schema).select(id_, *names))


def joined(flat: np.ndarray) -> np.ndarray:
    """Spans that overlap or touch made one."""
    pairs = flat.reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    if not len(pairs):
        return flat
    reach = np.maximum.accumulate(pairs[:, 1])
    fresh = np.append(True, pairs[1:, 0] > reach[:-1])
    return np.stack([pairs[fresh, 0], reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(pairs) - 1)]], 1).ravel()


def in_order(table: pa.Table) -> pa.Table:
    return table.sort_by([("doc", "ascending"), ("row", "ascending"), ("first", "ascending")]).combine_chunks()


def messages(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[], [], [], []]
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=MESSAGE_NAMES)


def answered(sent: DataFrame, merge: dict[int, Callable[[list[bytes], int], list[bytes]]]) -> DataFrame:
    """Each bucket's runs merged by ``merge[kind]``, which answers every run. Kinds without a merge go back as they are."""

    def per_bucket(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        if kind not in merge:
            return table.select(MESSAGE_NAMES)
        table = table.sort_by("block")
        replies = merge[kind](table.column("payload").to_pylist(), table.column("bucket")[0].as_py())
        return pa.table([table.column("kind"), table.column("bucket"), table.column("block"), pa.array(replies, pa.binary())], names=MESSAGE_NAMES)

    return sent.groupBy("kind", "bucket").applyInArrow(per_bucket, MESSAGE)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(payload: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(payload, np.uint8), count=n).astype(bool)


def stretches(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """Of ascending bucket numbers: each number that is there, with its first place and the place after its last."""
    if not len(bucket):
        return []
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return list(zip(bucket[first].tolist(), first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True))


def window_flags(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of n units the windows at ``starts`` cover."""
    begun = np.zeros(n + 1, np.int64)
    begun[starts + 1] = 1
    np.cumsum(begun, out=begun)
    out = begun[1:].copy()
    out[size:] -= begun[1 : n - size + 1]
    return out > 0


def edges(flags: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """For each bounds[i]:bounds[i + 1] the flat runs of set flags, from its own first place."""
    out = []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = flags[s:e]
        out.append(np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))) if own.any() else np.zeros(0, np.int64))
    return out


class Flags:
    """Which keys recur in other documents, and which are met more than HOT times.

    A key is a 64-bit sketch; its bucket and 32 more bits are sent with the occurrences there are
    in the block. Two keys taken for one only send something needlessly.
    """

    HOT = 4096

    def __init__(self, keys: np.ndarray, docs: np.ndarray, buckets: int):
        """``keys`` with their documents (ascending numbers)."""
        bucket, rest = (mix(keys, 7) >> np.uint64(32)) % np.uint64(buckets), mix(keys, 11) & np.uint64(0xFFFFFFFF)
        self.code, self.inverse, counts = np.unique((bucket << np.uint64(32)) | rest, return_inverse=True, return_counts=True)
        low, high = np.full(len(self.code), NO_DOC), np.full(len(self.code), -1)
        np.minimum.at(low, self.inverse, docs)
        np.maximum.at(high, self.inverse, docs)
        # One occurrence, or more; more in one document only is as one.
        self.count = np.where(high > low, np.minimum(counts, 255), 1).astype(np.uint8)
        self.stretches = stretches((self.code >> np.uint64(32)).astype(np.int64))

    def sent(self, kind: int, block: int) -> list[tuple]:
        rest = (self.code & np.uint64(0xFFFFFFFF)).astype("<u4")
        return [(kind, b, block, rest[s:e].tobytes() + self.count[s:e].tobytes()) for b, s, e in self.stretches]

    @classmethod
    def merge(cls, payloads: list[bytes], _: int) -> list[bytes]:
        sizes = [len(p) // 5 for p in payloads]
        rest = np.concatenate([np.frombuffer(p, "<u4", n) for p, n in zip(payloads, sizes, strict=True)])
        count = np.concatenate([np.frombuffer(p, np.uint8, n, 4 * n) for p, n in zip(payloads, sizes, strict=True)])
        _, inverse = np.unique(rest, return_inverse=True)
        total = np.bincount(inverse, weights=count)[inverse]
        out, at = [], 0
        for n in sizes:
            own = total[at : at + n]
            out.append(bits(own > 1) + bits(own > cls.HOT))
            at += n
        return out

    def read(self, kind: int, replies: dict) -> tuple[np.ndarray, np.ndarray]:
        """Per occurrence: recurs, is hot."""
        recurs, hot = np.zeros(len(self.code), bool), np.zeros(len(self.code), bool)
        for b, s, e in self.stretches:
            payload = replies[(kind, b)]
            half = len(payload) // 2
            recurs[s:e], hot[s:e] = unbits(payload[:half], e - s), unbits(payload[half:], e - s)
        return recurs[self.inverse], hot[self.inverse]

