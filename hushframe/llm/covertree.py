"""Product codes of vectors by Lloyd's rounds over cover trees, in whole numbers throughout.

Vectors are cut into equal consecutive parts. Tasks build a cover tree for each part of each block
of their rows, once; the trees go to the shared folder. In every round a tree is descended with the
codebook: a node whose points must all have the same nearest entry, by the triangle inequality,
adds its whole subtree at once (a difference of cumulative sums); only ambiguous nodes are opened,
with the entries that are still possible, down to comparisons of single points. Sums of a task are
added up before they are shuffled, and a round brings parts x entries x components numbers to the
driver, however many vectors there are.

Defined results: rows whose vector is null, holds a null or a number that is not finite, or has
another length than most vectors, are left out. A length that the number of parts does not divide
is filled up with zeros. Components are floor(scale * x), exact up to 2^80 in size (beyond that they
stay at 2^80); an error beyond a long stays at the largest long. Equal ids are rows of their own,
null ids come last where ids are put in order, equal ids in the order of their vectors. With fewer
vectors than entries the codebook has as many entries as there are vectors; without vectors there
are no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import met_by, null_safe, settle
from .vectors import dimension, matrix, usable

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of a block, whose trees are built and searched together.
BLOCK = 1024
#: A node of so few points or less is not divided further.
LEAF = 8
#: Components up to this size give squared distances that fit a long in any part of up to 128 of them.
NARROW = 1 << 27
WIDEST = float(1 << 80)
LONGEST = (1 << 63) - 1
#: Distances are rounded square roots; the test for whole subtrees allows for that.
SLACK = 1e-9


def whole_numbers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as doubles that hold whole numbers."""
    return np.clip(np.floor(scale * vectors), -WIDEST, WIDEST)


def exact(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers as longs, or as Python's own where squares might not fit a long."""
    if not numbers.size or np.abs(numbers).max() < NARROW:
        return numbers.astype(np.int64)
    out = np.empty(numbers.shape, object)
    out.ravel()[:] = [int(x) for x in numbers.ravel()]
    return out


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, points by entries."""
    points, entries = (points, entries) if points.dtype == entries.dtype else (points.astype(object), entries.astype(object))
    apart = points[:, None, :] - entries[None, :, :]
    return (apart * apart).sum(axis=2)


class CoverTree:
    """A cover tree over distinct points with weights.

    Points enter in levels: at level i every point farther than 2^i from all points so far enters
    (separation), under the nearest of those that the level before had (covering, within 2^(i+1)).
    ``points`` are in depth-first order, so that a node's subtree is a run ``low:high`` of them and
    its sum a difference of two cumulative sums. Nodes are numbered level by level: ``first`` is a
    node's point, ``radius`` the farthest of its subtree from that, ``child`` its children.
    """

    FIELDS = ("points", "weights", "first", "low", "high", "radius", "child_from", "child_to")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def built(cls, points: np.ndarray, weights: np.ndarray) -> tuple[CoverTree, np.ndarray]:
        """The tree of distinct ``points`` (doubles that hold whole numbers), and the place that each has in it."""
        n = len(points)
        near, dist = np.zeros(n, np.int64), np.sqrt(((points - points[0]) ** 2).sum(axis=1))
        joined: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n)]
        reach = 2.0 ** np.ceil(np.log2(max(dist.max(), 1.0)))
        while dist.max() > 0:
            reach /= 2
            if not (dist > reach).any():
                continue
            above, entered = near.copy(), []
            while True:
                q = int(dist.argmax())
                if dist[q] <= reach:
                    break
                entered.append(q)
                now = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
                closer = now < dist
                near[closer], dist[closer] = q, now[closer]
            entered = np.array(entered)
            order = np.argsort(above[entered], kind="stable")
            owners, starts = np.unique(above[entered][order], return_index=True)
            for owner, of in zip(owners, np.split(entered[order], starts[1:]), strict=True):
                joined[owner].append((len(joined[owner]), of))
        return cls._laid_out(points, weights, joined)

    @classmethod
    def _laid_out(cls, points, weights, joined) -> tuple[CoverTree, np.ndarray]:
        # Sizes of (point, step) subtrees: the point with what joins it from that step on. Points that
        # enter later come first here, as each one's owner entered before it.
        size = {}

        def size_of(p: int) -> int:
            stack = [p]
            while stack:
                at = stack[-1]
                if at in size:
                    stack.pop()
                    continue
                missing = [c for _, of in joined[at] for c in of.tolist() if c not in size]
                if missing:
                    stack.extend(missing)
                    continue
                total, sizes = 1, [1]
                for _, of in reversed(joined[at]):
                    total += sum(size[c][0] for c in of.tolist())
                    sizes.append(total)
                size[at] = sizes[::-1]
                stack.pop()
            return size[p][0]

        size_of(0)
        place = np.empty(len(points), np.int64)
        first, low, high, child_from, child_to = [], [], [], [], []
        level = [(0, 0, 0)]  # point, step, low
        while level:
            below, number = [], len(first) + len(level)
            for p, step, start in level:
                end = start + size[p][step]
                first.append(start)
                low.append(start)
                high.append(end)
                place[p] = start
                child_from.append(number + len(below))
                if end - start > LEAF:
                    of = joined[p][step][1].tolist()
                    at = start + size[p][step + 1]
                    below.append((p, step + 1, start))
                    for c in of:
                        below.append((c, 0, at))
                        at += size[c][0]
                elif end - start > 1:
                    cls._placed(p, step, start, joined, place, size)
                child_to.append(number + len(below))
            level = below
        order = np.empty(len(points), np.int64)
        order[place] = np.arange(len(points))
        ordered, low, high = points[order], np.array(low), np.array(high)
        radius = [np.sqrt(((ordered[a:b] - ordered[a]) ** 2).sum(axis=1).max()) for a, b in zip(low, high, strict=True)]
        arrays = {"points": ordered, "weights": weights[order], "first": np.array(first), "low": low, "high": high, "radius": np.array(radius), "child_from": np.array(child_from), "child_to": np.array(child_to)}
        return cls(**arrays), place

    @staticmethod
    def _placed(p, step, start, joined, place, size) -> None:
        """Places of a leaf's points, the node's own first."""
        stack, at = [(p, step)], start
        while stack:
            q, s = stack.pop()
            place[q] = at
            at += 1
            stack.extend((c, 0) for _, of in joined[q][s:] for c in of.tolist())

    def assigned(self, entries: np.ndarray) -> tuple[np.ndarray, int]:
        """The nearest entry (ties: the lowest) of each point, and how many distances that took."""
        points = exact(self.points)
        labels = np.zeros(len(points), np.int64)
        nodes, open_ = np.array([0]), np.ones((1, len(entries)), bool)
        square, count = squared(points[self.first[nodes]], entries), len(entries)
        while len(nodes):
            dist = np.where(open_, np.sqrt(square.astype(np.float64)), np.inf)
            reach = dist.min(axis=1) + 2 * self.radius[nodes]
            possible = dist <= (reach * (1 + SLACK) + SLACK)[:, None]
            settled = possible.sum(axis=1) == 1
            for node, entry in zip(nodes[settled], possible[settled].argmax(axis=1), strict=True):
                labels[self.low[node] : self.high[node]] = entry
            nodes, possible, square = nodes[~settled], possible[~settled], square[~settled]
            inner = self.child_to[nodes] > self.child_from[nodes]
            leaves = nodes[~inner]
            if len(leaves):
                lengths = self.high[leaves] - self.low[leaves]
                rows = np.repeat(np.arange(len(leaves)), lengths)
                at = np.concatenate([np.arange(a, b) for a, b in zip(self.low[leaves], self.high[leaves], strict=True)])
                exactly = squared(points[at], entries)
                allowed = possible[~inner][rows]
                count += int(allowed.sum())
                # Of those still possible the least; impossible ones lose to any real distance.
                worst = exactly.max() + 1
                labels[at] = np.where(allowed, exactly, worst).argmin(axis=1)
            nodes, possible, square = nodes[inner], possible[inner], square[inner]
            if not len(nodes):
                break
            many = self.child_to[nodes] - self.child_from[nodes]
            below = np.concatenate([np.arange(a, b) for a, b in zip(self.child_from[nodes], self.child_to[nodes], strict=True)])
            # A node's first child has its point: those distances are known.
            fresh = below != np.repeat(self.child_from[nodes], many)
            open_, square = np.repeat(possible, many, axis=0), np.repeat(square, many, axis=0)
            square[fresh] = squared(points[self.first[below[fresh]]], entries)
            count += int(open_[fresh].sum())
            nodes = below
        return labels, count

    def sums(self, labels: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """Weighted sums and weights by entry: runs of one label are differences of the cumulative sums."""
        points = exact(self.points)
        ends = np.append(np.flatnonzero(np.diff(labels)) + 1, len(labels))
        starts = np.append(0, ends[:-1])
        total = np.zeros((len(points) + 1, points.shape[1]), points.dtype)
        np.cumsum(points * self.weights[:, None], axis=0, out=total[1:])
        weight = np.append(0, np.cumsum(self.weights))
        added, n = np.zeros((entries, points.shape[1]), points.dtype), np.zeros(entries, np.int64)
        np.add.at(added, labels[starts], total[ends] - total[starts])
        np.add.at(n, labels[starts], weight[ends] - weight[starts])
        return added, n


# --- blocks of rows, as they are kept between rounds


def packed(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them."""
    top = np.abs(numbers).max() if numbers.size else 0
    kind = next((t for t in (np.int8, np.int16, np.int32) if top <= np.iinfo(t).max), None)
    return numbers.astype(kind) if kind is not None else numbers


def block_of(numbers: np.ndarray, parts: int) -> bytes:
    """A block's trees and the place of each row in them."""
    arrays = {}
    for part, own in enumerate(np.split(numbers, parts, axis=1)):
        points, which, weights = np.unique(own, axis=0, return_inverse=True, return_counts=True)
        tree, place = CoverTree.built(points, weights)
        arrays[f"{part}_place"] = packed(place[which.ravel()])
        arrays |= {f"{part}_{name}": getattr(tree, name) if name == "radius" else packed(getattr(tree, name)) for name in CoverTree.FIELDS}
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def trees_of(block: bytes, parts: int) -> Iterator[tuple[CoverTree, np.ndarray]]:
    arrays = np.load(io.BytesIO(block))
    for part in range(parts):
        got = {name: arrays[f"{part}_{name}"] for name in CoverTree.FIELDS}
        wide = {name: a if name in ("points", "radius") else a.astype(np.int64) for name, a in got.items()}
        yield CoverTree(**wide | {"points": got["points"].astype(np.float64)}), arrays[f"{part}_place"].astype(np.int64)


def blocks(rows: DataFrame, id_: str, label: str, vector: str, d: int, parts: int, scale: int) -> DataFrame:
    """``ids, labels, trees`` of runs of rows of one partition; nothing is shuffled."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = f"ids array<{kinds[id_].simpleString()}>, labels array<{kinds[label].simpleString()}>, trees binary"
    fill = -d % parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                numbers = np.pad(whole_numbers(matrix(part.column(2), d), scale), ((0, 0), (0, fill)))
                offsets = pa.array([0, part.num_rows], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, part.column(i)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([block_of(numbers, parts)], pa.binary())], ["ids", "labels", "trees"])

    return rows.select(id_, label, vector).mapInArrow(run, schema)


def round_sums(kept: DataFrame, book: list[np.ndarray], parts: int) -> DataFrame:
    """``part, entry, at, added, n`` over all blocks, each task's blocks added up before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for block in batch["trees"]:
                for part, (tree, _) in enumerate(trees_of(block, parts)):
                    labels, _ = tree.assigned(book[part])
                    added, n = tree.sums(labels, len(book[part]))
                    for entry in np.flatnonzero(n):
                        held = sums.setdefault((part, int(entry)), [0, 0])
                        held[0] = held[0] + added[entry].astype(object)
                        held[1] += int(n[entry])
        rows = [(part, entry, at, str(x), n) for (part, entry), (xs, n) in sums.items() for at, x in enumerate(xs)]
        yield pd.DataFrame(rows, columns=["part", "entry", "at", "added", "n"])

    found = kept.select("trees").mapInPandas(run, "part int, entry int, at int, added string, n long")
    return found.groupBy("part", "entry", "at").agg(F.sum(F.col("added").cast("decimal(38,0)")).alias("added"), F.sum("n").alias("n"))


def first_entries(rows: DataFrame, id_: str, vector: str, d: int, parts: int, entries: int, scale: int) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids: at most ``entries`` rows reach the driver."""
    top = rows.select(id_, vector).orderBy(F.col(id_).asc_nulls_last(), F.col(vector)).limit(entries).toArrow()
    numbers = np.pad(whole_numbers(matrix(top.column(1).combine_chunks(), d), scale), ((0, 0), (0, -d % parts)))
    return [exact(part) for part in np.split(numbers, parts, axis=1)]


def refined(kept: DataFrame, book: list[np.ndarray], parts: int, rounds: int) -> list[np.ndarray]:
    """The codebook after ``rounds`` of Lloyd: every entry becomes the floored mean of what it was nearest to; unused ones stay."""
    for _ in range(rounds):
        new = [[[int(x) for x in entry] for entry in part] for part in book]
        for r in round_sums(kept, book, parts).collect():  # parts x entries x components, whatever the input
            new[r["part"]][r["entry"]][r["at"]] = int(r["added"]) // r["n"]
        book = [exact_entries(part) for part in new]
    return book


def exact_entries(entries: list[list[int]]) -> np.ndarray:
    top = max((abs(x) for entry in entries for x in entry), default=0)
    return np.array(entries, np.int64 if top < NARROW else object)


def coded(kept: DataFrame, book: list[np.ndarray], parts: int, id_: str, label: str) -> DataFrame:
    """``id, label, code, error`` of every row."""
    kinds = {f.name: f.dataType.elementType.simpleString() for f in kept.schema.fields if f.name in ("ids", "labels")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, block in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                codes, error = [], 0
                for part, (tree, place) in enumerate(trees_of(block.as_py(), parts)):
                    found, _ = tree.assigned(book[part])
                    points, entries = exact(tree.points), book[part][found]
                    apart = (points if entries.dtype == points.dtype else points.astype(object)) - entries
                    codes.append(found[place].astype(np.uint8))
                    error = error + (apart * apart).sum(axis=1).astype(object)[place]
                text = np.stack(codes, axis=1)
                named = pa.array([row.tobytes().hex() for row in text], pa.string())
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, named, pa.array([min(e, LONGEST) for e in error], pa.int64())], ["id", "label", "code", "error"])

    return kept.select("ids", "labels", "trees").mapInArrow(run, f"id {kinds['ids']}, label {kinds['labels']}, code string, error long")


def book_digest(book: list[np.ndarray]) -> str:
    """SHA-256 over all entries' components in decimal: by part, entry, place, with commas between."""
    return hashlib.sha256(",".join(str(int(x)) for part in book for entry in part for x in entry).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_: str = "vec_id", label: str = "label", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """``id_, label, code, error, label_error`` of every usable vector, and the codebook (parts x entries x components).

    ``entries`` is at most 256. A label with any share of the rows is not gathered: sums are
    pre-aggregated, and heavy labels go to where the rows are.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    d = dimension(vectors, vector)
    rows = usable(vectors.select(id_, label, vector), vector, d)
    if d == 0:
        empty = rows.limit(0).select(id_, label, F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty, []
    kept = settle(blocks(rows, id_, label, vector, d, parts, scale))
    book = refined(kept, first_entries(rows, id_, vector, d, parts, entries, scale), parts, rounds)
    found = settle(coded(kept, book, parts, id_, label).withColumn("_label", null_safe("label")))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    by_label = settle(found.groupBy("_label").agg(total.alias("label_error"), F.count("*").alias("n")))
    met = met_by(found, by_label, "_label", found.count())
    return met.select(F.col("id").alias(id_), F.col("label").alias(label), "code", "error", "label_error"), book
