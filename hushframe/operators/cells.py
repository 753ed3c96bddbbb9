"""Joins of things that overlap, in space or in text, by cells.

Each thing has, on each axis, a class by its size; a cell of its class is at least as long as it
is, so that it lies in two at most. Two things meet in cells of the larger class on each axis, and
only in the cell where their common part begins, so that each pair is made once. A small thing goes
to the classes that the other side has, which are few: sizes grow fourfold from one to the next. What
is in a cell together mostly overlaps; work grows with the overlaps, not with the square of a group.

Cells make copies, of which a group of few rows has no need: its pairs are tried as they are, at most
``CROWD`` for each row. Which groups have more is counted first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.materialize import materialized

#: Rows of a group, on either side, up to which all its pairs are tried, and groups of more that may be broadcast.
CROWD, BROADCAST_ROWS = 64, 100_000
#: Length of a cell of the smallest class, growth from class to class, and the largest class.
SIDE, GROWTH, TOP = 16.0, 4.0, 26
#: Places beyond this are taken for it where cells are told, not where overlaps are tested.
FAR = 1e15

#: An axis: where a thing begins and ends on it.
Axis = tuple[Column, Column]


def _length(k: Column) -> Column:
    return F.lit(SIDE) * F.pow(F.lit(GROWTH), k)


def _placed(df: DataFrame, axes: list[Axis]) -> DataFrame:
    """``df`` with ``_low{i}``, ``_high{i}`` and ``_class{i}``; what has no place, or no end after its begin, meets nothing."""
    near = lambda c: F.least(F.greatest(c.cast("double"), F.lit(-FAR)), F.lit(FAR))
    for i, (low, high) in enumerate(axes):
        df = df.withColumns({f"_low{i}": near(low), f"_high{i}": near(high)})
        size = F.col(f"_high{i}") - F.col(f"_low{i}")
        # The logarithm is rounded: a class too small means one cell more, not a pair less.
        k = F.ceil(F.log(F.greatest(size, F.lit(SIDE)) / SIDE) / F.log(F.lit(GROWTH)))
        df = df.withColumn(f"_class{i}", F.least(k, F.lit(TOP)).cast("int")).where(size >= 0)
    return df


def _classes(df: DataFrame, n: int) -> Column:
    """The classes of a side, as an array; at most (TOP + 1) to the power of the axes, mostly a handful."""
    found = df.select(*[f"_class{i}" for i in range(n)]).distinct().collect()
    shape = "struct<" + ",".join(f"k{i}:int" for i in range(n)) + ">"
    return F.array(*[F.struct(*[F.lit(r[f"_class{i}"]).alias(f"k{i}") for i in range(n)]) for r in found]).cast(f"array<{shape}>")


def _in_cells(df: DataFrame, others: Column, n: int) -> DataFrame:
    """``df`` once for each cell that it lies in, of each class in which it may meet the other side."""
    meeting = F.array_distinct(F.transform(others, lambda o: F.struct(*[F.greatest(o[f"k{i}"], F.col(f"_class{i}")).alias(f"k{i}") for i in range(n)])))
    out = df.withColumn("_k", F.explode(meeting))
    for i in range(n):
        cell = lambda at: F.floor(at / _length(F.col(f"_k.k{i}"))).cast("long")  # noqa: E731, B023
        out = out.withColumn(f"_cell{i}", F.explode(F.sequence(cell(F.col(f"_low{i}")), cell(F.col(f"_high{i}")))))
    return out


def _crowded(sides: list[DataFrame], on: list[str]) -> DataFrame | None:
    """The groups that have more than ``CROWD`` rows on a side, hinted for a join; None if there is none."""
    large = [side.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > CROWD).select(*on) for side in sides]
    found = materialized(large[0].union(large[1]).distinct())
    n = found.count()
    return None if not n else F.broadcast(found) if n <= BROADCAST_ROWS else found.hint("merge")


def _met(left: DataFrame, right: DataFrame, key: list[str], on: list[str], n: int) -> DataFrame:
    """Pairs of rows with one key that overlap or touch on all axes; columns of ``right`` get the prefix ``b_``."""
    other = right.select(*key, *[F.col(c).alias(f"b_{c}") for c in right.columns if c not in on and c not in key])
    met = left.join(other.hint("merge"), key)
    for i in range(n):
        met = met.where((F.col(f"_low{i}") <= F.col(f"b__high{i}")) & (F.col(f"b__low{i}") <= F.col(f"_high{i}")))
    return met


def _met_in_cells(left: DataFrame, right: DataFrame, on: list[str], n: int) -> DataFrame:
    cells_a, cells_b = _in_cells(left, _classes(right, n), n), _in_cells(right, _classes(left, n), n)
    met = _met(cells_a, cells_b, [*on, "_k", *[f"_cell{i}" for i in range(n)]], on, n)
    for i in range(n):
        low, k = F.col(f"_low{i}"), F.col(f"_k.k{i}")
        begins = F.floor(F.greatest(low, F.col(f"b__low{i}")) / _length(k)).cast("long")
        met = met.where((k == F.greatest(f"_class{i}", f"b__class{i}")) & (F.col(f"_cell{i}") == begins))
    return met


def meeting(a: DataFrame, b: DataFrame, on: list[str], axes_a: list[Axis], axes_b: list[Axis]) -> DataFrame:
    """Pairs of rows of one group (``on``) that overlap or touch on all axes, each once; columns of ``b`` get the prefix ``b_``.

    Both sides are read twice or more (their groups and classes first): write what is dear to work out.
    """
    n = len(axes_a)
    left, right = _placed(a, axes_a), _placed(b, axes_b)
    shown = [*a.columns, *[f"b_{c}" for c in b.columns if c not in on]]
    crowded = _crowded([left, right], on)
    if crowded is None:
        return _met(left, right, on, on, n).select(*shown)
    few, many = ([side.join(crowded, on, how) for side in (left, right)] for how in ("left_anti", "left_semi"))
    return _met(*few, on, on, n).select(*shown).unionByName(_met_in_cells(*many, on, n).select(*shown))


def box_axes() -> list[Axis]:
    return [(F.col("x"), F.col("x") + F.col("w")), (F.col("y"), F.col("y") + F.col("h"))]


def span_axes() -> list[Axis]:
    return [(F.col("start"), F.col("end"))]
