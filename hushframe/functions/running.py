"""Running sums within groups of any size, without a window over one key.

Rows are range-partitioned by group and order, so that a group that holds most rows is spread like
any other. Each partition adds up by itself; only its first group can go on from the partition
before, so that one row a partition, what it ends with, gives what that group is to be raised by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .materialize import materialized


def _breaks(column: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """Whether each value differs from the one before it; nulls are equal."""
    if not len(column):
        return np.zeros(0, bool)
    head = column.slice(0, 1)
    first = before is None or before.as_py() != head[0].as_py()
    differs = pc.coalesce(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)), pc.xor(pc.is_null(column.slice(1)), pc.is_null(column.slice(0, len(column) - 1))))
    return np.concatenate([[first], differs.to_numpy(zero_copy_only=False)]).astype(bool)


def running_sum(df: DataFrame, group: str, order: list[str], weight: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``weight`` (a long without nulls) from the first row of its group up to this one, by ``order``.

    Null is a group like any other. The order of rows equal in ``order`` is not defined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried, seen = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            breaks = _breaks(batch.column(group), last)
            total = np.cumsum(batch.column(weight).to_numpy(zero_copy_only=False)) + carried
            # What had been added up when the group of each row began.
            at = np.maximum.accumulate(np.where(breaks, np.arange(len(total)), -1))
            began = np.where(at >= 0, np.where(at > 0, total[at - 1], carried), 0)
            sums = total - began
            groups = seen + np.cumsum(breaks)
            last, carried, seen = batch.column(group)[-1], int(sums[-1]), int(groups[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64()), pa.array(np.full(len(sums), part), pa.int32()), pa.array(groups == 1)], [*batch.schema.names, name, "_part", "_leads"])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, F.col(group), *order).sortWithinPartitions(group, *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    local = materialized(dealt.mapInArrow(run, f"{schema}, `{name}` long, _part int, _leads boolean"))
    # Of each partition the sum and group that it ends with, and the group that it begins with.
    ends = F.struct(F.col(group).alias("group"), F.col(name).alias("sum"), F.col("_leads").alias("leads"))
    found = local.withColumn("_place", F.monotonically_increasing_id()).groupBy("_part").agg(F.min_by(F.struct(F.col(group).alias("group")), "_place").alias("first"), F.max_by(ends, "_place").alias("last")).orderBy("_part").collect()
    raised, before = {}, None
    for r in found:
        same = before is not None and before[0] == r["first"]["group"]
        raised[r["_part"]] = before[1] if same else 0
        before = (r["last"]["group"], r["last"]["sum"] + (raised[r["_part"]] if r["last"]["leads"] else 0))
    offsets = F.array(*[F.lit(raised.get(i, 0)).cast("long") for i in range(max(raised, default=0) + 1)])
    lifted = F.col(name) + F.when(F.col("_leads"), F.element_at(offsets, F.col("_part") + 1)).otherwise(0)
    return local.withColumn(name, lifted).drop("_part", "_leads")
