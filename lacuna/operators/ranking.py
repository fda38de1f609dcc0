"""Numbering of rows in a global order without bringing a group, or all rows, into one task.

Rows are dealt by ranges of (group, order), which Spark finds by sampling, and sorted within partitions; a group that is larger
than a partition spreads over several. A row's number is its place in its partition and group plus the rows of that group in
earlier partitions: prefix sums over at most one count for each group and partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.sources.staging import staged

#: ``monotonically_increasing_id`` holds the partition above these bits and the row's place in it below.
_ROW_BITS = 33


def numbered(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "number") -> DataFrame:
    """``df`` with the number of each row, from 1, within its group of equal ``by`` in the given order.

    Nulls in ``by`` are a group. Rows with equal keys are numbered in any order, so the order should end in a unique key; it also lets
    the ranges cut through ties. ``df`` is computed twice, by the sampling and by the write: stage it where that is dear.
    """
    inner = "__"
    while any(c.startswith(inner) for c in df.columns):
        inner += "_"
    at, part, before, first, part_of = (inner + k for k in ("at", "part", "before", "first", "part_of"))
    keys = [F.col(f"`{c}`") for c in by]
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn(at, F.monotonically_increasing_id())
    rows = staged(dealt.withColumn(part, F.shiftright(at, _ROW_BITS)), "ranges")
    counts = rows.groupBy(part, *keys).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(before))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)) - F.col(first) + 1)
    # Renamed, so that null groups can be matched; without groups there is one row a partition.
    offsets = offsets.select(F.col(part).alias(part_of), F.col(before), *[k.alias(f"{inner}by{i}") for i, k in enumerate(keys)])
    same = F.col(part) == F.col(part_of)
    for i, k in enumerate(keys):
        same &= k.eqNullSafe(F.col(f"{inner}by{i}"))
    joined = rows.join(offsets if by else F.broadcast(offsets), same)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(at) + F.col(before)).alias(name))


def firsts(df: DataFrame, by: Sequence[str], key: Column, keep: int, digits: int = 3) -> DataFrame:
    """The rows that can be among the first ``keep`` of their group in the order of ``key``, a hexadecimal hash; all of these, and few others.

    The heads of the keys are counted for each group, and rows stay up to the head that holds a group's ``keep``-th row: about ``keep`` and a
    4096th of the group (with three digits). So no task sorts the rows that it reads. ``df`` is read twice, the first time without its other columns.
    """
    head = F.substring(key, 1, digits)
    heads = df.select(*by, head.alias("__head")).groupBy(*by, "__head").agg(F.count(F.lit(1)).alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(*by).orderBy("__head").rowsBetween(Window.unboundedPreceding, -1))
    needed = heads.withColumn("__before", F.coalesce(earlier, F.lit(0))).where(F.col("__before") < keep)
    last = staged(needed.groupBy(*by).agg(F.max("__head").alias("__last")), "last-heads")  # of known size, so that the planner may broadcast it
    return df.join(last, list(by)).where(head <= F.col("__last")).select(*df.columns)
