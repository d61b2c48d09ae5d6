"""Positions in a total order, also inside groups of any size, without a task that sees a whole table or group.

Rows are dealt by ranges of the order, numbered inside each range, and moved on by the rows of the ranges before. A window
without a partition key, or over a group that holds much of a table, would send all of it through one task.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

_AT = "__spanloom_at"
#: ``monotonically_increasing_id`` has a task's number above this bit and the row's number below it.
_TASK_BITS = 33


def positioned(df: DataFrame, order: list[Column], group: tuple[str, ...] = (), name: str = "position") -> DataFrame:
    """``df`` with each row's place from 1 in ``order`` (inside ``group``), in a column ``name``.

    Equal rows get different places in no defined order, so ``order`` should end in a column that tells rows apart. Nulls
    are ordered as ``order`` says; a null in a group column is a group. An empty table stays empty. ``df`` is read twice
    (ranges are drawn from a sample) and written once.
    """
    keys = [F.col(g) for g in group]
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = stored(dealt.withColumn(_AT, F.monotonically_increasing_id()), "ranks")
    task = F.shiftright(_AT, _TASK_BITS)
    counts = sorted(rows.groupBy(task.alias("t")).count().collect())  # a row for each task of the shuffle
    before = accumulate((n for _, n in counts), initial=0)
    moved = [(t, b) for (t, _), b in zip(counts, before, strict=False)]
    offsets = df.sparkSession.createDataFrame(moved, "__spanloom_task long, __spanloom_before long")
    place = F.col("__spanloom_before") + F.col(_AT).bitwiseAND((1 << _TASK_BITS) - 1) + 1
    rows = rows.withColumn("__spanloom_task", task).join(F.broadcast(offsets), "__spanloom_task").withColumn(name, place.cast("long")).drop("__spanloom_task", "__spanloom_before", _AT)
    if not group:
        return rows
    named = [f"__spanloom_group{i}" for i in range(len(group))]
    firsts = rows.groupBy(*[F.col(g).alias(n) for g, n in zip(group, named, strict=True)]).agg(F.min(name).alias("__spanloom_first"))
    same = [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group, named, strict=True)]
    return rows.join(firsts, same).withColumn(name, F.col(name) - F.col("__spanloom_first") + 1).drop("__spanloom_first", *named)
