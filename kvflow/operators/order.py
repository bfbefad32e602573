"""Rows in a total order, cut into sorted partitions, with running totals over all of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvflow.functions.text import numeric_order
from kvflow.operators.shuffle import sort_here, with_spread
from kvflow.session import scratch_path

_ROW_MASK = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in its low 33 bits


def ordered_table(
    df: DataFrame, order_by: list[Column | str], partitions: int | None = None
) -> DataFrame:
    """``df`` in ranges of ``order_by``, sorted, with the range's number and the row's place in it.

    Rows that tie are spread by their place in the input, so ranges stay even when one key fills
    a third of the table. Range numbers hold only until the next shuffle: write the table before
    using them twice.
    """
    count = () if partitions is None else (partitions,)
    moved = with_spread(df).repartitionByRange(*count, *order_by, "_spread")
    return (
        sort_here(moved, [*order_by, "_spread"])
        .drop("_spread")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_MASK)))
    )


def stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def changes(column: pa.Array, before) -> np.ndarray:
    """Whether each value differs from the one before it; NULLs are alike."""
    previous = pa.concat_arrays([pa.array([before], column.type), column.slice(0, len(column) - 1)])
    both = pc.fill_null(pc.not_equal(column, previous), False)
    one = pc.not_equal(pc.is_null(column), pc.is_null(previous))
    return pc.or_(both, one).to_numpy(zero_copy_only=False)


def _running(group_by: list[str]):
    """Add the total weight before each row: since the partition's start and since its group's."""

    def task(batches):
        total = 0
        group_start = -1  # running total where the group began; -1: before this partition
        last: list | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            weight = batch.column("_weight").to_numpy(zero_copy_only=False)
            local = total + np.cumsum(weight) - weight
            starts = np.zeros(batch.num_rows, dtype=bool)
            for i, name in enumerate(group_by):
                column = batch.column(name)
                changed = changes(column, column[0].as_py() if last is None else last[i])
                starts |= changed
            begun = np.maximum.accumulate(np.where(starts, local, group_start))
            columns = batch.columns + [
                pa.array(local, pa.int64()),
                pa.array(local - np.maximum(begun, 0), pa.int64()),
                pa.array(begun < 0),
            ]
            names = batch.schema.names + ["_local", "_group_local", "_head"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            total = int(local[-1] + weight[-1])
            group_start = int(begun[-1])
            last = [batch.column(name)[-1].as_py() for name in group_by]

    return task


def _earlier(last_row: int):
    return Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, last_row)


class OrderedTotals:
    """A written, ordered table whose rows know their running total inside their partition.

    ``starts`` has one row per partition, a few thousand at most, and gives what to add; it is
    the only thing that is broadcast or brought together in one task.
    """

    def __init__(
        self,
        df: DataFrame,
        order_by: list[Column | str],
        weight: Column | None = None,
        group_by: list[str] | None = None,
        partitions: int | None = None,
    ):
        self.columns = df.columns
        self.group_by = list(group_by or [])
        if weight is not None:
            df = df.withColumn("_weight", weight.cast("bigint"))
        rows = ordered_table(df, [*self.group_by, *order_by], partitions)
        if weight is None and not self.group_by:
            # positions only: the row's place is its running total, without leaving the JVM
            rows = rows.withColumn("_local", F.col("_row")).withColumn("_weight", F.lit(1).cast("bigint"))
        else:
            if weight is None:
                rows = rows.withColumn("_weight", F.lit(1).cast("bigint"))
            ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
            rows = rows.mapInArrow(
                _running(self.group_by), f"{ddl}, _local bigint, _group_local bigint, _head boolean"
            )
        self.table = stored(rows, "ordered")

    @property
    def starts(self) -> DataFrame:
        parts = self.table.groupBy("_part").agg(F.sum("_weight").alias("_total"))
        start = F.coalesce(F.sum("_total").over(_earlier(-1)), F.lit(0))
        return parts.select("_part", "_total", start.alias("_start"))

    def total(self) -> int:
        row = self.table.agg(F.sum("_weight").alias("n")).first()
        return int(row["n"] or 0)

    def running(self, name: str) -> DataFrame:
        """The rows with ``name``: the total weight of all rows before this one."""
        starts = F.broadcast(self.starts.select("_part", "_start"))
        joined = self.table.join(starts, "_part")
        return joined.select(*self.columns, (F.col("_local") + F.col("_start")).alias(name))

    def running_in_group(self, name: str) -> DataFrame:
        """The rows with ``name``: the total weight of the rows of their group before this one."""
        key = F.struct(*self.group_by)
        parts = self.table.groupBy("_part").agg(
            F.min_by(key, "_row").alias("first"),
            F.max_by(key, "_row").alias("last"),
            F.max_by(F.col("_group_local") + F.col("_weight"), "_row").alias("tail"),
            F.bool_and("_head").alias("one_group"),
        )
        by_part = Window.orderBy("_part")
        parts = parts.withColumn(
            "continued", F.coalesce(F.col("first").eqNullSafe(F.lag("last").over(by_part)), F.lit(False))
        ).withColumn("before", F.coalesce(F.sum("tail").over(_earlier(-1)), F.lit(0)))
        # a group's carry reaches back over partitions that hold nothing else
        opens = F.when(~(F.col("one_group") & F.col("continued")), F.col("before"))
        parts = parts.withColumn("since", F.last(opens, ignorenulls=True).over(_earlier(-1)))
        carry = F.when(F.col("continued"), F.col("before") - F.col("since")).otherwise(F.lit(0))
        parts = F.broadcast(parts.select("_part", carry.alias("_carry")))
        joined = self.table.join(parts, "_part")
        value = F.col("_group_local") + F.when(F.col("_head"), F.col("_carry")).otherwise(F.lit(0))
        return joined.select(*self.columns, value.alias(name))


def total_order(
    kv: DataFrame,
    numeric: bool = False,
    name: str = "pos",
    key: str = "key",
    partitions: int | None = None,
) -> DataFrame:
    """The rows with their 1-based position in key order, ties broken by the other columns."""
    order: list[Column | str] = [key, *(c for c in kv.columns if c != key)]
    if numeric:
        order = [*numeric_order(key)[:2], *order]
    ranked = OrderedTotals(kv, order, partitions=partitions).running("_before")
    return ranked.select(*kv.columns, (F.col("_before") + 1).alias(name))
