"""Shuffle pairs to reduce partitions and sort them there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvflow.functions.text import numeric_order
from kvflow.operators.hot_keys import hot_keys, partition_ids


def _reads_shuffle(node) -> bool:
    """Whether a physical plan takes its rows, in whatever order they arrive, from a shuffle."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _reads_shuffle(node.executedPlan())
    if kind in ("BroadcastExchangeExec", "ShuffleExchangeExec"):
        return kind == "ShuffleExchangeExec"
    children = node.children()
    return any(_reads_shuffle(children.apply(i)) for i in range(children.size()))


def with_spread(df: DataFrame) -> DataFrame:
    """Add ``_spread``, a number that tells rows apart that are otherwise alike.

    A task that runs again must give its rows the same numbers. File scans keep their order; rows
    out of a shuffle do not, so they are put in order first.
    """
    if _reads_shuffle(df._jdf.queryExecution().executedPlan()):
        df = df.sortWithinPartitions(*(f.name for f in df.schema if not has_map(f.dataType)))
    return df.withColumn("_spread", F.monotonically_increasing_id())


def has_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


def sort_here(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """Sort inside partitions, computing each sort expression once per row and not per comparison."""
    made = {f"_sort{i}": c for i, c in enumerate(order) if not isinstance(c, str)}
    names = [f"_sort{i}" if f"_sort{i}" in made else c for i, c in enumerate(order)]
    return df.withColumns(made).sortWithinPartitions(*names).drop(*made)


def shuffle(
    kv: DataFrame,
    reduce_tasks: int | None = None,
    numeric: bool = False,
    value_order: str | None = None,
    whole_keys: bool = True,
    hot_share: float | None = None,
) -> DataFrame:
    """Pairs in partitions sorted by key: byte order, or leading number first if ``numeric``.

    ``value_order`` names a column that orders the pairs of one key. With ``whole_keys`` a key
    lies in one partition, as a reducer needs. Without it the pairs are cut into sorted ranges of
    even size, and a key too big for one partition continues in the next.

    With ``hot_share`` every key that has such a share of the pairs gets a partition to itself, and all
    other keys are dealt over the rest; the pairs are read once more for it, so write them first
    where they are costly to make.
    """
    if reduce_tasks is not None and reduce_tasks < 1:
        raise ValueError("a job has at least one reduce task")
    order: list[Column | str] = [*(numeric_order("key")[:2] if numeric else ()), "key"]
    if value_order:
        order.append(value_order)

    count = () if reduce_tasks is None else (reduce_tasks,)
    if hot_share is not None:
        if not whole_keys:
            raise ValueError("keys that may be cut need no partition of their own")
        partitions = reduce_tasks or int(kv.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        place, _ = partition_ids(F.col("key"), hot_keys(kv, hot_share), partitions)
        return sort_here(kv.repartitionById(partitions, place), order)
    if whole_keys:
        return sort_here(kv.repartition(*count, "key"), order)
    moved = with_spread(kv).repartitionByRange(*count, *order, "_spread").drop("_spread")
    return sort_here(moved, order)
