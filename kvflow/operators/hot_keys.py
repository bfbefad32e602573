"""Keys that hold a large share of all rows, and partitions of their own for them."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kvflow.session import scratch_path


class Sketch:
    """Misra-Gries counters: each key's count is at most rows / (size + 1) too low, never too high."""

    def __init__(self, size: int):
        self.size = size
        self.counts: dict = {}
        self.rows = 0

    def add(self, keys: pa.Array) -> None:
        """Count a batch of keys at once: its own counts are merged, then the least are taken off."""
        self.rows += len(keys)
        for pair in keys.value_counts():
            key = pair["values"].as_py()
            self.counts[key] = self.counts.get(key, 0) + pair["counts"].as_py()
        if len(self.counts) > self.size:
            less = sorted(self.counts.values(), reverse=True)[self.size]
            self.counts = {key: n - less for key, n in self.counts.items() if n > less}


def hot_keys(df: DataFrame, share: float, key: str = "key") -> list:
    """All keys with at least ``share`` of the rows, most frequent first, in one pass.

    Each task keeps a sketch of ``2 / share`` counters, and sketches are added up. A key is returned if
    it has half the share for certain, so the list has ``2 / share`` keys at most.
    """
    if not 0 < share <= 1:
        raise ValueError("the share is above 0 and at most 1")
    size = math.ceil(2 / share)
    ddl, kind = df.schema[key].dataType.simpleString(), to_arrow_type(df.schema[key].dataType)

    def task(batches):
        sketch = Sketch(size)
        for batch in batches:
            if batch.num_rows:
                sketch.add(batch.column(0))
        rows = [(None, sketch.rows, True)] + [(k, n, False) for k, n in sketch.counts.items()]
        keys, counts, totals = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, kind), pa.array(counts, pa.int64()), pa.array(totals)], names=["key", "n", "total"]
        )

    counted = df.select(key).mapInArrow(task, f"key {ddl}, n bigint, total boolean")
    # written, as it is read twice: for the number of rows, and for the keys that have enough of them
    path = scratch_path(df.sparkSession, "hot-keys")
    counted.groupBy("key", "total").agg(F.sum("n").alias("n")).write.parquet(path)
    sums = df.sparkSession.read.parquet(path)
    rows = sums.filter("total").agg(F.sum("n")).first()[0] or 0
    found = sums.filter("NOT total").filter(F.col("n") >= rows * (share / 2)).orderBy(F.desc("n"), "key")
    return [r["key"] for r in found.collect()]


def partition_ids(key: Column, hot: list, partitions: int) -> tuple[Column, int]:
    """A partition for each key: one for each hot key, the others shared by all the rest; and how many are hot.

    One partition at least is left for the rest, so the foremost ``partitions - 1`` keys are taken; NULL is
    never one of them.
    """
    hot = [k for k in hot if k is not None][: partitions - 1]
    rest = F.pmod(F.hash(key), F.lit(partitions - len(hot))) + F.lit(len(hot))
    if not hot:
        return rest, 0
    places = F.create_map(*(x for i, k in enumerate(hot) for x in (F.lit(k), F.lit(i))))
    return F.coalesce(F.try_element_at(places, key), rest), len(hot)
