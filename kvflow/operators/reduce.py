"""Reduce: a function called once per key with a single-pass stream of values."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby, islice
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from kvflow.functions import text
from kvflow.functions.records import KV_DDL
from kvflow.operators.mapping import (
    OUT_ROWS,
    Combiner,
    combine_kv,
    emitter,
    read_pairs,
    write_rows,
)
from kvflow.operators.order import stored
from kvflow.operators.shuffle import shuffle

Reducer = Callable[[str, Iterable], Iterable[tuple]]

GROUPS_A_PARTITION = 32  # groups of keys that a table function asks for, for each shuffle partition
_FED_ROWS = 1024  # pairs handed to the reducers' thread, and rows from it, at a time

_VALUE_TYPES = {
    "string": text.to_text,
    "int": text.parse_int,
    "long": text.parse_long,
    "float": text.parse_float,
    "double": text.parse_double,
    "bool": text.parse_bool,
}


def typed_values(kv: DataFrame, value_type: str) -> DataFrame:
    """The pairs with their value text parsed as ``value_type``."""
    if value_type not in _VALUE_TYPES:
        raise ValueError(f"unknown value type {value_type!r}; known: {', '.join(_VALUE_TYPES)}")
    return kv.select("key", _VALUE_TYPES[value_type]("value").alias("value"))


def reduce_kv(
    kv: DataFrame,
    reducer: Reducer | None,
    schema: str = KV_DDL,
    reduce_tasks: int | None = None,
    numeric: bool = False,
    value_order: str | None = None,
    value_type: str = "string",
    combiner: Combiner | None = None,
    sep: str = "\t",
    num_key_fields: int = 1,
    hot_share: float | None = None,
) -> DataFrame:
    """Call ``reducer(key, values)`` once per key and return the pairs it emits.

    ``values`` streams out of the sorted partition and is never held as a whole; what the
    reducer leaves unread is skipped. Without a reducer the sorted pairs pass through. A
    ``combiner`` folds each task's pairs before the shuffle: give one wherever the reducer
    allows it, since all remaining values of a key are read by a single task. ``hot_share`` gives
    each key with such a share of the pairs a task of its own, see ``shuffle``.
    """
    if value_type != "string":
        kv = typed_values(kv, value_type)
    if reducer is None:
        return shuffle(kv, reduce_tasks, numeric, value_order, whole_keys=False)
    if combiner is not None:
        kv = combine_kv(kv, combiner)
    if hot_share is not None:
        kv = stored(kv.select("key", "value"), "reduce-pairs")
    arrow_schema = to_arrow_schema(T.StructType.fromDDL(schema))
    records = emitter(schema, sep, num_key_fields)

    def task(batches):
        def reduced():
            for key, group in groupby(read_pairs(batches), itemgetter(0)):
                yield from records(reducer(key, map(itemgetter(1), group)))

        yield from write_rows(reduced(), arrow_schema)

    ordered = shuffle(kv.select("key", "value"), reduce_tasks, numeric, value_order, hot_share=hot_share)
    return ordered.mapInArrow(task, schema)


def reduce_group(
    kv: DataFrame,
    fn: Callable[[str, Iterable[pd.Series]], Iterable[tuple]],
    schema: str = KV_DDL,
    combiner: Combiner | None = None,
) -> DataFrame:
    """Call ``fn(key, batches)`` per key, its values coming as pandas series of bounded size."""
    if combiner is not None:
        kv = combine_kv(kv, combiner)
    names = T.StructType.fromDDL(schema).fieldNames()
    records = emitter(schema, "\t", 1)

    def group(key: tuple, frames):
        rows = records(fn(key[0], (frame["value"] for frame in frames)))
        while part := list(islice(rows, OUT_ROWS)):
            yield pd.DataFrame(part, columns=names)

    # these hints tell Spark to hand the group over batch by batch
    frames = Iterator[pd.DataFrame]
    group.__annotations__ = {"key": tuple[object, ...], "frames": frames, "return": frames}
    return kv.select("key", "value").groupBy("key").applyInPandas(group, schema)


def reduce_agg(kv: DataFrame, **aggs: Column) -> DataFrame:
    """Reduce by native aggregates, which fold equal keys before and after the shuffle."""
    if not aggs:
        raise ValueError("name at least one aggregate")
    return kv.groupBy("key").agg(*(column.alias(name) for name, column in aggs.items()))


class _Fed:
    """Reducers that read their values while these arrive, one key after the other in one thread.

    Pairs wait in a short queue and results in another, so neither a group nor what a reducer emits is
    held; what a reducer leaves unread is dropped.
    """

    def __init__(self, reducer: Reducer, records: Callable):
        self.queue: queue.Queue = queue.Queue(maxsize=4)
        self.out: queue.Queue = queue.Queue(maxsize=4)
        self.chunk: list[tuple] = []
        self.trouble: BaseException | None = None
        self.stop = threading.Event()

        def emit(rows: list) -> None:
            while not self.stop.is_set():
                try:
                    return self.out.put(rows, timeout=0.5)
                except queue.Full:
                    continue

        def work():
            try:
                pairs, rows = chain.from_iterable(iter(self.queue.get, None)), []
                for key, group in groupby(pairs, itemgetter(0)):
                    for record in records(reducer(key, map(itemgetter(1), group))):
                        rows.append(record)
                        if len(rows) >= _FED_ROWS:
                            emit(rows)
                            rows = []
                emit(rows)
            except BaseException as error:  # raised again where the rows come from
                self.trouble = error

        self.thread = threading.Thread(target=work, daemon=True)
        self.thread.start()

    def _ready(self) -> Iterator[tuple]:
        while True:
            try:
                yield from self.out.get_nowait()
            except queue.Empty:
                return

    def _put(self, item: list | None) -> Iterator[tuple]:
        """Hand on some pairs or the end; results are taken meanwhile, so neither side waits for the other."""
        while self.thread.is_alive():
            try:
                self.queue.put(item, timeout=0.05)
                break
            except queue.Full:
                yield from self._ready()
        yield from self._ready()

    def add(self, pair: tuple) -> Iterator[tuple]:
        self.chunk.append(pair)
        if len(self.chunk) >= _FED_ROWS:
            chunk, self.chunk = self.chunk, []
            yield from self._put(chunk)

    def finish(self) -> Iterator[tuple]:
        yield from self._put(self.chunk)
        yield from self._put(None)
        while self.thread.is_alive():
            yield from self._ready()
            self.thread.join(0.005)
        yield from self._ready()
        if self.trouble is not None:
            raise self.trouble


def register_reducer(
    spark: SparkSession, name: str, reducer: Reducer, schema: str = KV_DDL, value_order: bool | None = None
) -> None:
    """Make ``reducer`` a SQL table function.

    It is called as by ``reduce_kv``, with a single-pass stream of values per key, and its rows have
    ``schema``, or that of the call: ``SELECT * FROM name(TABLE(kv), 'key string, total bigint')``. With
    ``value_order`` true or false the function itself asks for its rows: dealt by a hash of the key over
    32 groups for each shuffle partition, in order of key, and of value if true; all keys of
    a group pass through one thread. Without it the call says ``TABLE(kv) PARTITION BY key [ORDER BY
    value]``, and each key has a thread of its own, which costs far more where keys are many.
    A key's rows go to one task: fold them first (``combine_kv``) where a key may be hot. Spark hands a
    table function one row at a time, at a high price: fold what tasks left of the same keys as well
    (``combine_kv`` with ``across``) where that is much.
    """
    # Spark deals groups by a hash of their numbers: of few groups some partitions get several, others none
    groups = GROUPS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    registered = T.StructType.fromDDL(schema)
    as_text, as_rows = emitter(KV_DDL, "\t", 1), emitter("key bigint", "\t", 1)
    pairs_of_text = T.StructType.fromDDL(KV_DDL)

    class ReduceFunction:
        @staticmethod
        def analyze(pairs: AnalyzeArgument, result: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not pairs.isTable or {"key", "value"} - {f.name.lower() for f in pairs.dataType}:
                raise ValueError(f"{name} takes TABLE(...) with columns key and value")
            found = _TypedRows(registered if result is None else _simple_schema(result.value))
            found.text = found.schema == pairs_of_text
            if value_order is not None:
                found.partitionBy = [PartitioningColumn(f"pmod(hash(key), {groups})")]
                found.orderBy = [OrderingColumn("key")] + [OrderingColumn("value")] * value_order
            return found

        def __init__(self, call: _TypedRows):
            self.fed = None
            self.records = as_text if call.text else as_rows

        def eval(self, row: T.Row, result: str | None = None):
            if self.fed is None:
                self.fed = _Fed(reducer, self.records)
            yield from self.fed.add((row["key"], row["value"]))

        def terminate(self):
            if self.fed is not None:
                yield from self.fed.finish()

    spark.udtf.register(name, F.udtf(ReduceFunction))


@dataclass
class _TypedRows(AnalyzeResult):
    """What a call of a reducer's table function was found to return; ``text`` if its rows are pairs of text."""

    text: bool = False


_SIMPLE_TYPES = {
    name: kind
    for kind in (
        T.StringType(), T.BinaryType(), T.BooleanType(), T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(),
        T.FloatType(), T.DoubleType(), T.DateType(), T.TimestampType(), T.TimestampNTZType(),
    )
    for name in (kind.simpleString(), kind.typeName())
}


def _simple_schema(ddl: str) -> T.StructType:
    """``name type, name type``, read without Spark, as a call of a table function is analyzed apart from it."""
    out = T.StructType()
    for part in ddl.split(","):
        name, _, kind = part.strip().replace(":", " ").partition(" ")
        if kind.strip().lower() not in _SIMPLE_TYPES:
            raise ValueError(f"{part.strip()!r} is no name and simple type; give other types when registering")
        out = out.add(name.strip("`"), _SIMPLE_TYPES[kind.strip().lower()])
    return out
