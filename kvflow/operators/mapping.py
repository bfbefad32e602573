"""Map: a function called once per record that emits any number of pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kvflow.functions.records import KV_DDL, emitted_records

Mapper = Callable[[str, str], Iterable[tuple]]
Combiner = Callable[[str, Iterable], Iterable[tuple]]

# Rows and characters a task gathers before it hands a batch back to Spark.
OUT_ROWS = 16_384
OUT_CHARS = 8 << 20
STEP_ROWS = 128  # rows between two looks at these sizes, at most
# Pairs, and characters of text in them, a task holds for its combiner before it folds them.
COMBINE_ROWS = 500_000
COMBINE_CHARS = 64 << 20


def read_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


def write_rows(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    rows = iter(rows)
    texts = [pa.types.is_string(field.type) for field in schema]

    def batch():
        arrays = [pa.array(column, field.type) for column, field in zip(columns, schema)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    columns: list[list] = [[] for _ in schema]
    chars, step = 0, 1
    while some := list(islice(rows, step)):
        size = 0
        for column, part, text in zip(columns, zip(*some), texts):
            column.extend(part)
            if text:
                size += sum(map(len, filter(None, part)))
        chars += size
        # the longer the rows, the fewer at a time
        step = max(1, min(STEP_ROWS, OUT_CHARS * len(some) // (size + 1)))
        if len(columns[0]) >= OUT_ROWS or chars >= OUT_CHARS:
            yield batch()
            columns, chars = [[] for _ in schema], 0
    if columns[0]:
        yield batch()


def combined(pairs: Iterable[tuple], combiner: Combiner, records: Callable) -> Iterator[tuple]:
    """Fold pairs of one task per key, in bounded memory; ``records`` as from ``emitter``.

    Folded pairs stay in hand while there are few keys, so a key that fills the task leaves it
    as one pair; with many keys they are passed on.
    """
    groups: dict = {}
    held = chars = 0

    def size(value):
        return len(value) if type(value) is str else 8

    def fold():
        # a single pair has nothing to be folded with; a folded one may come back under its key
        out = {key: values for key, values in groups.items() if len(values) == 1}
        several = [(key, values) for key, values in groups.items() if len(values) > 1]
        calls = (combiner(key, iter(values)) or () for key, values in several)
        for key, value in records(chain.from_iterable(calls)):
            if key in out:
                out[key].append(value)
            else:
                out[key] = [value]
        n = sum(map(len, out.values()))
        return out, n, sum(map(size, out)) + sum(map(size, chain.from_iterable(out.values())))

    for key, value in pairs:
        if key in groups:
            groups[key].append(value)
        else:
            groups[key] = [value]
            chars += size(key)
        held += 1
        chars += len(value) if type(value) is str else 8
        if held >= COMBINE_ROWS or chars >= COMBINE_CHARS:
            groups, held, chars = fold()
            if held > COMBINE_ROWS // 2 or chars > COMBINE_CHARS // 2:
                for k, values in groups.items():
                    for v in values:
                        yield k, v
                groups, held, chars = {}, 0, 0
    groups, held, chars = fold()
    for k, values in groups.items():
        for v in values:
            yield k, v


def _names_and_types(schema: str) -> list[tuple[str, T.DataType]]:
    return [(field.name.lower(), field.dataType) for field in T.StructType.fromDDL(schema)]


def emitter(schema: str, sep: str, num_key_fields: int):
    """How a function's pairs become records: as text read back, or as typed rows."""
    if _names_and_types(schema) == _names_and_types(KV_DDL):
        return lambda pairs: emitted_records(pairs, sep, num_key_fields)
    return lambda pairs: map(tuple, pairs or ())


def _in_tasks(kv: DataFrame, map_tasks: int | None) -> DataFrame:
    """The records dealt over so many tasks; where they are without a number."""
    if map_tasks is None:
        return kv
    if map_tasks < 1:
        raise ValueError("a job has at least one map task")
    return kv.repartition(map_tasks)


def map_kv(
    kv: DataFrame,
    mapper: Mapper,
    schema: str = KV_DDL,
    map_tasks: int | None = None,
    combiner: Combiner | None = None,
    sep: str = "\t",
    num_key_fields: int = 1,
) -> DataFrame:
    """Call ``mapper(key, value)`` per record and return the pairs it emits.

    With the default schema the pairs pass through text, as if written to a stream and read
    back. ``combiner(key, values)`` folds the pairs of one task before they leave it; it may
    be applied any number of times, or not at all. ``map_tasks`` asks for that many tasks, which
    moves all records; without it they are mapped where they are read. Files are better cut for so many
    tasks when they are read (``read_kv(tasks=...)``, which ``run_job`` does): that moves nothing.
    """
    kv = _in_tasks(kv.select("key", "value"), map_tasks)
    arrow_schema = to_arrow_schema(T.StructType.fromDDL(schema))
    records = emitter(schema, sep, num_key_fields)

    def task(batches):
        def emitted():
            for key, value in read_pairs(batches):
                yield from records(mapper(key, value))

        pairs = emitted()
        if combiner is not None:
            pairs = combined(pairs, combiner, records)
        yield from write_rows(pairs, arrow_schema)

    return kv.mapInArrow(task, schema)


def combine_kv(kv: DataFrame, combiner: Combiner, across: bool = False) -> DataFrame:
    """Fold equal keys inside each task, so that a hot key is small before it is shuffled.

    With ``across`` the pairs are dealt and sorted by key first, so that what several tasks left of a
    key is folded too; fold inside the tasks before that.
    """
    if across:
        kv = kv.select("key", "value").repartition("key").sortWithinPartitions("key")
    schema = f"key string, value {kv.schema['value'].dataType.simpleString()}"
    arrow_schema = to_arrow_schema(T.StructType.fromDDL(schema))
    records = emitter(schema, "\t", 1)

    def task(batches):
        yield from write_rows(combined(read_pairs(batches), combiner, records), arrow_schema)

    return kv.select("key", "value").mapInArrow(task, schema)


def map_expr(
    kv: DataFrame, expr: Callable[[Column, Column], Column], map_tasks: int | None = None
) -> DataFrame:
    """Map by a column expression returning ``array<struct<key, value>>``; no Python per row.

    ``map_tasks`` as in ``map_kv``.
    """
    kv = _in_tasks(kv, map_tasks)
    pairs = kv.select(F.inline(expr(F.col("key"), F.col("value"))))
    return pairs.select(pairs[pairs.columns[0]].alias("key"), pairs[pairs.columns[1]].alias("value"))


def register_mapper(spark: SparkSession, name: str, mapper: Mapper, sep: str = "\t") -> None:
    """Make ``mapper`` a SQL table function: ``SELECT m.* FROM kv, LATERAL name(key, value) m``."""
    records = emitter(KV_DDL, sep, 1)

    class MapFunction:
        def eval(self, key: str, value: str):
            yield from records(mapper(key, value))

    spark.udtf.register(name, F.udtf(MapFunction, returnType=KV_DDL, useArrow=True))
