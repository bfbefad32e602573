"""Small helpers of this subpackage: stored tables, Arrow maps that keep columns, text hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kvflow.session import scratch_path
from kvflow.sources.paths import delete_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables that ``stored`` has written and nobody has released, by application.
_OPEN: dict[str, list[str]] = {}


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """A table written once below the shared folder and read again, which cuts the lineage; its path."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``written``, to be removed by ``release``."""
    table_, path = written(df, label)
    _OPEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return table_


def release(spark: SparkSession) -> None:
    """Remove all tables that operators have stored so far; results that read them must be written."""
    for path in _OPEN.pop(spark.sparkContext.applicationId, []):
        delete_path(spark, path)


#: Rows of a stored table that is sent to every task instead of being shuffled; they are some hundred bytes each.
BROADCAST_ROWS = 1 << 14


def spread(table_: DataFrame) -> DataFrame:
    """A stored table, marked to be sent to every task if it is small; else joins shuffle it."""
    return F.broadcast(table_) if table_.count() <= BROADCAST_ROWS else table_


def in_block_pairs(rows: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """``rows`` of buckets that are in ``sizes`` (bucket, blocks), with columns x, y, block.

    A bucket in several blocks, by the hash of column ``key``, is dealt over its pairs of blocks (x <= y);
    the rows of all others, nearly all, are there once.
    """
    sizes = stored(sizes, "block-sizes")
    placed = rows.join(sizes, "bucket")
    if sizes.filter("blocks > 1").isEmpty():
        zero = F.lit(0)
        return placed.withColumns({"x": zero, "y": zero, "block": zero}).drop("blocks")
    placed = placed.withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns(
        {"x": F.least("block", "_other"), "y": F.greatest("block", "_other")}
    ).drop("_other", "blocks")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names, in any case, an operator wants for its results."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


#: Arrays over the words of a batch take about ten times its bytes, so tasks work on this much at once.
PIECE_BYTES = 2 << 20


def pieces(batch: pa.RecordBatch, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of at most so many bytes; a larger row is a run of its own."""
    if batch.nbytes <= most or batch.num_rows < 2:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from pieces(batch.slice(0, half), most)
        yield from pieces(batch.slice(half), most)


def map_batches(
    df: DataFrame, added: T.StructType, task: Callable[[pa.RecordBatch], list[pa.Array]], drop: tuple[str, ...] = ()
) -> DataFrame:
    """Add columns computed batch by batch; columns in ``drop`` are read but not returned."""
    kept = [f for f in without(df, *[f.name for f in added]).schema if f.name not in drop]
    source = df.columns
    names = [f.name for f in kept]
    schema = T.StructType(kept + list(added))
    types = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole)):
            batch = pa.RecordBatch.from_arrays(batch.columns, names=source)
            made = [column.cast(kind) for column, kind in zip(task(batch), types, strict=True)]
            columns = [batch.column(source.index(name)) for name in names] + made
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole groups, of about so many rows: rows that agree in the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            column = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= column[1:] != column[:-1]
            new[0] |= bool(held) and held[-1].column(k)[-1].as_py() != column[0]
        cuts = np.flatnonzero(new)
        if count + batch.num_rows >= rows and len(cuts):
            cut = int(cuts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)], batch.schema)
            held, count, batch = [], 0, batch.slice(cut)
        held.append(batch)
        count += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def lists(offsets, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
