"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Rows have a place on the ring by the hash of their key. The ring is cut into cells; a cell belongs to
the next virtual node clockwise. Rows arrive in ring order; those that meet a full shard go on
clockwise to the next virtual node whose shard has room. As only the number of rows in each cell
matters for that, one count per cell decides where each row goes, and each row's place inside its
cell picks the shard: one aggregate of ``CELLS`` rows and one shuffle by cell. A cell that one key has
made hot is ranked in parts, by the hash of whole rows.

Without slack the capacities add up to the number of rows, so shards differ by one row at most.

Defined results: a null key has the place of the empty string; repeated keys share a place and are
ordered by the hash of the whole row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvflow.llm.common import without

#: Cells of the ring: the most rows of the one table that is collected.
CELLS = 1 << 14
VIRTUAL_NODES = 128
#: A cell is cut in parts of so many times the mean, and of so many rows at least.
HOT_CELL, HOT_ROWS = 64, 4096
_DIGITS = 15


def place(key: Column) -> Column:
    """60 bits of the key's MD5."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("long")


def owners(shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> list[list[int]]:
    """For each cell the virtual nodes' shards that stand at its end, in clockwise order."""
    nodes: list[list[tuple[int, int]]] = [[] for _ in range(cells)]
    for shard in range(shards):
        for node in range(virtual_nodes):
            at = int(hashlib.md5(f"{shard}/{node}".encode()).hexdigest()[:_DIGITS], 16)
            nodes[at * cells >> 4 * _DIGITS].append((at, shard))
    return [[shard for _, shard in sorted(cell)] for cell in nodes]


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack:
        return [math.ceil(rows * (1 + slack) / shards)] * shards
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def deal(counts: dict[int, int], shards: int, slack: float, virtual_nodes: int, cells: int) -> Iterator[tuple]:
    """(cell, first rank, last rank exclusive, shard, first slot): where each cell's rows go."""
    room = capacities(sum(counts.values()), shards, slack)
    ring = [(cell, shard) for cell, own in enumerate(owners(shards, virtual_nodes, cells)) for shard in own]
    used = [0] * shards
    head = 0  # first node at or after the cell
    for cell in range(cells):
        while head < len(ring) and ring[head][0] < cell:
            head += 1
        left, rank, node = counts.get(cell, 0), 0, head
        while left:
            shard = ring[node % len(ring)][1]
            take = min(left, room[shard] - used[shard])
            if take:
                yield cell, rank, rank + take, shard, used[shard]
                used[shard] += take
                rank += take
                left -= take
            node += 1


def shard_rows(
    df: DataFrame,
    key_col: str,
    shards: int,
    slack: float = 0.0,
    virtual_nodes: int = VIRTUAL_NODES,
    cells: int = CELLS,
) -> DataFrame:
    """``df`` with shard and slot; slots of a shard count from 0 without gaps.

    No shard gets more than ``(1 + slack)`` times the mean, rounded up. Columns of ``df`` named shard
    or slot are replaced; all others stay as they are, whatever their names.
    """
    width = (1 << 4 * _DIGITS) // cells
    if cells & (cells - 1):
        raise ValueError("the number of cells must be a power of two")
    columns = [F.col(f"`{c}`") for c in without(df, "shard", "slot").columns]
    at = place(F.col(key_col))
    # all columns as one, so that none meets the names used here
    rows = df.select(
        F.struct(F.lit(0).alias("_"), *columns).alias("_columns"), at.alias("_place"),
        F.shiftright(at, width.bit_length() - 1).cast("int").alias("_cell"), F.xxhash64(*columns).alias("_hash"),
    )
    spark = df.sparkSession
    counts = {r[0]: r[1] for r in rows.groupBy("_cell").count().collect()}
    rows, firsts = _in_parts(rows, counts, cells)
    dealt = spark.createDataFrame(
        list(deal(counts, shards, slack, virtual_nodes, cells)), "_cell int, _from long, _to long, shard int, _slot long"
    )
    order = Window.partitionBy("_cell", "_part").orderBy("_place", "_hash")
    rank = F.row_number().over(order).cast("long") - 1
    ranked = rows.withColumn("_rank", rank)
    if firsts:
        first = spark.createDataFrame(firsts, "_cell int, _part int, _first long")
        ranked = ranked.join(F.broadcast(first), ["_cell", "_part"], "left")  # a row per part of a hot cell
        ranked = ranked.withColumn("_rank", F.col("_rank") + F.coalesce("_first", F.lit(0)))
    near = F.broadcast(dealt)  # two rows per cell and one per shard at most, on average
    return ranked.join(near, "_cell").filter("_rank >= _from AND _rank < _to").select(
        *[F.col("_columns").getField(c).alias(c) for c in without(df, "shard", "slot").columns],
        "shard", (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"),
    )


def _in_parts(rows: DataFrame, counts: dict[int, int], cells: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """``rows`` with their part of the cell, and (cell, part, rank of its first row) of cells in several parts.

    A cell with many times the mean, as when one key has a third of all rows, is cut by the hash of
    whole rows, and each part is counted. Rows that are alike in all columns stay in one part.
    """
    most = max(HOT_CELL * sum(counts.values()) // cells, HOT_ROWS)
    hot = {cell: -(-n // most) for cell, n in counts.items() if n > most}
    if not hot:
        return rows.withColumn("_part", F.lit(0)), []
    parts = F.create_map(*(F.lit(x) for pair in hot.items() for x in pair))
    split = F.pmod(F.xxhash64("_hash"), F.coalesce(F.try_element_at(parts, "_cell"), F.lit(1))).cast("int")
    rows = rows.withColumn("_part", split)
    sizes = rows.filter(F.col("_cell").isin(list(hot))).groupBy("_cell", "_part").count().collect()
    firsts, cell, rank = [], None, 0
    for r in sorted(sizes, key=lambda r: (r["_cell"], r["_part"])):
        if r["_cell"] != cell:
            cell, rank = r["_cell"], 0
        firsts.append((cell, r["_part"], rank))
        rank += r["count"]
    return rows, firsts
