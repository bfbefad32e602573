"""First free name: ``name``, ``name-1``, ``name-2``, ... for many rows at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvflow.operators.order import OrderedTotals, stored

#: Taken serials that are numbered in one task, and free ones that one row of steps stands for.
BLOCK, STEP = 1 << 16, 1 << 10

_SERIAL = r"(?s)^(.*)-([1-9][0-9]{0,17})\z"


def assign_unique_names(
    df: DataFrame, name: str, existing: DataFrame | None, order_by: list[str], out: str = "unique_name"
) -> DataFrame:
    """Give each row, in ``order_by`` order, the first name not taken before it.

    ``existing`` has the taken names in its first column. Requested names must not look like
    serials of each other (``a`` and ``a-1``): which one is free would depend on both.
    """
    keys = [f"_key{i}" for i in range(len(order_by))]
    rows = df.select(
        F.col(name).alias("_name"), *(F.col(c).alias(k) for c, k in zip(order_by, keys)),
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_columns"),
    )
    wanted = stored(rows.select("_name").distinct(), "wanted-names")
    clash = wanted.select(F.regexp_extract("_name", _SERIAL, 1).alias("_name")).filter("_name <> ''")
    if not wanted.join(clash, "_name", "left_semi").isEmpty():
        raise ValueError("some requested names are serials of other requested names")

    # the rows pass through one ordered write; what is taken is brought to them as small steps
    ranked = OrderedTotals(rows, keys, group_by=["_name"]).running_in_group("_free")
    serial = F.col("_free")
    taken = None if existing is None else stored(_taken_serials(existing, wanted), "taken-names")
    if taken is not None and not taken.isEmpty():
        ranked = ranked.withColumn("_step", F.floor(F.col("_free") / STEP))
        steps = stored(_steps(_taken_runs(taken), ranked.select("_name", "_step")), "name-steps")
        skipped = F.aggregate(
            F.filter("_runs", lambda run: run["free"] <= F.col("_free")), F.lit(0).cast("bigint"), lambda n, run: n + run["n"]
        )
        ranked = ranked.join(steps, ["_name", "_step"], "left")
        serial = serial + F.coalesce(F.col("_before") + skipped, F.lit(0))
    full = F.when(serial == 0, F.col("_name")).otherwise(F.concat("_name", F.lit("-"), serial))
    return ranked.select(*(F.col(f"_columns.`{c}`") for c in df.columns), full.alias(out))


def _earlier(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def _taken_runs(taken: DataFrame) -> DataFrame:
    """``(_name, free, n)``: n taken serials in a row, with so many free ones below them.

    Serial s, the i-th taken one of its name (from 0), has s - i free ones below it; serials that
    follow each other have the same number. A row with r free serials before its own skips every run
    with at most r. Serials are counted in blocks, so that no task holds all of a name.
    """
    blocks = taken.withColumn("_block", F.floor(F.col("_serial") / BLOCK))
    sizes = blocks.groupBy("_name", "_block").agg(F.count("*").alias("_n"))
    below = F.coalesce(F.sum("_n").over(_earlier(Window.partitionBy("_name").orderBy("_block"))), F.lit(0))
    starts = sizes.select("_name", "_block", below.alias("_below"))
    inside = F.row_number().over(Window.partitionBy("_name", "_block").orderBy("_serial")) - 1
    ranked = blocks.withColumn("_inside", inside).join(starts, ["_name", "_block"])
    free = (F.col("_serial") - F.col("_below") - F.col("_inside")).alias("free")
    return ranked.select("_name", free).groupBy("_name", "free").agg(F.count("*").alias("n"))


def _steps(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """``(_name, _step, _runs, _before)`` for each step of ``STEP`` free serials that has rows or runs:
    the runs that begin in it, and how many serials are taken before it."""
    own = runs.groupBy("_name", F.floor(F.col("free") / STEP).alias("_step")).agg(
        F.collect_list(F.struct("free", "n")).alias("_runs"), F.sum("n").alias("_n")
    )
    asked = rows.distinct().join(runs.select("_name").distinct(), "_name", "left_semi")
    both = asked.join(own, ["_name", "_step"], "full_outer")
    before = F.coalesce(F.sum("_n").over(_earlier(Window.partitionBy("_name").orderBy("_step"))), F.lit(0))
    nothing = F.array().cast("array<struct<free: bigint, n: bigint>>")
    return both.select("_name", "_step", F.coalesce("_runs", nothing).alias("_runs"), before.alias("_before"))


def _taken_serials(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(_name, _serial)`` of the taken names that a requested name could run into."""
    taken = existing.select(F.col(existing.columns[0]).alias("_taken")).distinct()
    plain = taken.select(F.col("_taken").alias("_name"), F.lit(0).cast("bigint").alias("_serial"))
    numbered = taken.select(
        F.regexp_extract("_taken", _SERIAL, 1).alias("_name"),
        F.regexp_extract("_taken", _SERIAL, 2).try_cast("bigint").alias("_serial"),
    ).filter("_serial IS NOT NULL")
    return plain.unionByName(numbered).join(wanted, "_name", "left_semi")
