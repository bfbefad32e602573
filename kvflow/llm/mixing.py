"""Mixing sources to target weights by entropy balancing.

The mix takes each document at a rate between 0 and ``most_copies``. Among all rates that meet the
token target of every source, entropy balancing picks those nearest to 1 in relative entropy:
``rate = min(most_copies, exp(x * size / scale))`` with one multiplier ``x`` per source, the solution
of a convex dual. Newton steps, held inside a shrinking bracket, find all multipliers at once from an
exact histogram (source, size, documents), which is the only thing they read; one small job per step.

Rates become copies block by block: a block is a hashed part of one source of some thousand documents;
inside it documents go from large to small, and each is rounded so that the words taken so far stay
nearest to their running target. So a source misses its target by about one short document per block,
no hot source meets in one task, and a rerun takes the same copies.

Defined results: a null text has size 0, such documents have no words to take and are copied once; a
null source is a source of its own, last in order; a source without words has target 0; an empty
table gives no rows; repeated rows are documents of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvflow.llm.common import stored, written
from kvflow.sources.paths import delete_path

BLOCK_ROWS = 4096


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(
    sizes: DataFrame, weights: list[float], share: float = 1.5, most_copies: float = 2.0
) -> DataFrame:
    """(source, rows, source_size, target): ``share`` of all sizes dealt by weight, with a ceiling.

    ``sizes`` has source, n, size rows. Weights repeat over the sources in code point order, null
    last. A target stops at ``most_copies`` times the size of its source; what it leaves goes to
    the others by weight, again and again: the rest is level at ``level * weight``, and the sources
    with the least ceiling per weight are those that stop.
    """
    by_source = sizes.groupBy("source").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("size")).alias("source_size")
    )
    # one row per source from here on
    place = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)) + 1)
    ceiling = F.lit(float(most_copies)) * F.col("source_size")
    ranked = by_source.withColumn("weight", weight).withColumn("ratio", ceiling / F.col("weight"))
    order = Window.partitionBy().orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum(ceiling).over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(from_here)
    # the level if all sources before this one stop; the first that does not reach its ceiling sets it
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(whole)
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.coalesce(first["level"], F.max("ratio").over(whole)))
        .select("source", "rows", "source_size", F.least(ceiling, F.col("level") * F.col("weight")).alias("target"))
    )


def _rate(x: Column, size: Column, scale: Column, most: float) -> Column:
    """``min(most, exp(x * size / scale))`` without overflow."""
    return F.exp(F.least(x * size / scale, F.lit(math.log(most))))


def _exact_sum(values: Column) -> Column:
    """A sum that does not depend on the order of its rows, so that a rerun finds the same rates."""
    return F.sum(values.cast("decimal(38,8)")).cast("double")


def multipliers(sizes: DataFrame, goals: DataFrame, most_copies: float = 2.0, steps: int = 40) -> DataFrame:
    """``goals`` with scale and x, the multiplier of each source, by Newton steps on all at once.

    The words taken rise with x, so a bracket holds the root; a step that would leave it halves it
    instead, and after ``steps`` rounds all steps do, so every source is solved in the end. At the ceiling every document is taken ``most_copies`` times, at target 0 none.
    """
    top = math.log(most_copies)
    biggest = sizes.groupBy("source").agg(
        F.min(F.when(F.col("size") > 0, F.col("size"))).alias("shortest"),
        _exact_sum(F.col("n") * F.col("size").cast("double") * F.col("size")).alias("squares"),
    )
    same = F.col("g.source").eqNullSafe(F.col("b.source"))
    scale = F.greatest(F.col("source_size") / F.col("rows"), F.lit(1.0))
    state = goals.alias("g").join(biggest.alias("b"), same).select(
        "g.source", "rows", "source_size", "target", scale.alias("scale"),
        # at the upper end even the shortest document is at its most, at the lower end it is at e^-40
        (F.lit(top) * scale / F.coalesce("shortest", F.lit(1))).alias("high"),
        (F.lit(-40.0) * scale / F.coalesce("shortest", F.lit(1))).alias("low"), "squares",
    )
    # a first guess from the mean size of a word's document; sources at their ceiling are done
    full = F.col("target") >= F.lit(float(most_copies)) * F.col("source_size") * (1 - 1e-12)
    guess = F.log(F.col("target") / F.col("source_size")) * F.col("scale") * F.col("source_size") / F.col("squares")
    guess = F.greatest(F.least(guess, F.col("high")), F.col("low"))
    state = state.withColumn("x", F.when(full, F.col("high")).otherwise(guess)).withColumn("done", full).drop("squares")
    state, path = written(state, "mix-step")
    spark = sizes.sparkSession
    turn = 0
    while not state.filter("NOT done").isEmpty():
        turn += 1
        h, s = sizes.alias("h"), state.alias("s")
        rate = _rate(F.col("x"), F.col("size"), F.col("scale"), most_copies)
        words = F.col("n") * F.col("size") * rate
        free = F.col("x") * F.col("size") / F.col("scale") < top
        sums = h.join(s, F.col("h.source").eqNullSafe(F.col("s.source"))).groupBy("s.source").agg(
            _exact_sum(words).alias("got"),
            _exact_sum(F.when(free, words * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"),
        )
        both = state.alias("s").join(sums.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        miss = F.col("got") - F.col("target")
        high = F.when(miss >= 0, F.col("x")).otherwise(F.col("high"))
        low = F.when(miss <= 0, F.col("x")).otherwise(F.col("low"))
        newton = F.col("x") - miss / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high) & F.lit(turn <= steps)
        done = (F.abs(miss) <= F.lit(1e-9) * F.greatest(F.col("target"), F.lit(1.0))) | (high - low <= 1e-12 * F.greatest(F.abs(high), F.lit(1.0)))
        done = F.col("done") | done
        last = path
        state, path = written(
            both.select(
                "s.source", "rows", "source_size", "target", "scale", high.alias("high"), low.alias("low"),
                F.when(done, F.col("x")).when(inside, newton).otherwise((high + low) / 2).alias("x"), done.alias("done"),
            ),
            "mix-step",
        )
        delete_path(spark, last)
    return stored(state.drop("high", "low", "done"), "mix-solved")


def round_block(block: pd.DataFrame, most: int) -> pd.DataFrame:
    """``block`` (size, rate, _tie) with copies: from large to small, what is owed goes on to the next."""
    block = block.sort_values(["size", "_tie"], ascending=[False, True], kind="stable")
    size, rate = block["size"].to_numpy(np.int64), block["rate"].to_numpy(np.float64)
    copies, owed = np.ones(len(block), np.int64), 0.0
    for i in range(len(block)):
        if size[i]:
            owed += rate[i] * size[i]
            copies[i] = min(max(math.floor(owed / size[i] + 0.5), 0), most)
            owed -= copies[i] * size[i]
    return block.assign(copies=copies)


def _tie(key: Column, text: Column) -> Column:
    return F.xxhash64(key, F.coalesce(text.cast("string"), F.lit("")))


def _mixed(docs, key_col, text_col, source_col, weights, share, most_copies) -> DataFrame:
    rows = stored(
        docs.select(
            F.col(key_col).alias("_key"), F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"), _tie(F.col(key_col), F.col(text_col)).alias("_tie"),
        ),
        "mix-rows",
    )
    sizes = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-sizes")
    goals = targets(sizes, list(weights), share, most_copies)
    solved = multipliers(sizes, goals, most_copies)
    tilted = rows.alias("r").join(solved.alias("m"), F.col("r.source").eqNullSafe(F.col("m.source"))).select(
        "_key", "r.source", "size", "_tie", "source_size", "target",
        _rate(F.col("x"), F.col("size"), F.col("scale"), float(most_copies)).alias("rate"),
        F.pmod(F.col("_tie"), F.ceil(F.col("rows") / BLOCK_ROWS)).alias("_block"),
    )
    schema = T.StructType([f for f in tilted.schema if f.name != "_block"] + [T.StructField("copies", T.LongType())])

    def task(block: pd.DataFrame) -> pd.DataFrame:
        return round_block(block, int(most_copies))[schema.names]

    return tilted.groupBy("source", "_block").applyInPandas(task, schema)


def mix(
    docs: DataFrame,
    key_col: str,
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most_copies: int = 2,
) -> DataFrame:
    """One row per document: its key and source with size, source_size, target, rate, copies."""
    found = _mixed(docs, key_col, text_col, source_col, weights, share, most_copies)
    return found.drop("_tie").withColumnRenamed("_key", key_col)


def mixed_rows(
    docs: DataFrame,
    key_col: str,
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most_copies: int = 2,
) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns are kept.

    Rows are met again by key and text; those that repeat both are numbered on either side.
    """
    found = _mixed(docs, key_col, text_col, source_col, weights, share, most_copies).select("_key", "_tie", "copies")
    one = Window.partitionBy("_tie", "_key").orderBy(F.desc("copies"))
    found = found.withColumn("_no", F.row_number().over(one))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("_row")).select(
        "_row", F.col(f"_row.{key_col}").alias("_key"), _tie(F.col(f"_row.{key_col}"), F.col(f"_row.{text_col}")).alias("_tie")
    )
    one = Window.partitionBy("_tie", "_key").orderBy(F.xxhash64("_row"))
    rows = rows.withColumn("_no", F.row_number().over(one))
    same = (
        (F.col("r._tie") == F.col("f._tie")) & F.col("r._key").eqNullSafe(F.col("f._key")) & (F.col("r._no") == F.col("f._no"))
    )
    taken = rows.alias("r").join(found.alias("f"), same).filter("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
