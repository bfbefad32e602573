"""Counters, status and metrics from program logs."""

from __future__ import annotations

import re
import uuid

from pyspark import AccumulatorParam, TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

PREFIX = "reporter:"  # fixed value: default start of a line meant for the host

_BLANK = "".join(map(chr, range(33)))
_ENDS = r"^[\x00-\x20]+|[\x00-\x20]+$"


def _after(line: Column, start: str) -> Column:
    return F.regexp_replace(F.substr(line, F.lit(len(start) + 1)), _ENDS, "")


def parse_counters(log: DataFrame, line: str = "line", prefix: str = PREFIX) -> DataFrame:
    """``(group, counter, total)`` over lines ``<prefix>counter:<group>,<name>,<amount>``.

    Lines with another number of fields or without a whole number add nothing. Totals are rows,
    so a task that ran twice counts once.
    """
    start = prefix + "counter:"
    fields = F.split(F.regexp_replace(_after(F.col(line), start), ",+$", ""), ",", -1)
    rows = log.filter(F.col(line).startswith(start)).select(fields.alias("f")).filter(F.size("f") == 3)
    rows = rows.select(
        F.get("f", F.lit(0)).alias("group"),
        F.get("f", F.lit(1)).alias("counter"),
        F.when(F.get("f", F.lit(2)).rlike(r"^[+-]?[0-9]+\z"), F.get("f", F.lit(2)).try_cast("bigint")).alias("n"),
    )
    return rows.filter("n IS NOT NULL").groupBy("group", "counter").agg(F.sum("n").alias("total"))


def counter_of(line: str, prefix: str = PREFIX) -> tuple[str, str, int] | None:
    """(group, counter, amount) of one line, by the rule of ``parse_counters``; None if it is no counter."""
    start = prefix + "counter:"
    if not line.startswith(start):
        return None
    fields = line[len(start):].strip(_BLANK).rstrip(",").split(",")
    if len(fields) != 3 or not re.fullmatch("[+-]?[0-9]+", fields[2]):
        return None
    amount = int(fields[2])
    return (fields[0], fields[1], amount) if -(1 << 63) <= amount < 1 << 63 else None


class _Latest(AccumulatorParam):
    """{(step): (stage, {partition: {(group, counter): total}})}: of a step the latest stage counts, and
    of each of its partitions the last report, so tasks that run again or twice count once."""

    def zero(self, value):
        return {}

    def addInPlace(self, value1, value2):
        for step, (stage, parts) in value2.items():
            if step not in value1 or value1[step][0] < stage:
                value1[step] = (stage, dict(parts))
            elif value1[step][0] == stage:
                value1[step][1].update(parts)
        return value1


class Counters:
    """Counters that programs report while a table is computed, brought to the driver with the tasks' ends.

    Nothing is written for them: a task sends its own totals, one number per counter. They are complete
    once the table has been computed as a whole.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.sums = spark.sparkContext.accumulator({}, _Latest())

    def step(self):
        """A function for the tasks of one step: it takes a task's error lines and, at its end, None."""
        sums, name = self.sums, uuid.uuid4().hex

        def report():
            own: dict[tuple[str, str], int] = {}

            def add(lines: list[str] | None) -> None:
                for line in lines or ():
                    found = counter_of(line)
                    if found:
                        own[found[:2]] = own.get(found[:2], 0) + found[2]
                if lines is None:
                    context = TaskContext.get()
                    sums.add({name: (context.stageId(), {context.partitionId(): own})})

            return add

        return report

    def totals(self) -> DataFrame:
        """``(group, counter, total)`` of what has been reported so far."""
        total: dict[tuple[str, str], int] = {}
        for _, parts in self.sums.value.values():
            for own in parts.values():
                for name, n in own.items():
                    total[name] = total.get(name, 0) + n
        rows = [(group, counter, n) for (group, counter), n in sorted(total.items())]
        return self.spark.createDataFrame(rows, "group string, counter string, total bigint")


def latest_status(
    log: DataFrame, task: str = "task_id", seq: str = "seq", line: str = "line", prefix: str = PREFIX
) -> DataFrame:
    """``(task, status)``: the text of each task's last ``<prefix>status:`` line."""
    start = prefix + "status:"
    rows = log.filter(F.col(line).startswith(start))
    return rows.groupBy(task).agg(F.max_by(_after(F.col(line), start), F.col(seq)).alias("status"))


def other_lines(log: DataFrame, line: str = "line", prefix: str = PREFIX) -> DataFrame:
    """The log without the lines meant for the host."""
    return log.filter(~F.col(line).startswith(prefix))


def rate_text(n: Column | str, d: Column | str) -> Column:
    """``q=n/d`` with the whole quotient ``q``, or ``NA`` where ``d`` is zero."""
    n, d = (F.col(c) if isinstance(c, str) else c for c in (n, d))
    n, d = n.cast("bigint"), d.cast("bigint")
    # Spark's div on a zero divisor is an error, so it must not see one
    q = F.call_function("div", n, F.when(d != 0, d))
    return F.when(d == 0, "NA").otherwise(
        F.concat(q.cast("string"), F.lit("="), n.cast("string"), F.lit("/"), d.cast("string"))
    )


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` counting its rows as they pass; read the count from the observation afterwards."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("records")), seen


def job_metrics(counters: DataFrame, seconds: Column | int, by: list[str] | None = None) -> DataFrame:
    """Records read, written and skipped with rates per second, from ``parse_counters`` rows."""
    def total(name):
        return F.coalesce(F.sum(F.when(F.col("counter") == name, F.col("total"))), F.lit(0))

    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    sums = counters.groupBy(*(by or [])).agg(
        total("read").alias("records_read"),
        total("written").alias("records_written"),
        total("skipped").alias("records_skipped"),
        F.max(seconds).cast("bigint").alias("seconds"),
    )
    return sums.withColumns(
        {"read_rate": rate_text("records_read", "seconds"), "write_rate": rate_text("records_written", "seconds")}
    )
