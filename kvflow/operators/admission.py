"""Rolling admission: at most so many accepted rows per user in any recent window.

Whether a row is accepted depends on which earlier rows were, so a user's rows have to be walked
in order. The walk is cut wherever the past no longer matters, so that a user with very many rows
is shared by many tasks.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvflow.operators.jobs import QUOTA_ATTEMPTS, QUOTA_MINUTES
from kvflow.operators.order import changes, ordered_table, stored
from kvflow.session import scratch_path


#: Open rows of one block: their times travel together, as one row of a chain.
BLOCK_ROWS = 1 << 15


def window_micros(minutes: float) -> int:
    return int(minutes * 60_000_000)


def walk(times: list[int], accepted: deque, window: int, begin: int = 0) -> list[bool]:
    """Decide rows in time order, given the latest accepted times; updates ``accepted``.

    ``accepted`` is a deque with ``maxlen`` set to the number of attempts. A row is accepted
    while fewer than that many accepted times lie in the closed window before it. Rejected rows
    are stepped over together, so the work grows with the accepted ones.
    """
    attempts, end = accepted.maxlen, len(times)
    out = [False] * (end - begin)
    i = begin
    while i < end:
        if len(accepted) == attempts and accepted[0] + window >= times[i]:
            i = bisect_right(times, accepted[0] + window, i)
            continue
        accepted.append(times[i])
        out[i - begin] = True
        i += 1
    return out


class _PartitionWalk:
    """Walk one partition's rows; rows that may depend on the partition before stay open.

    The first user of a partition may go on from the one before. Its rows stay open until the
    past is settled: another user begins, a pause longer than the window, or a full window of
    rows so few that all of them were accepted whatever came before.
    """

    def __init__(self, attempts: int, window: int):
        self.attempts, self.window = attempts, window
        self.accepted: deque = deque(maxlen=attempts)
        self.open = True
        self.recent: deque = deque(maxlen=attempts)  # latest times of open rows
        self.first = self.last = self.unsure = None

    def feed(self, times: list[int], same_user: bool) -> list[bool | None]:
        """Decide the next rows, all of one user: true, false, or None while open."""
        if not same_user:
            self.accepted.clear()
            self.open = False
        i = 0
        while self.open and i < len(times) and not self._settles(times[i]):
            i += 1
        return [None] * i + walk(times, self.accepted, self.window, i)

    def _settles(self, t: int) -> bool:
        """Take an open row, or find that nothing before the partition matters from it on."""
        horizon = t - self.window
        if self.last is None:
            self.first = self.unsure = t
        elif self.last < horizon or self.unsure < horizon:
            # a pause, or every row in the window was accepted for certain
            self.accepted.extend(r for r in self.recent if r >= horizon)
            self.open = False
            return True
        full = len(self.recent) == self.attempts and self.recent[0] >= horizon
        if self.first >= horizon or full:
            self.unsure = t
        self.recent.append(t)
        self.last = t
        return False


def _first_pass(user: str, ts: str, attempts: int, window: int):
    def task(batches):
        walker = _PartitionWalk(attempts, window)
        held = latest = None

        def finish(batch, times, decided, last):
            n = batch.num_rows
            edge = np.zeros(n, dtype=bool)
            edge[-1] = last
            state = [None] * n
            if last:
                state[-1] = None if walker.open else list(walker.accepted)
            return pa.RecordBatch.from_arrays(
                [*batch.columns, times, pa.array(decided, pa.bool_()), pa.array(edge),
                 pa.array(state, pa.list_(pa.int64()))],
                names=[*batch.schema.names, "_time", "accepted", "_last", "_state"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield finish(*held, False)
            # microseconds, whether the column has a time zone or not
            times = batch.column(ts).cast(pa.int64())
            plain = times.to_pylist()
            users = batch.column(user)
            same = held is None or users[0].as_py() == latest
            decided: list[bool | None] = []
            starts = np.flatnonzero(changes(users, users[0].as_py()))
            for lo, hi in zip([0, *starts], [*starts, batch.num_rows]):
                decided += walker.feed(plain[lo:hi], same)
                same = False
            latest = users[batch.num_rows - 1].as_py()
            held = (batch, times, decided)
        if held is not None:
            yield finish(*held, True)

    return task


def _blocks(batches):
    """Times of open rows (_part, _row, _time) as blocks of rows that follow each other in a range."""
    for batch in batches:
        if not batch.num_rows:
            continue
        parts, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        # a range's open rows are its first ones, so a gap means that another range begins
        new = np.flatnonzero((np.diff(parts) != 0) | (np.diff(rows) != 1)) + 1
        firsts = np.concatenate([np.arange(a, b, BLOCK_ROWS) for a, b in zip([0, *new], [*new, len(parts)])])
        times = pa.ListArray.from_arrays(
            pa.array([*firsts, len(parts)], pa.int32()), batch.column(2).cast(pa.int64())
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(parts[firsts]), pa.array(rows[firsts]), times], names=["_part", "_first", "_times"]
        )


def _jump(attempts: int, window: int, before: dict[int, list[int]]):
    """Walk chains of blocks from the state ``before`` each chain; returns the rows that are accepted.

    Blocks come by chain, in order. Up to the end of the accepted window all is rejected, so whole blocks
    are passed by their last time, and the next row to look at is sought in the block it is in: the
    work grows with blocks and accepted rows, not with rows.
    """

    def task(batches):
        chain = accepted = None
        for batch in batches:
            chains, parts = batch.column("_chain").to_pylist(), batch.column("_part").to_numpy()
            firsts, times = batch.column("_first").to_numpy(), batch.column("_times")
            found_part, found_row = [], []
            for k, name in enumerate(chains):
                if name != chain:
                    chain, accepted = name, deque(before[name], maxlen=attempts)
                block = times[k].values.to_numpy()
                for i in _accepted_places(block, accepted, window):
                    found_part.append(parts[k])
                    found_row.append(firsts[k] + i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found_part, pa.int32()), pa.array(found_row, pa.int64())], names=["_part", "_row"]
            )

    return task


def _accepted_places(times: np.ndarray, accepted: deque, window: int) -> list[int]:
    """``walk`` over an array of times: the places of the accepted rows."""
    attempts, i, end, out = accepted.maxlen, 0, len(times), []
    while i < end:
        if len(accepted) == attempts and accepted[0] + window >= times[i]:
            if accepted[0] + window >= times[-1]:
                break
            i = int(np.searchsorted(times, accepted[0] + window, "right"))
        accepted.append(int(times[i]))
        out.append(i)
        i += 1
    return out


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def admit(
    df: DataFrame,
    user: str,
    ts: str,
    attempts: int = QUOTA_ATTEMPTS,
    minutes: float = QUOTA_MINUTES,
    order_by: list[str] | None = None,
    enabled: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``accepted``: fewer than ``attempts`` accepted rows of the user in the last ``minutes``.

    The window is closed at its start, and rejected rows do not count. ``order_by`` settles equal
    times. Rows without a time are not decided: ``accepted`` is NULL and they do not count.

    Rows are written once in (user, time) ranges; each range is walked by its own task. Rows that a
    range could not settle alone are decided once more from their times only, which travel in blocks: all
    open ranges of a user that follow each other are a chain, chains run side by side, and a chain
    jumps from accepted row to accepted row. Two Spark jobs run here, whatever the ranges; no range is sorted again.
    """
    if attempts < 1:
        raise ValueError("the quota allows at least one row")
    if not enabled:
        return df.withColumn("accepted", F.lit(True))
    spark, window = df.sparkSession, window_micros(minutes)
    columns = df.columns
    timed = df.filter(F.col(ts).isNotNull())
    untimed = df.filter(F.col(ts).isNull()).withColumn("accepted", F.lit(None).cast("boolean"))
    rows = ordered_table(timed, [user, ts, *(order_by or [])], partitions)
    path = scratch_path(spark, "admission")
    rows.mapInArrow(
        _first_pass(user, ts, attempts, window),
        f"{_ddl(rows)}, _time bigint, accepted boolean, _last boolean, _state array<bigint>",
    ).write.parquet(path)
    table = spark.read.parquet(path)

    settled = table.filter("accepted IS NOT NULL").select(*columns, "accepted").unionByName(untimed)
    chains, before = _chains(table, user, window)
    if not chains:
        return settled
    opened = table.filter("accepted IS NULL")
    # a pair of numbers per range
    placed = opened.select("_part", "_row", "_time").mapInArrow(_blocks, "_part int, _first bigint, _times array<bigint>")
    placed = placed.join(F.broadcast(spark.createDataFrame(chains, "_part int, _chain int")), "_part")
    ordered = placed.repartition("_chain").sortWithinPartitions("_chain", "_part", "_first")
    chosen = ordered.mapInArrow(_jump(attempts, window, before), "_part int, _row bigint")
    # written, so that Spark sees how few they are
    accepted = stored(chosen.withColumn("_yes", F.lit(True)), "admitted")
    again = opened.drop("accepted").join(accepted, ["_part", "_row"], "left")
    return settled.unionByName(again.select(*columns, F.coalesce("_yes", F.lit(False)).alias("accepted")))


def _chains(table: DataFrame, user: str, window: int) -> tuple[list[tuple[int, int]], dict[int, list[int]]]:
    """(range, chain) of the ranges that begin with open rows, and the state before each chain.

    A chain is named by its first range, before which the past is known; each next one waits for the
    one before it, which is open to its end. Only each range's first and last row come to the driver.
    """
    edges = table.filter("_row = 0 OR _last").select(
        "_part", "_row", F.col(user).alias("_user"), "_time", "_last", "_state"
    )
    first: dict[int, tuple] = {}
    last: dict[int, tuple] = {}
    for row in edges.collect():
        if row["_row"] == 0:
            first[row["_part"]] = (row["_user"], row["_time"])
        if row["_last"]:
            last[row["_part"]] = (row["_user"], row["_time"], row["_state"])
    chains: list[tuple[int, int]] = []
    before: dict[int, list[int]] = {}
    chain = previous = None
    for part in sorted(first):
        begins = previous is None or last[previous][0] != first[part][0]
        if begins or last[previous][1] < first[part][1] - window:
            chain, before[part] = part, []
        elif last[previous][2] is not None:
            chain, before[part] = part, last[previous][2]
        chains.append((part, chain))
        previous = part
    return chains, before
