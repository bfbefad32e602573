"""Rolling admission on a stream, with the answer of the batch form however the rows arrive.

Rows are decided once the watermark, the newest time seen less ``lateness``, is past them; until then
they wait. So the number and the order of micro-batches do not change a decision. Rows that come after
their time was decided are returned too, with ``late`` true and ``accepted`` NULL.

``admit_stream`` keeps its state per group of users in the state store and decides with low delay.
``admit_batches`` decides each micro-batch with the batch operator, which shares a user with very many
rows among tasks, and keeps its state as a table; ``finish_batches`` decides what still waits when the
stream has come to its end. To let ``admit_stream`` decide all, end the stream with a row of a user of
its own that is later than all others by more than ``lateness``.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from kvflow.operators.admission import admit, walk, window_micros
from kvflow.operators.jobs import QUOTA_ATTEMPTS, QUOTA_MINUTES
from kvflow.sources.paths import delete_path, path_exists

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TIME = "kv_micros"


#: Users share state keys by a hash, so that Spark hands over and stores many short histories at a time. A
#: running stream's users stay where they are, so this number does not follow the session.
GROUPS = 1024
#: Waiting rows are stored in slices of time. A slice ends after so many rows, or with a bucket, of which
#: there are so many for each span of lateness, once it has the least number of rows.
SLICE_ROWS, SLICE_LEAST = 4096, 256
BUCKETS = 64
#: Rows and frames, as Spark hands them over, that are brought into order at a time.
ORDER_ROWS = 1 << 16
ORDER_FRAMES = 8
_USER, _GROUP = "kv_user", "kv_group"


def _packed(frame: pd.DataFrame) -> bytes:
    """A frame as one value of the state store."""
    table, sink = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(value: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(value).read_pandas()


class _Facts:
    """What a key's state says besides the waiting rows: read and written as one value."""

    SCHEMA = T.StructType([
        T.StructField("accepted", T.BinaryType()),  # latest accepted times by user, a frame
        T.StructField("timer", T.LongType()),  # milliseconds of the timer that is set
        T.StructField("slices", T.ArrayType(T.LongType())),  # of waiting rows: number, least time
        T.StructField("firsts", T.ArrayType(T.LongType())),
    ])

    def __init__(self, value: tuple | None):
        self.accepted, self.timer, slices, firsts = value or (None, None, [], [])
        self.waiting = dict(zip(slices, firsts))

    def value(self) -> tuple | None:
        if not (self.accepted or self.waiting or self.timer is not None):
            return None
        return self.accepted, self.timer, list(self.waiting), list(self.waiting.values())

    def accepted_times(self, attempts: int) -> dict[str | None, deque]:
        out: dict[str | None, deque] = {}
        if self.accepted:
            frame = _unpacked(self.accepted)
            for user, t in zip(frame[_USER].tolist(), frame[_TIME].tolist()):
                out.setdefault(user, deque(maxlen=attempts)).append(t)
        return out

    def keep_accepted(self, accepted: dict[str | None, deque], horizon: int) -> int | None:
        """Keep the times from ``horizon`` on; returns the newest."""
        alive = [(user, t) for user, times in accepted.items() for t in times if t >= horizon]
        users, times = [user for user, _ in alive], [t for _, t in alive]
        frame = pd.DataFrame({_USER: pd.Series(users, dtype="object"), _TIME: pd.Series(times, dtype="int64")})
        self.accepted = _packed(frame) if alive else None
        return max(times) if alive else None


class _Admission(StatefulProcessor):
    """State of a key, one user or a group of them: waiting rows in slices of time, and what ``_Facts`` says.

    The rows of a micro-batch are added as slices of their own, without reading what is there; a timer
    reads the slices that the watermark has reached, and stores again what of these must still wait.
    """

    def __init__(self, row: T.StructType, order_by: list[str], attempts: int, window: int, width: int, user: str | None = None):
        self.row, self.order_by, self.user = row, order_by, user
        self.attempts, self.window, self.width = attempts, window, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", _Facts.SCHEMA)
        name = T.StructType([T.StructField("slice", T.LongType())])
        self.waiting = handle.getMapState("waiting", name, T.StructType([T.StructField("rows", T.BinaryType())]))

    def _save(self, facts: _Facts, wake: int | None) -> None:
        """Write the facts, with one timer per key: it moves only if it must fire earlier or has fired."""
        at = None if wake is None else wake // 1000 + 1
        if facts.timer is not None and (at is None or at < facts.timer):
            self.handle.deleteTimer(facts.timer)
            facts.timer = None
        if at is not None and facts.timer is None:
            self.handle.registerTimer(at)
            facts.timer = at
        value = facts.value()
        if value is None:
            self.facts.clear()
        else:
            self.facts.update(value)

    def _add(self, facts: _Facts, frames: list[pd.DataFrame]) -> None:
        frame = (pd.concat(frames) if len(frames) > 1 else frames[0]).sort_values(_TIME, kind="stable")
        number = max(facts.waiting, default=-1) + 1
        edges = np.flatnonzero(np.diff(frame[_TIME].to_numpy(np.int64) // self.width)) + 1
        begin = 0
        while begin < len(frame):
            ends = edges[np.searchsorted(edges, begin + SLICE_LEAST) :][:1].tolist()
            part = frame.iloc[begin : min([begin + SLICE_ROWS, *ends])]
            self.waiting.updateValue((number,), (_packed(part),))
            facts.waiting[number] = int(part[_TIME].iloc[0])
            number, begin = number + 1, begin + len(part)

    def _take(self, facts: _Facts, number: int) -> pd.DataFrame:
        frame = _unpacked(self.waiting.getValue((number,))[0])
        self.waiting.removeKey((number,))
        del facts.waiting[number]
        return frame

    def _decide(self, due: pd.DataFrame, accepted: dict[str | None, deque]) -> pd.DataFrame:
        due = due.sort_values([_TIME, *self.order_by], kind="stable")
        if self.user is None:
            codes, users = np.zeros(len(due), dtype=np.int64), [None]
        else:
            codes, users = pd.factorize(due[self.user], use_na_sentinel=False)
        place = np.argsort(codes, kind="stable")
        times, outcome = due[_TIME].to_numpy(np.int64)[place], np.zeros(len(due), dtype=bool)
        begin = 0
        for user, n in zip(users, np.bincount(codes, minlength=len(users)).tolist()):
            past = accepted.setdefault(user if type(user) is str else None, deque(maxlen=self.attempts))
            outcome[place[begin : begin + n]] = walk(times[begin : begin + n].tolist(), past, self.window)
            begin += n
        return due.assign(accepted=outcome, late=False)

    def handleInputRows(self, key, rows, timerValues):
        # Spark's first watermark is 0; nothing was decided before it
        decided_to = timerValues.getCurrentWatermarkInMs() * 1000
        facts, held = None, []
        for frame in rows:
            frame = frame.drop(columns=_GROUP, errors="ignore")
            untimed = frame[_TIME].isna()
            late = frame[_TIME] < decided_to
            for some, tardy in ((untimed, False), (late, True)):
                if some.any():
                    out = frame[some].astype({_TIME: "Int64"})
                    yield out.assign(accepted=pd.Series(None, index=out.index, dtype="boolean"), late=tardy)
            keep = frame[~late & ~untimed].astype({_TIME: "int64"})
            if len(keep):
                facts = facts or _Facts(self.facts.get())
                held.append(keep)
                if len(held) == ORDER_FRAMES:
                    self._add(facts, held)
                    held = []
        if held:
            self._add(facts, held)
        if facts is not None:
            self._save(facts, min(facts.waiting.values()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        facts = _Facts(self.facts.get())
        facts.timer = None
        decided_to = timerValues.getCurrentWatermarkInMs() * 1000
        accepted = facts.accepted_times(self.attempts)
        slices = sorted((first, number) for number, first in facts.waiting.items() if first < decided_to)
        frames, old, new = [], 0, 0  # rows in hand, and how many of them are from before
        for following, (_, number) in enumerate(slices, 1):
            frames.append(self._take(facts, number))
            new += len(frames[-1])
            if following < len(slices) and new < max(old, ORDER_ROWS):
                continue
            # no slice still to be read has rows before its first
            until = slices[following][0] if following < len(slices) else decided_to
            frame = pd.concat(frames) if len(frames) > 1 else frames[0]
            due = frame[_TIME] < until
            if due.any():
                yield self._decide(frame[due], accepted)
            frames, old, new = [frame[~due]], len(frame) - int(due.sum()), 0
        if old:
            self._add(facts, frames)
        newest = facts.keep_accepted(accepted, decided_to - self.window)
        # the next row to decide, or the time from which nothing accepted counts any more
        waits = min(facts.waiting.values(), default=None)
        self._save(facts, waits if waits is not None else newest + self.window if newest is not None else None)

    def close(self) -> None:
        pass


def admit_stream(
    sdf: DataFrame,
    user: str,
    ts: str,
    attempts: int = QUOTA_ATTEMPTS,
    minutes: float = QUOTA_MINUTES,
    order_by: list[str] | None = None,
    lateness: str = "0 seconds",
) -> DataFrame:
    """Add ``accepted`` and ``late`` to a stream, by the rule of the batch form.

    Waiting rows, those of the last ``lateness``, are in the state store by slices of time and are ordered
    slice by slice when their time has come. Users named by text, whole numbers or booleans are dealt by a
    hash over ``GROUPS`` keys of state, so that the work grows with rows rather than with users; users of
    other types have a key each. Rows without a time are returned at once, with ``accepted`` NULL and
    ``late`` false. The session needs the RocksDB state store (``STATE_STORE``).
    """
    kind, user_kind = sdf.schema[ts].dataType, sdf.schema[user].dataType
    grouped = user_kind == T.StringType() or isinstance(user_kind, (T.IntegralType, T.BooleanType))
    others = [f for f in sdf.schema if f.name != ts and not (grouped and f.name == user)]
    row = T.StructType([*others, T.StructField(_TIME, T.LongType())])
    if grouped:  # pandas would make numbers with a NULL among them floats
        row = row.add(_USER, T.StringType())
    out = T.StructType([*row, T.StructField("accepted", T.BooleanType()), T.StructField("late", T.BooleanType())])
    order = [c for c in order_by or [] if not (grouped and c == user)]
    span = F.unix_micros(F.expr(f"timestamp_micros(0) + INTERVAL {lateness}"))
    width = max(sdf.sparkSession.range(1).select(span).first()[0] // BUCKETS, 1_000_000)
    processor = _Admission(row, order, attempts, window_micros(minutes), width, _USER if grouped else None)
    # as a number the time carries no watermark, so that Spark hands late rows over
    named = [F.col(user).cast("string").alias(_USER), F.pmod(F.hash(user), F.lit(GROUPS)).alias(_GROUP)]
    rows = sdf.withWatermark(ts, lateness).select(
        *[f.name for f in others], _micros(ts, kind).alias(_TIME), *named * grouped
    )
    decided = rows.groupBy(_GROUP if grouped else user).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="append", timeMode="eventTime",
    )
    back = F.timestamp_micros(_TIME)
    if isinstance(kind, T.TimestampNTZType):
        back = F.timestamp_micros(_TIME).cast("timestamp_ntz")
    made = {ts: back.alias(ts)} | ({user: F.col(_USER).cast(user_kind).alias(user)} if grouped else {})
    return decided.select(*[made.get(c, F.col(c)) for c in sdf.columns], "accepted", "late")


def _micros(ts: str, kind: T.DataType):
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(kind, T.TimestampNTZType) else F.col(ts))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Batches:
    """Decides one micro-batch after the other. State below ``path/state/<batch>``: ``rows`` has
    waiting rows and live accepted rows, ``clock`` the newest time and the time decided to."""

    def __init__(self, path, user, ts, attempts, minutes, order_by, lateness, partitions):
        self.path, self.user, self.ts, self.attempts = path, user, ts, attempts
        self.minutes, self.order, self.partitions = minutes, list(order_by or []), partitions
        self.lateness = F.expr(f"INTERVAL {lateness}")
        self.window = F.make_dt_interval(secs=F.lit(window_micros(minutes) / 1_000_000).cast("decimal(18,6)"))

    def step(self, batch: DataFrame, batch_id: int, everything: bool = False) -> None:
        spark, ts = batch.sparkSession, self.ts
        before = f"{self.path}/state/{batch_id - 1}"
        newest = batch.agg(F.max(ts).alias("newest"))
        rows = batch.withColumn("_live", F.lit(False))
        if batch_id > 0:
            clock = spark.read.parquet(f"{before}/clock")  # a lost state is an error
            newest = newest.unionAll(clock.select("newest")).agg(F.max("newest").alias("newest"))
            decided_to = clock.first()["decided_to"]
        else:
            decided_to = None
        kind = batch.schema[ts].dataType
        at = newest.select("newest", (F.col("newest") - self.lateness).cast(kind).alias("decided_to")).first()
        until = at["decided_to"]
        if decided_to is not None and (until is None or until < decided_to):
            until = decided_to
        limit, start = F.lit(until).cast(kind), F.lit(decided_to).cast(kind)
        late = rows.filter(F.col(ts) < start) if decided_to is not None else rows.limit(0)
        if decided_to is not None:
            rows = rows.filter((F.col(ts) >= start) | F.col(ts).isNull())
        if batch_id > 0:
            rows = rows.unionByName(spark.read.parquet(f"{before}/rows"))
        # rows without a time do not wait; without any time nothing else is due; at the end everything is
        timed = F.coalesce(F.col(ts) < limit, F.lit(False))
        due = F.lit(True) if everything else timed | F.col("_live") | F.col(ts).isNull()
        # accepted rows of the past come first and are accepted again, as they fit the quota
        walked = rows.filter(due).withColumn("_new", (~F.col("_live")).cast("int"))
        decided = admit(walked, self.user, ts, self.attempts, self.minutes, ["_new", *self.order], partitions=self.partitions)
        decided = decided.withColumn("late", F.lit(False))
        tardy = late.withColumns({"_new": F.lit(1), "accepted": F.lit(None).cast("boolean"), "late": F.lit(True)})
        out = _written(
            decided.filter("_new = 1").unionByName(tardy).drop("_new", "_live"), f"{self.path}/rows/batch={batch_id}"
        )

        past = rows.filter("_live")
        live = out.filter("accepted").drop("accepted", "late").withColumn("_live", F.lit(True)).unionByName(past)
        if until is not None:
            live = live.filter(F.col(ts) >= limit - self.window)
        _written(rows.filter(~due).unionByName(live), f"{self.path}/state/{batch_id}/rows")
        clock = spark.range(1).select(F.lit(at["newest"]).cast(kind).alias("newest"), limit.alias("decided_to"))
        _written(clock, f"{self.path}/state/{batch_id}/clock")
        # a restart repeats this micro-batch at most, from the state before it
        delete_path(spark, f"{self.path}/state/{batch_id - 2}")


def admit_batches(
    sdf: DataFrame,
    path: str,
    user: str,
    ts: str,
    attempts: int = QUOTA_ATTEMPTS,
    minutes: float = QUOTA_MINUTES,
    order_by: list[str] | None = None,
    lateness: str = "0 seconds",
    partitions: int | None = None,
) -> DataStreamWriter:
    """A stream writer that decides each micro-batch and appends it below ``path/rows``.

    Rows get ``accepted`` and ``late``; those without a time are decided at once, as NULL and false. The state is the waiting rows of the last ``lateness`` and the
    accepted rows of the last window, at most ``attempts`` per user, as a table per micro-batch of
    which two are kept. A micro-batch that runs again replaces its own files, so every row counts once.
    """
    batches = _Batches(path, user, ts, attempts, minutes, order_by, lateness, partitions)
    return sdf.writeStream.foreachBatch(batches.step)


def finish_batches(
    spark: SparkSession,
    path: str,
    user: str,
    ts: str,
    attempts: int = QUOTA_ATTEMPTS,
    minutes: float = QUOTA_MINUTES,
    order_by: list[str] | None = None,
    partitions: int | None = None,
) -> None:
    """Decide the rows that still wait, once no more will come, as one more micro-batch."""
    last = 0
    while path_exists(spark, f"{path}/rows/batch={last + 1}"):
        last += 1
    waiting = spark.read.parquet(f"{path}/state/{last}/rows")
    batches = _Batches(path, user, ts, attempts, minutes, order_by, "0 seconds", partitions)
    batches.step(waiting.drop("_live").limit(0), last + 1, everything=True)
