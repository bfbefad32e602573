"""State of the streamed admission: users share keys, and rows share stored values."""

import random
from collections import deque
from datetime import datetime, timedelta
from pathlib import Path

import __spark_entry__ as entry
import pandas as pd
from pyspark.sql import types as T

from kvflow.operators.admission import walk
from kvflow.streaming import admission as streaming

DAY = 86_400_000_000


class Values(dict):
    """Stands in for a value and a map of the state store."""

    puts = 0

    def get(self, *key):
        return dict.get(self, "facts") if not key else dict.get(self, *key)

    def update(self, value):
        self["facts"] = value

    def updateValue(self, key, value):
        self.puts += 1
        self[key] = value

    getValue, removeKey = dict.__getitem__, dict.__delitem__


class Timers:
    def __init__(self):
        self.now, self.times = 0, set()
        self.registerTimer, self.deleteTimer = self.times.add, self.times.discard

    def getCurrentWatermarkInMs(self):
        return self.now


def grouped(width=56_250_000):
    row = T.StructType([T.StructField("id", T.LongType()), T.StructField(streaming._TIME, T.LongType())])
    group = streaming._Admission(row, ["id"], 2, DAY, width, streaming._USER)
    group.handle, group.facts, group.waiting = Timers(), Values(), Values()
    return group


def fire(group, watermark):
    clock, out = group.handle, []
    clock.now = watermark
    while due := [t for t in clock.times if t <= watermark]:
        clock.times.discard(min(due))
        out += list(group.handleExpiredTimer((0,), clock, None))
    return out


def test_many_users_and_long_stretches_are_stored_in_few_values():
    random.seed(4)
    rows = [(i, random.randrange(30 * DAY // 4) * 4, random.choice([None, *"abcdefgh"]) or None) for i in range(20_000)]
    frame = pd.DataFrame(rows, columns=["id", streaming._TIME, streaming._USER])
    group = grouped()
    frames = [frame.iloc[i : i + 2000] for i in range(0, 20_000, 2000)]
    assert not list(group.handleInputRows((0,), iter(frames), group.handle))
    assert group.waiting.puts < 120  # not one for each row, though rows are minutes apart
    got = {}
    for day in (3, 3.5, 17, 40):
        for out in fire(group, int(day * DAY / 1000)):
            got |= dict(zip(out["id"].tolist(), out["accepted"].tolist()))
    want = {}
    for user in {u for _, _, u in rows}:
        mine = sorted((t, i) for i, t, u in rows if u == user)
        want |= dict(zip([i for _, i in mine], walk([t for t, _ in mine], deque(maxlen=2), DAY)))
    assert got == want and not group.waiting
    assert fire(group, 10**12) == [] and not group.facts


def test_slices_with_the_same_times_are_decided_in_order(monkeypatch):
    monkeypatch.setattr(streaming, "SLICE_ROWS", 8)
    monkeypatch.setattr(streaming, "ORDER_ROWS", 16)
    rows = [(i, (i % 5) * 1000, "ab"[i % 2]) for i in random.Random(3).sample(range(400), 400)]
    group, got = grouped(), {}
    for k in range(0, 400, 40):
        part = pd.DataFrame(rows[k : k + 40], columns=["id", streaming._TIME, streaming._USER])
        list(group.handleInputRows((0,), iter([part]), group.handle))
    for out in fire(group, 10**9):
        got |= dict(zip(out["id"].tolist(), out["accepted"].tolist()))
    assert len(got) == 400 and {i for i, yes in got.items() if yes} == {0, 10, 5, 15}


def test_a_table_of_many_files_arrives_as_few(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, i % 7, start + timedelta(hours=i)) for i in range(600)] + [(None, 3, start), (601, None, start)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    df.repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    out = entry.event_files(spark, str(tmp_path), True)
    files = sorted(str(p) for p in Path(out.removeprefix("file:")).glob("*/part-*"))
    assert len(files) == 7  # six stretches and the closing row
    arrived = spark.read.parquet(f"{out}/*").filter("event_id IS NULL OR event_id >= 0")
    assert sorted(map(str, arrived.collect())) == sorted(map(str, df.collect()))
    firsts = [spark.read.parquet(f).agg({"ts": "min"}).first()[0] for f in files]
    assert firsts == sorted(firsts)
