import os
import random
from collections import deque
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvflow.operators import admission
from kvflow.operators.admission import admit
from kvflow.streaming.admission import admit_batches, admit_stream, finish_batches

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def plain(rows, attempts, minutes):
    """Row by row over all accepted rows of the user."""
    window, accepted, out = timedelta(minutes=minutes), {}, {}
    for i, user, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        live = [t for t in accepted.get(user, []) if t >= ts - window]
        out[i] = len(live) < attempts
        accepted[user] = live + [ts] if out[i] else live
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, user string, ts timestamp").repartition(3)


def decided(df):
    return {r["id"]: r["accepted"] for r in df.collect()}


def test_window_is_closed(spark):
    rows = [(i, "a", START + timedelta(hours=h)) for i, h in enumerate([0, 1, 2, 24, 25, 26])]
    out = decided(admit(table(spark, rows), "user", "ts", 2, 1440, ["id"]))
    assert [out[i] for i in range(6)] == [True, True, False, False, True, True]


def random_rows(seed, n=600, hot=0.4, step=4, quiet=0.02):
    """One user has many of the rows; now and then nobody does anything for a while."""
    rng, now, rows = random.Random(seed), START, []
    for i in range(n):
        now += timedelta(minutes=rng.choice([0, 0, 1, step]) if rng.random() > quiet else 200)
        rows.append((i, "hot" if rng.random() < hot else f"u{rng.randrange(6)}", now))
    return rows


@pytest.mark.parametrize("partitions", [1, 6, 37])
@pytest.mark.parametrize("attempts, minutes", [(1, 7), (3, 20), (20, 10)])
def test_agrees_with_plain_walk(spark, partitions, attempts, minutes):
    rows = random_rows(attempts)
    out = decided(admit(table(spark, rows), "user", "ts", attempts, minutes, ["id"], partitions=partitions))
    assert out == plain(rows, attempts, minutes)


@pytest.mark.parametrize("block_rows", [1, 13, 1 << 15])
def test_one_user_over_quota_all_the_time(spark, monkeypatch, block_rows):
    monkeypatch.setattr(admission, "BLOCK_ROWS", block_rows)
    rows = [(i, "hot" if i % 20 else "b", START + timedelta(seconds=7 * i + i % 3)) for i in range(500)]
    out = decided(admit(table(spark, rows), "user", "ts", 3, 30, ["id"], partitions=9))
    assert out == plain(rows, 3, 30)
    assert 0 < sum(out.values()) < len(rows)


def jobs_of(spark, run):
    """The number of Spark jobs that ``run`` starts."""
    name = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(name, name)
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_jobs_do_not_grow_with_the_ranges_of_a_chain(spark):
    rows = [(i, "hot" if i % 20 else "b", START + timedelta(seconds=7 * i)) for i in range(600)]
    df = table(spark, rows)
    few, many = (jobs_of(spark, lambda n=n: admit(df, "user", "ts", 3, 30, ["id"], partitions=n)) for n in (3, 30))
    assert 0 < many <= few + 1


def test_blocks_are_passed_and_sought():
    rng = random.Random(11)
    for _ in range(200):
        attempts, window = rng.randrange(1, 4), rng.randrange(1, 40)
        times = sorted(rng.randrange(300) for _ in range(rng.randrange(1, 120)))
        start = deque(sorted(rng.randrange(-30, 1) for _ in range(rng.randrange(attempts + 1))), maxlen=attempts)
        want = admission.walk(times, deque(start, maxlen=attempts), window)
        state, got = deque(start, maxlen=attempts), []
        cuts = [0, *sorted(rng.sample(range(len(times)), min(2, len(times)))), len(times)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                got += [a + i for i in admission._accepted_places(np.array(times[a:b]), state, window)]
        assert got == [i for i, yes in enumerate(want) if yes]


def test_rows_without_a_time_are_not_decided(spark):
    rows = random_rows(8, 200)
    more = [(1000 + i, user, None) for i, user in enumerate(["hot", "u1", "new", None])]
    out = decided(admit(table(spark, rows + more), "user", "ts", 2, 20, ["id"], partitions=7))
    assert out == plain(rows, 2, 20) | {i: None for i, *_ in more}
    assert decided(admit(table(spark, more), "user", "ts", 2, 20)) == {i: None for i, *_ in more}


@pytest.mark.parametrize("seed", range(60))
def test_partition_walk_settles_only_what_it_knows(seed):
    """Cut one user's rows anywhere: the later part's settled rows match a walk over all rows."""
    rng = random.Random(seed)
    attempts, window, now, times = rng.randrange(1, 4), rng.randrange(1, 30), 0, []
    for _ in range(60):
        now += rng.choice([0, 0, 1, 2, 5, rng.choice([5, 40])])
        times.append(now)
    cut = rng.randrange(60)
    whole = admission.walk(times, deque(maxlen=attempts), window)
    walker = admission._PartitionWalk(attempts, window)
    mid = rng.randrange(cut, 61)
    tail = walker.feed(times[cut:mid], True) + walker.feed(times[mid:], True)
    opened = tail.count(None)
    assert all(t is None for t in tail[:opened]) and None not in tail[opened:]
    assert tail[opened:] == whole[cut + opened :]


def test_times_without_zone_and_disabled_quota(spark):
    rows = random_rows(5, 100)
    bare = table(spark, rows).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert decided(admit(bare, "user", "ts", 2, 20, ["id"])) == plain(rows, 2, 20)
    assert all(decided(admit(bare, "user", "ts", 1, 20, ["id"], enabled=False)).values())
    with pytest.raises(ValueError):
        admit(bare, "user", "ts", 0)


@pytest.fixture(scope="module")
def arriving(spark, tmp_path_factory):
    """Rows of three files that arrive one after the other, and a stream that takes one at a time."""
    rows, folder = random_rows(9, 300), tmp_path_factory.mktemp("arriving")
    for part in range(3):
        df = spark.createDataFrame(rows[part * 100 : part * 100 + 100], "id long, user string, ts timestamp")
        df.coalesce(1).write.parquet(f"{folder}/made/{part}")
        (file,) = (folder / "made" / str(part)).glob("part-*")
        (folder / f"{part}.parquet").write_bytes(file.read_bytes())
        os.utime(folder / f"{part}.parquet", (1_700_000_000 + part * 60,) * 2)

    def stream(*columns):
        source = spark.readStream.schema("id long, user string, ts timestamp").option("maxFilesPerTrigger", 1)
        return source.parquet(f"{folder}/*.parquet").select("id", "user", "ts", *columns)

    return rows, stream


RULE = dict(user="user", ts="ts", attempts=2, minutes=20, order_by=["id"])


def run_stream(spark, tmp_path, stream, lateness):
    query = (
        admit_stream(stream, **RULE, lateness=lateness).writeStream.format("parquet")
        .option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def test_stream_decides_what_the_watermark_has_passed(spark, tmp_path, arriving):
    rows, stream = arriving
    newest = max(r[2] for r in rows)
    out = run_stream(spark, tmp_path, stream(), "1 hour")
    want = plain(rows, 2, 20)
    got = decided(out)
    assert got == {i: want[i] for i, _, ts in rows if ts < newest - timedelta(hours=1)}
    assert out.filter("late").isEmpty()


def test_stream_accounts_for_late_rows(spark, tmp_path):
    folder = tmp_path / "in"
    at = datetime(2024, 1, 1)
    parts = [
        [(1, "a", at + timedelta(minutes=60))], [(2, "a", at), (3, "a", at + timedelta(minutes=70))],
        [(4, "a", at + timedelta(minutes=61))], [(9, "end", at + timedelta(days=9))],
    ]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "id long, user string, ts timestamp").coalesce(1).write.parquet(f"{folder}/{k}")
    source = spark.readStream.schema("id long, user string, ts timestamp").option("maxFilesPerTrigger", 1)
    out = run_stream(spark, tmp_path, source.parquet(f"{folder}/*"), "1 second")
    found = {r["id"]: (r["accepted"], r["late"]) for r in out.collect()}
    # 2 and 4 lie behind what was decided; the closing row itself still waits
    assert found == {1: (True, False), 2: (None, True), 3: (True, False), 4: (None, True)}


def test_streams_return_rows_without_a_time(spark, tmp_path):
    rows = random_rows(12, 60)
    more = [(1000 + i, user, None) for i, user in enumerate(["hot", "u1", "new", None])]
    end = [(9999, "end", START + timedelta(days=900))]
    for k, part in enumerate([rows[:30] + more[:2], rows[30:] + more[2:], end]):
        df = spark.createDataFrame([(i, u, t and t.replace(tzinfo=None)) for i, u, t in part], "id long, user string, ts timestamp")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema("id long, user string, ts timestamp").option("maxFilesPerTrigger", 1)
    want = plain(rows, 2, 20) | {i: None for i, *_ in more}
    out = run_stream(spark, tmp_path / "stream", source.parquet(f"{tmp_path}/in/*"), "1 day")
    assert decided(out) == want and out.filter("late").isEmpty()
    out = run_batches(spark, tmp_path / "batches", source.parquet(f"{tmp_path}/in/*"), "1 day")
    assert decided(out) == want | {9999: True} and out.filter("late").isEmpty()


def test_state_is_read_in_proportion_to_rows(spark, monkeypatch):
    """One user, many micro-batches, a long lateness: each row is packed and read a few times."""
    from kvflow.streaming import admission as streaming

    class Store(dict):
        def get(self, *key):
            return dict.get(self, "facts") if not key else dict.get(self, *key)

        updateValue, getValue, removeKey = dict.__setitem__, dict.__getitem__, dict.__delitem__

        def update(self, value):
            self["facts"] = value

    class Handle:
        timers: set = set()
        registerTimer, deleteTimer = timers.add, timers.discard

    class Clock:
        def getCurrentWatermarkInMs(self):
            return max(newest - 3600_000, 0)

    read = []
    monkeypatch.setattr(streaming, "_unpacked", lambda v, f=streaming._unpacked: (x := f(v), read.append(len(x)))[0])
    row = T.StructType([T.StructField("id", T.LongType()), T.StructField(streaming._TIME, T.LongType())])
    user = streaming._Admission(row, ["id"], 3, 600_000_000, 3600_000_000 // streaming.BUCKETS)
    user.handle, user.facts, user.waiting = Handle(), Store(), Store()
    newest, rows, got = 0, [], {}
    for batch in range(300):
        part = [(20 * batch + i, (20 * batch + i) * 3_000_000) for i in range(20)]
        random.Random(batch).shuffle(part)
        rows += part
        frame = pd.DataFrame(part, columns=["id", streaming._TIME])
        out = list(user.handleInputRows(("a",), iter([frame]), Clock()))
        newest = max(newest, max(t for _, t in part) // 1000)
        for at in sorted(t for t in Handle.timers if t <= Clock().getCurrentWatermarkInMs()):
            Handle.timers.discard(at)
            out += list(user.handleExpiredTimer(("a",), Clock(), None))
        for f in out:
            got |= dict(zip(f["id"].tolist(), f["accepted"].tolist()))
    want = admission.walk([t for _, t in sorted(rows)], deque(maxlen=3), 600_000_000)
    assert len(got) > 4000 and all(got[i] == want[i] for i in got)
    assert sum(read) < 4 * len(got)


def run_batches(spark, path, stream, lateness, finish=True):
    writer = admit_batches(stream, str(path), **RULE, lateness=lateness, partitions=5)
    query = writer.option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    if finish:
        finish_batches(spark, str(path), **RULE, partitions=5)
    return spark.read.parquet(f"{path}/rows")


def test_batches_of_a_stream(spark, tmp_path, arriving):
    rows, stream = arriving
    more = stream(F.lit("x").alias("more"))
    run_batches(spark, tmp_path, more, "1 hour", finish=False)
    out = run_batches(spark, tmp_path, more, "1 hour")  # the second start finds nothing new
    assert out.select("batch").distinct().count() == 4
    assert decided(out) == plain(rows, 2, 20) and out.filter("more <> 'x' OR late").isEmpty()
    # two states are kept, each with the accepted rows of a window
    kept = sorted(p.name for p in (tmp_path / "state").iterdir())
    assert kept == ["2", "3"]
    last = spark.read.parquet(f"{tmp_path}/state/3/rows")
    assert last.filter("NOT _live").isEmpty() and last.groupBy("user").count().filter("count > 2").isEmpty()


def test_batches_out_of_order_give_the_batch_answer(spark, tmp_path, arriving):
    rows, _ = arriving
    folder = tmp_path / "in"
    for k in range(4):
        part = [r for r in rows if hash(r[0]) % 4 == k]
        spark.createDataFrame(part, "id long, user string, ts timestamp").coalesce(1).write.parquet(f"{folder}/{k}")
    source = spark.readStream.schema("id long, user string, ts timestamp").option("maxFilesPerTrigger", 1)
    out = run_batches(spark, tmp_path / "done", source.parquet(f"{folder}/*"), "30 days")
    assert decided(out) == plain(rows, 2, 20)
    # with too little lateness every row is still there, decided or late
    out = run_batches(spark, tmp_path / "hasty", source.parquet(f"{folder}/*"), "1 second")
    assert sorted(r["id"] for r in out.collect()) == sorted(r[0] for r in rows)
    assert not out.filter("late").isEmpty() and out.filter("late <> (accepted IS NULL)").isEmpty()


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    def step(rows, batch_id):
        df = spark.createDataFrame(rows, "id long, user string, ts timestamp_ntz")
        captured = []

        class Stream:  # hands the step out instead of running it
            writeStream = property(lambda self: self)

            def foreachBatch(self, fn):
                captured.append(fn)

        admit_batches(Stream(), str(tmp_path), "user", "ts", 1, 10, ["id"])
        captured[0](df, batch_id)
        out = spark.read.parquet(f"{tmp_path}/rows/batch={batch_id}")
        return {r["id"]: r["accepted"] for r in out.collect()}

    def at(minute):
        return datetime(2024, 1, 1, 0, minute)

    assert step([], 0) == {}
    assert step([(1, "a", at(0)), (2, "b", at(5))], 1) == {1: True}
    for _ in range(2):
        rows = [(3, "a", at(4)), (4, "b", at(5)), (5, "a", at(10)), (6, "a", at(11))]
        assert step(rows, 2) == {2: True, 3: None, 4: False, 5: False}
    assert step([], 3) == {}
    assert step([(7, "a", at(21)), (8, "a", at(22)), (9, "b", at(22))], 4) == {6: True, 7: False}
    finish_batches(spark, str(tmp_path), "user", "ts", 1, 10, ["id"])
    out = spark.read.parquet(f"{tmp_path}/rows/batch=5")
    assert {r["id"]: r["accepted"] for r in out.collect()} == {8: True, 9: True}
    with pytest.raises(Exception, match="(?i)not.exist"):
        step([], 9)
