import random

import pytest
from pyspark.sql import functions as F

from kvflow.operators import naming
from kvflow.operators.naming import assign_unique_names
from kvflow.operators.order import OrderedTotals, total_order


def skewed(n, seed=1):
    """A third of the rows has one key; a few rows are alike."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.35 else f"k{rng.randrange(12):02d}", i, rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_running_totals(spark, partitions):
    rows = skewed(700)
    df = spark.createDataFrame(rows, "k string, i long, w long").repartition(3)
    totals = OrderedTotals(df, ["i"], weight=F.col("w"), group_by=["k"], partitions=partitions)
    whole = {r["i"]: r["before"] for r in totals.running("before").collect()}
    grouped = {r["i"]: r["before"] for r in totals.running_in_group("before").collect()}
    running, per_key = 0, {}
    for k, i, w in sorted(rows):
        assert whole[i] == running
        assert grouped[i] == per_key.get(k, 0)
        running += w
        per_key[k] = per_key.get(k, 0) + w
    assert totals.total() == running


def test_hot_key_is_spread_over_ranges(spark):
    df = spark.createDataFrame(skewed(2000), "k string, i long, w long").repartition(3)
    totals = OrderedTotals(df.select("k"), ["k"], partitions=8)
    sizes = [r["_total"] for r in totals.starts.collect()]
    assert sum(sizes) == 2000 and max(sizes) < 2000 / 4


def test_null_groups(spark):
    rows = [(None, 1), (None, 2), ("a", 3), (None, 4), ("", 5)]
    df = spark.createDataFrame(rows, "k string, i long")
    out = OrderedTotals(df, ["i"], group_by=["k"], partitions=3).running_in_group("n")
    assert {r["i"]: r["n"] for r in out.collect()} == {1: 0, 2: 1, 4: 2, 3: 0, 5: 0}


def test_total_order_with_ties(spark):
    keys = [k for k, _, _ in skewed(500)]
    out = total_order(spark.createDataFrame([(k,) for k in keys], "key string"), partitions=7)
    assert [r["key"] for r in out.orderBy("pos").collect()] == sorted(keys)
    assert sorted(r["pos"] for r in out.collect()) == list(range(1, 501))


def test_numeric_total_order(spark):
    keys = ["10", "9x", "abc", "-2.5z", " 7", "01", "1", "+3"]
    out = total_order(spark.createDataFrame([(k,) for k in keys], "key string"), numeric=True, partitions=3)
    assert [r["key"] for r in out.orderBy("pos").collect()] == ["-2.5z", "+3", "abc", "01", "1", " 7", "9x", "10"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "key string")
    assert total_order(empty).count() == 0
    totals = OrderedTotals(empty, ["key"], group_by=["key"])
    assert totals.total() == 0 and totals.running_in_group("n").count() == 0


def free_names(rows, taken):
    taken, out = set(taken), {}
    for i, name in rows:
        serial, full = 0, name
        while full in taken:
            serial += 1
            full = f"{name}-{serial}"
        taken.add(full)
        out[i] = full
    return out


@pytest.mark.parametrize("seed", range(3))
def test_unique_names(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < 0.4 else f"n{rng.randrange(6)}") for i in range(200)]
    taken = [f"{rng.choice(['hot', 'n1', 'n2', 'other'])}{rng.choice(['', '-1', '-2', '-3', '-9', '-40', '-05', '-x'])}"
             for _ in range(25)]
    df = spark.createDataFrame(rows, "i long, name string").repartition(4)
    existing = spark.createDataFrame([(t,) for t in taken], "t string")
    got = {r["i"]: r["unique_name"] for r in assign_unique_names(df, "name", existing, ["i"]).collect()}
    assert got == free_names(rows, taken)
    got = {r["i"]: r["unique_name"] for r in assign_unique_names(df, "name", None, ["i"]).collect()}
    assert got == free_names(rows, [])


@pytest.mark.parametrize("block, step", [(4, 2), (1 << 16, 3), (7, 1 << 10)])
def test_names_among_many_taken(spark, monkeypatch, block, step):
    """Runs of taken serials across the borders of blocks and steps; other columns and NULL names stay."""
    monkeypatch.setattr(naming, "BLOCK", block)
    monkeypatch.setattr(naming, "STEP", step)
    rng = random.Random(block + step)
    taken = ["hot", *(f"hot-{i}" for i in range(1, 60)), *(f"hot-{i}" for i in range(64, 400, 2)), "n1-3", "n1-4", "n2"]
    rows = [(i, "hot" if rng.random() < 0.7 else f"n{rng.randrange(4)}") for i in range(300)]
    df = spark.createDataFrame([(i, n, f"p{i}") for i, n in rows] + [(999, None, "none")], "i long, name string, _step string")
    existing = spark.createDataFrame([(t,) for t in taken + taken[:5]], "t string")
    out = assign_unique_names(df.repartition(4), "name", existing, ["i"])
    assert out.columns == ["i", "name", "_step", "unique_name"]
    found = {r["i"]: (r["unique_name"], r["_step"]) for r in out.collect()}
    assert found.pop(999) == (None, "none")
    assert found == {i: (n, f"p{i}") for i, n in free_names(rows, taken).items()}


def test_names_that_are_serials_of_each_other(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a-1")], "i long, name string")
    with pytest.raises(ValueError):
        assign_unique_names(df, "name", None, ["i"])


def test_names_that_hold_newlines(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b\nc"), (4, "b\nc")], "i int, name string")
    existing = spark.createDataFrame([("a-1\n",), ("b\nc",), ("b\nc-1",)], "name string")
    got = {r["i"]: r["unique_name"] for r in assign_unique_names(df, "name", existing, ["i"]).collect()}
    assert got == {1: "a", 2: "a-1", 3: "b\nc-2", 4: "b\nc-3"}
