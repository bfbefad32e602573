"""How far pairs are folded before a reducer sees them, and how evenly a table function's groups are dealt."""

from collections import Counter

from pyspark.sql import functions as F

from kvflow.operators import mapping, reduce


def summed(key, values):
    yield key, sum(map(int, values))


def test_a_task_folds_as_many_keys_as_it_holds(spark):
    pairs = [(f"k{i % 150_000}", "1") for i in range(450_000)]
    out = list(mapping.combined(iter(pairs), summed, mapping.emitter(mapping.KV_DDL, "\t", 1)))
    assert len(out) == 150_000 and all(value == "3" for _, value in out)


def test_pairs_of_several_tasks_are_folded_across_them(spark, kv):
    pairs = [(f"k{i % 90}", "1") for i in range(1000)] + [(None, "2"), (None, "5"), ("", "1")]
    df = kv(pairs, 7)
    inside = mapping.combine_kv(df, summed)
    assert inside.count() > 300
    got = [tuple(r) for r in mapping.combine_kv(inside, summed, across=True).collect()]
    assert sorted(r for r in got if r[0] not in (None, "")) == sorted(
        (k, str(n)) for k, n in Counter(k for k, _ in pairs[:1000]).items()
    )
    assert len(got) <= 93 and sum(int(value) for _, value in got) == 1008


def test_groups_of_a_table_function_fill_its_partitions(spark):
    spark.range(40_000).selectExpr("CAST(id AS STRING) AS key", "'1' AS value").createOrReplaceTempView("many_keys")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shares = []
        for partitions in (4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            reduce.register_reducer(spark, "fold_evenly", summed, value_order=False)
            got = spark.sql("SELECT * FROM fold_evenly(TABLE(many_keys))")
            rows = got.select(F.spark_partition_id().alias("p")).rdd.map(lambda r: r.p).countByValue()
            assert sum(rows.values()) == 40_000
            shares.append(max(rows.values()) * partitions / 40_000)
        assert max(shares) < 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
