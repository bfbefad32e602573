"""The registered queries: against SQL where there is some, and the pipeline stage by stage."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from check import TABLES, rows_of
from kvflow.llm import queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_all_are_registered():
    names = set(entry.queries())
    assert {"pipeline", *queries.QUERIES} <= names and len(queries.QUERIES) == 13


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
        want = con.sql(queries.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns) and got == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["op2_chat_format", "op7_shard_ring", "op8_pii"])
def test_native_plans_have_no_python(spark, name):
    text = queries.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in text for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_pipeline_stages(spark):
    from kvflow.llm.common import table, written

    docs = table(spark, SF_DIR, "documents").withColumns(
        {"score": F.lit("mine"), "items": F.lit(1), "_key": F.lit(2), "shard": F.lit("old")}
    )
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = written(stage(spark, docs, SF_DIR), f"test-{name}")
        after = docs.count()
        if name != "shard":
            assert docs.columns == columns
            assert docs.filter("score <> 'mine' OR items <> 1 OR _key <> 2 OR shard <> 'old'").isEmpty()
        assert after > 0 and (name == "mix" or after <= before)
        before = after
    sizes = [r["count"] for r in docs.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_pipeline_of_nothing(spark):
    from kvflow.llm.common import written

    empty = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty, _ = written(stage(spark, empty, SF_DIR), f"empty-{name}")
        assert empty.count() == 0
