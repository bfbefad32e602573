"""What the physical plans look like: pushdown, pruning, shuffles, and no pairwise joins."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kvflow.operators import mapping, paging, reduce
from kvflow.operators.shuffle import shuffle
from kvflow.plans.job import Native, run_job

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_python_job_shuffles_pairs_once_after_folding(spark):
    text = plan(entry.word_count(spark, SF_DIR))
    assert text.count("hashpartitioning") == 1
    above, below = text.split("Exchange hashpartitioning")
    assert "MapInArrow" in above and "MapInArrow" in below
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in below


def test_native_job_aggregates_before_its_shuffle(spark):
    job = run_job(spark, entry.doc_pairs(spark, SF_DIR), Native(entry.native_words), Native(F.count))
    text = plan(job)
    assert text.count("hashpartitioning") == 1 and "partial_count" in text.split("hashpartitioning")[1]
    assert "Python" not in text and "InArrow" not in text
    assert "ReadSchema: struct<text:string>" in text


def test_filters_and_columns_reach_the_scan(spark):
    items = entry.table(spark, SF_DIR, "lineitem").filter(F.col("l_quantity") > 30)
    pairs = items.select(F.col("l_returnflag").alias("key"), F.col("l_tax").alias("value"))
    text = plan(reduce.reduce_agg(pairs, n=F.count("*")))
    assert "GreaterThan(l_quantity,30.0)" in text
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in text


def test_reading_a_page_prunes_row_groups(spark):
    docs = entry.table(spark, SF_DIR, "documents").select("doc_id", "text")
    text = plan(paging.PagedLines(docs, ["doc_id"], page_size=65_536).page(2))
    assert "Exchange" not in text
    assert "_part" in text.split("DataFilters")[1] and "_local" in text.split("DataFilters")[1]


def test_page_by_unique_order_moves_no_text(spark):
    docs = entry.table(spark, SF_DIR, "documents").select("doc_id", "text")
    text = plan(paging.read_page(docs, 2, ["doc_id"], page_size=65_536, unique=True))
    assert "hashpartitioning" not in text and "rangepartitioning" not in text
    assert "GreaterThanOrEqual(doc_id" in text


def test_order_without_whole_keys_uses_ranges(spark, kv):
    pairs = kv([("a", "1")])
    assert "rangepartitioning(key" in plan(shuffle(pairs, whole_keys=False))
    assert "hashpartitioning(key" in plan(shuffle(pairs))
    assert "rangepartitioning(key" in plan(reduce.reduce_kv(pairs, None))


def test_ties_are_numbered_in_a_repeatable_order(spark):
    docs = entry.table(spark, SF_DIR, "documents").selectExpr("lang AS key", "source AS value")
    joined = docs.join(F.broadcast(docs.limit(1).select("key")), "key")
    for narrow in (docs, joined, docs.filter("value > 'a'")):
        assert plan(shuffle(narrow, whole_keys=False)).count("Sort [") == 1
    for moved in (docs.repartition(3), docs.distinct(), docs.union(docs.repartition("key"))):
        text = plan(shuffle(moved, whole_keys=False))
        assert text.count("Sort [") == 2 and "Sort [key" in text.split("rangepartitioning")[1]


@pytest.mark.parametrize("name", sorted(entry._QUERIES))
def test_no_query_pairs_up_rows(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_no_size_moves_rows_before_a_map(spark):
    pairs, words = entry.doc_pairs(spark, SF_DIR), entry.word_pairs(spark, SF_DIR)
    whole = run_job(spark, pairs, entry.word_mapper, entry.sum_reducer, combiner=entry.sum_reducer)
    for df in (words, mapping.map_kv(pairs, entry.word_mapper), entry.word_count_native(spark, SF_DIR), whole):
        assert "RoundRobin" not in plan(df)
    assert "RoundRobin" in plan(mapping.map_kv(pairs, entry.word_mapper, map_tasks=3))
