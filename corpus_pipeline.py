"""From raw documents to sharded training data: the stages in order, each on what the last one kept.

``run(spark, sf_dir)`` applies them to ``documents``. Each stage's rows are written as Parquet below
the shared folder and read again before the next one, so that a lost executor repeats at most one
stage. Tables that a stage stored on its way are removed when the next stage begins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvflow.llm.common import release, table, written
from kvflow.llm.decontaminate import decontaminate
from kvflow.llm.mixing import mixed_rows
from kvflow.llm.order_minhash import keep_first
from kvflow.llm.ring import shard_rows
from kvflow.llm.toxicity import score_toxicity
from kvflow.sources.paths import delete_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
SHARDS = 16


def packed(docs: DataFrame) -> DataFrame:
    """Id and text, and all other columns as one, so that none meets an operator's own names."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c if c in ("doc_id", "text") else F.col(f"_rest.`{c}`") for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier marks as toxic go."""
    release(spark)
    scored = score_toxicity(packed(docs), table(spark, sf_dir, "labels"), keep_text=True)
    return unpacked(scored.filter("predicted = 0"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of least id stays."""
    release(spark)
    return unpacked(keep_first(packed(docs)), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold any window of the benchmark go; all others stay as they are."""
    release(spark)
    found = decontaminate(packed(docs), table(spark, sf_dir, "benchmark"))
    return unpacked(found.filter("n_hit = 0"), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    release(spark)
    return mixed_rows(docs, "doc_id")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their slot in it."""
    release(spark)
    rows = shard_rows(packed(docs), "doc_id", SHARDS)
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    return rows.select(*[c if c in ("doc_id", "text") else F.col(f"_rest.`{c}`") for c in columns], "shard", "slot")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("shard", shard),
]

#: Trained scores, sketches, index searches and iterated solves are not expressible in DuckDB.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            delete_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
