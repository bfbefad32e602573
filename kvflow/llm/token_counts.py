"""Token counts: an exact histogram of encoded lengths, and suffix sums over it.

Each document is encoded whole by a public tokenizer; one partial aggregate per task leaves rows per
distinct length, far fewer than documents. Suffix sums over the lengths then hold the totals, the
quantiles and the truncated totals for every context limit at once, exact for each of them.

Defined results: a null or empty text has length 0 and counts as a document; an empty table gives no
rows; repeated rows count each.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: how this vocabulary cuts texts before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths per first-level block of the suffix sums.
BLOCK = 1024
_ENCODERS: dict[int, object] = {}


def encoder(ranks: bytes, pattern: str = PATTERN):
    """The tokenizer of a ranks file, built once per Python worker."""
    import tiktoken

    key = hash((ranks, pattern))
    if key not in _ENCODERS:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return _ENCODERS[key]


def token_lengths(
    docs: DataFrame, text_col: str = "text", ranks_path: str = RANKS_PATH, pattern: str = PATTERN
) -> DataFrame:
    """(length) of each text. The driver reads the vocabulary, about a megabyte, and broadcasts it."""
    with open(ranks_path, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())

    def count(batches):
        encode = encoder(ranks.value, pattern).encode_ordinary
        for batch in batches:
            texts = batch.column(0)
            lengths = [len(encode(t.as_py() or "")) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], names=["length"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "length long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each distinct length L, what a context limit of L means.

    n_docs of that length; docs_up_to and tokens_up_to it; docs_over and tokens_over it;
    truncated_total, the tokens left when longer documents are cut to L; share_up_to, the quantile
    that L is. Sums run inside blocks of lengths and over block totals, so no task sees all lengths.
    """
    rows = histogram.select(
        "length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / BLOCK).alias("_block")
    )
    per_block = rows.groupBy("_block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_block = per_block.select(  # one row per block of lengths
        "_block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("_tokens_after"),
        F.sum("d").over(whole).alias("_docs"), F.sum("t").over(whole).alias("_tokens"),
    )
    inside = Window.partitionBy("_block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    over = (
        rows.withColumn("_d", F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
        .withColumn("_t", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(per_block, "_block")
    )
    docs_over, tokens_over = F.col("_d") + F.col("_docs_after"), F.col("_t") + F.col("_tokens_after")
    return over.select(
        "length", "n_docs",
        (F.col("_docs") - docs_over).alias("docs_up_to"),
        (F.col("_tokens") - tokens_over).alias("tokens_up_to"),
        docs_over.alias("docs_over"), tokens_over.alias("tokens_over"),
        (F.col("_tokens") - tokens_over + F.col("length") * docs_over).alias("truncated_total"),
        ((F.col("_docs") - docs_over) / F.col("_docs")).alias("share_up_to"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_over, truncated_total) for any context limits, in one pass over the sums.

    Lengths up to the limit stay whole, longer documents leave the limit's tokens each.
    """
    asked = sorted({int(x) for x in limits})
    sides = []
    for k, limit in enumerate(asked):
        short = F.col("length") <= limit
        sides.append(F.sum(F.when(short, F.col("length") * F.col("n_docs")).otherwise(0)).alias(f"t{k}"))
        sides.append(F.sum(F.when(short, 0).otherwise(F.col("n_docs"))).alias(f"d{k}"))
    rows = [
        F.struct(
            F.lit(limit).cast("long").alias("limit"), F.coalesce(f"d{k}", F.lit(0)).alias("docs_over"),
            (F.coalesce(f"t{k}", F.lit(0)) + F.lit(limit) * F.coalesce(f"d{k}", F.lit(0))).alias("truncated_total"),
        )
        for k, limit in enumerate(asked)
    ]
    return sums.agg(*sides).select(F.inline(F.array(*rows)))


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """The least length that at least ``share`` of the documents do not exceed."""
    return sums.filter(F.col("share_up_to") >= share).agg(F.min("length").alias("length"))
