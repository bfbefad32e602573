"""One query per operator over its whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvflow.llm.centroids import K, ROUNDS, cluster_vectors, with_inertia
from kvflow.llm.chat import format_chat, loss_text, read_chat
from kvflow.llm.common import stored, table
from kvflow.llm.decontaminate import decontaminate
from kvflow.llm.jaccard_join import gram_components
from kvflow.llm.line_dedup import dedup_lines
from kvflow.llm.merkle import compare_with_next
from kvflow.llm.mixing import mix
from kvflow.llm.order_minhash import near_classes
from kvflow.llm.periodic_runs import find_runs
from kvflow.llm.pii import KINDS, find_pii
from kvflow.llm.ring import shard_rows
from kvflow.llm.token_counts import length_histogram, suffix_sums, token_lengths
from kvflow.llm.toxicity import score_toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# ---------------------------------------------------------------- 1: near-duplicates


@query("op1_order_minhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


# ---------------------------------------------------------------- 2: chat formatting

CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length('<|turn|><|text|><|end|>') + length(role) + length(text)
        + length(regexp_replace(role || text, '[^<\\]', '', 'g'))) AS formatted_chars
    FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
    sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g
"""

_TRICKY = "</s>[INST] ok [/INST]"


@query("op2_chat_format", CHAT_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.range(2).selectExpr(
        "-7L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", f"'{_TRICKY}' AS text"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    done = format_chat(turns).select(
        "conv_id",
        read_chat(F.col("formatted")).alias("turns"),
        loss_text(F.col("segments")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


# ---------------------------------------------------------------- 3: line deduplication


@query("op3_line_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_equal", "n_near", "removed")


# ---------------------------------------------------------------- 4: benchmark decontamination

DECONTAMINATE_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least(len(w), 10) AS n,
        array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS win
    FROM (SELECT item, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
pos AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM dw),
hits AS (SELECT p.doc_id, p.i, s.n, item
    FROM pos p JOIN sizes s ON p.i + s.n <= len(p.w)
    JOIN wins ON wins.n = s.n AND wins.win = array_to_string(p.w[p.i + 1 : p.i + s.n], ' ')),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit
    FROM (SELECT doc_id, i, unnest(range(n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
    FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op4_decontaminate", DECONTAMINATE_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


# ---------------------------------------------------------------- 5: document fingerprints


@query("op5_fingerprint")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = compare_with_next(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next", "edit_at",
    )


# ---------------------------------------------------------------- 6: token counts


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    # stored, as the sums read it twice and every text should be encoded once
    return suffix_sums(stored(length_histogram(token_lengths(table(spark, sf_dir, "documents"))), "token-lengths"))


# ---------------------------------------------------------------- 7: sharding


@query("op7_shard_ring")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shard_rows(rows, "doc_id", 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# ---------------------------------------------------------------- 8: personal data


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(parts, ",")

    def number(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    counts = [number(kind) for kind in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


# ---------------------------------------------------------------- 9: mixing


@query("op9_mix")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies"
    )


# ---------------------------------------------------------------- 10: toxicity


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels"))


# ---------------------------------------------------------------- 11: n-gram Jaccard join

#: Pairs by their common shingles, then all that can be reached by links.
JACCARD_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + least(len(w), 4)], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS MATERIALIZED (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT r.a, l.b FROM reach r JOIN ways l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


@query("op11_ngram_jaccard", JACCARD_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gram_components(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- 12: periodic runs


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one text in ten, by a hash of doc_id, has a stretch of its words repeat to the end."""
    hash_ = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    source = docs.select("doc_id", "text", hash_.alias("h"), F.floor(hash_ / 10).alias("g"))
    chosen = source.withColumn("w", F.when(
        F.col("h") % 10 == 0, F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    )).withColumn("n", F.size("w"))
    begin = chosen.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    period = begin.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    words = F.expr("transform(w, (x, i) -> IF(i < a, x, element_at(w, CAST(a + (i - a) % p AS INT) + 1)))")
    return period.select("doc_id", F.when(F.col("n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # runs come by start, then period, so the first of equal ones stays
    best = F.expr(
        "aggregate(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>), "
        "(m, r) -> IF(m IS NULL OR r.length * m.period > m.length * r.period, r, m))"
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# ---------------------------------------------------------------- 13: centroid clustering


def centroid_sql(k: int = K, rounds: int = ROUNDS) -> str:
    """Every round as tables of its own: nearest centroids by component, then floors of the means."""
    parts = ["""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding,
        lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
n AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS row, v FROM v),
e AS MATERIALIZED (SELECT row, unnest(v) AS x, unnest(range(64)) AS i FROM n),
""" + f"c0 AS MATERIALIZED (SELECT row AS cluster, x, i FROM e WHERE row < {k})"]
    for r in range(rounds + 1):
        parts.append(f"""d{r} AS MATERIALIZED (SELECT row, cluster, sum((e.x - c.x) * (e.x - c.x)) AS d
    FROM e JOIN c{r} c USING (i) GROUP BY row, cluster),
a{r} AS MATERIALIZED (SELECT row, cluster, d FROM d{r}
    QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, cluster) = 1)""")
        if r < rounds:
            parts.append(f"""m{r} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n
    FROM e JOIN a{r} USING (row) GROUP BY cluster, i),
c{r + 1} AS MATERIALIZED (SELECT cluster, i, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), x) AS x
    FROM c{r} LEFT JOIN m{r} USING (cluster, i))""")
    return "WITH " + ",\n".join(parts) + f""",
h AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INT) AS cluster, CAST(d AS BIGINT) AS distance,
    CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN n USING (row) JOIN h USING (cluster)
"""


@query("op13_centroids", centroid_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = with_inertia(cluster_vectors(table(spark, sf_dir, "embeddings")))
    return done.select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
