"""Queries over the test tables, one or more per operator, each with the SQL it must agree with."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402
from pyspark import cloudpickle  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from kvflow.functions import records, text  # noqa: E402
from kvflow.operators import admission, external, jobs, logs, mapping, naming, order, paging  # noqa: E402
from kvflow.operators import reduce as reducing  # noqa: E402
from kvflow.operators.shuffle import shuffle  # noqa: E402
from kvflow.plans.job import Native, preview_job, run_job  # noqa: E402
from kvflow.session import scratch_path  # noqa: E402
from kvflow.sources import files, sinks  # noqa: E402
from kvflow.streaming.admission import STATE_STORE, admit_batches, admit_stream, finish_batches  # noqa: E402

if __name__ in sys.modules:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- shared pieces

_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")

LINES_SQL = """(SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS line_no
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""
WORDS_SQL = r"""(SELECT word FROM (
    SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents) WHERE word <> '')"""
WORD_COUNT_SQL = f"SELECT word AS key, CAST(count(*) AS VARCHAR) AS value FROM {WORDS_SQL} GROUP BY word"
WORD_ROWS_SQL = f"SELECT word AS key, count(*) AS n FROM {WORDS_SQL} GROUP BY word"
# byte offset and page of every document, ordered by doc_id
PAGES_SQL = """(SELECT doc_id, byte_offset, CAST(byte_offset // 524288 + 1 AS BIGINT) AS page, bytes FROM (
    SELECT doc_id, strlen(text) + 1 AS bytes,
        CAST(sum(strlen(text) + 1) OVER (ORDER BY doc_id) - strlen(text) - 1 AS BIGINT) AS byte_offset
    FROM documents))"""


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("key"), F.col("text").alias("value")
    )


def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.map_expr(doc_pairs(spark, sf_dir), native_words, map_hint(spark))


def native_words(key, value):
    found = F.filter(F.split(F.lower(value), r"\s+"), lambda w: w != "")
    return F.transform(found, lambda w: records.make_kv(w, F.lit("1")))


def word_mapper(key, value):
    for word in _WORD.findall(value.lower()):
        yield word, 1


def map_hint(spark: SparkSession) -> int | None:
    """The number of map tasks that the session asks for; unset, records are mapped where they are read."""
    tasks = spark.conf.get("kvflow.map.tasks", None)
    return int(tasks) if tasks else None


def sum_reducer(key, values):
    yield key, sum(map(int, values))


def add_reducer(key, values):
    yield key, sum(values)


def text_dir(spark: SparkSession, lines: DataFrame, label: str) -> str:
    path = scratch_path(spark, label)
    lines.write.text(path)
    return path


def ordered_line_files(spark: SparkSession, sf_dir: str) -> str:
    """The lines of all documents as text files whose names follow the order of the lines."""
    lines = doc_lines(spark, sf_dir).repartitionByRange("doc_id", "line_no")
    return text_dir(spark, lines.sortWithinPartitions("doc_id", "line_no").select("line"), "lines")


def entry(spark: SparkSession) -> DataFrame:
    """Word count over the documents: text, map, shuffle, reduce."""
    return word_count(spark, "/root/testdata/sf0.001")


def _text_pipeline() -> tuple[dict[str, Query], dict[str, str]]:
    """The queries of the text pipeline, where that part is installed."""
    try:
        import corpus_pipeline
        from kvflow.llm import queries as more
    except ModuleNotFoundError as missing:
        if missing.name != "corpus_pipeline" and not f"{missing.name}.".startswith("kvflow.llm."):
            raise
        return {}, {}
    found, sql = dict(more.QUERIES), dict(more.ORACLES)
    found["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


def queries() -> dict[str, Query]:
    return {**_QUERIES, **_text_pipeline()[0]}


def oracle_sql() -> dict[str, str]:
    return {**_ORACLES, **_text_pipeline()[1]}


# ---------------------------------------------------------------- sources and sinks


@query("s1_read_kv", f"SELECT CAST(doc_id AS VARCHAR) AS key, line AS value FROM {LINES_SQL}")
def read_records(spark, sf_dir):
    lines = doc_lines(spark, sf_dir).select(records.emit("doc_id", "line"))
    return files.read_kv(spark, text_dir(spark, lines, "s1"))


@query(
    "s2_directory_scan",
    """SELECT concat('nation=', c_nationkey) AS name, count(*) AS lines, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS bytes
    FROM customer GROUP BY c_nationkey""",
)
def directory_scan(spark, sf_dir):
    """One folder per nation, each with a file and with things that are no input."""
    names = table(spark, sf_dir, "customer").select("c_nationkey", "c_name")
    root = scratch_path(spark, "s2")
    one = names.repartition("c_nationkey")
    one.withColumnRenamed("c_nationkey", "nation").write.partitionBy("nation").text(root)
    folders = [f"{root}/nation={k}" for (k,) in names.select("c_nationkey").distinct().collect()]
    for hidden in ("_logs", ".staging", "sub"):
        names.select("c_name").limit(3).write.text(f"{folders[0]}/{hidden}")

    def folder(path):
        return F.regexp_extract(path, "(nation=[0-9]+)/[^/]*$", 1).alias("name")

    sizes = files.list_inputs(spark, folders).groupBy(folder(F.col("path"))).agg(F.sum("length").alias("bytes"))
    lines = files.read_lines(spark, folders)
    lines = lines.groupBy(folder(F.col("_metadata.file_path"))).agg(F.count("*").alias("lines"))
    return sizes.join(lines, "name").select("name", "lines", "bytes")


@query(
    "s3_concat_files",
    f"""SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS line_no, line,
        CAST(sum(strlen(line) + 1) OVER (ORDER BY doc_id, line_no) - strlen(line) - 1 AS BIGINT) AS byte_offset
    FROM {LINES_SQL}""",
)
def concat_files(spark, sf_dir):
    path = ordered_line_files(spark, sf_dir)
    return files.concat_files(spark, path).select("line_no", "line", "byte_offset")


_HOME = "hdfs://nn/home"
_ASKED = """CASE page_id % 8
    WHEN 0 THEN concat('file:///data/', page_id)
    WHEN 1 THEN concat('in/', page_id)
    WHEN 2 THEN concat('/abs/', page_id)
    WHEN 3 THEN concat('hdfs://nn/home/in/', page_id)
    WHEN 4 THEN concat('in/../../other/', page_id)
    WHEN 5 THEN concat('hdfs://nn/homework/', page_id)
    WHEN 6 THEN concat('/home/./in/../in/', page_id)
    ELSE concat('HDFS://NN/home//x/', page_id) END"""
_RESOLVED = """concat(CASE page_id % 8
    WHEN 0 THEN 'file:///data/' WHEN 2 THEN 'hdfs://nn/abs/' WHEN 4 THEN 'hdfs://nn/other/'
    WHEN 5 THEN 'hdfs://nn/homework/' WHEN 7 THEN 'hdfs://nn/home/x/' ELSE 'hdfs://nn/home/in/' END, page_id)"""


def _inputs_sql(outside: str) -> str:
    return f"""SELECT page_id, {_RESOLVED} AS resolved, CASE WHEN page_id % 8 = 0 THEN 'local_denied'
        WHEN page_id % 3 = 0 THEN 'not_found' WHEN page_id % 8 IN (2, 4, 5) THEN '{outside}' ELSE 'ok' END AS verdict
    FROM pages"""


def _checked_inputs(spark, sf_dir, contain: bool):
    pages = table(spark, sf_dir, "pages")
    # a listing names files in full
    there = pages.filter("page_id % 3 <> 0").selectExpr(f"{_RESOLVED} AS path")
    checked = files.check_inputs(pages.selectExpr("page_id", f"{_ASKED} AS path"), _HOME, there, contain=contain)
    return checked.select("page_id", "resolved", "verdict")


@query("s4_check_inputs", _inputs_sql("outside_home"))
def check_inputs(spark, sf_dir):
    return _checked_inputs(spark, sf_dir, True)


@query("s4_check_inputs_anywhere", _inputs_sql("ok"))
def check_inputs_anywhere(spark, sf_dir):
    return _checked_inputs(spark, sf_dir, False)


@query(
    "s5_write_kv",
    """SELECT concat(o_orderkey, chr(9), CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END) AS line
    FROM orders""",
)
def write_records(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderpriority"))
    path = scratch_path(spark, "s5")
    sinks.write_kv(orders.select(F.col("o_orderkey").cast("string").alias("key"), value.alias("value")), path)
    return files.read_lines(spark, path).select(F.col("value").alias("line"))


@query("s6_store_dataset", f"SELECT line, count(*) AS n FROM {LINES_SQL} GROUP BY line")
def store_dataset(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    windows_text = docs.select(F.replace("text", F.lit("\n"), F.lit("\r\n")).alias("text"))
    home = scratch_path(spark, "home")
    stored = sinks.store_dataset(windows_text, home)
    lines = files.read_lines(spark, f"{home}/{stored}", line_sep="\n")
    return lines.groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query(
    "s7_free_names",
    """WITH taken AS (
        SELECT DISTINCT event_type, user_id % 7 AS serial FROM events WHERE value > 90 OR user_id % 7 = 3),
    free AS (
        SELECT t.event_type, s.serial, row_number() OVER (PARTITION BY t.event_type ORDER BY s.serial) AS rank
        FROM (SELECT DISTINCT event_type FROM events) t
        CROSS JOIN (SELECT unnest(range((SELECT count(*) + 10 FROM events))) AS serial) s
        WHERE (t.event_type, s.serial) NOT IN (SELECT (event_type, serial) FROM taken)),
    asked AS (
        SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank
        FROM events)
    SELECT event_id, event_type || CASE WHEN serial = 0 THEN '' ELSE concat('-', serial) END AS unique_name
    FROM asked JOIN free USING (event_type, rank)""",
)
def free_names(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    serial = F.col("user_id") % 7
    taken = events.filter((F.col("value") > 90) | (serial == 3)).select(
        F.when(serial == 0, F.col("event_type")).otherwise(F.concat("event_type", F.lit("-"), serial))
    )
    named = naming.assign_unique_names(
        events.select("event_id", "event_type"), "event_type", taken, ["event_id"]
    )
    return named.select("event_id", "unique_name")


# ---------------------------------------------------------------- records

_EVENT_LINE = """CASE event_id % 4
    WHEN 0 THEN event_type
    WHEN 1 THEN concat(event_type, '\t', props)
    WHEN 2 THEN concat('\t', props)
    ELSE concat(event_type, '\t', props, '\t', user_id) END"""


def event_lines(spark, sf_dir, line: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{line} AS line")


@query(
    "k1_split_first",
    f"""SELECT event_id, CASE WHEN tab > 0 THEN left(line, tab - 1) ELSE line END AS key,
        CASE WHEN tab > 0 THEN substr(line, tab + 1) ELSE '' END AS value
    FROM (SELECT event_id, line, instr(line, chr(9)) AS tab FROM (SELECT event_id, {_EVENT_LINE} AS line FROM events))""",
)
def split_first(spark, sf_dir):
    lines = event_lines(spark, sf_dir, _EVENT_LINE)
    return lines.select("event_id", records.split_kv("line").alias("kv")).select("event_id", "kv.*")


@query(
    "k2_split_nth",
    """WITH lines AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(l_linenumber AS VARCHAR) AS c, count(*) AS n
        FROM lineitem GROUP BY ALL)
    SELECT 1 AS fields, a AS key, b || '#' || c AS value, n FROM lines
    UNION ALL SELECT 2, a || '#' || b, c, n FROM lines
    UNION ALL SELECT 5, a || '#' || b || '#' || c, '', n FROM lines""",
)
def split_nth(spark, sf_dir):
    line = F.concat_ws("#", "l_returnflag", "l_linestatus", "l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select(line.alias("line"))
    # the three splits of a line come from one scan
    splits = F.array(
        *(F.struct(F.lit(n).alias("fields"), records.split_kv("line", "#", n).alias("kv")) for n in (1, 2, 5))
    )
    rows = lines.select(F.inline(splits)).select("fields", "kv.key", "kv.value")
    return rows.groupBy("fields", "key", "value").agg(F.count("*").alias("n"))


@query("k3_emit", "SELECT concat(c_custkey, chr(9), c_name) AS line, c_name AS value FROM customer")
def emit_lines(spark, sf_dir):
    pairs = table(spark, sf_dir, "customer").select(records.make_kv("c_custkey", "c_name").alias("pair"))
    line = records.emit(records.kv_key("pair"), records.kv_value("pair"))
    return pairs.select(line.alias("line"), records.kv_value("pair").alias("value"))


@query(
    "k4_reparse",
    f"""SELECT CASE WHEN line_no > 0 THEN line WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'a' END AS key,
        CASE WHEN line_no > 0 THEN '' WHEN doc_id % 2 = 0 THEN line ELSE concat(doc_id, chr(9), line) END AS value
    FROM {LINES_SQL}""",
)
def reparse(spark, sf_dir):
    doc_id = F.col("doc_id").cast("string")
    key = F.when(F.col("doc_id") % 2 == 0, doc_id).otherwise(F.concat(F.lit("a\t"), doc_id))
    docs = table(spark, sf_dir, "documents").select(key.alias("key"), F.col("text").alias("value"))
    return records.reparse(docs)


_DIALECT_LINE = """CASE event_id % 6
    WHEN 0 THEN ''
    WHEN 1 THEN event_type
    WHEN 2 THEN concat(' ', event_type, ' \t', user_id, ' ')
    WHEN 3 THEN concat(event_type, '\t', user_id, '\t', 'x')
    WHEN 4 THEN concat('\t', user_id)
    ELSE '  \t ' END"""
_DIALECT_LINES = f"(SELECT event_id, event_id % 6 AS kind, {_DIALECT_LINE} AS line FROM events)"
_FIRST_TAB = """CASE WHEN instr(line, chr(9)) > 0 THEN left(line, instr(line, chr(9)) - 1) ELSE {} END AS key,
    CASE WHEN instr(line, chr(9)) > 0 THEN substr(line, instr(line, chr(9)) + 1) ELSE {} END AS value"""
_DIALECT_SQL = {
    "standard": f"SELECT event_id, {_FIRST_TAB.format('line', repr(''))} FROM {_DIALECT_LINES}",
    "value_only": f"SELECT event_id, {_FIRST_TAB.format(repr(''), 'line')} FROM {_DIALECT_LINES}",
    "skip_blank": f"SELECT event_id, {_FIRST_TAB.format('line', repr(''))} FROM {_DIALECT_LINES} WHERE kind <> 0",
    "trim_split": f"""SELECT event_id, string_split(t, chr(9))[1] AS key, coalesce(string_split(t, chr(9))[2], '') AS value
        FROM (SELECT event_id, trim(line, chr(9) || ' ') AS t, kind FROM {_DIALECT_LINES}) WHERE kind NOT IN (0, 3, 5)""",
    "trim_split_reduce": f"""SELECT event_id, string_split(t, chr(9))[1] AS key,
            coalesce(string_split(t, chr(9))[2], '') AS value
        FROM (SELECT event_id, trim(line, chr(9) || ' ') AS t, kind FROM {_DIALECT_LINES}) WHERE kind NOT IN (0, 5)""",
}


_ENDS = """CASE c_custkey % 6
    WHEN 0 THEN concat(c_name, chr(13)) WHEN 1 THEN concat(c_name, chr(13), chr(10)) WHEN 2 THEN concat(c_name, chr(10))
    WHEN 3 THEN concat(chr(13), c_name) WHEN 4 THEN concat('ab', c_name) ELSE concat(c_name, 'a') END"""
# keys that end in a part of the separator move its place
_ODD_KEYS = "CASE WHEN c_custkey % 3 = 0 THEN 'xa' WHEN c_custkey % 3 = 1 THEN 'x' ELSE 'aay' END"


@query(
    "k4_reparse_crlf",
    rf"""WITH lines AS (SELECT c_custkey, regexp_split_to_array(concat(k, 'aa', v, chr(10)), '\r\n|\r|\n') AS parts
        FROM (SELECT c_custkey, {_ODD_KEYS} AS k, {_ENDS} AS v FROM customer)),
    one AS (SELECT unnest(parts[1 : len(parts) - 1]) AS line FROM lines)
    SELECT form, CASE WHEN strpos(line, 'aa') > 0 THEN left(line, strpos(line, 'aa') - 1) ELSE line END AS key,
        CASE WHEN strpos(line, 'aa') > 0 THEN substr(line, strpos(line, 'aa') + 2) ELSE '' END AS value
    FROM one, (SELECT unnest(['column', 'python']) AS form)""".replace("\\r", "\r").replace("\\n", "\n"),
)
def reparse_line_ends(spark, sf_dir):
    pairs = table(spark, sf_dir, "customer").selectExpr(f"{_ODD_KEYS} AS key", f"{_ENDS} AS value")
    by_column = records.reparse(pairs, sep="aa")
    by_python = mapping.map_kv(pairs, lambda key, value: [(key, value)], schema="key STRING, value STRING", sep="aa")
    return by_column.withColumn("form", F.lit("column")).unionAll(by_python.withColumn("form", F.lit("python")))


def _dialect_query(dialect: str) -> Query:
    def run(spark, sf_dir):
        lines = event_lines(spark, sf_dir, _DIALECT_LINE)
        pairs = lines.select("event_id", records.split_kv("line", dialect=dialect).alias("kv"))
        return pairs.filter("kv IS NOT NULL").select("event_id", "kv.*")

    return run


for _name, _sql in _DIALECT_SQL.items():
    query(f"k5_dialect_{_name}", _sql)(_dialect_query(_name))


# ---------------------------------------------------------------- map


def _counted(kv: DataFrame) -> DataFrame:
    return kv.groupBy("key").agg(F.count("*").alias("n"))


@query("m1_map_words", WORD_ROWS_SQL)
def map_words(spark, sf_dir):
    return _counted(mapping.map_kv(doc_pairs(spark, sf_dir), word_mapper, map_tasks=map_hint(spark)))


@query("m2_map_expr_words", WORD_ROWS_SQL)
def map_words_native(spark, sf_dir):
    return _counted(word_pairs(spark, sf_dir))


@query("m3_map_table_function", WORD_ROWS_SQL)
def map_words_sql(spark, sf_dir):
    mapping.register_mapper(spark, "split_words", word_mapper)
    doc_pairs(spark, sf_dir).createOrReplaceTempView("doc_pairs")
    return spark.sql(
        """SELECT m.key, count(*) AS n FROM doc_pairs, LATERAL split_words(doc_pairs.key, doc_pairs.value) m
        GROUP BY m.key"""
    )


@query("m4_map_tasks", WORD_ROWS_SQL)
def map_words_in_tasks(spark, sf_dir):
    return _counted(mapping.map_kv(doc_pairs(spark, sf_dir), word_mapper, map_tasks=5))


# ---------------------------------------------------------------- shuffle and order


@query(
    "x1_hash_partition",
    f"SELECT word AS key, count(*) AS n, CAST(1 AS BIGINT) AS n_partitions FROM {WORDS_SQL} GROUP BY word",
)
def hash_partition(spark, sf_dir):
    pairs = mapping.combine_kv(word_pairs(spark, sf_dir), sum_reducer)
    moved = shuffle(pairs, 8).withColumn("part", F.spark_partition_id())
    return moved.groupBy("key").agg(
        F.sum(F.col("value").cast("bigint")).alias("n"), F.countDistinct("part").alias("n_partitions")
    )


_HOT_PAIRS = "CASE WHEN event_id % 3 < 2 THEN event_type ELSE concat('user-', user_id) END"


@query(
    "x1_hot_keys",
    f"""WITH p AS (SELECT {_HOT_PAIRS} AS key FROM events)
    SELECT key, count(*) AS n, CAST(1 AS BIGINT) AS n_partitions,
        CASE WHEN count(*) * 16 >= (SELECT count(*) FROM p) THEN CAST(1 AS BIGINT) END AS keys_there
    FROM p GROUP BY key""",
)
def hot_partitions(spark, sf_dir):
    """Every key with a sixteenth of the pairs is alone in its partition; all keys stay whole."""
    pairs = table(spark, sf_dir, "events").selectExpr(f"{_HOT_PAIRS} AS key", "CAST(event_id AS STRING) AS value")
    moved = shuffle(pairs, 24, hot_share=1 / 16).withColumn("part", F.spark_partition_id())
    there = moved.groupBy("part").agg(F.countDistinct("key").alias("keys"))
    per_key = moved.groupBy("key", "part").agg(F.count("*").alias("n")).join(there, "part")
    sums = per_key.groupBy("key").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_partitions"), F.max("keys").alias("keys")
    )
    return sums.select(
        "key", "n", "n_partitions", F.when(F.col("n") * 16 >= pairs.count(), F.col("keys")).alias("keys_there")
    )


def _inversions(batches):
    last = None
    rows = found = 0
    for batch in batches:
        if batch.num_rows:
            keys = batch.column(0)
            if last is not None:
                keys = pa.concat_arrays([pa.array([last], keys.type), keys])
            found += pc.sum(pc.less(keys.slice(1), keys.slice(0, len(keys) - 1))).as_py() or 0
            rows += batch.num_rows
            last = keys[-1].as_py()
    yield pa.RecordBatch.from_pydict({"n_rows": [rows], "inversions": [found]})


@query(
    "x2_sorted_partitions",
    f"SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS inversions FROM {WORDS_SQL}",
)
def sorted_partitions(spark, sf_dir):
    ordered = shuffle(word_pairs(spark, sf_dir))
    found = ordered.select("key").mapInArrow(_inversions, "n_rows bigint, inversions bigint")
    return found.agg(F.sum("n_rows").alias("n_rows"), F.sum("inversions").alias("inversions"))


_NUMERIC_KEY = """CASE p_partkey % 7
    WHEN 0 THEN concat(p_size, '')
    WHEN 1 THEN concat(p_size, 'x')
    WHEN 2 THEN concat('-', p_size, '.25z')
    WHEN 3 THEN concat('0', p_size)
    WHEN 4 THEN concat('abc', p_size)
    WHEN 5 THEN concat(' ', p_size, '.5')
    ELSE concat('+', p_size) END"""


@query(
    "x3_numeric_order",
    rf"""SELECT key, row_number() OVER (ORDER BY coalesce(try_cast(
            regexp_extract(key, '^[ \t]*(-?[0-9]*[.]?[0-9]*)', 1) AS DOUBLE), 0), key) AS pos
    FROM (SELECT {_NUMERIC_KEY} AS key FROM part)""",
)
def numeric_order(spark, sf_dir):
    keys = table(spark, sf_dir, "part").selectExpr(f"{_NUMERIC_KEY} AS key")
    return order.total_order(keys, numeric=True)


@query("x4_total_order", "SELECT c_name AS key, row_number() OVER (ORDER BY c_name) AS pos FROM customer")
def total_order(spark, sf_dir):
    return order.total_order(table(spark, sf_dir, "customer").select(F.col("c_name").alias("key")))


@query(
    "x4_total_order_hot_keys",
    """SELECT key, min(pos) AS first_pos, max(pos) AS last_pos FROM (
        SELECT l_returnflag AS key, row_number() OVER (ORDER BY l_returnflag) AS pos FROM lineitem) GROUP BY key""",
)
def total_order_hot(spark, sf_dir):
    ranked = order.total_order(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("key")))
    return ranked.groupBy("key").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def ends_reducer(key, values):
    first = last = next(values)
    for last in values:
        pass
    yield key, f"{first} {last}"


def ends_combiner(key, values):
    held = list(values)  # one task's share, at most the combiner's bound
    yield key, min(held)
    if len(held) > 1:
        yield key, max(held)


@query(
    "x5_value_order",
    """SELECT o_orderpriority AS key, concat(min(v), ' ', max(v)) AS value
    FROM (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS v FROM orders) GROUP BY 1""",
)
def value_order(spark, sf_dir):
    pairs = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("value")
    )
    return reducing.reduce_kv(pairs, ends_reducer, value_order="value", combiner=ends_combiner)


# ---------------------------------------------------------------- reduce


def word_count(spark, sf_dir):
    return run_job(
        spark, doc_pairs(spark, sf_dir), word_mapper, sum_reducer, combiner=sum_reducer, name="words"
    )


@query("r1_reduce_words", WORD_COUNT_SQL)
def reduce_words(spark, sf_dir):
    mapped = mapping.map_kv(
        doc_pairs(spark, sf_dir), word_mapper, map_tasks=map_hint(spark), combiner=sum_reducer
    )
    return reducing.reduce_kv(mapped, sum_reducer)


@query("r2_reduce_table_function", WORD_COUNT_SQL)
def reduce_words_sql(spark, sf_dir):
    reducing.register_reducer(spark, "sum_values", sum_reducer, value_order=True)
    mapped = mapping.map_kv(doc_pairs(spark, sf_dir), word_mapper, combiner=sum_reducer)
    mapping.combine_kv(mapped, sum_reducer, across=True).createOrReplaceTempView("word_pairs")
    return spark.sql("SELECT * FROM sum_values(TABLE(word_pairs))")


def long_sum_reducer(key, values):
    n = total = 0
    for value in values:
        n, total = n + 1, total + value
    yield key, n, total


@query(
    "r2_typed_reduce",
    """SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total
    FROM events GROUP BY user_id""",
)
def reduce_typed_sql(spark, sf_dir):
    """Long values in, and rows out whose types the call names."""
    reducing.register_reducer(spark, "sum_longs", long_sum_reducer, value_order=False)
    pairs = table(spark, sf_dir, "events").selectExpr("CAST(user_id AS STRING) AS key", "event_id AS value")
    pairs.createOrReplaceTempView("long_pairs")
    return spark.sql("SELECT * FROM sum_longs(TABLE(long_pairs), 'key string, n bigint, total bigint')")


def group_sum(key, batches):
    yield key, sum(int(batch.astype("int64").sum()) for batch in batches)


@query(
    "r3_reduce_group",
    "SELECT CAST(user_id AS VARCHAR) AS key, CAST(CAST(sum(event_id) AS BIGINT) AS VARCHAR) AS value FROM events GROUP BY 1",
)
def reduce_groups(spark, sf_dir):
    pairs = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("value")
    )
    return reducing.reduce_group(pairs, group_sum, combiner=sum_reducer)


@query(
    "r4_reduce_native",
    """SELECT concat(l_returnflag, '|', l_linestatus) AS key, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS total,
        min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean
    FROM lineitem GROUP BY 1""",
)
def reduce_native(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("|", "l_returnflag", "l_linestatus").alias("key"), F.col("l_quantity").alias("value")
    )
    value = F.col("value")
    return reducing.reduce_agg(
        pairs, n=F.count("*"), total=F.sum(value).cast("bigint"), low=F.min(value), high=F.max(value),
        mean=F.round(F.avg(value), 6),
    )


@query("r4_word_count_native", WORD_COUNT_SQL)
def word_count_native(spark, sf_dir):
    return run_job(
        spark, doc_pairs(spark, sf_dir), Native(native_words), Native(lambda value: F.count(value)),
        map_tasks=map_hint(spark),
    )


@query(
    "r5_identity_reduce",
    """SELECT 'rows' AS what, l_returnflag AS key, count(*) AS n, count(DISTINCT l_orderkey) AS n_values
        FROM lineitem GROUP BY l_returnflag
    UNION ALL SELECT 'inversions', NULL, 0, NULL""",
)
def identity_reduce(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("key"), F.col("l_orderkey").cast("string").alias("value")
    )
    passed = reducing.reduce_kv(pairs, None)
    rows = passed.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))
    found = passed.select("key").mapInArrow(_inversions, "n_rows bigint, inversions bigint")
    found = found.agg(F.sum("inversions").alias("n"))
    return rows.select(F.lit("rows").alias("what"), "key", "n", "n_values").unionAll(
        found.select(F.lit("inversions"), F.lit(None).cast("string"), "n", F.lit(None).cast("bigint"))
    )


@query(
    "r6_typed_values",
    "SELECT o_orderpriority AS key, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
)
def typed_values(spark, sf_dir):
    pairs = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("key"), F.col("o_totalprice").cast("string").alias("value")
    )
    sums = reducing.reduce_kv(
        pairs, add_reducer, schema="key string, total double", value_type="double", combiner=add_reducer
    )
    return sums.select("key", F.round("total", 2).alias("total"))


@query("r7_whole_job", WORD_COUNT_SQL)
def whole_job(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(records.emit("doc_id", F.replace("text", F.lit("\n"), F.lit(" "))))
    return run_job(
        spark, text_dir(spark, lines, "r7"), word_mapper, sum_reducer, combiner=sum_reducer,
        name="word count", home=scratch_path(spark, "r7-home"),
    )


@query("r7_map_tasks", WORD_COUNT_SQL)
def job_in_map_tasks(spark, sf_dir):
    """Text files cut for eight map tasks as they are read; no record is moved before the map."""
    lines = doc_lines(spark, sf_dir).select(records.emit("doc_id", "line"))
    return run_job(
        spark, text_dir(spark, lines, "r7-tasks"), Native(native_words), Native(lambda value: F.count(value)), map_tasks=8
    )


@query(
    "r7_native_numeric",
    f"""SELECT key, value, part FROM (SELECT CAST(strlen(word) AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS value,
        1 AS part FROM {WORDS_SQL} GROUP BY strlen(word))
    UNION ALL SELECT 'in order', 'true', 1""",
)
def native_numeric_job(spark, sf_dir):
    """One reduce task with keys in numeric order."""
    def lengths(key, value):
        return F.transform(native_words(key, value), lambda p: records.make_kv(F.octet_length(p["key"]), F.lit("1")))

    counts = run_job(
        spark, doc_pairs(spark, sf_dir), Native(lengths), Native(F.count), reduce_tasks=1, numeric=True
    ).withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    counts = counts.withColumn("n", F.col("key").cast("int"))
    by_place = F.array_sort(F.collect_list(F.struct("at", "n")))
    in_order = F.array_sort(F.collect_list("n")) == F.transform(by_place, lambda r: r["n"])
    whole = counts.agg((in_order & (F.count_distinct("part") == 1)).cast("string").alias("value"))
    rows = counts.select("key", "value", F.lit(1).alias("part"))
    return rows.unionAll(whole.select(F.lit("in order"), "value", F.lit(1)))


@query(
    "r7_program_job_counters",
    """SELECT 'pair' AS "group", CAST(c_nationkey AS VARCHAR) AS name, count(*) AS n FROM customer GROUP BY c_nationkey
    UNION ALL SELECT 'seen', 'even', count(*) FROM customer WHERE c_nationkey % 2 = 0
    UNION ALL SELECT 'keys', 'reduced', count(DISTINCT c_nationkey) FROM customer""",
)
def program_job_counters(spark, sf_dir):
    """Programs with separators of their own, an exit code that does not count, and counters."""
    pairs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("key"), F.col("c_nationkey").cast("string").alias("value")
    )
    mapper = ["awk", "-F", ";", """{ print $2 "|1"; if ($2 % 2 == 0) print "reporter:counter:seen,even,1" > "/dev/stderr" }
        END { exit 3 }"""]
    reducer = ["awk", "-F", "|", """function out() { print k "=" s; print "reporter:counter:keys,reduced,1" > "/dev/stderr" }
        NR > 1 && $1 != k { out(); s = 0 } { k = $1; s += $2 } END { out() }"""]
    result, counts = run_job(
        spark, pairs, mapper, reducer, counters=True,
        map_options={"in_sep": ";", "out_sep": "|", "on_exit": "ignore"}, reduce_options={"in_sep": "|", "out_sep": "="},
    )
    result = order.stored(result, "r7-pairs")  # counters are there once the table has been computed
    ours = counts.totals().filter("`group` <> 'records'").select("group", F.col("counter").alias("name"), F.col("total").alias("n"))
    rows = result.select(F.lit("pair").alias("group"), F.col("key").alias("name"), F.col("value").cast("bigint").alias("n"))
    return rows.unionAll(ours)


# ---------------------------------------------------------------- external programs

# Sums the values of equal neighbouring keys; also fit to run before the shuffle.
_SUM_PROGRAM = [
    "awk", "-F", "\t",
    'NR > 1 && $1 != k { printf "%s\\t%d\\n", k, s; s = 0 } { k = $1; s += $2 } END { printf "%s\\t%d\\n", k, s }',
]


def customer_pairs(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value")
    )


@query("p1_program_map", "SELECT CAST(c_custkey AS VARCHAR) AS key, upper(c_name) AS value FROM customer")
def program_map(spark, sf_dir):
    return external.pipe_map(customer_pairs(spark, sf_dir), "tr a-z A-Z")


@query(
    "p2_program_reduce",
    "SELECT event_type AS key, CAST(count(*) AS VARCHAR) AS value FROM events GROUP BY 1",
)
def program_reduce(spark, sf_dir):
    pairs = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.lit("1").alias("value"))
    return external.pipe_reduce(pairs, _SUM_PROGRAM, combine_cmd=_SUM_PROGRAM)


@query(
    "p3_program_params",
    """SELECT CAST(c_custkey AS VARCHAR) AS key, concat(c_name, chr(9), 'word count', chr(9), '2=3') AS value
    FROM customer""",
)
def program_params(spark, sf_dir):
    show = 'BEGIN { OFS = "\\t" } { print $0, ENVIRON["job_name"], ENVIRON["b"] }'
    return external.pipe_map(
        customer_pairs(spark, sf_dir), ["awk", show], params={"job.name": "word count"}, extra_env="a=1 b=2=3 junk"
    )


@query("p4_exit_ignored", "SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS value FROM customer")
def exit_ignored(spark, sf_dir):
    return external.pipe_map(customer_pairs(spark, sf_dir), ["sh", "-c", "cat; exit 3"], on_exit="ignore")


@query(
    "p5_skip_rest",
    """SELECT o_orderkey AS first_key FROM (
        SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey % 8 ORDER BY o_orderkey) AS rn FROM orders)
    WHERE rn <= 5""",
)
def skip_rest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").repartitionById(8, (F.col("o_orderkey") % 8).cast("int"))
    pairs = orders.sortWithinPartitions("o_orderkey").select(
        F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("value")
    )
    kept = external.pipe_map(pairs, "head -n 5", skip_after=5)
    return kept.select(F.col("key").cast("bigint").alias("first_key"))


_COUNTER_LINE = """CASE event_id % 6
    WHEN 0 THEN concat('reporter:counter:', event_type, ',seen,', user_id)
    WHEN 1 THEN concat('reporter:counter: g,', event_type, ',2 ')
    WHEN 2 THEN 'reporter:counter:g,n,x'
    WHEN 3 THEN 'reporter:counter:g,n'
    WHEN 4 THEN concat('reporter:counter:g,n,', user_id, ',')
    ELSE 'hello' END"""


@query(
    "p6_counters",
    """SELECT event_type AS "group", 'seen' AS counter, CAST(sum(user_id) AS BIGINT) AS total
        FROM events WHERE event_id % 6 = 0 GROUP BY event_type
    UNION ALL SELECT 'g', event_type, 2 * count(*) FROM events WHERE event_id % 6 = 1 GROUP BY event_type
    UNION ALL SELECT 'g', 'n', CAST(sum(user_id) AS BIGINT) FROM events WHERE event_id % 6 = 4""",
)
def counters(spark, sf_dir):
    return logs.parse_counters(event_lines(spark, sf_dir, _COUNTER_LINE))


@query(
    "p6_program_counters",
    """SELECT 'records' AS "group", unnest(['read', 'skipped', 'written']) AS counter,
        unnest([n, 0, n]) AS total FROM (SELECT count(*) AS n FROM customer)
    UNION ALL SELECT 'names', 'long', count(*) FROM customer WHERE c_custkey % 2 = 0""",
)
def program_counters(spark, sf_dir):
    report = '{ print; if ($1 % 2 == 0) print "reporter:counter:names,long,1" > "/dev/stderr" }'
    log = external.pipe_map(customer_pairs(spark, sf_dir), ["awk", report], log=True)
    return logs.parse_counters(log.filter("channel = 'err'"))


@query(
    "p7_status",
    "SELECT user_id AS task_id, arg_max(concat(event_type, ' ', event_id), event_id) AS status FROM events GROUP BY 1",
)
def status(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"),
        F.concat(F.lit("reporter:status: "), "event_type", F.lit(" "), "event_id").alias("line"),
    )
    return logs.latest_status(log)


@query(
    "p8_rates",
    """SELECT user_id, n, d, CASE WHEN d = 0 THEN 'NA' ELSE concat(n // d, '=', n, '/', d) END AS rate FROM (
        SELECT user_id, count(*) AS n, count(*) FILTER (WHERE value > 60) AS d FROM events GROUP BY user_id)""",
)
def rates(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") > 60).alias("d")
    )
    return counts.withColumn("rate", logs.rate_text("n", "d"))


# ---------------------------------------------------------------- pages and prefixes


@query("l1_all_pages", f"SELECT doc_id, byte_offset, page FROM {PAGES_SQL}")
def all_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return paging.line_pages(docs, ["doc_id"]).select("doc_id", "byte_offset", "page")


@query(
    "l1_read_page",
    f"""SELECT doc_id, byte_offset, CAST(2 AS BIGINT) AS page, text FROM {PAGES_SQL} JOIN documents USING (doc_id)
    WHERE byte_offset // 131072 = 1""",
)
def read_page(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return paging.read_page(docs, 2, ["doc_id"], page_size=131_072, unique=True)


@query(
    "l1_read_file_page",
    f"""SELECT line, byte_offset FROM (
        SELECT line, CAST(sum(strlen(line) + 1) OVER (ORDER BY doc_id, line_no) - strlen(line) - 1 AS BIGINT) AS byte_offset
        FROM {LINES_SQL}) WHERE byte_offset // 131072 = 1""",
)
def read_file_page(spark, sf_dir):
    path = ordered_line_files(spark, sf_dir)
    return paging.read_file_page(spark, path, 2, page_size=131_072).select("line", "byte_offset")


@query(
    "l2_page_index",
    f"SELECT page, count(*) AS n_lines, CAST(sum(bytes) AS BIGINT) AS n_bytes FROM {PAGES_SQL} GROUP BY page",
)
def page_index(spark, sf_dir):
    return paging.page_index(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


@query(
    "l2_reopened_index",
    f"""SELECT line_no, line, byte_offset FROM (
        SELECT line, CAST(row_number() OVER (ORDER BY doc_id, line_no) - 1 AS BIGINT) AS line_no,
            CAST(sum(strlen(line) + 1) OVER (ORDER BY doc_id, line_no) - strlen(line) - 1 AS BIGINT) AS byte_offset
        FROM {LINES_SQL}) WHERE byte_offset // 131072 IN (1, 2)""",
)
def reopened_index(spark, sf_dir):
    """Two pages by an index that was stored before and is opened by its path."""
    folder = scratch_path(spark, "page-index")
    paging.FilePageIndex.build(spark, ordered_line_files(spark, sf_dir), folder, page_size=131_072)
    index = paging.FilePageIndex(spark, folder)
    return index.page(2).unionAll(index.page(3)).select("line_no", "line", "byte_offset")


# the longest run of whole characters in what the cap leaves of a document
def _capped_sql(cap: int) -> str:
    return f"""(SELECT doc_id, byte_offset, CASE WHEN strlen(text) <= {cap} - byte_offset THEN text ELSE
            left(text, (SELECT max(i) FROM range(0, {cap} + 1) r(i)
                WHERE strlen(left(text, CAST(i AS BIGINT))) <= {cap} - byte_offset)) END AS text
        FROM (SELECT doc_id, byte_offset, text FROM {PAGES_SQL} JOIN documents USING (doc_id)
            WHERE byte_offset < {cap}))"""


@query("l3_take_bytes", f"SELECT doc_id, byte_offset, text FROM {_capped_sql(10_000)}")
def take_bytes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return paging.take_bytes(docs, 10_000, ["doc_id"])


@query(
    "l4_preview",
    rf"""SELECT word AS key, CAST(count(*) AS VARCHAR) AS value FROM (
        SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM {_capped_sql(1024)})
    WHERE word <> '' GROUP BY word""",
)
def preview(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("\t"), "text").alias("line"))
    # the tab in front makes the text the value; it is part of the line, so the cap counts it
    docs = docs.withColumn("line", F.substr("line", F.lit(2)))
    done = preview_job(spark, docs, key_word_mapper, sum_reducer, cap=1024, order_by=["doc_id"])
    return done.reduced


@query(
    "l3_take_file_bytes",
    f"""SELECT byte_offset, CASE WHEN strlen(line) <= 10000 - byte_offset THEN line ELSE
            left(line, (SELECT max(i) FROM range(0, 10001) r(i)
                WHERE strlen(left(line, CAST(i AS BIGINT))) <= 10000 - byte_offset)) END AS line
    FROM (SELECT line, CAST(sum(strlen(line) + 1) OVER (ORDER BY doc_id, line_no) - strlen(line) - 1 AS BIGINT)
        AS byte_offset FROM {LINES_SQL}) WHERE byte_offset < 10000""",
)
def take_file_bytes(spark, sf_dir):
    path = ordered_line_files(spark, sf_dir)
    return paging.take_file_bytes(spark, path, 10_000).select("byte_offset", "line")


@query(
    "l4_preview_failure",
    f"""SELECT 'map' AS phase, 3 AS code, count(*) AS n_records, 'oops' AS errors, 'FAILED' AS state
    FROM {_capped_sql(1024)}, (SELECT unnest(string_split(text, chr(10))))""",
)
def preview_failure(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    failing = ["sh", "-c", "cat; echo oops >&2; echo reporter:status:hidden >&2; exit 3"]
    done = preview_job(spark, docs, failing, sum_reducer, cap=1024, order_by=["doc_id"], line="text")
    return done.phases.withColumn("state", F.lit(done.state))


def key_word_mapper(key, value):
    yield from word_mapper(None, key)


# ---------------------------------------------------------------- scalar functions


@query(
    "f1_split",
    """SELECT p_partkey, len(t) AS n, array_to_string(t, '|') AS tokens FROM (
        SELECT p_partkey, regexp_split_to_array(concat(' ', p_name, '  ', p_type, ' '), ' +') AS t FROM part)""",
)
def f_split(spark, sf_dir):
    tokens = text.kv_split(F.concat(F.lit(" "), "p_name", F.lit("  "), "p_type", F.lit(" ")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.size(tokens).cast("bigint").alias("n"), F.array_join(tokens, "|").alias("tokens")
    )


@query(
    "f2_split_max",
    """SELECT p_partkey, array_to_string(CASE WHEN len(t) > 3 THEN list_append(t[1:2], array_to_string(t[3:], ' '))
        ELSE t END, '|') AS tokens
    FROM (SELECT p_partkey, regexp_split_to_array(
        CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE concat(p_name, ' ', p_brand, '  ', p_size) END, ' +') AS t
        FROM part)""",
)
def f_split_max(spark, sf_dir):
    line = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(
        F.concat("p_name", F.lit(" "), "p_brand", F.lit("  "), "p_size")
    )
    tokens = text.kv_split(line, " +", 3)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tokens, "|").alias("tokens"))


_COMMA_TEXT = """CASE event_id % 6
    WHEN 0 THEN ''
    WHEN 1 THEN ','
    WHEN 2 THEN concat(event_type, ',', user_id, ',')
    WHEN 3 THEN concat(event_type, ',,', user_id)
    WHEN 4 THEN concat(',', event_type, ',,')
    ELSE event_type END"""


@query(
    "f3_split_char",
    f"""SELECT event_id, len(u) AS n, array_to_string(u, '|') AS tokens FROM (
        SELECT event_id, CASE WHEN t[-1] = '' THEN t[:-2] ELSE t END AS u FROM (
            SELECT event_id, string_split({_COMMA_TEXT}, ',') AS t FROM events))""",
)
def f_split_char(spark, sf_dir):
    tokens = text.split_char("line", ",")
    return event_lines(spark, sf_dir, _COMMA_TEXT).select(
        "event_id", F.size(tokens).cast("bigint").alias("n"), F.array_join(tokens, "|").alias("tokens")
    )


_MANY_TEXT = "concat(p_name, ';;', p_type, CASE p_partkey % 3 WHEN 0 THEN ',x' WHEN 1 THEN ',xy' ELSE ',' END)"
_MANY_SQL = f"""SELECT p_partkey, array_to_string({{}}, '|') AS tokens FROM (
    SELECT p_partkey, list_filter(regexp_split_to_array({_MANY_TEXT}, '[,; ]'), lambda x: x <> '') AS t FROM part)"""


def _split_many(legacy: bool) -> Query:
    def run(spark, sf_dir):
        parts = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_MANY_TEXT} AS line")
        tokens = text.split_any("line", ",; ", legacy)
        return parts.select("p_partkey", F.array_join(tokens, "|").alias("tokens"))

    return run


query("f4_split_any", _MANY_SQL.format("t"))(_split_many(False))
query("f4_split_any_legacy", _MANY_SQL.format("CASE WHEN len(t[-1]) = 1 THEN t[:-2] ELSE t END"))(_split_many(True))

_NUMBER_TEXT = """CASE l_linenumber % 7
    WHEN 0 THEN concat(CAST(l_quantity AS INT), 'x')
    WHEN 1 THEN concat(' ', CAST(l_quantity AS INT))
    WHEN 2 THEN concat('-', CAST(l_quantity AS INT), '.5z')
    WHEN 3 THEN concat('abc', CAST(l_quantity AS INT))
    WHEN 4 THEN concat(CAST(l_quantity AS INT), '00000000000')
    WHEN 5 THEN concat('+', CAST(l_quantity AS INT), 'e2')
    ELSE '' END"""


@query(
    "f5_parse_numbers",
    rf"""SELECT s, CAST(least(coalesce(h, 0), 2147483647) AS INTEGER) AS i, CAST(coalesce(h, 0) AS BIGINT) AS l,
        coalesce(try_cast(regexp_extract(s, '^\s*([+-]?[0-9]+\.?[0-9]*(e[0-9]+)?)', 1) AS DOUBLE), 0) AS d, n
    FROM (SELECT s, try_cast(regexp_extract(s, '^\s*([+-]?[0-9]+)', 1) AS HUGEINT) AS h, count(*) AS n
        FROM (SELECT {_NUMBER_TEXT} AS s FROM lineitem) GROUP BY s)""",
)
def f_parse_numbers(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr(f"{_NUMBER_TEXT} AS s")
    parsed = lines.select(
        "s", text.parse_int("s").alias("i"), text.parse_long("s").alias("l"), text.parse_double("s").alias("d")
    )
    return parsed.groupBy("s", "i", "l", "d").agg(F.count("*").alias("n"))


@query(
    "f6_parse_bool",
    "SELECT doc_id, quality <> 0 AS good, toxic <> 0 AS bad FROM labels",
)
def f_parse_bool(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    flags = {"good": "quality", "bad": "toxic"}
    return labels.select("doc_id", *(text.parse_bool(F.col(c).cast("string")).alias(n) for n, c in flags.items()))


@query("f7_to_text", "SELECT CAST(c_custkey AS VARCHAR) AS k, CAST(c_nationkey AS VARCHAR) AS n FROM customer")
def f_to_text(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        text.to_text("c_custkey").alias("k"), text.to_text("c_nationkey").alias("n")
    )


@query("f8_first_word", "SELECT p_partkey, string_split(p_name, ' ')[1] AS word FROM part")
def f_first_word(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.first_word(F.concat(F.lit(" \t"), "p_name")).alias("word")
    )


@query("f9_safe_name", "SELECT regexp_replace(c_name, '[^0-9A-Za-z]', '_', 'g') AS name FROM customer")
def f_safe_name(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(text.safe_name("c_name").alias("name"))


@query(
    "f10_pairs_to_map",
    """SELECT c_custkey, 'a' AS name, concat(c_nationkey, '=x') AS value FROM customer
    UNION ALL SELECT c_custkey, 'b', c_name FROM customer""",
)
def f_pairs_to_map(spark, sf_dir):
    pairs = F.concat(
        F.lit("a=1 b="), "c_name", F.lit(" junk  a="), "c_nationkey", F.lit("=x")
    )
    maps = table(spark, sf_dir, "customer").select("c_custkey", text.pairs_to_map(pairs).alias("m"))
    return maps.select("c_custkey", F.explode("m").alias("name", "value"))


@query(
    "f11_map_to_pairs",
    """SELECT c_custkey, concat(CASE WHEN c_custkey % 2 = 0 THEN 'x=0 ' ELSE '' END, 'name=', c_name,
        ' nation=', c_nationkey) AS pairs FROM customer""",
)
def f_map_to_pairs(spark, sf_dir):
    made = F.create_map(F.lit("name"), F.col("c_name"), F.lit("nation"), F.col("c_nationkey").cast("string"))
    before = F.when(F.col("c_custkey") % 2 == 0, "x=0").otherwise(" ")
    return table(spark, sf_dir, "customer").select("c_custkey", text.map_to_pairs(made, before).alias("pairs"))


@query("f12_newlines", "SELECT doc_id, text FROM documents")
def f_newlines(spark, sf_dir):
    windows = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_newlines(windows).alias("text"))


@query(
    "f13_blank_lines",
    rf"""SELECT doc_id, CAST(sum(CASE WHEN regexp_full_match(line, '\s*') THEN 1 ELSE 0 END) AS BIGINT) AS n_blank
    FROM {LINES_SQL} GROUP BY doc_id""",
)
def f_blank_lines(spark, sf_dir):
    return doc_lines(spark, sf_dir).groupBy("doc_id").agg(F.count_if(text.is_blank("line")).alias("n_blank"))


# ---------------------------------------------------------------- job tables

_REQUESTS = """SELECT event_id AS request_id,
    CASE WHEN event_id % 11 = 0 THEN ' ' WHEN event_id % 11 = 1 THEN concat('a\t', event_type) ELSE event_type END AS name,
    CASE user_id % 3 WHEN 0 THEN 'python3' WHEN 1 THEN 'javascript' ELSE 'cobol' END AS language,
    CASE WHEN event_id % 19 = 0 THEN '' ELSE concat('/in/', user_id) END AS input,
    CASE WHEN event_id % 7 = 0 THEN '  ' ELSE 'm' END AS mapper,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'r' END AS reducer,
    CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 3 END AS map_tasks,
    CASE WHEN event_id % 17 = 0 THEN -1 ELSE 2 END AS reduce_tasks
FROM events"""


@query(
    "j1_validate_requests",
    f"""SELECT request_id, CASE WHEN trim(name) = '' THEN 'job' ELSE name END AS name,
        CASE WHEN trim(mapper) = '' THEN 'Mapper was not specified.'
            WHEN reducer IS NULL THEN 'Reducer was not specified.'
            WHEN map_tasks < 1 THEN 'Jobs must have at least one map task.'
            WHEN reduce_tasks < 1 THEN 'Jobs must have at least one reduce task.'
            WHEN instr(name, chr(9)) > 0 THEN 'Job name can only contain printing characters and spaces.'
            WHEN input = '' THEN 'No input was specified.'
            WHEN language = 'cobol' THEN 'Specified source code language is not recognized.' END AS error,
        CASE WHEN trim(mapper) = '' THEN mapper WHEN reducer IS NULL THEN NULL
            WHEN map_tasks < 1 THEN CAST(map_tasks AS VARCHAR)
            WHEN reduce_tasks < 1 THEN CAST(reduce_tasks AS VARCHAR)
            WHEN instr(name, chr(9)) > 0 THEN name WHEN input = '' THEN input
            WHEN language = 'cobol' THEN language END AS bad_value
    FROM ({_REQUESTS})""",
)
def validate_requests(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("request_events")
    requests = spark.sql(_REQUESTS.replace("FROM events", "FROM request_events"))
    checked = jobs.validate_requests(requests, ["python3", "javascript"])
    return checked.select("request_id", "name", "error", "bad_value")


@query(
    "j2_jobs_since",
    "SELECT count(*) AS jobs FROM events WHERE CAST(user_id AS VARCHAR) LIKE '1%' AND ts >= TIMESTAMP '2024-01-15 12:00:00'",
)
def jobs_since(spark, sf_dir):
    return jobs.jobs_since(table(spark, sf_dir, "events"), "1%", "2024-01-15 12:00:00", user="user_id")


ADMISSION_SQL = """WITH RECURSIVE asked AS (
        SELECT event_id, user_id, epoch_us(ts) AS t,
            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    walk AS (
        SELECT user_id, rn, event_id, true AS accepted, [t] AS live FROM asked WHERE rn = 1
        UNION ALL
        SELECT user_id, rn, event_id, len(kept) < 2 AS accepted,
            CASE WHEN len(kept) < 2 THEN list_append(kept, t) ELSE kept END AS live
        FROM (SELECT a.user_id, a.rn, a.event_id, a.t,
                list_filter(w.live, lambda x: x >= a.t - 86400000000) AS kept
            FROM walk w JOIN asked a ON a.user_id = w.user_id AND a.rn = w.rn + 1))
    SELECT event_id, accepted FROM walk"""


@query("j3_admit", ADMISSION_SQL)
def admit(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    decided = admission.admit(events, "user_id", "ts", attempts=2, minutes=1440, order_by=["event_id"])
    return decided.select("event_id", "accepted")


HOT_USER_SQL = ADMISSION_SQL.replace("SELECT event_id, user_id, epoch_us(ts)",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS user_id, epoch_us(ts)").replace(
    "PARTITION BY user_id ORDER BY ts", "PARTITION BY CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END ORDER BY ts")


@query("j3_hot_user", HOT_USER_SQL)
def admit_hot_user(spark, sf_dir):
    """A third of the rows are of one user who is over the quota without a pause, in many ranges."""
    user = F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")).alias("user_id")
    events = table(spark, sf_dir, "events").select("event_id", user, "ts")
    decided = admission.admit(
        events, "user_id", "ts", attempts=2, minutes=1440, order_by=["event_id"], partitions=24
    )
    return decided.select("event_id", "accepted")


@query(
    "j4_derive_state",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'RUNNING' WHEN event_id % 7 = 0 THEN 'KILLED'
        WHEN user_id % 2 = 0 AND event_id % 3 = 0 THEN 'SUCCESSFUL' ELSE 'FAILED' END AS state FROM events""",
)
def derive_state(spark, sf_dir):
    phases = table(spark, sf_dir, "events").selectExpr(
        "event_id", "event_id % 5 <> 0 AS done", "event_id % 7 = 0 AS cancelled",
        "CAST(user_id % 2 AS INT) AS map_code",
        "CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS reduce_code",
    )
    return jobs.derive_state(phases).select("event_id", "state")


_TASK_EVENTS = """SELECT user_id AS job_id, event_id AS seq,
    CASE WHEN event_id % 2 = 0 THEN 'map' ELSE 'reduce' END AS phase,
    CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
    CASE WHEN event_id % 3 = 0 OR user_id % 10 = 0 THEN '  ' WHEN event_id % 3 = 2 THEN concat(props, event_id) END AS log
FROM events"""


@query(
    "j5_failure_digest",
    f"""SELECT job_id, phase, CASE WHEN count(*) FILTER (WHERE status <> 'SUCCEEDED') > 0 THEN
        coalesce(arg_min(log, seq) FILTER (WHERE status <> 'SUCCEEDED' AND trim(log) <> ''), '') END AS errors
    FROM ({_TASK_EVENTS}) GROUP BY job_id, phase""",
)
def failure_digest(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("digest_events")
    return jobs.failure_digest(spark.sql(_TASK_EVENTS.replace("FROM events", "FROM digest_events")))


@query(
    "j6_phase_progress",
    """SELECT l_orderkey AS job_id, CASE WHEN l_linestatus = 'O' THEN 'map' ELSE 'reduce' END AS phase,
        count(*) AS total_tasks, round(avg(l_discount * 10) * 100, 4) AS progress FROM lineitem GROUP BY 1, 2""",
)
def phase_progress(spark, sf_dir):
    tasks = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        F.when(F.col("l_linestatus") == "O", "map").otherwise("reduce").alias("phase"),
        (F.col("l_discount") * 10).alias("progress"),
    )
    return jobs.phase_progress(tasks).withColumn("progress", F.round("progress", 4))


_JOB_PHASES = """SELECT user_id AS job_id, user_id % 5 <> 0 AS done, user_id % 7 = 0 AS cancelled,
    CAST(user_id % 2 AS INT) AS map_code, CASE user_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS reduce_code
FROM (SELECT DISTINCT user_id FROM events)"""
_JOB_TASKS = """SELECT user_id AS job_id, CASE WHEN event_id % 4 < 2 THEN 'map' ELSE 'reduce' END AS phase,
    CAST(event_id % 5 AS DOUBLE) / 4 AS progress FROM events WHERE event_id % 3 = 0"""


@query(
    "j9_job_status",
    f"""WITH digest AS (SELECT job_id, phase, CASE WHEN count(*) FILTER (WHERE status <> 'SUCCEEDED') > 0 THEN
            coalesce(arg_min(log, seq) FILTER (WHERE status <> 'SUCCEEDED' AND trim(log) <> ''), '') END AS errors
        FROM ({_TASK_EVENTS}) GROUP BY job_id, phase),
    run AS (SELECT job_id, phase, count(*) AS n, avg(progress) * 100 AS progress FROM ({_JOB_TASKS}) GROUP BY 1, 2)
    SELECT p.job_id, CASE WHEN NOT done THEN 'RUNNING' WHEN cancelled THEN 'KILLED'
            WHEN map_code = 0 AND coalesce(reduce_code, -1) = 0 THEN 'SUCCESSFUL' ELSE 'FAILED' END AS state,
        map_code, mr.n AS map_tasks, round(mr.progress, 6) AS map_progress, md.errors AS map_errors,
        reduce_code, rr.n AS reduce_tasks, round(rr.progress, 6) AS reduce_progress, rd.errors AS reduce_errors
    FROM ({_JOB_PHASES}) p
    LEFT JOIN digest md ON md.job_id = p.job_id AND md.phase = 'map'
    LEFT JOIN digest rd ON rd.job_id = p.job_id AND rd.phase = 'reduce'
    LEFT JOIN run mr ON mr.job_id = p.job_id AND mr.phase = 'map'
    LEFT JOIN run rr ON rr.job_id = p.job_id AND rr.phase = 'reduce'""",
)
def job_status(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("status_events")
    phases, task_events, tasks = (
        spark.sql(q.replace("FROM events", "FROM status_events")) for q in (_JOB_PHASES, _TASK_EVENTS, _JOB_TASKS)
    )
    return jobs.job_status(phases, task_events, tasks).select(
        "job_id", "state",
        *[F.col(f"{p}.code").alias(f"{p}_code") for p in ("map", "reduce")],
        *[F.col(f"{p}.total_tasks").alias(f"{p}_tasks") for p in ("map", "reduce")],
        *[F.round(f"{p}.progress", 6).alias(f"{p}_progress") for p in ("map", "reduce")],
        *[F.col(f"{p}.errors").alias(f"{p}_errors") for p in ("map", "reduce")],
    )


@query(
    "j7_snapshot",
    """SELECT user_id AS id, arg_max(props, event_id) FILTER (WHERE event_type = 'error') AS name,
        arg_max(props, event_id) FILTER (WHERE event_type = 'click') AS input,
        arg_max(props, event_id) FILTER (WHERE event_type = 'view' AND event_id % 2 = 0) AS native_id,
        coalesce(bool_or(event_type = 'signup'), false) AS submitted,
        coalesce(bool_or(event_type = 'purchase' AND event_id % 4 = 0), false) AS completed
    FROM events GROUP BY user_id""",
)
def snapshot(spark, sf_dir):
    log = table(spark, sf_dir, "events").selectExpr(
        "user_id AS id", "event_id AS seq",
        """CASE event_type WHEN 'error' THEN 'name' WHEN 'click' THEN 'input' WHEN 'view' THEN 'native_id'
            WHEN 'signup' THEN 'submitted' ELSE 'completed' END AS field""",
        """CASE event_type WHEN 'signup' THEN 'true' WHEN 'view' THEN IF(event_id % 2 = 0, props, NULL)
            WHEN 'purchase' THEN IF(event_id % 4 = 0, 'true', 'false') ELSE props END AS value""",
    )
    return jobs.submission_snapshot(log).select("id", "name", "input", "native_id", "submitted", "completed")


@query(
    "j8_find_many",
    """WITH wanted AS (SELECT DISTINCT user_id * 100 + event_id % 7 AS id FROM events)
    SELECT 'found' AS outcome, o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT id FROM wanted)
    UNION ALL SELECT 'missing', id FROM wanted WHERE id NOT IN (SELECT o_orderkey FROM orders)""",
)
def find_many(spark, sf_dir):
    wanted = table(spark, sf_dir, "events").select(F.col("user_id") * 100 + F.col("event_id") % 7)
    found, missing = jobs.find_many(table(spark, sf_dir, "orders"), wanted, "o_orderkey")
    return found.select(F.lit("found").alias("outcome"), F.col("o_orderkey").alias("id")).unionAll(
        missing.select(F.lit("missing").alias("outcome"), F.col("o_orderkey").alias("id"))
    )


# ---------------------------------------------------------------- streaming


ARRIVING_ROWS = 8_000_000  # of a file of a stretch of days


def event_files(spark, sf_dir, shuffled: bool) -> str:
    """The events as a folder of files that follow each other, in order of time or far from it.

    A last file holds one row of a user of its own, later than all others, which closes the stream.
    """
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")
    )
    out = scratch_path(spark, "arriving")
    if shuffled:
        # a file has rows of two neighbouring stretches of five days, so half of them come late
        first = events.agg(F.min(F.unix_date(F.to_date("ts")))).first()[0]
        part = F.floor((F.unix_date(F.to_date("ts")) - first) / 5) + F.pmod(F.xxhash64("event_id"), F.lit(2))
        # the table is cut once; files are written in order, as many as their rows need and not as tasks read them
        made = scratch_path(spark, "stretches")
        events.withColumn("part", part).write.partitionBy("part").parquet(made)
        cut = spark.read.schema(events.schema.add("part", "long")).parquet(made)
        for k, n in sorted(map(tuple, cut.groupBy("part").count().collect()), key=lambda row: row[0] or 0):
            stretch = cut.filter(F.col("part").eqNullSafe(k)).drop("part").coalesce(-(-n // ARRIVING_ROWS))
            stretch.write.parquet(f"{out}/{0 if k is None else k + 10}")
    else:
        events.write.parquet(f"{out}/0")
    end = events.agg((F.max("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts"))
    end.select(F.lit(-1).cast("bigint").alias("event_id"), F.lit(-1).cast(events.schema["user_id"].dataType).alias("user_id"), "ts").write.parquet(f"{out}/99")
    return out


def event_stream(spark, folder: str, one_by_one: bool):
    source = spark.readStream.schema("event_id long, user_id long, ts timestamp")
    if one_by_one:
        source = source.option("maxFilesPerTrigger", 1)
    return source.parquet(f"{folder}/*")


def _admit_from_stream(spark, folder: str, one_by_one: bool, lateness: str):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    decided = admit_stream(
        event_stream(spark, folder, one_by_one), "user_id", "ts", attempts=2, minutes=1440, order_by=["event_id"],
        lateness=lateness,
    )
    out = scratch_path(spark, "t1")
    stream = (
        decided.select("event_id", "accepted").writeStream.format("parquet")
        .option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
        .outputMode("append").trigger(availableNow=True).start()
    )
    stream.awaitTermination()
    return spark.read.parquet(f"{out}/rows").filter("event_id >= 0")


def _admit_in_batches(spark, folder: str, one_by_one: bool, lateness: str):
    out = scratch_path(spark, "t1-batches")
    rule = dict(user="user_id", ts="ts", attempts=2, minutes=1440, order_by=["event_id"])
    stream = event_stream(spark, folder, one_by_one).filter("event_id >= 0")
    writer = admit_batches(stream, out, **rule, lateness=lateness)
    writer.option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()
    finish_batches(spark, out, **rule)
    return spark.read.parquet(f"{out}/rows").select("event_id", "accepted")


@query("t1_admit_stream", ADMISSION_SQL)
def admit_from_stream(spark, sf_dir):
    return _admit_from_stream(spark, event_files(spark, sf_dir, False), False, "1 hour")


@query("t1_admit_batches", ADMISSION_SQL)
def admit_in_batches(spark, sf_dir):
    return _admit_in_batches(spark, event_files(spark, sf_dir, False), False, "1 hour")


@query("t1_stream_many_files", ADMISSION_SQL)
def admit_many_files_from_stream(spark, sf_dir):
    return _admit_from_stream(spark, event_files(spark, sf_dir, True), True, "11 days")


@query("t1_batches_many_files", ADMISSION_SQL)
def admit_many_files_in_batches(spark, sf_dir):
    return _admit_in_batches(spark, event_files(spark, sf_dir, True), True, "11 days")
