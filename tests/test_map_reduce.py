import random
from collections import Counter
from itertools import islice

import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from kvflow.functions.records import make_kv
from kvflow.operators import external, hot_keys, logs, mapping, reduce
from kvflow.operators.shuffle import shuffle
from kvflow.plans.job import JobFailed, Native, preview_job, run_job
from kvflow.sources import files
from tests.conftest import pairs_of

TEXTS = [("1", "a b a"), ("2", ""), ("3", "b c\nd a"), ("4", "a " * 50)]


def words(key, value):
    for word in value.split():
        yield word, 1


def total(key, values):
    yield key, sum(map(int, values))


def native_words(key, value):
    found = F.filter(F.split(value, r"\s+"), lambda w: w != "")
    return F.transform(found, lambda w: make_kv(w, F.lit("1")))


EXPECTED = sorted((w, str(n)) for w, n in Counter(w for _, t in TEXTS for w in t.split()).items())


def test_map_surfaces_agree(spark, kv):
    want = sorted((w, "1") for _, t in TEXTS for w in t.split())
    assert pairs_of(mapping.map_kv(kv(TEXTS), words)) == want
    assert pairs_of(mapping.map_kv(kv(TEXTS), words, map_tasks=2)) == want
    assert pairs_of(mapping.map_expr(kv(TEXTS), native_words)) == want
    mapping.register_mapper(spark, "test_words", words)
    kv(TEXTS).createOrReplaceTempView("test_texts")
    assert pairs_of(spark.sql("SELECT m.* FROM test_texts t, LATERAL test_words(t.key, t.value) m")) == want


def test_mapper_may_emit_nothing_and_odd_text(kv):
    def odd(key, value):
        if key == "1":
            return None
        if key == "2":
            return [(None, None), (None, 3), ("x\ty", "z"), ("p", "q\nr\ts")]
        return []

    assert pairs_of(mapping.map_kv(kv(TEXTS), odd)) == sorted(
        [("", "3"), ("x", "y\tz"), ("p", "q"), ("r", "s")]
    )


def test_typed_output(kv):
    out = mapping.map_kv(kv(TEXTS), lambda k, v: [(k, len(v))], schema="id string, n bigint")
    assert sorted(tuple(r) for r in out.collect()) == [(k, len(v)) for k, v in TEXTS]


def test_reduce_surfaces_agree(spark, kv):
    mapped = mapping.map_kv(kv(TEXTS), words)
    assert pairs_of(reduce.reduce_kv(mapped, total)) == EXPECTED
    assert pairs_of(reduce.reduce_kv(mapped, total, combiner=total, reduce_tasks=3)) == EXPECTED
    assert pairs_of(reduce.reduce_kv(mapped, total, numeric=True, value_order="value")) == EXPECTED
    grouped = reduce.reduce_group(mapped, lambda k, parts: [(k, sum(int(p.astype(int).sum()) for p in parts))])
    assert pairs_of(grouped) == EXPECTED
    native = reduce.reduce_agg(mapped, value=F.count("value").cast("string"))
    assert pairs_of(native) == EXPECTED
    reduce.register_reducer(spark, "test_sum", total)
    mapped.createOrReplaceTempView("test_pairs")
    assert pairs_of(spark.sql("SELECT * FROM test_sum(TABLE(test_pairs) PARTITION BY key)")) == EXPECTED


def test_reducers_as_table_functions(spark):
    def first_and_echo(key, values):
        yield key, next(iter(values))
        if key == "all":
            for value in values:
                yield key, value

    def broken(key, values):
        raise RuntimeError("no good")

    spark.range(9000).selectExpr(
        "IF(id % 2 = 0, 'all', 'one') AS key", "format_string('%04d', id) AS value"
    ).createOrReplaceTempView("numbers")
    reduce.register_reducer(spark, "first_and_echo", first_and_echo)
    got = pairs_of(spark.sql("SELECT * FROM first_and_echo(TABLE(numbers) PARTITION BY key ORDER BY value)"))
    assert got == [("all", f"{i:04d}") for i in range(0, 9000, 2)] + [("one", "0001")]
    reduce.register_reducer(spark, "broken", broken)
    with pytest.raises(Exception, match="no good"):
        spark.sql("SELECT * FROM broken(TABLE(numbers) PARTITION BY key)").collect()


def test_table_functions_that_ask_for_their_rows(spark):
    """Types by registration and by call, many keys in one thread, a group that emits more than it reads."""
    def spread(key, values):
        n = sum(values)
        for i in range(n % 5000 if key == "7" else 1):
            yield key, n, i

    spark.range(3000).selectExpr("CAST(id % 50 AS STRING) AS key", "id AS value", "'x' AS more").createOrReplaceTempView("nums")
    reduce.register_reducer(spark, "spread", spread, "key string, n bigint, i int", value_order=False)
    got = spark.sql("SELECT * FROM spread(TABLE(nums))")
    assert [t for _, t in got.dtypes] == ["string", "bigint", "int"]
    want = {str(k): sum(range(k, 3000, 50)) for k in range(50)}
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted((k, n, i) for k, n in want.items() for i in range(n % 5000 if k == "7" else 1))
    other = spark.sql("SELECT * FROM spread(TABLE(nums), 'name string, total bigint, i bigint')")
    assert other.dtypes == [("name", "string"), ("total", "bigint"), ("i", "bigint")]
    assert {r["name"]: r["total"] for r in other.collect()} == want
    reduce.register_reducer(spark, "firsts", lambda k, vs: [(k, next(iter(vs)))], value_order=True)
    spark.sql("SELECT key, lpad(CAST(-value + 9999 AS STRING), 6, '0') AS value FROM nums").createOrReplaceTempView("texts")
    got = dict(pairs_of(spark.sql("SELECT * FROM firsts(TABLE(texts))")))
    assert got == {str(k): f"{9999 - max(range(k, 3000, 50)):06d}" for k in range(50)}
    with pytest.raises(Exception, match="columns key and value"):
        spark.sql("SELECT * FROM firsts(TABLE(SELECT 1 AS a))").collect()

    def broken(key, values):
        raise RuntimeError("no good")

    reduce.register_reducer(spark, "broken_too", broken, value_order=False)
    with pytest.raises(Exception, match="no good"):
        spark.sql("SELECT * FROM broken_too(TABLE(nums))").collect()


def test_hot_keys(spark, kv):
    rng = random.Random(4)
    keys = rng.choices(["a", "b", "c"] + [f"k{i}" for i in range(400)], [100, 60, 30] + [0.5] * 400, k=6000)
    pairs = kv([(k, "1") for k in keys], 5)
    share, counts = 1 / 16, Counter(keys)
    found = hot_keys.hot_keys(pairs, share)
    assert found[:2] == ["a", "b"] and {k for k, n in counts.items() if n >= share * len(keys)} <= set(found)
    assert all(counts[k] >= share * len(keys) / 2 for k in found)
    moved = shuffle(pairs, 12, hot_share=share).withColumn("part", F.spark_partition_id()).collect()
    parts, there = {}, {}
    for r in moved:
        parts.setdefault(r["key"], set()).add(r["part"])
        there.setdefault(r["part"], set()).add(r["key"])
    assert len(moved) == 6000 and all(len(p) == 1 for p in parts.values())
    assert all(there[min(parts[k])] == {k} for k in found)
    # more hot keys than partitions: the foremost ones have their own, the rest have one
    few = shuffle(pairs, 2, hot_share=share).withColumn("part", F.spark_partition_id())
    assert {r["part"] for r in few.filter("key = 'a'").collect()}.isdisjoint({r["part"] for r in few.filter("key <> 'a'").collect()})
    for df in (pairs.limit(0), kv([(None, "1")] * 9 + [("x", "2")], 2)):
        assert sorted(map(tuple, shuffle(df, 3, hot_share=0.5).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    out = reduce.reduce_kv(pairs, total, reduce_tasks=6, hot_share=share)
    assert pairs_of(out) == sorted((k, str(n)) for k, n in counts.items())
    out = external.pipe_reduce(pairs, ["awk", "-F", "\t", "{ n[$1]++ } END { for (k in n) print k \"\t\" n[k] }"], 6, hot_share=share)
    assert pairs_of(out) == sorted((k, str(n)) for k, n in counts.items())
    with pytest.raises(ValueError):
        hot_keys.hot_keys(pairs, 0)


@pytest.mark.parametrize("size", [1, 3, 20])
def test_sketches_never_miss_much(size):
    rng, sketch, seen = random.Random(size), hot_keys.Sketch(size), Counter()
    for _ in range(60):
        batch = [rng.choice("abcdefgh") if rng.random() < 0.6 else f"x{rng.randrange(500)}" for _ in range(rng.randrange(1, 90))]
        sketch.add(pa.array(batch))
        seen.update(batch)
        assert len(sketch.counts) <= size and sketch.rows == sum(seen.values())
        assert all(0 <= seen[k] - sketch.counts.get(k, 0) <= sketch.rows / (size + 1) for k in seen)


def test_group_spans_batches_and_early_stop_drains(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        pairs = spark.range(1000).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 11)).alias("key"),
            F.format_string("%04d", F.col("id")).alias("value"),
        )

        def first_two(key, values):
            yield key, "|".join(islice(values, 2))

        got = dict(pairs_of(reduce.reduce_kv(pairs, first_two, value_order="value", reduce_tasks=2)))
        rows = [(r["key"], r["value"]) for r in pairs.collect()]
        want = {k: "|".join(sorted(v for q, v in rows if q == k)[:2]) for k in {k for k, _ in rows}}
        assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_results_do_not_depend_on_task_counts(spark, kv):
    for map_tasks in (1, 5):
        for reduce_tasks in (1, 6):
            out = run_job(spark, kv(TEXTS), words, total, map_tasks=map_tasks, reduce_tasks=reduce_tasks)
            assert pairs_of(out) == EXPECTED
    for bad in ({"map_tasks": 0}, {"reduce_tasks": 0}):
        with pytest.raises(ValueError):
            run_job(spark, kv(TEXTS), words, total, **bad)


def test_combiner_folds_hot_keys_in_bounded_memory():
    records = mapping.emitter("key string, value string", "\t", 1)
    n = mapping.COMBINE_ROWS * 2 + 10
    pairs = (("hot" if i % 3 == 0 else f"k{i}", "1") for i in range(n))
    out = list(mapping.combined(pairs, total, records))
    assert sum(int(v) for _, v in out) == n
    assert sum(int(v) for k, v in out if k == "hot") == -(-n // 3)
    assert sum(1 for k, _ in out if k == "hot") <= 3
    few = list(mapping.combined((("k", "1") for _ in range(n)), total, records))
    assert few == [("k", str(n))]


def test_typed_values(kv):
    pairs = kv([("a", "1.5x"), ("a", " 2"), ("b", "z")])
    out = reduce.reduce_kv(
        pairs, lambda k, vs: [(k, sum(vs))], schema="key string, value double", value_type="double"
    )
    assert pairs_of(out) == [("a", 3.5), ("b", 0.0)]
    with pytest.raises(ValueError):
        reduce.typed_values(pairs, "date")


def partitions_of(df):
    rows = df.withColumn("part", F.spark_partition_id()).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r["part"], []).append((r["key"], r["value"]))
    return parts


HOT = [("hot", f"{i:04d}") for i in range(600)] + [(f"k{i % 50:02d}", f"{i:04d}") for i in range(1200)]


def test_shuffle_keeps_keys_whole_and_sorted(kv):
    parts = partitions_of(shuffle(kv(HOT), 5, value_order="value"))
    seen = {}
    for part, rows in parts.items():
        assert rows == sorted(rows)
        for key in {k for k, _ in rows}:
            assert seen.setdefault(key, part) == part
    assert sorted(p for rows in parts.values() for p in rows) == sorted(HOT)


def test_shuffle_without_whole_keys_splits_a_hot_key(kv):
    parts = partitions_of(shuffle(kv(HOT), 6, whole_keys=False))
    assert all([k for k, _ in rows] == sorted(k for k, _ in rows) for rows in parts.values())
    assert max(len(rows) for rows in parts.values()) < len(HOT) / 3
    assert sorted(p for rows in parts.values() for p in rows) == sorted(HOT)
    assert sorted(pairs_of(reduce.reduce_kv(kv(HOT), None))) == sorted(HOT)


def test_numeric_shuffle(kv):
    keys = ["10", "9x", "abc", "-2.5z", " 7", "01", "1", "+3"]
    rows = shuffle(kv([(k, "") for k in keys]), 1, numeric=True).collect()
    assert [r["key"] for r in rows] == ["-2.5z", "+3", "abc", "01", "1", " 7", "9x", "10"]


def test_job_over_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("1\ta b a\n2\t\n")
    (source / "b.txt").write_text("3\tb c d a\n4\t" + "a " * 50 + "\n")
    (source / "_skip.txt").write_text("5\tzzz\n")
    home = f"file://{tmp_path}/home"
    for want in ("words", "words-1"):
        out = run_job(spark, str(source), words, total, combiner=total, name="words", home=home)
        assert pairs_of(out) == EXPECTED
        assert (tmp_path / "home" / "out" / want).is_dir()


def test_jobs_with_combiners(spark, kv):
    tokens = ["awk", "-F", "\t", '{ n = split($2, w, " "); for (i = 1; i <= n; i++) print w[i] "\t1" }']
    add = ["awk", "-F", "\t", 'NR > 1 && $1 != k { print k "\t" s; s = 0 } { k = $1; s += $2 } END { print k "\t" s }']
    one_line = [(k, v.replace("\n", " ")) for k, v in TEXTS]
    for mapper in (words, Native(native_words), tokens):
        for reducer, combiner in ((total, total), (add, add), (add, total), (Native(F.count), None), (total, None)):
            out = run_job(spark, kv(one_line), mapper, reducer, combiner=combiner)
            assert pairs_of(out) == EXPECTED
    with pytest.raises(ValueError):
        run_job(spark, kv(one_line), words, total, combiner=add)


def test_long_rows_make_small_batches():
    schema = pa.schema([("key", pa.string()), ("value", pa.string())])
    long = "x" * (mapping.OUT_CHARS // 4)
    sizes = [b.num_rows for b in mapping.write_rows([("k", long)] * 20 + [("k", "v")] * 50_000, schema)]
    assert sum(sizes) == 50_020 and max(sizes) <= mapping.OUT_ROWS + mapping.STEP_ROWS
    assert all(n <= 6 for n in sizes[:3])


def test_job_preview(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1\ta b a\n2\tb\n")
    assert pairs_of(run_job(spark, str(tmp_path), words, total, preview=6)) == [("a", "1"), ("b", "1")]
    with pytest.raises(JobFailed, match="no output"):
        run_job(spark, str(tmp_path), lambda k, v: (), total, preview=100)


def test_previews_obey_or_refuse_every_argument(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1\ta b a\n2\tb c\n")
    path = str(tmp_path)
    report = ["awk", "-F", "\t", '{ n = split($2, w, " "); for (i = 1; i <= n; i++) print w[i] "\t" i; print "reporter:counter:g,lines,1" > "/dev/stderr" }']
    result, counters = run_job(spark, path, report, total, preview=100, counters=True)
    assert pairs_of(result) == [("a", "4"), ("b", "3"), ("c", "2")]
    totals = {(r["group"], r["counter"]): r["total"] for r in counters.totals().collect()}
    assert totals[("g", "lines")] == 2 and totals[("records", "read")] == 2
    backwards = lambda k, vs: [(k, "".join(vs))]
    twice = lambda k, v: [(w, str(9 - i)) for i, w in enumerate(v.split())]
    assert pairs_of(run_job(spark, path, twice, backwards, preview=100)) == [("a", "79"), ("b", "89"), ("c", "8")]
    folded = []
    out = run_job(spark, path, words, total, preview=100, combiner=total, value_order="value")
    assert pairs_of(out) == [("a", "2"), ("b", "2"), ("c", "1")] and not folded
    for bad in ({"map_tasks": 3}, {"reduce_tasks": 2}, {"home": path}):
        with pytest.raises(ValueError, match="preview"):
            run_job(spark, path, words, total, preview=100, **bad)


def test_counters_without_logs(spark, kv, tmp_path):
    """Totals are right with a task that fails once; nothing but the result is written."""
    flag = tmp_path / "failed"
    program = ["sh", "-c", f"""awk '{{ print; print "reporter:counter:g,n,1" > "/dev/stderr" }}'; [ -e {flag} ] || {{ touch {flag}; exit 4; }}"""]
    pairs = kv([(str(i), "x") for i in range(100)], 3)
    result, counters = run_job(spark, pairs, program, ["cat"], counters=True, home=f"file://{tmp_path}/home", reduce_tasks=2,
                               map_options={"on_exit": "fail"}) if flag.exists() else (None, None)
    if result is None:
        # a local session does not try a task again, so the first run fails as a whole
        with pytest.raises(PythonException):
            run_job(spark, pairs, program, ["cat"], counters=True, home=f"file://{tmp_path}/home")
        result, counters = run_job(spark, pairs, program, ["cat"], counters=True, home=f"file://{tmp_path}/home", reduce_tasks=2)
    want = {("g", "n"): 100, ("records", "read"): 200, ("records", "written"): 200, ("records", "skipped"): 0}
    assert {(r["group"], r["counter"]): r["total"] for r in counters.totals().collect()} == want
    result, counters = run_job(spark, pairs, program, ["cat"], counters=True, reduce_tasks=2)
    assert counters.totals().count() == 0
    for _ in range(2):  # computed twice, counted once
        assert result.count() == 100
        assert {(r["group"], r["counter"]): r["total"] for r in counters.totals().collect()} == want


def test_reports_of_a_task_that_runs_twice_count_once():
    merge = logs._Latest().addInPlace
    one, two = {("g", "n"): 5}, {("g", "n"): 2}
    value = merge({}, {"s": (3, {0: one})})
    value = merge(value, {"s": (3, {1: two})})
    value = merge(value, {"s": (3, {0: one})})
    assert value == {"s": (3, {0: one, 1: two})}
    assert merge(value, {"s": (2, {0: two})}) == {"s": (3, {0: one, 1: two})}
    assert merge(value, {"s": (7, {0: two}), "t": (1, {0: one})}) == {"s": (7, {0: two}), "t": (1, {0: one})}


def test_map_tasks_cut_files_and_move_nothing(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{i}\ta b {i % 7}\n" for i in range(20_000)))
    for tasks in (1, 8, 13):
        job = run_job(spark, str(tmp_path), Native(native_words), Native(F.count), map_tasks=tasks)
        text = job._jdf.queryExecution().executedPlan().toString()
        assert "RoundRobin" not in text
        lines = files.read_lines(spark, str(tmp_path), tasks=tasks)
        assert lines.rdd.getNumPartitions() == tasks and lines.count() == 20_000
        assert lines.sparkSession is spark
    plain = run_job(spark, str(tmp_path), Native(native_words), Native(F.count))
    assert pairs_of(job) == pairs_of(plain)
    assert files.read_lines(spark, str(tmp_path)).rdd.getNumPartitions() < 13
    with pytest.raises(ValueError):
        files.read_lines(spark, str(tmp_path), tasks=0)


def test_native_and_program_jobs(spark, kv):
    assert pairs_of(run_job(spark, kv(TEXTS), Native(native_words), Native(F.count))) == EXPECTED
    tokens = ["awk", "-F", "\t", '{ n = split($2, w, " "); for (i = 1; i <= n; i++) print w[i] "\\t1" }']
    one_line = [(k, v.replace("\n", " ")) for k, v in TEXTS]
    assert pairs_of(run_job(spark, kv(one_line), tokens, total)) == EXPECTED
    assert pairs_of(run_job(spark, kv(TEXTS), words, None)) == sorted((w, "1") for _, t in TEXTS for w in t.split())


def test_preview(spark):
    lines = spark.createDataFrame([(i, f"{i}\tw{i % 3} w{i % 2}") for i in range(50)], "n int, line string")
    whole = preview_job(spark, lines, words, total, cap=10_000, order_by=["n"])
    full = run_job(spark, lines.selectExpr("'' AS key", "split_part(line, '\t', 2) AS value"), words, total)
    assert whole.state == "SUCCESSFUL"
    assert pairs_of(whole.reduced) == pairs_of(full)
    cut = preview_job(spark, lines, words, total, cap=11, order_by=["n"])
    assert pairs_of(cut.mapped) == [("w", "1"), ("w0", "1"), ("w0", "1")]
    assert [tuple(r)[:3] for r in cut.phases.orderBy("phase").collect()] == [("map", 0, 3), ("reduce", 0, 2)]


def test_preview_failures(spark):
    lines = spark.createDataFrame([(1, "a\tb")], "n int, line string")

    def broken(key, value):
        raise RuntimeError("no good")

    failed = preview_job(spark, lines, broken, total, cap=100, order_by=["n"])
    assert failed.state == "FAILED" and failed.mapped is None and failed.reduced is None
    assert "no good" in failed.phases.first()["errors"]
    silent = preview_job(spark, lines, lambda k, v: (), total, cap=100, order_by=["n"])
    assert silent.state == "FAILED" and silent.phases.count() == 1
    bad_reduce = preview_job(spark, lines, words, broken, cap=100, order_by=["n"])
    assert bad_reduce.state == "FAILED" and bad_reduce.mapped.count() == 1


def test_user_errors_reach_the_user(kv):
    def broken(key, value):
        raise RuntimeError("no good")

    with pytest.raises(PythonException, match="no good"):
        mapping.map_kv(kv(TEXTS), broken).collect()


def test_native_reducers_obey_order_and_tasks(spark, kv):
    pairs = [(str(i % 30), "1") for i in range(300)]
    def same(key, value):
        return F.array(make_kv(key, value))

    out = run_job(spark, kv(pairs), Native(same), Native(F.count), reduce_tasks=1, numeric=True).collect()
    assert [r["key"] for r in out] == [str(i) for i in range(30)] and {r["value"] for r in out} == {"10"}


def test_program_preview_tells_code_and_errors(spark):
    lines = spark.createDataFrame([(1, "a\tb"), (2, "c\td")], "n int, line string")
    failing = ["sh", "-c", "cat; echo oops >&2; exit 3"]
    done = preview_job(spark, lines, failing, total, cap=100, order_by=["n"])
    assert done.state == "FAILED" and done.reduced is None and pairs_of(done.mapped) == [("a", "b"), ("c", "d")]
    assert [tuple(r) for r in done.phases.collect()] == [("map", 3, 2, "oops")]
    fine = preview_job(spark, lines, failing, ["cat"], cap=100, order_by=["n"], map_options={"on_exit": "ignore"})
    assert fine.state == "SUCCESSFUL" and fine.reduced.count() == 2
    with pytest.raises(ValueError):
        run_job(spark, lines, words, total, map_options={"in_sep": ";"})


def test_typed_schema_by_type(kv):
    out = mapping.map_kv(kv([("a", "b")]), lambda k, v: [("x\ty", "z\r")], schema="KEY STRING, value string")
    assert [tuple(r) for r in out.collect()] == [("x", "y\tz")]
