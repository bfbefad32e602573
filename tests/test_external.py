import pytest
from pyspark.sql import functions as F

from kvflow.operators import external, logs
from tests.conftest import pairs_of

PAIRS = [(f"k{i % 7}", f"Value {i}") for i in range(200)]


def test_program_maps_pairs(kv):
    assert pairs_of(external.pipe_map(kv(PAIRS), "tr a-z A-Z")) == sorted((k.upper(), v.upper()) for k, v in PAIRS)
    assert pairs_of(external.pipe_map(kv(PAIRS), "cat", ignore_key=True)) == sorted((v, "") for _, v in PAIRS)
    split = external.pipe_map(kv([("a", "b:c:d")]), "cat", in_sep=":", out_sep=":", out_key_fields=2)
    assert pairs_of(split) == [("a:b", "c:d")]


def test_program_output_larger_than_pipes(kv):
    big = [(str(i), "x" * 5000) for i in range(400)]
    twice = external.pipe_map(kv(big, 2), ["awk", "{ print; print }"])
    assert twice.count() == 800


def test_program_reads_nothing_but_writes(spark):
    half = spark.range(0, 4, 1, 2).filter("id < 2").selectExpr("CAST(id AS STRING) AS key", "'v' AS value")
    shown = external.pipe_map(half, ["sh", "-c", "cat; echo done"])
    assert pairs_of(shown) == [("0", "v"), ("1", "v"), ("done", ""), ("done", "")]
    one_key = half.filter("key = '0'")
    assert pairs_of(external.pipe_reduce(one_key, ["sh", "-c", "cat; echo done"], 3)) == [("0", "v"), ("done", "")]


def test_program_reduces_sorted_keys(kv):
    count = external.python_program(
        "import sys, itertools\n"
        "for k, g in itertools.groupby(sys.stdin, key=lambda l: l.split('\\t')[0]): print(k, len(list(g)), sep='\\t')"
    )
    want = sorted((f"k{i}", str(sum(1 for k, _ in PAIRS if k == f"k{i}"))) for i in range(7))
    assert pairs_of(external.pipe_reduce(kv(PAIRS), count, reduce_tasks=3)) == want
    add = external.python_program(
        "import sys, itertools\n"
        "for k, g in itertools.groupby((l.rstrip('\\n').split('\\t') for l in sys.stdin), key=lambda p: p[0]):\n"
        "    print(k, sum(int(v) for _, v in g), sep='\\t')"
    )
    ones = kv([(k, "1") for k, _ in PAIRS])
    assert pairs_of(external.pipe_reduce(ones, add, combine_cmd=add)) == want


def test_parameters(kv):
    show = ["sh", "-c", 'cat > /dev/null; echo "$job_name|$a|$b|$TMPDIR"']
    out = external.pipe_map(kv([("x", "y")], 1), show, params={"job.name": "n 1"}, extra_env="a=1=2 junk b= c")
    key = pairs_of(out)[0][0].split("|")
    assert key[:3] == ["n 1", "1=2", ""] and key[3]


def test_exit_code(kv):
    with pytest.raises(Exception, match="exit code 3"):
        external.pipe_map(kv(PAIRS), ["sh", "-c", "cat; exit 3"]).collect()
    kept = external.pipe_map(kv(PAIRS), ["sh", "-c", "cat; exit 3"], on_exit="ignore")
    assert pairs_of(kept) == sorted(PAIRS)
    with pytest.raises(ValueError):
        external.pipe_map(kv(PAIRS), "cat", on_exit="maybe")


def test_program_that_stops_reading(kv):
    big = [(f"{i:05d}", "x" * 1000) for i in range(3000)]
    with pytest.raises(Exception, match="stopped reading after writing 5 records"):
        external.pipe_map(kv(big, 1), "head -n 5").collect()
    with pytest.raises(Exception, match="stopped reading"):
        external.pipe_map(kv(big, 1), "head -n 5", skip_after=6).collect()
    log = external.pipe_map(kv(big, 1), "head -n 5", skip_after=5, log=True)
    assert log.filter("channel = 'out'").count() == 5
    totals = {r["counter"]: r["total"] for r in logs.parse_counters(log.filter("channel = 'err'")).collect()}
    assert totals["read"] == 3000 and totals["written"] == 5 and totals["skipped"] > 0


def test_missing_program(kv):
    with pytest.raises(Exception, match="(?i)no such file"):
        external.pipe_map(kv(PAIRS), "/no/such/program").collect()


def test_reader_that_takes_little(kv):
    big = [(str(i), "x" * 1000) for i in range(5000)]
    assert external.pipe_map(kv(big, 1), "cat").limit(3).count() == 3


def test_counters_from_a_program(kv):
    report = '{ print; print "reporter:counter:g,n,2" > "/dev/stderr"; print "reporter:status: at " NR > "/dev/stderr" }'
    log = external.pipe_map(kv(PAIRS, 1), ["awk", report], log=True).filter("channel = 'err'")
    totals = {(r["group"], r["counter"]): r["total"] for r in logs.parse_counters(log).collect()}
    assert totals == {("g", "n"): 400, ("records", "read"): 200, ("records", "written"): 200, ("records", "skipped"): 0}
    assert [r["status"] for r in logs.latest_status(log).collect()] == ["at 200"]


LOG = ["reporter:counter:g,n,5", "reporter:counter: g,n,2 ", "reporter:counter:g,n,x", "reporter:counter:g,n", "hello",
       "reporter:counter:g,,1", "reporter:counter:g,n,1,,", "reporter:counter:g,n, 4", "reporter:counter:g,n,-3",
       "reporter:counter:g,n,99999999999999999999", "xreporter:counter:g,n,1", "reporter:odd"]


def test_counter_lines(spark):
    log = spark.createDataFrame([(line,) for line in LOG], "line string")
    got = {(r["group"], r["counter"]): r["total"] for r in logs.parse_counters(log).collect()}
    assert got == {("g", "n"): 5 + 2 + 1 - 3, ("g", ""): 1}
    assert logs.other_lines(log).count() == 2
    renamed = log.withColumn("line", F.replace("line", F.lit("reporter:"), F.lit("me:")))
    assert logs.parse_counters(renamed, prefix="me:").count() == 2


def test_rates_and_metrics(spark):
    df = spark.createDataFrame([(7, 2), (5, 0), (0, 3)], "n long, d long")
    assert [r[0] for r in df.select(logs.rate_text("n", "d")).collect()] == ["3=7/2", "NA", "0=0/3"]
    counters = spark.createDataFrame([("read", 10), ("written", 4), ("other", 1)], "counter string, total long")
    row = logs.job_metrics(counters, 3).first()
    assert (row["records_read"], row["records_written"], row["records_skipped"]) == (10, 4, 0)
    assert (row["read_rate"], row["write_rate"]) == ("3=10/3", "1=4/3")
    watched, seen = logs.observed(df, "rows")
    watched.collect()
    assert seen.get["records"] == 3
