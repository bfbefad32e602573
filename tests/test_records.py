import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvflow.functions import records
from kvflow.functions.records import emitted_records, split_record
from tests.conftest import pairs_of

# line -> pair per dialect; None: the line is dropped
CASES = [
    # line, standard, skip_blank, value_only, trim_split, trim_split_reduce
    ("k1\ta b", ("k1", "a b"), ("k1", "a b"), ("k1", "a b"), ("k1", "a b"), ("k1", "a b")),
    ("nokey", ("nokey", ""), ("nokey", ""), ("", "nokey"), ("nokey", ""), ("nokey", "")),
    ("\tv", ("", "v"), ("", "v"), ("", "v"), ("v", ""), ("v", "")),
    ("k\t", ("k", ""), ("k", ""), ("k", ""), ("k", ""), ("k", "")),
    ("k\tx\ty", ("k", "x\ty"), ("k", "x\ty"), ("k", "x\ty"), None, ("k", "x")),
    ("", ("", ""), None, ("", ""), None, None),
    (" k \t v ", (" k ", " v "), (" k ", " v "), (" k ", " v "), ("k ", " v"), ("k ", " v")),
    (" k　", (" k　", ""), (" k　", ""), ("", " k　"), ("k", ""), ("k", "")),
]


def split_all(spark, lines, **options):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i int, line string")
    rows = df.select("i", records.split_kv("line", **options).alias("kv")).orderBy("i").collect()
    return [None if r["kv"] is None else tuple(r["kv"]) for r in rows]


@pytest.mark.parametrize("dialect", records.DIALECTS)
def test_dialects(spark, dialect):
    column = 1 + ["standard", "skip_blank", "value_only", "trim_split", "trim_split_reduce"].index(dialect)
    got = split_all(spark, [c[0] for c in CASES], dialect=dialect)
    assert got == [c[column] for c in CASES]


@pytest.mark.parametrize("n, pair", [(1, ("A", "F#3")), (2, ("A#F", "3")), (3, ("A#F#3", "")), (5, ("A#F#3", ""))])
def test_key_fields(spark, n, pair):
    assert split_all(spark, ["A#F#3"], sep="#", num_key_fields=n) == [pair]


def test_long_separators_do_not_overlap(spark):
    assert split_all(spark, ["a###b", "a##b##c"], sep="##", num_key_fields=2) == [("a###b", ""), ("a##b", "c")]
    assert split_all(spark, ["a###b"], sep="##") == [("a", "#b")]


def test_separator_is_plain_text(spark):
    assert split_all(spark, ["a.b.c", "a|b"], sep=".", num_key_fields=2) == [("a.b", "c"), ("a|b", "")]
    assert split_all(spark, ["a||b||c"], sep="||", num_key_fields=2) == [("a||b", "c")]


def test_bad_options(spark):
    for options in ({"sep": ""}, {"num_key_fields": 0}, {"dialect": "x"}):
        with pytest.raises(ValueError):
            records.split_kv("line", **options)


def test_null_line_is_empty(spark):
    assert split_all(spark, [None]) == [("", "")]


def test_to_kv_drops_lines(spark):
    df = spark.createDataFrame([("",), ("a\tb",)], "value string")
    assert pairs_of(records.to_kv(df, dialect="skip_blank")) == [("a", "b")]


def test_emit(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    rows = df.select(records.emit("k", "v").alias("line"), records.emit(F.lit(None), F.lit(None)).alias("none"))
    assert [tuple(r) for r in rows.collect()] == [("1\ta", None), ("2\t", None)]


def test_reparse(spark):
    emitted = [("a\tb", "c"), ("a", "x\ny"), (None, None), ("k", "p\r\nq\rr"), ("e", "")]
    df = spark.createDataFrame(emitted, "key string, value string")
    expected = sorted([("a", "b\tc"), ("a", "x"), ("y", ""), ("k", "p"), ("q", ""), ("r", ""), ("e", "")])
    assert pairs_of(records.reparse(df)) == expected
    assert sorted(emitted_records(emitted, "\t", 1)) == expected


TEXT = st.text(alphabet="ab\t\n #é", max_size=8)


@settings(max_examples=10, deadline=None)
@given(lines=st.lists(TEXT, min_size=1, max_size=40), n=st.integers(1, 3), sep=st.sampled_from(["\t", "#", "ab", "  "]))
def test_split_agrees_with_python(spark, lines, n, sep):
    got = split_all(spark, lines, sep=sep, num_key_fields=n)
    assert got == [split_record(line, sep, n) for line in lines]


@settings(max_examples=10, deadline=None)
@given(lines=st.lists(TEXT.filter(lambda s: "\t" in s), min_size=1, max_size=40))
def test_split_then_emit_is_the_line(spark, lines):
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    kv = df.select("line", records.split_kv("line").alias("kv"))
    assert kv.filter(records.emit("kv.key", "kv.value") != F.col("line")).isEmpty()


def test_pair_accessors(spark):
    df = spark.range(1).select(records.make_kv(F.lit(7), F.lit(None)).alias("p"))
    assert tuple(df.select(records.kv_key("p"), records.kv_value("p")).first()) == ("7", "")


def test_closing_carriage_returns_and_long_separators(spark):
    pairs = [("k", "x\r"), ("k", "x\r\n"), ("k", "x\n"), ("xa", "v"), ("", "aa"), ("a", "aav\r\r")]
    df = spark.createDataFrame(pairs, "key string, value string")

    def plain(key, value):
        for line in re.split("\r\n|\r|\n", f"{key}aa{value}\n")[:-1]:
            head, _, tail = line.partition("aa")
            yield head, tail

    want = sorted(p for k, v in pairs for p in plain(k, v))
    assert sorted(tuple(r) for r in records.reparse(df, sep="aa").collect()) == want
    assert sorted(records.emitted_records(pairs, "aa", 1)) == want
