import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kvflow.functions import text


def over(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    named = [c.alias(f"c{n}") for n, c in enumerate(columns)]
    rows = df.select("i", *named).orderBy("i").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in rows]


def test_kv_split(spark):
    assert over(spark, ["a b  c", " a ", ""], text.kv_split("s")) == [["a", "b", "c"], ["", "a", ""], [""]]
    got = over(spark, ["a b c  d", "a b c", "a"], text.kv_split("s", " +", 3))
    assert got == [["a", "b", "c d"], ["a", "b", "c"], ["a"]]
    assert over(spark, ["a b  c"], text.kv_split("s", " +", 1)) == [["a b c"]]
    with pytest.raises(ValueError):
        text.kv_split("s", " +", 0)


def test_split_char(spark):
    got = over(spark, ["a,b,", "", ",", "a,,b", ",,", "a"], text.split_char("s", ","))
    assert got == [["a", "b"], [], [""], ["a", "", "b"], ["", ""], ["a"]]
    assert over(spark, ["a.b"], text.split_char("s", ".")) == [["a", "b"]]


def legacy_split(s, chars):
    """Character walk: a token of one character at the very end is never looked at."""
    out, begin = [], 0
    while begin + 1 < len(s):
        ends = [i for i in range(begin, len(s)) if s[i] in chars]
        if not ends:
            out.append(s[begin:])
            break
        if ends[0] > begin:
            out.append(s[begin : ends[0]])
        begin = ends[0] + 1
    return out


def test_split_any(spark):
    values = ["a,b;;cd", "a b", "", "x", "ab", ",", "a;", ";;a"]
    assert over(spark, values, text.split_any("s", ",; ")) == [
        [t for t in re.split("[,; ]", v) if t] for v in values
    ]
    assert over(spark, values, text.split_any("s", ",; ", legacy=True)) == [legacy_split(v, ",; ") for v in values]
    assert over(spark, ["a-b]c^d[e&f"], text.split_any("s", "-]^[&")) == [list("abcdef")]
    assert over(spark, ["abc"], text.split_any("s", "")) == [[]]


@settings(max_examples=8, deadline=None)
@given(values=st.lists(st.text(alphabet="ab,; \n", max_size=7), min_size=1, max_size=40))
def test_split_any_legacy_agrees(spark, values):
    got = over(spark, values, text.split_any("s", ",; ", legacy=True))
    assert got == [legacy_split(v, ",; ") for v in values]


def test_parse_numbers(spark):
    values = ["9x", " 7", "abc", "+3", "-2.5z", "", "99999999999", "-" + "9" * 60, "1e3x", ".5", "\n\t4"]
    assert over(spark, values, text.parse_int("s")) == [9, 7, 0, 3, -2, 0, 2147483647, -2147483648, 1, 0, 4]
    assert over(spark, values, text.parse_long("s"))[6:8] == [99999999999, -(2**63)]
    assert over(spark, values, text.parse_double("s")) == [
        9.0, 7.0, 0.0, 3.0, -2.5, 0.0, 99999999999.0, -1e60, 1000.0, 0.5, 4.0
    ]
    assert over(spark, ["x"], text.parse_int("s", 5)) == [5]
    assert over(spark, ["1.25"], text.parse_float("s")) == [1.25]


def test_parse_bool(spark):
    assert over(spark, ["1", "0", " 1", "x", "00", "2"], text.parse_bool("s")) == [True, False, True, False, False, True]


def test_names_and_words(spark):
    assert over(spark, ["mapred.job-id", "é1"], text.safe_name("s")) == ["mapred_job_id", "_1"]
    assert over(spark, ["  two words", "", "one"], text.first_word("s")) == ["two", "", "one"]


def test_pairs_and_maps(spark):
    got = over(spark, ["a=1 b=2=3 junk a=9", "", "=x", "a= b"], text.pairs_to_map("s"))
    assert got == [{"a": "9", "b": "2=3"}, {}, {"": "x"}, {"a": ""}]
    there = text.map_to_pairs(text.pairs_to_map("s"))
    assert over(spark, ["a=1 b=2", ""], there) == ["a=1 b=2", ""]
    from pyspark.sql import functions as F

    after = text.map_to_pairs(text.pairs_to_map("s"), F.lit("z=0"))
    assert over(spark, ["a=1", ""], after) == ["z=0 a=1", "z=0 "]
    assert over(spark, ["a=1"], text.map_to_pairs(text.pairs_to_map("s"), F.lit("  "))) == ["a=1"]


def test_newlines_and_blanks(spark):
    assert over(spark, ["a\r\nb\rc\n"], text.normalize_newlines("s")) == ["a\nb\rc\n"]
    values = [None, "", " \t\n", "　", " ", "x", "a\n"]
    assert over(spark, values, text.is_blank("s")) == [True, True, True, True, False, False, False]


def test_numeric_order(spark):
    keys = ["10", "9x", "abc", "-2.5z", " 7", "01", "1", "+3"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = [r["k"] for r in df.orderBy(*text.numeric_order("k")).collect()]
    assert got == ["-2.5z", "+3", "abc", "01", "1", " 7", "9x", "10"]


def test_numeric_order_is_exact(spark):
    from decimal import Decimal

    keys = ["90071992547409930", "90071992547409931", "-90071992547409931", "-90071992547409930",
            "0.5", "0.51", "-0.5", "-0.51", "-10", "-9", "1." + "0" * 30 + "1", "1", "9" * 400, "-" + "9" * 400]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = [r["k"] for r in df.orderBy(*text.numeric_order("k")).collect()]
    assert got == sorted(keys, key=Decimal)
