"""Splitting lines into ``(key, value)`` and putting them together again."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KV_DDL = "key string, value string"
DIALECTS = ("standard", "value_only", "skip_blank", "trim_split", "trim_split_reduce")

# What a script language's trim() removes, as a Java regex class.
_TRIM_CLASS = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
# The line ends a text reader recognises.
_LINE_END = r"\r\n|\r|\n"


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def make_kv(key: Column | str, value: Column | str) -> Column:
    """A pair; missing parts become empty text."""
    def text(c):
        return F.coalesce(_col(c).cast("string"), F.lit(""))

    return F.struct(text(key).alias("key"), text(value).alias("value"))


def kv_key(pair: Column | str) -> Column:
    return _col(pair)["key"]


def kv_value(pair: Column | str) -> Column:
    return _col(pair)["value"]


def split_kv(
    line: Column | str, sep: str = "\t", num_key_fields: int = 1, dialect: str = "standard"
) -> Column:
    """``struct(key, value)`` of a line; NULL where the dialect drops the line.

    The key keeps ``num_key_fields`` fields; with fewer separators the whole line is the key.
    """
    if not sep:
        raise ValueError("the separator must not be empty")
    if num_key_fields < 1:
        raise ValueError("a key has at least one field")
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}; known: {', '.join(DIALECTS)}")
    line = F.coalesce(_col(line), F.lit(""))

    if dialect.startswith("trim_split"):
        trimmed = F.regexp_replace(line, f"^{_TRIM_CLASS}+|{_TRIM_CLASS}+$", "")
        fields = F.split(trimmed, re.escape(sep), -1)
        pair = make_kv(F.get(fields, F.lit(0)), F.get(fields, F.lit(1)))
        keep = trimmed != ""
        if dialect == "trim_split":
            keep = keep & (F.size(fields) <= 2)
        return F.when(keep, pair)

    if len(sep) == 1 or num_key_fields == 1:
        key = F.substring_index(line, sep, num_key_fields)
        found = F.length(key) < F.length(line)
        value = F.substr(line, F.length(key) + F.lit(len(sep) + 1))
    else:
        # substring_index lets long separators overlap; split does not
        parts = F.split(line, re.escape(sep), num_key_fields + 1)
        found = F.size(parts) > num_key_fields
        key = F.when(found, F.array_join(F.slice(parts, 1, num_key_fields), sep)).otherwise(line)
        value = F.get(parts, F.lit(num_key_fields))

    if dialect == "value_only":
        return make_kv(F.when(found, key).otherwise(""), F.when(found, value).otherwise(line))
    pair = make_kv(key, F.when(found, value).otherwise(""))
    if dialect == "skip_blank":
        return F.when(line != "", pair)
    return pair


def to_kv(
    df: DataFrame,
    line: Column | str = "value",
    sep: str = "\t",
    num_key_fields: int = 1,
    dialect: str = "standard",
) -> DataFrame:
    """The ``kv`` table of a table of lines, without the lines its dialect drops."""
    pairs = df.select(split_kv(line, sep, num_key_fields, dialect).alias("pair"))
    if dialect in ("skip_blank", "trim_split", "trim_split_reduce"):
        pairs = pairs.filter(F.col("pair").isNotNull())
    return pairs.select("pair.key", "pair.value")


def emit(key: Column | str, value: Column | str, sep: str = "\t") -> Column:
    """``key SEP value`` as text; NULL, meaning no record, where both are NULL."""
    key, value = _col(key), _col(value)
    pair = make_kv(key, value)
    return F.when(
        key.isNotNull() | value.isNotNull(), F.concat(pair["key"], F.lit(sep), pair["value"])
    )


def reparse(kv: DataFrame, sep: str = "\t", num_key_fields: int = 1) -> DataFrame:
    """Read emitted pairs back as text: newlines make records, separators move the key's end."""
    lines = kv.select(emit("key", "value", sep).alias("line")).filter(F.col("line").isNotNull())
    # a written record ends in a newline, with which a closing carriage return is one line end
    pieces = F.split(F.concat("line", F.lit("\n")), _LINE_END, -1)
    lines = lines.select(F.explode(F.slice(pieces, 1, F.size(pieces) - 1)).alias("line"))
    return to_kv(lines, "line", sep, num_key_fields)


def split_record(line: str, sep: str, num_key_fields: int) -> tuple[str, str]:
    """``split_kv`` for one Python string, used where a task already holds Python strings."""
    if num_key_fields == 1:
        key, _, value = line.partition(sep)
        return key, value
    parts = line.split(sep, num_key_fields)
    if len(parts) <= num_key_fields:
        return line, ""
    return sep.join(parts[:num_key_fields]), parts[num_key_fields]


def emitted_records(pairs, sep: str, num_key_fields: int):
    """The records that emitted Python pairs are read back as."""
    for key, value in pairs or ():
        if key is None and value is None:
            continue
        if type(key) is not str:
            key = "" if key is None else str(key)
        if type(value) is not str:
            value = "" if value is None else str(value)
        # a separator of several characters may begin inside the key
        split = num_key_fields > 1 or (sep in key if len(sep) == 1 else (key + sep).find(sep) != len(key))
        if split or "\n" in key or "\r" in key or "\n" in value or "\r" in value:
            for line in re.split(_LINE_END, key + sep + value + "\n")[:-1]:
                yield split_record(line, sep, num_key_fields)
        else:
            yield key, value
