"""String, number and map helpers as column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvflow.functions.records import _col


def kv_split(col: Column | str, pattern: str = " +", max_tokens: int | None = None) -> Column:
    """Split on a regex; tokens from number ``max_tokens`` on are joined with one space."""
    tokens = F.split(_col(col), pattern, -1)
    if max_tokens is None:
        return tokens
    if max_tokens < 1:
        raise ValueError("max_tokens must be at least 1")
    rest = F.array_join(F.slice(tokens, F.lit(max_tokens), F.size(tokens)), " ")
    head = F.slice(tokens, 1, max_tokens - 1) if max_tokens > 1 else F.array().cast("array<string>")
    return F.when(F.size(tokens) > max_tokens, F.concat(head, F.array(rest))).otherwise(tokens)


def split_char(col: Column | str, ch: str) -> Column:
    """Split on one character; inner empty tokens stay, one empty token at the end goes."""
    if len(ch) != 1:
        raise ValueError("split_char takes exactly one character")
    tokens = F.split(_col(col), re.escape(ch), -1)
    return F.when(
        F.element_at(tokens, -1) == "", F.slice(tokens, F.lit(1), F.size(tokens) - 1)
    ).otherwise(tokens)


def split_any(col: Column | str, chars: str, legacy: bool = False) -> Column:
    """Split on any of ``chars`` without empty tokens.

    ``legacy`` also drops a last token of one character that ends the text.
    """
    col = _col(col)
    if not chars:
        return F.when(col.isNotNull(), F.array().cast("array<string>"))
    delimiter = "[" + "".join("\\" + c if c in "\\]^-[&" else c for c in chars) + "]"
    tokens = F.filter(F.split(col, delimiter, -1), lambda token: token != "")
    if not legacy:
        return tokens
    short_end = col.rlike(f"(?s)(^|{delimiter})[^{delimiter[1:-1]}]\\z")
    return F.when(short_end, F.slice(tokens, F.lit(1), F.size(tokens) - 1)).otherwise(tokens)


def _parse_integer(col: Column | str, default: int, bits: int) -> Column:
    digits = F.regexp_extract(_col(col), r"^\s*([+-]?[0-9]+)", 1)
    low, high = -(2 ** (bits - 1)), 2 ** (bits - 1) - 1
    wide = F.coalesce(
        digits.try_cast("decimal(38,0)"),
        # too long even for 38 digits: the sign alone decides
        F.when(digits.startswith("-"), F.lit(low)).otherwise(F.lit(high)).cast("decimal(38,0)"),
    )
    held = F.greatest(F.least(wide, F.lit(high).cast("decimal(38,0)")), F.lit(low).cast("decimal(38,0)"))
    return F.when(F.coalesce(digits, F.lit("")) != "", held).otherwise(
        F.lit(default).cast("decimal(38,0)")
    )


def parse_int(col: Column | str, default: int = 0) -> Column:
    """Leading 32-bit integer of a text, held to the type's range; ``default`` without one."""
    return _parse_integer(col, default, 32).cast("int")


def parse_long(col: Column | str, default: int = 0) -> Column:
    """Leading 64-bit integer of a text, held to the type's range; ``default`` without one."""
    return _parse_integer(col, default, 64).cast("bigint")


def parse_double(col: Column | str, default: float = 0.0) -> Column:
    """Leading floating point number of a text; ``default`` without one."""
    number = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
    digits = F.regexp_extract(_col(col), number, 1)
    return F.coalesce(digits.try_cast("double"), F.lit(float(default)))


def parse_float(col: Column | str, default: float = 0.0) -> Column:
    return parse_double(col, default).cast("float")


def parse_bool(col: Column | str) -> Column:
    """False for text starting with zero or without a number, true for other numbers."""
    return parse_long(col) != 0


def to_text(col: Column | str) -> Column:
    return _col(col).cast("string")


def first_word(col: Column | str) -> Column:
    """Text up to the first whitespace, leading whitespace skipped."""
    return F.regexp_extract(_col(col), r"^\s*(\S*)", 1)


def safe_name(col: Column | str) -> Column:
    """Every character that is not an ASCII letter or digit becomes ``_``."""
    return F.regexp_replace(_col(col), "[^0-9A-Za-z]", "_")


def pairs_to_map(col: Column | str) -> Column:
    """``a=b c=d`` as a map; entries without ``=`` are skipped, the last one of a name wins."""
    entries = F.transform(
        F.filter(F.split(_col(col), " ", -1), lambda e: F.instr(e, "=") > 0),
        lambda e: F.struct(
            F.substring_index(e, "=", 1).alias("key"),
            F.substr(e, F.instr(e, "=") + 1).alias("value"),
        ),
    )
    names = F.transform(entries, lambda e: e["key"])
    last = F.filter(
        entries,
        lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"]),
    )
    return F.map_from_entries(last)


def map_to_pairs(col: Column | str, previous: Column | str | None = None) -> Column:
    """A map as ``a=b c=d``, after the ``previous`` text unless that is blank."""
    pairs = F.trim(
        F.array_join(
            F.transform(F.map_entries(_col(col)), lambda e: F.concat(e["key"], F.lit("="), e["value"])),
            " ",
        )
    )
    if previous is None:
        return pairs
    before = F.coalesce(_col(previous), F.lit(""))
    return F.when(is_blank(before), pairs).otherwise(F.concat(before, F.lit(" "), pairs))


def normalize_newlines(col: Column | str) -> Column:
    return F.replace(_col(col), F.lit("\r\n"), F.lit("\n"))


def is_blank(col: Column | str) -> Column:
    """NULL, empty, or whitespace only (non-breaking spaces count as text)."""
    col = _col(col)
    return col.isNull() | col.rlike(r"^\p{javaWhitespace}*\z")


def numeric_order(col: Column | str) -> list[Column]:
    """Sort columns that order text by its leading number, then by the text itself.

    The number is blanks, an optional ``-``, digits and an optional fraction; text without one
    counts as 0. The first column is a double, quick to compare; the second settles numbers that
    a double cannot tell apart, digit by digit.
    """
    col = _col(col)
    number = r"^[ \t]*(-?)0*([0-9]*)(?:[.]([0-9]*))?"
    sign = F.regexp_extract(col, number, 1)
    whole = F.regexp_extract(col, number, 2)
    part = F.rtrim(F.regexp_extract(col, number, 3), F.lit("0"))
    zero = (whole == "") & (part == "")
    negative = (sign == "-") & ~zero
    approx = F.coalesce(F.concat(sign, whole, F.lit("."), part).try_cast("double"), F.lit(0.0))

    # below zero the longer and the higher digits come first, so both are turned round
    def turned(digits):
        return F.translate(digits, "0123456789", "9876543210")

    exact = F.struct(
        F.when(negative, -F.length(whole)).otherwise(F.length(whole)).alias("size"),
        F.when(negative, turned(whole)).otherwise(whole).alias("whole"),
        F.when(negative, F.concat(turned(part), F.lit(":"))).otherwise(part).alias("part"),
    )
    return [F.when(zero, F.lit(0.0)).otherwise(approx), exact, col]
