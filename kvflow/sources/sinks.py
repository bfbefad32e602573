"""Writing records and datasets as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvflow.functions.records import emit
from kvflow.functions.text import normalize_newlines
from kvflow.sources.paths import reserved_path


def write_kv(kv: DataFrame, path: str, sep: str = "\t") -> None:
    """One line per pair and one part file per partition; an existing path is an error."""
    kv.select(emit("key", "value", sep).alias("value")).filter("value IS NOT NULL").write.text(
        path, lineSep="\n"
    )


def store_dataset(
    df: DataFrame, home: str, name: str | None = None, text: str = "text"
) -> str:
    """Write text with plain newlines below ``home/data``; returns the path relative to ``home``."""
    if name is None or not name.strip():
        name = "dataset"
    lines = df.select(normalize_newlines(F.coalesce(F.col(text), F.lit(""))).alias("value"))
    with reserved_path(df.sparkSession, f"{home.rstrip('/')}/data", name) as path:
        lines.write.text(path, lineSep="\n")
    return path[len(home.rstrip("/")) + 1:]
