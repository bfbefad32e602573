"""Text files as tables of records and lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvflow.functions.records import to_kv
from kvflow.session import scratch_path
from kvflow.sources.paths import open_file, qualified


def _plain(path: Column) -> Column:
    """A path without scheme and host."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def _listed(file_path: Column) -> Column:
    """A row's file path, which has percent escapes, as listings show it."""
    return F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))


def _bare(path: str) -> str:
    return re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path)


def _is_input(spark: SparkSession, path: Column, root: str | list[str]) -> Column:
    """A file named itself, or a visible file directly inside a folder named as ``root``.

    Patterns name their files themselves.
    """
    roots = [root] if isinstance(root, str) else root
    if any(c in name for name in roots for c in "*?[{"):
        return F.lit(True)
    named = [_bare(qualified(spark, name)) for name in roots]
    bare = _plain(path)
    visible = ~F.substring_index(bare, "/", -1).rlike("^[._]")
    return bare.isin(named) | (F.regexp_replace(bare, "/[^/]*$", "").isin(named) & visible)


def _all_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime")


def list_inputs(spark: SparkSession, path: str | list[str], times: bool = False) -> DataFrame:
    """``(path, length)`` of the input files at ``path``, and ``modificationTime``; no content is read."""
    files = _all_files(spark, path).filter(_is_input(spark, F.col("path"), path))
    return files if times else files.drop("modificationTime")


def _planned(spark: SparkSession, path: str | list[str], tasks: int) -> SparkSession:
    """A session that cuts the files at ``path`` in about so many splits of even size.

    A scan is cut by the settings of the session that reads it, so the caller's own stay as they are.
    """
    total = list_inputs(spark, path).agg(F.sum("length").alias("n")).first()["n"] or 0
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.files.maxPartitionBytes", max(-(-total // tasks), 1))
    # without a charge for opening files, splits of the wanted size are one task each, small files fill up to it
    own.conf.set("spark.sql.files.openCostInBytes", 0)
    own.conf.set("spark.sql.files.minPartitionNum", 1)
    return own


def read_lines(
    spark: SparkSession, path: str | list[str], line_sep: str | None = None, tasks: int | None = None
) -> DataFrame:
    """One row per line: ``value`` and the file's metadata.

    ``tasks`` is how many tasks the files are to be read by, without moving any text afterwards. A small
    file is not cut in more parts than that needs, and a compressed one not at all.
    """
    if tasks is not None:
        if tasks < 1:
            raise ValueError("files are read by one task at least")
        lines = read_lines(_planned(spark, path, tasks), path, line_sep)
        # nothing is added, but the table is the caller's session's; the scan keeps the settings it has
        none = spark.range(1).limit(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in lines.schema))
        return none.unionAll(lines)
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    # a folder of nothing but inputs needs no look at each row's path
    mixed = not _all_files(spark, path).filter(~_is_input(spark, F.col("path"), path)).isEmpty()
    if not mixed:
        return reader.text(path).select("value", "_metadata")
    lines = reader.option("recursiveFileLookup", "true").text(path).select("value", "_metadata")
    return lines.filter(_is_input(spark, _listed(F.col("_metadata.file_path")), path))


def read_kv(
    spark: SparkSession,
    path: str | list[str],
    sep: str = "\t",
    dialect: str = "standard",
    num_key_fields: int = 1,
    tasks: int | None = None,
) -> DataFrame:
    """Text files as ``(key, value)`` records, one per line; ``tasks`` as in ``read_lines``."""
    return to_kv(read_lines(spark, path, tasks=tasks).select("value"), "value", sep, num_key_fields, dialect)


def _count_in_split(batches):
    """Add line number and byte offset since the start of the row's file split."""
    split, lines, total = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column("n_bytes").to_numpy(zero_copy_only=False)
        files = batch.column("file").dictionary_encode()
        code = files.indices.to_numpy(zero_copy_only=False)
        block = batch.column("block").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0)) + 1
        number = np.empty(batch.num_rows, dtype=np.int64)
        offset = np.empty(batch.num_rows, dtype=np.int64)
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            here = (files.dictionary[code[lo]].as_py(), int(block[lo]))
            if here != split:
                split, lines, total = here, 0, 0
            number[lo:hi] = lines + np.arange(hi - lo)
            ends = total + np.cumsum(size[lo:hi])
            offset[lo:hi] = ends - size[lo:hi]
            lines, total = lines + int(hi - lo), int(ends[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(number), pa.array(offset)],
            names=[*batch.schema.names, "split_line", "split_offset"],
        )


def _lines_with_place(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their file and split; bytes count the newline that ended them."""
    return read_lines(spark, path, line_sep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"),
        (F.octet_length("value") + 1).cast("bigint").alias("n_bytes"),
    )


def concat_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, line_no, line, byte_offset)`` over the files at ``path`` one after the other.

    Files follow each other by name. Each split counts its own lines as they are read; only the
    splits' totals, one row each, are added up and joined back, so the text is never shuffled.
    """
    lines = _lines_with_place(spark, path)
    placed = lines.mapInArrow(
        _count_in_split,
        "file string, block bigint, line string, n_bytes bigint, split_line bigint, split_offset bigint",
    )
    # from here on one row per split, some hundred bytes for every 128 MB of text
    splits = lines.groupBy("file", "block").agg(
        F.count("*").alias("n"), F.sum("n_bytes").alias("bytes")
    )
    lengths = list_inputs(spark, path).select(_plain(F.col("path")).alias("_name"), "path", "length")
    splits = splits.withColumn("_name", _plain(_listed(F.col("file")))).join(lengths, "_name")
    in_file = Window.partitionBy("path").orderBy("block")
    overall = Window.orderBy("path", "block")
    # a file's length counts once, at its first split; files that were not read do not count
    splits = splits.withColumn(
        "new_length", F.when(F.row_number().over(in_file) == 1, F.col("length")).otherwise(0)
    )

    def before(name, window):
        return F.coalesce(F.sum(name).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    through = overall.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    file_start = F.sum("new_length").over(through) - F.col("length")
    starts = splits.select(
        "file", "block", "path",
        before("n", overall).alias("first_line"),
        (file_start + before("bytes", in_file)).alias("first_offset"),
    )
    # written, so that Spark knows their size when it chooses the join
    stored = scratch_path(spark, "split-starts")
    starts.write.parquet(stored)
    starts = spark.read.schema(starts.schema).parquet(stored)
    # both scans must have been cut at the same places; a missing start would mean they were not
    joined = placed.join(starts, ["file", "block"], "left")
    first = F.coalesce(
        F.col("first_offset"), F.raise_error(F.lit("file splits changed between scans")).cast("bigint")
    )
    return joined.select(
        F.col("path").alias("file"),
        (F.col("first_line") + F.col("split_line")).alias("line_no"),
        "line",
        (first + F.col("split_offset")).alias("byte_offset"),
    )


_STEP = 1 << 20  # bytes asked for at a time
#: Bytes of a line that a reader of pages holds by default.
MAX_LINE = 64 << 20


class LineTooLong(ValueError):
    """A line has more bytes than its reader holds."""


def lines_in_range(
    spark: SparkSession, path: str, begin: int, stop: int, end: int, max_line: int = MAX_LINE, cut: bool = False
) -> Iterator[tuple[int, str]]:
    """``(offset, line)`` of the lines of one file that begin in ``begin`` to ``stop``.

    The file is sought, and read in blocks from just before ``begin`` up to the end of the last line, or up
    to ``end`` if that comes first; a line that is cut there keeps its whole characters. Of the line in
    the making at most ``max_line`` bytes are held: a longer one is an error, or with ``cut`` it comes
    in parts of up to so many bytes, each with its own offset, that end between characters.
    """
    if max_line < 4:
        raise ValueError("a line is held with a character at least")
    stream, read = open_file(spark, path)
    try:
        at = max(begin - 1, 0)
        skipping = begin > 0  # up to the end of the line before
        held = bytearray()  # of the line that begins at ``start``
        start, inside = begin, False
        while at < end and (inside or start < stop):
            block = read(at, min(_STEP, end - at))
            if not block:
                break
            place = 0
            while place < len(block):
                newline = block.find(b"\n", place)
                to = newline if newline >= 0 else len(block)
                if skipping:
                    if at + to >= stop:
                        return  # all of the range belongs to a line that begins before it
                elif not inside and start >= stop:
                    return
                else:
                    inside = True
                    while len(held) + to - place > max_line:
                        if not cut:
                            raise LineTooLong(f"the line at byte {start} of {path} has more than {max_line} bytes")
                        room = max_line - len(held)
                        held += block[place : place + room]
                        whole = _whole_characters(bytes(held))
                        yield start, whole.decode("utf-8", "replace")
                        start, place = start + len(whole), place + room
                        held = held[len(whole):]
                    held += memoryview(block)[place:to]
                if newline < 0:
                    break
                if not skipping:
                    yield start, held.decode("utf-8", "replace")
                    held = bytearray()
                skipping, inside, start, place = False, False, at + newline + 1, newline + 1
            at += len(block)
        if held:
            yield start, _whole_characters(bytes(held)).decode("utf-8", "replace")
    finally:
        stream.close()


def _whole_characters(raw: bytes) -> bytes:
    """Without a last character of which bytes are missing."""
    for back in range(1, min(4, len(raw) + 1)):
        lead = raw[-back]
        if lead >= 0xC0:
            size = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return raw[:-back] if size > back else raw
        if lead < 0x80:
            return raw
    return raw


def _canonical(path: Column, home: Column) -> Column:
    """Scheme, host and steps of a path; what it leaves out is taken from ``home``."""
    form = "^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/]*)?(.*)$"

    def part(col, i):
        return F.regexp_extract(col, "(?s)" + form, i)

    scheme, host, rest = (part(path, i) for i in (1, 2, 3))
    at_home = scheme == ""
    scheme = F.lower(F.when(at_home, part(home, 1)).otherwise(scheme))
    host = F.lower(F.when(at_home & (host == ""), part(home, 2)).otherwise(host))
    # no host and an empty one are the same
    host = F.when(host == "", F.lit("//")).otherwise(host)
    rest = F.when(at_home & ~rest.startswith("/"), F.concat(part(home, 3), F.lit("/"), rest)).otherwise(rest)
    return F.concat(scheme, F.lit(":"), host, _without_dots(rest))


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` steps taken."""
    def step(done, part):
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return (
            F.when(part.isin("", "."), done)
            .when(part == "..", up)
            .otherwise(F.concat(done, F.array(part)))
        )

    parts = F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def check_inputs(
    paths: DataFrame,
    home: str,
    listing: DataFrame,
    path: str = "path",
    allow_local: bool = False,
    contain: bool = False,
    default_scheme: str = "hdfs",
) -> DataFrame:
    """Add ``resolved`` and ``verdict`` to requested paths.

    Relative paths start at ``home``; paths without a scheme are on the file system of ``home``, or
    of ``default_scheme`` if that names none. ``resolved`` and the paths of ``listing`` are compared
    in one form: scheme, host, and no dot steps. The verdict is the first of ``local_denied``,
    ``not_found`` (absent from ``listing.path``), ``outside_home`` and ``ok``.
    """
    home = home.rstrip("/") or "/"
    if not re.match("[A-Za-z][A-Za-z0-9+.-]*:", home):
        home = f"{default_scheme}:{home}"
    base = F.lit(home)
    out = paths.withColumn("resolved", _canonical(F.col(path), base))
    root = F.rtrim(_canonical(base, base), F.lit("/"))
    inside = (F.col("resolved") == root) | F.col("resolved").startswith(F.concat(root, F.lit("/")))
    local = F.col("resolved").startswith("file:")
    present = listing.select(_canonical(F.col("path"), base).alias("resolved")).distinct()
    joined = out.join(present.withColumn("_there", F.lit(True)), "resolved", "left")
    verdict = (
        F.when(local & F.lit(not allow_local), "local_denied")
        .when(F.col("_there").isNull(), "not_found")
        .when(F.lit(contain) & ~inside, "outside_home")
        .otherwise("ok")
    )
    return joined.select(*paths.columns, "resolved", verdict.alias("verdict"))
