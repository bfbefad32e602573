"""Pages and prefixes of a table of lines, measured in bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvflow.operators.order import OrderedTotals, stored
from kvflow.operators.shuffle import has_map
from kvflow.sources.files import MAX_LINE, concat_files, lines_in_range, list_inputs
from kvflow.sources.paths import file_facts

PAGE_SIZE = 524_288  # fixed value: default bytes per page
PREVIEW_CAP = 1_024  # fixed value: default bytes of a preview


class PageNotFound(LookupError):
    """The page lies past the end of the data."""


class PagedLines:
    """Lines in a total order, written once with their byte offsets, to be read by page.

    A line takes its UTF-8 bytes and one newline and belongs to the page its first byte is in.
    Reading one page touches the row groups around it, not the whole table. ``col`` is the line,
    or a column with its size in bytes.
    """

    def __init__(
        self,
        df: DataFrame,
        order_by: list[str],
        col: str | Column = "text",
        page_size: int = PAGE_SIZE,
        partitions: int | None = None,
    ):
        if page_size < 1:
            raise ValueError("a page has at least one byte")
        self.page_size = page_size
        weight = _line_bytes(col) if isinstance(col, str) else col
        self.totals = OrderedTotals(df, order_by, weight=weight, partitions=partitions)

    def lines(self) -> DataFrame:
        """All lines with ``byte_offset`` and ``page``."""
        rows = self.totals.running("byte_offset")
        return rows.withColumn("page", _page_of(F.col("byte_offset"), self.page_size))

    def total_pages(self) -> int:
        return -(-self.totals.total() // self.page_size)

    def page(self, page: int) -> DataFrame:
        """The lines of one page, numbered from 1; no lines at all if there is no data."""
        if page < 1:
            raise ValueError("pages are numbered from 1")
        total = self.total_pages()
        if total and page > total:
            raise PageNotFound(f"page {page} is beyond the {total} pages of the data")
        low, high = (page - 1) * self.page_size, page * self.page_size
        overlap = (F.col("_start") < high) & (F.col("_start") + F.col("_total") > low)
        starts = self.totals.starts
        ends = starts.filter(overlap).agg(
            F.min("_part").alias("first"), F.max("_part").alias("last"),
            F.min("_start").alias("first_start"), F.max("_start").alias("last_start"),
        ).first()
        part, local = F.col("_part"), F.col("_local")
        # constants, so that parquet skips the files and row groups outside the page
        rows = self.totals.table.filter(
            part.between(ends["first"], ends["last"])
            & ((part != F.lit(ends["first"])) | (local >= low - (ends["first_start"] or 0)))
            & ((part != F.lit(ends["last"])) | (local < high - (ends["last_start"] or 0)))
        )
        at_first = F.lit(ends["first_start"]).cast("bigint")
        start = F.when(part == F.lit(ends["first"]), at_first).otherwise(F.lit(ends["last_start"]).cast("bigint"))
        if ends["first"] is not None and ends["last"] - ends["first"] > 1:
            rows, start = rows.join(F.broadcast(starts.select("_part", "_start")), "_part"), F.col("_start")
        return rows.select(
            *self.totals.columns, (local + start).alias("byte_offset"), F.lit(page).cast("bigint").alias("page")
        )


def _line_bytes(col: str) -> Column:
    return (F.coalesce(F.octet_length(col), F.lit(0)) + 1).cast("bigint")


def _page_of(offset: Column, page_size: int) -> Column:
    return F.call_function("div", offset, F.lit(page_size)) + F.lit(1).cast("bigint")


def read_page(
    df: DataFrame,
    page: int,
    order_by: list[str],
    col: str = "text",
    page_size: int = PAGE_SIZE,
    unique: bool = False,
) -> DataFrame:
    """The lines of one page with ``byte_offset`` and ``page``.

    If no two lines tie on ``order_by``, say ``unique``: then only those columns and the lines'
    sizes are put in order, and the text is fetched for the lines of the page, which are at most
    as many as the page has bytes. To read many pages, keep a :class:`PagedLines`.
    """
    if not unique:
        return PagedLines(df, order_by, col, page_size).page(page)
    keys = [f"_key{i}" for i in range(len(order_by))]
    sizes = df.select(
        *(F.col(c).alias(k) for c, k in zip(order_by, keys)), _line_bytes(col).alias("_size")
    )
    rows = stored(PagedLines(sizes, keys, F.col("_size"), page_size).page(page).drop("_size"), "page")
    ends = rows.agg(F.min(keys[0]).alias("low"), F.max(keys[0]).alias("high")).first()
    # the range lets the scan skip row groups; the join settles the rest
    near = F.col(order_by[0]).between(ends["low"], ends["high"]) | F.col(order_by[0]).isNull()
    if not df.filter(near).groupBy(*order_by).count().filter("count > 1").isEmpty():
        raise ValueError(f"lines tie on {', '.join(order_by)}: the order is not unique")
    same = F.lit(True)
    for name, key in zip(order_by, keys):
        same = same & F.col(name).eqNullSafe(F.col(key))
    return df.filter(near).join(rows, same).drop(*keys)


def line_pages(
    df: DataFrame, order_by: list[str], col: str = "text", page_size: int = PAGE_SIZE
) -> DataFrame:
    """``order_by`` columns, ``byte_offset`` and ``page`` of every line; the text itself is not moved."""
    sizes = df.select(*order_by, _line_bytes(col).alias("n_bytes"))
    return PagedLines(sizes, order_by, F.col("n_bytes"), page_size).lines()


def page_index(
    df: DataFrame, order_by: list[str], col: str = "text", page_size: int = PAGE_SIZE
) -> DataFrame:
    """``(page, n_lines, n_bytes)``; a page inside one long line has no lines."""
    return line_pages(df, order_by, col, page_size).groupBy("page").agg(
        F.count("*").alias("n_lines"), F.sum("n_bytes").alias("n_bytes")
    )


def read_file_page(
    spark: SparkSession, path: str, page: int, page_size: int = PAGE_SIZE, max_line: int = MAX_LINE, cut: bool = False
) -> DataFrame:
    """One page over the files at ``path``; only the page's bytes are read.

    Columns are those of ``concat_files``, with lines numbered inside the page. The page, and the
    end of a line that goes beyond it, is read through the driver, which holds at most the page and
    ``max_line`` bytes: a longer line is an error, or with ``cut`` comes in parts of that size. A page
    that lies inside a line is passed in small blocks. For many pages, keep a :class:`FilePageIndex`.
    """
    if page < 1:
        raise ValueError("pages are numbered from 1")
    low, high = (page - 1) * page_size, page * page_size
    files = _file_starts(spark, path)
    total = files.agg(F.sum("length").alias("n")).first()["n"] or 0
    pages = -(-total // page_size)
    if pages and page > pages:
        raise PageNotFound(f"page {page} is beyond the {pages} pages of the data")
    return _page_rows(spark, files.filter(_overlap(low, high)).collect(), low, high, max_line, cut)


def _file_starts(spark: SparkSession, path: str) -> DataFrame:
    """The files with bytes in them, and where each begins when they follow each other by name."""
    files = list_inputs(spark, path).filter("length > 0")
    return OrderedTotals(files, ["path"], weight=F.col("length")).running("start")


def _overlap(low: int, high: int) -> Column:
    return (F.col("start") < high) & (F.col("start") + F.col("length") > low)


_PAGE_DDL = "file string, line_no bigint, line string, byte_offset bigint"


def _page_rows(spark: SparkSession, files: list, low: int, high: int, max_line: int, cut: bool, first: int = 0) -> DataFrame:
    """Lines that begin in a byte range of ``files`` (path, start, length), numbered from ``first`` on.

    Without ``max_line`` the range ends the last line too.
    """
    rows = []
    for file in sorted(files, key=lambda f: f["start"]):  # each has a byte of the range
        begin, stop = max(low - file["start"], 0), min(high - file["start"], file["length"])
        end, most = (file["length"], max_line) if max_line else (stop, max(high - low, 4))
        for at, line in lines_in_range(spark, file["path"], begin, stop, end, most, cut):
            rows.append((file["path"], first + len(rows), line, file["start"] + at))
    return spark.createDataFrame(rows, _PAGE_DDL)


class StaleIndex(RuntimeError):
    """The files are no longer those that were indexed."""


class FilePageIndex:
    """Where the pages over text files begin, stored once and opened by any later session.

    The index has a row per page that begins a line (page, number of its first line and of its lines,
    file and offset of the first) and a row per file (path, start, length, time of the last change). A
    page is found by its number and read as the byte range it is; nothing is listed or ordered
    again. A file of the page that has another length or time than when it was indexed is an error;
    ``verify`` looks at all files.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.pages = spark.read.schema(self.PAGES).parquet(f"{self.folder}/pages")
        self.files = spark.read.schema(self.FILES).parquet(f"{self.folder}/files")
        self.page_size, self.size, self.path = spark.read.parquet(f"{self.folder}/facts").first()

    PAGES = "page bigint, first_line bigint, n_lines bigint, file string, byte_offset bigint"
    FILES = "path string, start bigint, length bigint, changed bigint"

    @classmethod
    def build(cls, spark: SparkSession, path: str, folder: str, page_size: int = PAGE_SIZE) -> FilePageIndex:
        """Index the files at ``path`` below ``folder``, which must be new."""
        if page_size < 1:
            raise ValueError("a page has at least one byte")
        folder = folder.rstrip("/")
        before = _changed_files(spark, path)
        starts = _file_starts(spark, path).withColumnRenamed("path", "_path")
        files = before.join(starts, before["path"] == starts["_path"]).select("path", "start", before["length"], "changed")
        files = stored(files, "file-starts")
        files.write.parquet(f"{folder}/files")
        lines = concat_files(spark, path).withColumn("page", _page_of(F.col("byte_offset"), page_size))
        pages = lines.groupBy("page").agg(
            F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"),
            F.min_by("file", "byte_offset").alias("file"), F.min("byte_offset").alias("byte_offset"),
        )
        # in order, so that a page's row is found by the bounds of row groups
        pages.repartitionByRange("page").sortWithinPartitions("page").write.parquet(f"{folder}/pages")
        size = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        if not before.select("path", "length", "changed").exceptAll(_changed_files(spark, path)).isEmpty():
            raise StaleIndex(f"files at {path} changed while they were indexed")
        facts = spark.createDataFrame([(page_size, size, path)], "page_size bigint, size bigint, path string")
        facts.write.parquet(f"{folder}/facts")
        return cls(spark, folder)

    def total_pages(self) -> int:
        return -(-self.size // self.page_size)

    def page(self, page: int, max_line: int = MAX_LINE, cut: bool = False) -> DataFrame:
        """The lines of one page with the columns of ``concat_files``; lines are numbered over all files."""
        if page < 1:
            raise ValueError("pages are numbered from 1")
        if self.size and page > self.total_pages():
            raise PageNotFound(f"page {page} is beyond the {self.total_pages()} pages of the data")
        begin = self.pages.filter(F.col("page") == page).first()
        if begin is None:
            return self.spark.createDataFrame([], _PAGE_DDL)  # all of it lies inside a line
        low, high = begin["byte_offset"], page * self.page_size
        files = self.files.filter(_overlap(low, high)).collect()
        for file in files:
            if file_facts(self.spark, file["path"]) != (file["length"], file["changed"]):
                raise StaleIndex(f"{file['path']} is not the file that was indexed")
        return _page_rows(self.spark, files, low, high, max_line, cut, begin["first_line"])

    def verify(self) -> None:
        """Compare all files with those that were indexed; any difference is an error."""
        now, then = _changed_files(self.spark, self.path), self.files.select("path", "length", "changed")
        if not (now.exceptAll(then).isEmpty() and then.exceptAll(now).isEmpty()):
            raise StaleIndex(f"the files at {self.path} are not those that were indexed")


def _changed_files(spark: SparkSession, path: str) -> DataFrame:
    """The files with bytes in them: path, length and time of the last change in milliseconds."""
    files = list_inputs(spark, path, times=True).filter("length > 0")
    return files.select("path", "length", F.unix_millis("modificationTime").alias("changed"))


def take_bytes(df: DataFrame, cap: int, order_by: list[str], col: str = "text") -> DataFrame:
    """The first ``cap`` bytes of the lines in ``order_by`` order; the last line is cut.

    A line has a byte at least, so the cap bounds the rows: order columns and sizes tell how many
    there are, and only so many rows are taken with their text, at most ``cap`` characters each.
    Lines that tie are ordered by a hash of the row.
    """
    if cap < 0:
        raise ValueError("the cap must not be negative")
    columns = [c for c in df.columns if c != col]
    tie = F.xxhash64(*[c for c in df.columns if not has_map(df.schema[c].dataType)])
    rows = df.select(
        *columns, F.substring(F.coalesce(F.col(col), F.lit("")), 1, cap).alias(col),
        _line_bytes(col).alias("_weight"), tie.alias("_tie"),
    )
    order = [*order_by, "_tie"]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_weight").over(before), F.lit(0))
    # the windows are over the cap's rows at most
    narrow = rows.select(*order_by, "_tie", "_weight").orderBy(*order).limit(cap)
    n = narrow.withColumn("byte_offset", offset).filter(F.col("byte_offset") < cap).count()
    few = rows.orderBy(*order).limit(n).withColumn("byte_offset", offset).filter(F.col("byte_offset") < cap)
    return few.select(
        *columns, cut_bytes(F.col(col), F.lit(cap) - F.col("byte_offset")).alias(col), "byte_offset"
    )


def cut_bytes(text: Column, n: Column) -> Column:
    """The longest prefix of whole characters in the first ``n`` bytes of a text."""
    raw = F.encode(text, "UTF-8")

    # the byte after the cut tells whether the cut is inside a character (at most 4 bytes long)
    def inside(back):
        return F.hex(F.substring(raw, n.cast("int") + (1 - back), F.lit(1))).between("80", "BF")

    end = n - 3
    for back in (2, 1, 0):
        end = F.when(~inside(back), n - back).otherwise(end)
    whole = F.octet_length(text) <= n
    piece = F.substring(raw, F.lit(1), F.greatest(end, F.lit(0)).cast("int"))
    return F.when(whole, text).otherwise(F.decode(piece, "UTF-8"))


def take_file_bytes(spark: SparkSession, path: str, cap: int) -> DataFrame:
    """``take_bytes`` over the files at ``path``, through the driver; nothing past the cap is read."""
    files = _file_starts(spark, path).filter(_overlap(0, cap)).collect()
    return _page_rows(spark, files, 0, cap, 0, False)
