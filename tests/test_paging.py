import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kvflow.operators import paging
from kvflow.sources import files

LINES = [(i, random.Random(i).choice(["", "a", "é" * 5, "𝄞x", "word " * 9]) * (i % 4)) for i in range(120)]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame(LINES, "n long, text string").repartition(5)


def offsets():
    out, at = {}, 0
    for n, text in sorted(LINES):
        out[n] = at
        at += len(text.encode()) + 1
    return out, at


def test_pages(spark, lines):
    where, total = offsets()
    paged = paging.PagedLines(lines, ["n"], page_size=100)
    got = {r["n"]: (r["byte_offset"], r["page"]) for r in paged.lines().collect()}
    assert got == {n: (at, at // 100 + 1) for n, at in where.items()}
    assert paged.total_pages() == -(-total // 100)
    index = {r["page"]: (r["n_lines"], r["n_bytes"]) for r in paging.page_index(lines, ["n"], page_size=100).collect()}
    assert sum(b for _, b in index.values()) == total
    seen = []
    for page in range(1, paged.total_pages() + 1):
        rows = paged.page(page).collect()
        assert len(rows) == index.get(page, (0, 0))[0]
        assert all(r["page"] == page and r["byte_offset"] == where[r["n"]] for r in rows)
        seen += [r["n"] for r in rows]
    assert sorted(seen) == sorted(where)
    with pytest.raises(paging.PageNotFound):
        paged.page(paged.total_pages() + 1)
    with pytest.raises(ValueError):
        paged.page(0)


def test_one_page_by_unique_order(spark, lines):
    paged = paging.PagedLines(lines, ["n"], page_size=100)
    for page in (1, 2, paged.total_pages()):
        want = sorted(tuple(r) for r in paged.page(page).select("n", "text", "byte_offset", "page").collect())
        got = paging.read_page(lines, page, ["n"], page_size=100, unique=True)
        assert sorted(tuple(r) for r in got.select("n", "text", "byte_offset", "page").collect()) == want
    assert paging.read_page(lines, 1, ["n"], page_size=100).count() == paged.page(1).count()
    with pytest.raises(paging.PageNotFound):
        paging.read_page(lines, 999, ["n"], page_size=100, unique=True)


def test_page_over_many_partitions(lines):
    for parts in (1, 2, 7):
        paged = paging.PagedLines(lines, ["n"], page_size=100_000, partitions=parts)
        assert paged.page(1).count() == len(LINES)
        small = paging.PagedLines(lines, ["n"], page_size=900, partitions=parts)
        got = [r["n"] for page in range(1, small.total_pages() + 1) for r in small.page(page).orderBy("n").collect()]
        assert got == sorted(n for n, _ in LINES)


def test_ties_are_no_unique_order(spark):
    tied = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "n long, text string")
    with pytest.raises(ValueError, match="not unique"):
        paging.read_page(tied, 1, ["n"], unique=True)


def test_no_data(spark):
    empty = spark.createDataFrame([], "n long, text string")
    paged = paging.PagedLines(empty, ["n"])
    assert paged.total_pages() == 0 and paged.page(1).count() == 0


def cut(text, n):
    return text.encode()[:n].decode(errors="ignore")


@pytest.mark.parametrize("cap", [0, 1, 7, 33, 500, 10_000])
def test_take_bytes(lines, cap):
    where, _ = offsets()
    got = {r["n"]: (r["byte_offset"], r["text"]) for r in paging.take_bytes(lines, cap, ["n"]).collect()}
    want = {n: (at, cut(dict(LINES)[n], cap - at)) for n, at in where.items() if at < cap}
    assert got == want


@settings(max_examples=8, deadline=None)
@given(texts=st.lists(st.text(max_size=8), min_size=1, max_size=30), n=st.integers(0, 20))
def test_cut_bytes(spark, texts, n):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    rows = df.select("i", paging.cut_bytes(F.col("s"), F.lit(n)).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in rows] == [cut(t, n) for t in texts]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pages") / "out dir+%"
    path.mkdir()
    rows = sorted(LINES)
    for part in range(4):
        body = "".join(f"{text}\n" for n, text in rows[part * 30 : part * 30 + 30])
        (path / f"part-{part}").write_text(body)
    (path / "_SUCCESS").write_text("")
    return str(path)


def test_file_pages(spark, folder):
    where, total = offsets()
    by_offset = {at: dict(LINES)[n] for n, at in where.items()}
    for page in (1, 2, -(-total // 400)):
        rows = paging.read_file_page(spark, folder, page, page_size=400).collect()
        want = {at: t for at, t in by_offset.items() if at // 400 + 1 == page}
        assert {r["byte_offset"]: r["line"] for r in rows} == want
    with pytest.raises(paging.PageNotFound):
        paging.read_file_page(spark, folder, 999, page_size=400)


def test_take_file_bytes(spark, folder):
    where, _ = offsets()
    for cap in (0, 5, 450):
        rows = paging.take_file_bytes(spark, folder, cap).collect()
        want = {at: cut(dict(LINES)[n], cap - at) for n, at in where.items() if at < cap}
        assert {r["byte_offset"]: r["line"] for r in rows} == want


def test_a_page_of_a_large_file_reads_only_its_bytes(spark, tmp_path, monkeypatch):
    from kvflow.sources import files, paths

    text = "".join(f"line {i} é\n" for i in range(200_000))
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("")
    taken = []
    plain = paths.open_file

    def counted(*args):
        stream, read = plain(*args)

        def count(place, size):
            taken.append(size)
            return read(place, size)

        return stream, count

    monkeypatch.setattr(files, "open_file", counted)
    rows = paging.read_file_page(spark, str(tmp_path), 3, page_size=10_000).collect()
    assert sum(taken) <= 10_001 + (1 << 20)
    raw = text.encode()
    assert all(raw[r["byte_offset"] :].startswith(r["line"].encode() + b"\n") for r in rows)
    assert 20_000 <= min(r["byte_offset"] for r in rows) and max(r["byte_offset"] for r in rows) < 30_000
    assert raw[: min(r["byte_offset"] for r in rows)].count(b"\n") + len(rows) == raw[:30_000].count(b"\n") + 1


def plain_lines(raw, low, high):
    """(offset, line) of the lines that begin in a byte range."""
    at, out = 0, []
    for line in raw.split(b"\n")[: -1 if raw.endswith(b"\n") else None]:
        if low <= at < high:
            out.append((at, line.decode()))
        at += len(line) + 1
    return out


@pytest.mark.parametrize("step", [1, 3, 7, 64, 1 << 20])
@pytest.mark.parametrize("ending", ["", "\n"])
def test_lines_in_any_range(spark, tmp_path, monkeypatch, step, ending):
    monkeypatch.setattr(files, "_STEP", step)
    path = tmp_path / "a.txt"
    path.write_text("one\n\nsome é longer 中 line\n\n\n" + "x" * 50 + "\nlast one" + ending)
    raw = path.read_bytes()
    for low in range(0, len(raw), 5):
        for high in (low + 1, low + 9, len(raw)):
            high = min(high, len(raw))
            got = list(files.lines_in_range(spark, str(path), low, high, len(raw)))
            assert got == plain_lines(raw, low, high)


@pytest.mark.parametrize("step", [1, 5, 1 << 20])
def test_long_lines_are_refused_or_cut(spark, tmp_path, monkeypatch, step):
    monkeypatch.setattr(files, "_STEP", step)
    path = tmp_path / "a.txt"
    path.write_text("ab\n" + "é中x" * 40 + "\ncd\n")
    raw = path.read_bytes()
    with pytest.raises(files.LineTooLong, match="byte 3 "):
        list(files.lines_in_range(spark, str(path), 0, len(raw), len(raw), 16))
    for most in (4, 16, 100):
        parts = list(files.lines_in_range(spark, str(path), 0, 4, len(raw), most, True))
        assert parts[0] == (0, "ab") and "".join(t for _, t in parts[1:]) == "é中x" * 40
        assert all(len(t.encode()) <= most and raw[at:].startswith(t.encode()) for at, t in parts)
    # a page inside the line has nothing, whatever the limit
    assert list(files.lines_in_range(spark, str(path), 10, 50, len(raw), 4)) == []


def test_a_page_in_a_very_long_line_holds_little(spark, tmp_path):
    import tracemalloc

    with open(tmp_path / "a.txt", "wb") as out:
        out.write(b"first\n")
        for _ in range(64):
            out.write(b"x" * (1 << 20))
        out.write(b"\nlast\n")
    size = 1 << 22
    tracemalloc.start()
    assert paging.read_file_page(spark, str(tmp_path), 3, page_size=size).count() == 0
    with pytest.raises(files.LineTooLong):
        paging.read_file_page(spark, str(tmp_path), 1, page_size=size, max_line=1 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20  # of 64 MB: a block, its copies on the way from the JVM, a page
    last = paging.read_file_page(spark, str(tmp_path), 17, page_size=size).collect()
    assert [(r["line"], r["byte_offset"]) for r in last] == [("last", 7 + (64 << 20))]


def test_stored_page_index(spark, folder, tmp_path):
    made = paging.FilePageIndex.build(spark, folder, f"{tmp_path}/index", page_size=400)
    where, total = offsets()
    ordered = sorted(where.items(), key=lambda w: w[1])
    opened = paging.FilePageIndex(spark.newSession(), f"{tmp_path}/index")
    assert opened.total_pages() == made.total_pages() == -(-total // 400)
    for page in range(1, opened.total_pages() + 1):
        rows = opened.page(page).collect()
        want = [(k, at, dict(LINES)[n]) for k, (n, at) in enumerate(ordered) if at // 400 + 1 == page]
        assert [(r["line_no"], r["byte_offset"], r["line"]) for r in rows] == want
    opened.verify()
    with pytest.raises(paging.PageNotFound):
        opened.page(999)
    with pytest.raises(Exception, match="(?i)exists"):
        paging.FilePageIndex.build(spark, folder, f"{tmp_path}/index", page_size=400)


def test_a_stale_page_index_is_an_error(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        (source / f"{k}.txt").write_text("".join(f"{k} {i}\n" for i in range(100)))
    index = paging.FilePageIndex.build(spark, str(source), f"{tmp_path}/index", page_size=200)
    assert index.page(1).count() > 0
    (source / "0.txt").write_text("other\n" * 100)
    with pytest.raises(paging.StaleIndex):
        index.page(1)
    assert index.page(index.total_pages()).count() > 0  # its file is as it was
    with pytest.raises(paging.StaleIndex):
        index.verify()
    (source / "2.txt").unlink()
    with pytest.raises(paging.StaleIndex):
        index.page(index.total_pages())


def test_a_page_of_an_index_lists_and_orders_nothing(spark, folder, tmp_path, monkeypatch):
    index = paging.FilePageIndex.build(spark, folder, f"{tmp_path}/index", page_size=400)

    def never(*args, **more):
        raise AssertionError("listed or ordered again")

    for name in ("list_inputs", "concat_files", "OrderedTotals"):
        monkeypatch.setattr(paging, name, never)
    assert paging.FilePageIndex(spark, index.folder).page(2).count() > 0


def test_index_of_no_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("")
    index = paging.FilePageIndex.build(spark, f"{tmp_path}/in", f"{tmp_path}/index")
    assert index.total_pages() == 0 and index.page(1).count() == 0
