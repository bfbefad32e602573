import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from kvflow.session import scratch_path, shared_dir
from kvflow.sources import files, paths, sinks
from tests.conftest import pairs_of


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in put"
    (root / "sub").mkdir(parents=True)
    (root / "day=1").mkdir()
    for name, body in {"b.txt": "k3\tv3\n", "a.txt": "k1\tv1\r\nk2\n", "_x": "no\n", ".y": "no\n",
                       "sub/c.txt": "no\n", "day=1/d.txt": "no\n"}.items():
        (root / name).write_bytes(body.encode())
    return root


def test_only_visible_direct_files_are_read(spark, folder):
    assert pairs_of(files.read_kv(spark, str(folder))) == [("k1", "v1"), ("k2", ""), ("k3", "v3")]
    listed = {r["path"].rsplit("/", 1)[1]: r["length"] for r in files.list_inputs(spark, str(folder)).collect()}
    assert listed == {"a.txt": 10, "b.txt": 6}
    assert pairs_of(files.read_kv(spark, str(folder / "b.txt"))) == [("k3", "v3")]
    assert pairs_of(files.read_kv(spark, f"file://{folder}/")) == [("k1", "v1"), ("k2", ""), ("k3", "v3")]


def test_relative_paths_and_patterns(spark, folder, monkeypatch):
    import os

    monkeypatch.chdir(folder)  # for Python; the JVM keeps its own working folder
    there = os.path.relpath(folder, spark._jvm.java.lang.System.getProperty("user.dir"))
    assert pairs_of(files.read_kv(spark, there)) == [("k1", "v1"), ("k2", ""), ("k3", "v3")]
    assert pairs_of(files.read_kv(spark, f"{folder}/b*.txt")) == [("k3", "v3")]


def test_concat_over_split_files(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    want, at = [], 0
    for name in ("p2", "p0", "p10", "p1"):
        body = [f"{name} line {i} é" * (i % 5) for i in range(300)]
        (root / name).write_text("".join(line + "\n" for line in body))
    for name in sorted(p.name for p in root.iterdir()):
        for line in (root / name).read_text().split("\n")[:-1]:
            want.append((name, len(want), line, at))
            at += len(line.encode()) + 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = files.concat_files(spark, str(root)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = sorted((r["line_no"], r["file"].rsplit("/", 1)[1], r["line"], r["byte_offset"]) for r in rows)
    assert [(f, n, line, at) for n, f, line, at in got] == want


def test_concat_counts_only_what_it_reads(spark, folder):
    for path in (str(folder), [str(folder)], f"{folder}/*.txt"):
        rows = files.concat_files(spark, path).orderBy("line_no").collect()
        assert [(r["line"], r["byte_offset"]) for r in rows] == [("k1\tv1\r", 0), ("k2", 7), ("k3\tv3", 10)]


def test_write_then_read(spark, tmp_path, kv):
    pairs = [("a", "1"), ("b", ""), ("", "x\ty")]
    path = f"file://{tmp_path}/out"
    sinks.write_kv(kv(pairs, 1), path)
    assert pairs_of(files.read_kv(spark, path)) == sorted(pairs)
    raw = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert sorted(raw.splitlines()) == sorted(["a\t1", "b\t", "\tx\ty"])
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_kv(kv(pairs), path)


def test_store_dataset(spark, tmp_path):
    home = f"file://{tmp_path}"
    df = spark.createDataFrame([("a\r\nb",), ("c",)], "text string")
    assert sinks.store_dataset(df, home) == "data/dataset"
    assert sinks.store_dataset(df, home, "  ") == "data/dataset-1"
    assert sinks.store_dataset(df, home + "/", "mine") == "data/mine"
    lines = files.read_lines(spark, f"{home}/data/mine", line_sep="\n")
    assert sorted(r["value"] for r in lines.collect()) == ["a", "b", "c"]


def test_two_jobs_never_store_in_one_place(spark, tmp_path):
    home, df = f"file://{tmp_path}", spark.createDataFrame([("a",)], "text string")
    inside = threading.Barrier(4)

    def one(k):
        with paths.reserved_path(spark, f"{home}/data", "name") as path:
            inside.wait(60)  # all four hold a path before any writes
            df.selectExpr(f"'{k}' AS value").write.text(path)
        return path

    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(one, range(4)))
    assert sorted(f.rsplit("/", 1)[1] for f in found) == ["name", "name-1", "name-2", "name-3"]
    assert sorted(p.name for p in (tmp_path / "data").iterdir() if not p.name.startswith("name")) == []
    with ThreadPoolExecutor(2) as pool:
        stored = sorted(pool.map(lambda _: sinks.store_dataset(df, home, "mine"), range(2)))
    assert stored == ["data/mine", "data/mine-1"]
    with pytest.raises(RuntimeError):
        with paths.reserved_path(spark, f"{home}/data", "lost"):
            raise RuntimeError
    assert sinks.store_dataset(df, home, "lost") == "data/lost"


CHECKS = [
    # path, exists, default flags, contained
    ("in/a", True, "ok", "ok"),
    ("in/b", False, "not_found", "not_found"),
    ("file:/etc/passwd", True, "local_denied", "local_denied"),
    ("/data/x", True, "ok", "outside_home"),
    ("hdfs://nn/home", True, "ok", "ok"),
    ("hdfs://nn/home/in/a", True, "ok", "ok"),
    ("hdfs://nn/homework", True, "ok", "outside_home"),
    ("hdfs://other/home/in", True, "ok", "outside_home"),
    ("in/../../x", True, "ok", "outside_home"),
    ("in/.././a", True, "ok", "ok"),
]


def test_check_inputs(spark):
    asked = spark.createDataFrame([(c[0],) for c in CHECKS], "path string")
    home = "hdfs://nn/home/"
    there = [c[0] if c[0].startswith(("/", "hdfs", "file")) else "hdfs://nn/home/" + c[0] for c in CHECKS if c[1]]
    listing = spark.createDataFrame([(p,) for p in there], "path string")
    for column, contain in ((2, False), (3, True)):
        out = files.check_inputs(asked, home, listing, contain=contain)
        assert {r["path"]: r["verdict"] for r in out.collect()} == {c[0]: c[column] for c in CHECKS}
    local = files.check_inputs(asked, home, listing, allow_local=True)
    assert local.filter(F.col("verdict") == "local_denied").isEmpty()


def test_shared_dir_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_dir(spark) == named
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_input_paths_are_compared_in_one_form(spark):
    asked = ["in/1", "/home/in/1", "in/../in/1", "HDFS://NN/home/in/1", "hdfs://nn//home/./in/1", "hdfs:///home/in/1", "../out"]
    listing = spark.createDataFrame([("hdfs://nn/home/in/1",), ("/out",)], "path string")
    df = spark.createDataFrame([(p,) for p in asked], "path string")
    out = {r["path"]: r["verdict"] for r in files.check_inputs(df, "hdfs://nn/home", listing, contain=True).collect()}
    assert out == {p: "ok" for p in asked} | {"hdfs:///home/in/1": "not_found", "../out": "outside_home"}
