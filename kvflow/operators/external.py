"""Map and reduce by external programs that read and write lines."""

from __future__ import annotations

import io
import os
import queue
import re
import shlex
import subprocess
import sys
import tempfile
import threading
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvflow.functions.records import to_kv
from kvflow.operators.logs import Counters
from kvflow.operators.order import stored
from kvflow.operators.shuffle import shuffle

LOG_DDL = "task_id bigint, seq bigint, channel string, line string"
PIPE_BUFFER = 131_072  # fixed value: bytes buffered towards the program
_CHUNK = 4_096  # lines handed on together, fewer if they are long
_CHUNK_CHARS = 1 << 20


class ProgramFailed(RuntimeError):
    """The program ended with an error or stopped reading too early."""


def program_env(params: dict | None = None, extra: str | None = None) -> dict[str, str]:
    """Environment of a program: parameters under safe names, then ``a=b c=d`` pairs."""
    env = {re.sub("[^0-9A-Za-z]", "_", name): str(value) for name, value in (params or {}).items()}
    for entry in (extra or "").split(" "):
        name, found, value = entry.partition("=")
        if found and name:
            env[name] = value
    return env


def _pump(stream, channel: str, out: queue.Queue, stop: threading.Event) -> None:
    """Pass a program's lines on in chunks, then its end."""
    lines = io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline=None)
    chunk: list[str] = []
    chars = 0

    def put(item):
        while not stop.is_set():
            try:
                return out.put(item, timeout=0.5)
            except queue.Full:
                continue

    for line in lines:
        chunk.append(line[:-1] if line.endswith("\n") else line)
        chars += len(line)
        if len(chunk) >= _CHUNK or chars >= _CHUNK_CHARS:
            put((channel, chunk))
            chunk, chars = [], 0
    put((channel, chunk))
    put((channel, None))


def run_program(
    lines: Iterator[list[str]],
    argv: list[str],
    env: dict[str, str],
    on_exit: str,
    skip_after: int | None,
) -> Iterator[tuple[str, list[str]]]:
    """Feed lines to one process and yield ``(channel, lines)`` as it writes them.

    Input, output and errors move at the same time, so no side can block the others. After a
    failed write the rest of the input is skipped if at least ``skip_after`` lines came out;
    otherwise the task fails.
    """
    process = subprocess.Popen(
        argv, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE,
        bufsize=PIPE_BUFFER, env={**os.environ, **env, "TMPDIR": tempfile.gettempdir()},
    )
    out: queue.Queue = queue.Queue(maxsize=16)
    stop = threading.Event()
    counts = {"read": 0, "written": 0, "skipped": 0}
    trouble: list[BaseException] = []
    broken = threading.Event()

    def feed():
        try:
            for chunk in lines:
                if stop.is_set():
                    continue  # the input still has to be read to its end
                counts["read"] += len(chunk)
                if broken.is_set():
                    counts["skipped"] += len(chunk)
                    continue
                try:
                    process.stdin.write(("\n".join(chunk) + "\n").encode("utf-8"))
                except OSError:
                    broken.set()
                    counts["skipped"] += len(chunk)
            try:
                process.stdin.close()
            except OSError:
                broken.set()
        except BaseException as error:  # an input error must reach the task's own thread
            trouble.append(error)
            process.kill()

    workers = [
        threading.Thread(target=feed, daemon=True),
        threading.Thread(target=_pump, args=(process.stdout, "out", out, stop), daemon=True),
        threading.Thread(target=_pump, args=(process.stderr, "err", out, stop), daemon=True),
    ]
    for worker in workers:
        worker.start()
    try:
        open_channels = 2
        while open_channels:
            channel, chunk = out.get()
            if chunk is None:
                open_channels -= 1
            elif chunk:
                if channel == "out":
                    counts["written"] += len(chunk)
                yield channel, chunk
        workers[0].join()
        code = process.wait()
        if trouble:
            raise trouble[0]
        if broken.is_set() and (skip_after is None or counts["written"] < skip_after):
            raise ProgramFailed(
                f"{argv[0]} stopped reading after writing {counts['written']} records (exit code {code})"
            )
        if code != 0 and on_exit == "fail":
            raise ProgramFailed(f"{argv[0]} failed with exit code {code}")
        yield "err", [f"reporter:counter:records,{name},{n}" for name, n in counts.items()]
        yield "exit", [str(code)]
    finally:
        stop.set()
        if process.poll() is None:
            process.kill()
        process.wait()


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[str]]:
    for batch in batches:
        values = batch.column(0).to_pylist()
        for lo in range(0, len(values), _CHUNK):
            yield values[lo : lo + _CHUNK]


def _program_lines(
    lines: DataFrame, argv: list[str], env: dict[str, str], on_exit: str,
    skip_after: int | None, empty_runs: bool, counters: Counters | None = None,
) -> DataFrame:
    """Run one process per partition of a one-column table; all its output as log lines."""
    report = counters.step() if counters is not None else None
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["task_id", "seq", "channel", "line"]

    def task(batches):
        context = TaskContext.get()
        task_id = context.partitionId() if context else 0
        chunks = _chunks(batches)
        if not empty_runs:
            first = next(chunks, None)
            if first is None:
                return
            rest = chunks
            chunks = (c for part in ([first], rest) for c in part)
        seq = 0
        add = report() if report else None
        for channel, chunk in run_program(chunks, argv, env, on_exit, skip_after):
            n = len(chunk)
            if add and channel == "err":
                add(chunk)
            columns = [[task_id] * n, range(seq, seq + n), [channel] * n, chunk]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)], names=names
            )
            seq += n
        if add:
            add(None)

    return lines.mapInArrow(task, LOG_DDL)


def _argv(cmd: str | list[str]) -> list[str]:
    return shlex.split(cmd) if isinstance(cmd, str) else list(cmd)


def _check(on_exit: str) -> None:
    if on_exit not in ("fail", "ignore"):
        raise ValueError("on_exit is 'fail' or 'ignore'")


def pipe_map(
    kv: DataFrame,
    cmd: str | list[str],
    in_sep: str = "\t",
    out_sep: str = "\t",
    out_key_fields: int = 1,
    ignore_key: bool = False,
    params: dict | None = None,
    extra_env: str | None = None,
    on_exit: str = "fail",
    skip_after: int | None = None,
    log: bool = False,
    counters: Counters | None = None,
) -> DataFrame:
    """Run ``cmd`` once per partition on ``key SEP value`` lines and read its output as pairs.

    ``ignore_key`` writes the value alone. ``on_exit='ignore'`` accepts a non-zero exit code.
    ``skip_after`` see :func:`run_program`. With ``log`` the result is all lines the program
    wrote, ``(task_id, seq, channel, line)``, counters of what was read, written, skipped, and its
    exit code in channel ``exit``. ``counters`` gets the counters that it reports.
    """
    _check(on_exit)
    sent = F.col("value") if ignore_key else F.concat("key", F.lit(in_sep), "value")
    env = program_env(params, extra_env)
    written = _program_lines(kv.select(sent.alias("line")), _argv(cmd), env, on_exit, skip_after, True, counters)
    if log:
        return written
    return to_kv(written.filter("channel = 'out'"), "line", out_sep, out_key_fields)


def pipe_reduce(
    kv: DataFrame,
    cmd: str | list[str],
    reduce_tasks: int | None = None,
    numeric: bool = False,
    value_order: str | None = None,
    combine_cmd: str | list[str] | None = None,
    in_sep: str = "\t",
    out_sep: str = "\t",
    out_key_fields: int = 1,
    params: dict | None = None,
    extra_env: str | None = None,
    on_exit: str = "fail",
    log: bool = False,
    hot_share: float | None = None,
    counters: Counters | None = None,
) -> DataFrame:
    """Run ``cmd`` on key-sorted partitions; partitions without input start no program.

    ``hot_share`` gives each key with such a share of the pairs a program of its own, see ``shuffle``.

    ``combine_cmd`` runs on each task's own sorted pairs before the shuffle, which keeps a hot
    key small; it must write pairs that ``cmd`` can take in their place.
    """
    _check(on_exit)
    env = program_env(params, extra_env)

    def run(ordered: DataFrame, program) -> DataFrame:
        sent = ordered.select(F.concat("key", F.lit(in_sep), "value").alias("line"))
        return _program_lines(sent, _argv(program), env, on_exit, None, False, counters)

    if combine_cmd is not None:
        local = run(kv.sortWithinPartitions("key"), combine_cmd)
        kv = to_kv(local.filter("channel = 'out'"), "line", out_sep, out_key_fields)
    if hot_share is not None:
        kv = stored(kv.select("key", "value"), "reduce-pairs")
    written = run(shuffle(kv, reduce_tasks, numeric, value_order, hot_share=hot_share), cmd)
    if log:
        return written
    return to_kv(written.filter("channel = 'out'"), "line", out_sep, out_key_fields)


def python_program(source: str) -> list[str]:
    """Command line of a short Python program given as text."""
    return [sys.executable, "-c", source]
