"""Whole jobs: read, map, shuffle, reduce, write; and the capped dry run of one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException, PySparkException, PythonException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvflow.functions.records import to_kv
from kvflow.operators.external import pipe_map, pipe_reduce
from kvflow.operators.logs import Counters, other_lines
from kvflow.operators.mapping import combine_kv, map_expr, map_kv
from kvflow.operators.order import stored
from kvflow.operators.paging import take_bytes, take_file_bytes
from kvflow.operators.reduce import reduce_agg, reduce_kv
from kvflow.operators.shuffle import shuffle
from kvflow.sources.files import read_kv
from kvflow.sources.paths import reserved_path
from kvflow.sources.sinks import write_kv


@dataclass(frozen=True)
class Native:
    """A mapper or reducer given as column expressions, which Spark runs without Python.

    As a mapper, ``expr(key, value)`` returns ``array<struct<key, value>>``; as a reducer,
    ``expr(value)`` returns an aggregate.
    """

    expr: Callable[..., Column]


class JobFailed(RuntimeError):
    """A preview whose map or reduce failed, or whose map emitted nothing."""


def _is_program(step) -> bool:
    return isinstance(step, (str, list))


def _map(kv: DataFrame, mapper, map_tasks, combiner, params, options) -> DataFrame:
    if isinstance(mapper, Native):
        return map_expr(kv, mapper.expr, map_tasks)
    if _is_program(mapper):
        return pipe_map(kv if map_tasks is None else kv.repartition(map_tasks), mapper, params=params, **options)
    return map_kv(kv, mapper, map_tasks=map_tasks, combiner=combiner)


def _reduce(kv: DataFrame, reducer, reduce_tasks, numeric, value_order, combiner, params, options) -> DataFrame:
    if isinstance(reducer, Native):
        reduced = reduce_agg(kv, value=reducer.expr(F.col("value")).cast("string"))
        if reduce_tasks is None and not numeric and value_order is None:
            return reduced
        return shuffle(reduced, reduce_tasks, numeric, value_order)
    if _is_program(reducer):
        return pipe_reduce(
            kv, reducer, reduce_tasks, numeric, value_order, combine_cmd=combiner, params=params, **options
        )
    return reduce_kv(
        kv, reducer, reduce_tasks=reduce_tasks, numeric=numeric, value_order=value_order, combiner=combiner
    )


def _pairs(log: DataFrame, options: dict) -> DataFrame:
    """The pairs in a program's log."""
    lines = log.filter("channel = 'out'")
    return to_kv(lines, "line", options.get("out_sep", "\t"), options.get("out_key_fields", 1))


def _check_options(step, options: dict | None, kind: str) -> dict:
    if options and not _is_program(step):
        raise ValueError(f"{kind} options are for programs")
    if options and {"log", "params", "counters"} & set(options):
        raise ValueError("log, params and counters are not options")
    return dict(options or {})


def run_job(
    spark: SparkSession,
    input: str | DataFrame,
    mapper,
    reducer,
    *,
    name: str = "job",
    user: str | None = None,
    map_tasks: int | None = None,
    reduce_tasks: int | None = None,
    numeric: bool = False,
    value_order: str | None = None,
    combiner=None,
    params: dict | None = None,
    home: str | None = None,
    dialect: str = "standard",
    preview: int | None = None,
    map_options: dict | None = None,
    reduce_options: dict | None = None,
    counters: bool = False,
) -> DataFrame | tuple[DataFrame, Counters]:
    """Run a map and reduce job over text files or a ``kv`` table.

    Mapper and reducer are Python functions, :class:`Native` expressions or command lines; no
    reducer passes the sorted pairs through. The result is a lazy ``kv`` table. With ``home`` it
    is written below ``home/out`` under the first free form of ``name`` and read back from there.
    ``combiner`` folds pairs before the shuffle: a function, or a command line for a program.
    ``preview`` runs on so many bytes of the input files only, see :func:`preview_job`.
    Programs find the job's settings and ``params`` in their environment (``job_name``, ...).
    ``map_options`` and ``reduce_options`` are further arguments of ``pipe_map`` and ``pipe_reduce``:
    separators, key fields, exit and skip policy, extra environment. With ``counters`` the result is
    a pair: the table, and the :class:`Counters` of the job's programs, whose totals are there once the
    table has been computed (with ``home``, at once). ``map_tasks`` cuts input files in so many splits;
    a table is dealt anew for it.
    """
    map_options = _check_options(mapper, map_options, "map")
    reduce_options = _check_options(reducer, reduce_options, "reduce")
    if counters and not (_is_program(mapper) or _is_program(reducer)):
        raise ValueError("only programs report counters")
    if isinstance(combiner, (str, list)) and not isinstance(reducer, (str, list)):
        raise ValueError("a command line can fold only for a reducer that is one")
    for count, kind in ((map_tasks, "map"), (reduce_tasks, "reduce")):
        if count is not None and count < 1:
            raise ValueError(f"a job has at least one {kind} task")
    settings = {
        "job.name": name, "job.user": user, "job.map.tasks": map_tasks,
        "job.reduce.tasks": reduce_tasks, "job.numeric.sort": str(numeric).lower(),
    }
    settings = {k: v for k, v in settings.items() if v is not None} | (params or {})
    if preview is not None:
        for what, given in (("map_tasks", map_tasks), ("reduce_tasks", reduce_tasks), ("home", home)):
            if given not in (None, 1):
                raise ValueError(f"a preview is one stream that is not stored, so it takes no {what}")
        done = preview_job(
            spark, input, mapper, reducer, cap=preview, numeric=numeric, params=settings, dialect=dialect,
            map_options=map_options, reduce_options=reduce_options, value_order=value_order, combiner=combiner,
        )
        if done.state != "SUCCESSFUL":
            raise JobFailed("; ".join(r["errors"] or "no output" for r in done.phases.collect()))
        return (done.reduced, done.counters) if counters else done.reduced
    if isinstance(input, str):
        # the files are cut for so many tasks; no record is moved
        kv, map_tasks = read_kv(spark, input, dialect=dialect, tasks=map_tasks), None
    else:
        kv = input
    # a function can fold right behind a mapper that is one; otherwise in a step of its own
    folds = callable(mapper) and callable(combiner)
    totals = Counters(spark) if counters else None

    def counted(step, options: dict) -> dict:
        return {**options, "counters": totals} if counters and _is_program(step) else options

    mapped = _map(kv, mapper, map_tasks, combiner if folds else None, settings, counted(mapper, map_options))
    if callable(combiner) and isinstance(reducer, (str, list)) and not folds:
        mapped, folds = combine_kv(mapped, combiner), True
    combiner = None if folds else combiner
    result = _reduce(
        mapped, reducer, reduce_tasks, numeric, value_order, combiner, settings, counted(reducer, reduce_options)
    )
    if home is not None:
        with reserved_path(spark, f"{home.rstrip('/')}/out", name) as path:
            write_kv(result, path)
        result = read_kv(spark, path)
    return (result, totals) if counters else result


@dataclass(frozen=True)
class Preview:
    """Outcome of a dry run: what each phase wrote, None if it did not run or its function failed."""

    mapped: DataFrame | None
    reduced: DataFrame | None
    phases: DataFrame  # (phase, code, n_records, errors)
    state: str
    counters: Counters  # what the programs reported


def preview_job(
    spark: SparkSession,
    input: str | DataFrame,
    mapper,
    reducer,
    *,
    cap: int,
    order_by: list[str] | None = None,
    line: str = "line",
    numeric: bool = False,
    params: dict | None = None,
    dialect: str = "standard",
    map_options: dict | None = None,
    reduce_options: dict | None = None,
    value_order: str | None = None,
    combiner=None,
) -> Preview:
    """Run a job on the first ``cap`` bytes of its input, as one sorted stream.

    The input is files, or a table of lines with ``order_by``. Pairs of a key come in order of
    ``value_order``, by default of the value; a ``combiner`` folds them first. The job stops after a map that
    fails or emits nothing, and then counts as failed. A program's code is its exit code and its
    errors are what it wrote to its error stream; for a function, 1 and its traceback. Only the
    user's code can fail like that: errors of the cluster are raised.
    """
    if isinstance(input, str):
        capped = take_file_bytes(spark, input, cap)
        line = "line"
    else:
        if not order_by:
            raise ValueError("a table of lines needs order_by")
        capped = take_bytes(input, cap, order_by, line)
    # one task, as the preview is one stream
    kv = to_kv(capped, line, dialect=dialect).coalesce(1)
    phases: list[tuple] = []
    counters = Counters(spark)

    def run(phase: str, step, build: Callable[[dict], DataFrame], options: dict) -> DataFrame | None:
        program = _is_program(step)
        code, errors = 0, None
        try:
            if program:
                log = stored(build({**options, "log": True, "on_exit": "ignore", "counters": counters}), f"preview-{phase}")
                out = _pairs(log, options)
                codes = [int(r["line"]) for r in log.filter("channel = 'exit'").collect()]  # one task
                code = next((c for c in codes if c), 0) if options.get("on_exit", "fail") == "fail" else 0
                said = other_lines(log.filter("channel = 'err'")).orderBy("task_id", "seq").select("line").collect()
                errors = "\n".join(r["line"] for r in said) or None
            else:
                out = stored(build(options), f"preview-{phase}")
        except PythonException as error:  # raised by the user's function, or by a program that broke off
            phases.append((phase, 1, 0, str(error)))
            return None
        except AnalysisException:
            raise
        except PySparkException as error:
            if not isinstance(step, Native):
                raise
            phases.append((phase, 1, 0, str(error)))
            return None
        phases.append((phase, code, out.count(), errors))
        return out

    options = _check_options(mapper, map_options, "map")
    mapped = run("map", mapper, lambda o: _map(kv, mapper, None, None, params, o), options)
    reduced = None
    if mapped is not None and phases[0][1] == 0 and phases[0][2] > 0:
        options = _check_options(reducer, reduce_options, "reduce")
        if callable(combiner) and _is_program(reducer):
            mapped_in, combiner = combine_kv(mapped, combiner), None
        else:
            mapped_in = mapped
        reduced = run(
            "reduce", reducer,
            # the sort is by key, then whole line
            lambda o: _reduce(mapped_in, reducer, 1, numeric, value_order or "value", combiner, params, o), options,
        )
    done = spark.createDataFrame(phases, "phase string, code int, n_records bigint, errors string")
    state = "SUCCESSFUL" if reduced is not None and phases[-1][1] == 0 else "FAILED"
    return Preview(mapped, reduced, done, state, counters)
