"""Questions over tables of job requests, submissions, phases and task events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvflow.functions.text import is_blank

QUOTA_ATTEMPTS = 20  # fixed value: default jobs per user and window
QUOTA_MINUTES = 10  # fixed value: default window

# Validation messages.
_MESSAGES = {
    "mapper": "Mapper was not specified.",
    "reducer": "Reducer was not specified.",
    "map_tasks": "Jobs must have at least one map task.",
    "reduce_tasks": "Jobs must have at least one reduce task.",
    "name": "Job name can only contain printing characters and spaces.",
    "input": "No input was specified.",
    "language": "Specified source code language is not recognized.",
}


def validate_requests(requests: DataFrame, languages: list[str]) -> DataFrame:
    """Replace a blank name by ``job`` and add the first failing rule and its value.

    ``error`` and ``bad_value`` are NULL for good requests. An unset task count is fine.
    """
    def count_bad(name):
        return F.coalesce(F.col(name) < 1, F.lit(False))

    bad = {
        "mapper": is_blank("mapper"),
        "reducer": is_blank("reducer"),
        "map_tasks": count_bad("map_tasks"),
        "reduce_tasks": count_bad("reduce_tasks"),
        "name": ~is_blank("name") & ~F.coalesce(F.col("name"), F.lit("")).rlike(r"^[ \S]*\z"),
        "input": is_blank("input"),
        "language": ~F.coalesce(F.col("language").isin(list(languages)), F.lit(False)),
    }
    error = bad_value = None
    for field, failed in bad.items():
        message, value = F.lit(_MESSAGES[field]), F.col(field).cast("string")
        error = F.when(failed, message) if error is None else error.when(failed, message)
        bad_value = F.when(failed, value) if bad_value is None else bad_value.when(failed, value)
    named = F.when(is_blank("name"), F.lit("job")).otherwise(F.col("name"))
    columns = [named.alias("name") if c == "name" else F.col(c) for c in requests.columns]
    return requests.select(*columns, error.alias("error"), bad_value.alias("bad_value"))


def jobs_since(
    submissions: DataFrame, user_pattern: str, since, user: str = "user", ts: str = "ts"
) -> DataFrame:
    """Number of rows since a time whose user matches a LIKE pattern (``%`` for everyone)."""
    since = since if isinstance(since, Column) else F.lit(since).cast("timestamp")
    rows = submissions.filter(F.col(user).cast("string").like(user_pattern) & (F.col(ts) >= since))
    return rows.agg(F.count("*").alias("jobs"))


def derive_state(phases: DataFrame) -> DataFrame:
    """Add ``state`` from done, cancelled and exit codes; a reduce phase that never ran failed."""
    state = (
        F.when(~F.col("done"), "RUNNING")
        .when(F.col("cancelled"), "KILLED")
        .when((F.col("map_code") == 0) & (F.coalesce("reduce_code", F.lit(-1)) == 0), "SUCCESSFUL")
        .otherwise("FAILED")
    )
    return phases.withColumn("state", state)


def cluster_state(reported: Column | str) -> Column:
    """A cluster's own state name as ours; anything unknown is still being prepared."""
    reported = F.col(reported) if isinstance(reported, str) else reported
    return (
        F.when(reported == "SUCCEEDED", "SUCCESSFUL")
        .when(reported.isin("FAILED", "KILLED", "RUNNING"), reported)
        .otherwise("PREP")
    )


def failure_digest(task_events: DataFrame) -> DataFrame:
    """``(job_id, phase, errors)``: the first log with text of the attempts that did not succeed.

    Failures without any text give ``''``; a phase without failures gives NULL.
    """
    failed = F.col("status").isNull() | (F.col("status") != "SUCCEEDED")
    told = failed & ~is_blank("log")
    return (
        task_events.groupBy("job_id", "phase")
        .agg(
            F.min_by(F.when(told, F.col("log")), F.when(told, F.col("seq"))).alias("text"),
            F.bool_or(failed).alias("failed"),
        )
        .select("job_id", "phase", F.when(F.col("failed"), F.coalesce("text", F.lit(""))).alias("errors"))
    )


def phase_progress(tasks: DataFrame) -> DataFrame:
    """``(job_id, phase, total_tasks, progress)`` with progress in percent."""
    return tasks.groupBy("job_id", "phase").agg(
        F.count("*").alias("total_tasks"), (F.avg("progress") * 100).alias("progress")
    )


def job_status(phases: DataFrame, task_events: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row per job of ``phases``: job_id, state, and a struct for each of its two phases.

    A phase is ``(code, total_tasks, progress, errors)``; inputs are those of ``derive_state``,
    ``failure_digest`` and ``phase_progress``. Facts of jobs that ``phases`` lacks are left out.
    """
    told = failure_digest(task_events).select("job_id", "phase", F.struct("errors").alias("digest"))
    run = phase_progress(tasks).select("job_id", "phase", F.struct("total_tasks", "progress").alias("run"))

    def by_job(facts, name):
        sides = [F.max(F.when(F.col("phase") == p, F.col(name))).alias(f"{p}_{name}") for p in ("map", "reduce")]
        return facts.groupBy("job_id").agg(*sides)

    joined = derive_state(phases).join(by_job(told, "digest"), "job_id", "left").join(by_job(run, "run"), "job_id", "left")

    def side(phase):
        return F.struct(
            F.col(f"{phase}_code").alias("code"), F.col(f"{phase}_run.total_tasks"), F.col(f"{phase}_run.progress"),
            F.col(f"{phase}_digest.errors"),
        ).alias(phase)

    return joined.select("job_id", "state", side("map"), side("reduce"))


def submission_snapshot(log: DataFrame) -> DataFrame:
    """Fold ``(id, seq, field, value)`` updates to one row per id with the latest values."""
    def latest(name):
        ours = (F.col("field") == name) & F.col("value").isNotNull()
        return F.max_by(F.when(ours, F.col("value")), F.when(ours, F.col("seq"))).alias(name)

    def ever(name):
        ours = (F.col("field") == name) & (F.lower("value") == "true")
        return F.coalesce(F.bool_or(ours), F.lit(False)).alias(name)

    return log.groupBy("id").agg(
        *(latest(n) for n in ("user", "name", "ts", "test", "input", "native_id", "mapper", "reducer")),
        *(ever(n) for n in ("submitted", "completed")),
    )


class UnknownId(LookupError):
    """No row has the requested id."""


def find(df: DataFrame, wanted, id_col: str = "id") -> DataFrame:
    """The row of one id; an unknown id is an error."""
    found = df.filter(F.col(id_col) == F.lit(wanted))
    if found.isEmpty():
        raise UnknownId(f"no row with {id_col} = {wanted}")
    return found


def find_many(df: DataFrame, wanted: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """The rows of many ids, and the ids that no row has."""
    ids = wanted.select(F.col(wanted.columns[0]).alias(id_col)).distinct()
    found = df.join(ids, id_col, "left_semi")
    # one row per id on the right, so that an id with very many rows does not weigh on one task
    return found, ids.join(found.select(id_col).distinct(), id_col, "left_anti")
