from datetime import datetime

import pytest

from kvflow.operators import jobs

GOOD = dict(request_id=0, name="n", language="python3", input="/in", mapper="m", reducer="r", map_tasks=1, reduce_tasks=1)


def test_validation_order(spark):
    cases = [
        ({}, None, None),
        ({"mapper": " ", "reducer": ""}, "Mapper was not specified.", " "),
        ({"reducer": None, "map_tasks": 0}, "Reducer was not specified.", None),
        ({"map_tasks": 0, "reduce_tasks": 0}, "Jobs must have at least one map task.", "0"),
        ({"map_tasks": None, "reduce_tasks": -1}, "Jobs must have at least one reduce task.", "-1"),
        ({"name": "a\tb", "input": ""}, "Job name can only contain printing characters and spaces.", "a\tb"),
        ({"name": "a\n"}, "Job name can only contain printing characters and spaces.", "a\n"),
        ({"input": "  ", "language": "x"}, "No input was specified.", "  "),
        ({"language": "x"}, "Specified source code language is not recognized.", "x"),
        ({"language": None}, "Specified source code language is not recognized.", None),
        ({"name": " é b"}, None, None),
        ({"name": None}, None, None),
    ]
    rows = [tuple({**GOOD, **change, "request_id": i}.values()) for i, (change, _, _) in enumerate(cases)]
    ddl = ("request_id int, name string, language string, input string, mapper string, reducer string, "
           "map_tasks int, reduce_tasks int")
    out = jobs.validate_requests(spark.createDataFrame(rows, ddl), ["python3"]).orderBy("request_id").collect()
    assert [(r["error"], r["bad_value"]) for r in out] == [(e, v) for _, e, v in cases]
    assert out[-1]["name"] == "job" and out[0]["name"] == "n"


def test_jobs_since(spark):
    rows = [("ann", datetime(2024, 1, 1, h)) for h in range(5)] + [("anna", datetime(2024, 1, 1, 3))]
    df = spark.createDataFrame(rows, "user string, ts timestamp")

    def count(pattern, hour):
        return jobs.jobs_since(df, pattern, datetime(2024, 1, 1, hour)).first()["jobs"]

    assert [count("ann", 2), count("ann%", 2), count("%", 0), count("bob", 0)] == [3, 4, 6, 0]


def test_states(spark):
    rows = [
        (False, False, None, None, "RUNNING"), (True, True, None, None, "KILLED"), (True, False, 0, 0, "SUCCESSFUL"),
        (True, False, 0, 1, "FAILED"), (True, False, 0, None, "FAILED"), (True, False, 2, None, "FAILED"),
    ]
    df = spark.createDataFrame(rows, "done boolean, cancelled boolean, map_code int, reduce_code int, want string")
    assert jobs.derive_state(df).filter("state <> want").isEmpty()
    named = spark.createDataFrame([(s,) for s in ("SUCCEEDED", "KILLED", "FAILED", "RUNNING", "odd", None)], "s string")
    states = [r[0] for r in named.select(jobs.cluster_state("s")).collect()]
    assert states == ["SUCCESSFUL", "KILLED", "FAILED", "RUNNING", "PREP", "PREP"]


def test_failure_digest_and_progress(spark):
    rows = [
        (1, 1, "map", "SUCCEEDED", 1.0, "fine"), (1, 2, "map", "FAILED", 0.5, "  "), (1, 4, "map", "KILLED", 0.0, "late"),
        (1, 3, "map", "FAILED", 0.5, "early"), (1, 5, "reduce", "FAILED", 0.25, None), (2, 6, "map", "SUCCEEDED", 1.0, "x"),
    ]
    df = spark.createDataFrame(rows, "job_id int, seq int, phase string, status string, progress double, log string")
    digest = {(r["job_id"], r["phase"]): r["errors"] for r in jobs.failure_digest(df).collect()}
    assert digest == {(1, "map"): "early", (1, "reduce"): "", (2, "map"): None}
    progress = {(r[0], r[1]): (r[2], r[3]) for r in jobs.phase_progress(df).collect()}
    assert progress == {(1, "map"): (4, 50.0), (1, "reduce"): (1, 25.0), (2, "map"): (1, 100.0)}


def test_snapshot(spark):
    log = [(1, 1, "user", "ann"), (1, 2, "input", "/a"), (1, 3, "input", "/b"), (1, 4, "submitted", "true"),
           (1, 5, "input", None), (2, 1, "name", "n")]
    df = spark.createDataFrame(log, "id int, seq int, field string, value string")
    out = {r["id"]: r for r in jobs.submission_snapshot(df).collect()}
    assert (out[1]["user"], out[1]["input"], out[1]["submitted"], out[1]["completed"]) == ("ann", "/b", True, False)
    assert (out[2]["name"], out[2]["input"], out[2]["submitted"]) == ("n", None, False)


def test_find(spark):
    df = spark.range(10)
    assert jobs.find(df, 3).count() == 1
    with pytest.raises(jobs.UnknownId):
        jobs.find(df, 11)
    found, missing = jobs.find_many(df, spark.createDataFrame([(3,), (3,), (12,)], "x long"))
    assert [r[0] for r in found.collect()] == [3] and [r[0] for r in missing.collect()] == [12]
