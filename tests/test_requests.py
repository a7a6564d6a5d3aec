"""The three request flows on a small fixture."""

from ledgerline.operators.requests import cancel_requests, run_requests, status_requests

JOBS = [(1, "[dev me] etl_dev", "BUNDLE", "me", None), (2, "report", None, "x", None),
        (3, "[dev a] multi_dev", "BUNDLE", "a", None), (4, "[dev b] multi_dev", "BUNDLE", "b", None)]
RUNS = [  # run_id, job_id, run_name, lc, rs, msg, start, exe, dur, url, termination
    (10, 1, "", "TERMINATED", "FAILED", "boom", 1000, 61000, None, "u10", ("C", "m")),
    (11, 1, "nightly", "RUNNING", None, None, 2000, None, None, "u11", None),
    (20, 2, None, "TERMINATED", "SUCCESS", None, 500, 4000, None, None, None),
    (21, 2, None, "TERMINATED", "SUCCESS", None, 600, 0, 8000, None, None),
]
RUN_SCHEMA = ("run_id bigint, job_id bigint, run_name string, life_cycle_state string, "
              "result_state string, state_message string, start_time bigint, "
              "execution_duration bigint, run_duration bigint, run_page_url string, "
              "termination struct<code:string,message:string>")


def _inputs(spark):
    jobs = spark.createDataFrame(JOBS, "job_id bigint, name string, deployment_kind string, "
                                       "creator_user_name string, run_as_user_name string")
    runs = spark.createDataFrame(RUNS, RUN_SCHEMA)
    req = spark.createDataFrame([("etl", "me"), ("report", "me"), ("multi", "me"), ("none", "me")],
                                "wanted string, principal string")
    return jobs, runs, req


def test_run_requests(spark):
    out = {r.wanted: r for r in run_requests(*_inputs(spark)).collect()}
    assert out["etl"].decision == "BLOCKED" and out["etl"].active_run_id == 11
    assert out["report"].decision == "ALLOWED" and out["report"].runs_used == 1
    assert out["report"].eta_text == "0m 4s"
    assert out["multi"].decision == "AMBIGUOUS" and out["multi"].n_candidates == 2
    assert out["none"].decision == "NOT_FOUND"
    jobs, runs, req = _inputs(spark)
    out = {r.wanted: r for r in run_requests(jobs, runs, req, prevent_duplicate=False).collect()}
    assert out["etl"].decision == "ALLOWED" and out["etl"].eta_text == "1m 1s"


def test_status_and_cancel_requests(spark):
    st = {r.wanted: r for r in status_requests(*_inputs(spark)).collect()}
    assert st["etl"].run_id == 11 and st["etl"].run_label == "nightly" and st["etl"].run_outcome == "RUNNING"
    assert st["report"].run_id == 21 and st["report"].run_label == "report"
    assert st["report"].duration_ms == 8000 and st["report"].run_outcome == "SUCCESS"
    assert st["multi"].run_id is None and st["none"].run_outcome is None
    ca = {r.wanted: r for r in cancel_requests(*_inputs(spark)).collect()}
    assert ca["etl"].action == "CANCEL" and ca["etl"].cancel_run_id == 11
    assert ca["report"].action == "NO_ACTIVE_RUN" and ca["multi"].action == "AMBIGUOUS"
