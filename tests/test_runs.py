"""Run-history golden cases (F5)."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import runs as R
from tests.oracle_compare import plan_text

RUN_SCHEMA = ("run_id bigint, job_id bigint, run_name string, life_cycle_state string, "
              "result_state string, state_message string, start_time bigint, "
              "execution_duration bigint, run_duration bigint, run_page_url string, "
              "termination struct<code:string,message:string>")
TASK_SCHEMA = ("run_id bigint, task_key string, task_run_id bigint, result_state string, "
               "state_message string, termination struct<code:string,message:string>")


def run(run_id, job_id=1, lc="TERMINATED", rs="SUCCESS", start=None, exe=None, dur=None,
        name=None, msg=None, term=None):
    return (run_id, job_id, name, lc, rs, msg, start if start is not None else run_id * 1000,
            exe, dur, None, term)


def runs_df(spark, rows):
    return spark.createDataFrame(rows, RUN_SCHEMA)


def test_eta_takes_newest_ten_then_drops_unusable(spark):
    rows = [run(i, exe=d * 1000) for i, d in enumerate([100, 100] + [1, 2, 3, 4, 5, 6, 7, 8, 9, 0])]
    rows.append(run(99, lc="RUNNING", rs=None, exe=500000))  # active: not a sample
    r = R.run_eta(runs_df(spark, rows)).first()
    assert r.runs_used == 9 and r.eta_seconds == pytest.approx(5.0) and r.eta_text == "0m 5s"


def test_eta_text_truncates(spark):
    rows = [run(1, exe=125900), run(2, exe=125900)]
    r = R.run_eta(runs_df(spark, rows)).first()
    assert r.eta_text == "2m 5s"


def test_eta_without_usable_duration(spark):
    r = R.run_eta(runs_df(spark, [run(1, exe=0), run(2, exe=None)])).first()
    assert r.runs_used == 0 and r.eta_seconds is None and r.eta_text is None


@pytest.mark.parametrize("exe,dur,ms,text", [
    (0, 7000, 7000, "0m 7s"), (None, 7000, 7000, "0m 7s"), (61000, 7000, 61000, "1m 1s"),
    (0, 0, None, None), (None, None, None, None), (0, None, None, None),
])
def test_duration_coalesce(spark, exe, dur, ms, text):
    r = R.run_durations(runs_df(spark, [run(1, exe=exe, dur=dur)])).first()
    assert r.duration_ms == ms and r.duration_text == text


@pytest.mark.parametrize("rs,lc,expected", [
    ("FAILED", "TERMINATED", "FAILED"), ("TIMEDOUT", "TERMINATED", "FAILED"),
    ("SUCCESS_WITH_FAILURES", "TERMINATED", "FAILED"), ("UPSTREAM_FAILED", "TERMINATED", "FAILED"),
    (None, "INTERNAL_ERROR", "FAILED"), (None, "RUNNING", "RUNNING"), ("CANCELED", "TERMINATED", "OTHER"),
    ("SUCCESS", "TERMINATED", "SUCCESS"), (None, "PENDING", "OTHER"), (None, None, "OTHER"),
])
def test_classification(spark, rs, lc, expected):
    r = R.classify_runs(runs_df(spark, [run(1, lc=lc, rs=rs)])).first()
    assert r.outcome == expected


def test_status_defaults(spark):
    rows = [run(1, lc=None, rs=None, start=0, name=""), run(2, name="nightly", start=1704067200123)]
    jobs = spark.createDataFrame([(1, "the_job")], "job_id bigint, name string")
    out = {r.run_id: r for r in R.run_status(runs_df(spark, rows), jobs).collect()}
    assert out[1].life_cycle == "UNKNOWN" and out[1].job_name == "the_job" and out[1].started is None
    assert out[2].job_name == "nightly"
    started = R.run_started(runs_df(spark, rows)).collect()
    iso = {r.run_id: r.started_iso for r in started}
    assert iso == {1: None, 2: "2024-01-01T00:00:00.123000"}


def test_latest_and_cancel_candidates(spark):
    rows = [run(1, start=10), run(2, start=30, lc="RUNNING", rs=None), run(3, start=20, lc="PENDING", rs=None),
            run(4, job_id=2, start=5)]
    df = runs_df(spark, rows)
    latest = {r.job_id: r.run_id for r in R.latest_run(df).collect()}
    assert latest == {1: 2, 2: 4}
    cancel = {r.job_id: r.run_id for r in R.cancel_candidates(df).collect()}
    assert cancel == {1: 2}
    req = spark.createDataFrame([(1,), (2,), (3,)], "job_id bigint")
    blocked = {r.job_id: (r.active_run_id, r.active_runs) for r in R.blocked_requests(req, df).collect()}
    assert blocked == {1: (2, 2)}
    allowed = sorted(r.job_id for r in R.allowed_requests(req, df).collect())
    assert allowed == [2, 3]


def tasks_df(spark, rows):
    return spark.createDataFrame(rows, TASK_SCHEMA)


def test_failed_task_selection(spark):
    tasks = tasks_df(spark, [
        (1, "A", 11, "FAILED", None, None), (1, "B", 12, "SUCCESS", None, None), (1, "C", 13, None, None, None),
        (2, "A", 21, "SUCCESS", None, None), (2, "B", 22, None, None, None), (2, "C", 23, "CANCELED", None, None),
    ])
    failed = spark.createDataFrame([(1,), (2,), (3,)], "run_id bigint")
    out = sorted((r.run_id, r.task_key, r.reason) for r in R.failed_tasks(failed, tasks).collect())
    assert out == [(1, "A", "failed"), (2, "B", "not_success"), (2, "C", "not_success"), (3, None, "no_tasks")]


def test_failed_tasks_with_odd_run_ids(spark):
    tasks = tasks_df(spark, [
        (1, "A", 11, "FAILED", None, None), (1, "A", 11, "FAILED", None, None), (1, "B", 12, None, None, None),
        (2, "A", 21, "SUCCESS", None, None), (4, "A", 41, "FAILED", None, None),
        (None, "A", 91, "FAILED", None, None), (None, "B", 92, None, None, None),
    ])
    failed = spark.createDataFrame([(1,), (1,), (2,), (3,), (3,), (None,), (None,)], "run_id bigint")
    out = sorted(((r.run_id, r.task_key, r.task_run_id, r.reason) for r in R.failed_tasks(failed, tasks).collect()), key=str)
    assert out == [(1, "A", 11, "failed"), (1, "A", 11, "failed"), (3, None, 3, "no_tasks"), (None, None, None, "no_tasks")]


def test_failed_tasks_joins_only_tasks(spark):
    failed = spark.range(50).select(F.col("id").alias("run_id"))
    tasks = tasks_df(spark, [(1, "A", 11, "FAILED", None, None)])
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_text(R.failed_tasks(failed, tasks))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    # The runs without tasks come from the aggregate, in a stage of its own, and not from sorts of all run ids.
    assert plan.split("\n\n")[0].count("SortMergeJoin") == 1
    assert "REPARTITION_BY_COL" in plan


@pytest.mark.parametrize("code,message,expected", [
    (None, "m", "m"), ("c", "m", "c - m"), ("", "", None), ("c", None, "c"),
])
def test_termination_summary(spark, code, message, expected):
    r = R.termination_text(runs_df(spark, [run(1, term=(code, message))])).first()
    assert r.termination_summary == expected


def test_task_errors_tail_and_placeholder(spark):
    sel = spark.createDataFrame([(1, "A", 11, "failed"), (1, "B", 12, "failed"), (1, "C", 13, "failed")],
                                "run_id bigint, task_key string, task_run_id bigint, reason string")
    outs = spark.createDataFrame([(11, "boom", "x" * 1000 + "y" * 4000, None), (12, "", "abc", ""),
                                  (13, None, None, None)],
                                 "task_run_id bigint, error string, error_trace string, notebook_result string")
    out = {r.task_key: r for r in R.task_errors(sel, outs).collect()}
    assert out["A"].trace_tail == "y" * 4000 and out["A"].error == "boom" and out["A"].note is None
    assert out["B"].trace_tail == "abc" and out["B"].error is None
    assert out["C"].note == "(No exception trace recorded for this task.)"


def test_run_eta_plan_limits_before_shuffle(spark, sf001):
    from ledgerline.sources import bindings as B

    plan = plan_text(R.run_eta(B.runs(spark, sf001)))
    assert "WindowGroupLimit" in plan


def test_failed_tasks_from_nested_runs(spark):
    from ledgerline import schemas as S

    t = lambda key, rid, state: (key, rid, state, None, None)
    rows = [
        (1, 1, None, "TERMINATED", "FAILED", None, 1, None, None, None, None,
         [t("A", 11, "FAILED"), t("B", 12, "SUCCESS"), t("C", 13, None)]),
        (2, 1, None, "TERMINATED", "FAILED", None, 2, None, None, None, None,
         [t("A", 21, "SUCCESS"), t("B", 22, None), t("C", 23, "CANCELED")]),
        (3, 1, None, "INTERNAL_ERROR", None, None, 3, None, None, None, None, []),
        (4, 1, None, "TERMINATED", "FAILED", None, 4, None, None, None, None, None),
        (5, 1, None, "TERMINATED", "SUCCESS", None, 5, None, None, None, None, [t("A", 51, "SUCCESS")]),
    ]
    runs = spark.createDataFrame(rows, S.RUNS)
    failed = R.classify_runs(runs).filter("is_failed")
    out = sorted((r.run_id, r.task_key, r.task_run_id, r.reason)
                 for r in R.failed_tasks(failed, R.explode_tasks(runs)).collect())
    assert out == [(1, "A", 11, "failed"), (2, "B", 22, "not_success"), (2, "C", 23, "not_success"),
                   (3, None, 3, "no_tasks"), (4, None, 4, "no_tasks")]


def test_eta_only_success_option(spark):
    rows = [run(1, rs="SUCCESS", exe=10000), run(2, rs="FAILED", exe=50000), run(3, rs="SUCCESS", exe=20000)]
    df = runs_df(spark, rows)
    assert R.run_eta(df).first().eta_seconds == pytest.approx(80 / 3)
    only = R.run_eta(df, only_success=True).first()
    assert only.runs_used == 2 and only.eta_seconds == pytest.approx(15.0)
