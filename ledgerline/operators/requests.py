"""The request flows of the job tools, each as one DataFrame plan over *all* requests at once:

* ``run_requests``    -- resolve the name, refuse duplicates, estimate duration
* ``status_requests`` -- the run asked for by id, or the newest run of the resolved name; its status
* ``status_details``  -- the failed tasks behind those runs, with their outputs
* ``cancel_requests`` -- the run asked for by id, or the newest active run of the resolved name

Requests name a job (``wanted``) and may carry a ``run_id``; those with one need no name.  The
request table is split by that, the parts are answered by two plans and united.  Triggering or
cancelling a run is a control-plane call and is not done here; these plans compute what such a
call would act on.  Every per-job input (active run, estimate, newest run) is a keyed aggregate
joined to the requests on ``job_id``; requests that resolved to no job are spread, not joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerline import schemas as S
from ledgerline.functions.text import duration_text, termination_summary, truthy_text
from ledgerline.functions.time import from_epoch_millis
from ledgerline.operators import runs as R
from ledgerline.operators.joins import counted, repeated, spread_join, spread_nulls
from ledgerline.operators.names import NOT_FOUND, RESOLVED, resolve_requests

BLOCKED, ALLOWED = "BLOCKED", "ALLOWED"
NO_RUNS, NO_ACTIVE_RUN, CANCEL = "NO_RUNS", "NO_ACTIVE_RUN", "CANCEL"

STATUS_FIELDS = ["run_name", "life_cycle_state", "result_state", "state_message",
                 "execution_duration", "run_duration", "run_page_url", "termination"]


def run_requests(jobs: DataFrame, runs: DataFrame, requests: DataFrame, principal: str | None = None,
                 prevent_duplicate: bool = True, sample: int = S.ETA_SAMPLE_RUNS) -> DataFrame:
    """Per request: resolution, then ``decision`` (NOT_FOUND / AMBIGUOUS / BLOCKED /
    ALLOWED), the blocking active run, and the duration estimate of allowed runs."""
    res = resolve_requests(jobs, requests, principal)
    j = spread_nulls(spread_nulls(res, R.active_per_job(runs), "job_id", by=["wanted"]), R.run_eta(runs, sample), "job_id", by=["wanted"])
    resolved = F.col("status") == F.lit(RESOLVED)
    blocked = resolved & F.lit(prevent_duplicate) & F.col("active_run_id").isNotNull()
    allowed = resolved & ~blocked
    return j.select(
        "wanted", "status", "n_candidates", "job_id", "job_name",
        F.when(~resolved, F.col("status")).when(blocked, F.lit(BLOCKED)).otherwise(F.lit(ALLOWED))
        .alias("decision"),
        F.when(blocked, F.col("active_run_id")).alias("active_run_id"),
        F.when(blocked, F.col("active_started")).alias("active_started"),
        F.when(allowed, F.coalesce(F.col("runs_used"), F.lit(0))).cast("bigint").alias("runs_used"),
        F.when(allowed, F.col("eta_seconds")).alias("eta_seconds"),
        F.when(allowed, F.col("eta_text")).alias("eta_text"),
    )


def _routed(jobs: DataFrame, named_runs: DataFrame, all_runs: DataFrame, requests: DataFrame, fields: list[str],
            principal: str | None) -> DataFrame:
    """Requests with the run each is about: the one of its ``run_id``, else its job's row of ``named_runs``.

    Adds ``status, n_candidates, job_id, job_name``, ``found_run_id``, ``start_time`` and ``fields``.
    A request by id is RESOLVED if the run exists, with the run's job; it has no candidates.
    """
    own = requests.columns
    by_id = "run_id" in own
    by_name = requests.filter("run_id is null") if by_id else requests
    named = resolve_requests(jobs, by_name, principal)
    found = named_runs.withColumnRenamed("run_id", "found_run_id")
    answered = spread_nulls(named, found.select("job_id", "found_run_id", "start_time", *fields), "job_id", by=["wanted"])
    if not by_id:
        return answered
    asked = counted(requests.filter("run_id is not null").withColumn("_ask", F.col("run_id")))
    asked_sizes = asked.groupBy("_ask").agg(F.count(F.lit(1)).alias("n"))
    # Only runs that are asked for travel on; a run that many requests ask for is dealt into shares.
    target = asked_sizes.select("_ask").join(all_runs.select(
        F.col("run_id").alias("_ask"), "job_id", F.col("run_id").alias("found_run_id"), "start_time", *fields), "_ask", "left")
    named_job = spread_nulls(target, jobs.select("job_id", F.col("name").alias("job_name")), "job_id", by=["_ask"])
    direct = spread_join(asked, named_job, ["_ask"], asked_sizes, by=own).drop("_ask").withColumns({
        "status": F.when(F.col("found_run_id").isNull(), F.lit(NOT_FOUND)).otherwise(F.lit(RESOLVED)),
        "n_candidates": F.lit(0).cast("bigint")})
    return answered.unionByName(repeated(direct).select(*answered.columns))


def status_requests(jobs: DataFrame, runs: DataFrame, requests: DataFrame,
                    principal: str | None = None) -> DataFrame:
    """Per request: resolution and the status header of its run (by ``run_id``, else the job's newest).

    ``run_outcome`` is NO_RUNS for a resolved job without runs; the displayed
    name falls back to the requested name when the run name is empty.
    """
    newest = R.newest_per_job(runs, STATUS_FIELDS)
    j = _routed(jobs, newest, runs, requests, STATUS_FIELDS, principal)
    resolved = F.col("status") == F.lit(RESOLVED)
    has_run = F.col("found_run_id").isNotNull()
    lc, rs = F.col("life_cycle_state"), F.col("result_state")
    ms = R.run_duration_ms(F.col("execution_duration"), F.col("run_duration"))
    failed = R.is_failed_run(rs, lc)
    return j.select(
        "wanted", "status", "n_candidates", "job_id", "job_name", F.col("found_run_id").alias("run_id"),
        F.when(has_run, F.coalesce(truthy_text(F.col("run_name")), F.col("wanted"))).alias("run_label"),
        F.when(has_run, F.coalesce(lc, F.lit(S.UNKNOWN_LIFE_CYCLE))).alias("life_cycle"),
        rs.alias("result_state"),
        from_epoch_millis(F.col("start_time")).alias("started"),
        ms.alias("duration_ms"),
        duration_text(ms).alias("duration_text"),
        F.when(has_run, truthy_text(F.col("run_page_url"))).alias("run_page_url"),
        F.when(~resolved, F.lit(None).cast("string"))
        .when(~has_run, F.lit(NO_RUNS)).otherwise(R.outcome(rs, lc)).alias("run_outcome"),
        F.when(has_run & failed, truthy_text(F.col("state_message"))).alias("failure_message"),
        F.when(has_run & failed, termination_summary(F.col("termination.code"),
                                                     F.col("termination.message")))
        .alias("termination_summary"),
    )


def status_details(jobs: DataFrame, runs: DataFrame, tasks: DataFrame | None, outputs: DataFrame, requests: DataFrame,
                   principal: str | None = None) -> DataFrame:
    """The failure part of the status answers: a row per request, failed run and task to report.

    ``wanted, run_id, task_key, task_run_id, reason, result_state, state_message,
    termination_summary, error, trace_tail, notebook_result, output_found, note``.  With ``tasks``
    null the runs carry their tasks (``tasks`` array).  Each failed run is worked out once,
    however many requests ask for it.
    """
    fields = ["life_cycle_state", "result_state"]
    j = _routed(jobs, R.newest_per_job(runs, fields), runs, requests, fields, principal)
    asked = j.filter(R.is_failed_run(F.col("result_state"), F.col("life_cycle_state"))).select("wanted", F.col("found_run_id").alias("run_id"))
    wanted_runs = asked.select("run_id").distinct()
    if tasks is None:
        selected = R.nested_failed_tasks(runs.join(wanted_runs, "run_id"))
    else:
        selected = R.failed_tasks(wanted_runs, tasks)
    told = R.task_errors(selected, outputs, carry=["result_state", "state_message", "termination_summary"])
    return asked.join(told, "run_id").select(
        "wanted", "run_id", "task_key", "task_run_id", "reason", "result_state", "state_message", "termination_summary",
        "error", "trace_tail", "notebook_result", "output_found", "note")


def cancel_requests(jobs: DataFrame, runs: DataFrame, requests: DataFrame,
                    principal: str | None = None) -> DataFrame:
    """Per request: resolution and the run a cancel would target.

    By ``run_id`` it is that run, active or not, as the call is made without looking; else the
    newest active run of the resolved job.
    """
    j = _routed(jobs, R.cancel_candidates(runs), runs, requests, [], principal)
    resolved = F.col("status") == F.lit(RESOLVED)
    return j.select(
        "wanted", "status", "n_candidates", "job_id", "job_name", F.col("found_run_id").alias("cancel_run_id"),
        from_epoch_millis(F.col("start_time")).alias("cancel_run_started"),
        F.when(~resolved, F.col("status")).when(F.col("found_run_id").isNull(), F.lit(NO_ACTIVE_RUN))
        .otherwise(F.lit(CANCEL)).alias("action"),
    )
