"""Run-history operators over ``runs`` / ``run_tasks`` / ``task_outputs`` tables.

All of them work on every job and run at once (keyed by ``job_id`` /
``run_id``) instead of one API record at a time:

* per-job "latest" selections are ``groupBy`` + ``max(struct(order keys, ...))``
  (partial aggregation; a hot job costs one partial row per map task);
* the last-N sample for duration estimates is a ``row_number`` window with a
  ``<= N`` filter, which Spark plans as a partial + final ``WindowGroupLimit``
  so at most N rows per job per task cross the shuffle;
* per-run "any failed task?" flags are a ``groupBy`` joined back in salted shares,
  so a run with a huge task list does not end up in one reducer; where runs carry
  their tasks as an array, the choice is made inside the row;
* task outputs are cut to their last 4000 characters *before* the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline import schemas as S
from ledgerline.functions.text import (
    duration_text,
    iso_text,
    minutes_seconds_text,
    tail,
    termination_summary,
    truthy_text,
)
from ledgerline.functions.time import from_epoch_millis
from ledgerline.operators.joins import spread_join, spread_nulls

# --- fixed values: why a task is reported -------------------------------------------
REASON_FAILED, REASON_NOT_SUCCESS, REASON_NO_TASKS = "failed", "not_success", "no_tasks"
FAILED, RUNNING, SUCCESS, OTHER = "FAILED", "RUNNING", "SUCCESS", "OTHER"


# ---- scalar predicates -----------------------------------------------------------

def is_active(life_cycle: Column) -> Column:
    return F.coalesce(life_cycle.isin(*S.ACTIVE_LIFE_CYCLE_STATES), F.lit(False))


def is_completed(life_cycle: Column) -> Column:
    return F.coalesce(life_cycle.isin(*S.TERMINAL_LIFE_CYCLE_STATES), F.lit(False))


def is_failed_state(result_state: Column) -> Column:
    return F.coalesce(result_state.isin(*S.FAILED_RESULT_STATES), F.lit(False))


def is_failed_run(result_state: Column, life_cycle: Column) -> Column:
    """Failed result state, or an INTERNAL_ERROR life cycle."""
    return is_failed_state(result_state) | F.coalesce(life_cycle == F.lit(S.INTERNAL_ERROR), F.lit(False))


def outcome(result_state: Column, life_cycle: Column) -> Column:
    """FAILED, else RUNNING, else SUCCESS, else OTHER (e.g. CANCELED, PENDING)."""
    return (F.when(is_failed_run(result_state, life_cycle), F.lit(FAILED))
            .when(F.coalesce(life_cycle == F.lit(RUNNING), F.lit(False)), F.lit(RUNNING))
            .when(F.coalesce(result_state == F.lit(SUCCESS), F.lit(False)), F.lit(SUCCESS))
            .otherwise(F.lit(OTHER)))


def run_duration_ms(execution_ms: Column, run_ms: Column) -> Column:
    """``execution_duration or run_duration``; null when that is 0 or null."""
    return F.nullif(F.coalesce(F.nullif(execution_ms, F.lit(0)), run_ms), F.lit(0))


# ---- per-run projections -----------------------------------------------------------

def classify_runs(runs: DataFrame) -> DataFrame:
    """``run_id, job_id, life_cycle_state, result_state, is_failed, outcome``."""
    lc, rs = F.col("life_cycle_state"), F.col("result_state")
    return runs.select("run_id", "job_id", "life_cycle_state", "result_state",
                       is_failed_run(rs, lc).alias("is_failed"), outcome(rs, lc).alias("outcome"))


def run_durations(runs: DataFrame) -> DataFrame:
    """``run_id, duration_ms, duration_seconds, duration_text`` (null when no duration)."""
    ms = run_duration_ms(F.col("execution_duration"), F.col("run_duration"))
    return runs.select("run_id", ms.alias("duration_ms")).select(
        "run_id", "duration_ms",
        (F.col("duration_ms") / 1000.0).alias("duration_seconds"),
        duration_text(F.col("duration_ms")).alias("duration_text"),
    )


def run_started(runs: DataFrame) -> DataFrame:
    """``run_id, start_time, started, started_iso``; 0/null start means not started."""
    started = from_epoch_millis(F.col("start_time"))
    return runs.select("run_id", "start_time", started.alias("started"),
                       iso_text(started).alias("started_iso"))


def termination_text(runs: DataFrame) -> DataFrame:
    """``run_id, termination_summary`` ('code - message', parts optional)."""
    return runs.select("run_id", termination_summary(F.col("termination.code"),
                                                     F.col("termination.message"))
                       .alias("termination_summary"))


def run_status(runs: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """The status header of every run.

    ``job_name`` is the run name, or the job's name when the run name is empty;
    ``life_cycle_state`` defaults to UNKNOWN; duration and start are omitted
    (null) when zero or missing.
    """
    r = runs
    name = truthy_text(F.col("run_name"))
    if jobs is not None:
        r = r.join(jobs.select("job_id", F.col("name").alias("_job_name")), "job_id", "left")
        name = F.coalesce(name, F.col("_job_name"))
    ms = run_duration_ms(F.col("execution_duration"), F.col("run_duration"))
    lc, rs = F.col("life_cycle_state"), F.col("result_state")
    return r.select(
        "run_id", "job_id",
        name.alias("job_name"),
        F.coalesce(lc, F.lit(S.UNKNOWN_LIFE_CYCLE)).alias("life_cycle"),
        rs.alias("result_state"),
        from_epoch_millis(F.col("start_time")).alias("started"),
        ms.alias("duration_ms"),
        duration_text(ms).alias("duration_text"),
        truthy_text(F.col("run_page_url")).alias("run_page_url"),
        outcome(rs, lc).alias("outcome"),
        F.when(is_failed_run(rs, lc), truthy_text(F.col("state_message"))).alias("failure_message"),
    )


# ---- per-job selections -------------------------------------------------------------

def newest_per_job(runs: DataFrame, fields: list[str]) -> DataFrame:
    """Newest run of every job by (start_time, run_id), carrying ``fields``."""
    top = F.max(F.struct(F.col("start_time"), F.col("run_id"), *[F.col(f) for f in fields]))
    return runs.groupBy("job_id").agg(top.alias("_top")).select(
        "job_id", F.col("_top.run_id").alias("run_id"), F.col("_top.start_time").alias("start_time"),
        *[F.col(f"_top.{f}").alias(f) for f in fields])


def latest_run(runs: DataFrame) -> DataFrame:
    """Newest run of every job (by start time, then run id)."""
    return newest_per_job(runs, ["life_cycle_state", "result_state"]).withColumn(
        "started", from_epoch_millis(F.col("start_time")))


def cancel_candidates(runs: DataFrame) -> DataFrame:
    """Newest *active* run of every job: the run a cancel request would target."""
    active = runs.filter(is_active(F.col("life_cycle_state")))
    return newest_per_job(active, ["life_cycle_state"]).withColumn(
        "started", from_epoch_millis(F.col("start_time")))


def run_eta(runs: DataFrame, sample: int = S.ETA_SAMPLE_RUNS, only_success: bool = False) -> DataFrame:
    """Duration estimate per job from its newest ``sample`` completed runs.

    The sample is taken first, then runs without a usable execution duration
    (null or 0) are dropped; the estimate is the mean in seconds over the rest.
    ``runs_used`` = 0 and a null estimate mean "cannot estimate".
    """
    done = runs.filter(is_completed(F.col("life_cycle_state")))
    if only_success:
        done = done.filter(F.col("result_state") == F.lit(SUCCESS))
    w = Window.partitionBy("job_id").orderBy(F.col("start_time").desc_nulls_last(), F.col("run_id").desc())
    newest = done.select("job_id", "execution_duration",
                         F.row_number().over(w).alias("_rn")).filter(F.col("_rn") <= sample)
    usable = F.nullif(F.col("execution_duration"), F.lit(0))
    est = newest.groupBy("job_id").agg(
        F.count(usable).alias("runs_used"),
        # Whole milliseconds are summed and divided once, so the order of rows can't matter.
        (F.sum(usable) / F.count(usable) / 1000.0).alias("eta_seconds"),
    )
    return est.withColumn("eta_text", F.when(F.col("eta_seconds").isNotNull(),
                                             minutes_seconds_text(F.col("eta_seconds").cast("bigint"))))


def active_per_job(runs: DataFrame) -> DataFrame:
    """Per job with active runs: the newest active run, its start, and how many are active."""
    active = runs.filter(is_active(F.col("life_cycle_state")))
    return active.groupBy("job_id").agg(
        F.max(F.struct("start_time", "run_id")).alias("_top"),
        F.count(F.lit(1)).alias("active_runs"),
    ).select("job_id", F.col("_top.run_id").alias("active_run_id"),
             from_epoch_millis(F.col("_top.start_time")).alias("active_started"), "active_runs")


def blocked_requests(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Requests refused as duplicates: their job has an active run (newest reported)."""
    return requests.join(active_per_job(runs), "job_id", "inner")


def allowed_requests(requests: DataFrame, runs: DataFrame, sample: int = S.ETA_SAMPLE_RUNS) -> DataFrame:
    """Requests that may run (no active run), with their duration estimate."""
    # Distinct first: a hot job's active runs collapse to one row per task
    # (partial aggregation) before the anti join sees them.
    active_jobs = runs.filter(is_active(F.col("life_cycle_state"))).select("job_id").distinct()
    allowed = requests.join(active_jobs, "job_id", "left_anti")
    eta = run_eta(runs, sample)
    return allowed.join(eta, "job_id", "left").select(
        *requests.columns,
        F.coalesce(F.col("runs_used"), F.lit(0)).cast("bigint").alias("runs_used"),
        "eta_seconds", "eta_text")


# ---- failed tasks ---------------------------------------------------------------------

def explode_tasks(runs: DataFrame) -> DataFrame:
    """Flatten a nested ``tasks ARRAY<STRUCT>`` column into ``run_tasks`` rows."""
    t = runs.select(F.col("run_id").alias("_parent"), F.explode("tasks").alias("t"))
    return t.select(F.col("_parent").alias("run_id"), F.col("t.task_key").alias("task_key"),
                    F.col("t.run_id").alias("task_run_id"), F.col("t.result_state").alias("result_state"),
                    F.col("t.state_message").alias("state_message"),
                    F.col("t.termination").alias("termination"))


def failed_tasks(failed_runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks to report for each failed run.

    Tasks in a failed result state; if a run has none, every task not in
    SUCCESS (a null state counts); a run without tasks reports itself
    (``task_key`` null, ``task_run_id`` = run id).  ``reason`` says which.
    Runs and tasks are summed up by run in one aggregate, so the failed runs are never sorted nor
    joined to find those without tasks, and the tasks of a heavy run are dealt into shares, so a
    run with a third of all tasks is many tasks.
    """
    state = F.col("result_state")
    # A task without a run belongs to none, also not to a failed run without an id.
    tasks = tasks.filter("run_id is not null")
    asked = failed_runs.select("run_id", F.lit(True).alias("_asked"), F.lit(None).cast("boolean").alias("_failed"))
    known = asked.unionByName(tasks.select("run_id", F.lit(False).alias("_asked"), is_failed_state(state).alias("_failed")))
    flags = known.groupBy("run_id").agg(F.max("_asked").alias("_asked"), F.max("_failed").alias("_any_failed")).filter("_asked")
    sizes = tasks.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    chosen = (
        spread_join(tasks.filter(~state.eqNullSafe(F.lit(SUCCESS))),
                    flags.filter("_any_failed is not null").select("run_id", "_any_failed"),
                    ["run_id"], sizes, by=["task_run_id", "task_key"])
        .filter(~F.col("_any_failed") | is_failed_state(state))
        .select("run_id", "task_key", "task_run_id", "result_state", "state_message",
                termination_summary(F.col("termination.code"), F.col("termination.message"))
                .alias("termination_summary"),
                F.when(F.col("_any_failed"), F.lit(REASON_FAILED)).otherwise(F.lit(REASON_NOT_SUCCESS))
                .alias("reason"))
    )
    # Dealt out anew, by another key than they are grouped by: within the union the aggregate would get few
    # partitions of many ids, as ids alone shuffle small.
    bare = flags.filter("_any_failed is null").select("run_id").repartition(F.xxhash64("run_id")).select(
        "run_id", F.lit(None).cast("string").alias("task_key"), F.col("run_id").alias("task_run_id"),
        F.lit(None).cast("string").alias("result_state"), F.lit(None).cast("string").alias("state_message"),
        F.lit(None).cast("string").alias("termination_summary"), F.lit(REASON_NO_TASKS).alias("reason"))
    return chosen.unionByName(bare)


def with_failed_tasks(runs: DataFrame) -> DataFrame:
    """``runs`` with ``selected_tasks``: what :func:`failed_tasks` reports of each failed run, from the nested ``tasks``.

    Decided inside the row with array functions: no task is exploded and no run is shuffled.  Runs
    that didn't fail have a null there; a null or empty ``tasks`` makes the run report itself.
    """
    def failed(t: Column) -> Column:
        return is_failed_state(t["result_state"])

    tasks = F.col("tasks")
    any_failed = F.exists(tasks, failed)
    chosen = F.when(any_failed, F.filter(tasks, failed)).otherwise(
        F.filter(tasks, lambda t: ~t["result_state"].eqNullSafe(F.lit(SUCCESS))))
    reason = F.when(any_failed, F.lit(REASON_FAILED)).otherwise(F.lit(REASON_NOT_SUCCESS))

    def row(key, run_id, state, message, summary, why) -> Column:
        return F.struct(key.cast("string").alias("task_key"), run_id.cast("bigint").alias("task_run_id"), state.cast("string").alias("result_state"),
                        message.cast("string").alias("state_message"), summary.cast("string").alias("termination_summary"), why.alias("reason"))

    none = F.lit(None)
    selected = F.transform(chosen, lambda t: row(
        t["task_key"], t["run_id"], t["result_state"], t["state_message"],
        termination_summary(t["termination"]["code"], t["termination"]["message"]), reason))
    itself = F.array(row(none, F.col("run_id"), none, none, none, F.lit(REASON_NO_TASKS)))
    reported = F.when(F.coalesce(F.size(tasks), F.lit(0)) <= 0, itself).otherwise(selected)
    return runs.withColumn("selected_tasks", F.when(is_failed_run(F.col("result_state"), F.col("life_cycle_state")), reported))


def nested_failed_tasks(runs: DataFrame) -> DataFrame:
    """The rows of :func:`failed_tasks` from runs that carry their tasks; only selected tasks become rows."""
    return with_failed_tasks(runs).filter("selected_tasks is not null").select("run_id", F.inline("selected_tasks"))


def task_errors(selected: DataFrame, outputs: DataFrame, tail_chars: int = S.TRACE_TAIL_CHARS,
                carry: list[str] | None = None) -> DataFrame:
    """Attach each selected task's output: error, trace tail, notebook result.

    ``output_found`` is false when no output row exists; ``note`` carries the
    placeholder when an output exists but records nothing.  Tasks with a
    falsy task run id are not looked up (the run-itself row always is).
    Columns of ``selected`` named in ``carry`` come along.
    """
    out = outputs.select(
        "task_run_id",
        truthy_text(F.col("error")).alias("error"),
        truthy_text(tail(F.col("error_trace"), tail_chars)).alias("trace_tail"),
        truthy_text(F.col("notebook_result")).alias("notebook_result"),
        F.lit(True).alias("_found"),
    )
    looked_up = (F.col("reason") == F.lit(REASON_NO_TASKS)) | F.coalesce(F.col("task_run_id") != 0, F.lit(False))
    sel = selected.select("run_id", "task_key", "task_run_id", "reason", *(carry or [])).withColumn("_lookup", looked_up)
    # Rows that aren't looked up have no key; they are spread over all tasks.
    sel = sel.withColumn("_asked", F.when(F.col("_lookup"), F.col("task_run_id")))
    j = spread_nulls(sel, out.withColumnRenamed("task_run_id", "_asked"), "_asked", by=["run_id", "task_key"])
    found = F.coalesce(F.col("_found"), F.lit(False))
    details = F.col("error").isNotNull() | F.col("trace_tail").isNotNull() | F.col("notebook_result").isNotNull()
    return j.select(
        "run_id", "task_key", "task_run_id", "reason", *(carry or []),
        "error", "trace_tail", "notebook_result",
        found.alias("output_found"),
        F.when(found & ~details, F.lit(S.NO_TRACE_NOTE)).alias("note"),
    )
