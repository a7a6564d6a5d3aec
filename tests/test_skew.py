"""Hot keys: one job / run / name holding a third of all rows gives exact results,
checked against brute force, and the plans pre-aggregate before the shuffle."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerline.operators import names
from ledgerline.operators import runs as R
from tests.oracle_compare import plan_text

N = 3000


def _runs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(N):
        job = 0 if i % 3 == 0 else rng.randint(1, 200)  # job 0 holds a third of all runs
        lc = rng.choice(["TERMINATED", "TERMINATED", "RUNNING", "INTERNAL_ERROR"])
        rows.append((i, job, lc, rng.choice([0, 1000, 2000, 61000, None]), rng.randint(0, 10**9)))
    df = spark.createDataFrame(rows, "run_id bigint, job_id bigint, life_cycle_state string, "
                                     "execution_duration bigint, start_time bigint")
    return rows, df.withColumn("result_state", F.lit("SUCCESS")).repartition(6)


def test_hot_job_eta_and_latest(spark):
    rows, df = _runs(spark)
    by_job = defaultdict(list)
    for r in rows:
        by_job[r[1]].append(r)
    want_eta, want_latest = {}, {}
    for job, rs in by_job.items():
        want_latest[job] = max(rs, key=lambda r: (r[4], r[0]))[0]
        done = sorted((r for r in rs if r[2] in ("TERMINATED", "INTERNAL_ERROR")),
                      key=lambda r: (r[4], r[0]), reverse=True)[:10]
        if done:
            used = [r[3] / 1000 for r in done if r[3]]
            want_eta[job] = (len(used), sum(used) / len(used) if used else None)
    got_eta = {r.job_id: (r.runs_used, r.eta_seconds) for r in R.run_eta(df).collect()}
    assert got_eta.keys() == want_eta.keys()
    for k, (n, v) in want_eta.items():
        assert got_eta[k][0] == n and (v is None and got_eta[k][1] is None or abs(got_eta[k][1] - v) < 1e-9)
    got_latest = {r.job_id: r.run_id for r in R.latest_run(df).collect()}
    assert got_latest == want_latest


def test_hot_run_failed_tasks(spark):
    rng = random.Random(5)
    tasks = []
    for i in range(N):
        run = 7 if i % 3 == 0 else rng.randint(8, 300)  # run 7 holds a third of all tasks
        tasks.append((run, f"t{i}", i, rng.choice(["SUCCESS", "FAILED", None, "CANCELED"]), None, None))
    tdf = spark.createDataFrame(tasks, "run_id bigint, task_key string, task_run_id bigint, "
                                       "result_state string, state_message string, "
                                       "termination struct<code:string,message:string>").repartition(5)
    failed = spark.createDataFrame([(r,) for r in range(7, 320)], "run_id bigint")
    by_run = defaultdict(list)
    for t in tasks:
        by_run[t[0]].append(t)
    want = set()
    for run in range(7, 320):
        ts = by_run.get(run, [])
        if not ts:
            want.add((run, None))
            continue
        bad = [t for t in ts if t[3] == "FAILED"] or [t for t in ts if t[3] != "SUCCESS"]
        want |= {(run, t[1]) for t in bad}
    got = {(r.run_id, r.task_key) for r in R.failed_tasks(failed, tdf).collect()}
    assert got == want
    plan = plan_text(R.failed_tasks(failed, tdf))
    assert "Window" not in plan  # per-run flags come from a partial aggregate, not a window


def test_hot_name_resolution(spark):
    rows = [(i, f"[dev u{i % 7}] hot_job_{i}", "BUNDLE" if i % 2 else None, f"u{i % 7}", None)
            for i in range(N // 3)]
    rows += [(N + i, f"other_{i}", None, None, None) for i in range(2 * N // 3)]
    jobs = spark.createDataFrame(rows, "job_id bigint, name string, deployment_kind string, "
                                       "creator_user_name string, run_as_user_name string").repartition(4)
    req = spark.createDataFrame([("hot", "u3"), ("hot_job_5", None), ("other", None)],
                                "wanted string, principal string")
    out = {r.wanted: (r.status, r.n_candidates, r.job_id) for r in names.resolve_jobs(jobs, req).collect()}
    managed_owned = [i for i in range(N // 3) if i % 2 and i % 7 == 3]
    assert out["hot"] == ("AMBIGUOUS", len(managed_owned), None)
    assert out["hot_job_5"] == ("RESOLVED", 1, 5)
    assert out["other"][0] == "AMBIGUOUS" and out["other"][1] == 2 * N // 3
    cands = names.ambiguous_candidates(jobs, req).filter(F.col("wanted") == "hot")
    assert sorted(r.job_id for r in cands.collect()) == managed_owned
