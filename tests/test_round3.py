"""Nested tasks, counts before joins, hot keys without broadcasts, checked landing, versions, overflow, ranks, JSON types, drift."""

import random
import time
from collections import Counter
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline import schemas as S
from ledgerline.operators import joins, names, quality, requests, sales
from ledgerline.operators import runs as R
from ledgerline.operators.summaries import flatten_summary
from ledgerline.plans import tables
from ledgerline.plans.pipeline import run_pipeline
from ledgerline.sources.generate import synthetic_orders
from ledgerline.sources.tables import SchemaDrift, check_drift
from tests.oracle_compare import plan_text

JOBS = "job_id long, name string, deployment_kind string, creator_user_name string, run_as_user_name string"
TASKS = ("run_id bigint, task_key string, task_run_id bigint, result_state string, state_message string, "
         "termination struct<code:string,message:string>")
STATES = ["SUCCESS", "FAILED", None, "CANCELED", "TIMEDOUT"]


@pytest.fixture
def no_broadcast(spark):
    """Joins as between large tables: no automatic broadcast, no coalescing of small partitions."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def largest_task(df):
    """The most rows that one partition of the result has, and all rows."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes), sum(sizes)


# ---- R15 -------------------------------------------------------------------------------

def nested(spark, rows):
    task = "struct<task_key:string,run_id:bigint,result_state:string,state_message:string,termination:struct<code:string,message:string>>"
    return spark.createDataFrame(rows, f"run_id bigint, life_cycle_state string, result_state string, tasks array<{task}>")


def test_nested_tasks_equal_exploded_ones(spark):
    rng = random.Random(1)
    rows = []
    for run in range(300):
        tasks = [(f"t{k}", rng.choice([0, None, run * 10 + k]), rng.choice(STATES), rng.choice([None, "m"]),
                  rng.choice([None, ("C", None), ("", "x")])) for k in range(rng.randint(0, 5))]
        rows.append((run, rng.choice(["TERMINATED", "INTERNAL_ERROR", None]), rng.choice(STATES), rng.choice([tasks, tasks, None])))
    runs = nested(spark, rows)
    failed = runs.filter(R.is_failed_run(F.col("result_state"), F.col("life_cycle_state")))
    want = R.failed_tasks(failed, R.explode_tasks(runs.filter("tasks is not null")))
    got = R.nested_failed_tasks(runs)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.select(*got.columns).collect()))
    plan = plan_text(R.with_failed_tasks(runs))
    assert "Exchange" not in plan and "Generate" not in plan and "Window" not in plan


def test_hot_run_is_many_tasks(spark, no_broadcast):
    rows = [(7 if i % 3 == 0 else i, f"t{i}", i, "FAILED" if i % 2 else None, None, None) for i in range(30_000)]
    tasks = spark.createDataFrame(rows, TASKS).repartition(6)
    failed = spark.createDataFrame([(r,) for r in range(30_000)], "run_id bigint")
    got = R.failed_tasks(failed, tasks)
    most, all_rows = largest_task(got)
    hot = [r for r in rows if r[0] == 7 and r[3] == "FAILED"]
    assert got.filter("run_id = 7").count() == len(hot) and all_rows > 15_000
    assert most < all_rows / 4


def test_spread_join_is_a_join(spark):
    many = spark.range(5000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 90).alias("k"), "id")
    few = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    few = few.unionByName(few.filter("k < 3"))
    sizes = many.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = joins.spread_join(many, few, ["k"], sizes, by=["id"])
    assert Counter(map(tuple, got.select("k", "id", "v").collect())) == Counter(map(tuple, many.join(few, "k").select("k", "id", "v").collect()))
    assert 1 <= joins.heavy_keys(sizes, ["k"]).count() < joins.HEAVY
    empty = joins.spread_join(many.limit(0), few, ["k"], sizes.limit(0), by=["id"])
    assert empty.count() == 0
    left = spark.createDataFrame([(None, 1), (None, 2), (5, 3), (6, 4)], "k long, id long")
    got = joins.spread_nulls(left, few.select("k", "v").distinct(), "k", by=["id"]).collect()
    assert sorted((r.id, r.v) for r in got if r.v is not None) == [(3, 10), (4, 12)] and len(got) == 4
    rows = spark.createDataFrame([("a", 3), ("b", 1), ("c", 9000)], "x string, _times long")
    assert {r.x: r["count"] for r in joins.repeated(rows).groupBy("x").count().collect()} == {"a": 3, "b": 1, "c": 9000}


# ---- R5, R20 ---------------------------------------------------------------------------

def brute_resolve(jobs, wanted, principal):
    import re

    base = [re.sub(r"^\[[^\]]*\]\s*", "", j[1]) if j[1] else None for j in jobs]
    found = [j for j, b in zip(jobs, base) if j[1] and wanted is not None and (j[1] == wanted or b == wanted or b.startswith(wanted + "_"))]
    for keep in (lambda j: j[2] is not None, lambda j: bool(principal) and principal.lower() in ((j[3] or "").lower(), (j[4] or "").lower())):
        if len(found) > 1:
            found = [j for j in found if keep(j)] or found
    return found


def test_many_callers_repeated_names_nulls(spark):
    rng = random.Random(9)
    jobs = [(i, rng.choice(["[dev a] hot_x", "hot", "hot_y", "cold", "[b] cold_z", "_odd", "", None, f"solo_{i}"]),
             rng.choice([None, "BUNDLE"]), rng.choice(["Ann", "bob", "", None]), rng.choice(["ANN", "Cy", None])) for i in range(120)]
    asked = [(rng.choice(["hot", "cold", "solo_3", "hot_x", "", None, "none", "solo", "_odd"]), rng.choice(["ann", "BOB", "cy", "", None, "zed"]))
             for _ in range(400)]
    table, want = spark.createDataFrame(jobs, JOBS), Counter()
    for w, p in asked:
        found = brute_resolve(jobs, w, p)
        one = found[0] if len(found) == 1 else (None, None)
        want[w, "NOT_FOUND" if not found else "RESOLVED" if len(found) == 1 else "AMBIGUOUS", len(found), one[0], one[1]] += 1
    req = spark.createDataFrame(asked, "wanted string, principal string")
    assert Counter(map(tuple, names.resolve_jobs(table, req).collect())) == want
    listed = Counter((r.wanted, r.job_id) for r in names.ambiguous_candidates(table, req).collect())
    callers = {(w, (p or "").lower()) for w, p in asked}
    assert listed == Counter((w, j[0]) for w, p in callers for f in [brute_resolve(jobs, w, p)] if len(f) > 1 for j in f)
    # Other columns of the requests come along, with a row each.
    with_id = req.withColumn("request_id", F.monotonically_increasing_id())
    assert names.resolve_requests(table, with_id).select("request_id").distinct().count() == len(asked)


def test_hot_name_is_many_tasks(spark, no_broadcast):
    rows = [(i, f"hot_{i}" if i % 3 == 0 else f"other{i}", None, f"u{i % 5}", None) for i in range(12_000)]
    jobs = spark.createDataFrame(rows, JOBS).repartition(8)
    req = spark.createDataFrame([("hot", None), ("other7", "x")] + [("hot", f"u{k}") for k in range(3)], "wanted string, principal string")
    most, all_rows = largest_task(names.ambiguous_candidates(jobs, req))
    assert all_rows == 4000 + sum(1 for i in range(0, 12_000, 3) if i % 5 < 3) and most < all_rows / 3
    # Jobs are counted before they meet a request: nothing is joined below the aggregates by key.
    counts = plan_text(names.key_counts(jobs))
    assert "Join" not in counts and counts.count("HashAggregate") >= 2


# ---- §3.3 ------------------------------------------------------------------------------

RUNS = ("run_id bigint, job_id bigint, run_name string, life_cycle_state string, result_state string, state_message string, "
        "start_time bigint, execution_duration bigint, run_duration bigint, run_page_url string, termination struct<code:string,message:string>")


def test_requests_by_run_id_and_by_name(spark):
    jobs = spark.createDataFrame([(1, "etl", None, None, None)], JOBS)
    runs = spark.createDataFrame([
        (10, 1, "", "TERMINATED", "FAILED", "boom", 1000, 61000, None, "u", ("C", "m")), (11, 1, "n", "RUNNING", None, None, 2000, None, None, None, None),
        (20, 9, "gone job", "INTERNAL_ERROR", None, None, 5, None, None, None, None)], RUNS)
    tasks = spark.createDataFrame([(10, "a", 100, "FAILED", "x", None), (10, "b", 101, "SUCCESS", None, None)], TASKS)
    outputs = spark.createDataFrame([(100, "err", "trace", None), (20, None, None, None)],
                                    "task_run_id bigint, error string, error_trace string, notebook_result string")
    req = spark.createDataFrame([(10, "etl"), (None, "etl"), (20, None), (99, "etl"), (None, "no"), (10, "etl")], "run_id long, wanted string")
    st = requests.status_requests(jobs, runs, req, principal="me").collect()
    assert Counter((r.wanted, r.status, r.run_id, r.run_label, r.run_outcome, r.failure_message) for r in st) == Counter([
        ("etl", "RESOLVED", 10, "etl", "FAILED", "boom")] * 2 + [("etl", "RESOLVED", 11, "n", "RUNNING", None),
        (None, "RESOLVED", 20, "gone job", "FAILED", None), ("etl", "NOT_FOUND", None, None, None, None), ("no", "NOT_FOUND", None, None, None, None)])
    det = requests.status_details(jobs, runs, tasks, outputs, req).collect()
    assert sorted((r.run_id, r.task_key, r.reason, r.error, r.note) for r in det) == [
        (10, "a", "failed", "err", None)] * 2 + [(20, None, "no_tasks", None, S.NO_TRACE_NOTE)]
    ca = requests.cancel_requests(jobs, runs, req).collect()
    assert Counter((r.wanted, r.cancel_run_id, r.action) for r in ca) == Counter([
        ("etl", 10, "CANCEL")] * 2 + [("etl", 11, "CANCEL"), (None, 20, "CANCEL"), ("etl", None, "NOT_FOUND"), ("no", None, "NOT_FOUND")])


# ---- D1, S2 ----------------------------------------------------------------------------

def test_source_is_read_once_and_refused_batches_stay_out(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    source = synthetic_orders(spark, 3000)
    schema = tables.scratch_schema(spark)
    done = run_pipeline(spark, schema, source=source.mapInArrow(count, source.schema), domains={"status": S.ORDER_STATUSES})
    assert (done.landed_rows, read.value, done.refused_rows) == (3000, 3000, 0)
    for bad, told in [(source.withColumn("quantity", F.lit(0)), "quantity_below_one=3000"), (source.unionByName(source), "duplicate_order_id=3000"),
                      (source.withColumn("region", F.lit(None).cast("string")), "null_region=3000")]:
        with pytest.raises(quality.QualityError, match=told):
            run_pipeline(spark, schema, source=bad)
        assert spark.table(done.raw_table).count() == 3000


# ---- S7 --------------------------------------------------------------------------------

def report(spark, region="us", gross="10.00"):
    one = [(region, "w", 1, Decimal(gross), Decimal(gross), 1.0, datetime(2024, 1, 1), datetime(2025, 1, 1))]
    return spark.createDataFrame(one, "region string, product string, order_count bigint, gross_revenue decimal(20,2), "
                                      "net_revenue decimal(20,2), avg_order_value double, latest_order timestamp_ntz, ingested_at timestamp_ntz")


def test_a_job_that_dies_before_the_switch_changes_nothing(spark, monkeypatch):
    table = tables.table_name(tables.scratch_schema(spark), S.REPORT_TABLE)
    tables.publish(report(spark), table)
    place = tables.current_version(spark, table)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(tables, "_promote", killed)
        with pytest.raises(KeyboardInterrupt):
            tables.publish(report(spark, "eu"), table)
    spark.catalog.refreshTable(table)
    assert tables.current_version(spark, table) == place and spark.table(table).first().region == "us"
    old = spark.read.parquet(place)
    tables.publish(report(spark, "eu"), table)
    assert spark.table(table).first().region == "eu" and old.first().region == "us"  # a reader of the old version goes on
    time.sleep(0.01)
    assert tables.expire_versions(spark, table, retain_seconds=0) == 2  # the old one and what the killed job left
    assert spark.table(table).first().region == "eu"


def test_changed_comment_is_refused(spark):
    table = tables.table_name(tables.scratch_schema(spark), S.REPORT_TABLE)
    columns = [(n, k, "other" if n == "product" else c) for n, k, c in S.SALES_COLUMNS]
    tables.declare_contract(spark, table, columns)
    with pytest.raises(tables.ContractError):
        tables.publish(report(spark), table)


# ---- P4, O1, D2 ------------------------------------------------------------------------

def test_groups_that_do_not_fit_are_named(spark):
    orders = synthetic_orders(spark, 2000).withColumn(
        "quantity", F.when(F.col("region") == "us-east", F.col("quantity") * 50_000_000).otherwise(F.col("quantity")))
    totals = sales.sales_totals(orders)
    refused = sales.refused_groups(totals).collect()
    fitting = sales.sales_by_region(orders, with_ingested_at=False, overflow="refuse").collect()
    assert refused and {r.region for r in refused} == {"us-east"} and all(r.gross_revenue >= 10**10 for r in refused)
    assert len(refused) + len(fitting) == totals.count()
    with pytest.raises(Exception, match="don't fit the report: us-east"):
        sales.sales_by_region(orders).collect()
    schema = tables.scratch_schema(spark)
    done = run_pipeline(spark, schema, source=orders)
    assert (done.published_rows, done.refused_rows) == (len(fitting), len(refused))
    assert {(r.region, r["product"]) for r in spark.table(done.refused_table).collect()} == {(r.region, r["product"]) for r in refused}


def test_rank_has_no_single_task_and_counts_on(spark):
    rng = random.Random(4)
    rows = [(f"r{i % 7}", f"p{i}", Decimal(rng.choice(["1.00", "2.50", "2.50", "9.99", str(i)])) if i % 11 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "region string, product string, net_revenue decimal(12,2)").repartition(5)
    ranked = sales.sales_ranked(df, parts=7)
    got = ranked.collect()
    want = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0], r[1]))
    assert [(r.region, r["product"], r.net_revenue, r.net_rank) for r in got] == [(*r, k) for k, r in enumerate(want, 1)]
    assert "Window" in plan_text(ranked) and "SinglePartition" not in plan_text(ranked).split("Subqueries")[0]
    assert sales.sales_ranked(df.limit(0)).count() == 0


def test_fingerprint_ignores_order_and_sees_repeats_and_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None), (None, "b")], "x long, y string")
    one = tables.fingerprint(df).first()
    assert tables.fingerprint(df.orderBy(F.desc("x")).repartition(3).select("y", "x")).first() == one
    for other in (df.distinct(), df.unionByName(df), df.withColumn("y", F.col("y").substr(1, 0)), df.limit(0),
                  spark.createDataFrame([(1, "a"), (2, None), (None, "b"), (None, "b")], "x long, y string")):
        assert tables.fingerprint(other).first() != one


# ---- R19 -------------------------------------------------------------------------------

def test_ids_by_json_type(spark):
    values = {"0": None, '"0"': "0", "false": None, '"false"': "false", "true": "true", "null": None, "[]": None, "{}": None, '""': None,
              "0.0": None, "-0.0": None, "7": "7", '"[]"': "[]", "[1]": "[1]", "12345678901234567890": "12345678901234567890", '" "': " "}
    rows = [(k, '{"resources":{"jobs":{"j":{"id":%s}}}}' % v) for k, v in enumerate(values)]
    got = {r.target: r.job_id for r in flatten_summary(spark.createDataFrame(rows, "target long, summary_json string")).collect()}
    assert [got[k] for k in range(len(values))] == list(values.values())


def test_repeated_keys_keep_the_last_value(spark):
    texts = ['{"resources":{"jobs":{"a":{"id":1},"b":2,"a":{"id":3,"name":"n"}}}}', '{"resources":{"jobs":{"a":{"id":1,"id":2},"b":{"id":"x"}}}}',
             '{"resources":{"jobs":[1]}}', '{"resources":{"jobs":null}}', "{}", "no", None, '{"resources":{"jobs":{"c":"text","d":[1],"e":null}}}']
    df = spark.createDataFrame(list(enumerate(texts)), "target long, summary_json string")
    got = sorted((r.target, r.job_key, r.job_name, r.job_id) for r in flatten_summary(df).collect())
    assert got == [(0, "a", "n", "3"), (0, "b", "b", None), (1, "a", "a", "2"), (1, "b", "b", "x"),
                   (7, "c", "c", None), (7, "d", "d", None), (7, "e", "e", None)]


# ---- S5 --------------------------------------------------------------------------------

def test_drift_is_refused(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    declared = spark.range(1).select(F.col("id").alias("a"), F.lit("x").alias("b")).schema
    spark.range(3).select(F.col("id").cast("int").alias("a"), F.lit("x").alias("b"), F.lit(1).alias("more")).write.parquet(path)
    check_drift(spark, path, declared)
    spark.range(3).select(F.col("id").alias("a"), F.lit("x").alias("renamed")).write.mode("overwrite").parquet(path)
    with pytest.raises(SchemaDrift, match="b is missing"):
        check_drift(spark, path, declared)
    spark.range(3).select(F.lit("1").alias("a"), F.lit("x").alias("b")).write.mode("overwrite").parquet(path)
    with pytest.raises(SchemaDrift, match="a is string, not bigint"):
        check_drift(spark, path, declared)
