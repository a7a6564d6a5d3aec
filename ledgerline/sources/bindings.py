"""Bindings of the shared test tables to the engine's table shapes.

These adapters give the operators realistic, scale-growing inputs:

* B1 ``orders_raw``  <- lineitem, orders, customer, nation, region, part
* B2 ``jobs``        <- part
* B3 ``runs``        <- events (one run per event)
* B4 ``run_tasks``   <- events (four tasks under a run)
* ``task_outputs``   <- documents (long texts as stack traces)
* ``deploy_summaries`` <- events (JSON summaries incl. malformed ones)

They are plain lazy DataFrames: Catalyst prunes the columns each query uses
and pushes filters into the scans.  The joins in B1 let the optimizer pick
broadcast for the fixed-size dimensions (nation, region) by their size
statistics and shuffle joins for the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline.functions.time import epoch_millis
from ledgerline.sources.tables import literal_table, read_table

# --- fixed values: status and state maps of the bindings ------------------------
ORDER_STATUS_BY_CODE = {"F": "completed", "P": "pending", "O": "cancelled"}
RESULT_BY_EVENT = {
    "purchase": "SUCCESS",
    "error": "FAILED",
    "click": "TIMEDOUT",
    "signup": "CANCELED",
}
TERMINATION_CODE_BY_EVENT = {"error": "RUN_EXECUTION_ERROR", "click": "TIMEOUT", "signup": ""}
DEPLOYED_KIND = "BUNDLE"
MANAGED_MIN_SIZE = 25
DEV_EVERY = 3
WANTED_NAMES = ["cold", "small_widget", "nope", "large"]
PRINCIPAL = "Brand#13"
TASKS_PER_RUN = 4
OVERFLOW_REGION, OVERFLOW_FACTOR = "ASIA", 1_000_000
HOT_NAME = "hot"
# JSON values of a summary's id, by event id; the last case is the user's id.
ID_CASES = ["0", '"0"', "false", '"false"', "null", "[]", "{}", '""', "0.0", "true", '"[]"']
NAME_CASES = ['""', "0", "null"]


def _map_value(col: Column, mapping: dict) -> Column:
    expr = None
    for key, value in mapping.items():
        expr = (F.when(col == F.lit(key), F.lit(value)) if expr is None
                else expr.when(col == F.lit(key), F.lit(value)))
    return expr


def orders_raw(spark: SparkSession, base_dir: str, unique_ids: bool = False) -> DataFrame:
    """B1: one order row per line item, in the ``orders_raw`` shape.

    Line numbers repeat within an order of the test tables, so ``order_id`` does too; with
    ``unique_ids`` the id also names part, supplier, ship day and price in cents.

    Join order: the order dimension (orders -> customer -> nation -> region) is
    built first, so at scale the line items are shuffled once by order key and
    once by part key, never by customer key.  There are no hints: the planner and
    AQE broadcast a side only by its file statistics or its size at run time.
    """
    li = read_table(spark, base_dir, "lineitem")
    o = read_table(spark, base_dir, "orders")
    c = read_table(spark, base_dir, "customer")
    n = read_table(spark, base_dir, "nation")
    r = read_table(spark, base_dir, "region")
    p = read_table(spark, base_dir, "part")
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select(n.n_nationkey, r.r_name)
    order_dim = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(geo, c.c_nationkey == geo.n_nationkey)
        .select(o.o_orderkey, geo.r_name, c.c_mktsegment,
                _map_value(o.o_orderstatus, ORDER_STATUS_BY_CODE).alias("status"), o.o_orderdate)
    )
    more = []
    if unique_ids:
        more = [F.lit("-"), li.l_partkey.cast("string"), F.lit("-"), li.l_suppkey.cast("string"), F.lit("-"),
                F.date_format(li.l_shipdate, "yyyyMMdd"), F.lit("-"), F.round(li.l_extendedprice * 100).cast("bigint").cast("string")]
    return (
        li.join(order_dim, li.l_orderkey == order_dim.o_orderkey)
        .join(p, li.l_partkey == p.p_partkey)
        .select(
            F.concat(F.lit("order-"), li.l_orderkey.cast("string"), F.lit("-"),
                     li.l_linenumber.cast("string"), *more).alias("order_id"),
            order_dim.r_name.alias("region"),
            p.p_type.alias("product"),
            order_dim.c_mktsegment.alias("channel"),
            order_dim.status,
            p.p_retailprice.alias("unit_price"),
            li.l_quantity.cast("int").alias("quantity"),
            li.l_discount.alias("discount_pct"),
            order_dim.o_orderdate.alias("order_date"),
        )
    )


def overflowing_orders(spark: SparkSession, base_dir: str) -> DataFrame:
    """B1 with the quantities of one region a million times as large, so that most of its sums pass DECIMAL(12,2)."""
    o = orders_raw(spark, base_dir)
    return o.withColumn("quantity", F.when(F.col("region") == F.lit(OVERFLOW_REGION), F.col("quantity") * OVERFLOW_FACTOR)
                        .otherwise(F.col("quantity")))


def jobs(spark: SparkSession, base_dir: str) -> DataFrame:
    """B2: one job per part.  Every third part is a dev deploy with a ``[dev uN]``
    prefix; parts larger than 25 are bundle-managed; the brand is the creator and,
    for even sizes, the upper-cased brand is the run-as user."""
    p = read_table(spark, base_dir, "part")
    base = F.replace(p.p_name, F.lit(" "), F.lit("_"))
    prefix = F.when(F.pmod(p.p_partkey, F.lit(DEV_EVERY)) == 0,
                    F.concat(F.lit("[dev u"), p.p_size.cast("string"), F.lit("] ")))
    return p.select(
        p.p_partkey.alias("job_id"),
        F.concat(F.coalesce(prefix, F.lit("")), base).alias("name"),
        F.when(p.p_size > MANAGED_MIN_SIZE, F.lit(DEPLOYED_KIND)).alias("deployment_kind"),
        p.p_brand.alias("creator_user_name"),
        F.when(F.pmod(p.p_size, F.lit(2)) == 0, F.upper(p.p_brand)).alias("run_as_user_name"),
    )


def name_requests(spark: SparkSession, names=None, principal: str | None = PRINCIPAL) -> DataFrame:
    """Requests to resolve: one row per wanted name, with the caller's principal."""
    names = WANTED_NAMES if names is None else names
    return literal_table(spark, [(w, principal) for w in names],
                         [("wanted", "string"), ("principal", "string")])


def mixed_name_requests(spark: SparkSession, base_dir: str) -> DataFrame:
    """A request per part, from several callers: a third want one hot name, others a job's name as
    deployed or its base name, some nothing; the brand calls in two spellings, a fixed caller, or none."""
    from ledgerline.functions.text import deployed_base

    p = read_table(spark, base_dir, "part").select("p_partkey", "p_brand")
    j = jobs(spark, base_dir).select(F.col("job_id").alias("p_partkey"), "name")
    k = F.col("p_partkey")
    wanted = (F.when(F.pmod(k, F.lit(3)) == 0, F.lit(HOT_NAME))
              .when(F.pmod(k, F.lit(17)) == 1, F.lit(None).cast("string")).when(F.pmod(k, F.lit(19)) == 1, F.lit(""))
              .when(F.pmod(k, F.lit(3)) == 1, F.col("name")).otherwise(deployed_base(F.col("name"))))
    principal = (F.when(F.pmod(k, F.lit(5)) == 0, F.col("p_brand")).when(F.pmod(k, F.lit(5)) == 1, F.upper("p_brand"))
                 .when(F.pmod(k, F.lit(5)) == 2, F.lit(PRINCIPAL)).when(F.pmod(k, F.lit(5)) == 3, F.lit("")))
    return p.join(j, "p_partkey").select(wanted.alias("wanted"), principal.alias("principal"))


def routed_requests(spark: SparkSession, base_dir: str) -> DataFrame:
    """``run_id, wanted, principal``: a request by run id per event (a third for one run, some for runs
    that don't exist), and the name requests of :func:`derived_name_requests` without one."""
    e = read_table(spark, base_dir, "events")
    k = e.event_id
    by_id = e.select(
        F.when(F.pmod(k, F.lit(3)) == 1, F.lit(0).cast("bigint")).when(F.pmod(k, F.lit(10)) == 0, -k).otherwise(k).alias("run_id"),
        e.event_type.alias("wanted"), F.lit(PRINCIPAL).alias("principal"))
    by_name = derived_name_requests(spark, base_dir).select(F.lit(None).cast("bigint").alias("run_id"), "wanted", "principal")
    return by_id.unionByName(by_name)


def derived_name_requests(spark: SparkSession, base_dir: str, principal: str | None = PRINCIPAL) -> DataFrame:
    """Requests for every distinct job name of B2 as deployed (raw) and as its base
    name, plus the fixed wanted names."""
    from ledgerline.functions.text import deployed_base

    j = jobs(spark, base_dir)
    raw = j.select(F.col("name").alias("wanted"))
    bases = j.select(deployed_base(F.col("name")).alias("wanted"))
    fixed = name_requests(spark, principal=principal).select("wanted")
    return (raw.unionByName(bases).unionByName(fixed).distinct()
            .withColumn("principal", F.lit(principal).cast("string")))


def job_requests(spark: SparkSession, base_dir: str) -> DataFrame:
    """Run requests: one per job of B2."""
    return jobs(spark, base_dir).select("job_id")


def _event_result(event_type: Column, event_id: Column) -> Column:
    internal = (event_type == F.lit("error")) & (F.pmod(event_id, F.lit(5)) == 0)
    return F.when(internal, F.lit(None).cast("string")).otherwise(_map_value(event_type, RESULT_BY_EVENT))


def _event_life_cycle(event_type: Column, event_id: Column) -> Column:
    return (
        F.when(event_type == F.lit("view"),
               F.when(F.pmod(event_id, F.lit(3)) == 0, F.lit("PENDING")).otherwise(F.lit("RUNNING")))
        .when((event_type == F.lit("error")) & (F.pmod(event_id, F.lit(5)) == 0), F.lit("INTERNAL_ERROR"))
        .when((event_type == F.lit("signup")) & (F.pmod(event_id, F.lit(9)) == 0), F.lit(None).cast("string"))
        .otherwise(F.lit("TERMINATED"))
    )


def _event_termination(event_type: Column, event_id: Column) -> Column:
    code = _map_value(event_type, TERMINATION_CODE_BY_EVENT)
    message = (F.when(F.pmod(event_id, F.lit(3)) == 0, F.lit(None).cast("string"))
               .when(F.pmod(event_id, F.lit(3)) == 1, F.lit(""))
               .otherwise(F.concat(F.lit("event "), event_id.cast("string"))))
    return F.when(code.isNotNull(), F.struct(code.alias("code"), message.alias("message")))


def runs(spark: SparkSession, base_dir: str) -> DataFrame:
    """B3: one run per event; job = user, start = event time in epoch ms."""
    e = read_table(spark, base_dir, "events")
    rid = e.event_id
    return e.select(
        rid.alias("run_id"),
        e.user_id.alias("job_id"),
        F.when(F.pmod(rid, F.lit(4)) == 0, F.lit(""))
        .when(F.pmod(rid, F.lit(4)) == 1, F.lit(None).cast("string"))
        .otherwise(F.concat(e.event_type, F.lit("-"), rid.cast("string"))).alias("run_name"),
        _event_life_cycle(e.event_type, rid).alias("life_cycle_state"),
        _event_result(e.event_type, rid).alias("result_state"),
        F.when(e.event_type.isin("error", "click"), F.concat(e.event_type, F.lit(" "), e.props))
        .alias("state_message"),
        epoch_millis(e.ts).alias("start_time"),
        (F.floor(e.value) * 1000).cast("bigint").alias("execution_duration"),
        F.when(F.pmod(rid, F.lit(2)) == 0, F.floor(e.value * 1000).cast("bigint")).alias("run_duration"),
        F.concat(F.lit("runs/"), rid.cast("string")).alias("run_page_url"),
        _event_termination(e.event_type, rid).alias("termination"),
    )


def run_tasks(spark: SparkSession, base_dir: str) -> DataFrame:
    """B4: every event is a task; four neighbouring ids belong to the run of the first."""
    e = read_table(spark, base_dir, "events")
    return e.select(
        (e.event_id - F.pmod(e.event_id, F.lit(TASKS_PER_RUN))).alias("run_id"),
        F.concat(F.lit("task-"), e.event_id.cast("string")).alias("task_key"),
        e.event_id.alias("task_run_id"),
        F.when(e.event_type == F.lit("view"), F.lit(None).cast("string"))
        .otherwise(_map_value(e.event_type, RESULT_BY_EVENT)).alias("result_state"),
        F.when(e.event_type.isin("error", "click"), F.concat(e.event_type, F.lit(" "), e.props))
        .alias("state_message"),
        _event_termination(e.event_type, e.event_id).alias("termination"),
    )


def failed_parent_runs(spark: SparkSession, base_dir: str) -> DataFrame:
    """B4 parent runs: the failed runs of B3; those that aren't the first of four have no tasks."""
    from ledgerline.operators.runs import classify_runs

    return classify_runs(runs(spark, base_dir)).filter("is_failed").select("run_id")


def nested_runs(spark: SparkSession, base_dir: str) -> DataFrame:
    """B3 runs that carry the tasks of B4 (at most four) as an array, as the runs' records do; without any it is null."""
    t = run_tasks(spark, base_dir)
    nested = t.groupBy("run_id").agg(F.collect_list(F.struct(
        "task_key", F.col("task_run_id").alias("run_id"), "result_state", "state_message", "termination")).alias("tasks"))
    return runs(spark, base_dir).join(nested, "run_id", "left")


def task_outputs(spark: SparkSession, base_dir: str) -> DataFrame:
    """Task outputs keyed by doc id: error text, the document as stack trace, result."""
    d = read_table(spark, base_dir, "documents")
    k = d.doc_id
    return d.select(
        k.alias("task_run_id"),
        F.when(F.pmod(k, F.lit(3)) == 0, F.lit(None).cast("string"))
        .when(F.pmod(k, F.lit(3)) == 1, F.lit(""))
        .otherwise(F.concat(F.lit("Exception in "), d.source)).alias("error"),
        F.when(F.pmod(k, F.lit(5)) == 0, F.lit(None).cast("string")).otherwise(d.text).alias("error_trace"),
        F.when(F.pmod(k, F.lit(4)) == 0, d.lang).alias("notebook_result"),
    )


def deploy_summaries(spark: SparkSession, base_dir: str) -> DataFrame:
    """Bundle summaries as JSON text, one per event, incl. invalid and degenerate ones."""
    e = read_table(spark, base_dir, "events")
    rid = e.event_id
    name = F.when(F.pmod(rid, F.lit(5)) == 0, F.lit("")).otherwise(e.event_type)
    full = F.concat(
        F.lit('{"resources":{"jobs":{"job_'), e.user_id.cast("string"),
        F.lit('":{"name":"'), name, F.lit('","id":'), e.user_id.cast("string"),
        F.lit('},"cfg_'), e.event_type, F.lit('":'), e.props, F.lit("}}}"),
    )
    sel = F.pmod(rid, F.lit(13))
    js = (F.when(sel == 0, F.lit("not json"))
          .when(sel == 1, F.concat(F.lit('{"resources":{"jobs":'), e.props, F.lit("}}")))
          .when(sel == 2, F.lit('{"resources":{"jobs":{}}}'))
          .otherwise(full))
    return e.select(F.concat(F.lit("t"), rid.cast("string")).alias("target"), js.alias("summary_json"))


def _by_number(key: Column, cases: list[str], otherwise: Column) -> Column:
    value = otherwise
    for k, text in enumerate(cases):
        value = F.when(F.pmod(key, F.lit(len(cases) + 1)) == k, F.lit(text)).otherwise(value)
    return value


def typed_summaries(spark: SparkSession, base_dir: str) -> DataFrame:
    """Bundle summaries whose ids and names are JSON values of every kind, one per event."""
    e = read_table(spark, base_dir, "events")
    job_id = _by_number(e.event_id, ID_CASES, e.user_id.cast("string"))
    name = _by_number(e.event_id, NAME_CASES, F.concat(F.lit('"'), e.event_type, F.lit('"')))
    text = F.concat(F.lit('{"resources":{"jobs":{"job_'), e.user_id.cast("string"), F.lit('":{"id":'), job_id,
                    F.lit(',"name":'), name, F.lit("}}}}"))
    return e.select(F.concat(F.lit("t"), e.event_id.cast("string")).alias("target"), text.alias("summary_json"))
