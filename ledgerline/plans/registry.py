"""Named queries over the test tables: ``name -> f(spark, base_dir) -> DataFrame``.

Every query reads the given tables (through the bindings in
``ledgerline.sources.bindings``) and runs over them whole.  Queries that write
tables do so in a fresh schema under the shared work folder and return what
they read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline import schemas as S
from ledgerline.functions.text import tail
from ledgerline.operators import names as name_ops
from ledgerline.operators import quality
from ledgerline.operators import runs as run_ops
from ledgerline.operators import sales as sales_ops
from ledgerline.operators.summaries import flatten_summary
from ledgerline.plans import tables
from ledgerline.plans.pipeline import run_pipeline
from ledgerline.sources import bindings as B
from ledgerline.sources.tables import read_table
from ledgerline.session import work_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# --- fixed values: publish time used by the checked publish queries -------------
AS_OF = "2025-01-01 00:00:00"
TAIL_LENGTHS = [4000, 2000, 800]


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def flagship(spark: SparkSession, base_dir: str) -> DataFrame:
    """The full 8-column report (``ingested_at`` = query time)."""
    return sales_ops.sales_by_region(B.orders_raw(spark, base_dir))


def _ntz(df: DataFrame, cols) -> DataFrame:
    """Timestamps as wall-clock NTZ values for zone-free comparison."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in cols else F.col(c)
                       for c in df.columns])


# ---- order checks, landing, publish --------------------------------------------------

@register("conform_orders")
def q_conform_orders(spark, base_dir):
    """Input-check report of the bound orders (status domain checked)."""
    batch = quality.conform(B.orders_raw(spark, base_dir))
    return quality.quality_report(batch, {"status": S.ORDER_STATUSES}, check_unique_ids=True)


@register("scan_orders")
def q_scan_orders(spark, base_dir):
    return B.orders_raw(spark, base_dir)


@register("land_orders")
def q_land_orders(spark, base_dir):
    schema = tables.scratch_schema(spark)
    raw = tables.table_name(schema, S.RAW_TABLE)
    return tables.land(quality.conform(B.orders_raw(spark, base_dir)), raw)


def _publish(spark, base_dir) -> str:
    schema = tables.scratch_schema(spark)
    report = tables.table_name(schema, S.REPORT_TABLE)
    sales = sales_ops.sales_by_region(B.orders_raw(spark, base_dir), as_of=AS_OF)
    tables.publish(sales, report)
    return report


@register("publish_sales")
def q_publish_sales(spark, base_dir):
    report = _publish(spark, base_dir)
    return _ntz(spark.table(report), {"latest_order", "ingested_at"})


@register("published_count")
def q_published_count(spark, base_dir):
    return tables.published_count(spark, _publish(spark, base_dir))


@register("stream_sales")
def q_stream_sales(spark, base_dir):
    """The rollup published by the streaming job from a folder of landed order files."""
    from ledgerline.streaming.feed import land_order_files, stream_sales_rollup

    schema = tables.scratch_schema(spark)
    source = land_order_files(quality.conform(B.orders_raw(spark, base_dir)),
                              f"{work_dir(spark)}/{schema}_feed")
    report = tables.table_name(schema, S.REPORT_TABLE)
    query = stream_sales_rollup(spark, source, report, as_of=AS_OF)
    query.awaitTermination()
    return _ntz(spark.table(report), {"latest_order", "ingested_at"})


@register("published_contract")
def q_published_contract(spark, base_dir):
    """Types and comments of the published table as the catalog holds them, and how many values each column got."""
    report = _publish(spark, base_dir)
    published = spark.table(report)
    filled = published.agg(*[F.count(c).alias(c) for c in published.columns]).unpivot([], published.columns, "col_name", "n_values")
    return tables.describe_contract(spark, report).join(filled, "col_name")


@register("rerun_fingerprint")
def q_rerun_fingerprint(spark, base_dir):
    """Two publishes of the same orders at their own times: rows, equal content, and what ``ingested_at`` holds."""
    schema = tables.scratch_schema(spark)
    names = [tables.table_name(schema, f"{S.REPORT_TABLE}_{k}") for k in (1, 2)]
    for name in names:
        tables.publish(sales_ops.sales_by_region(B.orders_raw(spark, base_dir)), name)
    first, second = (tables.fingerprint(spark.table(n).drop("ingested_at")) for n in names)
    other = tables.fingerprint(spark.table(names[0]).drop("ingested_at").withColumn("order_count", F.col("order_count") + 1))
    a, b, c = (df.select(F.struct(*df.columns).alias(k)) for k, df in zip("abc", (first, second, other)))
    times = spark.table(names[0]).agg(F.count_distinct("ingested_at").alias("ingested_values"),
                                      F.count_if(F.col("ingested_at").isNull()).alias("ingested_nulls"))
    row = times.select("*", a.scalar().alias("a"), b.scalar().alias("b"), c.scalar().alias("c")).select(
        F.col("a.n_rows").alias("n_rows"), (F.col("a") == F.col("b")).cast("bigint").alias("equal_runs"),
        (F.col("a") == F.col("c")).cast("bigint").alias("equal_changed"), "ingested_values", "ingested_nulls")
    return row.unpivot([], row.columns, "metric", "value")


@register("pipeline_sales")
def q_pipeline_sales(spark, base_dir):
    """Run the two-step job on the bound orders; reconcile raw and published tables."""
    schema = tables.scratch_schema(spark)
    res = run_pipeline(spark, schema, source=B.orders_raw(spark, base_dir, unique_ids=True), as_of=AS_OF,
                       domains={"status": S.ORDER_STATUSES})
    money = "decimal(20,2)"
    raw = spark.table(res.raw_table).agg(
        F.count(F.lit(1)).cast(money).alias("landed_rows"),
        F.count_if(F.col("status") == F.lit(S.COMPLETED)).cast(money).alias("completed_rows"))
    rep = spark.table(res.report_table).agg(
        F.count(F.lit(1)).cast(money).alias("published_groups"),
        F.sum("order_count").cast(money).alias("published_orders"),
        F.sum("gross_revenue").cast(money).alias("published_gross"),
        F.sum("net_revenue").cast(money).alias("published_net"))
    return (raw.unpivot([], raw.columns, "metric", "value")
            .unionByName(rep.unpivot([], rep.columns, "metric", "value")))


# ---- rollup pieces ---------------------------------------------------------------------

@register("preview_orders")
def q_preview_orders(spark, base_dir):
    return sales_ops.preview_orders(B.orders_raw(spark, base_dir))


@register("completed_orders")
def q_completed_orders(spark, base_dir):
    return sales_ops.completed_orders(B.orders_raw(spark, base_dir))


@register("priced_orders")
def q_priced_orders(spark, base_dir):
    return sales_ops.priced_orders(B.orders_raw(spark, base_dir)).select(
        "order_id", "region", "product", "gross_revenue", "net_revenue")


@register("sales_by_region")
def q_sales_by_region(spark, base_dir):
    return sales_ops.sales_by_region(B.orders_raw(spark, base_dir), with_ingested_at=False)


@register("refused_sales")
def q_refused_sales(spark, base_dir):
    """Groups that the report can't hold, by name, from orders of which one region's are too large."""
    return sales_ops.refused_groups(sales_ops.sales_totals(B.overflowing_orders(spark, base_dir)))


@register("sales_beside_refused")
def q_sales_beside_refused(spark, base_dir):
    """The report of the same orders: all other groups."""
    return sales_ops.sales_by_region(B.overflowing_orders(spark, base_dir), with_ingested_at=False, overflow="refuse")


@register("sales_ranked")
def q_sales_ranked(spark, base_dir):
    return sales_ops.sales_ranked(
        sales_ops.sales_by_region(B.orders_raw(spark, base_dir), with_ingested_at=False))


# ---- names -------------------------------------------------------------------------------

@register("normalize_name")
def q_normalize_name(spark, base_dir):
    return name_ops.normalize_names(B.jobs(spark, base_dir))


@register("match_names")
def q_match_names(spark, base_dir):
    wanted = B.mixed_name_requests(spark, base_dir).select("wanted").distinct()
    m = name_ops.match_names(B.jobs(spark, base_dir), wanted)
    return m.select("wanted", "job_id", "name")


@register("resolve_jobs")
def q_resolve_jobs(spark, base_dir):
    return name_ops.resolve_jobs(B.jobs(spark, base_dir), B.mixed_name_requests(spark, base_dir))


@register("ambiguous_names")
def q_ambiguous_names(spark, base_dir):
    return name_ops.ambiguous_candidates(B.jobs(spark, base_dir), B.mixed_name_requests(spark, base_dir))


# ---- request flows (resolve -> act) --------------------------------------------------------

@register("run_requests")
def q_run_requests(spark, base_dir):
    from ledgerline.operators.requests import run_requests

    return run_requests(B.jobs(spark, base_dir), B.runs(spark, base_dir),
                        B.derived_name_requests(spark, base_dir))


@register("status_requests")
def q_status_requests(spark, base_dir):
    from ledgerline.operators.requests import status_requests

    return status_requests(B.jobs(spark, base_dir), B.runs(spark, base_dir),
                           B.derived_name_requests(spark, base_dir))


@register("cancel_requests")
def q_cancel_requests(spark, base_dir):
    from ledgerline.operators.requests import cancel_requests

    return cancel_requests(B.jobs(spark, base_dir), B.runs(spark, base_dir),
                           B.derived_name_requests(spark, base_dir))


@register("status_by_run")
def q_status_by_run(spark, base_dir):
    """Status answers to requests by run id and by name."""
    from ledgerline.operators.requests import status_requests

    return status_requests(B.jobs(spark, base_dir), B.runs(spark, base_dir), B.routed_requests(spark, base_dir))


@register("status_details")
def q_status_details(spark, base_dir):
    """The failed tasks behind those answers, with their outputs."""
    from ledgerline.operators.requests import status_details

    return status_details(B.jobs(spark, base_dir), B.runs(spark, base_dir), B.run_tasks(spark, base_dir),
                          B.task_outputs(spark, base_dir), B.routed_requests(spark, base_dir))


@register("nested_status_details")
def q_nested_status_details(spark, base_dir):
    """The same from runs that carry their tasks."""
    from ledgerline.operators.requests import status_details

    return status_details(B.jobs(spark, base_dir), B.nested_runs(spark, base_dir), None,
                          B.task_outputs(spark, base_dir), B.routed_requests(spark, base_dir))


@register("cancel_by_run")
def q_cancel_by_run(spark, base_dir):
    from ledgerline.operators.requests import cancel_requests

    return cancel_requests(B.jobs(spark, base_dir), B.runs(spark, base_dir), B.routed_requests(spark, base_dir))


# ---- runs ----------------------------------------------------------------------------------

@register("allowed_requests")
def q_allowed_requests(spark, base_dir):
    return run_ops.allowed_requests(B.job_requests(spark, base_dir), B.runs(spark, base_dir))


@register("blocked_requests")
def q_blocked_requests(spark, base_dir):
    return run_ops.blocked_requests(B.job_requests(spark, base_dir), B.runs(spark, base_dir))


@register("run_eta")
def q_run_eta(spark, base_dir):
    return run_ops.run_eta(B.runs(spark, base_dir))


@register("duration_text")
def q_duration_text(spark, base_dir):
    return run_ops.run_durations(B.runs(spark, base_dir))


@register("latest_run")
def q_latest_run(spark, base_dir):
    return run_ops.latest_run(B.runs(spark, base_dir))


@register("cancel_candidates")
def q_cancel_candidates(spark, base_dir):
    return run_ops.cancel_candidates(B.runs(spark, base_dir))


@register("run_status")
def q_run_status(spark, base_dir):
    return run_ops.run_status(B.runs(spark, base_dir), B.jobs(spark, base_dir))


@register("run_started")
def q_run_started(spark, base_dir):
    return run_ops.run_started(B.runs(spark, base_dir))


@register("classify_runs")
def q_classify_runs(spark, base_dir):
    return run_ops.classify_runs(B.runs(spark, base_dir))


def _failed_tasks(spark, base_dir):
    return run_ops.failed_tasks(B.failed_parent_runs(spark, base_dir), B.run_tasks(spark, base_dir))


@register("failed_tasks")
def q_failed_tasks(spark, base_dir):
    return _failed_tasks(spark, base_dir)


@register("nested_failed_tasks")
def q_nested_failed_tasks(spark, base_dir):
    """Failed tasks from runs that carry them as an array."""
    return run_ops.nested_failed_tasks(B.nested_runs(spark, base_dir))


@register("termination_text")
def q_termination_text(spark, base_dir):
    return run_ops.termination_text(B.runs(spark, base_dir))


@register("task_errors")
def q_task_errors(spark, base_dir):
    return run_ops.task_errors(_failed_tasks(spark, base_dir), B.task_outputs(spark, base_dir))


@register("text_tail")
def q_text_tail(spark, base_dir):
    d = read_table(spark, base_dir, "documents")
    return d.select("doc_id", *[tail(F.col("text"), n).alias(f"tail_{n}") for n in TAIL_LENGTHS],
                    F.char_length(tail(F.col("text"), TAIL_LENGTHS[0])).cast("bigint").alias("tail_chars"))


@register("flatten_summary")
def q_flatten_summary(spark, base_dir):
    return flatten_summary(B.deploy_summaries(spark, base_dir))


@register("flatten_typed")
def q_flatten_typed(spark, base_dir):
    """Summaries whose ids and names are JSON values of every kind."""
    return flatten_summary(B.typed_summaries(spark, base_dir))


__all__ = ["QUERIES", "flagship", "register"]
