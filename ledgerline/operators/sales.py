"""Completed-order revenue rollup (the flagship) and its pieces.

Plan shape: scan -> filter(status) -> project(amounts) -> partial aggregate ->
shuffle on (region, product) -> final aggregate.  The shuffle carries at most
one row per group per map task, whatever the input size, so hot groups cost
nothing extra: map-side partial aggregation absorbs them.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerline import schemas as S
from ledgerline.functions.money import fits_report, gross_amount, net_amount, report_money, wide_sum
from ledgerline.session import work_dir


def completed_orders(orders: DataFrame) -> DataFrame:
    """Orders whose status is exactly ``completed`` (case-sensitive; null drops)."""
    return orders.filter(F.col("status") == F.lit(S.COMPLETED))


def priced_orders(orders: DataFrame, exact: bool = True) -> DataFrame:
    """Completed orders with ``gross_revenue`` and ``net_revenue`` per line."""
    gross = gross_amount(F.col("unit_price"), F.col("quantity"), exact)
    return (
        completed_orders(orders)
        .withColumn("gross_revenue", gross)
        .withColumn("net_revenue", net_amount(F.col("gross_revenue"), F.col("discount_pct"), exact))
    )


def ingest_time(as_of) -> Column:
    """The ``ingested_at`` value: the query's current time, or a pinned ``as_of``."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of.cast("timestamp")
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(as_of)).cast("timestamp_ntz").cast("timestamp")


def sales_totals(orders: DataFrame, exact: bool = True) -> DataFrame:
    """Per (region, product) over completed orders: count, unrounded sums, mean and latest order."""
    priced = priced_orders(orders, exact)
    if exact:
        avg_value = F.sum("net_revenue").cast("double") / F.count("net_revenue")
    else:
        avg_value = F.avg("net_revenue")
    return priced.groupBy("region", "product").agg(
        F.count("order_id").alias("order_count"),
        wide_sum(F.col("gross_revenue")).alias("gross_revenue"),
        wide_sum(F.col("net_revenue")).alias("net_revenue"),
        avg_value.alias("avg_order_value"),
        F.max("order_date").alias("latest_order"),
    )


def _fits() -> Column:
    return fits_report(F.col("gross_revenue")) & fits_report(F.col("net_revenue"))


def refused_groups(totals: DataFrame) -> DataFrame:
    """Groups whose sums don't fit the report's DECIMAL(12,2), with their sums as DECIMAL(38,6)."""
    return totals.filter(~_fits()).select(
        "region", "product", "order_count", *[F.col(c).cast("decimal(38,6)").alias(c) for c in ("gross_revenue", "net_revenue")])


def report_groups(totals: DataFrame, as_of=None, with_ingested_at: bool = True, only_fitting: bool = True) -> DataFrame:
    """The groups that fit, in contract types and column order."""
    fitting = (totals.filter(_fits()) if only_fitting else totals).withColumns({c: report_money(F.col(c)) for c in ("gross_revenue", "net_revenue")})
    columns = [name for name, _, _ in S.SALES_COLUMNS]
    if not with_ingested_at:
        return fitting.select(*[c for c in columns if c != "ingested_at"])
    return fitting.withColumn("ingested_at", ingest_time(as_of)).select(*columns)


def sales_by_region(
    orders: DataFrame,
    exact: bool = True,
    as_of=None,
    with_ingested_at: bool = True,
    overflow: str = "raise",
) -> DataFrame:
    """Revenue per (region, product) over completed orders, in contract column order.

    ``exact=True`` sums exact decimals and casts the sums to DECIMAL(12,2);
    ``avg_order_value`` is then the exact net sum over the order count, as a
    double.  ``exact=False`` is the literal double form.  ``as_of`` pins
    ``ingested_at`` (default: the query's current timestamp).  A group whose
    sums don't fit DECIMAL(12,2) makes the query fail (``overflow="raise"``) or
    is left out of the report (``"refuse"``); :func:`refused_groups` of
    :func:`sales_totals` then names it.
    """
    totals = sales_totals(orders, exact)
    if overflow == "raise":
        named = F.concat_ws(" ", F.lit("sums don't fit the report:"), "region", "product")
        refused = F.when(~_fits(), F.raise_error(named).cast("bigint"))
        totals = totals.withColumn("order_count", F.coalesce(refused, F.col("order_count")))
        return report_groups(totals, as_of, with_ingested_at, only_fitting=False)
    return report_groups(totals, as_of, with_ingested_at)


def sales_ranked(sales: DataFrame, parts: int | None = None) -> DataFrame:
    """The report ordered by net revenue (desc, nulls last), ties by region, product.

    ``net_rank`` numbers that order.  Rows are range-partitioned by the whole
    order (``parts`` ranges, by default the session's shuffle partitions) and
    written with their range's number; a row's rank is its place in its range
    plus the rows of all ranges before, so no task sees more than a range.
    """
    spark = sales.sparkSession
    order = [F.col("net_revenue").desc_nulls_last(), F.col("region").asc(), F.col("product").asc()]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{work_dir(spark)}/ranked-{uuid.uuid4().hex}"
    ranges = sales.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    ranges.write.parquet(path)
    ranges = spark.read.schema(ranges.schema).parquet(path)
    # One entry per range, as a scalar.
    sizes = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct("_range", "n")).alias("sizes")).scalar()
    before = F.aggregate(
        F.filter(F.col("_sizes"), lambda s: s["_range"] < F.col("_range")), F.lit(0).cast("bigint"), lambda total, s: total + s["n"])
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (ranges.withColumn("_place", place).withColumn("_sizes", sizes)
            .withColumn("net_rank", F.col("_place") + before).drop("_range", "_place", "_sizes").orderBy(*order))


def preview_orders(orders: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` orders by id (all columns as tie-breakers): a distributed top-n."""
    keys = ["order_id", "region", "product", "channel", "status", "unit_price",
            "quantity", "discount_pct", "order_date"]
    return orders.orderBy(*[F.col(k).asc_nulls_last() for k in keys]).limit(n)
