"""Streaming rollup: incremental batches and restart from checkpoint equal the batch rollup."""

import pytest
from pyspark.sql import functions as F

from ledgerline import schemas as S
from ledgerline.operators import sales
from ledgerline.plans import tables
from ledgerline.session import work_dir
from ledgerline.sources.generate import synthetic_orders
from ledgerline.streaming.feed import land_order_files, stream_sales_rollup


def _published(spark, table):
    spark.catalog.refreshTable(table)
    return sorted(map(tuple, spark.table(table).withColumn(
        "latest_order", F.col("latest_order").cast("timestamp_ntz")).drop("ingested_at").collect()))


def test_incremental_batches_and_restart(spark):
    schema = tables.scratch_schema(spark)
    source = f"{work_dir(spark)}/{schema}_feed"
    checkpoint = f"{work_dir(spark)}/{schema}_ckpt"
    report = tables.table_name(schema, S.REPORT_TABLE)
    orders = synthetic_orders(spark, 4000)
    first, second = orders.filter(F.col("quantity") <= 10), orders.filter(F.col("quantity") > 10)

    land_order_files(first, source)
    stream_sales_rollup(spark, source, report, checkpoint=checkpoint, state_partitions=4).awaitTermination()
    want1 = sorted(map(tuple, sales.sales_by_region(first, with_ingested_at=False).collect()))
    assert _published(spark, report) == want1

    # New files arrive; a new run resumes from the checkpoint and adds them to the state.
    land_order_files(second, source)
    stream_sales_rollup(spark, source, report, checkpoint=checkpoint, state_partitions=4).awaitTermination()
    want = sorted(map(tuple, sales.sales_by_region(orders, with_ingested_at=False).collect()))
    assert _published(spark, report) == want


def test_bad_row_stops_the_stream_and_leaves_the_report(spark):
    schema = tables.scratch_schema(spark)
    source, checkpoint = (f"{work_dir(spark)}/{schema}_{k}" for k in ("feed", "ckpt"))
    report = tables.table_name(schema, S.REPORT_TABLE)
    orders = synthetic_orders(spark, 300)
    land_order_files(orders, source)
    stream_sales_rollup(spark, source, report, checkpoint=checkpoint, state_partitions=2).awaitTermination()
    before = _published(spark, report)
    land_order_files(orders.limit(3).withColumn("quantity", F.lit(0)), source)
    with pytest.raises(Exception, match="row refused: quantity_below_one"):
        stream_sales_rollup(spark, source, report, checkpoint=checkpoint, state_partitions=2).awaitTermination()
    assert _published(spark, report) == before
