"""Contract publish (F3), landing, and the two-step pipeline (D1, D2)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline import schemas as S
from ledgerline.operators import sales
from ledgerline.plans import tables
from ledgerline.plans.pipeline import run_pipeline

AS_OF = "2025-01-01 00:00:00"


def _report(spark, region="us-east", gross="10.00", count=1):
    row = [(region, "widget-a", count, Decimal(gross), Decimal(gross), 1.0,
            dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1))]
    return spark.createDataFrame(row, "region string, product string, order_count bigint, "
                                      "gross_revenue decimal(20,2), net_revenue decimal(20,2), "
                                      "avg_order_value double, latest_order timestamp_ntz, "
                                      "ingested_at timestamp_ntz")


def _described(spark, table):
    return [(r.col_name, r.data_type, r.comment) for r in tables.describe_contract(spark, table).collect()]


@pytest.fixture
def report_table(spark):
    schema = tables.scratch_schema(spark)
    table = tables.table_name(schema, S.REPORT_TABLE)
    assert tables.publish(_report(spark), table) == 1
    return table


def test_types_and_comments_survive_two_publishes(spark, report_table):
    want = [(n, t.lower(), c) for n, t, c in S.SALES_COLUMNS]
    assert _described(spark, report_table) == want
    assert tables.publish(_report(spark, gross="20.00"), report_table) == 1
    assert _described(spark, report_table) == want
    assert spark.table(report_table).first().gross_revenue == Decimal("20.00")


@pytest.mark.parametrize("bad", [
    lambda df: df.withColumn("extra", F.lit(1)),
    lambda df: df.drop("avg_order_value"),
    lambda df: df.withColumn("region", F.lit(None).cast("string")),
    lambda df: df.withColumn("gross_revenue", F.lit(Decimal("99999999999.99")).cast("decimal(20,2)")),
    lambda df: df.unionByName(df),
])
def test_bad_batch_fails_and_old_rows_stay(spark, report_table, bad):
    before = sorted(map(tuple, spark.table(report_table).collect()))
    with pytest.raises(Exception):
        tables.publish(bad(_report(spark, gross="30.00")), report_table)
    spark.catalog.refreshTable(report_table)
    assert sorted(map(tuple, spark.table(report_table).collect())) == before
    assert _described(spark, report_table) == [(n, t.lower(), c) for n, t, c in S.SALES_COLUMNS]


def test_pipeline_generated_and_idempotent(spark):
    schema = tables.scratch_schema(spark)
    first = run_pipeline(spark, schema, n=5000, as_of=AS_OF)
    assert first.landed_rows == 5000 and first.published_rows == 25
    rows1 = sorted(map(tuple, spark.table(first.report_table).drop("ingested_at").collect()))
    second = run_pipeline(spark, schema, n=5000)
    rows2 = sorted(map(tuple, spark.table(second.report_table).drop("ingested_at").collect()))
    assert rows1 == rows2
    raw = spark.table(first.raw_table)
    completed = raw.filter(F.col("status") == "completed").count()
    assert spark.table(first.report_table).agg(F.sum("order_count")).first()[0] == completed
    direct = sales.sales_by_region(raw, with_ingested_at=False).collect()
    published = spark.table(first.report_table).withColumn(
        "latest_order", F.col("latest_order").cast("timestamp_ntz")).drop("ingested_at").collect()
    assert sorted(map(tuple, direct)) == sorted(map(tuple, published))


def test_pipeline_refuses_bad_source(spark, sf001):
    from ledgerline.operators.quality import QualityError
    from ledgerline.sources import bindings as B

    schema = tables.scratch_schema(spark)
    good = run_pipeline(spark, schema, n=500)
    bad = B.orders_raw(spark, sf001).withColumn("quantity", F.lit(0))
    with pytest.raises(QualityError):
        run_pipeline(spark, schema, source=bad, check_unique_ids=False)
    assert spark.table(good.raw_table).count() == 500  # the refused batch was not landed


def test_landing_replaces_schema_and_schema_creation_is_idempotent(spark):
    schema = tables.scratch_schema(spark)
    tables.ensure_schema(spark, schema)  # again: no error
    raw = tables.table_name(schema, S.RAW_TABLE)
    first = spark.range(3).select(F.col("id").alias("a"), F.lit("x").alias("b"))
    assert tables.land(first, raw).columns == ["a", "b"]
    second = spark.range(5).select(F.col("id").cast("string").alias("c"))
    landed = tables.land(second, raw)
    assert landed.columns == ["c"] and landed.count() == 5
