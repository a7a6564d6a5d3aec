"""Synthetic source (S1) and input checks (S2)."""

import pytest
from pyspark.sql import functions as F

from ledgerline import schemas as S
from ledgerline.operators import quality
from ledgerline.sources.generate import synthetic_orders


def test_same_batch_for_any_partition_count(spark):
    a = synthetic_orders(spark, 5000, num_partitions=1).collect()
    b = synthetic_orders(spark, 5000, num_partitions=7).collect()
    assert sorted(a) == sorted(b)


def test_seed_changes_batch(spark):
    a = synthetic_orders(spark, 200, seed=42).collect()
    b = synthetic_orders(spark, 200, seed=43).collect()
    assert sorted(a) != sorted(b)


def test_domains_and_ranges(spark):
    g = synthetic_orders(spark, 5000)
    assert [(f.name, f.dataType) for f in g.schema] == [(f.name, f.dataType) for f in S.ORDERS_RAW]
    r = g.agg(
        F.count_distinct("region").alias("regions"), F.count_distinct("product").alias("products"),
        F.count_distinct("channel").alias("channels"), F.count_distinct("status").alias("statuses"),
        F.min("quantity").alias("qmin"), F.max("quantity").alias("qmax"),
        F.min("unit_price").alias("pmin"), F.max("unit_price").alias("pmax"),
        F.count_distinct("order_id").alias("ids"),
    ).first()
    assert (r.regions, r.products, r.channels, r.statuses) == (5, 5, 3, 4)
    assert (r.qmin, r.qmax) == (1, 20)
    assert 10.0 <= r.pmin and r.pmax <= 500.0
    assert r.ids == 5000
    groups = g.groupBy("region", "product").count().count()
    assert groups == 25
    zero_share = g.filter(F.col("discount_pct") == 0).count() / 5000
    assert 0.28 < zero_share < 0.39


def test_generated_batch_is_clean(spark):
    g = quality.conform(synthetic_orders(spark, 5000))
    report = quality.quality_report(g, {"region": S.ORDER_REGIONS, "status": S.ORDER_STATUSES})
    quality.assert_clean(report)


@pytest.mark.parametrize("fault,check", [
    (lambda df: df.withColumn("region", F.when(F.col("order_id") == "order-00003", None)
                              .otherwise(F.col("region"))), "null_region"),
    (lambda df: df.withColumn("order_id", F.when(F.col("order_id") == "order-00004", "order-00005")
                              .otherwise(F.col("order_id"))), "duplicate_order_id"),
    (lambda df: df.withColumn("unit_price", F.when(F.col("order_id") == "order-00006", 10.005)
                              .otherwise(F.col("unit_price"))), "price_decimals"),
    (lambda df: df.withColumn("region", F.when(F.col("order_id") == "order-00007", "mars")
                              .otherwise(F.col("region"))), "domain_region"),
    (lambda df: df.withColumn("quantity", F.when(F.col("order_id") == "order-00008", 0)
                              .otherwise(F.col("quantity"))), "quantity_below_one"),
])
def test_planted_faults_are_flagged(spark, fault, check):
    g = fault(synthetic_orders(spark, 100))
    report = quality.quality_report(g, {"region": S.ORDER_REGIONS})
    failures = {r.check_name: r.failures for r in report.collect()}
    assert failures[check] == 1
    assert sum(failures.values()) == 1
    with pytest.raises(quality.QualityError):
        quality.assert_clean(report)
