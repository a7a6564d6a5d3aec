"""Seeded synthetic order source (the upstream order feed stand-in).

Rows come from ``spark.range`` and every field is a pure function of
``(seed, field name, row id)`` through ``xxhash64``, so the batch is the same
for any partition count and is generated in parallel on the executors; nothing
is built on the driver.  ``rand(seed)`` is not used: its values depend on how
rows are split into partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline import schemas as S


def _draw(seed: int, field: str, k: int) -> Column:
    """A value in [0, k) drawn from the row id."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(field), F.col("id")), F.lit(k))


def _choice(seed: int, field: str, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (_draw(seed, field, len(values)) + 1).cast("int"))


def synthetic_orders(
    spark: SparkSession,
    n: int = S.ORDER_COUNT,
    seed: int = S.ORDER_SEED,
    num_partitions: int | None = None,
) -> DataFrame:
    """``n`` orders in the ``orders_raw`` shape.

    Domains: five regions, five products, three channels, four statuses chosen
    uniformly; price uniform over whole cents in [10.00, 500.00]; quantity
    1..20 inclusive; discount drawn from the six-slot list (0 twice); order time
    2024-01-01 plus 0..8760 whole hours inclusive.
    """
    ids = spark.range(0, n, 1, num_partitions) if num_partitions else spark.range(n)
    cents_lo = int(round(S.ORDER_PRICE_MIN * 100))
    cents_span = int(round(S.ORDER_PRICE_MAX * 100)) - cents_lo + 1
    start = F.lit(S.ORDER_START).cast("timestamp_ntz")
    return ids.select(
        F.format_string(S.ORDER_ID_FORMAT, F.col("id")).alias("order_id"),
        _choice(seed, "region", S.ORDER_REGIONS).alias("region"),
        _choice(seed, "product", S.ORDER_PRODUCTS).alias("product"),
        _choice(seed, "channel", S.ORDER_CHANNELS).alias("channel"),
        _choice(seed, "status", S.ORDER_STATUSES).alias("status"),
        ((_draw(seed, "unit_price", cents_span) + cents_lo) / 100.0).alias("unit_price"),
        (_draw(seed, "quantity", S.ORDER_QTY_MAX - S.ORDER_QTY_MIN + 1) + S.ORDER_QTY_MIN)
        .cast("int").alias("quantity"),
        _choice(seed, "discount_pct", S.ORDER_DISCOUNTS).cast("double").alias("discount_pct"),
        F.timestamp_add("HOUR", _draw(seed, "order_date", S.ORDER_HOURS + 1), start).alias("order_date"),
    )
