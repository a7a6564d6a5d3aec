"""Joins that split hot keys by hand.

AQE splits a skewed partition only where a join reads two plain shuffles; above an aggregate
or another join it doesn't.  The helpers here need no setting and hold with broadcasts off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is heavy if it holds more than this share (one in so many) of all rows, so there are fewer heavy keys than this.
HEAVY = 256


def heavy_keys(sizes: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """``keys, _shares`` of the heavy keys of ``sizes`` (one row per key with its rows ``n``): fewer than HEAVY rows."""
    total = sizes.agg(F.sum(n)).scalar()
    return sizes.select(*keys, F.ceil(F.col(n) * F.lit(HEAVY) / total).cast("int").alias("_shares")).filter("_shares > 1")


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], sizes: DataFrame, by: list[str]) -> DataFrame:
    """Inner join on ``keys``; the rows of a heavy key are dealt into shares by the hash of ``by``.

    ``few`` repeats a heavy key's rows once per share, ``sizes`` counts the rows of ``many`` (or more)
    by key as ``n``.  No share holds much more than a HEAVY-th of all rows.  The list of heavy keys
    is broadcast: it has fewer than HEAVY rows whatever the data.
    """
    heavy = F.broadcast(heavy_keys(sizes, keys))
    shares = F.coalesce(F.col("_shares"), F.lit(1))
    dealt = many.join(heavy, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), shares).cast("int")).drop("_shares")
    copies = few.join(heavy, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_shares")
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")


def spread_nulls(left: DataFrame, right: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Left join on ``key`` in which the rows without a key, which match nothing, are dealt by the hash of ``by``.

    A plain join would send all of them to the task of the null key.
    """
    salt = F.when(F.col(key).isNull(), F.xxhash64(*by)).otherwise(F.lit(0))
    return (
        left.withColumn("_salt", salt)
        .join(right.withColumn("_salt", F.lit(0).cast("bigint")), [key, "_salt"], "left").drop("_salt")
    )


def counted(rows: DataFrame) -> DataFrame:
    """Distinct rows, and how often each occurs as ``_times``."""
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_times"))


def repeated(rows: DataFrame, block: int = 4096) -> DataFrame:
    """Each row ``_times`` times, with arrays of at most ``block`` numbers for up to block^2 of them."""
    last = F.col("_times") - 1
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / block))))
    size = F.least(F.lit(block).cast("bigint"), F.col("_times") - F.col("_block") * block)
    return blocks.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("bigint"), size))).drop("_times", "_block", "_one")
