"""Input checks for ``orders_raw``: explicit schema plus one aggregate pass.

A NOT NULL flag in a StructType is not enforced once data sits in parquet, so
nulls, duplicate ids, out-of-domain values and excess decimals are counted by
an aggregation (map-side partial counts, one tiny shuffle) and a batch with
any failure is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerline import schemas as S


class QualityError(ValueError):
    """A batch failed its input checks."""


def conform(orders: DataFrame, schema=S.ORDERS_RAW) -> DataFrame:
    """Cast to the declared column types and order (ANSI casts raise on bad values)."""
    missing = [f.name for f in schema.fields if f.name not in orders.columns]
    if missing:
        raise QualityError(f"missing columns: {missing}")
    return orders.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _count_if(cond) -> F.Column:
    return F.count_if(F.coalesce(cond, F.lit(False))).cast("bigint")


def failing(domains: dict[str, list] | None = None, schema=S.ORDERS_RAW) -> list[tuple[str, F.Column]]:
    """(check name, whether a row fails it) of all checks on single rows.

    Nulls per column; prices with more than 2 decimals or <= 0; discounts with more than 4
    decimals or outside [0, 1); quantities < 1; values outside ``domains``.
    """
    checks = [(f"null_{f.name}", F.col(f.name).isNull()) for f in schema.fields]
    price, disc, qty = F.col("unit_price"), F.col("discount_pct"), F.col("quantity")
    checks += [
        ("price_decimals", F.round(price, 2) != price),
        ("price_not_positive", price <= 0),
        ("discount_decimals", F.round(disc, 4) != disc),
        ("discount_out_of_range", (disc < 0) | (disc >= 1)),
        ("quantity_below_one", qty < 1),
    ]
    checks += [(f"domain_{column}", ~F.col(column).isin(*allowed)) for column, allowed in (domains or {}).items()]
    return checks


def row_checks(domains: dict[str, list] | None = None, schema=S.ORDERS_RAW) -> list[tuple[str, F.Column]]:
    """The checks of :func:`failing` as plain counts, which can be observed while the batch is written (``DataFrame.observe``)."""
    return [(name, _count_if(fails)) for name, fails in failing(domains, schema)]


def enforced(orders: DataFrame, domains: dict[str, list] | None = None, schema=S.ORDERS_RAW) -> DataFrame:
    """The same rows; one that fails a check stops the query, naming the check.  For streams, which have no batch to refuse."""
    told = F.lit(None).cast("string")
    for name, fails in reversed(failing(domains, schema)):
        told = F.when(F.coalesce(fails, F.lit(False)), F.lit(name)).otherwise(told)
    kept = F.when(told.isNull(), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("row refused: "), told)).cast("string"))
    return orders.withColumn("status", kept)


def duplicate_ids(orders: DataFrame, key: str = "order_id") -> DataFrame:
    """The number of rows whose id another row has already; reads the id column only."""
    return orders.agg((F.count(key) - F.count_distinct(key)).cast("bigint").alias("n"))


def quality_report(
    orders: DataFrame,
    domains: dict[str, list] | None = None,
    check_unique_ids: bool = True,
    schema=S.ORDERS_RAW,
) -> DataFrame:
    """One row per check: ``check_name`` and number of ``failures``.

    The checks of :func:`row_checks`, and duplicate ``order_id`` (count - count distinct).
    """
    checks = row_checks(domains, schema)
    if check_unique_ids:
        # One distinct aggregate in the same pass: Spark plans it as a two-phase
        # aggregate keyed by order_id (one shuffle), and the input plan runs once.
        checks.append(("duplicate_order_id",
                       (F.count("order_id") - F.count_distinct("order_id")).cast("bigint")))
    row = orders.agg(*[expr.alias(name) for name, expr in checks])
    return row.unpivot([], [name for name, _ in checks], "check_name", "failures")


def assert_clean(report: DataFrame) -> None:
    """Raise :class:`QualityError` listing every check with failures."""
    refuse({r["check_name"]: r["failures"] for r in report.filter(F.col("failures") > 0).collect()})  # at most one row per check


def refuse(failures: dict[str, int]) -> None:
    """Raise :class:`QualityError` if any count isn't zero."""
    bad = {name: n for name, n in failures.items() if n}
    if bad:
        raise QualityError("batch refused: " + ", ".join(f"{name}={n}" for name, n in bad.items()))
