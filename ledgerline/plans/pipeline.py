"""The two-step order job: land the raw batch, then publish the rollup.

ensure schema -> source (generated or given) -> conform -> write raw, checks observed on the
write -> ids checked on the written files -> land (a refused batch is never landed) -> read raw
table -> totals -> declare contract -> publish the groups that fit, and those that don't as a
table of refusals -> count.
The two steps hand data over through the landed table only, as two separate
tasks of a scheduled job would; the landed table also cuts the lineage.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ledgerline import schemas as S
from ledgerline.operators import quality
from ledgerline.operators.sales import refused_groups, report_groups, sales_totals
from ledgerline.plans import tables
from ledgerline.session import work_dir
from ledgerline.sources.generate import synthetic_orders


@dataclass
class PipelineResult:
    raw_table: str
    report_table: str
    landed_rows: int
    published_rows: int
    refused_table: str
    refused_rows: int


def ingest(spark: SparkSession, schema: str, catalog: str | None = None,
           source: DataFrame | None = None, n: int = S.ORDER_COUNT, seed: int = S.ORDER_SEED,
           domains: dict | None = None, check_unique_ids: bool = True,
           location: str | None = None) -> tuple[str, int]:
    """Step 1: land a checked batch in ``orders_raw``; returns (table, rows)."""
    tables.ensure_schema(spark, schema, catalog, location)
    raw_table = tables.table_name(schema, S.RAW_TABLE, catalog)
    if source is None:
        source = synthetic_orders(spark, n, seed)
        if domains is None:
            domains = {"region": S.ORDER_REGIONS, "product": S.ORDER_PRODUCTS,
                       "channel": S.ORDER_CHANNELS, "status": S.ORDER_STATUSES}
    _, rows = tables.land_checked(quality.conform(source), raw_table, quality.row_checks(domains),
                                  unique="order_id" if check_unique_ids else None)
    return raw_table, rows


def aggregate(spark: SparkSession, schema: str, catalog: str | None = None,
              exact: bool = True, as_of=None) -> tuple[str, int, str, int]:
    """Step 2: publish the rollup of ``orders_raw`` into ``sales_by_region``.

    Groups whose sums don't fit the contract go to ``sales_by_region_refused`` with their sums.
    Returns (report table, rows, refusal table, rows).  The totals are worked out once.
    """
    raw_table = tables.table_name(schema, S.RAW_TABLE, catalog)
    report_table = tables.table_name(schema, S.REPORT_TABLE, catalog)
    refused_table = tables.table_name(schema, S.REPORT_TABLE + "_refused", catalog)
    scratch = f"{work_dir(spark)}/totals-{uuid.uuid4().hex}"
    totals = sales_totals(spark.table(raw_table), exact)
    totals.write.parquet(scratch)
    totals = spark.read.schema(totals.schema).parquet(scratch)
    published = tables.publish(report_groups(totals, as_of), report_table)
    _, refused = tables.land_checked(refused_groups(totals), refused_table, [])
    return report_table, published, refused_table, refused


def run_pipeline(spark: SparkSession, schema: str = S.DEFAULT_SCHEMA, catalog: str | None = None,
                 source: DataFrame | None = None, n: int = S.ORDER_COUNT, seed: int = S.ORDER_SEED,
                 exact: bool = True, as_of=None, domains: dict | None = None,
                 check_unique_ids: bool = True, location: str | None = None) -> PipelineResult:
    raw_table, landed = ingest(spark, schema, catalog, source, n, seed, domains,
                               check_unique_ids, location)
    report_table, published, refused_table, refused = aggregate(spark, schema, catalog, exact, as_of)
    return PipelineResult(raw_table, report_table, landed, published, refused_table, refused)
