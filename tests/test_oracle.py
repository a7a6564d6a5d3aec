"""Every registered query equals its DuckDB reference SQL (sf0.001, and sf0.01 for the headline set)."""

import pytest

from ledgerline.plans import registry

import __spark_entry__ as E
from tests.oracle_compare import assert_same, duck

SQL = E.oracle_sql()
QUERIES = E.queries()
HEADLINE = ["sales_by_region", "resolve_jobs", "run_eta", "failed_tasks", "match_names",
            "ambiguous_names", "task_errors", "flatten_summary", "nested_failed_tasks", "status_by_run", "status_details",
            "cancel_by_run", "flatten_typed", "refused_sales", "rerun_fingerprint", "pipeline_sales"]


def test_every_query_has_an_oracle_except_rows_only():
    assert set(registry.QUERIES) == set(SQL) & set(registry.QUERIES)
    assert set(SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def con001(sf001):
    return duck(sf001)


@pytest.fixture(scope="module")
def con01(sf01):
    return duck(sf01)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle_sf0001(spark, sf001, con001, name):
    assert_same(QUERIES[name](spark, sf001), con001, SQL[name])


@pytest.mark.parametrize("name", HEADLINE)
def test_query_matches_oracle_sf001(spark, sf01, con01, name):
    assert_same(QUERIES[name](spark, sf01), con01, SQL[name])


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["region", "product", "order_count", "gross_revenue", "net_revenue",
                          "avg_order_value", "latest_order", "ingested_at"]
    assert df.count() > 0
