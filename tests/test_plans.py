"""Physical-plan properties: no cartesian products, no Python UDFs, pushed filters, partial aggregation."""

import contextlib
import io

import pytest

from ledgerline.plans.registry import QUERIES
from tests.oracle_compare import plan_text

WRITERS = {"land_orders", "publish_sales", "published_count", "pipeline_sales", "stream_sales"}


def plan_of(df):
    return plan_text(df)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS))
def test_no_cartesian_or_python(spark, sf001, name):
    plan = plan_of(QUERIES[name](spark, sf001))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                "FlatMapGroupsInPandas", "FlatMapGroupsInArrow", "MapInArrow", "MapInPandas", "PythonRDD"):
        assert bad not in plan, f"{name}: {bad}"


def test_flagship_pushes_and_partially_aggregates(spark, sf001):
    df = QUERIES["sales_by_region"](spark, sf001)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    assert "PushedFilters" in text
    assert text.count("HashAggregate") >= 2
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,l_quantity:double," \
           "l_discount:double>" in text
