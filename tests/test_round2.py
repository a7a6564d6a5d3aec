"""Line money without caps, requests resolved one by one, publishing into a verified table."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerline import schemas as S
from ledgerline.functions.money import gross_amount, net_amount
from ledgerline.operators.names import ambiguous_candidates, resolve_jobs
from ledgerline.plans import tables as P

JOBS = "job_id long, name string, deployment_kind string, creator_user_name string, run_as_user_name string"
REQUESTS = "wanted string, principal string"


@pytest.mark.parametrize("price,quantity,gross", [(5e8, 1, "500000000.00"), (1.0, 20_000_000, "20000000.00"),
                                                  (600_000.0, 2_000, "1200000000.00"), (None, 1, "None")])
def test_large_lines_are_exact(spark, price, quantity, gross):
    df = spark.createDataFrame([(price, quantity)], "p double, q int")
    assert str(df.select(gross_amount(F.col("p"), F.col("q"))).first()[0]) == gross


def test_excess_decimals_are_refused(spark):
    df = spark.createDataFrame([(100.0, 1, 0.12345)], "p double, q int, d double")
    with pytest.raises(Exception, match="more decimals"):
        df.select(net_amount(gross_amount(F.col("p"), F.col("q")), F.col("d"))).collect()
    with pytest.raises(Exception, match="more decimals"):
        df.select(gross_amount(F.lit(1.005), F.col("q"))).collect()


def test_requests_of_one_name_are_resolved_alone(spark):
    jobs = spark.createDataFrame([(1, "etl", None, "a", None), (2, "etl", None, "b", None), (3, "report", None, None, None)], JOBS)
    asked = [("report", "a"), ("report", "a"), ("etl", "a"), ("etl", "B"), ("etl", "x"), ("etl", None), ("etl", ""), ("no", "a")]
    got = resolve_jobs(jobs, spark.createDataFrame(asked, REQUESTS)).collect()
    seen = sorted((r.wanted, r.status, r.n_candidates, r.job_id) for r in got if r.job_id)
    assert seen == [("etl", "RESOLVED", 1, 1), ("etl", "RESOLVED", 1, 2), ("report", "RESOLVED", 1, 3), ("report", "RESOLVED", 1, 3)]
    assert sorted((r.wanted, r.status, r.n_candidates) for r in got if not r.job_id) == [
        ("etl", "AMBIGUOUS", 2)] * 3 + [("no", "NOT_FOUND", 0)]
    listed = ambiguous_candidates(jobs, spark.createDataFrame([("etl", "a"), ("etl", "x"), ("etl", "x")], REQUESTS)).collect()
    assert sorted(r.job_id for r in listed) == [1, 2]


def row(spark):
    one = [("us", "w", 1, 2.0, 2.0, 2.0, datetime(2024, 1, 1), datetime(2024, 1, 2))]
    return spark.createDataFrame(one, [n for n, _, _ in S.SALES_COLUMNS])


@pytest.mark.parametrize("change", ["swap", "type", "missing"])
def test_publish_refuses_a_table_that_differs(spark, change):
    schema = P.scratch_schema(spark)
    table = P.table_name(schema, "sales")
    columns = list(S.SALES_COLUMNS)
    if change == "swap":
        columns[0], columns[1] = columns[1], columns[0]
    elif change == "type":
        columns[2] = (columns[2][0], "INT", columns[2][2])
    else:
        columns.pop()
    P.declare_contract(spark, table, columns)
    with pytest.raises(P.ContractError):
        P.publish(row(spark), table)
    assert spark.table(table).count() == 0


def test_publishing_twice_gives_the_same_rows_and_leaves_no_staging(spark):
    schema = P.scratch_schema(spark)
    table = P.table_name(schema, "sales")
    for _ in range(2):
        assert P.publish(row(spark), table) == 1
    assert [t.name for t in spark.catalog.listTables(schema)] == ["sales"]
    assert spark.table(table).first().region == "us"
