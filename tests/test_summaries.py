"""JSON summary flattening (F6)."""

import pytest

from ledgerline.operators.summaries import flatten_summary


def flat(spark, js):
    df = spark.createDataFrame([("t", js)], "target string, summary_json string")
    return sorted((r.job_name, r.job_id) for r in flatten_summary(df).collect())


def test_f6_mixed_entries(spark):
    js = ('{"resources":{"jobs":{"k":{"name":"n","id":5},"k2":3,"k3":{"name":"","id":null},'
          '"k4":{},"k5":{"name":"z","id":0}}}}')
    assert flat(spark, js) == [("k2", None), ("k3", None), ("k4", None), ("n", "5"), ("z", None)]


@pytest.mark.parametrize("js", ["not json", "[1]", "{}", '{"resources":null}', '{"resources":{"jobs":{}}}',
                                '{"resources":{"jobs":null}}', '{"resources":{"jobs":[1]}}', None])
def test_f6_no_rows(spark, js):
    assert flat(spark, js) == []


def test_f6_duplicate_key_keeps_last_value(spark):
    js = '{"resources":{"jobs":{"a":{"name":"x","id":1},"b":2,"a":{"name":"y","id":2}}}}'
    assert flat(spark, js) == [("b", None), ("y", "2")]
