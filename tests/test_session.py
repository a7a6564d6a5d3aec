"""The shared work folder comes from the session's spark.checkpoint.dir."""

from ledgerline.plans import tables
from ledgerline.session import work_dir


def test_work_dir_is_the_configured_checkpoint_dir(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert configured and work_dir(spark) == configured.rstrip("/")


def test_scratch_schema_lives_under_work_dir(spark):
    schema = tables.scratch_schema(spark)
    loc = [r for r in spark.sql(f"DESCRIBE SCHEMA EXTENDED `{schema}`").collect()
           if r[0].lower() == "location"][0][1]
    assert work_dir(spark).split(":")[-1] in loc


def test_literal_table_empty_and_typed(spark):
    from ledgerline.sources.tables import literal_table

    cols = [("wanted", "string"), ("principal", "string")]
    empty = literal_table(spark, [], cols)
    assert empty.columns == ["wanted", "principal"] and empty.count() == 0
    two = literal_table(spark, [("a", None), ("b", "p")], cols)
    assert sorted(map(tuple, two.collect())) == [("a", None), ("b", "p")]
    from tests.oracle_compare import plan_text

    assert "ExistingRDD" not in plan_text(two)  # JVM-side relation, no Python RDD scan
