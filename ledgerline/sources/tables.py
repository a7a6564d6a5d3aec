"""Reading input tables.

Inputs are parquet; Spark prunes columns and pushes filters into the scan by
itself, so readers return the plain scan and callers select what they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


# --- fixed values: schemas of the input tables --------------------------------------
# Declared rather than inferred: inference reads parquet footers in a Spark job
# on every read (costly over thousands of files) and silently follows drift.
TABLE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": ("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                 "c_mktsegment string"),
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
             "p_retailprice double"),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                 "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                 "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    "events": ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
               "value double, props string"),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table_path(base_dir: str, name: str) -> str:
    return f"{base_dir.rstrip('/')}/{name}.parquet"


class SchemaDrift(ValueError):
    """A file's columns are not those declared for its table."""


# What a reader may widen: the declared type of a column, and the file types it also takes.
_WIDER = {"bigint": {"int", "smallint", "tinyint"}, "int": {"smallint", "tinyint"}, "double": {"float"},
          "timestamp_ntz": {"timestamp"}, "timestamp": {"timestamp_ntz"}}
_checked: set[tuple] = set()


def check_drift(spark: SparkSession, path: str, declared: T.StructType) -> None:
    """Raise :class:`SchemaDrift` if one footer lacks a declared column or has it in another type.

    With a declared schema a missing or renamed column would be read as nulls without a word.
    Other columns may come along.  A folder is looked at again when it has changed.
    """
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = found.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(found)
    mark = (spark.sparkContext.applicationId, path, status.getModificationTime(), status.getLen(), declared.simpleString())
    if mark in _checked:
        return
    have = {f.name: f.dataType.simpleString() for f in spark.read.parquet(path).schema}
    wrong = []
    for field in declared:
        want = field.dataType.simpleString()
        if field.name not in have:
            wrong.append(f"{field.name} is missing")
        elif have[field.name] != want and have[field.name] not in _WIDER.get(want, ()):
            wrong.append(f"{field.name} is {have[field.name]}, not {want}")
    if wrong:
        raise SchemaDrift(f"{path}: {', '.join(wrong)}")
    _checked.add(mark)


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """One parquet table ``<base_dir>/<name>.parquet``, with its declared schema if known; drift from that raises."""
    path = table_path(base_dir, name)
    if name not in TABLE_SCHEMAS:
        return spark.read.parquet(path)
    check_drift(spark, path, T.StructType.fromDDL(TABLE_SCHEMAS[name]))
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(path)


def literal_table(spark: SparkSession, rows: list[tuple], columns: list[tuple[str, str]]) -> DataFrame:
    """A small parameter table (e.g. request lists) built JVM-side from literals.

    ``spark.createDataFrame`` on a Python list plans as a scan of a Python RDD:
    it needs Python workers and carries no size statistics, so Spark will not
    broadcast it.  An inline array of literal structs is a JVM-only relation
    with a known (tiny) size.
    """
    structs = [
        F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, columns)])
        for row in rows
    ]
    empty = F.array().cast(f"array<struct<{','.join(f'{n}:{t}' for n, t in columns)}>>")
    arr = F.array(*structs) if structs else empty
    return spark.range(1).select(F.inline(arr))
