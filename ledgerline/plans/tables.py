"""Landing, the declared report table and its publish by versions.

On open-source Spark a parquet ``saveAsTable(mode="overwrite")`` *replaces*
a declared table (types widen or narrow to the DataFrame's, comments vanish),
and an overwriting insert that fails half way leaves the table empty.  So a
publish here

1. checks the DataFrame's columns against the contract as a set,
2. declares the report table from the contract, and refuses a table whose columns,
   types, order or comments differ from it,
3. writes the rows into a *version folder* of their own beside the table, cast to the
   contract -- every cast (and any DECIMAL overflow) happens in this step,
4. checks the keys of the written version (non-null, unique) with one aggregate,
5. points the table at the version: ``ALTER TABLE ... SET LOCATION``, one change in the
   catalog, which is the pointer that readers resolve,
6. removes versions that were replaced some time ago, and returns the row count.

A job that dies anywhere before 5 leaves the table as it was; after 5 it is published whole.
The version also cuts the lineage: everything after 3 reads files, not the plan.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ledgerline import schemas as S
from ledgerline.operators import quality
from ledgerline.session import work_dir

#: How long a replaced version is kept for readers that began before.
RETAIN_SECONDS = 3600


class ContractError(ValueError):
    """A batch does not fit the declared report contract."""


def table_name(schema: str, table: str, catalog: str | None = None) -> str:
    parts = [p for p in (catalog, schema, table) if p]
    return ".".join(f"`{p}`" for p in parts)


def ensure_schema(spark: SparkSession, schema: str, catalog: str | None = None,
                  location: str | None = None) -> str:
    """``CREATE SCHEMA IF NOT EXISTS`` (optionally at a shared ``location``)."""
    name = ".".join(f"`{p}`" for p in (catalog, schema) if p)
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}{loc}")
    return name


def scratch_schema(spark: SparkSession, prefix: str = "ledgerline") -> str:
    """A fresh schema located under the shared work folder."""
    schema = f"{prefix}_{uuid.uuid4().hex[:12]}"
    ensure_schema(spark, schema, location=f"{work_dir(spark)}/{schema}.db")
    return schema


def land(df: DataFrame, table: str) -> DataFrame:
    """Full overwrite landing; the table takes the DataFrame's schema."""
    df.write.mode("overwrite").format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def land_checked(df: DataFrame, table: str, checks: list[tuple[str, Column]], unique: str | None = None) -> tuple[DataFrame, int]:
    """Land a batch, counting failures while it is written; a refused batch never replaces the table.

    ``checks`` are observed on the write itself, so the source is read once.  ``unique`` names an id
    column without repeats; it is checked on the written version, reading that column only.
    Returns (table, rows).  The table takes the DataFrame's schema.
    """
    spark = df.sparkSession
    version = _new_version(spark, table)
    seen = Observation(f"landing-{uuid.uuid4().hex}")
    df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[check.alias(name) for name, check in checks]).write.parquet(version)
    counts = dict(seen.get)
    rows = counts.pop("n_rows")
    written = spark.read.schema(df.schema).parquet(version)
    if unique:
        counts[f"duplicate_{unique}"] = quality.duplicate_ids(written, unique).first()[0]
    try:
        quality.refuse(counts)
    except quality.QualityError:
        _delete(spark, version)
        raise
    _promote(spark, table, version, df.schema)
    return spark.table(table), rows


def _hadoop_path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    found, files = _hadoop_path(spark, path)
    files.delete(found, True)


def _versions_folder(spark: SparkSession, table: str) -> str:
    parts = [p.strip("`") for p in table.split(".")]
    schema = ".".join(f"`{p}`" for p in parts[:-1]) or spark.catalog.currentDatabase()
    place = spark.sql(f"DESCRIBE SCHEMA {schema}").filter("lower(info_name) = 'location'").first()["info_value"]
    return f"{place.rstrip('/')}/{parts[-1]}__versions"


def _new_version(spark: SparkSession, table: str) -> str:
    """A folder for a version; its name begins with the time, so that old ones can be told."""
    return f"{_versions_folder(spark, table)}/{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:12]}"


def current_version(spark: SparkSession, table: str) -> str:
    """Where the table's files are."""
    return spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'").first()["data_type"]


def _promote(spark: SparkSession, table: str, version: str, schema: T.StructType | None = None) -> None:
    """Point the table at a written version.  ``schema`` replaces the table's where they differ."""
    if schema is not None:
        have = [(f.name, f.dataType) for f in spark.table(table).schema] if spark.catalog.tableExists(table) else None
        if have != [(f.name, f.dataType) for f in schema]:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            spark.sql(f"CREATE TABLE {table} ({columns}) USING PARQUET LOCATION '{version}'")
            return
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{version}'")
    spark.catalog.refreshTable(table)


def expire_versions(spark: SparkSession, table: str, retain_seconds: float = RETAIN_SECONDS) -> int:
    """Remove versions older than ``retain_seconds`` but for the current one; readers that began before may still use younger ones."""
    folder, files = _hadoop_path(spark, _versions_folder(spark, table))
    if not files.exists(folder):
        return 0
    oldest = int((time.time() - retain_seconds) * 1000)
    current = current_version(spark, table).rstrip("/").rsplit("/", 1)[-1]
    gone = 0
    for entry in files.listStatus(folder):
        name = entry.getPath().getName()
        if name != current and int(name.split("-")[0]) <= oldest:
            files.delete(entry.getPath(), True)
            gone += 1
    return gone


def declare_contract(spark: SparkSession, table: str, columns=S.SALES_COLUMNS,
                     comment: str = S.SALES_TABLE_COMMENT) -> None:
    """``CREATE TABLE IF NOT EXISTS`` with pinned types and column comments."""
    quoted = comment.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} (\n    {S.contract_ddl(columns)}\n)\n"
        f"USING PARQUET\nCOMMENT '{quoted}'"
    )


def check_columns(df: DataFrame, columns=S.SALES_COLUMNS) -> None:
    want = [name for name, _, _ in columns]
    missing = sorted(set(want) - set(df.columns))
    extra = sorted(set(df.columns) - set(want))
    if missing or extra:
        raise ContractError(f"columns do not match the contract: missing={missing} extra={extra}")


def key_violations(df: DataFrame, keys=S.SALES_KEY) -> DataFrame:
    """One row: ``null_keys`` and ``duplicate_keys`` (count - distinct count)."""
    key_null = F.lit(False)
    for k in keys:
        key_null = key_null | F.col(k).isNull()
    return df.agg(
        F.count_if(key_null).cast("bigint").alias("null_keys"),
        (F.count(F.lit(1)) - F.count_distinct(*[F.col(k) for k in keys])).cast("bigint")
        .alias("duplicate_keys"),
    )


def stage(df: DataFrame, table: str, columns=S.SALES_COLUMNS, keys=S.SALES_KEY, comment: str = S.SALES_TABLE_COMMENT) -> str:
    """Write and check a version of ``table`` under its contract, without publishing it; returns its folder."""
    spark = df.sparkSession
    check_columns(df, columns)
    declare_contract(spark, table, columns, comment)
    check_table(spark, table, columns)
    version = _new_version(spark, table)
    try:
        df.select(*[F.col(name).cast(kind).alias(name) for name, kind, _ in columns]).write.parquet(version)
        written = spark.read.schema(", ".join(f"`{name}` {kind}" for name, kind, _ in columns)).parquet(version)
        bad = key_violations(written, keys).first()
        if bad["null_keys"] or bad["duplicate_keys"]:
            raise ContractError(
                f"staged batch has {bad['null_keys']} null and {bad['duplicate_keys']} duplicate keys")
    except Exception:
        _delete(spark, version)
        raise
    return version


def publish(df: DataFrame, table: str, columns=S.SALES_COLUMNS, keys=S.SALES_KEY,
            comment: str = S.SALES_TABLE_COMMENT) -> int:
    """Replace the rows of ``table`` under its contract; returns the published row count."""
    spark = df.sparkSession
    _promote(spark, table, stage(df, table, columns, keys, comment))
    expire_versions(spark, table)
    return spark.table(table).count()


def check_table(spark: SparkSession, table: str, columns=S.SALES_COLUMNS) -> None:
    """An existing table must have the contract's columns, types, order and comments."""
    want = [(name, _simple(kind), comment) for name, kind, comment in columns]
    have = [(f.name, f.dataType.simpleString(), f.metadata.get("comment")) for f in spark.table(table).schema]
    if want != have:
        raise ContractError(f"{table} differs from the contract: {have}")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row, ``n_rows, hash_a, hash_b``: equal for tables of equal rows in any order, repeats counted.

    Sums of two row hashes with different seeds, in decimals that can't overflow: a partial aggregate
    that moves no rows.  Columns are taken by name, so their order doesn't matter either.
    """
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    # A null and its neighbour's value hash alike, so each column tells whether it is null.
    parts = [part for c in columns for part in (c.isNull(), c)]
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.coalesce(F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(28,0)")), F.lit(0)).cast("decimal(38,0)").alias(name)
          for seed, name in ((1, "hash_a"), (2, "hash_b"))])


def _simple(kind: str) -> str:
    return T.DataType.fromDDL(kind).simpleString()


def published_count(spark: SparkSession, table: str) -> DataFrame:
    """Row count of the *written* table (not a recount of the lazy plan)."""
    return spark.table(table).agg(F.count(F.lit(1)).alias("published_rows"))


def describe_contract(spark: SparkSession, table: str) -> DataFrame:
    """``col_name, data_type, comment`` of the table as the catalog holds it."""
    d = spark.sql(f"DESCRIBE TABLE {table}")
    return d.filter((F.col("col_name") != F.lit("")) & ~F.col("col_name").startswith("#"))
