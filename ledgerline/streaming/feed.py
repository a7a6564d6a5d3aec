"""The sales rollup fed by a folder of order files, published incrementally.

Same operators as the batch job, delivered as a stream: new parquet files in
the order folder -> the (region, product) rollup as a stateful streaming
aggregation -> every micro-batch's complete result goes through the staged
contract publish in ``foreachBatch``.  Publishing the *complete* result is an
overwrite, so replaying a batch after a failure gives the same table
(idempotent sink).  Aggregation state is one row per (region, product) group;
checkpoints live under the shared work folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline import schemas as S
from ledgerline.operators import quality
from ledgerline.operators.sales import ingest_time, sales_by_region
from ledgerline.plans import tables
from ledgerline.session import work_dir


def order_stream(spark: SparkSession, source_path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet order files as a stream with the declared ``orders_raw`` schema (no inference)."""
    reader = spark.readStream.schema(S.ORDERS_RAW)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(source_path)


def stream_sales_rollup(
    spark: SparkSession,
    source_path: str,
    report_table: str,
    checkpoint: str | None = None,
    exact: bool = True,
    as_of=None,
    available_now: bool = True,
    processing_time: str | None = None,
    state_partitions: int | None = 16,
    domains: dict | None = None,
):
    """Start the streaming publish; returns the ``StreamingQuery``.

    ``available_now`` processes what is in the folder and stops (batch-like
    runs on a schedule); otherwise ``processing_time`` (e.g. "1 minute") keeps
    the query running.  ``state_partitions`` sizes the aggregation state: it
    holds one row per (region, product) group whatever the input volume, so a
    handful of partitions is right (the session default, often 200, would run
    that many near-empty state tasks per micro-batch).  The value is fixed in
    the checkpoint on the first run.  A row that fails the input checks (``domains``: see
    ``operators.quality.failing``) stops the query and is named; the report stays as it was.
    """
    if checkpoint is None:
        name = report_table.replace("`", "").replace(".", "_")
        checkpoint = f"{work_dir(spark)}/streams/{name}"
    orders = quality.enforced(order_stream(spark, source_path), domains)
    rollup = sales_by_region(orders, exact=exact, with_ingested_at=False)

    def publish_batch(batch: DataFrame, _epoch_id: int) -> None:
        tables.publish(batch.withColumn("ingested_at", ingest_time(as_of)), report_table)

    writer = (rollup.writeStream.outputMode("complete")
              .option("checkpointLocation", checkpoint)
              .foreachBatch(publish_batch))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    if state_partitions is None:
        return writer.start()
    # The query runs in a clone of the session taken at start(), so the setting
    # applies to this query only and the session is restored right after.
    key = "spark.sql.shuffle.partitions"
    previous = spark.conf.get(key)
    spark.conf.set(key, str(state_partitions))
    try:
        return writer.start()
    finally:
        spark.conf.set(key, previous)


def land_order_files(orders: DataFrame, path: str) -> str:
    """Write a batch of orders as parquet files into a stream source folder."""
    orders.select(*[F.col(f.name).cast(f.dataType) for f in S.ORDERS_RAW.fields]) \
        .write.mode("append").parquet(path)
    return path
