"""Schemas, the report-table contract and the fixed value sets.

Everything in the "fixed values" blocks must equal what the order job and the
run-history tools use, so the results line up; they are written out plainly.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: synthetic order source -------------------------------------
ORDER_REGIONS = ["us-east", "us-west", "eu-west", "eu-central", "ap-southeast"]
ORDER_PRODUCTS = ["widget-a", "widget-b", "gadget-x", "gadget-y", "service-z"]
ORDER_STATUSES = ["completed", "pending", "cancelled", "refunded"]
ORDER_CHANNELS = ["web", "partner", "field-sales"]
ORDER_DISCOUNTS = [0.0, 0.0, 0.05, 0.1, 0.15, 0.25]
ORDER_COUNT = 5000
ORDER_SEED = 42
ORDER_ID_FORMAT = "order-%05d"
ORDER_PRICE_MIN = 10.0
ORDER_PRICE_MAX = 500.0
ORDER_QTY_MIN = 1
ORDER_QTY_MAX = 20
ORDER_START = "2024-01-01 00:00:00"
ORDER_HOURS = 8760
COMPLETED = "completed"

# --- job parameters (defaults; catalog/schema are arguments) -------------------
DEFAULT_SCHEMA = "sales_reporting"
# --- fixed values: table names ----------------------------------------------------
RAW_TABLE = "orders_raw"
REPORT_TABLE = "sales_by_region"

# --- fixed values: run life-cycle and result state names -----------------------
FAILED_RESULT_STATES = ["FAILED", "TIMEDOUT", "SUCCESS_WITH_FAILURES", "UPSTREAM_FAILED"]
INTERNAL_ERROR = "INTERNAL_ERROR"
ACTIVE_LIFE_CYCLE_STATES = [
    "QUEUED", "PENDING", "RUNNING", "TERMINATING", "BLOCKED", "WAITING_FOR_RETRY",
]
TERMINAL_LIFE_CYCLE_STATES = ["TERMINATED", "SKIPPED", "INTERNAL_ERROR"]
ETA_SAMPLE_RUNS = 10
TRACE_TAIL_CHARS = 4000
NO_TRACE_NOTE = "(No exception trace recorded for this task.)"
UNKNOWN_LIFE_CYCLE = "UNKNOWN"

# The raw order table.  Non-null is a data check (see operators.quality): a
# NOT NULL flag does not survive a parquet saveAsTable round trip.  The order
# time is a wall-clock value without zone, so it is TIMESTAMP_NTZ.
ORDERS_RAW = T.StructType([
    T.StructField("order_id", T.StringType(), False),
    T.StructField("region", T.StringType(), False),
    T.StructField("product", T.StringType(), False),
    T.StructField("channel", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("unit_price", T.DoubleType(), False),
    T.StructField("quantity", T.IntegerType(), False),
    T.StructField("discount_pct", T.DoubleType(), False),
    T.StructField("order_date", T.TimestampNTZType(), False),
])

# --- fixed values: the report-table contract ----------------------------------
SALES_TABLE_COMMENT = "Completed-order revenue by region and product"
SALES_COLUMNS = [
    ("region", "STRING", "Sales region the order was placed in"),
    ("product", "STRING", "Product SKU"),
    ("order_count", "BIGINT", "Number of completed orders"),
    ("gross_revenue", "DECIMAL(12,2)", "Revenue at list price"),
    ("net_revenue", "DECIMAL(12,2)", "Revenue after promotional discounts"),
    ("avg_order_value", "DOUBLE", "Mean net revenue per completed order"),
    ("latest_order", "TIMESTAMP", "Timestamp of the most recent order"),
    ("ingested_at", "TIMESTAMP", "When this snapshot was published"),
]
SALES_KEY = ["region", "product"]

_SQL_TYPES = {
    "STRING": T.StringType(),
    "BIGINT": T.LongType(),
    "DECIMAL(12,2)": T.DecimalType(12, 2),
    "DOUBLE": T.DoubleType(),
    "TIMESTAMP": T.TimestampType(),
}


def contract_struct(columns=SALES_COLUMNS) -> T.StructType:
    """The contract as a StructType, comments kept as column metadata."""
    fields = []
    for name, sql_type, comment in columns:
        dtype = _SQL_TYPES[sql_type]
        fields.append(T.StructField(name, dtype, True, {"comment": comment}))
    return T.StructType(fields)


def contract_ddl(columns=SALES_COLUMNS) -> str:
    """Column list for CREATE TABLE, with comments quoted for SQL."""
    parts = []
    for name, sql_type, comment in columns:
        quoted = comment.replace("\\", "\\\\").replace("'", "\\'")
        parts.append(f"`{name}` {sql_type} COMMENT '{quoted}'")
    return ",\n    ".join(parts)


# Run-history tables, shaped by the attributes the tools read.
TERMINATION = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("message", T.StringType()),
])
TASK = T.StructType([
    T.StructField("task_key", T.StringType()),
    T.StructField("run_id", T.LongType()),
    T.StructField("result_state", T.StringType()),
    T.StructField("state_message", T.StringType()),
    T.StructField("termination", TERMINATION),
])
JOBS = T.StructType([
    T.StructField("job_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("deployment_kind", T.StringType()),
    T.StructField("creator_user_name", T.StringType()),
    T.StructField("run_as_user_name", T.StringType()),
])
RUNS = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("job_id", T.LongType()),
    T.StructField("run_name", T.StringType()),
    T.StructField("life_cycle_state", T.StringType()),
    T.StructField("result_state", T.StringType()),
    T.StructField("state_message", T.StringType()),
    T.StructField("start_time", T.LongType()),
    T.StructField("execution_duration", T.LongType()),
    T.StructField("run_duration", T.LongType()),
    T.StructField("run_page_url", T.StringType()),
    T.StructField("termination", TERMINATION),
    T.StructField("tasks", T.ArrayType(TASK)),
])
RUN_TASKS = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("task_key", T.StringType()),
    T.StructField("task_run_id", T.LongType()),
    T.StructField("result_state", T.StringType()),
    T.StructField("state_message", T.StringType()),
    T.StructField("termination", TERMINATION),
])
TASK_OUTPUTS = T.StructType([
    T.StructField("task_run_id", T.LongType()),
    T.StructField("error", T.StringType()),
    T.StructField("error_trace", T.StringType()),
    T.StructField("notebook_result", T.StringType()),
])
DEPLOY_SUMMARIES = T.StructType([
    T.StructField("target", T.StringType()),
    T.StructField("summary_json", T.StringType()),
])
