"""Reference SQL (DuckDB dialect) for every registered query.

Each statement recomputes its query's answer independently over the raw test
tables (views ``lineitem``, ``orders``, ... registered by the caller), written
the straightforward way (theta joins, windows, literal narrowing), so it checks
the Spark plans rather than mirroring them.
"""

from __future__ import annotations

# B1: orders_raw from the TPC-H-like tables.
ORDERS_RAW = """
orders_raw AS (
  SELECT 'order-' || CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS order_id,
         r.r_name AS region, p.p_type AS product, c.c_mktsegment AS channel,
         CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'pending'
                              WHEN 'O' THEN 'cancelled' END AS status,
         p.p_retailprice AS unit_price, CAST(l.l_quantity AS INTEGER) AS quantity,
         l.l_discount AS discount_pct, o.o_orderdate AS order_date
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""

PRICED = ORDERS_RAW + """,
priced AS (
  SELECT *,
         CAST(CAST(unit_price AS DECIMAL(12,2)) * CAST(quantity AS DECIMAL(10,0)) AS DECIMAL(23,2)) AS gross_revenue,
         CAST(CAST(CAST(unit_price AS DECIMAL(12,2)) * CAST(quantity AS DECIMAL(10,0)) AS DECIMAL(23,2))
              * (CAST(1 AS DECIMAL(5,4)) - CAST(discount_pct AS DECIMAL(5,4))) AS DECIMAL(29,6)) AS net_revenue
  FROM orders_raw WHERE status = 'completed'
)"""

SALES = PRICED + """,
sales AS (
  SELECT region, product,
         COUNT(order_id) AS order_count,
         CAST(SUM(gross_revenue) AS DECIMAL(12,2)) AS gross_revenue,
         CAST(SUM(net_revenue) AS DECIMAL(12,2)) AS net_revenue,
         CAST(SUM(net_revenue) AS DOUBLE) / COUNT(net_revenue) AS avg_order_value,
         MAX(order_date) AS latest_order
  FROM priced GROUP BY region, product
)"""



JOBS_B = r"""
jobs_b AS (
  SELECT p_partkey AS job_id,
         COALESCE(CASE WHEN p_partkey % 3 = 0 THEN '[dev u' || CAST(p_size AS VARCHAR) || '] ' END, '')
           || replace(p_name, ' ', '_') AS name,
         CASE WHEN p_size > 25 THEN 'BUNDLE' END AS deployment_kind,
         p_brand AS creator_user_name,
         CASE WHEN p_size % 2 = 0 THEN upper(p_brand) END AS run_as_user_name
  FROM part
)"""

WANTED_DERIVED = r"""
wanted AS (
  SELECT wanted, 'Brand#13' AS principal FROM (
    SELECT name AS wanted FROM jobs_b
    UNION
    SELECT regexp_replace(name, '^\[[^\]]*\]\s*', '') AS wanted FROM jobs_b
    UNION
    SELECT * FROM (VALUES ('cold'), ('small_widget'), ('nope'), ('large')) AS v(wanted)
  )
)"""

WANTED_MIXED = r"""
wanted AS (
  SELECT CASE WHEN p_partkey % 3 = 0 THEN 'hot' WHEN p_partkey % 17 = 1 THEN NULL WHEN p_partkey % 19 = 1 THEN ''
              WHEN p_partkey % 3 = 1 THEN j.name ELSE regexp_replace(j.name, '^\[[^\]]*\]\s*', '') END AS wanted,
         CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 1 THEN upper(p_brand) WHEN 2 THEN 'Brand#13' WHEN 3 THEN '' END AS principal
  FROM part JOIN jobs_b j ON p_partkey = j.job_id
)"""

ROUTED = r"""
routed AS (
  SELECT CASE WHEN event_id % 3 = 1 THEN 0 WHEN event_id % 10 = 0 THEN -event_id ELSE event_id END AS run_id,
         event_type AS wanted, 'Brand#13' AS principal
  FROM events
)"""

# Requests are resolved one by one: windows over the matches of one (name, caller).
NARROW = r"""
asked AS (SELECT DISTINCT wanted, lower(COALESCE(principal, '')) AS caller FROM wanted),
matched AS (
  SELECT w.wanted, w.caller, j.*
  FROM asked w
  JOIN (SELECT *, regexp_replace(name, '^\[[^\]]*\]\s*', '') AS base
        FROM jobs_b WHERE name IS NOT NULL AND name <> '') j
    ON j.name = w.wanted OR j.base = w.wanted OR starts_with(j.base, w.wanted || '_')
),
flagged AS (
  SELECT wanted, caller, job_id, name, deployment_kind IS NOT NULL AS managed,
         caller <> '' AND caller IN (lower(COALESCE(creator_user_name, '')), lower(COALESCE(run_as_user_name, ''))) AS owned
  FROM matched
),
s1 AS (SELECT *, count(*) OVER (PARTITION BY wanted, caller) AS c1,
              bool_or(managed) OVER (PARTITION BY wanted, caller) AS any_m FROM flagged),
f1 AS (SELECT * FROM s1 WHERE c1 <= 1 OR NOT any_m OR managed),
s2 AS (SELECT *, count(*) OVER (PARTITION BY wanted, caller) AS c2,
              bool_or(owned) OVER (PARTITION BY wanted, caller) AS any_o FROM f1),
f2 AS (SELECT *, count(*) OVER (PARTITION BY wanted, caller) AS c3 FROM s2 WHERE c2 <= 1 OR NOT any_o OR owned)"""

RESOLVE = """
agg AS (SELECT wanted, caller, count(*) AS n, min(job_id) AS jid, min(name) AS nm FROM f2 GROUP BY wanted, caller),
res AS (
  SELECT w.wanted,
         CASE WHEN agg.n IS NULL THEN 'NOT_FOUND' WHEN agg.n = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status,
         CAST(COALESCE(agg.n, 0) AS BIGINT) AS n_candidates,
         CASE WHEN agg.n = 1 THEN agg.jid END AS job_id,
         CASE WHEN agg.n = 1 THEN agg.nm END AS job_name
  FROM wanted w LEFT JOIN agg ON w.wanted = agg.wanted AND lower(COALESCE(w.principal, '')) = agg.caller
)"""

JOBS = JOBS_B + "," + WANTED_MIXED + "," + NARROW

FAILED_STATES = "('FAILED', 'TIMEDOUT', 'SUCCESS_WITH_FAILURES', 'UPSTREAM_FAILED')"
ACTIVE_STATES = "('QUEUED', 'PENDING', 'RUNNING', 'TERMINATING', 'BLOCKED', 'WAITING_FOR_RETRY')"
TERMINAL_STATES = "('TERMINATED', 'SKIPPED', 'INTERNAL_ERROR')"
RESULT_MAP = ("CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED' "
              "WHEN 'click' THEN 'TIMEDOUT' WHEN 'signup' THEN 'CANCELED' END")
TERM_CODE = ("CASE event_type WHEN 'error' THEN 'RUN_EXECUTION_ERROR' WHEN 'click' THEN 'TIMEOUT' "
             "WHEN 'signup' THEN '' END")
TERM_MESSAGE = ("CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN '' "
                "ELSE 'event ' || CAST(event_id AS VARCHAR) END")

RUNS = f"""
runs AS (
  SELECT event_id AS run_id, user_id AS job_id,
         CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN NULL
              ELSE event_type || '-' || CAST(event_id AS VARCHAR) END AS run_name,
         CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'PENDING' ELSE 'RUNNING' END
              WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'INTERNAL_ERROR'
              WHEN event_type = 'signup' AND event_id % 9 = 0 THEN NULL
              ELSE 'TERMINATED' END AS life_cycle_state,
         CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN NULL ELSE {RESULT_MAP} END AS result_state,
         CASE WHEN event_type IN ('error', 'click') THEN event_type || ' ' || props END AS state_message,
         epoch_us(ts) // 1000 AS start_time,
         CAST(floor(value) AS BIGINT) * 1000 AS execution_duration,
         CASE WHEN event_id % 2 = 0 THEN CAST(floor(value * 1000) AS BIGINT) END AS run_duration,
         'runs/' || CAST(event_id AS VARCHAR) AS run_page_url,
         {TERM_CODE} AS term_code,
         CASE WHEN {TERM_CODE} IS NOT NULL THEN {TERM_MESSAGE} END AS term_message
  FROM events
),
durations AS (
  SELECT run_id, NULLIF(COALESCE(NULLIF(execution_duration, 0), run_duration), 0) AS d FROM runs
),
classified AS (
  SELECT *,
         COALESCE(result_state IN {FAILED_STATES}, false)
           OR COALESCE(life_cycle_state = 'INTERNAL_ERROR', false) AS is_failed
  FROM runs
)"""

OUTCOME = ("CASE WHEN is_failed THEN 'FAILED' WHEN life_cycle_state = 'RUNNING' THEN 'RUNNING' "
           "WHEN result_state = 'SUCCESS' THEN 'SUCCESS' ELSE 'OTHER' END")


def _mmss(sec: str) -> str:
    return (f"CASE WHEN {sec} IS NOT NULL THEN format('{{}}m {{}}s', ({sec}) // 60, ({sec}) % 60) END")


ETA = """
done AS (SELECT * FROM runs WHERE life_cycle_state IN """ + TERMINAL_STATES + """),
ranked AS (
  SELECT job_id, execution_duration,
         row_number() OVER (PARTITION BY job_id ORDER BY start_time DESC NULLS LAST, run_id DESC) AS rn
  FROM done
),
eta AS (
  SELECT job_id, CAST(count(NULLIF(execution_duration, 0)) AS BIGINT) AS runs_used,
         avg(NULLIF(execution_duration, 0) / 1000.0::DOUBLE) AS eta_seconds
  FROM ranked WHERE rn <= 10 GROUP BY job_id
),
eta_t AS (
  SELECT *, """ + _mmss("CAST(trunc(eta_seconds) AS BIGINT)") + """ AS eta_text FROM eta
),
active AS (
  SELECT job_id, run_id, start_time,
         row_number() OVER (PARTITION BY job_id ORDER BY start_time DESC, run_id DESC) AS rn,
         count(*) OVER (PARTITION BY job_id) AS cnt
  FROM runs WHERE life_cycle_state IN """ + ACTIVE_STATES + """
)"""

TASKS = f"""
tasks AS (
  SELECT event_id - event_id % 4 AS run_id, 'task-' || CAST(event_id AS VARCHAR) AS task_key, event_id AS task_run_id,
         CASE WHEN event_type = 'view' THEN NULL ELSE {RESULT_MAP} END AS result_state,
         CASE WHEN event_type IN ('error', 'click') THEN event_type || ' ' || props END AS state_message,
         {TERM_CODE} AS term_code,
         CASE WHEN {TERM_CODE} IS NOT NULL THEN {TERM_MESSAGE} END AS term_message
  FROM events
),
failed_runs AS (SELECT run_id FROM classified WHERE is_failed),
tf AS (
  SELECT t.*, COALESCE(result_state IN {FAILED_STATES}, false) AS f,
         bool_or(COALESCE(result_state IN {FAILED_STATES}, false)) OVER (PARTITION BY run_id) AS anyf
  FROM tasks t WHERE run_id IN (SELECT run_id FROM failed_runs)
),
selected AS (
  SELECT run_id, task_key, task_run_id, result_state, state_message,
         NULLIF(concat_ws(' - ', NULLIF(term_code, ''), NULLIF(term_message, '')), '') AS termination_summary,
         CASE WHEN anyf THEN 'failed' ELSE 'not_success' END AS reason
  FROM tf WHERE CASE WHEN anyf THEN f ELSE result_state IS DISTINCT FROM 'SUCCESS' END
  UNION ALL
  SELECT run_id, NULL, run_id, NULL, NULL, NULL, 'no_tasks'
  FROM failed_runs WHERE run_id NOT IN (SELECT run_id FROM tasks)
)"""

OUTPUTS = """
outs AS (
  SELECT doc_id AS task_run_id,
         NULLIF(CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN ''
                     ELSE 'Exception in ' || source END, '') AS error,
         NULLIF(right(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END, 4000), '') AS trace_tail,
         NULLIF(CASE WHEN doc_id % 4 = 0 THEN lang END, '') AS notebook_result
  FROM documents
)"""

SUMMARIES = """
summ AS (
  SELECT 't' || CAST(event_id AS VARCHAR) AS target,
         CASE event_id % 13
           WHEN 0 THEN 'not json'
           WHEN 1 THEN '{"resources":{"jobs":' || props || '}}'
           WHEN 2 THEN '{"resources":{"jobs":{}}}'
           ELSE '{"resources":{"jobs":{"job_' || CAST(user_id AS VARCHAR) || '":{"name":"'
                || CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END
                || '","id":' || CAST(user_id AS VARCHAR) || '},"cfg_' || event_type || '":' || props || '}}}'
         END AS summary_json
  FROM events
),
jv AS (SELECT target, json_extract(summary_json, '$.resources.jobs') AS jobs FROM summ
       WHERE json_valid(summary_json)),
jk AS (SELECT target, jobs, unnest(json_keys(jobs)) AS job_key FROM jv WHERE json_type(jobs) = 'OBJECT'),
je AS (SELECT target, job_key, json_extract(jobs, '$."' || job_key || '"') AS info FROM jk),
ji AS (SELECT target, job_key, json_type(info) = 'OBJECT' AS is_obj,
              info ->> 'name' AS nm, info ->> 'id' AS id_text FROM je)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    # ---- orders -------------------------------------------------------------------
    q["scan_orders"] = _with(ORDERS_RAW) + "SELECT * FROM orders_raw"
    q["land_orders"] = q["scan_orders"]
    q["completed_orders"] = _with(ORDERS_RAW) + "SELECT * FROM orders_raw WHERE status = 'completed'"
    q["preview_orders"] = _with(ORDERS_RAW) + (
        "SELECT * FROM orders_raw ORDER BY order_id, region, product, channel, status, unit_price, "
        "quantity, discount_pct, order_date LIMIT 20")
    q["priced_orders"] = _with(PRICED) + "SELECT order_id, region, product, gross_revenue, net_revenue FROM priced"
    q["sales_by_region"] = _with(SALES) + "SELECT * FROM sales"
    q["sales_ranked"] = _with(SALES) + (
        "SELECT *, CAST(row_number() OVER (ORDER BY net_revenue DESC NULLS LAST, region, product) AS BIGINT)"
        " AS net_rank FROM sales")
    q["publish_sales"] = _with(SALES) + (
        "SELECT *, TIMESTAMP '2025-01-01 00:00:00' AS ingested_at FROM sales")
    q["stream_sales"] = q["publish_sales"]
    q["published_count"] = _with(SALES) + "SELECT count(*) AS published_rows FROM sales"
    q["published_contract"] = _with(SALES) + (
        "SELECT t.*, CASE WHEN col_name = 'latest_order' THEN n_latest WHEN col_name = 'avg_order_value' THEN n_mean ELSE n END AS n_values "
        "FROM (VALUES "
        "('region', 'string', 'Sales region the order was placed in'), "
        "('product', 'string', 'Product SKU'), "
        "('order_count', 'bigint', 'Number of completed orders'), "
        "('gross_revenue', 'decimal(12,2)', 'Revenue at list price'), "
        "('net_revenue', 'decimal(12,2)', 'Revenue after promotional discounts'), "
        "('avg_order_value', 'double', 'Mean net revenue per completed order'), "
        "('latest_order', 'timestamp', 'Timestamp of the most recent order'), "
        "('ingested_at', 'timestamp', 'When this snapshot was published')"
        ") AS t(col_name, data_type, comment), "
        "(SELECT count(*) AS n, count(latest_order) AS n_latest, count(avg_order_value) AS n_mean FROM sales)")
    q["rerun_fingerprint"] = _with(SALES) + (
        "SELECT 'n_rows' AS metric, count(*) AS value FROM sales UNION ALL SELECT * FROM (VALUES "
        "('equal_runs', 1), ('equal_changed', 0), ('ingested_values', 1), ('ingested_nulls', 0))")
    wide = _with(PRICED.replace("JOIN part p ON l.l_partkey = p.p_partkey\n)", "JOIN part p ON l.l_partkey = p.p_partkey\n),\n"
                                "scaled AS (SELECT * REPLACE (CASE WHEN region = 'ASIA' THEN quantity * 1000000 ELSE quantity END AS quantity)"
                                " FROM orders_raw)").replace("FROM orders_raw WHERE", "FROM scaled WHERE") + """,
totals AS (
  SELECT region, product, COUNT(order_id) AS order_count, CAST(SUM(gross_revenue) AS DECIMAL(38,6)) AS gross_revenue,
         CAST(SUM(net_revenue) AS DECIMAL(38,6)) AS net_revenue,
         CAST(SUM(net_revenue) AS DOUBLE) / COUNT(net_revenue) AS avg_order_value, MAX(order_date) AS latest_order
  FROM priced GROUP BY region, product
),
told AS (SELECT *, round(gross_revenue, 2) < 10000000000 AND round(net_revenue, 2) < 10000000000 AS fits FROM totals)""")
    q["refused_sales"] = wide + "SELECT region, product, order_count, gross_revenue, net_revenue FROM told WHERE NOT fits"
    q["sales_beside_refused"] = wide + (
        "SELECT region, product, order_count, CAST(gross_revenue AS DECIMAL(12,2)) AS gross_revenue, "
        "CAST(net_revenue AS DECIMAL(12,2)) AS net_revenue, avg_order_value, latest_order FROM told WHERE fits")
    q["pipeline_sales"] = _with(SALES) + """
SELECT 'landed_rows' AS metric, CAST(count(*) AS DECIMAL(20,2)) AS value FROM orders_raw
UNION ALL SELECT 'completed_rows', CAST(count_if(status = 'completed') AS DECIMAL(20,2)) FROM orders_raw
UNION ALL SELECT 'published_groups', CAST(count(*) AS DECIMAL(20,2)) FROM sales
UNION ALL SELECT 'published_orders', CAST(sum(order_count) AS DECIMAL(20,2)) FROM sales
UNION ALL SELECT 'published_gross', CAST(sum(gross_revenue) AS DECIMAL(20,2)) FROM sales
UNION ALL SELECT 'published_net', CAST(sum(net_revenue) AS DECIMAL(20,2)) FROM sales"""
    checks = ["null_order_id", "null_region", "null_product", "null_channel", "null_status",
              "null_unit_price", "null_quantity", "null_discount_pct", "null_order_date"]
    exprs = [f"CAST(count_if({c[5:]} IS NULL) AS BIGINT) AS {c}" for c in checks] + [
        "CAST(count_if(round(unit_price, 2) <> unit_price) AS BIGINT) AS price_decimals",
        "CAST(count_if(unit_price <= 0) AS BIGINT) AS price_not_positive",
        "CAST(count_if(round(discount_pct, 4) <> discount_pct) AS BIGINT) AS discount_decimals",
        "CAST(count_if(discount_pct < 0 OR discount_pct >= 1) AS BIGINT) AS discount_out_of_range",
        "CAST(count_if(quantity < 1) AS BIGINT) AS quantity_below_one",
        "CAST(count_if(NOT status IN ('completed', 'pending', 'cancelled', 'refunded')) AS BIGINT)"
        " AS domain_status",
    ]
    q["conform_orders"] = _with(ORDERS_RAW) + (
        "SELECT check_name, failures FROM (UNPIVOT (SELECT " + ", ".join(exprs) + " FROM orders_raw) "
        "ON COLUMNS(*) INTO NAME check_name VALUE failures) "
        "UNION ALL SELECT 'duplicate_order_id', CAST(count(order_id) - count(DISTINCT order_id) AS BIGINT) "
        "FROM orders_raw")
    # ---- names --------------------------------------------------------------------
    q["normalize_name"] = _with(JOBS) + (
        "SELECT job_id, name, regexp_replace(name, '^\\[[^\\]]*\\]\\s*', '') AS base_name FROM jobs_b")
    q["match_names"] = _with(JOBS) + "SELECT DISTINCT wanted, job_id, name FROM matched"
    q["resolve_jobs"] = _with(JOBS, RESOLVE) + "SELECT * FROM res"
    q["ambiguous_names"] = _with(JOBS) + (
        "SELECT wanted, job_id, name, '     - ' || name || ' (ID: ' || CAST(job_id AS VARCHAR) || ')'"
        " AS candidate_line FROM f2 WHERE c3 > 1")
    # ---- runs ---------------------------------------------------------------------
    q["classify_runs"] = _with(RUNS) + (
        f"SELECT run_id, job_id, life_cycle_state, result_state, is_failed, {OUTCOME} AS outcome "
        "FROM classified")
    q["duration_text"] = _with(RUNS) + (
        "SELECT run_id, d AS duration_ms, d / 1000.0::DOUBLE AS duration_seconds, "
        + _mmss("d // 1000") + " AS duration_text FROM durations")
    q["run_started"] = _with(RUNS) + """
SELECT run_id, start_time, started,
       strftime(started, '%Y-%m-%dT%H:%M:%S')
         || CASE WHEN strftime(started, '%f') <> '000000' THEN '.' || strftime(started, '%f') ELSE '' END
         AS started_iso
FROM (SELECT run_id, start_time, epoch_ms(NULLIF(start_time, 0)) AS started FROM runs)"""
    q["termination_text"] = _with(RUNS) + (
        "SELECT run_id, NULLIF(concat_ws(' - ', NULLIF(term_code, ''), NULLIF(term_message, '')), '')"
        " AS termination_summary FROM runs")
    q["run_status"] = _with(JOBS, RUNS) + f"""
SELECT c.run_id, c.job_id, COALESCE(NULLIF(c.run_name, ''), j.name) AS job_name,
       COALESCE(c.life_cycle_state, 'UNKNOWN') AS life_cycle, c.result_state,
       epoch_ms(NULLIF(c.start_time, 0)) AS started,
       d.d AS duration_ms, {_mmss("d.d // 1000")} AS duration_text,
       NULLIF(c.run_page_url, '') AS run_page_url,
       {OUTCOME.replace('is_failed', 'c.is_failed').replace('life_cycle_state', 'c.life_cycle_state')
        .replace('result_state', 'c.result_state')} AS outcome,
       CASE WHEN c.is_failed THEN NULLIF(c.state_message, '') END AS failure_message
FROM classified c JOIN durations d ON c.run_id = d.run_id
LEFT JOIN jobs_b j ON c.job_id = j.job_id"""
    q["run_eta"] = _with(RUNS, ETA) + "SELECT job_id, runs_used, eta_seconds, eta_text FROM eta_t"
    q["latest_run"] = _with(RUNS) + """
SELECT job_id, run_id, start_time, life_cycle_state, result_state, epoch_ms(NULLIF(start_time, 0)) AS started
FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start_time DESC NULLS LAST, run_id DESC) AS rn
      FROM runs) WHERE rn = 1"""
    q["cancel_candidates"] = _with(RUNS) + f"""
SELECT job_id, run_id, start_time, life_cycle_state, epoch_ms(NULLIF(start_time, 0)) AS started
FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start_time DESC NULLS LAST, run_id DESC) AS rn
      FROM runs WHERE life_cycle_state IN {ACTIVE_STATES}) WHERE rn = 1"""
    q["blocked_requests"] = _with(JOBS, RUNS, ETA) + """
SELECT j.job_id, a.run_id AS active_run_id, epoch_ms(NULLIF(a.start_time, 0)) AS active_started,
       CAST(a.cnt AS BIGINT) AS active_runs
FROM jobs_b j JOIN active a ON j.job_id = a.job_id AND a.rn = 1"""
    q["allowed_requests"] = _with(JOBS, RUNS, ETA) + """
SELECT j.job_id, CAST(COALESCE(e.runs_used, 0) AS BIGINT) AS runs_used, e.eta_seconds, e.eta_text
FROM jobs_b j LEFT JOIN eta_t e ON j.job_id = e.job_id
WHERE NOT EXISTS (SELECT 1 FROM active a WHERE a.job_id = j.job_id)"""
    q["failed_tasks"] = _with(RUNS, TASKS) + "SELECT * FROM selected"
    # ---- request flows --------------------------------------------------------------
    req = (JOBS_B, WANTED_DERIVED, NARROW, RESOLVE, RUNS, ETA)
    q["run_requests"] = _with(*req) + """
SELECT r.wanted, r.status, r.n_candidates, r.job_id, r.job_name,
       CASE WHEN r.status <> 'RESOLVED' THEN r.status WHEN a.run_id IS NOT NULL THEN 'BLOCKED'
            ELSE 'ALLOWED' END AS decision,
       CASE WHEN r.status = 'RESOLVED' THEN a.run_id END AS active_run_id,
       CASE WHEN r.status = 'RESOLVED' THEN epoch_ms(NULLIF(a.start_time, 0)) END AS active_started,
       CASE WHEN r.status = 'RESOLVED' AND a.run_id IS NULL THEN CAST(COALESCE(e.runs_used, 0) AS BIGINT) END
         AS runs_used,
       CASE WHEN r.status = 'RESOLVED' AND a.run_id IS NULL THEN e.eta_seconds END AS eta_seconds,
       CASE WHEN r.status = 'RESOLVED' AND a.run_id IS NULL THEN e.eta_text END AS eta_text
FROM res r
LEFT JOIN active a ON r.job_id = a.job_id AND a.rn = 1
LEFT JOIN eta_t e ON r.job_id = e.job_id"""
    newest = """
newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start_time DESC NULLS LAST,
                                                                     run_id DESC) AS rn
                 FROM classified) WHERE rn = 1
)"""
    by_id = ROUTED + """,
direct AS (
  SELECT q.wanted, CASE WHEN c.run_id IS NULL THEN 'NOT_FOUND' ELSE 'RESOLVED' END AS status,
         CAST(0 AS BIGINT) AS n_candidates, c.job_id, j.name AS job_name, c.run_id AS found
  FROM routed q LEFT JOIN classified c ON q.run_id = c.run_id LEFT JOIN jobs_b j ON c.job_id = j.job_id
)"""
    header = f"""
SELECT r.wanted, r.status, r.n_candidates, r.job_id, r.job_name, n.run_id,
       CASE WHEN n.run_id IS NOT NULL THEN COALESCE(NULLIF(n.run_name, ''), r.wanted) END AS run_label,
       CASE WHEN n.run_id IS NOT NULL THEN COALESCE(n.life_cycle_state, 'UNKNOWN') END AS life_cycle,
       n.result_state, epoch_ms(NULLIF(n.start_time, 0)) AS started,
       NULLIF(COALESCE(NULLIF(n.execution_duration, 0), n.run_duration), 0) AS duration_ms,
       {_mmss("NULLIF(COALESCE(NULLIF(n.execution_duration, 0), n.run_duration), 0) // 1000")} AS duration_text,
       CASE WHEN n.run_id IS NOT NULL THEN NULLIF(n.run_page_url, '') END AS run_page_url,
       CASE WHEN r.status <> 'RESOLVED' THEN NULL WHEN n.run_id IS NULL THEN 'NO_RUNS'
            ELSE {OUTCOME.replace('is_failed', 'n.is_failed').replace('life_cycle_state', 'n.life_cycle_state')
                  .replace('result_state', 'n.result_state')} END AS run_outcome,
       CASE WHEN n.run_id IS NOT NULL AND n.is_failed THEN NULLIF(n.state_message, '') END AS failure_message,
       CASE WHEN n.run_id IS NOT NULL AND n.is_failed
            THEN NULLIF(concat_ws(' - ', NULLIF(n.term_code, ''), NULLIF(n.term_message, '')), '') END
         AS termination_summary
"""
    by_name_status = header + "FROM res r LEFT JOIN newest n ON r.job_id = n.job_id"
    q["status_requests"] = _with(*req, newest) + by_name_status
    q["status_by_run"] = (_with(*req, newest, by_id) + by_name_status + "\nUNION ALL"
                          + header + "FROM direct r LEFT JOIN classified n ON r.found = n.run_id")
    q["status_details"] = _with(*req, newest, by_id, TASKS, OUTPUTS, """
about AS (
  SELECT r.wanted, n.run_id FROM res r JOIN newest n ON r.job_id = n.job_id WHERE n.is_failed
  UNION ALL SELECT r.wanted, c.run_id FROM direct r JOIN classified c ON r.found = c.run_id WHERE c.is_failed
)""") + """
SELECT a.wanted, s.run_id, s.task_key, s.task_run_id, s.reason, s.result_state, s.state_message, s.termination_summary,
       o.error, o.trace_tail, o.notebook_result, o.task_run_id IS NOT NULL AS output_found,
       CASE WHEN o.task_run_id IS NOT NULL AND o.error IS NULL AND o.trace_tail IS NULL
                 AND o.notebook_result IS NULL THEN '(No exception trace recorded for this task.)' END AS note
FROM about a JOIN selected s ON a.run_id = s.run_id
LEFT JOIN outs o ON s.task_run_id = o.task_run_id AND (s.reason = 'no_tasks' OR COALESCE(s.task_run_id <> 0, false))"""
    q["nested_status_details"] = q["status_details"]
    q["nested_failed_tasks"] = q["failed_tasks"]
    q["cancel_requests"] = _with(*req) + """
SELECT r.wanted, r.status, r.n_candidates, r.job_id, r.job_name,
       a.run_id AS cancel_run_id, epoch_ms(NULLIF(a.start_time, 0)) AS cancel_run_started,
       CASE WHEN r.status <> 'RESOLVED' THEN r.status WHEN a.run_id IS NULL THEN 'NO_ACTIVE_RUN'
            ELSE 'CANCEL' END AS action
FROM res r LEFT JOIN active a ON r.job_id = a.job_id AND a.rn = 1"""
    q["cancel_by_run"] = q["cancel_requests"].replace("WITH ", "WITH " + ROUTED.strip() + ", ", 1) + """
UNION ALL
SELECT q.wanted, CASE WHEN c.run_id IS NULL THEN 'NOT_FOUND' ELSE 'RESOLVED' END, CAST(0 AS BIGINT), c.job_id, j.name,
       c.run_id, epoch_ms(NULLIF(c.start_time, 0)), CASE WHEN c.run_id IS NULL THEN 'NOT_FOUND' ELSE 'CANCEL' END
FROM routed q LEFT JOIN classified c ON q.run_id = c.run_id LEFT JOIN jobs_b j ON c.job_id = j.job_id"""
    q["task_errors"] = _with(RUNS, TASKS, OUTPUTS) + """
SELECT s.run_id, s.task_key, s.task_run_id, s.reason, o.error, o.trace_tail, o.notebook_result,
       o.task_run_id IS NOT NULL AS output_found,
       CASE WHEN o.task_run_id IS NOT NULL AND o.error IS NULL AND o.trace_tail IS NULL
                 AND o.notebook_result IS NULL THEN '(No exception trace recorded for this task.)' END AS note
FROM selected s LEFT JOIN outs o
  ON s.task_run_id = o.task_run_id AND (s.reason = 'no_tasks' OR COALESCE(s.task_run_id <> 0, false))"""
    q["text_tail"] = """
SELECT doc_id, right(text, 4000) AS tail_4000, right(text, 2000) AS tail_2000, right(text, 800) AS tail_800,
       CAST(length(right(text, 4000)) AS BIGINT) AS tail_chars
FROM documents"""
    q["flatten_summary"] = _with(SUMMARIES) + """
SELECT target, job_key,
       COALESCE(CASE WHEN is_obj THEN NULLIF(nm, '') END, job_key) AS job_name,
       CASE WHEN is_obj AND NOT (id_text IS NULL OR id_text IN ('', 'false', '[]', '{}')
                                 OR COALESCE(TRY_CAST(id_text AS DOUBLE) = 0, false))
            THEN id_text END AS job_id
FROM ji"""
    q["flatten_typed"] = """
WITH summ AS (
  SELECT event_id, 't' || CAST(event_id AS VARCHAR) AS target, 'job_' || CAST(user_id AS VARCHAR) AS job_key,
         CAST(CASE event_id % 12 WHEN 0 THEN '0' WHEN 1 THEN '"0"' WHEN 2 THEN 'false' WHEN 3 THEN '"false"' WHEN 4 THEN 'null'
              WHEN 5 THEN '[]' WHEN 6 THEN '{}' WHEN 7 THEN '""' WHEN 8 THEN '0.0' WHEN 9 THEN 'true' WHEN 10 THEN '"[]"'
              ELSE CAST(user_id AS VARCHAR) END AS JSON) AS id,
         CAST(CASE event_id % 4 WHEN 0 THEN '""' WHEN 1 THEN '0' WHEN 2 THEN 'null' ELSE '"' || event_type || '"' END AS JSON) AS name
  FROM events
)
SELECT target, job_key,
       CASE WHEN json_type(name) = 'VARCHAR' AND name ->> '$' <> '' THEN name ->> '$' ELSE job_key END AS job_name,
       CASE json_type(id) WHEN 'VARCHAR' THEN NULLIF(id ->> '$', '') WHEN 'BOOLEAN' THEN NULLIF(id ->> '$', 'false')
            WHEN 'NULL' THEN NULL WHEN 'ARRAY' THEN NULLIF(id ->> '$', '[]') WHEN 'OBJECT' THEN NULLIF(id ->> '$', '{}')
            ELSE CASE WHEN CAST(id ->> '$' AS DOUBLE) <> 0 THEN id ->> '$' END END AS job_id
FROM summ"""
    return q
