"""Derived inputs: SQL over the given tables that Spark and DuckDB both run unchanged.

``{events}`` and friends stand for the given tables. Every derivation covers the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewarden.functions.times import utc_naive
from tablewarden.sources.history import fit

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-08-02 00:00:00"
LINEITEM_AS_OF = "2001-11-05 00:00:00"

FIXTURES = {
    "dirty": """
        SELECT event_id, ts, user_id,
               CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 101 = 0 THEN 'bogus' ELSE event_type END AS event_type,
               CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 211 = 0 THEN -value ELSE value END AS value,
               CASE WHEN event_id % 19 = 0 THEN 'user' || CAST(user_id AS STRING) ELSE 'u' || CAST(user_id AS STRING) || '@mail.example' END AS email
        FROM {events}""",
    "child_orphans": """
        SELECT o_orderkey, o_totalprice,
               CASE WHEN o_orderkey % 75 = 0 THEN NULL WHEN o_orderkey % 50 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS o_custkey
        FROM {orders}""",
    "volume_history": """
        SELECT CAST(row_number() OVER (PARTITION BY table_name ORDER BY recorded_at) AS BIGINT) AS id, table_name, recorded_at,
               CAST(CASE WHEN day(recorded_at) = 20 THEN floor(n * 0.4) WHEN day(recorded_at) = 25 THEN n * 2 ELSE n END AS BIGINT) AS row_count
        FROM (SELECT event_type AS table_name, date_trunc('day', ts) AS recorded_at, count(*) AS n
              FROM {events} GROUP BY event_type, date_trunc('day', ts)) d""",
    "alert_log": """
        SELECT event_id AS id, 'svc_' || CAST(user_id % 10 AS STRING) AS table_name,
               CASE event_type WHEN 'click' THEN 'freshness' WHEN 'view' THEN 'schema' WHEN 'error' THEN 'quality'
                    WHEN 'purchase' THEN 'volume' ELSE 'contract' END AS alert_type,
               CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'fail' WHEN event_id % 3 = 1 THEN 'warn' ELSE 'info' END AS severity,
               CASE WHEN event_id % 2 = 0 THEN 'slack' ELSE 'email' END AS channel,
               'user ' || CAST(user_id AS STRING) AS message,
               event_id % 10 <> 0 AS success, ts AS sent_at
        FROM {events}""",
    "alerts": """
        SELECT event_id AS id, 'svc_' || CAST(user_id % 10 AS STRING) AS table_name,
               CASE event_type WHEN 'click' THEN 'freshness' WHEN 'view' THEN 'schema' WHEN 'error' THEN 'quality'
                    WHEN 'purchase' THEN 'volume' ELSE 'contract' END AS alert_type,
               CASE WHEN event_id % 3 = 0 THEN 'fail' WHEN event_id % 3 = 1 THEN 'warn' ELSE 'info' END AS severity,
               'value of user ' || CAST(user_id AS STRING) AS message, ts AS raised_at
        FROM {events}""",
    "suppressions": """
        SELECT user_id AS id, 'svc_' || CAST(user_id % 10 AS STRING) AS table_name,
               max(ts) + user_id % 7 * INTERVAL '5' MINUTE AS suppressed_until, min(ts) AS created_at, 'reload' AS reason
        FROM {events} GROUP BY user_id""",
    "lineage_edges": """
        SELECT DISTINCT 'svc_' || CAST(user_id % 10 AS STRING) AS table_name, 'report_' || CAST(user_id % 37 AS STRING) AS downstream
        FROM {events}""",
    # Alerts of many tables, and links between those: some run in circles.
    "table_alerts": """
        SELECT event_id AS id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'tbl_' || CAST(user_id % 300 AS STRING) END AS table_name, event_type AS alert_type,
               CASE WHEN event_id % 3 = 0 THEN 'fail' WHEN event_id % 3 = 1 THEN 'warn' ELSE 'info' END AS severity, ts AS raised_at
        FROM {events}""",
    "table_edges": """
        SELECT DISTINCT 'tbl_' || CAST(user_id % 300 AS STRING) AS table_name, 'tbl_' || CAST((user_id % 300 * 7 + event_id % 2) % 300 AS STRING) AS downstream
        FROM {events}""",
    "model_edges": """
        SELECT DISTINCT 'model.shop.m' || CAST((user_id % 120 * 7 + 3 + event_id % 2 * 11) % 120 AS STRING) AS table_name,
               'model.shop.m' || CAST(user_id % 120 AS STRING) AS downstream
        FROM {events}""",
    "check_history": """
        SELECT event_id AS id, event_type AS table_name, 'chk_' || CAST(user_id % 5 AS STRING) AS check_name,
               value >= 10 AS passed, value AS metric_value, ts AS executed_at
        FROM {events}""",
    "contract_history": """
        SELECT event_id AS id, 'contract_' || CAST(user_id % 6 AS STRING) AS contract_id, '1.' || CAST(user_id % 3 AS STRING) AS contract_version,
               event_type AS table_name, value >= 20 AS passed, 5 AS total_rules, CASE WHEN value >= 20 THEN 5 ELSE 4 END AS passed_rules, ts AS validated_at
        FROM {events}""",
    "freshness_history": """
        SELECT event_id AS id, 'svc_' || CAST(user_id % 40 AS STRING) AS table_name, value * 60 AS lag_seconds,
               CASE WHEN value * 60 > 7200 THEN 'fail' WHEN value * 60 > 3600 THEN 'warn' ELSE 'ok' END AS status,
               ts AS checked_at
        FROM {events}""",
    "run_history": """
        SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'airflow' ELSE 'prefect' END AS orchestrator,
               o_orderpriority AS dag_id, CAST(o_orderkey AS STRING) AS run_id,
               CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' ELSE 'failed' END AS state,
               o_orderdate AS start_time, o_totalprice / 100 AS duration_seconds, o_orderdate AS recorded_at
        FROM {orders}""",
    "metering": """
        SELECT l_suppkey AS userid, CAST(l_quantity AS BIGINT) AS rows_scanned,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS bytes_scanned, l_shipdate AS start_time
        FROM {lineitem}""",
    "dist_prev": """
        SELECT event_id, event_type, value FROM {events} WHERE ts < TIMESTAMP '2024-01-16 00:00:00'""",
    "dist_curr": """
        SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'error' ELSE event_type END AS event_type,
               CASE WHEN event_id % 9 = 0 THEN NULL ELSE value * 2 END AS value
        FROM {events} WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'""",
    "daily_values": """
        SELECT date_trunc('day', ts) AS period,
               CASE WHEN day(ts) = 12 AND event_id % 4 = 0 THEN NULL WHEN day(ts) = 20 AND event_id % 3 = 0 THEN 'error' ELSE event_type END AS event_type,
               CASE WHEN day(ts) = 17 THEN value * 5 ELSE value END AS value
        FROM {events}""",
    # Every event, moved into a nightly batch between 00:00 and 03:00; three nights have none (their
    # rows came the night before) and one is late.
    "arrivals": """
        SELECT event_id, ts - (CASE WHEN day(ts) IN (5, 12, 19) THEN hour(ts) - hour(ts) % 2 + 24 WHEN day(ts) = 7 THEN hour(ts) - hour(ts) % 3 - 4
                               ELSE hour(ts) - hour(ts) % 3 END) * INTERVAL '1' HOUR AS ts
        FROM {events}""",
    "column_sightings": """
        SELECT DISTINCT event_type AS table_name, date_trunc('day', ts) AS snapshot_at,
               'c' || CAST(user_id % 12 AS STRING) AS name,
               CASE WHEN day(ts) % 5 = (user_id % 12) % 5 THEN 'double' ELSE 'bigint' END AS type
        FROM {events}""",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = FIXTURES[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return utc_naive(spark.sql(text, **used))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check history as rows of its history table."""
    return fit(fixture(spark, sf_dir, "check_history").selectExpr("*", "'declared' AS check_type"), "check_results")


def duck(name: str) -> str:
    return FIXTURES[name].format(**{t: t for t in TABLES})


def with_(*names: str, **more: str) -> str:
    """``WITH`` clause of the SQL twin: fixtures first, then further named queries."""
    parts = [f"{n} AS ({duck(n)})" for n in names] + [f"{n} AS ({q})" for n, q in more.items()]
    return "WITH " + ",\n".join(parts) + "\n"
