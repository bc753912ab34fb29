"""Table access and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.queryset.fixtures import TABLES, fixture, kept_checks, table, with_
from tablewarden.queryset.registry import query
from tablewarden.session import fresh_path
from tablewarden.sources import documents as D
from tablewarden.sources import history as H
from tablewarden.sources import tables as S

COUNTS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES)
TIMED = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}


@query("src_table", "SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def src_table(spark, sf):
    nation = S.load(spark, S.TableSpec("nation", "parquet", f"{sf}/nation.parquet"))
    region = S.load(spark, S.TableSpec("region", "parquet", f"{sf}/region.parquet"))
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_name", "n_regionkey", "r_name")


@query("src_row_count", COUNTS_SQL)
def src_row_count(spark, sf):
    return S.row_counts({t: table(spark, sf, t) for t in TABLES})


@query("src_row_count_meta", COUNTS_SQL)
def src_row_count_meta(spark, sf):
    return S.row_counts_from_statistics(spark, {t: f"{sf}/{t}.parquet" for t in TABLES})


@query("src_max_ts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS timestamp_column, max({c}) AS max_ts FROM {t}" for t, c in TIMED.items()))
def src_max_ts(spark, sf):
    return S.max_timestamps({t: (table(spark, sf, t), c) for t, c in TIMED.items()})


DESCRIBE = " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, column_name, column_type, CAST(row_number() OVER () AS INTEGER) AS ordinal_position
        FROM (DESCRIBE SELECT * FROM {t})""" for t in TABLES)


@query("src_schema", f"""
    SELECT table_name, column_name, ordinal_position, true AS nullable,
           CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
                WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>'
                ELSE column_type END AS data_type
    FROM ({DESCRIBE})""")
def src_schema(spark, sf):
    return S.schema_rows(spark, {t: table(spark, sf, t) for t in TABLES})


@query("src_sql", """
    SELECT c_mktsegment, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AND o_orderstatus = 'F' GROUP BY c_mktsegment""")
def src_sql(spark, sf):
    return S.run_sql(spark, """
        SELECT c_mktsegment, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey
        WHERE o_orderdate >= CAST(:since AS TIMESTAMP_NTZ) AND o_orderstatus = :status GROUP BY c_mktsegment""",
        {"orders": table(spark, sf, "orders"), "customer": table(spark, sf, "customer")},
        {"since": "1998-01-01 00:00:00", "status": "F"})


@query("src_file_stats")
def src_file_stats(spark, sf):
    return S.file_stats(table(spark, sf, "lineitem"))


@query("sink_history", with_("check_history") + """
    SELECT CAST(executed_at AS DATE) AS on_date, table_name, count(*) AS n,
           count(*) FILTER (WHERE passed) AS n_passed
    FROM check_history GROUP BY CAST(executed_at AS DATE), table_name""")
def sink_history(spark, sf):
    root = fresh_path(spark, "history")
    H.append(kept_checks(spark, sf), "check_results", root)
    back = H.read(spark, "check_results", root)
    return back.groupBy("on_date", "table_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"))


@query("ingest_check_json", """
    SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'unnamed' ELSE 'chk_' || CAST(user_id AS VARCHAR) END AS check_name,
           CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE event_type END AS table_name,
           value >= 10 AS passed, value AS metric_value
    FROM events""")
def ingest_check_json(spark, sf):
    e = table(spark, sf, "events")
    check = F.struct(F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("chk_"), F.col("user_id"))).alias("name"),
                     F.when(F.col("value") >= 10, F.lit("Pass")).otherwise(F.lit("FAIL")).alias("outcome"),
                     F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("table"),
                     F.col("value").alias("measured_value"))
    bare = F.to_json(F.array(check))
    wrapped = F.to_json(F.struct(F.array(check).alias("checks")))
    docs = e.select("event_id", F.when(F.col("event_id") % 2 == 0, bare).otherwise(wrapped).alias("body"))
    return D.scan_results(docs).drop("details")
