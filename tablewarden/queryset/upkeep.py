"""Runs, dbt, cost, status, maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.operators import dbt as B
from tablewarden.operators import finops as C
from tablewarden.operators import maintenance as M
from tablewarden.operators import runs as R
from tablewarden.operators import status as S
from tablewarden.queryset.fixtures import EVENTS_AS_OF, LINEITEM_AS_OF, ORDERS_AS_OF, fixture, kept_checks, table, with_
from tablewarden.queryset.registry import query
from tablewarden.session import cut_lineage, fresh_path
from tablewarden.sources import documents as D
from tablewarden.sources import history as H

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def airflow_callbacks(spark, sf):
    o = table(spark, sf, "orders")
    end = F.col("o_orderdate") + F.expr("INTERVAL 90 MINUTE")
    doc = F.to_json(F.struct(
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderpriority")).alias("dag_id"),
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.when(F.col("o_orderkey") % 7 != 0, F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")).alias("state"),
        F.date_format("o_orderdate", ISO).alias("start_date"),
        F.when(F.col("o_orderkey") % 3 == 0, "not a time").when(F.col("o_orderkey") % 3 == 1, F.date_format(end, "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).alias("end_date"),
        (F.col("o_totalprice") / 100).alias("duration")))
    return o.select("o_orderkey", doc.alias("body"))


AIRFLOW_SQL = """SELECT o_orderkey, 'airflow' AS orchestrator, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority ELSE 'unknown' END AS dag_id,
    CAST(o_orderkey AS VARCHAR) AS run_id, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' WHEN o_orderstatus = 'F' THEN 'success' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'failed' END AS state,
    o_orderdate AS start_time, CASE WHEN o_orderkey % 3 = 1 THEN o_orderdate + INTERVAL 90 MINUTE - INTERVAL 2 HOUR END AS end_time, o_totalprice / 100 AS duration_seconds FROM orders"""


@query("runs_ingest_airflow", AIRFLOW_SQL)
def runs_ingest_airflow(spark, sf):
    return R.from_airflow(airflow_callbacks(spark, sf))


@query("runs_ingest_prefect", """SELECT o_orderkey, 'prefect' AS orchestrator, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority ELSE 'unknown' END AS dag_id,
    CAST(o_orderkey AS VARCHAR) AS run_id, CASE WHEN o_orderkey % 7 = 0 THEN 'Cancelled' WHEN o_orderkey % 11 = 0 THEN 'unknown' WHEN o_orderstatus = 'F' THEN 'success' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'failed' END AS state,
    o_orderdate AS start_time, o_orderdate + INTERVAL 90 MINUTE AS end_time, o_totalprice / 100 AS duration_seconds FROM orders""")
def runs_ingest_prefect(spark, sf):
    key = F.col("o_orderkey")
    state = (F.when(key % 7 == 0, "Cancelled").when(key % 11 == 0, None).when(F.col("o_orderstatus") == "F", "Completed")
             .when(F.col("o_orderstatus") == "O", "Running").otherwise("Failed"))
    doc = F.to_json(F.struct(
        F.when(key % 10 != 0, F.col("o_orderpriority")).alias("flow_name"), key.cast("string").alias("flow_run_id"), state.alias("state"),
        F.date_format("o_orderdate", ISO).alias("start_time"), F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 90 MINUTE"), "yyyy-MM-dd'T'HH:mm:ss").alias("end_time"),
        (F.col("o_totalprice") / 100).alias("total_run_time")))
    return R.from_prefect(table(spark, sf, "orders").select("o_orderkey", doc.alias("body")))


@query("runs_normalize_api", """SELECT o_orderpriority AS dag_id, 'a' || CAST(o_orderkey AS VARCHAR) AS run_id, 'success' AS state, o_orderdate AS start_time,
      CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 45 MINUTE END AS end_time, CASE WHEN o_orderkey % 5 <> 0 THEN 2700.0::DOUBLE END AS duration_seconds FROM orders
    UNION ALL SELECT o_orderstatus, 'p' || CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE 'COMPLETED' END, o_orderdate, o_orderdate, o_totalprice / 100 FROM orders""")
def runs_normalize_api(spark, sf):
    o = table(spark, sf, "orders")
    start = F.date_format("o_orderdate", ISO)
    end = F.when(F.col("o_orderkey") % 5 != 0, F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 45 MINUTE"), ISO))
    run = F.struct(F.col("o_orderpriority").alias("dag_id"), F.concat(F.lit("a"), "o_orderkey").alias("dag_run_id"), F.lit("success").alias("state"),
                   start.alias("start_date"), end.alias("end_date"))
    airflow = R.from_airflow_dump(o.select(F.to_json(F.struct(F.array(run).alias("dag_runs"))).alias("body")))
    flow = F.struct(F.concat(F.lit("p"), "o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 != 0, "COMPLETED").alias("state_type"),
                    start.alias("start_time"), start.alias("end_time"), (F.col("o_totalprice") / 100).alias("total_run_time"))
    prefect = R.from_prefect_dump(o.select("o_orderstatus", F.to_json(F.array(flow)).alias("body")), F.col("o_orderstatus"))
    return airflow.unionByName(prefect)


@query("runs_query", with_("run_history") + "SELECT * FROM run_history WHERE orchestrator = 'airflow' AND dag_id = '2-HIGH' AND state = 'success' ORDER BY recorded_at DESC, id DESC LIMIT 50")
def runs_query(spark, sf):
    return R.listing(fixture(spark, sf, "run_history"), "airflow", "2-HIGH", "success")


@query("runs_success_rate_7d", with_("run_history") + f"""SELECT count(*) AS runs, count(*) FILTER (WHERE state = 'success') AS successes,
    round(count(*) FILTER (WHERE state = 'success') * 100.0 / nullif(count(*), 0), 6) AS success_rate FROM run_history WHERE recorded_at >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 7 DAY""")
def runs_success_rate_7d(spark, sf):
    return R.success_rate(fixture(spark, sf, "run_history"), ORDERS_AS_OF).withColumn("success_rate", F.round("success_rate", 6))


@query("runs_duration_quantiles", with_("run_history") + """SELECT date_trunc('hour', start_time) AS hour, round(quantile_cont(duration_seconds, 0.5), 6) AS p50,
    round(quantile_cont(duration_seconds, 0.95), 6) AS p95 FROM run_history GROUP BY date_trunc('hour', start_time)""")
def runs_duration_quantiles(spark, sf):
    return R.duration_quantiles(fixture(spark, sf, "run_history")).withColumns({c: F.round(c, 6) for c in ("p50", "p95")})


@query("runs_by_state", with_("run_history") + "SELECT state, count(*) AS runs FROM run_history GROUP BY state")
def runs_by_state(spark, sf):
    return R.by_state(fixture(spark, sf, "run_history"))


@query("runs_failure_heatmap", with_("alert_log") + "SELECT alert_type AS dag_id, CAST(hour(sent_at) AS INTEGER) AS hour, count(*) AS failures FROM alert_log WHERE severity = 'fail' GROUP BY ALL")
def runs_failure_heatmap(spark, sf):
    log = fixture(spark, sf, "alert_log")
    return R.failures_by_hour(log.select(F.col("alert_type").alias("dag_id"), F.col("sent_at").alias("start_time"),
                                         F.when(F.col("severity") == "fail", "failed").otherwise("success").alias("state")))


@query("runs_sla_misses", with_("run_history") + """SELECT dag_id, count(*) AS runs, count(*) FILTER (WHERE duration_seconds > CASE dag_id WHEN '1-URGENT' THEN 1000 ELSE 4000 END) AS sla_misses
    FROM run_history WHERE dag_id IN ('1-URGENT', '5-LOW') GROUP BY dag_id""")
def runs_sla_misses(spark, sf):
    return R.sla_misses(fixture(spark, sf, "run_history"), {"1-URGENT": 1000, "5-LOW": 4000})


def artifacts(spark, sf):
    return artifacts_of(table(spark, sf, "events"))


def artifacts_of(e, *carry):
    """One artifact pair per event: a model, a test on it, and a source known only to ``sources``."""
    model, test, source = (F.concat(F.lit(p), F.col("user_id")) for p in ("model.shop.m", "test.shop.t", "source.shop.s"))
    good = F.when(F.col("event_type") == "click", "success").when(F.col("event_type") == "view", "pass").otherwise("error")
    result = lambda uid: F.struct(uid.alias("unique_id"), good.alias("status"), F.col("value").alias("execution_time"), F.col("event_type").alias("message"))
    results = F.to_json(F.struct(F.struct(F.concat(F.lit("inv"), "event_id").alias("invocation_id"), F.date_format("ts", ISO).alias("generated_at")).alias("metadata"),
                                 F.array(result(model), result(test), result(source)).alias("results")))
    attached = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("model.shop.m"), F.col("user_id")))
    node = lambda kind, on=None: F.struct(F.lit(kind).alias("resource_type"), (F.lit(None).cast("string") if on is None else on).alias("attached_node"))
    manifest = F.to_json(F.struct(F.create_map(model, node("model"), test, node("test", attached)).alias("nodes"),
                                  F.create_map(source, node("snapshot")).alias("sources")))
    return e.select("event_id", "ts", *carry, results.alias("run_results"), manifest.alias("manifest"))


GOOD = "event_type IN ('click', 'view')"


def dbt_sql(where=""):
    return f"""SELECT 'run' AS kind, 'dbt_inv' || CAST(event_id AS VARCHAR) || '_' || p || CAST(user_id AS VARCHAR) AS name, 'dbt_run' AS target,
        {GOOD} AS ok, value AS seconds, date_trunc('second', ts) AS at FROM events, (VALUES ('model.shop.m'), ('source.shop.s')) v(p) {where}
    UNION ALL SELECT 'check', 'test.shop.t' || CAST(user_id AS VARCHAR), CASE WHEN event_id % 3 <> 0 THEN 'm' || CAST(user_id AS VARCHAR) ELSE 'unknown' END, {GOOD}, NULL, date_trunc('second', ts) FROM events {where}"""


def dbt_rows(spark, pairs):
    # Both outputs come from the same parsed documents: write them once, read them twice.
    return dbt_output(cut_lineage(B.joined_results(pairs, "event_id", EVENTS_AS_OF)))


def dbt_output(joined):
    runs = B.run_rows(joined).select(F.lit("run").alias("kind"), F.col("run_id").alias("name"), F.col("dag_id").alias("target"),
                                     (F.col("state") == "success").alias("ok"), F.col("duration_seconds").alias("seconds"), F.col("end_time").alias("at"))
    checks = B.check_rows(joined).select(F.lit("check").alias("kind"), F.col("check_name").alias("name"), F.col("table_name").alias("target"),
                                         F.col("passed").alias("ok"), F.lit(None).cast("double").alias("seconds"), F.col("executed_at").alias("at"))
    return runs.unionByName(checks)


@query("dbt_run_results", dbt_sql())
def dbt_run_results(spark, sf):
    return dbt_rows(spark, artifacts(spark, sf))


@query("dbt_incremental", dbt_sql("WHERE ts > TIMESTAMP '2024-01-20 00:00:00'"))
def dbt_incremental(spark, sf):
    seen = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return dbt_rows(spark, D.newer_than(artifacts(spark, sf).withColumnRenamed("ts", "modified_at"), seen))


@query("finops_total_cost", with_("metering") + f"SELECT CAST(coalesce(sum(bytes_scanned), 0) AS DOUBLE) AS total_cost FROM metering WHERE start_time >= TIMESTAMP '{LINEITEM_AS_OF}' - INTERVAL 90 DAY")
def finops_total_cost(spark, sf):
    return C.total_cost(fixture(spark, sf, "metering"), "bytes_scanned", LINEITEM_AS_OF, 90)


@query("finops_top_scanners", with_("metering") + f"""SELECT userid, CAST(sum(rows_scanned) AS BIGINT) AS total_rows_scanned, CAST(sum(bytes_scanned) AS BIGINT) AS total_bytes_scanned
    FROM metering WHERE start_time >= TIMESTAMP '{LINEITEM_AS_OF}' - INTERVAL 2400 HOUR GROUP BY userid ORDER BY 3 DESC, userid LIMIT 20""")
def finops_top_scanners(spark, sf):
    return C.top_scanners(fixture(spark, sf, "metering"), LINEITEM_AS_OF, 2400)


@query("finops_daily_threshold", with_("metering", d="SELECT date_trunc('day', start_time) AS day, CAST(sum(bytes_scanned) AS DOUBLE) AS cost FROM metering GROUP BY date_trunc('day', start_time)") + """
    SELECT CAST(d.day AS TIMESTAMP) AS day, d.cost, d.cost > 120000000 AS over_threshold, w.cost AS cost_week_before, round((d.cost - w.cost) / w.cost, 6) AS change
    FROM d LEFT JOIN d w ON w.day = d.day - INTERVAL 7 DAY""")
def finops_daily_threshold(spark, sf):
    return C.daily_costs(fixture(spark, sf, "metering"), "bytes_scanned", 120000000).withColumn("change", F.round("change", 6))


# ---- status ----

STATUS = dict(
    fr="SELECT id, table_name, status, checked_at FROM freshness_history",
    vo="SELECT id, 'svc_' || CAST(id % 30 AS VARCHAR) AS table_name, value > 100 AS is_anomaly, ts AS recorded_at FROM (SELECT event_id AS id, value, ts FROM events)",
    qu="SELECT event_id AS id, 'svc_' || CAST(user_id % 45 AS VARCHAR) AS table_name, value >= 6 AS passed, ts AS executed_at FROM events",
    sc="SELECT event_id AS id, 'svc_' || CAST(CASE WHEN value > 120 THEN user_id % 50 ELSE 60 + user_id % 3 END AS VARCHAR) AS table_name, ts AS detected_at FROM events")
DAY = f"TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 24 HOUR"
GRID = f"""SELECT table_name, coalesce(max(freshness), 'ok') AS freshness, coalesce(max(volume), 'ok') AS volume, coalesce(max(quality), 'ok') AS quality,
      coalesce(max(sch), 'ok') AS schema, max(rate) AS quality_pass_rate, max(seen_at) AS last_checked FROM (
    SELECT table_name, arg_max(status, (checked_at, id)) AS freshness, NULL AS volume, NULL AS quality, NULL AS sch, NULL::DOUBLE AS rate, max(checked_at) AS seen_at FROM fr WHERE checked_at >= {DAY} GROUP BY table_name
    UNION ALL SELECT table_name, NULL, CASE WHEN arg_max(is_anomaly, (recorded_at, id)) THEN 'fail' ELSE 'ok' END, NULL, NULL, NULL, max(recorded_at) FROM vo WHERE recorded_at >= {DAY} GROUP BY table_name
    UNION ALL SELECT table_name, NULL, NULL, CASE WHEN avg(passed::INT) = 1 THEN 'ok' WHEN avg(passed::INT) >= 0.8 THEN 'warn' ELSE 'fail' END, NULL, round(avg(passed::INT) * 100, 1), max(executed_at) FROM qu WHERE executed_at >= {DAY} GROUP BY table_name
    UNION ALL SELECT table_name, NULL, NULL, NULL, 'fail', NULL, max(detected_at) FROM sc WHERE detected_at >= {DAY} GROUP BY table_name) GROUP BY table_name"""


def pillars(spark, sf):
    e = table(spark, sf, "events")
    name = lambda c, n: F.concat(F.lit("svc_"), F.col(c) % n).alias("table_name")
    return (fixture(spark, sf, "freshness_history"),
            e.select(F.col("event_id").alias("id"), name("event_id", 30), (F.col("value") > 100).alias("is_anomaly"), F.col("ts").alias("recorded_at")),
            e.select(F.col("event_id").alias("id"), name("user_id", 45), (F.col("value") >= 6).alias("passed"), F.col("ts").alias("executed_at")),
            e.select(F.col("event_id").alias("id"), F.concat(F.lit("svc_"), F.when(F.col("value") > 120, F.col("user_id") % 50).otherwise(60 + F.col("user_id") % 3)).alias("table_name"),
                     F.col("ts").alias("detected_at")))


@query("status_grid", with_("freshness_history", **STATUS) + GRID)
def status_grid(spark, sf):
    return S.grid(*pillars(spark, sf), EVENTS_AS_OF)


@query("status_summary", with_("freshness_history", "suppressions", **STATUS, g=GRID, w="SELECT CASE WHEN 'fail' IN (freshness, volume, quality, schema) THEN 'fail' WHEN 'warn' IN (freshness, volume, quality, schema) THEN 'warn' ELSE 'ok' END AS worst FROM g") + f"""
    SELECT (SELECT count(*) FROM w WHERE worst = 'ok') AS healthy, (SELECT count(*) FROM w WHERE worst = 'warn') AS warn, (SELECT count(*) FROM w WHERE worst = 'fail') AS fail,
      (SELECT count(*) FROM suppressions WHERE suppressed_until >= TIMESTAMP '{EVENTS_AS_OF}') AS active_suppressions, (SELECT max(checked_at) FROM fr) AS last_freshness,
      (SELECT max(recorded_at) FROM vo) AS last_volume, (SELECT max(executed_at) FROM qu) AS last_quality, (SELECT max(detected_at) FROM sc) AS last_schema""")
def status_summary(spark, sf):
    p = pillars(spark, sf)
    return S.summary(S.grid(*p, EVENTS_AS_OF), *p, fixture(spark, sf, "suppressions"), EVENTS_AS_OF)


# ---- maintenance ----

PURGE_AS_OF = "2024-03-15 12:00:00"
PURGED = {"check_results": ("check_history", "executed_at"), "alert_logs": ("alert_log", "sent_at"), "freshness_records": ("freshness_history", "checked_at"),
          "contract_validation_results": ("contract_history", "validated_at")}
DAYS = {"check_results": 60, "alert_logs": 50, "freshness_records": 55, "contract_validation_results": 55}


@query("purge_preview", with_(*[f for f, _ in PURGED.values()]) + " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, {DAYS[t]} AS retention_days, TIMESTAMP '{PURGE_AS_OF}' - INTERVAL {DAYS[t]} DAY AS cutoff, count(*) AS rows_to_delete
        FROM {f} WHERE {c} < TIMESTAMP '{PURGE_AS_OF}' - INTERVAL {DAYS[t]} DAY""" for t, (f, c) in PURGED.items()))
def purge_preview(spark, sf):
    return M.preview({t: fixture(spark, sf, f) for t, (f, _) in PURGED.items()}, PURGE_AS_OF,
                     overrides={"check_results": 60, "alert_logs": 50}, global_days=55)


@query("purge_apply", with_("check_history", "alert_log") + " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, count(*) FILTER (WHERE {c} >= {cut}) AS rows_kept, count(*) FILTER (WHERE {c} < {cut}) AS rows_deleted,
        min({c}) FILTER (WHERE {c} >= {cut}) AS oldest_kept FROM {f}"""
    for t, f, c, cut in (("check_results", "check_history", "executed_at", f"TIMESTAMP '{PURGE_AS_OF}' - INTERVAL 60 DAY"),
                         ("alert_logs", "alert_log", "sent_at", f"TIMESTAMP '{PURGE_AS_OF}' - INTERVAL 50 DAY"))))
def purge_apply(spark, sf):
    root = fresh_path(spark, "history")
    names = ("check_results", "alert_logs")
    for t in names:
        H.append(kept_checks(spark, sf) if t == "check_results" else H.fit(fixture(spark, sf, PURGED[t][0]), t), t, root)
    M.apply(spark, root, list(names), PURGE_AS_OF, overrides=DAYS)
    gone = H.read(spark, "maintenance_logs", root).select(F.explode("deleted_counts").alias("table_name", "rows_deleted"))
    kept = None
    for t in names:
        one = H.read(spark, t, root).agg(F.count(F.lit(1)).alias("rows_kept"), F.min(PURGED[t][1]).alias("oldest_kept")).withColumn("table_name", F.lit(t))
        kept = one if kept is None else kept.unionByName(one)
    return kept.join(gone, "table_name").select("table_name", "rows_kept", "rows_deleted", "oldest_kept")


@query("purge_status", "WITH d AS (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY date_trunc('day', ts) ORDER BY day DESC LIMIT 1) "
       + " UNION ALL ".join(f"SELECT '{t}' AS table_name, {60 if t == 'alert_logs' else n} AS retention_days, day AS started_at, day + INTERVAL 5 MINUTE AS finished_at, 'ok' AS status, "
                            f"{'n' if t == 'alert_logs' else 'NULL::BIGINT'} AS last_deleted FROM d" for t, n in M.RETENTION_DAYS.items()))
def purge_status(spark, sf):
    daily = table(spark, sf, "events").groupBy(F.to_date("ts").cast("timestamp_ntz").alias("started_at")).agg(F.count(F.lit(1)).alias("n"))
    logs = daily.select("started_at", (F.col("started_at") + F.expr("INTERVAL 5 MINUTE")).alias("finished_at"), F.lit("ok").alias("status"),
                        F.create_map(F.lit("alert_logs"), "n").alias("deleted_counts"))
    return M.status(logs, overrides={"alert_logs": 60})
