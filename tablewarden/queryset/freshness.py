"""Freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.functions.times import humanize_lag, instant, seconds_between
from tablewarden.operators import freshness as O
from tablewarden.queryset.fixtures import (EVENTS_AS_OF, LINEITEM_AS_OF, fixture, table, with_)
from tablewarden.queryset.registry import query

POLLED = [("events", "ts", "90", "1d"), ("orders", "o_orderdate", "30d", "90d"), ("lineitem", "l_shipdate", "12h", "0.5d")]
SECONDS = {"90": 90, "1d": 86400, "30d": 2592000, "90d": 7776000, "12h": 43200, "0.5d": 43200}


def _poll_sql(t, c, warn, fail):
    return f"""SELECT '{t}' AS table_name, '{c}' AS timestamp_column, m AS last_updated_at,
        (epoch_us(TIMESTAMP '{LINEITEM_AS_OF}') - epoch_us(m)) / 1e6 AS lag_seconds,
        CASE WHEN m IS NULL OR (epoch_us(TIMESTAMP '{LINEITEM_AS_OF}') - epoch_us(m)) / 1e6 > {SECONDS[fail]} THEN 'fail'
             WHEN (epoch_us(TIMESTAMP '{LINEITEM_AS_OF}') - epoch_us(m)) / 1e6 > {SECONDS[warn]} THEN 'warn' ELSE 'ok' END AS status,
        TIMESTAMP '{LINEITEM_AS_OF}' AS checked_at FROM (SELECT max({c}) AS m FROM {t})"""


@query("freshness_poll", " UNION ALL ".join(_poll_sql(*p) for p in POLLED))
def freshness_poll(spark, sf):
    return O.poll([O.Watch(t, table(spark, sf, t), c, w, f) for t, c, w, f in POLLED], LINEITEM_AS_OF)


LATEST = """SELECT * FROM freshness_history QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY checked_at DESC, id DESC) = 1"""


@query("freshness_latest", with_("freshness_history") + LATEST)
def freshness_latest(spark, sf):
    return O.latest(fixture(spark, sf, "freshness_history"))


@query("freshness_list", with_("freshness_history") +
       "SELECT * FROM freshness_history WHERE status = 'warn' ORDER BY checked_at DESC, id DESC LIMIT 50")
def freshness_list(spark, sf):
    return O.listing(fixture(spark, sf, "freshness_history"), "warn")


@query("freshness_status_counts", with_("freshness_history", latest=LATEST) + """
    SELECT count(*) FILTER (WHERE lag_seconds < 3600) AS fresh,
           count(*) FILTER (WHERE lag_seconds >= 3600 AND lag_seconds < 7200) AS warning,
           count(*) FILTER (WHERE lag_seconds >= 7200) AS failing,
           count(*) FILTER (WHERE status = 'ok') AS status_ok, count(*) FILTER (WHERE status = 'warn') AS status_warn,
           count(*) FILTER (WHERE status = 'fail') AS status_fail FROM latest""")
def freshness_status_counts(spark, sf):
    return O.status_counts(fixture(spark, sf, "freshness_history"))


@query("freshness_lag_series", with_("freshness_history") + """
    SELECT table_name, date_trunc('hour', checked_at) AS bucket, arg_max(lag_seconds, (checked_at, id)) AS lag_seconds
    FROM freshness_history GROUP BY table_name, date_trunc('hour', checked_at)""")
def freshness_lag_series(spark, sf):
    return O.lag_series(fixture(spark, sf, "freshness_history"))


@query("freshness_dbt", f"""
    SELECT coalesce(CASE WHEN event_id % 3 <> 0 THEN 'sch' || CAST(user_id % 7 AS VARCHAR) END, 'public') || '.' ||
             coalesce(CASE WHEN event_id % 4 <> 0 THEN event_type END, 'model.shop.m' || CAST(user_id AS VARCHAR)) AS table_name,
           '__dbt_run__' AS timestamp_column,
           CASE WHEN event_id % 11 = 0 THEN TIMESTAMP '{EVENTS_AS_OF}' ELSE date_trunc('second', ts) END AS last_updated_at,
           0.0::DOUBLE AS lag_seconds,
           CASE WHEN event_type IN ('click', 'view') THEN 'ok' ELSE 'fail' END AS status,
           TIMESTAMP '{EVENTS_AS_OF}' AS checked_at
    FROM events""")
def freshness_dbt(spark, sf):
    e = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "click", "success").when(F.col("event_type") == "view", "pass").otherwise("error")
    node = F.struct(F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("sch"), F.col("user_id") % 7)).alias("schema"),
                    F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("name"))
    model = F.struct(F.concat(F.lit("model.shop.m"), "user_id").alias("unique_id"), status.alias("status"), node.alias("node"))
    test = F.struct(F.concat(F.lit("test.shop.t"), "user_id").alias("unique_id"), status.alias("status"), node.alias("node"))
    generated = F.when(F.col("event_id") % 11 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    doc = F.to_json(F.struct(F.struct(generated.alias("generated_at")).alias("metadata"),
                             F.array(model, test).alias("results")))
    return O.from_dbt(e.select(doc.alias("body")), EVENTS_AS_OF)


LAG = f"(epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(ts)) / 1e6"


@query("fresh_lag_humanize", f"""
    SELECT event_id, CASE WHEN s IS NULL THEN '—' WHEN s < 60 THEN CAST(CAST(floor(s + 0.5) AS BIGINT) AS VARCHAR) || 's'
        WHEN s < 3600 THEN CAST(CAST(floor(s / 60 + 0.5) AS BIGINT) AS VARCHAR) || 'm'
        WHEN s < 86400 THEN printf('%.1fh', s / 3600) ELSE printf('%.1fd', s / 86400) END AS lag_text
    FROM (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_type = 'click' THEN {LAG} / 1000 ELSE {LAG} END AS s FROM events)""")
def fresh_lag_humanize(spark, sf):
    lag = seconds_between(F.col("ts"), instant(EVENTS_AS_OF))
    lag = F.when(F.col("event_id") % 97 == 0, None).when(F.col("event_type") == "click", lag / 1000).otherwise(lag)
    return table(spark, sf, "events").select("event_id", humanize_lag(lag).alias("lag_text"))
