"""Alert gating and noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.operators import alerts as A
from tablewarden.operators import dedup as R
from tablewarden.operators import noise as N
from tablewarden.queryset.fixtures import EVENTS_AS_OF, fixture, table, with_
from tablewarden.queryset.registry import query

AS_OF = f"TIMESTAMP '{EVENTS_AS_OF}'"
ACTIVE = f"SELECT DISTINCT table_name FROM suppressions WHERE suppressed_until >= {AS_OF}"


@query("suppression_filter", with_("alerts", "suppressions") + f"SELECT * FROM alerts WHERE table_name NOT IN ({ACTIVE})")
def suppression_filter(spark, sf):
    return A.drop_suppressed(fixture(spark, sf, "alerts"), fixture(spark, sf, "suppressions"), EVENTS_AS_OF)


@query("suppression_list", with_("suppressions") + f"SELECT * FROM suppressions WHERE suppressed_until >= {AS_OF}")
def suppression_list(spark, sf):
    return A.list_suppressions(fixture(spark, sf, "suppressions"), EVENTS_AS_OF)


TREND = """SELECT table_name, alert_type, CASE WHEN count(*) FILTER (WHERE k <= 5) = 0 OR count(*) FILTER (WHERE k > 5) = 0 THEN 'stable'
    WHEN avg(w) FILTER (WHERE k <= 5) - avg(w) FILTER (WHERE k > 5) > 0.3 THEN 'worsening'
    WHEN avg(w) FILTER (WHERE k <= 5) - avg(w) FILTER (WHERE k > 5) < -0.3 THEN 'improving' ELSE 'stable' END AS severity_trend
    FROM (SELECT table_name, alert_type, CASE severity WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END AS w,
                 CASE WHEN severity IS NOT NULL THEN row_number() OVER (PARTITION BY table_name, alert_type, severity IS NULL ORDER BY rn) END AS k
          FROM (SELECT *, row_number() OVER (PARTITION BY table_name, alert_type ORDER BY sent_at DESC, id DESC) AS rn FROM alert_log WHERE success)
          WHERE rn <= 10) GROUP BY table_name, alert_type"""
COUNTS = f"""SELECT table_name, alert_type, count(*) FILTER (WHERE sent_at >= {AS_OF} - INTERVAL 1 HOUR) AS count_1h,
    count(*) FILTER (WHERE sent_at >= {AS_OF} - INTERVAL 24 HOUR) AS count_24h, count(*) AS count_7d
    FROM alert_log WHERE success AND sent_at >= {AS_OF} - INTERVAL 7 DAY GROUP BY table_name, alert_type"""
SCORE = "round(least(count_1h * 20.0::DOUBLE + count_24h * 2.0::DOUBLE + count_7d * 0.5::DOUBLE, 100), 2)"
WINDOW = "CAST(CASE WHEN noise_score <= 0 THEN 60 ELSE least(floor(60 * pow(2, noise_score / 25)), 480) END AS BIGINT)"
NOISE = dict(trend=TREND, counted=COUNTS, filled="""SELECT t.table_name, t.alert_type, coalesce(count_1h, 0) AS count_1h, coalesce(count_24h, 0) AS count_24h,
    coalesce(count_7d, 0) AS count_7d, severity_trend FROM trend t LEFT JOIN counted c ON t.table_name = c.table_name AND t.alert_type = c.alert_type""",
    noise=f"SELECT table_name, alert_type, count_1h, count_24h, count_7d, {SCORE} AS noise_score, severity_trend, count_24h >= 10 AS is_throttled, {AS_OF} AS last_calculated_at FROM filled")
WITH_NOISE = with_("alert_log", **NOISE)


def noise(spark, sf):
    return N.records(fixture(spark, sf, "alert_log"), EVENTS_AS_OF)


REPEATED = f"""SELECT l.table_name, l.alert_type FROM (SELECT table_name, alert_type, max(sent_at) AS m FROM alert_log GROUP BY table_name, alert_type) l
    LEFT JOIN noise n ON n.table_name = l.table_name AND n.alert_type = l.alert_type
    WHERE m >= {AS_OF} - to_minutes(coalesce({WINDOW}, 60))"""


@query("dedup_filter", with_("alert_log", "alerts", **NOISE, repeated=REPEATED) + "SELECT a.* FROM alerts a ANTI JOIN repeated r USING (table_name, alert_type)")
def dedup_filter(spark, sf):
    return A.drop_repeated(fixture(spark, sf, "alerts"), fixture(spark, sf, "alert_log"), EVENTS_AS_OF, noise(spark, sf))


REPLAY = """WITH RECURSIVE a AS (SELECT id, table_name, alert_type, sent_at FROM ({log})),
    s AS (SELECT table_name, alert_type, min(sent_at) AS sent_at FROM a GROUP BY table_name, alert_type
          UNION ALL SELECT s.table_name, s.alert_type, min(a.sent_at) FROM s JOIN a ON a.table_name = s.table_name AND a.alert_type = s.alert_type
          AND a.sent_at > s.sent_at + INTERVAL 60 MINUTE GROUP BY s.table_name, s.alert_type, s.sent_at)
    SELECT s.table_name, s.alert_type, s.sent_at, min(a.id) AS id FROM s JOIN a ON a.table_name = s.table_name AND a.alert_type = s.alert_type AND a.sent_at = s.sent_at
    GROUP BY s.table_name, s.alert_type, s.sent_at"""
# Per table only, and per day of alerts squeezed into hours, so that many alerts fall into a window.
DENSE = "SELECT event_id AS id, 'svc_' || CAST(user_id % 3 AS {s}) AS table_name, CASE WHEN event_type = 'error' THEN 'quality' ELSE 'volume' END AS alert_type, ts AS sent_at FROM {{events}}".format(s="STRING")


@query("dedup_replay", REPLAY.format(log=DENSE.format(events="events")))
def dedup_replay(spark, sf):
    return R.replay(spark.sql(DENSE, events=table(spark, sf, "events")))


@query("noise_counts", with_("alert_log") + COUNTS)
def noise_counts(spark, sf):
    return N.counts(fixture(spark, sf, "alert_log"), EVENTS_AS_OF)


@query("noise_score", with_("alert_log", counted=COUNTS) + f"SELECT table_name, alert_type, {SCORE} AS noise_score FROM counted")
def noise_score(spark, sf):
    c = N.counts(fixture(spark, sf, "alert_log"), EVENTS_AS_OF)
    return c.select(*N.PAIR, N.score(F.col("count_1h"), F.col("count_24h"), F.col("count_7d")).alias("noise_score"))


@query("severity_trend", with_("alert_log") + TREND)
def severity_trend(spark, sf):
    return N.severity_trend(fixture(spark, sf, "alert_log"))


@query("adaptive_window", WITH_NOISE + f"SELECT table_name, alert_type, noise_score, {WINDOW} AS window_minutes FROM noise")
def adaptive_window(spark, sf):
    return noise(spark, sf).select(*N.PAIR, "noise_score", N.window_minutes(F.col("noise_score")).alias("window_minutes"))


@query("noise_record", WITH_NOISE + "SELECT * FROM noise")
def noise_record(spark, sf):
    return noise(spark, sf)


@query("noise_list", WITH_NOISE + "SELECT table_name, alert_type, noise_score, is_throttled FROM noise")
def noise_list(spark, sf):
    return N.listing(noise(spark, sf)).select(*N.PAIR, "noise_score", "is_throttled")


@query("noise_summary", WITH_NOISE + """SELECT 'totals' AS part, NULL AS table_name, NULL AS alert_type, NULL::DOUBLE AS noise_score, count(*) AS total_tracked,
    count(*) FILTER (WHERE is_throttled) AS currently_throttled, count(*) FILTER (WHERE severity_trend = 'worsening') AS worsening_trend FROM noise
    UNION ALL SELECT * FROM (SELECT 'top', table_name, alert_type, noise_score, NULL, NULL, NULL FROM noise ORDER BY noise_score DESC, table_name, alert_type LIMIT 5)""")
def noise_summary(spark, sf):
    records = noise(spark, sf)
    top = N.noisiest(records).select(F.lit("top").alias("part"), *N.PAIR, "noise_score")
    return N.summary(records).withColumn("part", F.lit("totals")).unionByName(top, allowMissingColumns=True)


@query("noise_get", WITH_NOISE + "SELECT * FROM noise WHERE table_name = 'svc_3' AND alert_type = 'quality'")
def noise_get(spark, sf):
    return N.get(noise(spark, sf), "svc_3", "quality")


@query("noise_reset", WITH_NOISE + f"""SELECT table_name, alert_type, CASE WHEN h THEN 0 ELSE count_1h END AS count_1h, CASE WHEN h THEN 0 ELSE count_24h END AS count_24h,
    CASE WHEN h THEN 0 ELSE count_7d END AS count_7d, CASE WHEN h THEN 0 ELSE noise_score END AS noise_score, CASE WHEN h THEN 'stable' ELSE severity_trend END AS severity_trend,
    NOT h AND is_throttled AS is_throttled, last_calculated_at FROM (SELECT *, table_name = 'svc_3' AND alert_type = 'quality' AS h FROM noise)""")
def noise_reset(spark, sf):
    return N.reset(noise(spark, sf), "svc_3", "quality", EVENTS_AS_OF)


@query("alert_history", with_("alert_log") + "SELECT id, channel, severity, sent_at, success, message FROM alert_log WHERE table_name = 'svc_3' AND alert_type = 'quality' ORDER BY sent_at DESC, id DESC LIMIT 50")
def alert_history(spark, sf):
    return N.alert_history(fixture(spark, sf, "alert_log"), "svc_3", "quality")


ROUTES = (A.Route("slack-finance", "schema", table_pattern="svc_[0-4]*"), A.Route("slack-freshness", "freshness"),
          A.Route("pager", severity="fail"), A.Route("email", "quality", "warn", "svc_*"))
ROUTED = """SELECT a.*, rule, channel FROM alerts a, (VALUES (1, 'slack-finance'), (2, 'slack-freshness'), (3, 'pager'), (4, 'email')) r(rule, channel)
    WHERE (rule = 1 AND alert_type = 'schema' AND regexp_full_match(table_name, 'svc_[0-4].*')) OR (rule = 2 AND alert_type = 'freshness')
       OR (rule = 3 AND severity = 'fail') OR (rule = 4 AND alert_type = 'quality' AND severity = 'warn')
    UNION ALL SELECT *, 0, 'slack' FROM alerts WHERE NOT (alert_type = 'schema' AND regexp_full_match(table_name, 'svc_[0-4].*'))
       AND alert_type <> 'freshness' AND severity <> 'fail' AND NOT (alert_type = 'quality' AND severity = 'warn')"""


@query("alert_routing", with_("alerts") + ROUTED)
def alert_routing(spark, sf):
    return A.route(fixture(spark, sf, "alerts"), ROUTES)


FORMAT = """CASE severity WHEN 'fail' THEN '🔴' ELSE '🟠' END || ' [' || upper(severity) || '] ' || message AS text,
    coalesce(table_name, 'global') || ':' || coalesce(alert_type, 'unknown') AS dedup_key,
    CASE severity WHEN 'fail' THEN 'critical' WHEN 'warn' THEN 'warning' WHEN 'info' THEN 'info' ELSE 'error' END AS pager_severity,
    CASE WHEN alert_type IN ('quality', 'volume', 'contract') THEN 'critical' WHEN alert_type IN ('freshness', 'schema', 'distribution') THEN 'warning' ELSE 'info' END AS webhook_severity"""


@query("alert_format", with_("alerts") + f"SELECT *, {FORMAT} FROM alerts")
def alert_format(spark, sf):
    return A.format_alerts(fixture(spark, sf, "alerts"))


GATED = dict(repeated=REPEATED, first="SELECT * FROM alerts0 QUALIFY row_number() OVER (PARTITION BY table_name, alert_type ORDER BY raised_at, id) = 1",
             alerts=f"SELECT f.* FROM first f ANTI JOIN repeated r USING (table_name, alert_type) WHERE table_name NOT IN ({ACTIVE})", routed=ROUTED)


@query("alert_gate", with_("alert_log", "suppressions", **NOISE, alerts0=with_("alerts") + "SELECT * FROM alerts", **GATED) + f"SELECT *, {FORMAT} FROM routed")
def alert_gate(spark, sf):
    return A.gate(fixture(spark, sf, "alerts"), fixture(spark, sf, "suppressions"), fixture(spark, sf, "alert_log"),
                  EVENTS_AS_OF, ROUTES, noise=noise(spark, sf))


@query("lineage_impact", with_("alerts", "lineage_edges") + """SELECT t.table_name, coalesce(string_agg(downstream, ',' ORDER BY downstream), '') AS downstream
    FROM (SELECT DISTINCT table_name FROM alerts) t LEFT JOIN lineage_edges e ON e.table_name = t.table_name GROUP BY t.table_name""")
def lineage_impact(spark, sf):
    out = A.lineage_impact(fixture(spark, sf, "alerts"), fixture(spark, sf, "lineage_edges"))
    return out.withColumn("downstream", F.array_join("downstream", ","))
