"""Volume and backfill."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.operators import volume as O
from tablewarden.queryset.fixtures import EVENTS_AS_OF, ORDERS_AS_OF, fixture, table, with_
from tablewarden.queryset.registry import query
from tablewarden.sources.tables import row_counts

# Current counts: the last recorded day of each type, taken from the raw rows.
CURRENT = "SELECT event_type AS table_name, count(*) * (CASE event_type WHEN 'click' THEN 2 ELSE 1 END) AS row_count FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' GROUP BY event_type"
JUDGE = """CASE WHEN rolling_avg > 0 THEN abs(row_count - rolling_avg) / rolling_avg WHEN row_count > 0 THEN 1.0 ELSE 0.0 END"""


@query("volume_check", with_("volume_history", current=CURRENT, h=f"""
        SELECT table_name, avg(row_count) AS a, count(*) AS n FROM volume_history
        WHERE recorded_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY GROUP BY table_name""",
       j="SELECT c.table_name, c.row_count, coalesce(n, 0) AS history_points, coalesce(a, c.row_count) AS rolling_avg FROM current c LEFT JOIN h USING (table_name)",
       d=f"SELECT *, {JUDGE} AS dev FROM j") + """
    SELECT table_name, row_count, history_points, round(rolling_avg, 6) AS rolling_avg, round(dev, 6) AS deviation_pct,
           history_points >= 3 AND dev > CASE WHEN table_name = 'view' THEN 0.05 ELSE 0.3 END AS is_anomaly FROM d""")
def volume_check(spark, sf):
    last_day = table(spark, sf, "events").filter("ts >= TIMESTAMP_NTZ '2024-01-30 00:00:00'")
    current = last_day.groupBy(F.col("event_type").alias("table_name")).agg(F.count(F.lit(1)).alias("n")).select(
        "table_name", (F.col("n") * F.when(F.col("table_name") == "click", 2).otherwise(1)).alias("row_count"))
    out = O.check(current, fixture(spark, sf, "volume_history"), EVENTS_AS_OF, thresholds={"view": 0.05})
    return out.withColumns({c: F.round(c, 6) for c in ("rolling_avg", "deviation_pct")})


WINDOW = """OVER (PARTITION BY table_name ORDER BY epoch_us(recorded_at) RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING)"""


@query("volume_backtest", with_("volume_history",
       w=f"SELECT *, count(*) {WINDOW} AS history_points, coalesce(avg(row_count) {WINDOW}, row_count) AS rolling_avg FROM volume_history",
       d=f"SELECT *, {JUDGE} AS dev FROM w") + """
    SELECT id, table_name, recorded_at, row_count, history_points, round(rolling_avg, 6) AS rolling_avg,
           round(dev, 6) AS deviation_pct, history_points >= 3 AND dev > 0.3 AS is_anomaly FROM d""")
def volume_backtest(spark, sf):
    out = O.backtest(fixture(spark, sf, "volume_history"))
    return out.withColumns({c: F.round(c, 6) for c in ("rolling_avg", "deviation_pct")})


@query("volume_zscore", with_("volume_history") + f"""
    SELECT table_name, recorded_at, row_count, round(avg(row_count) {WINDOW}, 6) AS rolling_avg,
           round((row_count - avg(row_count) {WINDOW}) / nullif(stddev_samp(row_count) {WINDOW}, 0), 6) AS z_score
    FROM volume_history""")
def volume_zscore(spark, sf):
    out = O.zscore(fixture(spark, sf, "volume_history"))
    return out.withColumns({c: F.round(c, 6) for c in ("rolling_avg", "z_score")})


def _backfill(t, c, as_of, size):
    return f"""SELECT '{t}' AS table_name, count(*) AS sample_size, min(x) AS oldest_row_ts, max(x) AS newest_row_ts,
        (epoch_us(max(x)) - epoch_us(min(x))) / 1e6 AS historical_span_seconds,
        round(count(*) FILTER (WHERE x < TIMESTAMP '{as_of}' - INTERVAL 7 DAY) / count(*), 4) AS historical_row_fraction,
        count(*) FILTER (WHERE x < TIMESTAMP '{as_of}' - INTERVAL 7 DAY) / count(*) >= 0.4
          AND (epoch_us(max(x)) - epoch_us(min(x))) / 1e6 >= 86400 AS is_backfill
        FROM (SELECT {c} AS x FROM {t} WHERE {c} IS NOT NULL ORDER BY {c} DESC LIMIT ({size}))"""


@query("backfill_detect", _backfill("lineitem", "l_shipdate", ORDERS_AS_OF, "SELECT greatest(1, count(l_shipdate) // 10) FROM lineitem"))
def backfill_detect(spark, sf):
    return O.detect_backfill(O.BackfillWatch("lineitem", table(spark, sf, "lineitem"), "l_shipdate"), ORDERS_AS_OF)


GATED = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}
DAILY = " UNION ALL ".join(f"SELECT '{t}' AS table_name, date_trunc('day', {c}) AS recorded_at, count(*) AS row_count FROM {t} GROUP BY date_trunc('day', {c})" for t, c in GATED.items())


@query("volume_backfill_gate", "WITH h0 AS (" + DAILY + f"""),
    h AS (SELECT table_name, avg(row_count) AS a, count(*) AS n FROM h0 WHERE recorded_at >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 7 DAY GROUP BY table_name),
    c AS (""" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in GATED) + f"""),
    j AS (SELECT c.table_name, c.row_count, coalesce(n, 0) AS history_points, coalesce(a, c.row_count) AS rolling_avg FROM c LEFT JOIN h USING (table_name)),
    d AS (SELECT *, {JUDGE} AS dev FROM j),
    k AS (SELECT *, history_points >= 3 AND dev > CASE WHEN table_name = 'orders' THEN 1e12 ELSE 0.3 END AS anom FROM d),
    b AS (""" + " UNION ALL ".join(_backfill(t, c, ORDERS_AS_OF, f"SELECT greatest(1, ceil(row_count - rolling_avg))::BIGINT FROM d WHERE table_name = '{t}'") for t, c in GATED.items()) + """)
    SELECT k.table_name, k.row_count, history_points, round(rolling_avg, 6) AS rolling_avg, round(dev, 6) AS deviation_pct,
           anom AND NOT is_backfill AS is_anomaly, anom AND is_backfill AS is_backfill,
           CASE WHEN anom AND is_backfill THEN 'info' WHEN anom THEN 'warn' END AS severity,
           CASE WHEN anom THEN historical_row_fraction END AS historical_row_fraction,
           CASE WHEN anom THEN historical_span_seconds END AS historical_span_seconds
    FROM k LEFT JOIN b USING (table_name)""")
def volume_backfill_gate(spark, sf):
    tables = {t: table(spark, sf, t) for t in GATED}
    daily = None
    for t, c in GATED.items():
        part = tables[t].groupBy(F.to_date(c).alias("d")).agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(t).alias("table_name"), F.col("d").cast("timestamp_ntz").alias("recorded_at"), "row_count")
        daily = part if daily is None else daily.unionByName(part)
    checked = O.check(row_counts(tables), daily, ORDERS_AS_OF, thresholds={"orders": 1e12})
    gated = O.gate_backfills(checked, [O.BackfillWatch(t, tables[t], c) for t, c in GATED.items()], ORDERS_AS_OF)
    return gated.drop("sample_size", "oldest_row_ts", "newest_row_ts").withColumns(
        {c: F.round(c, 6) for c in ("rolling_avg", "deviation_pct")})


@query("volume_deviation_rank", with_("volume_history",
       w=f"SELECT *, count(*) {WINDOW} AS history_points, coalesce(avg(row_count) {WINDOW}, row_count) AS rolling_avg FROM volume_history",
       d=f"SELECT *, {JUDGE} AS dev FROM w") + """
    SELECT table_name, row_count, round(dev * 100, 1) AS deviation_percent, history_points >= 3 AND dev > 0.3 AS is_anomaly
    FROM d QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY recorded_at DESC, id DESC) = 1""")
def volume_deviation_rank(spark, sf):
    return O.deviation_rank(O.backtest(fixture(spark, sf, "volume_history")))
