"""Monitors' results kept in history tables, and reports that read them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.operators import arrival as R
from tablewarden.operators import checks as C
from tablewarden.operators import contracts as K
from tablewarden.operators import distribution as D
from tablewarden.operators import freshness as FR
from tablewarden.operators import volume as V
from tablewarden.queryset.fixtures import EVENTS_AS_OF, fixture, kept_checks, table, with_
from tablewarden.queryset.registry import query
from tablewarden.queryset.shape import DETECT, daily
from tablewarden.session import fresh_path
from tablewarden.sources import history as H

AS_OF = f"TIMESTAMP '{EVENTS_AS_OF}'"
CONTRACT = K.Contract("events_kept", "events", "2.0", (K.ColumnRule("event_id", "bigint", nullable=False), K.ColumnRule("value", "numeric", min=0)), min_rows=1_000_000_000)


def run_all(spark, sf, root):
    """One run of every monitor over ``events``, its results appended to their history tables."""
    events, as_of = table(spark, sf, "events"), EVENTS_AS_OF
    tables = {"events": events}
    suite = C.run_suite(tables, [C.declare("events", t) for t in ("row_count > 0", "missing_count(value) = 0", "max(value) < 0")], as_of)
    sql = C.run_sql_checks(spark, [C.SqlCheck("negative", "SELECT count(*) AS n FROM {events} WHERE value < 0", "result == 0", "events")], tables)
    counts = events.groupBy(F.col("event_type").alias("table_name")).agg(F.count(F.lit(1)).alias("row_count"))
    snapshots = D.drift_snapshots(events.withColumn("period", F.date_trunc("day", "ts").cast("timestamp_ntz")), "events", ["event_type"], ["value"], period="period")
    made = [("freshness_records", FR.poll([FR.Watch("events", events, "ts", "1h", "6h")], as_of)), ("check_results", suite), ("check_results", sql),
            ("volume_records", V.check(counts, fixture(spark, sf, "volume_history"), as_of)),
            ("contract_validation_results", K.summarise(K.validate(spark, [CONTRACT], tables))),
            ("late_arriving_records", R.check(events, "events", "ts", as_of, since="2024-01-20 00:00:00")),
            ("distribution_snapshots", snapshots), ("distribution_drifts", D.detect(daily(spark, sf)))]
    for name, rows in made:
        H.append(H.fit(rows, name, as_of), name, root)
    return sorted({name for name, _ in made})


DAY = f"CAST({AS_OF} AS DATE)"


@query("sink_monitors", with_("daily_values", **DETECT) + f"""
    SELECT 'freshness_records' AS history_table, {DAY} AS on_date, 1::BIGINT AS n
    UNION ALL SELECT 'check_results', {DAY}, 4 UNION ALL SELECT 'volume_records', {DAY}, count(DISTINCT event_type) FROM events
    UNION ALL SELECT 'contract_validation_results', {DAY}, 1
    UNION ALL SELECT 'late_arriving_records', {DAY}, 11
    UNION ALL SELECT 'distribution_snapshots', CAST(ts AS DATE), 2 FROM events GROUP BY CAST(ts AS DATE)
    UNION ALL SELECT 'distribution_drifts', CAST(detected_at AS DATE), count(*) FROM det WHERE drift_type IS NOT NULL GROUP BY CAST(detected_at AS DATE)""")
def sink_monitors(spark, sf):
    root = fresh_path(spark, "history")
    back = [H.read(spark, name, root).groupBy("on_date").agg(F.count_distinct("id").alias("n")).select(F.lit(name).alias("history_table"), "on_date", "n")
            for name in run_all(spark, sf, root)]
    return reduce(DataFrame.unionByName, back)


@query("history_trend", with_("check_history") + f"""SELECT table_name, date_trunc('day', executed_at) AS day, count(*) AS total, count(*) FILTER (WHERE passed) AS passed,
    count(*) FILTER (WHERE passed) * 100.0 / count(*) AS pass_rate FROM check_history WHERE executed_at >= {AS_OF} - INTERVAL 12 DAY GROUP BY table_name, date_trunc('day', executed_at)""")
def history_trend(spark, sf):
    """Passed and failed results of each table and day, from the folders of those days only."""
    root = fresh_path(spark, "history")
    H.append(kept_checks(spark, sf), "check_results", root)
    return C.daily_pass_rate(H.read(spark, "check_results", root), EVENTS_AS_OF, days=12)


@query("history_drift", with_("daily_values", **DETECT) + "SELECT table_name, column_name, detected_at, drift_type, round(magnitude, 6) AS magnitude, previous_value, current_value FROM det WHERE drift_type IS NOT NULL")
def history_drift(spark, sf):
    """Drift between snapshots that were written to history and read back."""
    root = fresh_path(spark, "history")
    H.append(H.fit(daily(spark, sf), "distribution_snapshots"), "distribution_snapshots", root)
    found = D.detect(D.from_history(H.read(spark, "distribution_snapshots", root)))
    return found.filter("drifted").drop("drifted").withColumn("magnitude", F.round("magnitude", 6))
