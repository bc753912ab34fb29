"""Streaming forms of the monitors, run to the end of their input and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewarden.operators import freshness as FR
from tablewarden.operators import runs as R
from tablewarden.queryset.alerting import DENSE, REPLAY
from tablewarden.queryset.fixtures import EVENTS_AS_OF, fixture, table
from tablewarden.queryset.registry import ORACLES, query
from tablewarden.queryset.upkeep import AIRFLOW_SQL, airflow_callbacks, artifacts_of, dbt_output, dbt_sql
from tablewarden.session import fresh_path
from tablewarden.streaming import monitors as M


def events(spark, sf):
    return M.open_files(spark, sf, table(spark, sf, "events").schema, pattern="events.parquet")


def run(stream, spark, name):
    path = fresh_path(spark, name)
    M.append_to(stream, path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query("stream_volume", """SELECT event_type AS table_name, date_trunc('day', ts) AS recorded_at, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS row_count
    FROM events GROUP BY event_type, date_trunc('day', ts)""")
def stream_volume(spark, sf):
    path = fresh_path(spark, "stream-volume")
    M.volume_per_batch(events(spark, sf), "event_type", "ts", path).awaitTermination()
    return M.volume_so_far(spark.read.parquet(f"{path}/rows")).drop("last_at")


LAG = f"(epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(max(ts))) / 1e6"


@query("stream_freshness", f"""SELECT event_type AS table_name, max(ts) AS last_updated_at, {LAG} AS lag_seconds,
    CASE WHEN {LAG} > 7200 THEN 'fail' WHEN {LAG} > 3600 THEN 'warn' ELSE 'ok' END AS status FROM events GROUP BY event_type""")
def stream_freshness(spark, sf):
    path = fresh_path(spark, "stream-freshness")
    M.newest_per_batch(events(spark, sf), "event_type", "ts", path).awaitTermination()
    seen = spark.read.parquet(f"{path}/rows")
    return FR.poll_keyed(seen, "table_name", "last_updated_at", EVENTS_AS_OF).select("table_name", "last_updated_at", "lag_seconds", "status")


def in_batches(rows, spark, name, count, files=1):
    """Files in the order of ``batch``, ``files`` a micro-batch. The column itself is not part of the stream."""
    path = fresh_path(spark, name)
    plain = rows.drop("batch")
    for number in range(count):
        rows.where(F.col("batch") == number).drop("batch").coalesce(files).write.mode("append").parquet(path)
        # tasks without rows write no file, and a micro-batch goes by their number
        for _ in range(len(spark.read.schema(plain.schema).parquet(path).inputFiles()), (number + 1) * files):
            plain.where(F.lit(False)).write.mode("append").parquet(path)
    return M.open_files(spark, path, plain.schema, pattern="*.parquet", files_per_batch=files)


ARRIVED = "ts + CASE WHEN event_id % 10 = 0 THEN 10800 ELSE user_id % 50 END * INTERVAL '1' SECOND"


@query("stream_late_rows", f"""WITH a AS (SELECT event_type, ts, (day({ARRIVED}) - 1) // 8 AS batch FROM events),
    m AS (SELECT batch, max(ts) AS newest FROM a GROUP BY batch), p AS (SELECT x.batch, max(m.newest) AS seen FROM m x JOIN m ON m.batch < x.batch GROUP BY x.batch)
    SELECT event_type AS table_name, batch::INTEGER AS batch, count(*) AS row_count, count(*) FILTER (WHERE ts < seen - INTERVAL 30 MINUTE) AS late_rows,
           max(seen) AS newest_before FROM a LEFT JOIN p USING (batch) GROUP BY event_type, batch""")
def stream_late_rows(spark, sf):
    arriving = table(spark, sf, "events").withColumn("batch", F.floor((F.day(F.expr(ARRIVED)) - 1) / 8))
    path = fresh_path(spark, "stream-late")
    M.late_per_batch(in_batches(arriving, spark, "arriving", 4), "ts", path, delay_seconds=1800).awaitTermination()
    counted = spark.read.parquet(f"{path}/rows").groupBy(F.col("event_type").alias("table_name"), "batch").agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("late") == "true").alias("late_rows"))
    before = spark.read.parquet(f"{path}/progress").select((F.col("batch") + 1).alias("batch"), F.col("newest").alias("newest_before"))
    return counted.join(before, "batch", "left")


@query("stream_alert_gate", REPLAY.format(log=DENSE.format(events="events")))
def stream_alert_gate(spark, sf):
    e = events(spark, sf)
    alerts = e.select(F.col("event_id").alias("id"), F.concat(F.lit("svc_"), F.col("user_id") % 3).alias("table_name"),
                      F.when(F.col("event_type") == "error", "quality").otherwise("volume").alias("alert_type"), F.col("ts").alias("sent_at"))
    sent = run(M.gate_alerts(alerts), spark, "stream-gate")
    return sent.select("table_name", "alert_type", F.timestamp_micros("at").cast("timestamp_ntz").alias("sent_at"), "id")


def as_files(rows, spark, name):
    path = fresh_path(spark, name)
    rows.write.parquet(path)
    return M.open_files(spark, path, rows.schema, pattern="*.parquet", files_per_batch=4)


@query("stream_runs_ingest", AIRFLOW_SQL)
def stream_runs_ingest(spark, sf):
    callbacks = as_files(airflow_callbacks(spark, sf).repartition(8), spark, "callbacks")
    return run(R.from_airflow(callbacks), spark, "stream-runs")


@query("stream_dbt_ingest", dbt_sql())
def stream_dbt_ingest(spark, sf):
    """Run documents and manifests as two streams; every manifest comes a batch after its results."""
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    files = max(spark.sparkContext.defaultParallelism, e.rdd.getNumPartitions())
    # rows are dealt out once, before they become documents
    dealt = fresh_path(spark, "events-by-batch")
    e.withColumn("batch", F.floor((F.day("ts") - 1) / 8).cast("int")).repartition(files).write.partitionBy("batch").parquet(dealt)
    days = spark.read.schema(f"{', '.join(f'{n} {t}' for n, t in e.dtypes)}, batch int").parquet(dealt)
    pairs = artifacts_of(days, "batch").withColumn("made_at", F.col("ts"))
    results = in_batches(pairs.select("event_id", "made_at", "run_results", "batch"), spark, "run-results", 5, files)
    manifests = in_batches(pairs.select("event_id", "made_at", "manifest", (F.col("batch") + 1).alias("batch")), spark, "manifests", 5, files)
    path = fresh_path(spark, "stream-dbt")
    M.artifacts_per_batch(results, manifests, "event_id", EVENTS_AS_OF, "made_at", path, wait="20 days").awaitTermination()
    return dbt_output(spark.read.parquet(f"{path}/rows"))


@query("stream_alert_recoveries", ORACLES["alert_recoveries"])
def stream_alert_recoveries(spark, sf):
    history = fixture(spark, sf, "check_history").withColumn("batch", F.floor((F.day("executed_at") - 1) / 11))
    return run(M.recoveries(in_batches(history, spark, "check-history", 3)), spark, "stream-recoveries")
