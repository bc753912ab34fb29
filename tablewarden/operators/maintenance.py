"""Retention of history tables."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions.times import before, instant
from tablewarden.plans.recent import between
from tablewarden.session import cut_lineage, small_frame
from tablewarden.sources import history

# Days each history table is kept if nothing is configured.
RETENTION_DAYS = {
    "freshness_records": 90, "volume_records": 90, "check_results": 90, "schema_snapshots": 180, "schema_diffs": 90,
    "alert_logs": 30, "alert_noise_records": 30, "column_profiles": 90, "distribution_snapshots": 180,
    "distribution_drifts": 90, "contract_validation_results": 90, "backfill_events": 90, "late_arriving_records": 90,
    "maintenance_logs": 365,
}


def retention(table: str, run_days: int | None = None, overrides: Mapping[str, int] | None = None,
              global_days: int | None = None) -> int:
    """Run argument, then the table's override, then the configured global, then the built-in map."""
    if run_days is not None:
        return run_days
    if overrides and table in overrides:
        return overrides[table]
    return global_days if global_days is not None else RETENTION_DAYS[table]


def preview(tables: Mapping[str, DataFrame], as_of: datetime | str, run_days: int | None = None,
            overrides: Mapping[str, int] | None = None, global_days: int | None = None) -> DataFrame:
    """Rows each table would lose: (table_name, retention_days, cutoff, rows_to_delete).

    Rows without a time are kept. The filter reaches the scan, so only expired dates are read.
    """
    parts = []
    for name, df in tables.items():
        days = retention(name, run_days, overrides, global_days)
        expired = between(df, history.time_column(name), end=before(as_of, days * 86_400), before_end=True)
        parts.append(expired.agg(F.count(F.lit(1)).alias("rows_to_delete")).select(
            F.lit(name).alias("table_name"), F.lit(days).alias("retention_days"),
            before(as_of, days * 86_400).alias("cutoff"), "rows_to_delete"))
    return reduce(DataFrame.unionByName, parts)


def _drop_partition(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def apply(spark: SparkSession, root: str, tables: list[str], as_of: datetime | str, run_days: int | None = None,
          overrides: Mapping[str, int] | None = None, global_days: int | None = None) -> DataFrame:
    """Delete expired rows and append a maintenance row, which is also returned.

    Whole expired dates are dropped as folders; only the date the cutoff falls into is rewritten,
    from a copy in the shared folder. Repeating an interrupted purge is harmless.
    """
    started = as_of if isinstance(as_of, datetime) else datetime.fromisoformat(as_of)
    deleted: dict[str, int] = {}
    for name in tables:
        days = retention(name, run_days, overrides, global_days)
        cutoff = started - timedelta(days=days)
        rows = history.read(spark, name, root)
        late = between(rows, history.time_column(name), end=instant(cutoff), before_end=True)
        # One row per expired calendar date.
        counts = {r[0]: r[1] for r in late.groupBy(history.PARTITION).count().collect()}
        deleted[name] = sum(counts.values())
        boundary = cutoff.date()
        if boundary in counts:
            kept = cut_lineage(rows.filter((F.col(history.PARTITION) == F.lit(boundary))
                                           & (F.col(history.time_column(name)) >= instant(cutoff))))
            if kept.isEmpty():
                _drop_partition(spark, f"{root}/{name}/{history.PARTITION}={boundary}")
            else:
                (kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                 .partitionBy(history.PARTITION).parquet(f"{root}/{name}"))
        for day in counts:
            if day != boundary:
                _drop_partition(spark, f"{root}/{name}/{history.PARTITION}={day}")
    names = sorted(deleted)
    row = small_frame(spark, [(names, [deleted[n] for n in names], run_days if run_days is not None else global_days or 90)],
                      "names array<string>, counts array<bigint>, retention_days int")
    log = row.select(F.map_from_arrays("names", "counts").alias("deleted_counts"), "retention_days",
                     instant(as_of).alias("started_at"), instant(as_of).alias("finished_at"), F.lit("ok").alias("status"))
    history.append(history.fit(log, "maintenance_logs"), "maintenance_logs", root)
    return log


def status(logs: DataFrame, overrides: Mapping[str, int] | None = None, global_days: int | None = None) -> DataFrame:
    """Policy of every table next to the newest purge run and what it deleted there."""
    policy = F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(retention(t, None, overrides, global_days)).alias("retention_days"))
                       for t in RETENTION_DAYS])
    last = logs.agg(F.max_by(F.struct("started_at", "finished_at", "status", "deleted_counts"), "started_at").alias("run"))
    return last.select("run", F.inline(policy)).select(
        "table_name", "retention_days", F.col("run.started_at").alias("started_at"), F.col("run.finished_at").alias("finished_at"),
        F.col("run.status").alias("status"), F.try_element_at("run.deleted_counts", F.col("table_name")).alias("last_deleted"))
