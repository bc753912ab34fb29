"""History tables: fixed schemas, monitors' results fitted to them, append by date partition.

`append` takes exactly a table's columns; anything absent or unknown raises. `fit` makes such rows of what a monitor
returns: it knows each monitor's names, adds the time of the run and an id derived from the row's content, so that a run
that is repeated gives the same ids.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.times import instant
from tablewarden.plans.recent import PARTITION

COLUMN = "struct<name:string,type:string,nullable:boolean,ordinal_position:int>"

# History tables, their columns and the column that dates a row.
HISTORY = {
    "freshness_records": ("checked_at", "id bigint, table_name string, timestamp_column string, "
                          "last_updated_at timestamp_ntz, lag_seconds double, status string, checked_at timestamp_ntz"),
    "volume_records": ("recorded_at", "id bigint, table_name string, dag_id string, row_count bigint, "
                       "rolling_avg double, deviation_pct double, is_anomaly boolean, recorded_at timestamp_ntz"),
    "check_results": ("executed_at", "id bigint, check_name string, table_name string, check_type string, "
                      "passed boolean, metric_value decimal(20,6), details string, executed_at timestamp_ntz"),
    "schema_snapshots": ("snapshot_at", f"id bigint, table_name string, columns array<{COLUMN}>, "
                         "snapshot_at timestamp_ntz"),
    "schema_diffs": ("detected_at", "id bigint, table_name string, change_type string, column_name string, "
                     "old_value string, new_value string, detected_at timestamp_ntz"),
    "alert_logs": ("sent_at", "id bigint, alert_type string, channel string, table_name string, "
                   "message string, severity string, success boolean, sent_at timestamp_ntz"),
    "alert_noise_records": ("last_calculated_at", "id bigint, table_name string, alert_type string, "
                            "count_1h bigint, count_24h bigint, count_7d bigint, noise_score double, "
                            "severity_trend string, is_throttled boolean, last_calculated_at timestamp_ntz"),
    "column_profiles": ("profiled_at", "id bigint, table_name string, column_name string, null_count bigint, "
                        "null_pct double, distinct_count bigint, min_value string, max_value string, "
                        "mean_value double, profiled_at timestamp_ntz"),
    "distribution_snapshots": ("snapshotted_at", "id bigint, table_name string, column_name string, "
                               "column_type string, distribution string, snapshotted_at timestamp_ntz"),
    "distribution_drifts": ("detected_at", "id bigint, table_name string, column_name string, "
                            "drift_type string, previous_value string, current_value string, "
                            "change_magnitude double, detected_at timestamp_ntz"),
    "contract_validation_results": ("validated_at", "id bigint, contract_id string, contract_version string, "
                                    "table_name string, passed boolean, total_rules bigint, "
                                    "passed_rules bigint, violations string, validated_at timestamp_ntz"),
    "backfill_events": ("detected_at", "id bigint, table_name string, row_count bigint, "
                        "historical_span_seconds double, historical_row_fraction double, "
                        "volume_record_id bigint, detected_at timestamp_ntz"),
    "late_arriving_records": ("checked_at", "id bigint, table_name string, expected_at timestamp_ntz, "
                              "rows_arrived bigint, delay_seconds double, status string, "
                              "checked_at timestamp_ntz"),
    "maintenance_logs": ("started_at", "id bigint, deleted_counts map<string,bigint>, retention_days int, "
                         "finished_at timestamp_ntz, status string, error string, started_at timestamp_ntz"),
    "check_suppressions": ("created_at", "id bigint, table_name string, suppressed_until timestamp_ntz, "
                           "reason string, created_at timestamp_ntz"),
    "pipeline_runs": ("recorded_at", "id bigint, orchestrator string, dag_id string, run_id string, "
                      "state string, start_time timestamp_ntz, end_time timestamp_ntz, "
                      "duration_seconds double, recorded_at timestamp_ntz"),
}

# What monitors call a column of the table, and what may stay unknown. All else a monitor returns beyond the table's
# columns must be named under DROPPED.
RENAMED = {"check_results": {"rule": "check_name"}, "contract_validation_results": {"version": "contract_version"},
           "distribution_drifts": {"magnitude": "change_magnitude"}, "distribution_snapshots": {"period": "snapshotted_at"},
           "alert_logs": {"text": "message"}}
OPTIONAL = {"volume_records": ("dag_id",), "check_results": ("details",), "backfill_events": ("volume_record_id",),
            "distribution_drifts": ("previous_value", "current_value"), "maintenance_logs": ("error",), "alert_logs": ("channel", "severity"),
            "freshness_records": ("timestamp_column",), "check_suppressions": ("reason",)}
DROPPED = {"volume_records": ("history_points",), "late_arriving_records": ("deadline",), "distribution_drifts": ("drifted",)}


def time_column(table: str) -> str:
    return HISTORY[table][0]


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(HISTORY[table][1])


def fit(df: DataFrame, table: str, as_of: datetime | str | None = None) -> DataFrame:
    """A monitor's rows as rows of the history table.

    The time column is the run's ``as_of`` where the monitor has none. Lists and structs in a text column become JSON;
    a distribution snapshot's statistics become its ``distribution``. The id is a hash of all other columns unless the
    monitor gives one. Only drifted rows are drifts.
    """
    if table == "distribution_drifts" and "drifted" in df.columns:
        df = df.filter("drifted")
    if table == "distribution_snapshots" and "distribution" not in df.columns:
        kept = [c for c in df.columns if c not in {f.name for f in schema(table).fields} | set(RENAMED[table])]
        df = df.withColumn("distribution", F.to_json(F.struct(*kept))).drop(*kept)
    df = df.drop(*DROPPED.get(table, ())).withColumnsRenamed(RENAMED.get(table, {}))
    if as_of is not None and time_column(table) not in df.columns:
        df = df.withColumn(time_column(table), instant(as_of))
    for f in schema(table).fields:
        if f.name in df.columns and isinstance(f.dataType, T.StringType) and isinstance(df.schema[f.name].dataType, (T.ArrayType, T.StructType, T.MapType)):
            df = df.withColumn(f.name, F.to_json(f.name))
        if f.name not in df.columns and f.name in OPTIONAL.get(table, ()):
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    if "id" not in df.columns:
        content = [F.to_json(c) if isinstance(df.schema[c].dataType, (T.MapType, T.ArrayType, T.StructType)) else F.col(c) for c in sorted(df.columns)]
        df = df.withColumn("id", F.xxhash64(*content))
    return conform(df, table)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of the history table, in order and type. Absent or unknown ones raise."""
    want = [f.name for f in schema(table).fields]
    absent, unknown = [c for c in want if c not in df.columns], [c for c in df.columns if c not in want]
    if absent or unknown:
        raise ValueError(f"not rows of {table}: absent {absent}, unknown {unknown}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(table).fields])


def append(df: DataFrame, table: str, root: str) -> None:
    """Append rows of the table (see `fit`), partitioned by date; `plans.recent` reads only the dates asked for.

    Rows are first brought together by date, so one run adds few files per date instead of one
    per task and date; AQE splits a date that is too large for one file's task.
    """
    dated = conform(df, table).withColumn(PARTITION, F.to_date(time_column(table)))
    (dated.hint("rebalance", PARTITION).write.mode("append").partitionBy(PARTITION).parquet(f"{root}/{table}"))


def read(spark: SparkSession, table: str, root: str) -> DataFrame:
    declared = T.StructType([*schema(table).fields, T.StructField(PARTITION, T.DateType())])
    return spark.read.schema(declared).parquet(f"{root}/{table}")
