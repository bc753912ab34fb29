"""How old is the newest row of each table, and is that acceptable."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.functions.times import (bucket_start, duration_seconds, instant, parse_iso,
                                         seconds_between)
from tablewarden.plans.newest import newest, newest_per
from tablewarden.session import small_frame

# Default thresholds, and the panel limits in seconds.
WARN_AFTER, FAIL_AFTER = "1h", "2h"
PANEL_WARN, PANEL_FAIL = 3600, 7200
RECORD = "table_name string, timestamp_column string, last_updated_at timestamp_ntz, lag_seconds double, status string, checked_at timestamp_ntz"


@dataclass(frozen=True)
class Watch:
    table: str
    rows: DataFrame
    timestamp_column: str
    warn_after: str = WARN_AFTER
    fail_after: str = FAIL_AFTER
    enabled: bool = True


def classify(lag: Column, warn_after: Column, fail_after: Column) -> Column:
    """An unknown lag fails; a lag equal to a threshold does not cross it."""
    return (F.when(lag.isNull() | (lag > fail_after), F.lit("fail"))
            .when(lag > warn_after, F.lit("warn")).otherwise(F.lit("ok")))


def _judged(newest_rows: DataFrame, as_of, warn: Column, fail: Column) -> DataFrame:
    lag = seconds_between(F.col("last_updated_at"), instant(as_of))
    return (newest_rows.withColumn("lag_seconds", lag)
            .withColumn("status", classify(F.col("lag_seconds"), warn, fail))
            .withColumn("checked_at", instant(as_of)))


def poll(watches: Sequence[Watch], as_of: datetime | str) -> DataFrame:
    """One single-column scan per table; thresholds are constants in each branch."""
    parts = []
    for w in watches:
        if not w.enabled:
            continue
        if w.timestamp_column not in w.rows.columns:    # nothing is known of its lag, so it fails, alone
            top = small_frame(w.rows.sparkSession, [(None,)], "last_updated_at timestamp_ntz")
        else:
            top = w.rows.agg(F.max(w.timestamp_column).cast("timestamp_ntz").alias("last_updated_at"))
        row = top.select(F.lit(w.table).alias("table_name"),
                         F.lit(w.timestamp_column).alias("timestamp_column"), "last_updated_at")
        parts.append(_judged(row, as_of, F.lit(duration_seconds(w.warn_after)),
                             F.lit(duration_seconds(w.fail_after))))
    if not parts:
        return small_frame(SparkSession.active(), [], RECORD)
    return reduce(DataFrame.unionByName, parts)


def poll_keyed(rows: DataFrame, key: str, timestamp_column: str, as_of: datetime | str,
               warn_after: str = WARN_AFTER, fail_after: str = FAIL_AFTER) -> DataFrame:
    """The same rule where one physical table holds the rows of many logical ones."""
    top = rows.groupBy(F.col(key).alias("table_name")).agg(
        F.max(timestamp_column).cast("timestamp_ntz").alias("last_updated_at"))
    return _judged(top.withColumn("timestamp_column", F.lit(timestamp_column)), as_of,
                   F.lit(duration_seconds(warn_after)), F.lit(duration_seconds(fail_after)))


def latest(history: DataFrame) -> DataFrame:
    return newest_per(history, ["table_name"], "checked_at")


def listing(history: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    return newest(history, "checked_at", limit, None if status is None else F.col("status") == status)


def status_counts(history: DataFrame) -> DataFrame:
    """Tables by lag band (panels) and by status (tiles), over the latest record of each."""
    lag = F.col("lag_seconds")
    return latest(history).agg(
        F.count_if(lag < PANEL_WARN).alias("fresh"),
        F.count_if((lag >= PANEL_WARN) & (lag < PANEL_FAIL)).alias("warning"),
        F.count_if(lag >= PANEL_FAIL).alias("failing"),
        F.count_if(F.col("status") == "ok").alias("status_ok"),
        F.count_if(F.col("status") == "warn").alias("status_warn"),
        F.count_if(F.col("status") == "fail").alias("status_fail"))


def lag_series(history: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Last known lag per table and time bucket."""
    at = bucket_start(F.col("checked_at"), bucket_seconds).alias("bucket")
    return history.groupBy("table_name", at).agg(
        F.max_by("lag_seconds", F.struct("checked_at", "id")).alias("lag_seconds"))


# Shape of the run-results document, as far as freshness needs it.
RUN_RESULTS = ("struct<metadata:struct<generated_at:string>,"
               "results:array<struct<unique_id:string,status:string,node:struct<schema:string,name:string>>>>")


def from_dbt(documents: DataFrame, as_of: datetime | str, body: str = "body") -> DataFrame:
    """Every model result becomes a freshness record: a model that ran is fresh at that time."""
    doc = F.from_json(F.col(body), RUN_RESULTS)
    rows = (documents.select(doc.alias("d"))
            .select(F.coalesce(parse_iso(F.col("d.metadata.generated_at")), instant(as_of)).alias("last_updated_at"),
                    F.explode("d.results").alias("r"))
            .filter(F.col("r.unique_id").startswith("model.")))
    name = F.concat_ws(".", F.coalesce("r.node.schema", F.lit("public")),
                       F.coalesce("r.node.name", "r.unique_id"))
    return rows.select(name.alias("table_name"), F.lit("__dbt_run__").alias("timestamp_column"),
                       "last_updated_at", F.lit(0.0).alias("lag_seconds"),
                       F.when(F.col("r.status").isin("success", "pass"), "ok").otherwise("fail").alias("status"),
                       instant(as_of).alias("checked_at"))
