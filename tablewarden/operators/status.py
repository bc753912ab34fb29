"""Health of every table across the four pillars."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.times import before, instant
from tablewarden.plans.recent import since

HOURS = 24
WARN_PASS_RATE = 0.8
PILLARS = ("freshness", "volume", "quality", "schema")


def grid(freshness: DataFrame, volume: DataFrame, quality: DataFrame, schema: DataFrame, as_of: datetime | str) -> DataFrame:
    """One row per table seen in the last day: a status per pillar and the last time it was checked.

    Each history is filtered by time and reduced to a row per table; those rows are stacked and
    merged in one more small aggregate. A pillar without records is ``ok``.
    """
    start = before(as_of, HOURS * 3600)
    f = since(freshness, "checked_at", start).groupBy("table_name").agg(
        F.max_by("status", F.struct("checked_at", "id")).alias("freshness"), F.max("checked_at").alias("at"))
    v = since(volume, "recorded_at", start).groupBy("table_name").agg(
        F.when(F.max_by("is_anomaly", F.struct("recorded_at", "id")), "fail").otherwise("ok").alias("volume"),
        F.max("recorded_at").alias("at"))
    rate = F.count_if("passed") / F.count(F.lit(1))
    q = since(quality, "executed_at", start).groupBy("table_name").agg(
        F.when(rate == 1, "ok").when(rate >= WARN_PASS_RATE, "warn").otherwise("fail").alias("quality"),
        F.round(rate * 100, 1).alias("quality_pass_rate"), F.max("executed_at").alias("at"))
    s = since(schema, "detected_at", start).groupBy("table_name").agg(
        F.lit("fail").alias("schema"), F.max("detected_at").alias("at"))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f, v, q, s])
    return stacked.groupBy("table_name").agg(
        *[F.coalesce(F.max(p), F.lit("ok")).alias(p) for p in PILLARS],
        F.max("quality_pass_rate").alias("quality_pass_rate"), F.max("at").alias("last_checked"))


def worst(rows: DataFrame) -> DataFrame:
    seen = F.array(*PILLARS)
    return rows.withColumn("worst", F.when(F.array_contains(seen, "fail"), "fail")
                           .when(F.array_contains(seen, "warn"), "warn").otherwise("ok"))


def summary(grid_rows: DataFrame, freshness: DataFrame, volume: DataFrame, quality: DataFrame, schema: DataFrame,
            suppressions: DataFrame, as_of: datetime | str) -> DataFrame:
    """One row: tables by worst status, running suppressions, last time of each pillar (all history).

    Every part is one row with its own columns; stacking them and taking the maximum merges them.
    """
    tables = worst(grid_rows).agg(F.count_if(F.col("worst") == "ok").alias("healthy"),
                                  F.count_if(F.col("worst") == "warn").alias("warn"),
                                  F.count_if(F.col("worst") == "fail").alias("fail"))
    muted = suppressions.agg(F.count_if(F.col("suppressed_until") >= instant(as_of)).alias("active_suppressions"))
    last = [df.agg(F.max(c).alias(n)) for df, c, n in (
        (freshness, "checked_at", "last_freshness"), (volume, "recorded_at", "last_volume"),
        (quality, "executed_at", "last_quality"), (schema, "detected_at", "last_schema"))]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [tables, muted, *last])
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
