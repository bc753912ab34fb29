"""Warehouse cost reports over a metering table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.times import before

TOP_USERS = 20


def total_cost(metering: DataFrame, cost: str, as_of: datetime | str, days: int = 7) -> DataFrame:
    """Cost of the last days; 0 when nothing was metered."""
    recent = metering.filter(F.col("start_time") >= before(as_of, days * 86_400))
    return recent.agg(F.coalesce(F.sum(cost), F.lit(0)).cast("double").alias("total_cost"))


def top_scanners(metering: DataFrame, as_of: datetime | str, hours: int = 24, top: int = TOP_USERS) -> DataFrame:
    recent = metering.filter(F.col("start_time") >= before(as_of, hours * 3600))
    return (recent.groupBy("userid").agg(F.sum("rows_scanned").alias("total_rows_scanned"),
                                         F.sum("bytes_scanned").alias("total_bytes_scanned"))
            .orderBy(F.desc("total_bytes_scanned"), "userid").limit(top))


def daily_costs(metering: DataFrame, cost: str, threshold: float) -> DataFrame:
    """Cost per day, whether it is above the threshold, and the change to the same day a week before."""
    daily = metering.groupBy(F.to_date("start_time").alias("day")).agg(F.sum(cost).cast("double").alias("cost"))
    week_before = daily.select(F.date_add("day", 7).alias("day"), F.col("cost").alias("cost_week_before"))
    return daily.join(week_before, "day", "left").select(
        F.col("day").cast("timestamp_ntz").alias("day"), "cost", (F.col("cost") > threshold).alias("over_threshold"),
        "cost_week_before", F.try_divide(F.col("cost") - F.col("cost_week_before"), F.col("cost_week_before")).alias("change"))
