"""Alert noise: counts, score, severity trend and the dedup window that follows from them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.times import before, instant
from tablewarden.plans.newest import newest
from tablewarden.plans.recent import since

PAIR = ["table_name", "alert_type"]
# Score weights, severity weights, trend margin, window limits in minutes.
PER_HOUR, PER_DAY, PER_WEEK, MAX_SCORE = 20.0, 2.0, 0.5, 100.0
SEVERITY_WEIGHT = {"fail": 2, "warn": 1, "info": 0}
TREND_ROWS, TREND_RECENT, TREND_MARGIN = 10, 5, 0.3
MIN_WINDOW, MAX_WINDOW, DOUBLING_SCORE = 60, 480, 25.0
THROTTLE_THRESHOLD = 10
SPANS = {"count_1h": 3600, "count_24h": 24 * 3600, "count_7d": 7 * 24 * 3600}


def counts(log: DataFrame, as_of: datetime | str) -> DataFrame:
    """Successful alerts per pair in the last hour, day and week, from one filtered pass."""
    recent = since(log, "sent_at", before(as_of, SPANS["count_7d"])).filter("success")
    return recent.groupBy(*PAIR).agg(*[
        F.count_if(F.col("sent_at") >= before(as_of, s)).alias(n) for n, s in SPANS.items()])


def score(hour: Column, day: Column, week: Column) -> Column:
    return F.round(F.least(hour * PER_HOUR + day * PER_DAY + week * PER_WEEK, F.lit(MAX_SCORE)), 2)


def window_minutes(noise: Column, smallest: int = MIN_WINDOW, largest: int = MAX_WINDOW) -> Column:
    grown = F.floor(F.lit(smallest) * F.pow(F.lit(2.0), noise / DOUBLING_SCORE))
    return F.when(noise <= 0, F.lit(smallest)).otherwise(F.least(grown, F.lit(largest))).cast("bigint")


def _mean_weight(severities: Column) -> Column:
    weight = lambda s: F.when(s == "fail", 2.0).when(s == "warn", 1.0).otherwise(0.0)
    return F.aggregate(severities, F.lit(0.0), lambda a, s: a + weight(s)) / F.size(severities)


def trend_of(recent: Column, older: Column) -> Column:
    delta = _mean_weight(recent) - _mean_weight(older)
    return (F.when((F.size(recent) == 0) | (F.size(older) == 0), "stable")
            .when(delta > TREND_MARGIN, "worsening").when(delta < -TREND_MARGIN, "improving").otherwise("stable"))


def severity_trend(log: DataFrame) -> DataFrame:
    """Newest five severities against the ones before them, out of the last ten successful alerts.

    The rank limit is applied per task before the shuffle; missing severities are dropped after it.
    """
    order = Window.partitionBy(*PAIR).orderBy(F.desc("sent_at"), F.desc("id"))
    last = log.filter("success").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= TREND_ROWS)
    listed = last.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("rn", "severity"))).alias("s"))
    known = F.filter(F.transform("s", lambda x: x["severity"]), lambda v: v.isNotNull() & (v != ""))
    seen = listed.withColumn("known", known)
    recent = F.slice("known", 1, TREND_RECENT)
    older = F.slice("known", TREND_RECENT + 1, TREND_ROWS)
    return seen.select(*PAIR, trend_of(recent, older).alias("severity_trend"))


def records(log: DataFrame, as_of: datetime | str, threshold: int = THROTTLE_THRESHOLD) -> DataFrame:
    """The noise record of every pair in the log; throttled is reported, the score sets the window."""
    base = severity_trend(log).join(counts(log, as_of), PAIR, "left")
    filled = base.fillna(0, list(SPANS))
    return filled.select(*PAIR, *SPANS, score(*[F.col(n) for n in SPANS]).alias("noise_score"), "severity_trend",
                         (F.col("count_24h") >= threshold).alias("is_throttled"), instant(as_of).alias("last_calculated_at"))


def listing(noise: DataFrame) -> DataFrame:
    return noise.orderBy(F.desc("noise_score"), *PAIR)


def noisiest(noise: DataFrame, n: int = 5) -> DataFrame:
    return listing(noise).limit(n)


def summary(noise: DataFrame) -> DataFrame:
    return noise.agg(F.count(F.lit(1)).alias("total_tracked"), F.count_if("is_throttled").alias("currently_throttled"),
                     F.count_if(F.col("severity_trend") == "worsening").alias("worsening_trend"))


def get(noise: DataFrame, table: str, alert_type: str) -> DataFrame:
    return noise.filter((F.col("table_name") == table) & (F.col("alert_type") == alert_type))


def reset(noise: DataFrame, table: str, alert_type: str, as_of: datetime | str) -> DataFrame:
    """The records with one pair set back to quiet. The alert log is not touched."""
    hit = (F.col("table_name") == table) & (F.col("alert_type") == alert_type)
    fresh = {**{n: F.lit(0).cast("bigint") for n in SPANS}, "noise_score": F.lit(0.0), "severity_trend": F.lit("stable"),
             "is_throttled": F.lit(False), "last_calculated_at": instant(as_of)}
    return noise.withColumns({n: F.when(hit, v).otherwise(F.col(n)) for n, v in fresh.items()})


def alert_history(log: DataFrame, table: str, alert_type: str, limit: int = 50) -> DataFrame:
    rows = newest(log, "sent_at", limit, (F.col("table_name") == table) & (F.col("alert_type") == alert_type))
    return rows.select("id", "channel", "severity", "sent_at", "success", "message")
