"""Row counts against their own recent history, and backfills that explain a spike."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.times import before, instant, micros
from tablewarden.plans.newest import newest_per
from tablewarden.plans.ranks import Wanted, values_at_ranks
from tablewarden.plans.recent import since
from tablewarden.plans.running import trailing_totals
from tablewarden.session import cut_lineage, small_frame

# Fixed values.
WINDOW_DAYS = 7
MIN_HISTORY = 3
THRESHOLD = 0.3
BACKFILL_PART = 10
BACKFILL_FRACTION = 0.4
BACKFILL_SPAN_SECONDS = 24 * 3600
DAY = 86_400


def deviation(current: Column, average: Column) -> Column:
    """Relative deviation; rows appearing in a table that used to be empty count as 1."""
    return (F.when(average > 0, F.abs(current - average) / average)
            .when(current > 0, F.lit(1.0)).otherwise(F.lit(0.0)))


def _judge(rows: DataFrame, threshold: Column) -> DataFrame:
    n, average = F.coalesce("n", F.lit(0)), F.coalesce("average", F.col("row_count").cast("double"))
    return (rows.withColumn("history_points", n.cast("bigint")).withColumn("rolling_avg", average)
            .withColumn("deviation_pct", deviation(F.col("row_count"), F.col("rolling_avg")))
            .withColumn("is_anomaly", (F.col("history_points") >= MIN_HISTORY)
                        & (F.col("deviation_pct") > threshold))
            .drop("n", "average"))


def check(current: DataFrame, history: DataFrame, as_of: datetime | str,
          window_days: int = WINDOW_DAYS, threshold: float = THRESHOLD,
          thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """``current(table_name, row_count)`` against the mean of the recorded history.

    The time filter reaches the history scan; both join sides are one row per table.
    """
    recent = (since(history, "recorded_at", before(as_of, window_days * DAY))
              .groupBy("table_name").agg(F.avg("row_count").alias("average"),
                                         F.count("row_count").alias("n")))
    limit = F.lit(float(threshold))
    for name, value in (thresholds or {}).items():
        limit = F.when(F.col("table_name") == name, F.lit(float(value))).otherwise(limit)
    return _judge(current.join(recent, ["table_name"], "left"), limit)


def _trailing(history: DataFrame, window_days: int) -> DataFrame:
    count = F.col("row_count").cast("decimal(19,0)")
    return trailing_totals(history, ["table_name"], "recorded_at",
                           {"n": F.lit(1).cast("bigint"), "total": count,
                            "squares": (count * count).cast("decimal(38,0)")}, window_days * DAY)


def backtest(history: DataFrame, window_days: int = WINDOW_DAYS, threshold: float = THRESHOLD) -> DataFrame:
    """The rule replayed at every recorded point of every table."""
    rows = _trailing(history, window_days).withColumn(
        "average", F.when(F.col("n") > 0, F.col("total").cast("double") / F.col("n")))
    return _judge(rows, F.lit(float(threshold))).drop("total", "squares")


def zscore(history: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """(count - mean) / sample standard deviation of the window; NULL for a flat window."""
    t = _trailing(history, window_days)
    n, total = F.col("n"), F.col("total")
    # n * squares - total^2 is an exact integer, so a flat window gives exactly zero
    spread = (n.cast("decimal(10,0)") * F.col("squares") - (total * total).cast("decimal(38,0)")).cast("double")
    std = F.when(n > 1, F.sqrt(spread / (n * (n - 1))))
    mean = F.when(n > 0, total.cast("double") / n)
    return t.select("table_name", "recorded_at", "row_count", mean.alias("rolling_avg"),
                    F.try_divide(F.col("row_count") - mean, F.nullif(std, F.lit(0.0))).alias("z_score"))


@dataclass(frozen=True)
class BackfillWatch:
    table: str
    rows: DataFrame
    timestamp_column: str


def detect_backfill(watch: BackfillWatch, as_of: datetime | str, window_days: int = WINDOW_DAYS,
                    sample_rows: int | None = None) -> DataFrame:
    """Are the newest rows of a table mostly old ones?

    Looked at are the newest ``sample_rows`` rows, or a tenth of all (one at least) if none are asked for.
    Everything asked about the newest ``sample_rows`` non-null timestamps follows from three counts and
    from the timestamp at that rank, so the rows themselves are never sorted or gathered.
    """
    ts = F.col(watch.timestamp_column)
    cutoff = before(as_of, window_days * DAY)
    times = watch.rows.select(micros(ts).alias("at"))
    facts = watch.rows.agg(F.count(ts).alias("n"), F.max(micros(ts)).alias("newest"),
                           F.count_if(ts >= cutoff).alias("recent")).first()
    n = facts["n"]
    size = min(n, max(1, n // BACKFILL_PART) if sample_rows is None else sample_rows)
    # Microseconds of any date until the year 2255 are exact in a double.
    oldest = values_at_ranks(times, [Wanted("oldest", "at", n - size + 1, n)])["oldest"]
    row = (watch.table, size, size - min(facts["recent"], size),
           None if oldest is None else int(oldest), facts["newest"])
    out = small_frame(watch.rows.sparkSession, [row],
                      "table_name string, sample_size bigint, old_rows bigint, o bigint, w bigint")
    fraction = F.try_divide(F.col("old_rows"), F.col("sample_size"))
    span = (F.col("w") - F.col("o")) / F.lit(1e6)
    return out.select(
        "table_name", "sample_size",
        F.timestamp_micros("o").cast("timestamp_ntz").alias("oldest_row_ts"),
        F.timestamp_micros("w").cast("timestamp_ntz").alias("newest_row_ts"),
        span.alias("historical_span_seconds"), F.round(fraction, 4).alias("historical_row_fraction"),
        F.coalesce((fraction >= BACKFILL_FRACTION) & (span >= BACKFILL_SPAN_SECONDS), F.lit(False)).alias("is_backfill"))


def gate_backfills(checked: DataFrame, watches: Sequence[BackfillWatch], as_of: datetime | str,
                   window_days: int = WINDOW_DAYS, sample_rows: int | None = None) -> DataFrame:
    """An anomaly explained by a backfill stops being an anomaly and becomes an ``info`` event.

    As many of the newest rows are looked at as the spike has, one at least, or ``sample_rows`` if given.
    Only the tables that are anomalous now are inspected: their names and spikes (at most one
    per configured table) are the only thing fetched. The checked rows are written once, so the
    tables behind them are not counted again.
    """
    checked = cut_lineage(checked)
    watched = {w.table: w for w in watches}
    spike = F.ceil(F.col("row_count") - F.col("rolling_avg")).cast("bigint")
    flagged = checked.filter(F.col("is_anomaly") & F.col("table_name").isin(*watched)).select(
        "table_name", spike.alias("spike")).collect() if watched else []
    found = None
    for name, rows in flagged:
        size = max(rows, 1) if sample_rows is None else sample_rows
        one = detect_backfill(watched[name], as_of, window_days, size)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = small_frame(checked.sparkSession, [], "table_name string, sample_size bigint, "
                            "oldest_row_ts timestamp_ntz, newest_row_ts timestamp_ntz, "
                            "historical_span_seconds double, historical_row_fraction double, is_backfill boolean")
    backfill = F.col("is_anomaly") & F.coalesce("is_backfill", F.lit(False))
    return (checked.join(found, ["table_name"], "left")
            .withColumn("is_backfill", backfill)
            .withColumn("severity", F.when(F.col("is_backfill"), "info").when(F.col("is_anomaly"), "warn"))
            .withColumn("is_anomaly", F.col("is_anomaly") & ~F.col("is_backfill")))


def backfill_events(gated: DataFrame, as_of: datetime | str) -> DataFrame:
    """History rows for the backfills found."""
    return gated.filter("is_backfill").select(
        "table_name", "row_count", "historical_span_seconds", "historical_row_fraction",
        instant(as_of).alias("detected_at"))


def deviation_rank(records: DataFrame) -> DataFrame:
    """Latest deviation of each table in percent, largest first, anomalies marked."""
    return (newest_per(records, ["table_name"], "recorded_at")
            .select("table_name", "row_count", F.round(F.col("deviation_pct") * 100, 1).alias("deviation_percent"),
                    "is_anomaly")
            .orderBy(F.desc("deviation_percent"), "table_name"))
