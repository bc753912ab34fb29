"""Did the expected batches arrive on time.

Times are handled as minutes since the epoch. A row belongs to the minute that ends at or after
it, so windows ``(previous slot, slot]`` are exact although only whole minutes are compared. Data
is reduced to one row per minute before it meets the calendar.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewarden.functions.cron import Cron, parse_cron
from tablewarden.functions.times import instant, micros, seconds_between, shift
from tablewarden.plans.newest import newest, newest_per

DAY_MINUTES = 1440
# Defaults.
CRON, GRACE_MINUTES, MIN_ROWS = "0 2 * * *", 60, 1


def _as_datetime(when: datetime | str) -> datetime:
    return when if isinstance(when, datetime) else datetime.fromisoformat(when)


def _day_matches(cron: Cron, day: Column) -> Column:
    dom = F.dayofmonth(day).isin(*sorted(cron.days))
    dow = (F.dayofweek(day) - 1).isin(*sorted(cron.weekdays))
    return F.month(day).isin(*sorted(cron.months)) & ((dom | dow) if cron.either_day else (dom & dow))


def calendar(spark: SparkSession, cron: Cron, first: date, last: date) -> DataFrame:
    """One row per day of the span: day number, whether it matches, nearest matching days around it.

    The size is the number of days, whatever the data: 366 rows a year plus a margin that makes
    sure both neighbours exist (a 29th of February may be eight years away).
    """
    margin = timedelta(days=8 * 366 if len(cron.months) < 12 else 63)
    day = F.explode(F.sequence(F.lit(first - margin), F.lit(last + margin)))
    days = spark.range(1).select(day.alias("date"))
    days = days.select(F.unix_date("date").alias("day"), _day_matches(cron, F.col("date")).alias("matches"),
                       F.lit(0).alias("calendar"))
    order = Window.partitionBy("calendar").orderBy("day")
    match = F.when(F.col("matches"), F.col("day"))
    return days.select("day", "matches",
                       F.max(match).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("prev_day"),
                       F.min(match).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("next_day"))


def _times(cron: Cron) -> Column:
    return F.array(*[F.lit(t) for t in cron.times])


def minute_instant(minute: Column) -> Column:
    return F.timestamp_micros(minute * 60_000_000).cast("timestamp_ntz")


def minute_slots(spark: SparkSession, cron: Cron, first: datetime, as_of: datetime) -> DataFrame:
    """Slots in [first, as_of): (slot_m, prev_m, next_m)."""
    t0, tn = cron.times[0], cron.times[-1]
    days = calendar(spark, cron, first.date(), as_of.date()).filter("matches")
    per_day = days.select("day", "prev_day", "next_day", F.posexplode(_times(cron)).alias("i", "t"))
    base = F.col("day") * F.lit(DAY_MINUTES).cast("bigint")
    n = len(cron.times)
    before_ = F.when(F.col("i") > 0, base + F.get(_times(cron), F.col("i") - 1)).otherwise(
        F.col("prev_day") * F.lit(DAY_MINUTES).cast("bigint") + tn)
    after_ = F.when(F.col("i") < n - 1, base + F.get(_times(cron), F.col("i") + 1)).otherwise(
        F.col("next_day") * F.lit(DAY_MINUTES).cast("bigint") + t0)
    slots = per_day.select((base + F.col("t")).alias("slot_m"), before_.alias("prev_m"), after_.alias("next_m"))
    at = minute_instant(F.col("slot_m"))
    return slots.filter((at >= instant(first)) & (at < instant(as_of)))


def slots(spark: SparkSession, cron: str, first: datetime | str, as_of: datetime | str) -> DataFrame:
    """Expected arrivals before ``as_of`` with the one before each: (expected_at, prev_expected_at)."""
    found = minute_slots(spark, parse_cron(cron), _as_datetime(first), _as_datetime(as_of))
    return found.select(minute_instant(F.col("slot_m")).alias("expected_at"),
                        minute_instant(F.col("prev_m")).alias("prev_expected_at"))


def _minutes(rows: DataFrame, ts: str, first: datetime, as_of: datetime) -> DataFrame:
    """Row count and last timestamp per minute; the time bounds reach the scan."""
    seen = rows.filter((F.col(ts) > instant(first)) & (F.col(ts) <= instant(as_of)))
    at = micros(F.col(ts))
    minute = ((at + F.pmod(-at, F.lit(60_000_000))) / 60_000_000).cast("bigint")
    return seen.groupBy(minute.alias("m")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col(ts)).alias("last_ts"))


def _first_instant(rows: DataFrame, ts: str, since: datetime | str | None, as_of: datetime) -> datetime:
    if since is not None:
        return _as_datetime(since)
    low = rows.agg(F.min(F.col(ts)).cast("timestamp_ntz").alias("t")).first()["t"]
    return low or as_of - timedelta(days=1)


def _per_slot(spark: SparkSession, minutes: DataFrame, cron: Cron, first: datetime, as_of: datetime) -> DataFrame:
    """Each minute goes to the first slot at or after it."""
    # Broadcast: one row per calendar day, see calendar().
    days = F.broadcast(calendar(spark, cron, first.date(), as_of.date()))
    located = minutes.withColumn("day", F.floor(F.col("m") / DAY_MINUTES).cast("int")).join(days, "day")
    tod = F.pmod("m", F.lit(DAY_MINUTES)).cast("int")
    wide = F.lit(DAY_MINUTES).cast("bigint")
    same_day = F.col("day") * wide + F.get(F.filter(_times(cron), lambda t: t >= tod), F.lit(0))
    slot = F.when(F.col("matches") & (tod <= cron.times[-1]), same_day).otherwise(
        F.col("next_day") * wide + cron.times[0])
    return located.groupBy(slot.alias("slot_m")).agg(F.sum("n").alias("n"), F.max("last_ts").alias("last_ts"))


RESULT = ("table_name", "expected_at", "deadline", "rows_arrived", "delay_seconds", "status", "checked_at")


def check(rows: DataFrame, table: str, ts: str, as_of: datetime | str, cron: str = CRON,
          grace_minutes: int = GRACE_MINUTES, min_rows: int = MIN_ROWS,
          since: datetime | str | None = None, last_only: bool = False) -> DataFrame:
    """Rows in (previous slot, slot] for every slot since the start of the data, or the last slot.

    Enough rows are ``ok``, or ``late`` if the last of them is past the deadline; too few are
    ``missing`` once the deadline has passed and ``ok`` before that.
    """
    spec, end = parse_cron(cron), _as_datetime(as_of)
    spark = rows.sparkSession
    first = _first_instant(rows, ts, since, end)
    found = minute_slots(spark, spec, first, end)
    if last_only:
        found = found.orderBy(F.desc("slot_m")).limit(1)
    arrived = _per_slot(spark, _minutes(rows, ts, first - timedelta(days=1), end), spec, first - timedelta(days=1), end)
    joined = found.join(arrived, "slot_m", "left")
    n = F.coalesce("n", F.lit(0))
    deadline = shift(F.col("expected_at"), grace_minutes * 60)
    out = (joined.withColumn("expected_at", minute_instant(F.col("slot_m")))
           .withColumn("deadline", deadline).withColumn("rows_arrived", n)
           .withColumn("checked_at", instant(end)).withColumn("table_name", F.lit(table)))
    enough, passed = F.col("rows_arrived") >= min_rows, F.col("checked_at") >= F.col("deadline")
    late = F.col("last_ts") > F.col("deadline")
    status = F.when(enough & late, "late").when(enough, "ok").when(passed, "missing").otherwise("ok")
    delay = (F.when(enough & late, seconds_between(F.col("deadline"), F.col("last_ts")))
             .when(~enough & passed, seconds_between(F.col("deadline"), F.col("checked_at"))))
    return out.withColumn("status", status).withColumn("delay_seconds", delay).select(*RESULT)


def check_grace(rows: DataFrame, table: str, ts: str, as_of: datetime | str, cron: str = CRON,
                grace_minutes: int = GRACE_MINUTES, min_rows: int = MIN_ROWS,
                since: datetime | str | None = None) -> DataFrame:
    """Rows in (previous slot, slot + grace] are on time; rows up to the next slot are late.

    ``late`` if only the later rows make the number; the delay runs from the deadline to the last
    row. The rows after a slot are found by an equi-join on the day plus the range condition,
    between slots and minutes, both of which are bounded by the calendar.
    """
    spec, end = parse_cron(cron), _as_datetime(as_of)
    spark = rows.sparkSession
    first = _first_instant(rows, ts, since, end)
    minutes = _minutes(rows, ts, first - timedelta(days=1), end)
    before_slot = _per_slot(spark, minutes, spec, first - timedelta(days=1), end)
    found = (minute_slots(spark, spec, first, end)
             .withColumn("deadline_m", F.col("slot_m") + grace_minutes)
             .withColumn("end_m", F.greatest("deadline_m", "next_m")))
    wide = F.lit(DAY_MINUTES)
    spans = found.select("slot_m", "deadline_m", "end_m", F.explode(F.sequence(
        F.floor((F.col("slot_m") + 1) / wide), F.floor(F.col("end_m") / wide))).alias("day"))
    daily = minutes.withColumn("day", F.floor(F.col("m") / wide))
    after_slot = (spans.join(daily, "day").filter("m > slot_m AND m <= end_m").groupBy("slot_m").agg(
        F.sum(F.when(F.col("m") <= F.col("deadline_m"), F.col("n")).otherwise(0)).alias("in_grace"),
        F.sum("n").alias("after"), F.max("last_ts").alias("last_after")))
    none = F.lit(0)
    out = (found.join(before_slot, "slot_m", "left").join(after_slot, "slot_m", "left")
           .withColumn("on_time", F.coalesce("n", none) + F.coalesce("in_grace", none))
           .withColumn("total", F.coalesce("n", none) + F.coalesce("after", none))
           .withColumn("expected_at", minute_instant(F.col("slot_m")))
           .withColumn("deadline", minute_instant(F.col("deadline_m")))
           .withColumn("checked_at", instant(end)).withColumn("table_name", F.lit(table)))
    ok, late = F.col("on_time") >= min_rows, F.col("total") >= min_rows
    passed = F.col("checked_at") >= F.col("deadline")
    status = F.when(ok, "ok").when(late, "late").when(passed, "missing").otherwise("ok")
    delay = (F.when(ok, None).when(late, seconds_between(F.col("deadline"), F.coalesce("last_after", "last_ts")))
             .when(passed, seconds_between(F.col("deadline"), F.col("checked_at"))))
    arrived = F.when(ok | ~late, F.col("on_time")).otherwise(F.col("total"))
    return (out.withColumn("status", status).withColumn("delay_seconds", delay)
            .withColumn("rows_arrived", arrived).select(*RESULT))


def latest(records: DataFrame, id_col: str = "expected_at") -> DataFrame:
    return newest_per(records, ["table_name"], "checked_at", id_col)


def listing(records: DataFrame, status: str | None = None, limit: int = 50, id_col: str = "expected_at") -> DataFrame:
    return newest(records, "checked_at", limit, None if status is None else F.col("status") == status, id_col)
