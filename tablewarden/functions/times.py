"""Durations, instants and lag formatting.

Every instant is UTC wall-clock time. Literals are built as ``timestamp_ntz``: against an
NTZ column the comparison needs no cast, so it reaches the Parquet scan as a pushed filter;
against a zoned column only the literal is cast.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECONDS_PER_UNIT = {"s": 1, "m": 60, "h": 3600, "d": 86400}
DURATION_PATTERN = r"^\s*([0-9]*\.?[0-9]+)\s*([smhdSMHD]?)\s*$"


def duration_seconds(text: str | float | int) -> float:
    """``30m``, ``2h``, ``0.5h``, ``1d``, ``60s`` or plain seconds."""
    found = re.match(DURATION_PATTERN, str(text))
    if not found:
        raise ValueError(f"not a duration: {text!r}")
    return float(found.group(1)) * SECONDS_PER_UNIT[(found.group(2) or "s").lower()]


def duration_seconds_col(text: Column) -> Column:
    """Same grammar for a column of duration strings; NULL where the text is no duration."""
    number = F.regexp_extract(text, DURATION_PATTERN, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, DURATION_PATTERN, 2))
    factor = F.lit(1.0)
    for name, seconds in SECONDS_PER_UNIT.items():
        factor = F.when(unit == name, F.lit(float(seconds))).otherwise(factor)
    return number * factor


def instant(when: datetime | str | Column) -> Column:
    if isinstance(when, Column):
        return when
    text = when.isoformat(sep=" ") if isinstance(when, datetime) else when
    return F.lit(text).cast("timestamp_ntz")


def shift(when: Column, seconds: float | Column) -> Column:
    """``when`` moved by a number of seconds (may be negative or fractional)."""
    amount = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    return when + F.make_dt_interval(secs=amount.cast("decimal(18,6)"))


def before(as_of: datetime | str, seconds: float) -> Column:
    """The constant instant ``as_of - seconds`` as one foldable literal."""
    return shift(instant(as_of), -seconds)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def bucket_start(ts: Column, width_seconds: int) -> Column:
    """Start of the fixed-width bucket that holds ``ts``."""
    width = width_seconds * 1_000_000
    start = micros(ts) - F.pmod(micros(ts), F.lit(width))
    return F.timestamp_micros(start).cast("timestamp_ntz")


def day_start(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz")


def hour_start(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


OFFSET_PATTERN = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"


def parse_iso(text: Column) -> Column:
    """ISO instant as UTC wall-clock; without ``Z`` or offset it is UTC already. NULL if unreadable."""
    zoned = F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")
    return F.when(text.rlike(OFFSET_PATTERN), zoned).otherwise(text.try_cast("timestamp_ntz"))


def humanize_lag(seconds: Column) -> Column:
    """``45s``, ``12m``, ``3.4h``, ``2.1d``; a dash when unknown."""
    return (
        F.when(seconds.isNull(), F.lit("—"))
        .when(seconds < 60, F.format_string("%ds", F.floor(seconds + 0.5)))
        .when(seconds < 3600, F.format_string("%dm", F.floor(seconds / 60 + 0.5)))
        .when(seconds < 86400, F.format_string("%.1fh", seconds / 3600))
        .otherwise(F.format_string("%.1fd", seconds / 86400))
    )


def utc_naive(df: DataFrame) -> DataFrame:
    """Zoned timestamp columns become ``timestamp_ntz``."""
    zoned = {f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields
             if isinstance(f.dataType, T.TimestampType)}
    return df.withColumns(zoned) if zoned else df
