"""Time bounds on history rows that also prune the date folders they are kept in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the folder column of history tables.
PARTITION = "on_date"


def between(rows: DataFrame, column: str, start: Column | None = None, end: Column | None = None, before_end: bool = False) -> DataFrame:
    """Rows from ``start`` to ``end`` (up to but without it, with ``before_end``), constants both.

    A history table keeps the date of ``column`` as its folder column, so the same bounds on the date leave whole folders
    unread. Rows that have no such column are filtered by time alone.
    """
    tests = []
    dated = PARTITION in rows.columns
    if start is not None:
        tests.append(F.col(column) >= start)
        tests += [F.col(PARTITION) >= F.to_date(start)] if dated else []
    if end is not None:
        tests.append(F.col(column) < end if before_end else F.col(column) <= end)
        tests += [F.col(PARTITION) <= F.to_date(end)] if dated else []
    for test in tests:
        rows = rows.filter(test)
    return rows


def since(rows: DataFrame, column: str, start: Column) -> DataFrame:
    return between(rows, column, start)
