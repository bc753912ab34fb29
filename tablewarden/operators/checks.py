"""Quality checks, expectations and the history of their results."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.assertions import assertion_holds, assertion_op, compare
from tablewarden.functions.times import (before, bucket_start, day_start, duration_seconds, instant,
                                         seconds_between)
from tablewarden.plans.answers import ask_all
from tablewarden.plans.newest import newest
from tablewarden.plans.recent import between, since
from tablewarden.plans.rules import Rule, evaluate, repeated_values, rule_row, unmatched_rows
from tablewarden.session import small_frame

DAY = 86_400
# Fixed value: a format a text column can be checked against by name.
FORMATS = {"email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"}

ROW_METRICS = ("row_count", "missing_count", "missing_percent", "min", "max", "avg",
               "invalid_count", "freshness")
VALUE_METRICS = ("duplicate_count", "duplicate_percent")
RESULT = "rule string, table_name string, check_type string, metric_value double, passed boolean"


@dataclass(frozen=True)
class Check:
    """One declared check. ``low``/``high`` with op ``between`` are inclusive."""

    table: str
    metric: str
    column: str | None = None
    op: str = "="
    value: float = 0.0
    high: float | None = None
    name: str | None = None
    pattern: str | None = None
    parent: str | None = None
    parent_column: str | None = None
    required: tuple[str, ...] = ()

    @property
    def title(self) -> str:
        if self.name:
            return self.name
        target = f"({self.column})" if self.column else ""
        return f"{self.metric}{target}"

    def holds(self, result: Column) -> Column:
        if self.op == "between":
            return result.between(self.value, self.high)
        return compare(result, self.op, F.lit(float(self.value)))


LINE = re.compile(r"^\s*(\w+)\s*(?:\(\s*([\w.]+)\s*\))?\s*"
                  r"(?:between\s+(-?[\w.]+)\s+and\s+(-?[\w.]+)|(=|!=|<=|>=|<|>)\s*(-?[\w.]+))\s*$")
EXISTS_LINE = re.compile(r"^\s*values in \((\w+)\) must exist in ([\w.]+) \((\w+)\)\s*$")


def declare(table: str, text: str, name: str | None = None) -> Check:
    """A check written as one line, e.g. ``missing_percent(c) < 5`` or ``row_count between 1 and 9``."""
    exists = EXISTS_LINE.match(text)
    if exists:
        return Check(table, "reference", exists.group(1), "=", 0, name=name or text,
                     parent=exists.group(2), parent_column=exists.group(3))
    found = LINE.match(text)
    if not found or found.group(1) not in ROW_METRICS + VALUE_METRICS:
        raise ValueError(f"not a check: {text!r}")
    metric, column, low, high, op, bound = found.groups()
    read = duration_seconds if metric == "freshness" else float
    if low is not None:
        return Check(table, metric, column, "between", read(low), read(high), name=name or text)
    return Check(table, metric, column, op, read(bound), name=name or text)


def row_metric(check: Check, as_of: datetime | str | None = None) -> Column:
    """The check's metric as an aggregate over the table's rows."""
    c = F.col(check.column) if check.column else None
    rows = F.count(F.lit(1))
    if check.metric == "row_count":
        return rows
    if check.metric == "missing_count":
        return F.count_if(c.isNull())
    if check.metric == "missing_percent":
        return F.try_divide(F.count_if(c.isNull()) * 100.0, rows)
    if check.metric == "min":
        return F.min(c)
    if check.metric == "max":
        return F.max(c)
    if check.metric == "avg":
        return F.avg(c)
    if check.metric == "invalid_count":
        # the format of the check, else the one that has the column's name
        pattern = check.pattern or FORMATS.get(check.column)
        if pattern is None:
            raise ValueError(f"{check.title}: give a pattern, {check.column} is no known format")
        return F.count_if(c.isNotNull() & ~c.rlike(pattern))
    if check.metric == "freshness":
        return seconds_between(F.max(c), instant(as_of))
    raise ValueError(f"{check.metric} is not a row metric")


def _tags(check: Check, kind: str) -> dict[str, str | None]:
    return {"table_name": check.table, "check_type": kind}


def run_suite(tables: Mapping[str, DataFrame], checks: Sequence[Check],
              as_of: datetime | str | None = None, kind: str = "declared") -> DataFrame:
    """One row per check: (rule, table_name, check_type, metric_value, passed).

    All row metrics of a table come from one scan. Each column checked for duplicates adds one
    count per value, each reference check one anti join of distinct keys. Nothing is written, so
    calling this is the dry run; ``history.append`` keeps the rows. A check of a table or column that
    is not there fails, with a NULL metric, and leaves the others alone.
    """
    parts = []
    lost = [c for c in checks if not _possible(c, tables)]
    if lost or not checks:
        session = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
        parts.append(small_frame(session, [(c.title, c.table, kind, None, False) for c in lost], RESULT))
    for table, df in tables.items():
        mine = [c for c in checks if c.table == table and c not in lost]
        fused = [Rule(c.title, row_metric(c, as_of), c.holds, _tags(c, kind))
                 for c in mine if c.metric in ROW_METRICS]
        if fused:
            parts.append(evaluate(df, fused))
        for column in dict.fromkeys(c.column for c in mine if c.metric in VALUE_METRICS):
            stats = repeated_values(df, column)
            rows = []
            for c in mine:
                if c.metric in VALUE_METRICS and c.column == column:
                    value = (F.col("repeated") if c.metric == "duplicate_count"
                             else F.try_divide(F.col("repeated") * 100.0, F.col("rows")))
                    rows.append(rule_row(Rule(c.title, value, c.holds, _tags(c, kind)), value, None))
            parts.append(stats.select(F.inline(F.array(*rows))))
        for c in mine:
            if c.metric == "reference":
                alone = unmatched_rows(df, [c.column], tables[c.parent], [c.parent_column], skip_null_keys=True)
                rule = Rule(c.title, F.col("unmatched"), c.holds, _tags(c, kind))
                parts.append(alone.select(F.inline(F.array(rule_row(rule, F.col("unmatched"), None)))))
            if c.metric == "required_columns":
                parts.append(_required_row(df, c, kind))
    return reduce(DataFrame.unionByName, parts)


def _possible(c: Check, tables: Mapping[str, DataFrame]) -> bool:
    """Are the check's tables and columns there?"""
    wanted = [(c.table, c.column)] + ([(c.parent, c.parent_column)] if c.parent else [])
    return all(t in tables and (n is None or n in tables[t].columns) for t, n in wanted)


def _required_row(df: DataFrame, c: Check, kind: str) -> DataFrame:
    absent = len([n for n in c.required if n not in df.columns])
    rule = Rule(c.title, F.col("absent"), c.holds, _tags(c, kind))
    counted = small_frame(df.sparkSession, [(absent,)], "absent bigint")
    return counted.select(F.inline(F.array(rule_row(rule, F.col("absent"), None))))


def missing_columns(schema_rows: DataFrame, required: DataFrame) -> DataFrame:
    """Required (table_name, column_name) pairs that the tables do not have."""
    return required.join(schema_rows, ["table_name", "column_name"], "left_anti")


def expectation_results(df: DataFrame, table: str, *, not_null: Sequence[str] = (),
                        unique: Sequence[str] = (),
                        between: Mapping[str, tuple[float | None, float | None]] | None = None,
                        row_count: tuple[int | None, int | None] | None = None) -> DataFrame:
    """Expectation suite: (expectation, column_name, success, unexpected_count, unexpected_percent).

    Percentages are over the non-null rows of the column, except for not-null (all rows). For
    uniqueness every row of a repeated value is unexpected.
    """
    n = F.count(F.lit(1))

    def shape(label, column, unexpected, of, success=None):
        u = unexpected.cast("bigint")
        return F.struct(F.lit(label).alias("expectation"), F.lit(column).cast("string").alias("column_name"),
                        (u == 0 if success is None else success).alias("success"), u.alias("unexpected_count"),
                        F.round(F.try_divide(u * 100.0, of), 6).alias("unexpected_percent"))

    metrics, rows = {"n": n}, []
    for c in not_null:
        metrics[f"null_{c}"] = F.count_if(F.col(c).isNull())
        rows.append(("expect_column_values_to_not_be_null", c, f"null_{c}", "n"))
    for c, (low, high) in (between or {}).items():
        out = F.lit(False)
        if low is not None:
            out = out | (F.col(c) < low)
        if high is not None:
            out = out | (F.col(c) > high)
        metrics[f"out_{c}"], metrics[f"have_{c}"] = F.count_if(out), F.count(c)
        rows.append(("expect_column_values_to_be_between", c, f"out_{c}", f"have_{c}"))
    parts = []
    if rows or row_count:
        structs = [shape(label, c, F.col(u), F.col(of)) for label, c, u, of in rows]
        if row_count:
            low, high = row_count
            inside = F.lit(True)
            if low is not None:
                inside = inside & (F.col("n") >= low)
            if high is not None:
                inside = inside & (F.col("n") <= high)
            structs.append(shape("expect_table_row_count_to_be_between", None,
                                 F.when(inside, 0).otherwise(F.col("n")), F.col("n"), inside))
        measured = df.agg(*[m.alias(k) for k, m in metrics.items()])
        parts.append(measured.select(F.inline(F.array(*structs))))
    for c in unique:
        counts = df.select(F.col(c).alias("v")).dropna().groupBy("v").agg(n.alias("k")).agg(
            F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("u"),
            F.coalesce(F.sum("k"), F.lit(0)).alias("of"))
        parts.append(counts.select(F.inline(F.array(
            shape("expect_column_values_to_be_unique", c, F.col("u"), F.col("of"))))))
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class SqlCheck:
    name: str
    query: str
    assertion: str = "result == 0"
    table: str = "unknown"


def run_sql_checks(spark: SparkSession, checks: Sequence[SqlCheck],
                   tables: Mapping[str, DataFrame]) -> DataFrame:
    """User queries judged by an assertion on their first value, with ``details`` of what went wrong.

    Tables are named ``{orders}``, ``orders`` or ``public.orders``. No row counts as 0. A NULL or
    non-numeric value fails everything but ``!=``; an assertion outside the grammar and a query that does not
    compile or run fail, and only they do. The metric is kept only for numbers.
    """
    answers = ask_all(spark, [c.query for c in checks], tables)
    rows = small_frame(spark, [(c.name, c.table, c.assertion, a.value if a.rows else (None if a.error else 0.0), a.error) for c, a in zip(checks, answers)],
                       "check_name string, table_name string, assertion string, metric_value double, error string")
    value, text = F.col("metric_value"), F.col("assertion")
    judged = F.coalesce(assertion_holds(text, value), value.isNull() & (assertion_op(text) == "!="), F.lit(False))
    known = assertion_op(text).isNotNull()
    details = F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), "error")).when(~known, F.concat(F.lit("error: not an assertion: "), text))
    return rows.select("check_name", "table_name", F.lit("custom_sql").alias("check_type"),
                       (F.col("error").isNull() & known & judged).alias("passed"), "metric_value", details.alias("details"))


def results(history: DataFrame, table: str | None = None, passed: bool | None = None,
            limit: int = 50) -> DataFrame:
    where = None
    if table is not None:
        where = F.col("table_name") == table
    if passed is not None:
        flag = F.col("passed") == F.lit(passed)
        where = flag if where is None else where & flag
    return newest(history, "executed_at", limit, where)


def daily_pass_rate(history: DataFrame, as_of: datetime | str, days: int = 30) -> DataFrame:
    recent = since(history, "executed_at", before(as_of, days * DAY))
    return recent.groupBy("table_name", day_start(F.col("executed_at")).alias("day")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"),
        (F.count_if("passed") * 100.0 / F.count(F.lit(1))).alias("pass_rate"))


def trend(history: DataFrame, as_of: datetime | str, days: int = 30, bucket_seconds: int = 3600) -> DataFrame:
    """Per table: overall pass rate, current failure streak, and the pass rate of each day.

    The streak counts failing rows newer than the last passing one. Rows are first reduced per
    table and time bucket: within a bucket the failures after its last pass follow from a window
    over that bucket only, and a table's streak is then a sum over its buckets.
    """
    recent = since(history, "executed_at", before(as_of, days * DAY))
    # Results of one run share a time and collapse here, before any window.
    moments = recent.groupBy("table_name", bucket_start(F.col("executed_at"), bucket_seconds).alias("b"),
                             "executed_at").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("ok"))
    last_ok = F.max(F.when(F.col("ok") > 0, F.col("executed_at"))).over(Window.partitionBy("table_name", "b"))
    in_tail = F.col("last_ok").isNull() | (F.col("executed_at") > F.col("last_ok"))
    buckets = moments.withColumn("last_ok", last_ok).groupBy("table_name", "b").agg(
        F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.max("last_ok").alias("last_ok"),
        F.sum(F.when(in_tail, F.col("n") - F.col("ok")).otherwise(0)).alias("tail"))
    table = Window.partitionBy("table_name")
    newest_ok = F.max(F.when(F.col("last_ok").isNotNull(), F.col("b"))).over(table)
    streak = F.sum(F.when(F.col("newest_ok").isNull() | (F.col("b") >= F.col("newest_ok")),
                          F.col("tail")).otherwise(0)).over(table)
    marked = (buckets.withColumn("newest_ok", newest_ok).withColumn("streak", streak)
              .withColumn("overall", F.sum("ok").over(table) * 100.0 / F.sum("n").over(table)))
    return marked.groupBy("table_name", day_start(F.col("b")).alias("day")).agg(
        (F.sum("ok") * 100.0 / F.sum("n")).alias("pass_rate"),
        F.round(F.max("overall"), 2).alias("overall_pass_rate"),
        F.max("streak").alias("current_failure_streak"))


def pass_rate_by_table(history: DataFrame) -> DataFrame:
    return history.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"),
        F.round(F.count_if("passed") * 100.0 / F.count(F.lit(1)), 6).alias("pass_rate"))


def checks_in_last_day(history: DataFrame, as_of: datetime | str) -> DataFrame:
    """Checks run in the 24 hours before ``as_of`` per table, split by outcome."""
    recent = between(history, "executed_at", before(as_of, DAY), instant(as_of))
    return recent.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("checks_run"), F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"))
