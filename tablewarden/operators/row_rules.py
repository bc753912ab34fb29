"""Rules over the columns of one row, and samples of the rows that break them.

A rule is a boolean SQL expression, such as ``shipped_at >= ordered_at``, parsed and typed by Spark. A row breaks it where
it is false; where it is NULL nothing is known and the row counts as neither. All rules of a table share one scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.session import small_frame


@dataclass(frozen=True)
class RowRule:
    name: str
    expression: str
    most_failed: int = 0


def problem(df: DataFrame, rule: RowRule) -> str | None:
    """Why the rule cannot be judged on this table, if it cannot. Only row expressions pass: no aggregates, windows or generators."""
    try:
        kept = df.filter(F.expr(rule.expression))
        kind = df.select(F.expr(rule.expression).alias("x")).schema["x"].dataType
        kept.schema
    except PySparkException as found:
        return next((line for line in str(found).splitlines() if line.strip()), "not an expression")[:500]
    return None if isinstance(kind, T.BooleanType) else f"a rule is true or false, this one is {kind.simpleString()}"


def check(df: DataFrame, table: str, rules: Sequence[RowRule]) -> DataFrame:
    """``rule``, ``table_name``, ``failed``, ``unknown``, ``passed``, ``details``: one row per rule; an unusable one fails with its reason."""
    reasons = {r.name: problem(df, r) for r in rules}
    usable = [r for r in rules if reasons[r.name] is None]
    bad = small_frame(df.sparkSession, [(r.name, table, None, None, False, f"error: {reasons[r.name]}") for r in rules if reasons[r.name]],
                      "rule string, table_name string, failed bigint, unknown bigint, passed boolean, details string")
    if not usable:
        return bad
    counts = [c for i, r in enumerate(usable) for c in (F.count_if(~F.expr(r.expression)).alias(f"f{i}"), F.count_if(F.expr(r.expression).isNull()).alias(f"u{i}"))]
    rows = [F.struct(F.lit(r.name).alias("rule"), F.lit(table).alias("table_name"), F.col(f"f{i}").alias("failed"), F.col(f"u{i}").alias("unknown"),
                     (F.col(f"f{i}") <= r.most_failed).alias("passed"), F.lit(None).cast("string").alias("details")) for i, r in enumerate(usable)]
    return df.agg(*counts).select(F.inline(F.array(*rows))).unionByName(bad)


def failing_rows(df: DataFrame, rules: Sequence[RowRule], k: int = 10, order: Sequence[str | Column] | None = None) -> DataFrame:
    """Up to ``k`` rows that break each rule: ``rule``, ``place`` and the row as a struct ``row``.

    Taken are the first by ``order``, by default by a hash of the whole row, so the sample does not depend on how the table
    is partitioned. Every task keeps its own first k of a rule before the shuffle, so a rule that all rows break moves k
    rows a task. One scan serves all rules; unusable ones have no rows.
    """
    usable = [r for r in rules if problem(df, r) is None]
    broken = F.array_compact(F.array(*[F.when(~F.expr(r.expression), F.lit(r.name)) for r in usable])) if usable else F.array().cast("array<string>")
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    first = list(order) if order else [F.xxhash64(*[F.to_json(F.struct(f"`{c}`")) for c in df.columns]), F.to_json(whole)]
    keys = [(F.col(c) if isinstance(c, str) else c).alias(f"_o{i}") for i, c in enumerate(first)]
    told = df.select(F.explode(broken).alias("rule"), whole.alias("row"), *keys)
    by = Window.partitionBy("rule").orderBy(*[f"_o{i}" for i in range(len(keys))])
    return told.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k).select("rule", "place", "row")
