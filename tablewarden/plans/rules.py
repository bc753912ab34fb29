"""Rule compiler: many rules over one table become one aggregation and a row per rule."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``metric`` is an aggregate over the table, ``holds`` judges its value."""

    name: str
    metric: Column
    holds: Callable[[Column], Column]
    tags: dict[str, str | None] = field(default_factory=dict)


def rule_row(rule: Rule, metric: Column, extra: Callable[[Rule, Column], list[Column]] | None) -> Column:
    value = metric.cast("double")
    passed = F.coalesce(rule.holds(value), F.lit(False))
    tags = [F.lit(v).cast("string").alias(k) for k, v in rule.tags.items()]
    more = extra(rule, value) if extra else []
    return F.struct(F.lit(rule.name).alias("rule"), *tags, value.alias("metric_value"),
                    passed.alias("passed"), *more)


def evaluate(df: DataFrame, rules: Sequence[Rule],
             extra: Callable[[Rule, Column], list[Column]] | None = None) -> DataFrame:
    """All rules in one pass over ``df``: one aggregate row, unfolded to a row per rule."""
    named = [f"m{i}" for i in range(len(rules))]
    measured = df.agg(*[r.metric.alias(n) for r, n in zip(rules, named)])
    rows = [rule_row(r, F.col(n), extra) for r, n in zip(rules, named)]
    return measured.select(F.inline(F.array(*rows)))


def repeated_values(df: DataFrame, column: str, keep_null_group: bool = False) -> DataFrame:
    """One row: values that occur more than once, and the rows seen.

    The count per value is combined on the map side, so a value holding a large share of the
    table moves as one partial count per task.
    """
    counts = df.select(F.col(column).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    repeated = F.col("n") > 1
    if not keep_null_group:
        repeated = repeated & F.col("v").isNotNull()
    return counts.agg(F.count_if(repeated).alias("repeated"),
                      F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def unmatched_rows(child: DataFrame, child_keys: Sequence[str], parent: DataFrame,
                   parent_keys: Sequence[str], skip_null_keys: bool = False) -> DataFrame:
    """One row: child rows without a parent.

    Child rows are counted per key and parent keys deduplicated before the anti join, so neither
    side can send a hot key's rows to one task. A NULL key never matches.
    """
    keys = [f"k{i}" for i in range(len(child_keys))]
    left = child.select(*[F.col(c).alias(k) for c, k in zip(child_keys, keys)])
    if skip_null_keys:
        left = left.dropna(how="any")
    left = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    right = parent.select(*[F.col(c).alias(k) for c, k in zip(parent_keys, keys)]).distinct()
    return left.join(right, keys, "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unmatched"))
