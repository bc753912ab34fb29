"""Cross-table consistency and migration parity."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.plans.rules import unmatched_rows
from tablewarden.sources.tables import row_counts, schema_rows

MONEY = "decimal(18,2)"


def orphans(a: DataFrame, b: DataFrame, key_a: str, key_b: str, name: str, tolerance: int = 0) -> DataFrame:
    """Rows of A without a row of B on the key; a NULL key counts as unmatched."""
    lost = unmatched_rows(a, [key_a], b, [key_b])
    return lost.select(F.lit(name).alias("check_name"), "unmatched",
                       (F.col("unmatched") <= tolerance).alias("passed"))


def row_count_match(a: DataFrame, b: DataFrame, name: str, tolerance: int = 0) -> DataFrame:
    """Both tables are counted side by side: a flag per side, one aggregate, no join."""
    sides = a.select(F.lit(True).alias("in_a")).unionByName(b.select(F.lit(False).alias("in_a")))
    n = sides.agg(F.count_if("in_a").alias("count_a"), F.count_if(~F.col("in_a")).alias("count_b"))
    diff = F.abs(F.col("count_a") - F.col("count_b"))
    return n.select(F.lit(name).alias("check_name"), "count_a", "count_b", diff.alias("diff"),
                    (diff <= tolerance).alias("passed"))


def relative_gap(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def sum_match(a: DataFrame, b: DataFrame, column_a: str, column_b: str, name: str,
              tolerance: float = 0.0) -> DataFrame:
    """Sums are taken as decimals, so the result does not depend on the order of the rows."""
    empty = F.lit(None).cast(MONEY)
    sides = a.select(F.col(column_a).cast(MONEY).alias("a"), empty.alias("b")).unionByName(
        b.select(empty.alias("a"), F.col(column_b).cast(MONEY).alias("b")))
    sums = sides.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(f"sum_{c}") for c in ("a", "b")])
    gap = relative_gap(F.col("sum_a"), F.col("sum_b"))
    return sums.select(F.lit(name).alias("check_name"), "sum_a", "sum_b", gap.alias("drift"),
                       (gap <= tolerance).alias("passed"))


def migration_parity(source: Mapping[str, DataFrame], target: Mapping[str, DataFrame]) -> DataFrame:
    """Per table of either side: both counts, their difference, and the columns that differ.

    A table that exists on one side only has a NULL count on the other.
    """
    spark = next(iter({**source, **target}.values())).sparkSession
    counts = row_counts(source).withColumnRenamed("row_count", "source_rows").join(
        row_counts(target).withColumnRenamed("row_count", "target_rows"), "table_name", "full_outer")
    both = sorted(set(source) & set(target))
    left = schema_rows(spark, {t: source[t] for t in both}).select("table_name", "column_name", F.col("data_type").alias("s"))
    right = schema_rows(spark, {t: target[t] for t in both}).select("table_name", "column_name", F.col("data_type").alias("t"))
    differs = left.join(right, ["table_name", "column_name"], "full_outer").groupBy("table_name").agg(
        F.count_if(~F.col("s").eqNullSafe(F.col("t"))).alias("schema_differences"))
    status = (F.when(F.col("source_rows").isNull(), "missing_in_source")
              .when(F.col("target_rows").isNull(), "missing_in_target")
              .when((F.col("source_rows") != F.col("target_rows")) | (F.col("schema_differences") > 0), "different")
              .otherwise("equal"))
    return counts.join(differs, "table_name", "left").select(
        "table_name", "source_rows", "target_rows",
        (F.col("target_rows") - F.col("source_rows")).alias("row_difference"),
        "schema_differences", status.alias("status"))
