"""Column profiles."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.times import instant

UNORDERED = (T.MapType, T.VariantType)


def profiled_columns(df: DataFrame) -> list[T.StructField]:
    """Columns that can be ordered and counted distinct."""
    return [f for f in df.schema.fields if not isinstance(f.dataType, UNORDERED)]


def _fused(df: DataFrame, table: str, as_of, distinct: bool, rsd: float) -> DataFrame:
    fields = profiled_columns(df)
    asked = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        asked += [F.count(c).alias(f"c{i}"), F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}")]
        if isinstance(f.dataType, T.NumericType):
            asked.append(F.avg(c).cast("double").alias(f"mean{i}"))
        if distinct:
            asked.append(F.approx_count_distinct(c, rsd).alias(f"d{i}"))
    rows = []
    for i, f in enumerate(fields):
        nulls = F.col("n") - F.col(f"c{i}")
        mean = F.col(f"mean{i}") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")
        rows.append(F.struct(
            F.lit(table).alias("table_name"), F.lit(f.name).alias("column_name"),
            nulls.alias("null_count"), (nulls / F.col("n")).alias("null_pct"),
            *([F.col(f"d{i}").alias("distinct_count")] if distinct else []),
            F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value"), mean.alias("mean_value"),
            instant(as_of).alias("profiled_at")))
    return df.agg(*asked).filter("n > 0").select(F.inline(F.array(*rows)))


def profile(df: DataFrame, table: str, as_of: datetime | str) -> DataFrame:
    """Exact profile: one fused scan, plus one single-column distinct count per column.

    Several exact distinct counts in one aggregate would multiply every row by the number of
    columns; separate branches each read only their own column, so together they read the table
    once more. An empty table has no profile.
    """
    distinct = reduce(DataFrame.unionByName, [
        df.select(F.col(f"`{f.name}`").alias("v")).agg(F.count_distinct("v").alias("distinct_count"))
        .select(F.lit(f.name).alias("column_name"), "distinct_count") for f in profiled_columns(df)])
    return _fused(df, table, as_of, False, 0).join(distinct, "column_name").select(
        "table_name", "column_name", "null_count", "null_pct", "distinct_count", "min_value",
        "max_value", "mean_value", "profiled_at")


def profile_approx(df: DataFrame, table: str, as_of: datetime | str, rsd: float = 0.05) -> DataFrame:
    """The same with approximate distinct counts, all in one scan without a wide shuffle."""
    return _fused(df, table, as_of, True, rsd)


def report(profiles: DataFrame) -> DataFrame:
    """What a reader is shown: null share in percent with two digits, and distinct values."""
    return profiles.select("table_name", "column_name", F.round(F.col("null_pct") * 100, 2).alias("null_percent"), "distinct_count")


def latest(profiles: DataFrame) -> DataFrame:
    """All rows of each table's newest profile run: the rows of a run share its time."""
    rest = [c for c in profiles.columns if c not in ("table_name", "profiled_at")]
    runs = profiles.groupBy("table_name", "profiled_at").agg(F.collect_list(F.struct(*rest)).alias("rows"))
    newest = runs.groupBy("table_name").agg(F.max("profiled_at").alias("profiled_at"),
                                            F.max_by("rows", "profiled_at").alias("rows"))
    return newest.select("table_name", "profiled_at", F.inline("rows")).select(*profiles.columns)
