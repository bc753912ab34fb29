"""Schema snapshots and the changes between them."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewarden.functions.times import instant
from tablewarden.plans.newest import newest_n_per
from tablewarden.sources.tables import schema_rows


def snapshot(spark: SparkSession, tables: Mapping[str, DataFrame], as_of: datetime | str) -> DataFrame:
    """One row per table with its columns in order."""
    column = F.struct("ordinal_position", F.col("column_name").alias("name"), F.col("data_type").alias("type"), "nullable")
    rows = schema_rows(spark, tables).groupBy("table_name").agg(F.array_sort(F.collect_list(column)).alias("c"))
    ordered = F.transform("c", lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type"),
                                                  c["nullable"].alias("nullable"),
                                                  c["ordinal_position"].alias("ordinal_position")))
    return rows.select("table_name", ordered.alias("columns"), instant(as_of).alias("snapshot_at"))


def changes(old: Column, new: Column) -> Column:
    """Array of (change_type, column_name, old_value, new_value) between two column arrays.

    Names are compared case-sensitively; order and nullability are ignored.
    """
    types = lambda columns: F.map_from_entries(F.transform(columns, lambda c: F.struct(c["name"], c["type"])))
    before, after = types(old), types(new)
    names = F.array_union(F.map_keys(before), F.map_keys(after))

    def one(n: Column) -> Column:
        was, now = F.element_at(before, n), F.element_at(after, n)
        kind = (F.when(~F.map_contains_key(after, n), "removed")
                .when(~F.map_contains_key(before, n), "added")
                .when(~was.eqNullSafe(now), "type_changed"))
        return F.struct(kind.alias("change_type"), n.alias("column_name"),
                        was.alias("old_value"), now.alias("new_value"))

    return F.filter(F.transform(names, one), lambda d: d["change_type"].isNotNull())


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Changes from each table's previous snapshot to its current one; a first snapshot has none."""
    pair = current.alias("n").join(previous.alias("o"), "table_name")
    return pair.select("table_name", F.inline(changes(F.col("o.columns"), F.col("n.columns"))))


def diff_history(snapshots: DataFrame) -> DataFrame:
    """Changes between every consecutive pair of snapshots of a table."""
    order = Window.partitionBy("table_name").orderBy("snapshot_at")
    pairs = snapshots.withColumn("prev", F.lag("columns").over(order)).filter(F.col("prev").isNotNull())
    return pairs.select("table_name", F.col("snapshot_at").alias("detected_at"),
                        F.inline(changes(F.col("prev"), F.col("columns"))))


def latest_diffs(diffs: DataFrame, n: int = 20, id_col: str = "column_name") -> DataFrame:
    return newest_n_per(diffs, ["table_name"], "detected_at", n, id_col)


def latest_snapshots(snapshots: DataFrame, n: int = 10, id_col: str = "snapshot_at") -> DataFrame:
    return newest_n_per(snapshots, ["table_name"], "snapshot_at", n, id_col)


def summary(diffs: DataFrame) -> DataFrame:
    """One alert text per table and detection: a line per changed column, ordered by name."""
    line = F.concat(F.lit("  - Column `"), "column_name", F.lit("` "), "change_type",
                    F.when(F.col("change_type") == "type_changed",
                           F.concat(F.lit(": "), "old_value", F.lit(" → "), "new_value")).otherwise(""))
    grouped = diffs.groupBy("table_name", "detected_at").agg(
        F.count(F.lit(1)).alias("changes"), F.array_sort(F.collect_list(F.struct("column_name", line.alias("line")))).alias("lines"))
    return grouped.select("table_name", "detected_at", "changes", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("summary"))
