"""Newest-record shapes over history tables. Every order has the id as final tie-break."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_per(df: DataFrame, keys: Sequence[str], time_col: str, id_col: str = "id") -> DataFrame:
    """The newest row of each key, as a partial + final aggregate (no sort, no window)."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(time_col, id_col)).alias("r")
    return df.groupBy(*keys).agg(best).select(*keys, "r.*").select(*df.columns)


def newest_n_per(df: DataFrame, keys: Sequence[str], time_col: str, n: int,
                 id_col: str = "id") -> DataFrame:
    """The newest ``n`` rows of each key. The rank filter is pushed below the shuffle as a
    per-partition group limit, so a hot key moves at most ``n`` rows per map task."""
    order = Window.partitionBy(*keys).orderBy(F.desc(time_col), F.desc(id_col))
    return df.withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= n).drop("__rn")


def newest(df: DataFrame, time_col: str, limit: int = 50, where: Column | None = None,
           id_col: str = "id") -> DataFrame:
    """Newest-first listing with an optional filter and the list limit of the report."""
    rows = df if where is None else df.filter(where)
    return rows.orderBy(F.desc(time_col), F.desc(id_col)).limit(limit)
