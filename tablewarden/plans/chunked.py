"""The row before, in a long history, without one task per key.

A history is cut into chunks of time. Within a chunk a window function does it; the first row of a chunk takes what
the chunks before it left behind, of which each is one row. So a task holds a chunk of a key's history, or one row
for each of the key's chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(rows: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], value: Column, name: str = "previous") -> DataFrame:
    """Add ``value`` of the row before by ``order`` among rows of equal ``keys``; NULL for the first.

    ``chunk`` must not fall as ``order`` rises, ``order`` must be total within a key. ``value`` must not be NULL; pack
    what may be into a struct. Keys may be NULL and are then equal.
    """
    rows = rows.withColumns({"_chunk": chunk, "_value": value})
    last = rows.groupBy(*keys, "_chunk").agg(F.max_by("_value", F.struct(*order)).alias("_last"))
    carried = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk"))).drop("_last")
    inside = rows.withColumn("_inside", F.lag("_value").over(Window.partitionBy(*keys, "_chunk").orderBy(*order)))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_chunk"]]
    kept = [F.col(f"l.{c}") for c in rows.columns if c not in ("_chunk", "_value")]
    # a chunk's first row is the only one that needs what was carried
    joined = inside.alias("l").join(carried.alias("r"), same, "left")
    return joined.select(*kept, F.coalesce("l._inside", "r._carried").alias(name))


def with_last_marked(rows: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], marked: Column, name: str) -> DataFrame:
    """Add the last non-NULL ``marked`` up to and with each row, by the same rules."""
    rows = rows.withColumns({"_chunk": chunk, "_marked": marked})
    by_chunk = rows.where(F.col("_marked").isNotNull()).groupBy(*keys, "_chunk").agg(F.max_by("_marked", F.struct(*order)).alias("_last"))
    every = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    pair = [F.col(f"e.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_chunk"]]
    left = every.alias("e").join(by_chunk.alias("b"), pair, "left").select(*[F.col(f"e.{k}") for k in [*keys, "_chunk"]], F.col("b._last").alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    to_here = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("_inside", F.last("_marked", ignorenulls=True).over(to_here))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_chunk"]]
    kept = [F.col(f"l.{c}") for c in rows.columns if c not in ("_chunk", "_marked")]
    joined = inside.alias("l").join(carried.alias("r"), same, "left")
    return joined.select(*kept, F.coalesce("l._inside", "r._carried").alias(name))
