"""Trailing-window totals per key that do not put a whole key into one task.

Each history row enters the window at its own time and leaves one window length later, so a
trailing total is a running total over enter/leave events. Running totals are split by fixed
time chunks: a total inside the chunk plus the total of all earlier chunks. The per-key window
runs over one row per chunk, whose number depends on the time span and not on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.times import micros

CHUNK_SECONDS = 6 * 3600


def trailing_totals(df: DataFrame, keys: list[str], time_col: str, totals: dict[str, Column],
                    window_seconds: int, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Rows of ``df`` plus, per name, the sum of that column over ``[t - window, t)``.

    Sums are exact, so the columns should be integers or decimals.
    """
    rest = [c for c in df.columns if c not in keys]
    at, width = micros(F.col(time_col)), chunk_seconds * 1_000_000
    whole = F.struct(*rest)

    def event(row: Column, when: Column, sign: int) -> Column:
        return F.struct(row.alias("__row"), when.alias("__at"),
                        *[(c * sign).cast(df.select(c).schema[0].dataType).alias(f"__d_{n}") for n, c in totals.items()])

    gone = F.when(F.lit(False), whole)
    both = F.array(event(F.when(F.lit(True), whole), at, 1), event(gone, at + window_seconds * 1_000_000, -1))
    events = df.select(*keys, F.inline(both))
    events = events.withColumn("__chunk", F.col("__at") - F.pmod("__at", F.lit(width)))

    per_chunk = events.groupBy(*keys, "__chunk").agg(
        *[F.sum(f"__d_{n}").alias(f"__s_{n}") for n in totals])
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(*keys, "__chunk", *[
        F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in totals])

    inside = (Window.partitionBy(*keys, "__chunk").orderBy("__at")
              .rangeBetween(Window.unboundedPreceding, -1))
    local = events.withColumns({
        f"__l_{n}": F.coalesce(F.sum(f"__d_{n}").over(inside), F.lit(0)) for n in totals})
    joined = local.filter(F.col("__row").isNotNull()).join(offsets, [*keys, "__chunk"])
    return joined.select(*keys, "__row.*", *[
        (F.col(f"__l_{n}") + F.col(f"__o_{n}")).alias(n) for n in totals]).select(*df.columns, *totals)
