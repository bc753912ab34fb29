"""Exact interpolated quantiles per group when a group may be too large for one task."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped_quantiles(df: DataFrame, keys: list[str], value: Column, quantiles: Mapping[str, float],
                      bucket_width: float = 1.0) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per key.

    Equal values collapse into counts on the map side. Counts per value bucket tell which bucket
    holds each wanted position; only those buckets are ordered, each as its own group.
    """
    counted = (df.select(*keys, value.cast("double").alias("v")).filter(F.col("v").isNotNull())
               .groupBy(*keys, F.floor(F.col("v") / bucket_width).alias("b"), "v").agg(F.count(F.lit(1)).alias("n")))
    per_bucket = counted.groupBy(*keys, "b").agg(F.sum("n").alias("n"))
    group, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("b")
    placed = (per_bucket.withColumn("total", F.sum("n").over(group))
              .withColumn("skip", F.sum("n").over(upto) - F.col("n")))
    wanted = []
    for name, q in quantiles.items():
        position = (F.col("total") - 1) * q
        low, high = F.floor(position), F.ceil(position)
        wanted.append(F.struct(F.lit(name).alias("q"), low.alias("pos"), (1 - (position - low)).alias("weight")))
        wanted.append(F.struct(F.lit(name).alias("q"), high.alias("pos"), (position - low).alias("weight")))
    inside = lambda w: (w["pos"] >= F.col("skip")) & (w["pos"] < F.col("skip") + F.col("n"))
    needed = placed.select(*keys, "b", "skip", F.filter(F.array(*wanted), inside).alias("wanted")).filter(F.size("wanted") > 0)
    order = Window.partitionBy(*keys, "b").orderBy("v")
    ranked = counted.join(needed, [*keys, "b"]).withColumn("last", F.col("skip") + F.sum("n").over(order) - 1)
    hits = ranked.select(*keys, "v", "last", "n", F.explode("wanted").alias("w")).filter(
        (F.col("w.pos") <= F.col("last")) & (F.col("w.pos") > F.col("last") - F.col("n")))
    return hits.groupBy(*keys).agg(*[
        F.sum(F.when(F.col("w.q") == name, F.col("v") * F.col("w.weight"))).alias(name) for name in quantiles])
