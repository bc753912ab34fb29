"""Lineage from dbt manifests, and what lies below a table at any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.session import fresh_path, small_frame

PARENTS = "struct<parent_map:map<string,array<string>>>"


def manifest_edges(manifests: DataFrame, manifest: str = "manifest") -> DataFrame:
    """(table_name, downstream) of every parent in every document's ``parent_map``, each once.

    Unreadable documents, null and empty parent lists give no edge.
    """
    parents = manifests.select(F.explode(F.from_json(manifest, PARENTS)["parent_map"]).alias("downstream", "parents"))
    edges = parents.select(F.explode("parents").alias("table_name"), "downstream")
    return edges.where("table_name is not null").distinct()


def closure(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """``table_name``, ``downstream``, ``depth``: every table that can be reached, with the least number of edges.

    Semi-naive: each round joins only the pairs that the round before found with the edges, and keeps those not seen
    yet. Rounds go by distance, so the first depth of a pair is its least one, and cycles end by themselves: a table
    on a cycle reaches itself, with the cycle's length. Every round is written, and the next one reads it; pairs are
    made distinct before they are compared with what is known.
    """
    spark = edges.sparkSession
    steps = edges.select("table_name", "downstream").where("table_name is not null and downstream is not null").distinct()
    root = fresh_path(spark, "closure")
    kind = steps.schema["table_name"].dataType.simpleString()
    schema = f"table_name {kind}, downstream {kind}, depth int"
    small_frame(spark, [], schema).write.parquet(f"{root}/round-0")
    steps.write.parquet(f"{root}/edges")
    steps = spark.read.schema(f"table_name {kind}, downstream {kind}").parquet(f"{root}/edges")
    fresh, paths, at = steps, [f"{root}/round-0"], 1
    while depth is None or at <= depth:
        path = f"{root}/round-{at}"
        fresh.withColumn("depth", F.lit(at)).write.parquet(path)
        last = spark.read.schema(schema).parquet(path)
        if last.isEmpty():
            break
        paths, at = [*paths, path], at + 1
        known = spark.read.schema(schema).parquet(*paths)
        further = last.select("table_name", F.col("downstream").alias("via")).join(steps.withColumnRenamed("table_name", "via"), "via")
        fresh = further.select("table_name", "downstream").distinct().join(known, ["table_name", "downstream"], "left_anti")
    return spark.read.schema(schema).parquet(*paths)
