"""dbt artifacts: run results joined to the manifest, as run rows and check rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.times import instant, parse_iso

NODE = "struct<resource_type:string,name:string,attached_node:string>"
RESULTS = ("struct<metadata:struct<invocation_id:string,generated_at:string>,"
           "results:array<struct<unique_id:string,status:string,execution_time:double,message:string>>>")
MANIFEST = f"struct<nodes:map<string,{NODE}>,sources:map<string,{NODE}>,metrics:map<string,{NODE}>>"
# Node kinds that are runs, and states that count as success.
RUN_KINDS = ("model", "seed", "snapshot")
GOOD = ("success", "pass")


def known_nodes(manifest: Column) -> Column:
    """All nodes of a manifest as one map; sources, then metrics, stand in for absent nodes."""
    nodes, sources, metrics = (F.coalesce(manifest[part], F.create_map().cast(f"map<string,{NODE}>"))
                               for part in ("nodes", "sources", "metrics"))
    more = F.map_filter(sources, lambda k, _: ~F.map_contains_key(nodes, k))
    last = F.map_filter(metrics, lambda k, _: ~F.map_contains_key(nodes, k) & ~F.map_contains_key(sources, k))
    return F.map_concat(nodes, more, last)


def result_rows(documents: DataFrame, key: str, as_of: datetime | str, results: str = "run_results", carry: Sequence[str] = ()) -> DataFrame:
    """One row per result of the run documents; ``at`` is the document's time, or ``as_of`` where it has none."""
    doc = documents.select(key, *carry, F.from_json(results, RESULTS).alias("d"))
    at = F.coalesce(parse_iso(F.col("d.metadata.generated_at")), instant(as_of))
    return doc.select(key, *carry, F.col("d.metadata.invocation_id").alias("invocation_id"), at.alias("at"), F.inline("d.results"))


def node_rows(documents: DataFrame, key: str, manifest: str = "manifest", carry: Sequence[str] = ()) -> DataFrame:
    """One row per node of the manifests."""
    parsed = documents.select(key, *carry, F.from_json(manifest, MANIFEST).alias("m"))
    return parsed.select(key, *carry, F.explode(known_nodes(F.col("m"))).alias("unique_id", "node"))


def joined_results(artifacts: DataFrame, key: str, as_of: datetime | str, results: str = "run_results",
                   manifest: str = "manifest") -> DataFrame:
    """One row per result with its node. ``key`` identifies an artifact pair.

    Results and nodes are unfolded to rows and joined on (artifact, node id), so a manifest with
    many nodes is not searched once per result.
    """
    return result_rows(artifacts, key, as_of, results).join(node_rows(artifacts, key, manifest), [key, "unique_id"], "left")


def matched_results(pairs: DataFrame, key: str, as_of: datetime | str, results: str = "run_results",
                    manifest: str = "manifest") -> DataFrame:
    """One row per result that has a node, of pairs whose two documents stand in one row.

    Results keyed by node id are zipped with the nodes, which looks up both sides by hash: nothing is
    shuffled, and a manifest is not searched once per result.
    """
    doc = pairs.select(key, F.from_json(results, RESULTS).alias("d"), F.from_json(manifest, MANIFEST).alias("m"))
    at = F.coalesce(parse_iso(F.col("d.metadata.generated_at")), instant(as_of))
    named = F.filter("d.results", lambda r: r["unique_id"].isNotNull())
    flat = doc.select(key, F.col("d.metadata.invocation_id").alias("invocation_id"), at.alias("at"), named.alias("r"),
                      F.transform(named, lambda r: r["unique_id"]).alias("ids"), known_nodes(F.col("m")).alias("nodes"))
    ids = F.array_distinct("ids")
    single = F.map_from_arrays("ids", F.transform("r", lambda r: F.array(r)))
    several = F.map_from_arrays(ids, F.transform(ids, lambda k: F.filter("r", lambda r: r["unique_id"] == k)))
    by_node = F.when(F.size(ids) == F.size("ids"), single).otherwise(several)
    fields = ("unique_id", "status", "execution_time", "message")
    met = F.map_zip_with(by_node, "nodes", lambda _, found, node: F.transform(found, lambda r: F.struct(*(r[f].alias(f) for f in fields), node.alias("node"))))
    rows = F.flatten(F.filter(F.map_values(met), lambda found: found.isNotNull()))
    return flat.select(key, "invocation_id", "at", F.inline(rows)).where(F.col("node").isNotNull())


def run_rows(joined: DataFrame) -> DataFrame:
    """Models, seeds and snapshots as orchestrator runs."""
    mine = joined.filter(F.col("node.resource_type").isin(*RUN_KINDS))
    return mine.select(
        F.lit("dbt_core").alias("orchestrator"), F.lit("dbt_run").alias("dag_id"),
        F.concat(F.lit("dbt_"), F.coalesce("invocation_id", F.lit("None")), F.lit("_"), "unique_id").alias("run_id"),
        F.when(F.col("status").isin(*GOOD), "success").otherwise("failed").alias("state"),
        F.col("at").alias("end_time"), F.coalesce("execution_time", F.lit(0.0)).alias("duration_seconds"))


def check_rows(joined: DataFrame) -> DataFrame:
    """Tests as check results, on the last part of the node they are attached to."""
    mine = joined.filter(F.col("node.resource_type") == "test")
    table = F.element_at(F.split(F.coalesce("node.attached_node", F.lit("unknown")), r"\."), -1)
    detail = F.to_json(F.struct(F.coalesce("message", F.lit("")).alias("error_message"),
                                F.coalesce("execution_time", F.lit(0.0)).alias("execution_time")))
    return mine.select(F.col("unique_id").alias("check_name"), table.alias("table_name"), F.lit("dbt_test").alias("check_type"),
                       F.coalesce(F.col("status").isin(*GOOD), F.lit(False)).alias("passed"), detail.alias("details"),
                       F.col("at").alias("executed_at"))
