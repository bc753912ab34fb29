"""Incidents: alerts that belong together in time and along lineage.

Alerts of one table that follow each other within a gap are a session. Sessions of tables that lineage links
directly, in either direction, are joined if they are no more than the gap apart. An incident is a connected
component of sessions; every alert is in exactly one.

Alerts are first counted per table and gap-wide bucket: rows of one bucket are always in one session, so a table that
raises millions of alerts is as many rows as its history has buckets. Sessions, links and components are worked out on
those. Alerts without a table form sessions among themselves and are linked to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.functions.times import duration_seconds, micros
from tablewarden.plans.components import components
from tablewarden.session import cut_lineage

# Weight of a severity; others weigh nothing.
SEVERITY_WEIGHT = {"fail": 2, "warn": 1}


def bucket(at: Column, gap: int) -> Column:
    return F.floor(at / F.lit(gap)).cast("long")


def sessions(alerts: DataFrame, gap: int, time_col: str = "raised_at") -> DataFrame:
    """One row per table and bucket with its ``session`` (a number), bounds of the bucket's and the session's alerts."""
    at = micros(F.col(time_col))
    cells = alerts.groupBy("table_name", bucket(at, gap).alias("cell")).agg(
        F.min(at).alias("cell_first"), F.max(at).alias("cell_last"), F.min("id").alias("least_id"))
    in_order = Window.partitionBy("table_name").orderBy("cell")
    begins = F.coalesce(F.col("cell_first") - F.lag("cell_last").over(in_order) > gap, F.lit(True))
    numbered = cells.withColumn("begins", begins).withColumn("first", F.last(F.when(F.col("begins"), F.col("cell_first")), ignorenulls=True).over(
        in_order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("table_name", "first").agg(F.max("cell_last").alias("last"), F.min("least_id").alias("session_least_id"))
    named = cut_lineage(whole.withColumn("session", F.monotonically_increasing_id()))
    same = F.col("c.table_name").eqNullSafe(F.col("s.table_name")) & (F.col("c.first") == F.col("s.first"))
    return cut_lineage(numbered.alias("c").join(named.alias("s"), same).select("c.table_name", "cell", "s.session", "s.first", "s.last", "session_least_id"))


def links(found: DataFrame, edges: DataFrame, gap: int) -> DataFrame:
    """Pairs of sessions ``a``, ``b`` that an edge joins and that are no more than ``gap`` apart.

    [first, last + gap] of the two meet if and only if they are that near, and then they share a bucket: a plain
    equality join, checked afterwards. A session has as many buckets as it is long.
    """
    whole = found.where(F.col("table_name").isNotNull()).groupBy("table_name", "session").agg(F.first("first").alias("first"), F.first("last").alias("last"))
    spread = whole.withColumn("cell", F.explode(F.sequence(bucket(F.col("first"), gap), bucket(F.col("last") + gap, gap))))
    pairs = edges.select("table_name", "downstream").where("table_name is not null and downstream is not null and table_name <> downstream").distinct()
    upper = spread.join(pairs, "table_name").select(F.col("session").alias("a"), F.col("first").alias("a_first"), F.col("last").alias("a_last"), "cell", F.col("downstream").alias("table_name"))
    near = (F.col("a_first") <= F.col("last") + gap) & (F.col("first") <= F.col("a_last") + gap)
    return upper.join(spread, ["table_name", "cell"]).where(near).select("a", F.col("session").alias("b")).distinct()


def group_alerts(alerts: DataFrame, edges: DataFrame, gap: str | float = "30m", time_col: str = "raised_at") -> DataFrame:
    """The alerts with ``incident_id``, the least alert id of their incident.

    ``alerts`` has ``id`` (not null), ``table_name`` and a time; rows without a time are left out, since no incident
    can hold them. ``edges`` has ``table_name`` and ``downstream``; cycles and repeats do no harm.
    """
    width = int(duration_seconds(gap) * 1_000_000)
    timed = alerts.where(F.col(time_col).isNotNull())
    found = sessions(timed, width, time_col)
    grouped = components(links(found, edges, width)).withColumnRenamed("node", "session")
    least = found.join(grouped, "session", "left").withColumn("component", F.coalesce("component", "session"))
    named = cut_lineage(least.groupBy("component").agg(F.min("session_least_id").alias("incident_id")))
    cells = cut_lineage(least.join(named, "component").select("table_name", "cell", "incident_id"))
    same = F.col("l.table_name").eqNullSafe(F.col("r.table_name")) & (bucket(micros(F.col(f"l.{time_col}")), width) == F.col("r.cell"))
    return timed.alias("l").join(cells.alias("r"), same).select("l.*", "r.incident_id")


def summarise(grouped: DataFrame, edges: DataFrame, time_col: str = "raised_at") -> DataFrame:
    """One row per incident: bounds, counts, worst severity, and its tables without an alerting table above them.

    Tables are first reduced to one row per incident and table, so an incident's lists are as long as it has tables.
    """
    weight = F.coalesce(F.create_map(*[x for k, v in SEVERITY_WEIGHT.items() for x in (F.lit(k), F.lit(v))])[F.col("severity")], F.lit(0))
    by_table = grouped.groupBy("incident_id", "table_name").agg(
        F.min(time_col).alias("first"), F.max(time_col).alias("last"), F.count(F.lit(1)).alias("n"), F.max(weight).alias("weight"))
    own = by_table.where(F.col("table_name").isNotNull()).select("incident_id", "table_name")
    pairs = edges.select(F.col("table_name").alias("upper"), F.col("downstream").alias("table_name")).where("upper <> table_name").distinct()
    below = own.join(pairs, "table_name").join(own.withColumnRenamed("table_name", "upper"), ["incident_id", "upper"]).select("incident_id", "table_name").distinct()
    marked = by_table.join(below.withColumn("is_below", F.lit(True)), ["incident_id", "table_name"], "left")
    return marked.groupBy("incident_id").agg(
        F.min("first").alias("started_at"), F.max("last").alias("ended_at"), F.sum("n").alias("alerts"), F.count("table_name").alias("tables"),
        F.max("weight").alias("weight"), F.array_sort(F.collect_list(F.when(F.col("is_below").isNull(), F.col("table_name")))).alias("roots")).withColumn(
        "severity", F.when(F.col("weight") == 2, "fail").when(F.col("weight") == 1, "warn").otherwise("info")).drop("weight")
