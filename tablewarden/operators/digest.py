"""Weekly digest: what every pillar saw, by table and week, with totals, from one aggregate."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The pillars' histories, the time of a record and what makes it a bad one.
PILLARS = {"freshness": ("checked_at", "status <> 'ok'"), "volume": ("recorded_at", "is_anomaly"), "quality": ("executed_at", "NOT passed"),
           "contracts": ("validated_at", "NOT passed"), "arrival": ("checked_at", "status <> 'ok'")}


def week_start(ts: Column) -> Column:
    """Monday, 00:00."""
    return F.date_trunc("week", ts).cast("timestamp_ntz")


def weekly(histories: Mapping[str, DataFrame]) -> DataFrame:
    """``pillar``, ``table_name``, ``week``, ``records``, ``bad``, ``last_bad_at``, ``level``.

    Levels: ``table`` (pillar, table, week), ``pillar`` (pillar, week), ``week`` (all pillars). Records without a time
    are in no week and left out; a NULL outcome is not bad. The histories are stacked and grouped once; partial counts
    are made where the rows lie.
    """
    parts = []
    for pillar, rows in histories.items():
        at, bad = PILLARS[pillar]
        parts.append(rows.where(F.col(at).isNotNull()).select(F.lit(pillar).alias("pillar"), F.coalesce("table_name", F.lit("")).alias("table_name"),
                                                              week_start(F.col(at)).alias("week"), F.col(at).alias("at"), F.coalesce(F.expr(bad), F.lit(False)).alias("bad")))
    stacked = reduce(DataFrame.unionByName, parts)
    columns = [F.col(c) for c in ("pillar", "table_name", "week")]
    sets = [columns, [columns[0], columns[2]], [columns[2]]]
    counted = stacked.groupingSets(sets, *columns).agg(F.count(F.lit(1)).alias("records"), F.count_if("bad").alias("bad"),
                                                       F.max(F.when(F.col("bad"), F.col("at"))).alias("last_bad_at"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 0, "table").when(F.col("g") == 2, "pillar").otherwise("week")
    return counted.select("pillar", "table_name", "week", "records", "bad", "last_bad_at", level.alias("level"))
