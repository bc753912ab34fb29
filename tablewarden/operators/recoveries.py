"""When checks began to fail and when they recovered: a two-state machine over the results of each (table, check).

A run is a stretch of results of one outcome. A failed result after none or a passed one opens a failure, the next
passed one recovers it. Results are worked through in chunks of time (`plans.chunked`), so a check with a long history
is not one task. Ties in time go by id. Results without a time or outcome are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.times import seconds_between
from tablewarden.plans.chunked import with_last_marked, with_previous
from tablewarden.session import cut_lineage

KEYS = ("table_name", "check_name")


def runs(results: DataFrame, time_col: str = "executed_at", id_col: str = "id", passed: str = "passed", chunk: str = "day") -> DataFrame:
    """``table_name``, ``check_name``, ``passed``, ``began_at``, ``began_id``, ``last_at``, ``results``: one row per run."""
    slim = results.select(*KEYS, F.col(time_col).alias("at"), F.col(id_col).alias("id"), F.col(passed).alias("passed")).where("at is not null and passed is not null")
    part = F.date_trunc(chunk, "at")
    told = with_previous(slim, KEYS, part, ["at", "id"], F.col("passed"), "before")
    change = F.when(F.col("before").isNull() | (F.col("before") != F.col("passed")), F.struct("at", "id"))
    begun = with_last_marked(told, KEYS, part, ["at", "id"], change, "began")
    return begun.groupBy(*KEYS, "passed", "began").agg(F.max("at").alias("last_at"), F.count(F.lit(1)).alias("results")).select(
        *KEYS, "passed", F.col("began.at").alias("began_at"), F.col("began.id").alias("began_id"), "last_at", "results")


def events(results: DataFrame, time_col: str = "executed_at", id_col: str = "id", passed: str = "passed", chunk: str = "day") -> DataFrame:
    """``event`` (failed, recovered) with its time, id and, of a recovery, how long and how many results it took."""
    found = cut_lineage(runs(results, time_col, id_col, passed, chunk))
    before = with_previous(found, KEYS, F.date_trunc("month", "began_at"), ["began_at", "began_id"], F.struct("began_at", "results"), "before")
    told = before.where("not passed or before is not null")
    return told.select(*KEYS, F.when(F.col("passed"), "recovered").otherwise("failed").alias("event"), F.col("began_at").alias("at"), F.col("began_id").alias("id"),
                       F.when(F.col("passed"), F.col("before.began_at")).alias("failing_since"),
                       F.when(F.col("passed"), seconds_between(F.col("before.began_at"), F.col("began_at"))).alias("down_seconds"),
                       F.when(F.col("passed"), F.col("before.results")).alias("failed_results"))


def still_failing(results: DataFrame, **columns: str) -> DataFrame:
    """Checks whose last run is a failed one: since when, last result, number of failed results."""
    last = runs(results, **columns).groupBy(*KEYS).agg(F.max_by(F.struct("passed", "began_at", "last_at", "results"), F.struct("began_at", "began_id")).alias("r"))
    return last.where("not r.passed").select(*KEYS, F.col("r.began_at").alias("failing_since"), F.col("r.last_at").alias("last_at"), F.col("r.results").alias("failed_results"))
