"""Orchestrator runs: ingest of callbacks and API dumps, and the reports over run history."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.times import before, hour_start, parse_iso, seconds_between
from tablewarden.plans.newest import newest
from tablewarden.plans.quantiles import grouped_quantiles
from tablewarden.plans.recent import since

# Callback shapes and the state names of one orchestrator.
AIRFLOW = "struct<dag_id:string,run_id:string,state:string,start_date:string,end_date:string,duration:double>"
PREFECT = "struct<flow_name:string,flow_run_id:string,state:string,start_time:string,end_time:string,total_run_time:double>"
PREFECT_STATES = {"Completed": "success", "Failed": "failed", "Running": "running"}
AIRFLOW_DUMP = "struct<dag_runs:array<struct<dag_id:string,dag_run_id:string,state:string,start_date:string,end_date:string>>>"
PREFECT_DUMP = "array<struct<id:string,name:string,state_type:string,start_time:string,end_time:string,total_run_time:double>>"
TASK_DUMP = ("struct<task_instances:array<struct<task_id:string,state:string,start_date:string,end_date:string,"
             "duration:double,try_number:int>>>")
UNKNOWN = "unknown"


def _or_unknown(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(UNKNOWN))


def readable(body: str) -> Column:
    """Is the text one JSON object? A text that is none would be read as a document of NULLs."""
    return F.coalesce(F.try_parse_json(F.col(body)).isNotNull() & F.ltrim(F.col(body)).startswith("{"), F.lit(False))


def unreadable(callbacks: DataFrame, body: str = "body") -> DataFrame:
    """The callbacks that give no run: NULL, broken JSON, or JSON that is no object."""
    return callbacks.filter(~readable(body))


def from_airflow(callbacks: DataFrame, body: str = "body") -> DataFrame:
    """Callback documents to runs; unreadable ones (see `unreadable`) give none, absent ids become ``unknown``."""
    d = callbacks.filter(readable(body)).withColumn("d", F.from_json(body, AIRFLOW))
    return d.select(*[c for c in callbacks.columns if c != body], F.lit("airflow").alias("orchestrator"),
                    _or_unknown("d.dag_id").alias("dag_id"), _or_unknown("d.run_id").alias("run_id"),
                    _or_unknown("d.state").alias("state"), parse_iso(F.col("d.start_date")).alias("start_time"),
                    parse_iso(F.col("d.end_date")).alias("end_time"), F.col("d.duration").alias("duration_seconds"))


def from_prefect(callbacks: DataFrame, body: str = "body") -> DataFrame:
    d = callbacks.filter(readable(body)).withColumn("d", F.from_json(body, PREFECT))
    state = _or_unknown("d.state")
    for theirs, ours in PREFECT_STATES.items():
        state = F.when(F.col("d.state") == theirs, ours).otherwise(state)
    return d.select(*[c for c in callbacks.columns if c != body], F.lit("prefect").alias("orchestrator"),
                    _or_unknown("d.flow_name").alias("dag_id"), _or_unknown("d.flow_run_id").alias("run_id"),
                    state.alias("state"), parse_iso(F.col("d.start_time")).alias("start_time"),
                    parse_iso(F.col("d.end_time")).alias("end_time"), F.col("d.total_run_time").alias("duration_seconds"))


def from_airflow_dump(dumps: DataFrame, body: str = "body") -> DataFrame:
    """Run lists of the API; the duration is taken from start and end."""
    r = dumps.select(F.explode(F.from_json(body, AIRFLOW_DUMP)["dag_runs"]).alias("r"))
    start, end = parse_iso(F.col("r.start_date")), parse_iso(F.col("r.end_date"))
    return r.select(F.col("r.dag_id").alias("dag_id"), F.col("r.dag_run_id").alias("run_id"), F.col("r.state").alias("state"),
                    start.alias("start_time"), end.alias("end_time"), seconds_between(start, end).alias("duration_seconds"))


def from_prefect_dump(dumps: DataFrame, flow: Column, body: str = "body") -> DataFrame:
    """Flow-run lists carry no flow name, so ``flow`` gives it."""
    r = dumps.select(flow.alias("dag_id"), F.explode(F.from_json(body, PREFECT_DUMP)).alias("r"))
    return r.select("dag_id", F.col("r.id").alias("run_id"), _or_unknown("r.state_type").alias("state"),
                    parse_iso(F.col("r.start_time")).alias("start_time"), parse_iso(F.col("r.end_time")).alias("end_time"),
                    F.col("r.total_run_time").alias("duration_seconds"))


def task_instances(dumps: DataFrame, body: str = "body") -> DataFrame:
    t = dumps.select(F.explode(F.from_json(body, TASK_DUMP)["task_instances"]).alias("t"))
    return t.select("t.task_id", "t.state", parse_iso(F.col("t.start_date")).alias("start_time"),
                    parse_iso(F.col("t.end_date")).alias("end_time"), F.col("t.duration").alias("duration_seconds"),
                    F.coalesce("t.try_number", F.lit(1)).alias("try_number"))


def listing(history: DataFrame, orchestrator: str | None = None, dag_id: str | None = None,
            state: str | None = None, limit: int = 50) -> DataFrame:
    where = F.lit(True)
    for column, wanted in (("orchestrator", orchestrator), ("dag_id", dag_id), ("state", state)):
        if wanted is not None:
            where = where & (F.col(column) == wanted)
    return newest(history, "recorded_at", limit, where)


def success_rate(history: DataFrame, as_of: datetime | str, days: int = 7) -> DataFrame:
    """Successful share of all runs recorded in the last days, in percent."""
    recent = since(history, "recorded_at", before(as_of, days * 86_400))
    won, all_ = F.count_if(F.col("state") == "success"), F.count(F.lit(1))
    return recent.agg(all_.alias("runs"), won.alias("successes"), F.try_divide(won * 100.0, all_).alias("success_rate"))


def duration_quantiles(history: DataFrame, bucket_width: float = 1.0) -> DataFrame:
    timed = history.withColumn("hour", hour_start(F.col("start_time")))
    return grouped_quantiles(timed, ["hour"], F.col("duration_seconds"), {"p50": 0.5, "p95": 0.95}, bucket_width)


def by_state(history: DataFrame) -> DataFrame:
    return history.groupBy("state").agg(F.count(F.lit(1)).alias("runs"))


def failures_by_hour(history: DataFrame) -> DataFrame:
    return history.filter(F.col("state") == "failed").groupBy("dag_id", F.hour("start_time").alias("hour")).agg(
        F.count(F.lit(1)).alias("failures"))


def sla_misses(history: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """Runs longer than the limit of their dag; dags without a limit are not reported."""
    allowed = F.create_map(*[F.lit(x) for pair in limits.items() for x in (pair[0], float(pair[1]))])
    return (history.filter(F.col("dag_id").isin(*limits)).groupBy("dag_id").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("duration_seconds") > F.element_at(allowed, F.col("dag_id"))).alias("sla_misses")))
