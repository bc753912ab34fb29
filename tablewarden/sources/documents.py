"""JSON documents held one per row in a text column (files read whole, or a stream of messages)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCAN_CHECK = "array<struct<name:string,outcome:string,table:string,measured_value:double,definition:string>>"


def read_documents(spark: SparkSession, path: str, suffix: str = "*.json") -> DataFrame:
    """Whole files as rows, with the file's path and modification time."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=suffix)
    return files.select(F.col("value").alias("body"), F.col("_metadata.file_path").alias("path"),
                        F.col("_metadata.file_modification_time").alias("modified_at"))


def newer_than(documents: DataFrame, last_seen: Column) -> DataFrame:
    """Documents modified after the newest one already processed."""
    return documents.filter(F.col("modified_at") > last_seen)


def scan_results(documents: DataFrame, body: str = "body") -> DataFrame:
    """Results of an external scan: ``{"checks": [...]}`` or a bare array, one row per check.

    A document without readable JSON yields one failed ``scan`` row.
    """
    text = F.trim(F.col(body))
    wrapped = F.when(text.startswith("["), F.concat(F.lit('{"checks":'), text, F.lit("}"))).when(text.startswith("{"), text)
    doc = F.from_json(wrapped, f"struct<checks:{SCAN_CHECK},_corrupt_record:string>")
    read = documents.withColumn("d", doc)
    readable = F.col("d").isNotNull() & F.col("d._corrupt_record").isNull()
    unreadable = F.array(F.struct(
        F.lit("scan").alias("name"), F.lit("fail").alias("outcome"), F.lit("unknown").alias("table"),
        F.lit(None).cast("double").alias("measured_value"),
        F.lit("no structured output").alias("definition")))
    empty = F.array().cast(SCAN_CHECK)
    checks = F.when(readable, F.coalesce("d.checks", empty)).otherwise(unreadable)
    found = read.withColumn("c", F.explode(checks))
    keep = [c for c in documents.columns if c != body]
    return found.select(
        *keep,
        F.coalesce("c.name", F.lit("unnamed")).alias("check_name"),
        F.coalesce("c.table", F.lit("unknown")).alias("table_name"),
        (F.lower(F.coalesce("c.outcome", F.lit("fail"))) == "pass").alias("passed"),
        F.col("c.measured_value").alias("metric_value"),
        F.coalesce("c.definition", F.lit("")).alias("details"))
