"""Resolving a table reference to a DataFrame, and the cheap facts about a table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.session import small_frame

FILE_FORMATS = ("parquet", "orc", "json", "csv", "avro", "text")
TABLE_FORMATS = ("delta", "iceberg", "hudi")
# Warehouse kinds that are read over JDBC.
JDBC_KINDS = ("postgres", "mysql", "mariadb", "redshift", "snowflake", "trino", "databricks",
              "duckdb", "sqlserver", "oracle")


@dataclass(frozen=True)
class TableSpec:
    """Where a monitored table lives.

    ``kind`` is a file format, a lakehouse format, ``table`` (session catalog), a JDBC kind or
    any other registered Spark source. For JDBC give ``partition_column``, bounds and
    ``partitions`` so that the read is split over executors.
    """

    name: str
    kind: str = "parquet"
    location: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)
    schema: T.StructType | str | None = None
    partition_column: str | None = None
    lower_bound: str | int | None = None
    upper_bound: str | int | None = None
    partitions: int | None = None


def load(spark: SparkSession, spec: TableSpec) -> DataFrame:
    target = spec.location or spec.name
    if spec.kind == "table":
        return spark.table(target)
    reader = spark.read.options(**spec.options)
    if spec.kind in FILE_FORMATS or spec.kind in TABLE_FORMATS:
        if spec.schema is not None:
            reader = reader.schema(spec.schema)
        return reader.format(spec.kind).load(target)
    if spec.kind == "jdbc" or spec.kind in JDBC_KINDS:
        reader = reader.option("dbtable", spec.name)
        if spec.partition_column:
            reader = reader.options(partitionColumn=spec.partition_column,
                                    lowerBound=str(spec.lower_bound),
                                    upperBound=str(spec.upper_bound),
                                    numPartitions=str(spec.partitions))
        return reader.format("jdbc").load()
    return reader.format(spec.kind).load(target)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table; each branch reads no column at all."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n, df in tables.items()]
    return _union(parts)


def row_counts_from_statistics(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """COUNT(*) answered from Parquet footers.

    The count is pushed into the scan, which reads row-group statistics and no data pages; a
    source without statistics falls back to an ordinary scan by itself. Both settings are put
    back; plans keep the source version they were built with.
    """
    changed = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    saved = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        counts = row_counts({n: spark.read.parquet(p) for n, p in paths.items()})
        counts._jdf.queryExecution().executedPlan()
        return counts
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def max_timestamps(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    parts = [df.agg(F.max(c).cast("timestamp_ntz").alias("max_ts"))
             .select(F.lit(n).alias("table_name"), F.lit(c).alias("timestamp_column"), "max_ts")
             for n, (df, c) in tables.items()]
    return _union(parts)


def schema_rows(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Column lists from the analysed schema: 1-based ordinal, type name, nullability."""
    rows = [(n, f.name, f.dataType.simpleString(), f.nullable, i)
            for n, df in tables.items() for i, f in enumerate(df.schema.fields, start=1)]
    return small_frame(
        spark, rows, "table_name string, column_name string, data_type string, nullable boolean, ordinal_position int")


def run_sql(spark: SparkSession, query: str, tables: Mapping[str, DataFrame],
            args: Mapping[str, object] | None = None) -> DataFrame:
    """A user's SELECT with named parameters; tables are referred to as ``{name}``."""
    return spark.sql(query, args=dict(args or {}), **tables)


def file_stats(df: DataFrame) -> DataFrame:
    """Files, bytes and rows of a file-based table. Rows are first counted per file."""
    per_file = (df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"))
                .groupBy("p", "s").agg(F.count(F.lit(1)).alias("n")))
    return per_file.agg(F.count(F.lit(1)).alias("num_files"),
                        F.coalesce(F.sum("s"), F.lit(0)).alias("total_bytes"),
                        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
