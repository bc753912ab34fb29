"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Settings a monitoring session is expected to run with. None of them changes a
# result; they let Spark re-plan joins and partition counts from runtime sizes.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, app: str = "tablewarden", **extra: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for key, value in {**RECOMMENDED_CONF, **extra}.items():
        b = b.config(key, value)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only when neither the configuration nor the context names one (single-machine
    tests) is a fresh local folder made and set.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if folder:
        if current is None:
            sc.setCheckpointDir(folder)
        return folder
    if current is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        current = sc.getCheckpointDir()
    return current


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and go on from there.

    What follows does not repeat the work that made ``df``, a lost executor reads the files
    again, and the optimizer knows the size.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few rows of configuration or scalars as a local relation (no tasks, known size)."""
    declared = T.StructType.fromDDL(ddl)
    columns = list(zip(*rows)) if rows else [[] for _ in declared.fields]
    arrow = pa.table({f.name: pa.array(list(c), type=to_arrow_type(f.dataType))
                      for f, c in zip(declared.fields, columns)})
    return spark.createDataFrame(arrow, schema=declared)
