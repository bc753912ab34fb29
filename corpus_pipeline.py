"""Corpus pipeline: quality rules, toxicity, near duplicates, packing. Each stage reads what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm import queries, toxicity
from tablewarden.llm.near_dedup import near_duplicates, text_key
from tablewarden.llm.packing import pack
from tablewarden.llm.repetition import repetition
from tablewarden.session import fresh_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition(docs, keep=COLUMNS[1:]).where("kept").select(COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic."""
    return toxicity.score(docs.select(COLUMNS), queries.toxicity_model(spark, sf_dir)).where("predicted = 0").select(COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest id, then of the smallest text hash.

    Ids may be null or repeat, so classes and rows are told apart by the keys of their texts. Texts without words
    are a class for each id; those without an id, too, all stay.
    """
    docs = docs.select(COLUMNS).withColumn("text_key", text_key(F.col("text")))
    wordless = F.col("text_key") == text_key(F.lit(""))
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).alias("own")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("x")
    kept = near_duplicates(docs, keys=True).groupBy("class_key", own).agg(first).select("x.doc_id", "x.text_key")
    same = F.expr("d.doc_id <=> k.doc_id and d.text_key = k.text_key")
    left = docs.where(~(F.col("doc_id").isNull() & wordless)).alias("d").join(kept.alias("k"), same, "left_semi")
    # rows of equal id and words: the least of them
    one = left.groupBy("doc_id", "text_key").agg(F.min(F.struct(COLUMNS[1:])).alias("x")).select("doc_id", "x.*")
    return one.unionByName(docs.where(F.col("doc_id").isNull() & wordless).select(COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("toxicity", clean), ("near_dedup", distinct), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
