"""A corpus pipeline: judge quality, drop near-duplicates, drop contaminated documents, redact personal data, pack.

Each stage takes (spark, docs, sf_dir) and gets what the stage before it kept, from Parquet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gambrel.llm.common import bounded, materialise
from gambrel.llm.decontamination import decontaminate
from gambrel.llm.near_dedup import deduplicate
from gambrel.llm.packing import pack
from gambrel.llm.pii import redact
from gambrel.llm.quality_rules import keep_good
from gambrel.llm.queries import table, tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    bounded(spark)
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    bounded(spark)
    return deduplicate(docs).select(docs.columns)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too much of a benchmark item go."""
    bounded(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data in their texts is replaced by its kind, and n_chars follows."""
    bounded(spark)
    return redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 1024 ids."""
    bounded(spark)
    return pack(docs, tokenizer("byte_bpe_50k.json"), end_id=0, size=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("decontamination", contamination),
    ("pii", personal_data),
    ("packing", packed),
]

#: SQL expresses neither the fitted rules nor the signatures; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
