"""Token counts through a digest cache.

The cache is a Parquet table of (tokenizer digest, content digest, n_tokens). Documents' digests are joined to it; texts
are encoded once for each distinct digest that it lacks, and those counts are appended.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gambrel.llm.common import map_rows, quoted, text_of, without
from gambrel.llm.encoding import encoder

CACHE = "tokenizer string, digest binary, n_tokens long"
ADDED = ("n_bytes", "n_tokens", "over_limit")


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text: Column) -> Column:
    """Runs of plain white space as one space, none at the ends: the same tokens, for tokenizers that drop white space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r]+", " "))


def count_with_sentencepiece(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda text: len(model.encode(text))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit to every document; append the counts of new texts to ``cache``.

    Null texts count as empty. Repeated rows and copies share one digest and are encoded once. The cache folder may be
    missing or hold other tokenizers' counts, and doubled entries (two jobs that met) do no harm. Input columns named
    like an added one are replaced. ``tokenizer`` is a .json or .model file; white space is normalised for .json files of
    the kind that drops it, and a .model file's texts are digested as they are.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    pieces = tokenizer.endswith(".model")
    text = quoted(text_col)
    content = F.coalesce(text, F.lit("")) if pieces else normalised(text)
    keyed = without(docs, [*ADDED, "__content", "__digest"]).withColumn("__content", content)
    keyed = keyed.withColumn("__digest", F.unhex(F.sha2("__content", 256)))
    try:
        stored = spark.read.schema(CACHE).parquet(cache)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], CACHE)
    known = stored.where(F.col("tokenizer") == version).groupBy(F.col("digest").alias("__digest")).agg(F.max("n_tokens").alias("__known"))
    distinct = keyed.groupBy("__digest").agg(F.first("__content").alias("__content"))
    missing = distinct.join(known, "__digest", "left_anti")

    def start():
        count = count_with_sentencepiece(tokenizer) if pieces else encoder(tokenizer).count

        def work(batch: pa.RecordBatch) -> list:
            return [pa.array([count(t) for t in text_of(batch, "__content")], pa.int64())]

        return work

    counted = map_rows(missing, StructType([StructField("__n", LongType())]), start, "__content")
    counted.select(F.lit(version).alias("tokenizer"), F.col("__digest").alias("digest"), F.col("__n").alias("n_tokens")).write.mode("append").parquet(cache)
    full = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy(F.col("digest").alias("__digest")).agg(F.max("n_tokens").alias("n_tokens"))
    sized = keyed.withColumn("n_bytes", F.octet_length(F.coalesce(text, F.lit(""))).cast("long")).drop("__content")
    out = sized.join(full, "__digest", "left").withColumn("over_limit", F.col("n_tokens") > limit)
    return out.select(*[quoted(c) for c in sized.columns if c not in ("__digest",)], "n_tokens", "over_limit")
