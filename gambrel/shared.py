"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``. Where that is unset a temporary folder will do for a local session; on a cluster it would
    be of one machine only, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gambrel-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gambrel/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, keeps column pruning."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``materialise``, to be joined by shuffles: Spark takes the files' bytes for the table's size, but runs, labels and paths
    pack so well that it would send large tables to the driver."""
    return materialise(df, name).hint("merge")


def partitions(df: DataFrame) -> int:
    """The number of partitions of a shuffle, to be asked for where rows are few but their work is not."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def beginnings(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Of rows in the order of their keys, whether each begins a group."""
    out = np.zeros(table.num_rows, bool)
    out[:1] = True
    for c in keys:
        column = table.column(c).combine_chunks()
        for part in column.flatten() if pa.types.is_struct(column.type) else [column]:
            plain = pa.types.is_integer(part.type) and not part.null_count
            codes = (part if plain else part.dictionary_encode().indices.fill_null(-1)).to_numpy(zero_copy_only=False)
            out[1:] |= codes[1:] != codes[:-1]
    return out


def by_groups(rows: DataFrame, keys: list[str], order: list[str], one: Callable, schema, begins: Callable | None = None, spread: bool = False) -> DataFrame:
    """Rows group by group where groups are many and small: ``one`` takes a table of whole groups, by keys and ``order``, and
    the places where they begin, and gives a table of ``schema``. A task reads its groups in order and calls it once a batch, not
    once a group; of a group that is longer than a batch it holds the rows so far. ``begins`` cuts finer than the keys do.

    Rows are dealt by a hash of the keys, not by the keys: where a join has just dealt them by the same keys, Spark drops the
    second shuffle, and then, if the join turns into a broadcast, the first one's order too, and groups would be torn apart.
    ``spread`` asks for all partitions of a shuffle, for groups that are few bytes but much work.
    """
    begins = begins or (lambda table: beginnings(table, keys))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last group may go on in the next batch
            seam = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            at = np.flatnonzero(begins(pa.Table.from_batches([*seam, batch]))[len(seam) :])
            if len(at) and (held or at[-1]):
                before = sum(b.num_rows for b in held)
                whole = pa.Table.from_batches([*held, batch.slice(0, at[-1])]).combine_chunks()
                yield from one(whole, np.concatenate([[0], at[:-1] + before]) if held and (before + at[0]) else at[:-1]).to_batches()
                held = []
            held.append(batch.slice(at[-1]) if len(at) else batch)
        if held:
            yield from one(pa.Table.from_batches(held).combine_chunks(), np.zeros(1, np.int64)).to_batches()

    dealt = [F.xxhash64(F.lit("groups"), *keys)]
    return rows.repartition(*([partitions(rows)] if spread else []), *dealt).sortWithinPartitions(*keys, *order).mapInArrow(each, schema)
