"""Helpers that the corpus operators share: the shared folder, Arrow row maps and skew-proof ranks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gambrel.shared import materialise, scratch, shared_dir

__all__ = ["bin_of", "bin_offsets", "bounded", "byte_slices", "give_back", "map_rows", "materialise", "quoted", "scratch", "shared_dir", "shut", "text_of", "without"]

#: Rows, and bytes of their longest column, that an Arrow map turns into Python objects at a time.
SLICE_ROWS, SLICE_BYTES = 256, 2 << 20
#: Bytes of a batch on its way to Python.
BATCH_BYTES = 8 << 20
#: Bins that split the rows of any one key; a third of 10^10 rows makes under a million rows a bin.
RANK_BINS = 4096


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, names) -> DataFrame:
    """``df`` less the columns that an operator is about to add; names compare as Spark does, ignoring case."""
    gone = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in gone])


def shut(df: DataFrame) -> DataFrame:
    """``df`` with all of a row once more in one column ``row``, which no name in it can clash with.

    A column of that name is in the struct alone; refer to it as ``row.row``.
    """
    return df.select(F.struct(*map(quoted, df.columns)).alias("row"), *[quoted(c) for c in df.columns if c.lower() != "row"])


def bounded(spark: SparkSession) -> SparkSession:
    """Keep batches of texts on their way to Python at BATCH_BYTES or a row, which bounds a worker's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, str(BATCH_BYTES))
    return spark


def give_back() -> None:
    """Hand freed memory back to the system. Idle workers live on beside the stages that follow, with all that they keep."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def byte_slices(batches: Iterator[pa.RecordBatch], col: int, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of at most ``rows`` rows whose column ``col`` holds at most ``size`` bytes, or one row.

    Behind the last slice a worker gives back what its task has freed.
    """
    batch = None
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(lengths, dtype=np.int64), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, to - at)
            at = to
    del batch
    give_back()


def map_rows(df: DataFrame, fields: StructType, start: Callable[[], Callable[[pa.RecordBatch], list]], longest: str) -> DataFrame:
    """Add ``fields`` to every row. ``start()`` runs once a task and gives a function from a slice to the new arrays.

    ``longest``: the column of texts whose bytes bound a slice.
    """
    base = without(df, fields.names)
    schema, names = StructType([*base.schema.fields, *fields.fields]), [*base.columns, *fields.names]
    at = base.columns.index(longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for part in byte_slices(batches, at):
            yield pa.RecordBatch.from_arrays([*part.columns, *work(part)], names=names)

    return base.mapInArrow(run, schema)


def text_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a column, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def bin_of(*cols: Column, bins: int = RANK_BINS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(bins)).cast("int")


def bin_offsets(df: DataFrame, keys: list[str], bin_col: str, count: str = "bin_n", before: str = "bin_before") -> DataFrame:
    """Per (keys, bin): its rows, and the rows of the same keys in lower bins. Windows see one row a bin, never the rows."""
    counts = df.groupBy(*keys, bin_col).agg(F.count(F.lit(1)).alias(count))
    w = Window.partitionBy(*keys).orderBy(bin_col) if keys else Window.partitionBy(F.lit(0)).orderBy(bin_col)
    return counts.withColumn(before, F.sum(count).over(w) - F.col(count))
