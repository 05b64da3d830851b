"""Hard negatives through a vector-approximation file.

Each component of a vector is quantised into one of 256 cells of its dimension, a byte each. For a block of anchors, the
edges of a row's cells are looked up and give a lower and an upper bound of its score; only rows whose bounds let them into
an answer are read in full and scored exactly. Bounds hold for every row, so answers are exact whatever the cells are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gambrel.llm.common import materialise, quoted

#: Cells of a dimension.
CELLS = 256
#: Anchors whose bounds a task works out together, and rows at a time: two tables of 8 bytes a pair.
ANCHORS, ROWS = 1024, 1024


def prepared(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", label: Column | None = None, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, x): components as floor(scale * x), x as double.

    Rows with a null id, label or vector, or any null or non-finite component, and rows without the commonest number of
    components (of equals the largest), take no part. Repeated ids count once, with the least label, then the least vector.
    """
    x = F.transform(quoted(vector_col), lambda v: v.cast("double"))
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(scale * v))
    out = rows.select(quoted(id_col).cast("long").alias("vec_id"), (quoted(label_col) if label is None else label).cast("long").alias("label"), F.when(fit, whole).alias("x"))
    out = out.where("vec_id is not null and label is not null and x is not null and size(x) > 0")
    out = out.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")
    out = materialise(out, "vectors")
    size = out.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    return out.where(F.size("x") == (size[0]["size"] if size else 0))


def cell_edges(vectors: DataFrame) -> np.ndarray:
    """(dimensions, CELLS + 1): the first value of each cell and the first beyond the last, at quantiles of all rows."""
    cuts = [k / CELLS for k in range(1, CELLS)]
    by = vectors.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", cuts, 4 * CELLS).alias("cuts")).orderBy("d").collect()
    return np.array([[r.low, *r.cuts, r.high + 1] for r in by], np.int64)


def approximations(vectors: DataFrame, edges: np.ndarray) -> DataFrame:
    """(vec_id, label, cells): a byte for each component."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), len(edges))
            cells = np.stack([np.searchsorted(edges[d, 1:-1], x[:, d], "right") for d in range(len(edges))], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in cells], pa.binary())], names=["vec_id", "label", "cells"])

    return vectors.select("vec_id", "label", "x").mapInArrow(code, "vec_id long, label long, cells binary")


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


@dataclass(frozen=True)
class Block:
    """Anchors of a block: ids, labels, vectors; and the edges of cells. ``windows``: per anchor and positive the least and
    the largest score that a negative may have (nothing for a positive that is not there); ``floors``: scores that an answer
    has at least."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    edges: np.ndarray
    windows: np.ndarray | None = None
    floors: np.ndarray | None = None


def bounds(block: Block, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of rows with each anchor: (rows, anchors). A component's part is least at one
    edge of its cell and largest at the other, by the sign of the anchor's component."""
    d = np.arange(block.x.shape[1])
    low, high = block.edges[d, cells], block.edges[d, cells.astype(np.int64) + 1] - 1
    up, down = np.maximum(block.x, 0).astype(float).T, np.minimum(block.x, 0).astype(float).T
    low, high = low.astype(float), np.maximum(high, low).astype(float)
    return low @ up + high @ down, high @ up + low @ down


def _scan(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of slices of the approximations: ids, which pairs have equal labels, lower and upper bounds."""
    width = block.x.shape[1]
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            cells = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(-1, width)
            ids, labels = (part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            yield ids, labels[:, None] == block.labels[None], *bounds(block, cells)


def _best(kept: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest of each column of both."""
    both = np.concatenate([kept, values])
    return np.partition(both, len(both) - k, axis=0)[len(both) - k :] if len(both) > k else both


def _floors(approx: DataFrame, shared, k: int, sure: Callable) -> np.ndarray:
    """For each slot (anchor, or anchor and positive) the ``k``-th largest lower bound of rows that are surely answers, or
    minus infinity: at least k rows score as much. Tasks send k bounds a slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = shared.value, None
        for ids, same, low, high in _scan(batches, block):
            values = np.concatenate([np.where(m, low, -np.inf) for m in sure(block, ids, same, low, high)], axis=1)
            best = _best(np.full((k, values.shape[1]), -np.inf) if best is None else best, values, k)
        if best is not None:
            at = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays([pa.array(at[1], pa.int64()), pa.array(best[at], pa.float64())], names=["slot", "low"])

    first = Window.partitionBy("slot").orderBy(F.desc("low"))
    found = approx.mapInArrow(run, "slot long, low double").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k)
    rows = found.groupBy("slot").agg(F.min("low").alias("low"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("slot", "low").collect()
    block = shared.value
    slots = len(block.ids) * (1 if block.windows is None else block.windows.shape[1])
    out = np.full(slots, -np.inf)
    for r in rows:
        out[r.slot] = r.low
    return out


def _candidates(approx: DataFrame, vectors: DataFrame, anchors: DataFrame, shared, may: Callable) -> DataFrame:
    """(anchor_id, vec_id, score): exact scores of the pairs that ``may`` lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for ids, same, low, high in _scan(batches, block):
            at = np.nonzero(may(block, ids, same, low, high))
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[at[1]], pa.int64()), pa.array(ids[at[0]], pa.int64())], names=["anchor_id", "vec_id"])

    pairs = approx.mapInArrow(run, "anchor_id long, vec_id long")
    full = pairs.join(vectors.select("vec_id", "x"), "vec_id").join(anchors.select(F.col("vec_id").alias("anchor_id"), F.col("x").alias("a")), "anchor_id")
    return full.select("anchor_id", "vec_id", F.aggregate(F.zip_with("a", "x", lambda p, q: p * q), F.lit(0).cast("long"), lambda s, v: s + v).alias("score"))


def _block(spark: SparkSession, anchors: DataFrame, edges: np.ndarray) -> Block:
    rows = sorted(anchors.collect(), key=lambda r: r.vec_id)
    return Block(np.array([r.vec_id for r in rows], np.int64), np.array([r.label for r in rows], np.int64), np.array([r.x for r in rows], np.int64).reshape(len(rows), len(edges)), edges)


def _one_block(approx: DataFrame, vectors: DataFrame, anchors: DataFrame, edges: np.ndarray, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = vectors.sparkSession
    block = _block(spark, anchors, edges)
    share = lambda **more: spark.sparkContext.broadcast(Block(block.ids, block.labels, block.x, edges, **more))
    others = lambda b, ids, same, lo, hi: same & (ids[:, None] != b.ids[None])
    floors = _floors(approx, share(), positives, lambda b, ids, same, lo, hi: [others(b, ids, same, lo, hi)])
    near = _candidates(approx, vectors, anchors, share(floors=floors), lambda b, ids, same, lo, hi: others(b, ids, same, lo, hi) & (hi >= b.floors[None]))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    chosen = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"})
    chosen = materialise(chosen, "positives")
    # windows of scores by anchor and positive; an empty one lets nothing in
    at = {a: k for k, a in enumerate(block.ids.tolist())}
    windows = np.full((len(block.ids), positives, 2), [np.inf, -np.inf])
    for r in chosen.select("anchor_id", "place", "positive_score").collect():
        windows[at[r.anchor_id], r.place - 1] = r.positive_score * low / high, r.positive_score
    n = range(positives)
    # a hair of room for the division: candidates are judged again by whole numbers
    inside = lambda b, same, lo, hi, p: ~same & (lo >= b.windows[:, p, 0] + 1) & (hi <= b.windows[:, p, 1])
    floors = _floors(approx, share(windows=windows), negatives, lambda b, ids, same, lo, hi: [inside(b, same, lo, hi, p) for p in n]).reshape(positives, len(block.ids)).T

    def may(b: Block, ids, same, lo, hi) -> np.ndarray:
        some = np.zeros(same.shape, bool)
        for p in n:
            some |= (hi >= b.windows[:, p, 0] - 1) & (lo <= b.windows[:, p, 1]) & (hi >= b.floors[:, p])
        return some & ~same

    far = _candidates(approx, vectors, anchors, share(windows=windows, floors=floors), may)
    met = far.join(chosen.drop("place"), "anchor_id").where((low * F.col("positive_score") <= high * F.col("score")) & (F.col("score") <= F.col("positive_score")))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    out = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return materialise(out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``prepared`` vectors.

    Anchors are rows whose id is divisible by ``every``. Scores are inner products of whole numbers; larger ones come first,
    of equals the smaller id. An anchor's positives are its first other rows of the same label; a positive's negatives are
    its first rows of another label with low * positive <= high * negative <= high * positive. Fewer rows are all returned;
    an anchor without positives, and a positive without negatives (as one of a negative score), gives none.

    Anchors go through in blocks of about ANCHORS by a hash of their ids: a block, at most a few MB, is broadcast, and each
    pass over the approximations meets it with all rows. The driver holds one block, its positives' scores and its floors.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "label", "x")
    edges = cell_edges(vectors)
    kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    anchors = vectors.where(F.col("vec_id") % every == 0)
    count = anchors.count() if len(edges) else 0
    if not count:
        return spark.createDataFrame([], kinds)
    approx = materialise(approximations(vectors, edges), "approximations")
    blocks = -(-count // ANCHORS)
    out = None
    for k in range(blocks):
        some = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k) if blocks > 1 else anchors
        part = _one_block(approx, vectors, some, edges, positives, negatives, low, high)
        out = part if out is None else out.unionByName(part)
    return out
