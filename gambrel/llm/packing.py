"""Bounded-space online packing of token ids into windows of fixed size.

Each partition keeps a fixed number of open windows. A document's full windows leave at once; its rest goes where it fits
best. When it fits nowhere and no window may be opened, the fullest leaves, first topped up with a cut of that rest where
the gap is worth a piece. What is open at a partition's end is merged at the end, over groups of partitions.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gambrel.llm.common import byte_slices, materialise, quoted
from gambrel.llm.encoding import encoder, widen

#: Partitions whose open windows one merge task takes; times the open windows, a bound on its rows' windows.
MERGE_PARTS = 64
#: Rows, of 16 bytes, of the numbering of partitions and merge groups that may be broadcast.
SMALL = 200_000
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, part int, window long, piece int, offset long, open boolean"
MOVES = "part int, window long, piece int, cut long, take long, merged_group int, merged long, merged_offset long"


class Packer:
    """The open windows of one partition. A piece is (doc, start, ids, doc_tokens).

    Held pieces are copies: a view would keep all ids of its document for as long as the window is open.
    """

    def __init__(self, size: int, windows: int, least: int):
        self.size, self.windows, self.least = size, windows, least
        self.gaps: list[int] = []
        self.held: list[list] = []
        self.closed = 0

    def _leave(self, k: int, still_open: bool = False) -> Iterator[tuple]:
        pieces, at = self.held.pop(k), 0
        self.gaps.pop(k)
        for n, (doc, start, ids, total) in enumerate(pieces):
            yield doc, start, len(ids), ids, total, self.closed, n, at, still_open
            at += len(ids)
        self.closed += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        total, at = len(ids), 0
        while total - at >= self.size:
            yield doc, at, self.size, ids[at : at + self.size], total, self.closed, 0, 0, False
            self.closed += 1
            at += self.size
        while at < total:
            rest = total - at
            k = min((k for k, g in enumerate(self.gaps) if g >= rest), key=self.gaps.__getitem__, default=-1)
            if k < 0 and len(self.gaps) == self.windows:
                full = min(range(len(self.gaps)), key=self.gaps.__getitem__)
                if self.gaps[full] >= self.least and rest - self.gaps[full] >= self.least:
                    self.held[full].append((doc, at, ids[at : at + self.gaps[full]].copy(), total))
                    at += self.gaps[full]
                yield from self._leave(full)
                continue
            if k < 0:
                self.gaps.append(self.size)
                self.held.append([])
                k = len(self.gaps) - 1
            self.held[k].append((doc, at, ids[at:].copy(), total))
            self.gaps[k] -= rest
            if not self.gaps[k]:
                yield from self._leave(k)
            break

    def end(self) -> Iterator[tuple]:
        while self.gaps:
            yield from self._leave(len(self.gaps) - 1, True)


def merge_windows(pieces: list[tuple[tuple, int]], size: int, least: int) -> list[tuple[tuple, int, int, int, int]]:
    """Refill windows. ``pieces``: ((part, window, piece), length). Gives (key, cut, take, merged, offset).

    The fullest windows stay; the emptiest are taken apart to fill their gaps, best fit first, cut where nothing fits.
    """
    windows: dict[tuple, list] = {}
    for key, length in sorted(pieces):
        windows.setdefault(key[:2], []).append((length, key, 0))
    order = sorted(windows.values(), key=lambda w: (-sum(p[0] for p in w), w[0][1]))
    pool: list[tuple] = []
    out, merged, low, high = [], 0, 0, len(order) - 1
    while low <= high or pool:
        now, low = (order[low], low + 1) if low <= high else ([], low)
        at = 0
        for length, key, cut in now:
            out.append((key, cut, length, merged, at))
            at += length
        while at < size:
            fits = bisect_right(pool, (size - at, ((1 << 62),) * 3, 1 << 62))
            if fits:
                length, key, cut = pool.pop(fits - 1)
            elif pool and size - at >= least and pool[-1][0] - (size - at) >= least:
                whole, key, cut = pool.pop()
                length = size - at
                insort(pool, (whole - length, key, cut + length))
            elif low <= high and not pool:
                for p in order[high]:
                    insort(pool, p)
                high -= 1
                continue
            else:
                break
            out.append((key, cut, length, merged, at))
            at += length
        merged += 1
    return out


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 1024, windows: int = 64, least: int = 32, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pack every document's ids, with ``end_id`` behind them, into sequences of at most ``size`` ids.

    Returns a row a piece: doc_id, start (its document's ids before it), length, ids (binary, little-endian unsigned
    32-bit), doc_tokens, sequence_id (gapless from 0) and offset in the sequence. Null texts are empty: their end id alone
    is packed. Null ids and repeated rows are packed like others. An empty table gives no pieces. Other columns are not
    returned. Pieces are written once to the shared folder, so sequences stay as they are when executors are lost.
    ``windows`` bounds what a task holds; ``least`` is the shortest piece made by a cut that only avoids padding.
    """
    spark = docs.sparkSession

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        packer, part = Packer(size, windows, least), TaskContext.get().partitionId()

        def made(rows: list[tuple]) -> pa.RecordBatch:
            doc, at, n, ids, total, window, piece, offset, is_open = zip(*rows)
            i64 = pa.int64()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, i64),
                    pa.array(at, i64),
                    pa.array(n, i64),
                    pa.array([x.tobytes() for x in ids], pa.binary()),
                    pa.array(total, i64),
                    pa.array([part] * len(rows), pa.int32()),
                    pa.array(window, i64),
                    pa.array(piece, pa.int32()),
                    pa.array(offset, i64),
                    pa.array(is_open, pa.bool_()),
                ],
                names=[f.split()[0] for f in PIECES.split(", ")],
            )

        for some in byte_slices(batches, 1):
            rows = []
            for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                rows += packer.add(doc, widen(enc.encode(text or "") + end, enc.width))
            if rows:
                yield made(rows)
        if rows := list(packer.end()):
            yield made(rows)

    pieces = docs.select(quoted(id_col).cast("long"), quoted(text_col)).mapInArrow(start, PIECES)
    pieces = materialise(pieces, "packing")
    done, left = pieces.where(~F.col("open")), pieces.where("open")

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        rows = merge_windows([((p, w, n), k) for p, w, n, k in zip(frame.part, frame.window, frame.piece, frame.length)], size, least)
        group = int(frame.part.iloc[0]) // MERGE_PARTS
        return pd.DataFrame([(*key, cut, take, group, merged, at) for key, cut, take, merged, at in rows], columns=[f.split()[0] for f in MOVES.split(", ")])

    moves = materialise(left.select("part", "window", "piece", "length").groupBy(F.expr(f"part div {MERGE_PARTS}")).applyInPandas(merge, MOVES), "packing-moves")

    # One row a partition and a merge group: how many sequences come before theirs.
    base, bases = 0, []
    for kind, counts in (("part", done.groupBy("part")), ("merged_group", moves.groupBy("merged_group"))):
        n = counts.agg(F.count_distinct("window" if kind == "part" else "merged").alias("n"))
        for r in sorted(n.collect()):
            bases.append((kind, r[0], base))
            base += r["n"]
    based = spark.createDataFrame(bases, "kind string, of int, base long")
    if len(bases) <= SMALL:  # else a shuffled join
        based = F.broadcast(based)
    first = done.join(based.where("kind = 'part'").select(F.col("of").alias("part"), "base"), "part")
    # closed windows of a partition are numbered from 0 without gaps, the open ones behind them
    plain = first.select("doc_id", "start", "length", "ids", "doc_tokens", (F.col("base") + F.col("window")).alias("sequence_id"), "offset")
    moved = left.join(moves, ["part", "window", "piece"]).join(based.where("kind = 'merged_group'").select(F.col("of").alias("merged_group"), F.col("base")), "merged_group")
    again = moved.select(
        "doc_id",
        (F.col("start") + F.col("cut")).alias("start"),
        F.col("take").alias("length"),
        F.expr("substring(ids, cast(4 * cut + 1 as int), cast(4 * take as int))").alias("ids"),
        "doc_tokens",
        (F.col("base") + F.col("merged")).alias("sequence_id"),
        F.col("merged_offset").alias("offset"),
    )
    return plain.unionByName(again)
