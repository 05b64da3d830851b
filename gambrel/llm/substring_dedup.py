"""Substring deduplication by super-k-mer partitioning.

A window is ``k`` consecutive words. Its minimiser is the least hash of its runs of ``m`` words. Consecutive windows with
one minimiser travel as one packed string to that minimiser's part; there all windows are sorted by hash, equal hashes are
compared word for word, and every window but the first by (document, start) is reported. Equal strings of one batch are
sent once, with their first place; the rest of them are known to repeat. Minimisers whose slot is far above the mean load
(common lines and passages) are split: their windows travel singly, to parts of their own hashes.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gambrel.llm.common import byte_slices, map_rows, quoted, text_of, without

#: Packed bytes that a part aims at, packed bytes a task gathers before it sends, and bytes hashed at a time.
PART_BYTES, SEND_BYTES, HASH_BYTES = 16 << 20, 24 << 20, 1 << 20
#: Packed words compress by half; what they are sent as is most of the disk in use.
LEVEL = 6
#: A slot of minimisers with more than this many times the mean load is split, and so is one with this many eighths of a
#: part, which holds the load of a group where the table of slots has its largest size.
HOT, MOST_SLOTS = 4.0, 1 << 20
_LAST = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15 | 1
ADDED = StructType([StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2^64, and of its inverse."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            out = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                out.append(np.multiply.accumulate(steps))
            self.up, self.down = out
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _POWERS.get(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return total, down


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of space-joined bytes."""
    raw = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(raw)]))
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + HASH_BYTES, "right")))
        low = starts[at]
        total, down = _sums(raw[low : ends[to - 1]].astype(np.uint64) + np.uint64(1))
        s, e = starts[at:to] - low, ends[at:to] - low
        hashes[at:to] = _mix((total[e] - total[s]) * down[s])
        at = to
    return starts, ends, hashes


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    total, down = _sums(hashes)
    return _mix((total[k:] - total[:-k]) * down[: len(hashes) - k + 1])


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    have, out = 1, a
    while have < w:
        step = min(have, w - have)
        out, have = np.minimum(out[:-step], out[step:]), have + step
    return out


def super_kmers(data: bytes, counts: list[int], k: int, m: int, hot: np.ndarray | None, slots: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(document number, first word in it, windows, minimiser, packed words) of space-joined documents.

    ``counts``: words of each document. Windows of minimisers in ``hot`` slots come singly, under their own hashes.
    """
    starts, ends, hashes = word_hashes(data)
    if len(hashes) < k:
        return
    doc = np.repeat(np.arange(len(counts)), counts)
    first_word = np.concatenate(([0], np.cumsum(counts)))
    least = sliding_min(window_hashes(hashes, m), k - m + 1)
    good = doc[: len(least)] == doc[k - 1 :]
    breaks = np.empty(len(least), bool)
    breaks[0] = True
    breaks[1:] = (least[1:] != least[:-1]) | ~good[:-1] | (doc[1 : len(least)] != doc[: len(least) - 1])
    if hot is not None and hot.any():
        single = hot[(least % np.uint64(slots)).astype(np.int64)]
        least = np.where(single, window_hashes(hashes, k), least)
        breaks |= single
        breaks[1:] |= single[:-1]
    at = np.flatnonzero(breaks & good)
    stop = np.append(np.flatnonzero(breaks), len(least))
    # a run ends at the next break, or where windows stop being inside one document
    until = stop[np.searchsorted(stop, at, "right")]
    bad = np.append(np.flatnonzero(~good), len(least))
    until = np.minimum(until, bad[np.searchsorted(bad, at, "left")])
    low, high = starts[at].tolist(), ends[until + k - 2].tolist()
    d = doc[at]
    for n, first, size, key, a, b in zip(d.tolist(), (at - first_word[d]).tolist(), (until - at).tolist(), least[at].tolist(), low, high):
        yield n, first, size, key, data[a:b]


def _canonical(texts: list[str]) -> tuple[bytes, list[int]]:
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    return b" ".join(b" ".join(w) for w in words if w), [len(w) for w in words]


def _blob(docs, crcs, firsts, sizes, strings: list[bytes]) -> bytes:
    import zstandard

    body = b"".join([np.array(docs, "<i8").tobytes(), np.array(crcs, "<u4").tobytes(), np.array(firsts, "<u4").tobytes(), np.array(sizes, "<u4").tobytes(), b" ".join(strings)])
    return struct.pack("<I", len(docs)) + zstandard.ZstdCompressor(level=LEVEL).compress(body)


def _unblob(blob: bytes) -> tuple:
    import zstandard

    (n,) = struct.unpack_from("<I", blob)
    body = zstandard.ZstdDecompressor().decompress(blob[4:])
    at = 8 * n
    return np.frombuffer(body, "<i8", n), *(np.frombuffer(body, "<u4", n, at + 4 * n * j) for j in range(3)), body[at + 12 * n :]


def repeats(docs: np.ndarray, crcs: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, strings: list[bytes], k: int) -> list[np.ndarray]:
    """Of super-k-mers: the runs (doc, crc, first, size) of windows that are not the first with their words."""
    order = np.lexsort((firsts, crcs, docs))
    docs, crcs, firsts, sizes = (x[order] for x in (docs, crcs, firsts, sizes))
    data = b" ".join([strings[i] for i in order.tolist()])
    starts, ends, hashes = word_hashes(data)
    base = np.concatenate(([0], np.cumsum(sizes.astype(np.int64) + k - 1)))[:-1]
    record = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(record)) - np.repeat(np.cumsum(sizes.astype(np.int64)) - sizes, sizes)
    at = base[record] + within
    h = window_hashes(hashes, k)[at]
    low, high = starts[at], ends[at + k - 1]
    by = np.argsort(h, kind="stable")
    same = np.zeros(len(by), bool)
    same[1:] = h[by[1:]] == h[by[:-1]]
    heads = by[np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))]
    dup = np.zeros(len(by), bool)
    later, head = by[same], heads[same]
    unequal = [data[a:b] != data[c:d] for a, b, c, d in zip(low[later].tolist(), high[later].tolist(), low[head].tolist(), high[head].tolist())]
    if any(unequal):  # one hash, other words: those runs by their words
        bad = np.isin(h, h[later[np.array(unequal)]])
        seen: dict[bytes, int] = {}
        for w in np.flatnonzero(bad).tolist():
            words = data[low[w] : high[w]]
            dup[w] = words in seen
            seen.setdefault(words, w)
        rest = ~bad[later]
        later, head = later[rest], head[rest]
    # equal places come from repeated rows and are no earlier window
    places = [(docs[record[x]], crcs[record[x]], firsts[record[x]].astype(np.int64) + within[x]) for x in (later, head)]
    dup[later[~np.logical_and.reduce([a == b for a, b in zip(*places)])]] = True
    begin = np.flatnonzero(dup & ~np.concatenate(([False], dup[:-1] & (record[1:] == record[:-1]))))
    end = np.flatnonzero(dup & ~np.concatenate((dup[1:] & (record[1:] == record[:-1]), [False])))
    r = record[begin]
    return [docs[r], crcs[r].astype(np.int64), firsts[r].astype(np.int64) + within[begin], end - begin + 1]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20, m: int = 4, part_bytes: int = PART_BYTES) -> DataFrame:
    """Add n_words, n_removed and kept_text: each text less every word that a window covers whose words also start
    earlier (smaller id, or same document and earlier start). Windows are judged on the input. Kept words are joined by
    one space.

    Null and empty texts have no words. Texts shorter than ``k`` words lose none. Rows that share an id are ordered by
    the checksum of their texts; rows equal in both are one document and get the same answer; null ids count as last.
    An empty table gives an empty one. Input columns named like an added one are replaced.
    """
    spark = docs.sparkSession
    wanted = docs.select(quoted(id_col).cast("long").alias("doc"), quoted(text_col).alias("text"))
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, math.ceil(3 * size / part_bytes))
    slots = min(MOST_SLOTS, max(4096, 1 << (8 * parts - 1).bit_length()))

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, bytes, list[int]]]:
        for some in byte_slices(batches, 1):
            texts = text_of(some, "text")
            yield [d if d is not None else _LAST for d in some.column(0).to_pylist()], texts, *_canonical(texts)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for _, _, data, counts in batches_of(batches):
            for _, _, _, key, packed in super_kmers(data, counts, k, m, None, slots):
                total[key % slots] += len(packed)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["slot", "bytes"])

    loads = wanted.mapInArrow(load, "slot long, bytes long").groupBy("slot").agg(F.sum("bytes").alias("bytes"))
    most = HOT * min(3 * size / slots, part_bytes / 8)
    hot = [r.slot for r in loads.where((F.col("bytes") > most) & (F.col("bytes") > part_bytes // 256)).select("slot").collect()]  # at most slots / HOT
    hot_shared = spark.sparkContext.broadcast(hot)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_slots = np.zeros(slots, bool)
        hot_slots[hot_shared.value] = True
        held: dict[bytes, tuple] = {}
        again: list[tuple] = []
        filled = 0

        def send() -> Iterator[pa.RecordBatch]:
            rows: dict[tuple[int, bool], list] = {}
            for packed, (doc, crc, first, n, key) in held.items():
                rows.setdefault((key % parts, False), []).append((doc, crc, first, n, packed))
            for doc, crc, first, n in again:
                rows.setdefault((zlib.crc32(struct.pack("<qI", doc, first)) % parts, True), []).append((doc, crc, first, n, b""))
            made = [(part, known, _blob(*zip(*r))) if not known else (part, known, _blob(*list(zip(*r))[:4], [])) for (part, known), r in rows.items()]
            held.clear()
            again.clear()
            if made:
                p, q, b = zip(*made)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(q, pa.bool_()), pa.array(b, pa.binary())], names=["part", "known", "blob"])

        for ids, texts, data, counts in batches_of(batches):
            crcs = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts]
            for d, first, n, key, packed in super_kmers(data, counts, k, m, hot_slots, slots):
                new = (ids[d], crcs[d], first, n, key)
                old = held.get(packed)
                if old is None:
                    held[packed] = new
                    filled += len(packed) + 200
                elif old[:3] != new[:3]:
                    if new[:3] < old[:3]:
                        held[packed], new = new, old
                    again.append(new[:4])
                    filled += 100
            if filled >= SEND_BYTES:
                yield from send()
                filled = 0
        yield from send()

    def judge(key, group):
        found, raw = [], []
        for known, blob in zip(group.column("known").to_pylist(), group.column("blob").to_pylist()):
            d, c, f, n, text = _unblob(blob)
            if known:
                found.append([d, c.astype(np.int64), f.astype(np.int64), n.astype(np.int64)])
            else:
                words = text.split(b" ")
                stops = np.cumsum(n.astype(np.int64) + k - 1).tolist()
                raw.append((d, c, f, n, [b" ".join(words[a:b]) for a, b in zip([0, *stops], stops)]))
        if raw:
            found.append(repeats(*(np.concatenate([r[j] for r in raw]) for j in range(4)), [s for r in raw for s in r[4]], k))
        cols = [np.concatenate([f[j] for f in found]) if found else np.empty(0, np.int64) for j in range(4)]
        return pa.table([pa.array(x, pa.int64()) for x in cols], names=["doc", "crc", "first", "n"])

    packed = wanted.mapInArrow(split, "part int, known boolean, blob binary")
    runs = packed.groupBy("part").applyInArrow(judge, "doc long, crc long, first long, n long")
    # the words from first to the end of the last window of each run
    covered = runs.groupBy("doc", "crc").agg(F.collect_list(F.struct("first", (F.col("first") + F.col("n") + k - 1).alias("until"))).alias("__runs"))
    keyed = without(docs, [*ADDED.fieldNames(), "__doc", "__crc"])
    keyed = keyed.withColumn("__doc", F.coalesce(quoted(id_col).cast("long"), F.lit(int(_LAST)))).withColumn("__crc", F.crc32(F.coalesce(quoted(text_col), F.lit(""))))
    joined = keyed.join(covered.withColumnsRenamed({"doc": "__doc", "crc": "__crc"}), ["__doc", "__crc"], "left")

    def start():
        def work(batch: pa.RecordBatch) -> list:
            counts, removed, kept = [], [], []
            spans = batch.column(batch.schema.get_field_index("__runs")).to_pylist()
            for text, runs in zip(text_of(batch, text_col), spans):
                words = text.encode("utf-8", "surrogatepass").split()
                out, at = [], 0
                for r in sorted(runs or (), key=lambda r: r["first"]):
                    out += words[at : max(at, r["first"])]
                    at = max(at, r["until"])
                out += words[at:]
                counts.append(len(words))
                removed.append(len(words) - len(out))
                kept.append(b" ".join(out).decode("utf-8", "surrogatepass"))
            return [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]

        return work

    out = map_rows(joined, ADDED, start, text_col)
    return out.select(*[quoted(c) for c in keyed.columns if c not in ("__doc", "__crc")], *ADDED.fieldNames())
