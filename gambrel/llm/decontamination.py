"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of ``n`` consecutive benchmark words. For each pattern length a shift table over blocks of
consecutive words says how far the scan may jump; where it says zero, the bucket of the suffix block, refined by the
prefix block, gives the few patterns to compare word by word.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from gambrel.llm.common import map_rows, materialise, quoted, text_of, without

#: ASCII letters fold to lower case; digits and every byte of a non-ASCII character stay; all else separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Benchmark bytes that one broadcast may hold; a larger benchmark is searched in blocks of this size.
BLOCK_BYTES = 32 << 20
SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])
ADDED = StructType(
    [
        StructField("n_words", LongType()),
        StructField("n_hit", LongType()),
        StructField("item_ids", ArrayType(StringType())),
        StructField("hit_spans", ArrayType(SPAN)),
        StructField("contaminated", BooleanType()),
    ]
)
_CARRY = StructType([StructField("__found_spans", ArrayType(LongType())), StructField("__found_items", ArrayType(StringType()))])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class WuManber:
    """Patterns of one length, in words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]], block: int = 2):
        self.m = len(next(iter(patterns)))
        self.block = min(block, self.m)
        self.jump = self.m - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list]] = defaultdict(lambda: defaultdict(list))
        b = self.block
        for words, items in patterns.items():
            for end in range(b, self.m + 1):
                key = b" ".join(words[end - b : end])
                self.shift[key] = min(self.shift.get(key, self.jump), self.m - end)
            self.buckets[b" ".join(words[-b:])][b" ".join(words[:b])].append((list(words), items))

    def search(self, words: list[bytes]) -> Iterable[tuple[int, set[str]]]:
        """Start and items of every occurrence."""
        m, b, jump, shift, n = self.m, self.block, self.jump, self.shift, len(words)
        end = m
        while end <= n:
            key = b" ".join(words[end - b : end])
            step = shift.get(key, jump)
            if step:
                end += step
                continue
            at = end - m
            for pattern, items in self.buckets[key].get(b" ".join(words[at : at + b]), ()):
                if words[at:end] == pattern:
                    yield at, items
            end += 1


def build(items: Iterable[tuple[str | None, str | None]], n: int) -> list[WuManber]:
    """One table for each pattern length: ``n``, and those of items with fewer words."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = words_of(text)
        m = min(n, len(words))
        for at in range(len(words) - m + 1 if m else 0):
            by_length[m][tuple(words[at : at + m])].update([] if item is None else [item])
    return [WuManber(p) for _, p in sorted(by_length.items())]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _pass(df: DataFrame, items: list[tuple], text_col: str, n: int, share: int | None = None) -> DataFrame:
    """Search one block of the benchmark; finds of earlier blocks are carried along.

    With ``share`` it is the last block: its map gives the verdict too. A second map behind it would take another Python
    worker a core, and executors keep workers, with what they hold, for the stages that follow.
    """
    shared = df.sparkSession.sparkContext.broadcast(items)
    carried = [f.name for f in _CARRY]
    first = carried[0] not in df.columns

    def start():
        tables = build(shared.value, n)

        def work(batch: pa.RecordBatch) -> list:
            old = None if first else [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in carried_in]
            spans_out, items_out, counts = [], [], []
            for i, text in enumerate(text_of(batch, text_col)):
                words = words_of(text)
                spans, found = ([], set()) if first else (list(zip(old[0][i][::2], old[0][i][1::2])), set(old[1][i]))
                for t in tables:
                    for at, owners in t.search(words):
                        spans.append((at, at + t.m))
                        found |= owners
                spans_out.append(merge(spans))
                items_out.append(sorted(found))
                counts.append(len(words))
            items_array = pa.array(items_out, pa.list_(pa.string()))
            if share is None:
                return [pa.array([[x for s in spans for x in s] for spans in spans_out], pa.list_(pa.int64())), items_array]
            hits = [sum(b - a for a, b in spans) for spans in spans_out]
            listed = [[{"start": a, "end": b} for a, b in spans] for spans in spans_out]
            return [
                pa.array(counts, pa.int64()),
                pa.array(hits, pa.int64()),
                items_array,
                pa.array(listed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array([h > 0 and share * h >= c for h, c in zip(hits, counts)], pa.bool_()),
            ]

        return work

    carried_in = ["__prior_spans", "__prior_items"]
    if not first:
        df = df.withColumnsRenamed(dict(zip(carried, carried_in)))
    out = map_rows(df, _CARRY if share is None else ADDED, start, text_col)
    return out if first else out.drop(*carried_in)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 13,
    share: int = 20,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add to each document: n_words, n_hit (words inside an occurrence), item_ids (sorted as strings), hit_spans
    (merged, in words) and contaminated (``n_hit > 0 and share * n_hit >= n_words``).

    Null or empty texts have no words and are clean. Repeated rows are judged alike, each on its own. Items without
    words match nothing; an item with a null id marks words but is not listed. An empty benchmark leaves every document
    clean. Input columns named like an added one are replaced. The benchmark is measured first; beyond
    ``block_bytes`` it is searched in blocks that each fit one broadcast, finds being carried from block to block.
    """
    items = benchmark.select(quoted(item_col).cast("string").alias("item"), quoted(item_text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.lit(64)).alias("size")).first()["size"] or 0
    blocks = max(1, math.ceil(1.25 * size / block_bytes))
    out = without(docs, ADDED.fieldNames())
    for k in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        last = k + 1 == blocks
        out = _pass(out, [tuple(r) for r in block.collect()], text_col, n, share if last else None)
        if not last:
            out = materialise(out, "decontamination")
    return out
