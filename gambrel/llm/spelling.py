"""Spelling variants of a vocabulary: words one edit apart, the common form of a rare one, and the root of its chain.

Every word emits its full neighbourhood: all distinct deletions, replacements and insertions over the letters that the
vocabulary shows. Neighbours are emitted as hashes first. A bitmap of the vocabulary's hashes, whose size has an upper
bound, drops most that are no words; the rest are spelt out and joined to the vocabulary by the strings themselves, so what
meets is exactly one edit apart and needs no distance. A vocabulary too large for the bitmap lets more neighbours through
to the join; nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gambrel.llm.common import materialise, quoted

#: Bits of the bitmap for each word, and the most bits of all, as a power of two (32 MB).
BITS_A_WORD, MOST_BITS = 32, 28
#: Hashes that a task holds at a time.
CELLS = 1 << 20
#: Words that a task holds at a time.
WORDS = 1 << 14
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 15  # bits of a value of bitmap_construct_agg


def words_of(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, word): every run of ``pattern`` in whole texts, A to Z in lower case. Null texts have none."""
    runs = docs.select(quoted(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(F.coalesce(quoted(text_col), F.lit("")), F.lit(pattern), F.lit(0))).alias("word"))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return runs.withColumn("word", F.when(F.rlike("word", F.lit("[A-Z]")), F.translate("word", capitals, capitals.lower())).otherwise(F.col("word")))


def vocabulary(words: DataFrame, least_chars: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of words of enough code points that occur often enough; null and empty words do not count."""
    return words.where(F.char_length("word") >= max(1, least_chars)).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, _BASE), out=out[1:]) if n else None
    return out


def _by_length(words: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words of one length with their code points, a row a word."""
    order: dict[int, list[str]] = {}
    for w in words:
        order.setdefault(len(w), []).append(w)
    for size, some in order.items():
        step = max(1, CELLS // size)
        for k in range(0, len(some), step):
            part = some[k : k + step]
            yield part, np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(part), size).astype(np.uint64)


def _hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: the hashes of what stands before each place, and of what stands from it on, all modulo 2^64."""
    n, size = codes.shape
    powers = _powers(size)
    suffix = np.zeros((n, size + 1), np.uint64)
    suffix[:, :size] = np.cumsum((codes * powers[size - 1 :: -1][:size])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    prefix = np.zeros((n, size + 1), np.uint64)
    for i in range(size):
        prefix[:, i + 1] = prefix[:, i] * _BASE + codes[:, i]
    return prefix, suffix


def _places(hashes: np.ndarray, log_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits for each hash."""
    x = hashes ^ (hashes >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x >> np.uint64(64 - log_bits), (x >> np.uint64(4)) & np.uint64((1 << log_bits) - 1)


def _on(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _found(bits: np.ndarray, log_bits: int, hashes: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, ...]:
    """Indices of the hashes under ``keep`` that the bitmap holds."""
    at = np.nonzero(keep)
    one, two = _places(hashes[at], log_bits)
    first = np.nonzero(_on(bits, one))[0]
    both = first[_on(bits, two[first])]
    return tuple(a[both] for a in at)


def neighbours(words: list[str], letters: str, bits: np.ndarray, log_bits: int) -> Iterator[tuple[str, str]]:
    """(word, neighbour) of all distinct strings one edit away that ``bits`` holds; no string comes twice for a word.

    A deleted letter is the first of its run, an inserted one stands before a run of itself, so that each string has one way.
    """
    alphabet = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    for part, codes in _by_length(words):
        n, size = codes.shape
        prefix, suffix = _hashes(codes)
        powers = _powers(size + 1)
        one = prefix[:, :size] * powers[size - 1 :: -1][:size] + suffix[:, 1:]
        fresh = np.ones((n, size), bool)
        fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
        for r, i in zip(*_found(bits, log_bits, one, fresh)):
            yield part[r], part[r][:i] + part[r][i + 1 :]
        rows, wide = max(1, CELLS // ((size + 1) * len(alphabet))), max(1, CELLS // len(alphabet))
        for r0 in range(0, n, rows):
            c, pre, suf = codes[r0 : r0 + rows], prefix[r0 : r0 + rows], suffix[r0 : r0 + rows]
            for i0 in range(0, size + 1, wide):
                at = np.arange(i0, min(i0 + wide, size + 1))
                inner = at[at < size]
                # a letter in place of another: (rows, places, letters)
                p = powers[size - 1 - inner]
                swapped = (pre[:, inner] * (p * _BASE) + suf[:, inner + 1])[:, :, None] + (p[:, None] * alphabet)[None]
                for r, i, k in zip(*_found(bits, log_bits, swapped, c[:, inner, None] != alphabet)):
                    w = part[r0 + r]
                    yield w, w[: inner[i]] + letters[k] + w[inner[i] + 1 :]
                # a letter more
                p = powers[size - at]
                put = (pre[:, at] * (p * _BASE) + suf[:, at])[:, :, None] + (p[:, None] * alphabet)[None]
                new = np.ones(put.shape, bool)
                back = at > 0
                new[:, back] = c[:, at[back] - 1, None] != alphabet
                for r, i, k in zip(*_found(bits, log_bits, put, new)):
                    w = part[r0 + r]
                    yield w, w[: at[i]] + letters[k] + w[at[i] :]


def _bitmap(vocab: DataFrame, log_bits: int) -> np.ndarray:
    """The vocabulary's bitmap: made of blocks in the cluster, at most 2^MOST_BITS bits in all."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes in _by_length(batch.column(0).to_pylist()):
                places = np.concatenate(_places(_hashes(codes)[0][:, -1], log_bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(places // _BLOCK), pa.array(places % _BLOCK)], names=["block", "bit"])

    blocks = vocab.select("word").mapInArrow(mark, "block long, bit long").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(max(_BLOCK, 1 << log_bits) // 8, np.uint8)
    for r in blocks.toLocalIterator():
        out[r.block * _BLOCK // 8 : (r.block + 1) * _BLOCK // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, near): every pair of words of ``vocab`` (word, n) that differ by one inserted, deleted or replaced code point,
    both ways round."""
    spark = vocab.sparkSession
    letters = "".join(sorted(r.c for r in vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().where("c <> ''").collect()))
    log_bits = min(MOST_BITS, max(15, (BITS_A_WORD * vocab.count()).bit_length()))
    bits = spark.sparkContext.broadcast(_bitmap(vocab, log_bits).tobytes())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            words, near = [], []
            for w, x in neighbours(batch.column(0).to_pylist(), letters, table, log_bits):
                words.append(w)
                near.append(x)
                if len(words) >= WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(near, pa.string())], names=["word", "near"])
                    words, near = [], []
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(near, pa.string())], names=["word", "near"])

    if not letters:
        return vocab.select("word", F.col("word").alias("near")).limit(0)
    spelt = vocab.select("word").mapInArrow(emit, "word string, near string")
    return spelt.join(vocab.select(F.col("word").alias("near")), "near", "left_semi").select("word", "near")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form (word, form): the last word of the chain of forms. Each round halves the chains;
    a chain's counts double at every step, so a handful of rounds will do."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = materialise(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.drop("moved")


def group_variants(vocab: DataFrame, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``vocab`` (word, n).

    The form is the near word of largest n, of equals the first in code-point order, if its n is ``factor`` times the
    word's or more, else null; the root is the last of the chain of forms, or the word. Words are distinct and not null
    (``vocabulary`` sees to it); very long words work in pieces; an empty vocabulary gives no rows.
    """
    vocab = materialise(vocab.select("word", "n"), "spelling-vocabulary")
    counts = vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = near_words(vocab).join(counts, "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("low"), F.col("near"))).alias("best"))
    named = vocab.join(best, "word", "left")
    some: Column = -F.col("best.low") >= factor * F.col("n")
    named = named.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(some, F.col("best.near")).alias("form"), F.when(some, -F.col("best.low")).alias("form_n"))
    named = materialise(named, "spelling-forms")
    ends = roots(named.where("form is not null"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
