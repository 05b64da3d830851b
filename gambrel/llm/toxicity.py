"""Toxicity by compression: two zstandard dictionaries, of toxic and of ordinary text; a window of a text speaks for the one
under which it is shorter, and calibrated thresholds make a score of its windows.

Zstandard stores inputs of a few bytes as they are, and a short word costs about as much spelt out as looked up, so bytes
of words tell little: windows of plain text gave an area under the curve of 0.75 at best on held-out labels. Words are
therefore written as codes of 16 bytes and windows twice over: a word that a dictionary knows costs three bytes, one that
it does not know costs 16, and no window is stored raw. Windows of one and of two words both gave 0.967 (the labels hold
noise), four 0.92; a window is one word here, as most windows then repeat and need not be compressed again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from gambrel.llm.common import byte_slices, materialise, quoted, without

#: Bytes of a word's code, which is a window; words of a training sample.
CODE, SAMPLE = 16, 8
#: Words of a piece of a training text that is sampled or not.
CHUNK = 64
LEVEL = 19
#: Margins that a worker process remembers at most.
MEMO = 1_000_000
ADDED = ("score", "windows", "toxic_windows", "margin")


@dataclass(frozen=True)
class Model:
    """Dictionaries (ordinary, toxic), the margin from which a window counts as toxic, weights of the score."""

    ordinary: bytes = b""
    toxic: bytes = b""
    threshold: int = 0
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    prior: float = 0.0
    memo: dict = field(default_factory=dict, compare=False, repr=False)


def word_codes(text: Column) -> Column:
    """The hashes of a text's words, runs of letters in lower case, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\P{L}+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def coded(hashes: np.ndarray) -> bytes:
    """Hashes as codes: each with a second half that follows from it."""
    h = hashes.astype(np.int64).view(np.uint64)
    return np.stack([h, h * np.uint64(0x9E3779B97F4A7C15)], axis=1).tobytes()


def compressor(dictionary: bytes):
    import zstandard

    known = zstandard.ZstdCompressionDict(dictionary)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)


def margins(model: Model):
    """A function from hashes of words to the margins of their windows: bytes under the ordinary dictionary less bytes under
    the toxic one. A worker keeps a bounded table of margins for as long as the model is the same."""
    ordinary, toxic = compressor(model.ordinary), compressor(model.toxic)
    memo = model.memo

    def of(hashes: np.ndarray) -> np.ndarray:
        words, back = np.unique(hashes, return_inverse=True)
        raw, out = coded(words), np.zeros(len(words), np.int16)
        for k, word in enumerate(words.tolist()):
            m = memo.get(word)
            if m is None:
                if len(memo) >= MEMO:
                    memo.clear()
                twice = raw[k * CODE : (k + 1) * CODE] * 2
                m = memo[word] = len(ordinary.compress(twice)) - len(toxic.compress(twice))
            out[k] = m
        return out[back]

    return of


def by_row(codes: pa.ListArray, of) -> list[np.ndarray]:
    """The margins of each row's words, all words of a batch at once."""
    flat = codes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.array([len(c) for c in codes], np.int64)
    return np.split(of(flat), np.cumsum(sizes)[:-1]) if len(sizes) else []


_kept: dict[bytes, Model] = {}


def _kept_model(model: Model) -> Model:
    """The same model object for all tasks of a worker process, so that its margins are worked out once."""
    import hashlib

    key = hashlib.sha256(model.ordinary + model.toxic).digest()
    if key not in _kept:
        _kept.clear()
        _kept[key] = Model(model.ordinary, model.toxic)
    return _kept[key]


def train_dictionary(codes: np.ndarray, size: int) -> bytes:
    """A dictionary from hashes of words in order; of segments of one word. Too little text becomes a plain-content
    dictionary, which has no entropy tables but finds the same matches.

    Samples are shuffled, always alike: the trainer goes through them in stretches and ends early where several in a row, as
    of one long text that repeats itself, bring it nothing new.
    """
    import zstandard

    raw = coded(codes)
    step = CODE * SAMPLE
    samples = [raw[k * step : (k + 1) * step] for k in np.random.default_rng(7).permutation(-(-len(raw) // step))]
    try:
        return zstandard.train_dictionary(size, samples, k=CODE, d=8, level=3).as_bytes()
    except zstandard.ZstdError:
        return raw[-size:] or bytes(CODE)


def windows_of(rows: DataFrame, words: int) -> DataFrame:
    """Chunks of ``words`` words of rows' ``codes``, with the row's other columns and the chunk's place."""
    starts = F.when(F.size("codes") > 0, F.sequence(F.lit(1), F.size("codes"), F.lit(words))).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("start", F.explode(starts)).withColumn("codes", F.slice("codes", F.col("start"), words))


def features_of(rows: DataFrame, model: Model, label: str) -> DataFrame:
    """(label, counts) of rows with codes: how many of a row's windows have each margin from 0 (or less) to CODE or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = margins(_kept_model(model))
        for batch in batches:
            counts = [np.bincount(np.clip(m, 0, CODE), minlength=CODE + 1).tolist() for m in by_row(batch.column(1), of)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.list_(pa.int64()))], names=["label", "counts"])

    return rows.select(F.col(label).cast("int").alias("label"), "codes").mapInArrow(run, "label int, counts array<bigint>")


def design(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """What the score weighs: a constant, the number of toxic windows, and their share, both on a log scale."""
    count, total = np.asarray(count, float), np.asarray(total, float)
    return np.stack([np.ones_like(count), np.log1p(count), np.log1p(1000 * count / np.maximum(total, 1))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights by Newton's rule, rows counting as ``weight`` says, with a small penalty on all but the constant; their loss."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.0, *[ridge] * (x.shape[1] - 1)])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (weight * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return w, float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum())


def labelled_rows(docs: DataFrame, labels: DataFrame, fold: Column, id_col: str, text_col: str, label_col: str, label_rows: int) -> tuple[DataFrame, dict, dict]:
    """(label, fold, digest, codes) of the texts of at most ``label_rows`` ids a label, taken in the order of a hash; the ids
    of each label, and those taken. What is taken has a bound, so it is broadcast to the documents."""
    ids = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("label"), F.coalesce(fold, F.lit(False)).alias("fold"))
    ids = ids.where("id is not null and label in (0, 1)").distinct()
    totals = {r.label: r.n for r in ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = [ids.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(label_rows) for k in (0, 1)]
    picked = some[0].unionByName(some[1])
    text = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    rows = text.join(F.broadcast(picked), "id").select("label", "fold", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), word_codes(F.col("text")).alias("codes"))
    rows = materialise(rows.groupBy("digest", "label").agg(F.min("fold").alias("fold"), F.first("codes").alias("codes")), "toxic-rows")
    return rows, totals, {k: min(n, label_rows) for k, n in totals.items()}


def fit(docs: DataFrame, labels: DataFrame, fold: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", label_rows: int = 10_000, sample_words: int = 1_000_000, share: float = 0.01, least: int = 4, sizes: tuple[int, int] = (1 << 20, 1 << 16)) -> Model:
    """The model of the documents that ``labels`` (id, label 0 or 1) names; other labels, null ids and ids without a document
    are left out.

    ``label_rows`` ids a label, in the order of a hash, are used: the bound of all that is fitted. Labelled rows where
    ``fold`` is true calibrate, the others train, so thresholds are of texts that the dictionaries did not see; in calibration
    the labels weigh as they do among all labelled rows. Equal texts of a label count once, and train if any of them does.
    Words in under ``share`` of the toxic training texts, or under ``least``, stay out of the toxic dictionary, which so holds
    what toxic texts have in common. Of the training texts about ``sample_words`` words a label, whole windows by a hash, come
    to the driver.

    Without texts of both labels the model gives every text the share of label 1, or 0.
    """
    rows, totals, taken = labelled_rows(docs, labels, fold, id_col, text_col, label_col, label_rows)
    train = rows.where("not fold")
    texts = {r.label: r for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.ceil(F.size("codes") / CHUNK)).alias("chunks")).collect()}
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    if not (0 in texts and 1 in texts):
        return Model(prior=prior)
    known = train.where("label = 1").select(F.explode(F.array_distinct("codes")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    # words in a hundredth of the texts are at most a hundred times a text's words
    often = np.array([r.code for r in known.where(F.col("n") >= max(min(least, texts[1].n), math.ceil(share * texts[1].n))).select("code").collect()], np.int64)

    def sample(label: int) -> np.ndarray:
        kept = min(1.0, sample_words / CHUNK / max(1, texts[label].chunks))
        chunks = windows_of(train.where(F.col("label") == label), CHUNK).where(F.pmod(F.xxhash64("digest", "start"), F.lit(1 << 20)) < kept * (1 << 20))
        parts = [np.array(r.codes, np.int64) for r in chunks.select("digest", "start", "codes").orderBy("digest", "start").toLocalIterator()]
        return np.concatenate(parts) if parts else np.array([], np.int64)

    toxic = sample(1)
    model = Model(train_dictionary(sample(0), sizes[0]), train_dictionary(toxic[np.isin(toxic, often)], sizes[1]), prior=prior)
    counted = features_of(rows.where("fold"), model, "label").collect()
    y = np.array([r.label for r in counted], float)
    if not counted or y.min() == y.max():
        # nothing to calibrate by: a window counts if the toxic dictionary alone knows it
        return Model(model.ordinary, model.toxic, CODE // 2, (-3.0, 3.0, 0.5), prior)
    table = np.array([r.counts for r in counted], float)
    weight = np.array([totals[r.label] / taken[r.label] for r in counted])
    best = None
    for threshold in range(1, CODE + 1):
        w, loss = logistic(design(table[:, threshold:].sum(axis=1), table.sum(axis=1)), y, weight)
        if best is None or loss < best[0] - 1e-12:
            best = (loss, threshold, tuple(float(v) for v in w))
    return Model(model.ordinary, model.toxic, best[1], best[2], prior)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add score (0 to 1), windows, toxic_windows and margin (the mean over all windows) to every document.

    Whole texts are scored, window by window; nothing but the text enters the score. Null and empty texts, and texts
    without letters, have no windows and the score of a text without toxic ones. Equal texts get equal scores. Input columns
    named like an added one are replaced. Empty tables give no rows.
    """
    base = without(docs, [*ADDED, "__codes"]).withColumn("__codes", word_codes(quoted(text_col)))
    names = [c for c in base.columns if c != "__codes"]
    if not model.toxic:
        return base.select(*map(quoted, names), F.lit(float(model.prior)).alias("score"), F.lit(0).cast("long").alias("windows"), F.lit(0).cast("long").alias("toxic_windows"), F.lit(0.0).alias("margin"))
    shared = docs.sparkSession.sparkContext.broadcast((model.ordinary, model.toxic))
    threshold, weights, at = model.threshold, np.array(model.weights), len(base.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = margins(_kept_model(Model(*shared.value)))
        for batch in byte_slices(batches, names.index(text_col)):
            n, toxic, mean = [], [], []
            for m in by_row(batch.column(at), of):
                n.append(len(m))
                toxic.append(int((m >= threshold).sum()))
                mean.append(float(m.mean()) if len(m) else 0.0)
            z = design(np.array(toxic), np.array(n)) @ weights if n else np.array([])
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(p, pa.float64()), pa.array(n, pa.int64()), pa.array(toxic, pa.int64()), pa.array(mean, pa.float64())], names=[*names, "score", "windows", "toxic_windows", "margin"])

    schema = StructType([*base.drop("__codes").schema.fields, StructField("score", DoubleType()), StructField("windows", LongType()), StructField("toxic_windows", LongType()), StructField("margin", DoubleType())])
    return base.mapInArrow(run, schema)
