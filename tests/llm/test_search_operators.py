"""Spelling variants, toxicity and hard negatives, against brute force and held-out labels."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gambrel.llm import hard_negatives as H
from gambrel.llm import spelling as S
from gambrel.llm import toxicity as T
from gambrel.llm.queries import LETTERS, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(texts):
    """The words of op11's contract, with their counts."""
    count = Counter()
    for doc, text in texts:
        for run in re.findall(LETTERS, text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{doc}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def plain_variants(vocab):
    """word -> (form, root, n, n_near, form_n), by holes: words near each other share one with a letter left out."""
    holes = defaultdict(set)
    for w in vocab:
        for i in range(len(w)):
            holes[(w[:i], w[i + 1 :])].add(w)
    near = defaultdict(set)
    for w in vocab:
        for i in range(len(w)):
            near[w] |= holes[(w[:i], w[i + 1 :])] - {w}
            short = w[:i] + w[i + 1 :]
            if short in vocab:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, n in vocab.items():
        best = min(near[w], key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), vocab.get(form[w])) for w, n in vocab.items()}


def got_variants(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_op11(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = plain_variants(plain_words(docs))
    assert got_variants(QUERIES["op11_spelling_variants"](spark, sf_dir)) == want
    assert sum(v[0] is not None for v in want.values()) > 20 and sum(v[1] != v[0] and v[0] is not None for v in want.values()) > 0


def test_variants_of_odd_words(spark):
    """Repeated letters, letters beyond 16 bits, long words, ties and chains; each near pair once."""
    words = {"aaaaa": 3, "aaaa": 9, "aaaaaa": 9, "aabaa": 4, "baaaa": 1, "ab": 7, "ba": 5, "a": 2, "b": 2, "": 5, "𝒳yz": 3, "𝒳y": 6, "𝒳y𝒳": 3, "x" * 3000: 2, "x" * 2999 + "y": 8, "x" * 1500 + "y" + "x" * 1500: 40}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    del words[""]
    assert got_variants(S.group_variants(S.vocabulary(df.select(F.explode(F.array_repeat("word", F.col("n").cast("int"))).alias("word")), 1, 1))) == plain_variants(words)
    near = S.near_words(df.where("word <> ''")).collect()
    assert len(near) == len({(r.word, r.near) for r in near})
    assert S.group_variants(df.limit(0)).count() == 0


def test_words_of_null_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "w"), (2, "", "w"), (None, "Abc ÀÉ-x", "w")], "doc_id long, text string, word string")
    assert sorted((r.doc_id, r.word) for r in S.words_of(df, LETTERS).collect()) == [(None, "abc"), (None, "x"), (None, "ÀÉ")]


def test_bitmap_only_drops(spark):
    """Whatever a full bitmap lets through, the join judges."""
    words = ["house", "houses", "mouse", "louse", "hose"]
    every = set(S.neighbours(words, "ehlmosu", np.full(1 << 12, 255, np.uint8), 15))
    brute = set()
    for w in words:
        for i in range(len(w) + 1):
            brute |= {(w, w[:i] + c + w[i:]) for c in "ehlmosu"} | ({(w, w[:i] + w[i + 1 :])} if i < len(w) else set()) | {(w, w[:i] + c + w[i + 1 :]) for c in "ehlmosu" if i < len(w) and c != w[i]}
    assert every == brute and len(list(S.neighbours(words, "ehlmosu", np.full(1 << 12, 255, np.uint8), 15))) == len(brute)


def auc(pairs):
    low, high = [s for s, y in pairs if not y], [s for s, y in pairs if y]
    return sum((a > b) + 0.5 * (a == b) for a in high for b in low) / (len(high) * len(low))


def test_op12_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op12_toxicity"](spark, sf).collect()}
    docs = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert set(got) == docs and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(got[d].score, y) for d, y in labels.items() if got[d].held_out]
    right = sum((s >= 0.5) == bool(y) for s, y in held) / len(held)
    assert auc(held) >= 0.94 and right >= 0.97, (auc(held), right)  # some labels are noise


def toxic_rows(spark, n=60):
    plain = "the cat and the dog went over the hill with all of their friends to see a river".split()
    rows = []
    for i in range(n):
        words = [plain[(i * 7 + k * 3) % len(plain)] for k in range(40)]
        if i % 3 == 0:
            words[i % 40] = ["rotten", "dreadful"][i % 2]
            words[(i + 9) % 40] = "vile"
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_toxicity_of_odd_rows(spark):
    model = T.fit(toxic_rows(spark), toxic_rows(spark), F.col("doc_id") % 4 == 1, sample_words=5000)
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "12 34 !!", 0.5), (4, "you vile rotten dog", 0.5), (5, "the cat and the dog", 0.5), (5, "the cat and the dog", 0.5), (6, "VILE " * 20_000 + "Rotten", 0.5)]
    out = T.score(spark.createDataFrame(rows, "doc_id long, text string, score double"), model).collect()
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert len(out) == len(rows) and by[5][0] == by[5][1]
    assert by[1][0].score == by[2][0].score == by[3][0].score < 0.5 <= by[4][0].score and by[5][0].score < 0.5 <= by[6][0].score
    assert by[6][0].windows == by[6][0].toxic_windows == 20_001
    assert T.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    one = T.fit(toxic_rows(spark), toxic_rows(spark).where("label = 0"), F.lit(False))
    assert [r.score for r in T.score(toxic_rows(spark, 2), one).collect()] == [0.0, 0.0]
    assert T.fit(toxic_rows(spark), toxic_rows(spark).limit(0), F.lit(False)).prior == 0


def plain_negatives(rows, every=100):
    """(anchor, positive, rank, negative, scores) of (id, label, whole components)."""
    out = set()
    ids, labels = [r[0] for r in rows], np.array([r[1] for r in rows])
    x = np.array([r[2] for r in rows], np.int64)
    for a in range(len(rows)):
        if ids[a] % every:
            continue
        scores = x @ x[a]
        order = sorted(range(len(rows)), key=lambda k: (-scores[k], ids[k]))
        for p in [k for k in order if k != a and labels[k] == labels[a]][:5]:
            some = [k for k in order if labels[k] != labels[a] and 80 * scores[p] <= 100 * scores[k] <= 100 * scores[p]][:5]
            out |= {(ids[a], ids[p], i + 1, ids[k], int(scores[p]), int(scores[k])) for i, k in enumerate(some)}
    return out


def as_tuples(df):
    rows = df.collect()
    out = {(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in rows}
    assert len(out) == len(rows)
    return out


def test_op13(spark, sf_dir):
    rows = []
    for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect():
        if r.label is not None and r.embedding is not None and all(v is not None and np.isfinite(v) for v in r.embedding):
            rows.append((r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(np.floor(256 * float(v))) for v in r.embedding]))
    want = plain_negatives(rows)
    assert as_tuples(QUERIES["op13_hard_negatives"](spark, sf_dir)) == want and want


def test_negatives_of_odd_rows(spark, monkeypatch):
    """Ties, copies, nulls, other sizes, several blocks, anchors with few or no positives."""
    monkeypatch.setattr(H, "ANCHORS", 7)
    monkeypatch.setattr(H, "ROWS", 50)
    rng = np.random.default_rng(5)
    base = [(k, int(rng.integers(0, 4)), (rng.integers(-3, 9, 6) / 8).tolist()) for k in range(300)]
    base += [(1000 + k, base[k % 40][1], base[k % 40][2]) for k in range(80)] + [(5000, 77, [0.5] * 6), (5010, 78, [-0.5] * 6), (5020, 0, [0.0] * 6)]
    odd = [(None, 1, [1.0] * 6), (6000, None, [1.0] * 6), (6010, 1, None), (6020, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (6030, 1, [float("nan")] * 6), (6040, 1, [float("inf")] * 6), (6050, 1, [1.0] * 5), (6060, 1, []), base[10]]
    df = spark.createDataFrame(base + odd, "vec_id long, label int, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("score", F.lit(0))
    want = plain_negatives([(i, lab, [int(np.floor(256 * v)) for v in x]) for i, lab, x in base], 10)
    assert as_tuples(H.mine(H.prepared(df), every=10)) == want and len(want) > 300
    assert H.mine(H.prepared(df.limit(0))).count() == 0


@pytest.mark.parametrize("low", [-4, 3])
def test_bounds_hold(low):
    rng = np.random.default_rng(1)
    x = rng.integers(low, 60, (400, 5))
    edges = np.array([[x[:, d].min(), *np.sort(rng.choice(np.arange(low, 60), H.CELLS - 1)), x[:, d].max() + 1] for d in range(5)])
    cells = np.stack([np.searchsorted(edges[d, 1:-1], x[:, d], "right") for d in range(5)], axis=1).astype(np.uint8)
    block = H.Block(np.arange(9), np.zeros(9), rng.integers(-9, 9, (9, 5)), edges)
    lo, hi = H.bounds(block, cells)
    exact = x @ block.x.T
    assert (lo <= exact).all() and (exact <= hi).all()
