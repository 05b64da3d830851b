"""The queries themselves, contract column by column, against plain Python."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gambrel.llm.queries import QUERIES, tokenizer
from test_text_operators import plain_spans


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def library(name: str, texts: dict) -> dict:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(name))
    return {d: t.encode(text, add_special_tokens=False).ids for d, text in texts.items()}


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def run(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).collect()


def test_op2(spark, sf_dir, texts):
    got = run(spark, sf_dir, "op2_find_pii")
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        base = [(kind, a, b) for a, _, kind, b in plain_spans(texts[r.doc_id])]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone"))
        joined = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert [s for s in every if not s.startswith("context:")] == joined
        starts = [int(s.split(":")[1]) for s in every]
        assert starts == sorted(starts)


def test_op3(spark, sf_dir, texts):
    ids, at = {d: [*x, 2] for d, x in library("byte_bpe_50k.json", texts).items()}, 0
    want = []
    for d in sorted(ids):
        want.append((d, at, len(ids[d]), crc(ids[d])))
        at += len(ids[d])
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in run(spark, sf_dir, "op3_token_files")) == want


def test_op6(spark, sf_dir, texts):
    got, shards = run(spark, sf_dir, "op6_assign_shards"), defaultdict(list)
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        shards[r.shard].append(r.slot)
    assert set(shards) <= set(range(8)) and all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    where = defaultdict(set)
    for r in got:
        where[texts[r.doc_id]].add(r.shard)
    assert sum(len(v) > 1 for v in where.values()) == 0  # no group of copies is cut here


def test_op7(spark, sf_dir, texts):
    for r in run(spark, sf_dir, "op7_quality_rules"):
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)


def test_op8(spark, sf_dir, texts):
    want = {d: (len(texts[d].encode()), len(x), len(x) > 2048) for d, x in library("word_bpe_49k.json", texts).items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, sf_dir, "op8_count_tokens")} == want


def test_op9(spark, sf_dir, texts):
    ids = {d: [*x, 0] for d, x in library("byte_bpe_50k.json", texts).items()}
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in run(spark, sf_dir, "op9_pack"):
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.length > 0
        parts[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans, whole in [(parts[d], len(ids[d])) for d in ids] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at == whole if whole else at <= 1024
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(map(len, ids.values())) >= 0.98 * 1024 * len(sequences)
