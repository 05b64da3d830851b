"""Operators over groups of documents, and the pipeline, against plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from gambrel.llm.decontamination import words_of
from gambrel.llm.near_dedup import MAPS, deduplicate, may_be_alike, near_duplicates, packed_features, probability_jaccard, run_maps, shingles, signatures
from gambrel.llm.sharding import assign_shards
from gambrel.llm.warc import assemble, read_archives, write_archives


def prose(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def changed(words: list[str], seed: int, n: int) -> list[str]:
    r, out = random.Random(seed), list(words)
    for at in r.sample(range(len(words)), n):
        out[at] = f"x{seed}"
    return out


def weights(text: str) -> Counter:
    w = words_of(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def exact(a: Counter, b: Counter) -> float:
    both = a.keys() | b.keys()
    return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in both) for i in a.keys() & b.keys())


@pytest.fixture(scope="module")
def docs(spark):
    base, rows = prose(1, 200), []
    rows += [(i, " ".join(base)) for i in range(10)]  # exact copies
    rows += [(20 + i, " ".join(changed(base, i, 1 + i % 4))) for i in range(30)]  # near copies
    rows += [(60, " ".join(changed(base, 77, 60)))]  # too far
    chain = prose(2, 120)
    for i in range(4):
        rows.append((70 + i, " ".join(chain)))
        chain = changed(chain, 200 + i, 2)
    rows += [(80 + i, " ".join(prose(100 + i, 50))) for i in range(10)]
    rows += [(90, "one two three"), (91, "One, two THREE!"), (92, ""), (93, None), (94, " "), (None, " ".join(base)), (95, "a b a b a b a b a b " * 30), (96, "a b a b a b a b a b " * 31), (85, " ".join(prose(105, 50)))]
    return spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, class_id string")


def test_near_duplicates(docs):
    rows = [(r.doc_id if r.doc_id is not None else 1 << 62, r.text or "") for r in docs.collect()]
    w = [weights(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if w[i] and w[j] and top(i) != top(j) and (w[i] == w[j] or exact(w[i], w[j]) >= 0.8):
                root[top(i)] = top(j)
    least = defaultdict(lambda: 1 << 63)
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least[top(i)], d)
    want = Counter((d, least[top(i)]) for i, (d, _) in enumerate(rows))
    got = near_duplicates(docs).collect()
    assert Counter((r.doc_id if r.doc_id is not None else 1 << 62, r.class_id) for r in got) == want
    clash = docs.withColumnsRenamed({"class_id": "row"}).selectExpr("*", "1 as doc", "2 as digest", "3 as __doc")
    kept = deduplicate(clash)
    assert kept.columns == clash.columns and {tuple(r) for r in kept.select("row", "doc", "digest", "__doc").collect()} == {("c", 1, 2, 3)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_crowded_buckets(spark):
    """A frequent run puts all texts in the same few buckets: twenty pairs of copies, and a chain that drifts."""
    often = ["z"] * 300
    rows = []
    for i in range(20):
        own = prose(300 + i, 50)
        rows += [(2 * i, " ".join(often + own)), (2 * i + 1, " ".join(often + own[:40] + prose(400 + i, 10)))]
    drift = prose(500, 160)
    rows += [(100 + i, " ".join(often + drift[10 * i : 10 * i + 60])) for i in range(10)]
    w = {i: weights(t) for i, t in rows}
    assert exact(w[0], w[1]) > 0.8 and exact(w[0], w[2]) < 0.8 and exact(w[100], w[101]) > 0.8 and exact(w[100], w[109]) < 0.8
    root = {i: i for i in w}
    for i in w:
        for j in w:
            if i < j and root[i] != root[j] and exact(w[i], w[j]) >= 0.8:
                root = {k: min(root[i], root[j]) if r in (root[i], root[j]) else r for k, r in root.items()}
    assert len(set(root.values())) == 21
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=4, rows=1)
    assert {r.doc_id: r.class_id for r in got.collect()} == root


def test_near_duplicates_in_one_bucket_of_many(spark):
    """Pairs at 0.83 among texts that all are 0.77 alike: none may be lost, however many share a bucket."""
    often, rows = prose(600, 348), []
    for i in range(150):
        own = prose(700 + i, 52)
        rows += [(2 * i, " ".join(often + own)), (2 * i + 1, " ".join(often + own[:15] + prose(900 + i, 37)))]
    d, h, c = shingles([t.encode() for _, t in rows], [400] * len(rows))
    w = [(h[d == i], c[d == i]) for i in range(len(rows))]
    alike = [(i, j) for i in range(300) for j in range(i) if probability_jaccard(w[i], w[j]) >= 0.8]
    assert len(alike) == 150 and abs(probability_jaccard(w[0], w[1]) - exact(weights(rows[0][1]), weights(rows[1][1]))) < 1e-9
    want = {i: i for i in range(300)}
    for i, j in alike:
        want = {k: min(want[i], want[j]) if v in (want[i], want[j]) else v for k, v in want.items()}
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), bands=4, rows=1)
    assert {r.doc_id: r.class_id for r in got.collect()} == want


def test_odds_bound_the_similarity():
    """Whatever two multisets share, the odds of what they do not share bound their similarity."""
    r = np.random.default_rng(3)
    for _ in range(300):
        pair = []
        for side in (0, 1):
            shared, own = r.integers(1, 9, 12), r.integers(1, 9, r.integers(1, 8))
            pair.append((np.concatenate((np.arange(12), 100 * (side + 1) + np.arange(len(own)))).astype(np.uint64), np.concatenate((shared, own))))
        odds = [c[12:].sum() / c[:12].sum() for _, c in pair]
        assert probability_jaccard(*pair) <= 1 / (1 + sum(odds)) + 1e-12


def test_maps_bound_the_similarity(spark):
    texts = {k: " ".join(changed(prose(9, 100) + prose(8, 10) * (k % 2), k, k % 3)) for k in range(30)} | {90: "one", 91: "one two", 92: " ".join(prose(3, 600)), 93: " ".join(changed(prose(3, 600), 5, 5))}
    made = spark.createDataFrame([(bytes([k]), t) for k, t in texts.items()], "content binary, text string")
    maps = run_maps(packed_features(made))
    led = maps.select(*[maps[c].alias("a" if c == "content" else f"a_{c}") for c in ["content", *MAPS]])
    passed = {(r.content[0], r.a[0]) for r in maps.crossJoin(led).where(may_be_alike(0.25)).select("content", "a").collect()}
    runs = {k: weights(t) for k, t in texts.items()}
    near = {(a, b) for a in runs for b in runs if exact(runs[a], runs[b]) >= 0.8}
    assert near <= passed and len(near) > len(texts)
    assert all(exact(runs[a], runs[b]) >= 0.6 for a, b in passed)


def test_signature_estimates_probability_jaccard():
    texts = [" ".join(prose(5, 300)), " ".join(changed(prose(5, 300), 9, 8)), "a b c d e " * 40 + " ".join(prose(6, 100)), "a b c d e " * 40 + " ".join(prose(7, 100))]
    folded = [t.encode() for t in map(str.strip, texts)]
    d, h, c = shingles(folded, [len(f.split()) for f in folded])
    m = 4000
    s = signatures(d, h, c, 4, m)
    for i, j in ((0, 1), (2, 3), (0, 2)):
        want = exact(weights(texts[i]), weights(texts[j]))
        pair = [(h[d == k], c[d == k]) for k in (i, j)]
        assert abs(probability_jaccard(*pair) - want) < 1e-9
        assert abs((s[i] == s[j]).mean() - want) < 4 * np.sqrt(want * (1 - want) / m) + 1e-3


@pytest.mark.parametrize("rows", [[], [(i, f"text {i}") for i in range(21)], [(i, "same" if i % 3 else f"other {i // 2}") for i in range(200)], [(None, None), (None, None), (3, ""), (3, "x"), (3, "x")]])
def test_shards(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = assign_shards(df, 8).collect()
    counts, slots, groups = Counter(r.shard for r in got), defaultdict(list), defaultdict(set)
    assert len(got) == len(rows)
    for r in got:
        slots[r.shard].append(r.slot)
        groups[(r.text_crc32, r.size)].add(r.shard)
    full = [counts.get(s, 0) for s in range(8)]
    assert max(full) - min(full) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    quota = -(-len(rows) // 8)
    sizes = Counter((r.text_crc32, r.size) for r in got)
    for g, shards in groups.items():  # a group is in hardly more shards than it needs
        assert len(shards) <= -(-sizes[g] // max(1, quota)) + 1 or len(rows) < 16


def test_warc_round_trip(spark):
    rows = [(1, "http://a.example/x?q=1", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b.example/ü b\r\nEvil: 1", None), (4, "u", ""), (None, "http://n.example", "alone"), (5, "http://c.example", "<p>é</p>"), (5, "http://c.example", "<p>é</p>"), (6, "http://d.example", "\r\n\r\nbody\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = write_archives(df)
    caps = assemble(read_archives(manifest)).collect()
    got = Counter((c.metadata.fields.get("page-id"), c.type, c.payload_bytes, c.metadata.fields.get("refers-to-page-id")) for c in caps)
    assert got == Counter([("1", "revisit", 9, "5"), ("2", "revisit", 9, "5"), ("3", "revisit", 0, "4"), ("4", "response", 0, None), (None, "response", 5, None), ("5", "response", 9, None), ("5", "response", 9, None), ("6", "response", 10, None)])
    assert all(c.request and c.metadata and c.response.headers["Content-Length"] == str(c.payload_bytes) for c in caps)
    body = {c.metadata.fields.get("page-id"): bytes(c.response.payload) for c in caps if c.type == "response"}
    assert body["6"] == b"\r\n\r\nbody\r\n" and body["5"].decode() == "<p>é</p>"
    ids = {c.capture_id for c in caps}
    assert len(ids) == len(rows) and all(c.refers_to in ids for c in caps if c.type == "revisit")
    assert assemble(read_archives(write_archives(df.limit(0)))).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, texts = docs, {r.doc_id: r.text for r in docs.collect()}
    left = set(texts)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, sf_dir)
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == left
            break
        assert out.columns == docs.columns, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        rows = {r.doc_id: r for r in kept.collect()}
        assert len(rows) == kept.count() and set(rows) <= left and rows
        if name == "near_dedup":  # one of each group of alike documents, by brute force
            w = {d: weights(texts[d] or "") for d in left}
            for d in left - set(rows):
                assert any(exact(w[d], w[o]) >= 0.8 for o in left if o < d), d
            ids = sorted(rows)
            assert not any(w[a].keys() & w[b].keys() and exact(w[a], w[b]) >= 0.8 for a in ids for b in ids if a < b)
        if name == "pii":
            assert set(rows) == left and all(r.n_chars == len(r.text) for r in rows.values()) and not any("@mail" in r.text for r in rows.values())
        left = set(rows)


def test_entry_without_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[2]
    shutil.copytree(repo / "gambrel", tmp_path / "gambrel", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith(('op', 'pipe'))])"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": "/root", "PYTHONPATH": ""})
    assert said.returncode == 0 and said.stdout.strip().endswith("[]"), said.stderr


def test_full_shards_change_places(spark):
    """Pairs cut over shards that have no room: only an exchange joins them. A pair over a full and an open shard joins too."""
    from gambrel.llm.sharding import propagate, rooms_for

    cells = lambda rows: spark.createDataFrame(rows, "group string, shard int, n long")
    pairs = [(f"g{k}", s, 1) for k in range(20) for s in (k % 4, (k + 1 + k % 3) % 4)]
    got = propagate(cells(pairs), [10] * 4).collect()
    by, held = {}, {}
    for r in got:
        by.setdefault(r.group, []).append(r.shard)
        held[r.shard] = held.get(r.shard, 0) + r.n
    assert sum(r.n for r in got) == 40 and max(held.values()) <= 10
    assert all(len(v) == 1 for v in by.values())
    one = propagate(cells([("a", 0, 1), ("a", 1, 1), ("b", 0, 3)]), [4, 9]).collect()
    assert sorted((r.group, r.shard, r.n) for r in one) in ([("a", 0, 2), ("b", 0, 3)], [("a", 1, 2), ("b", 0, 3)]) and sum(r.n for r in one if r.shard == 0) <= 4
    assert propagate(cells([]), [1, 1]).count() == 0
    assert rooms_for({(0, 1): 5, (1, 0): 3, (2, 1): 4}, [0, 3, 9]) == {(0, 1): 5, (1, 0): 3, (2, 1): 1}
    assert rooms_for({(0, 1): 2, (1, 2): 3, (2, 0): 4}, [0, 0, 0]) == {(0, 1): 2, (1, 2): 2, (2, 0): 2}
    assert rooms_for({(0, 1): 2, (1, 2): 3}, [0, 0, 2]) == {(0, 1): 2, (1, 2): 2}


@pytest.mark.parametrize("most", [26, 15])
def test_likely_rows(spark, most, monkeypatch):
    """Rows are dropped before a join with few keys, never one of them, however small the bitmap; columns stay."""
    from gambrel.llm import near_dedup

    monkeypatch.setattr(near_dedup, "MOST_BITS", most)
    rows = spark.range(-3000, 57000).selectExpr("id", "cast(id as string) as text")
    for keys in (rows.where("id % 7 = 0").select("id"), rows.where("id < -5000").select("id"), spark.createDataFrame([(5,), (5,), ((1 << 63) - 1,)], "id long")):
        got = near_dedup.likely(rows, keys, "id")
        found, want = {r.id for r in got.collect()}, {r.id for r in rows.join(keys, "id", "left_semi").collect()}
        assert got.columns == rows.columns and want <= found and len(found) <= len(want) + (6000 if most == 26 else 30000)
        assert got.count() == len(found)
