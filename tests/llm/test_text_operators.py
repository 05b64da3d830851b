"""Operators that work text by text, against plain Python."""

from __future__ import annotations

import itertools
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gambrel.llm import substring_dedup as S
from gambrel.llm.decontamination import decontaminate, words_of
from gambrel.llm.encoding import Encoder
from gambrel.llm.packing import Packer, merge_windows, pack
from gambrel.llm.pii import bootstrap, find_spans, instances, detect, redact
from gambrel.llm.quality_rules import features, fit, judge_quality, keep_good
from gambrel.llm.queries import tokenizer
from gambrel.llm.token_counts import count_tokens
from gambrel.llm.token_files import read_token_files, write_token_files

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
SCHEMA = "doc_id long, text string, N_WORDS string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty, long, repeated, shared passages, and an extra column whose name clashes."""
    passage = prose(7, 60)
    rows = [(1, prose(1, 80)), (2, None), (3, ""), (4, " \n\t "), (5, prose(5, 30) + " " + passage), (6, passage + " " + prose(6, 30)), (7, prose(8, 9000)), (8, "Ünï cödé 日本 <|endoftext|> x  y\n\nz"), (None, "no id here at all"), (9, "short"), (9, "short")]
    return spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, docs, none, rows, block_bytes):
    items = [(1, prose(7, 20).upper()), (2, prose(7, 20)), (10, "no id here"), (3, None), (4, "..."), (None, prose(1, 13)), (5, prose(99, 40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(docs, bench, block_bytes=block_bytes)
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        m = min(13, len(w))
        for a in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[a : a + m])] |= {item} - {None}
    want = []
    for doc, text in rows:
        w, hit, found = words_of(text), set(), set()
        for g, owners in windows.items():
            for a in range(len(w) - len(g) + 1):
                if tuple(w[a : a + len(g)]) == g:
                    hit |= set(range(a, a + len(g)))
                    found |= owners
        want.append((doc, len(w), len(hit), sorted(map(str, found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    key = lambda t: (t[0] is None, t)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in got.collect()), key=key) == sorted(want, key=key)
    assert any(w[4] for w in want) and got.columns.count("n_words") == 1 and "N_WORDS" not in got.columns
    assert decontaminate(none, bench).count() == 0
    assert not decontaminate(docs, bench.limit(0)).where("contaminated").count()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(rows, name):
    e = Encoder(tokenizer(name))
    r, signs = random.Random(4), "abzé Üñ.,;:!?'\n\t\r  \"%*$#&|<>-_/\\0123456789日本ʼßſİǅªº²½\u0301\u200d💥()[]{}@^`~ABCst"
    parts = ["don't", "a,b.", "x's", "of%%%", "\nWas", "\tÜber.", "é.é,", "it's.", "ab''s", "'s", "A1.", "ß!", "ª.", "_a_"]
    rows = rows + [(0, "".join(r.choice(signs) for _ in range(r.randrange(60)))) for _ in range(1500)] + [(0, " ".join(r.choice(parts) for _ in range(9))) for _ in range(200)]
    odd = [" a  b\n\nc ", "\n", "  ", "a,b. c.", "tab\tx\r\ny", "don't they're 12,5", "é.é,", "\x1f x", "é ́x", " x y", "x" * 300 + ". y", "İstanbul, Straße."]
    for text in [t for _, t in rows] + odd:
        ids = e.tok.encode(text, add_special_tokens=False).ids
        if name.startswith("byte"):
            assert np.frombuffer(e.encode(text), e.dtype).tolist() == ids, text[:40]
        else:
            assert e.count(text) == len(ids), text[:40]


def test_words_in_use_are_encoded_once(monkeypatch):
    """However many words a worker meets, one that every text has stays in its table."""
    asked: Counter = Counter()
    word = Encoder._word
    monkeypatch.setattr("gambrel.llm.encoding.MEMO_CHUNKS", 100)
    monkeypatch.setattr(Encoder, "_word", lambda self, gap, text: asked.update([text]) or word(self, gap, text))
    e = Encoder(tokenizer("byte_bpe_50k.json"))
    new = iter("".join(x) for x in itertools.product("abcdefgh", repeat=4))
    for _ in range(40):
        text = " ".join(["one", *itertools.islice(new, 20), "often", "often,"])
        assert np.frombuffer(e.encode(text), e.dtype).tolist() == e.tok.encode(text, add_special_tokens=False).ids
    assert asked["often"] == 1 and len(e.packed) <= 100


def test_token_files(docs, none, rows):
    path = tokenizer("byte_bpe_50k.json")
    manifest = write_token_files(docs, path, end_id=2)
    got = {(r.doc_id, r.start): np.frombuffer(r.ids, "<u4").tolist() for r in read_token_files(manifest).collect()}
    lib, start, want = Encoder(path).tok, 0, {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*lib.encode(text, add_special_tokens=False).ids, 2]
        want[(doc, start)] = ids
        start += len(ids)
    assert got == want
    some = read_token_files(manifest, {5, 7}).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in some} == {k[0]: v for k, v in want.items() if k[0] in (5, 7)}
    assert read_token_files(write_token_files(none, path, 2)).count() == 0


def test_damaged_frame_is_found(docs):
    from gambrel.llm.token_files import FileReader

    path = write_token_files(docs.where("doc_id = 1").coalesce(1), tokenizer("byte_bpe_50k.json"), 2).first().path
    data = bytearray(open(path, "rb").read())
    data[12] ^= 1

    class Source:
        def __init__(self, data):
            self.data, self.at = bytes(data), 0

        def size(self):
            return len(self.data)

        def seek(self, at):
            self.at = at

        def read(self, n):
            return self.data[self.at : self.at + n]

    with pytest.raises(Exception):
        list(FileReader(Source(data)).documents())


def test_token_counts(docs, none, rows, tmp_path):
    path, cache = tokenizer("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    lib = Encoder(path).tok
    want = Counter((d, len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for d, t in rows)
    counted = lambda: Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in count_tokens(docs, path, cache).collect())
    assert counted() == want
    stored = docs.sparkSession.read.parquet(cache).count()
    assert stored == len({re.sub(r"[ \t\n\r]+", " ", t).strip(" ") for _, t in rows})
    assert counted() == want and docs.sparkSession.read.parquet(cache).count() == stored
    assert count_tokens(none, path, cache).count() == 0


@pytest.mark.parametrize("hot, slots", [(S.HOT, S.MOST_SLOTS), (0.0, S.MOST_SLOTS), (S.HOT, 16)])
def test_substring_dedup(spark, docs, none, rows, hot, slots, monkeypatch):
    """Few hot minimisers, all of them hot, and a table of slots too small for the load."""
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "MOST_SLOTS", slots)
    rows = [(d if d is not None else S._LAST, t) for d, t in rows]
    seen, want = {}, []
    for d, t in sorted(rows, key=lambda r: r[0]):
        w, gone = t.split(), set()
        for a in range(len(w) - 19):
            first = seen.setdefault(tuple(w[a : a + 20]), (d, a))
            if first != (d, a):
                gone |= set(range(a, a + 20))
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = S.remove_repeats(docs, part_bytes=4096)
    assert sorted((r.doc_id if r.doc_id is not None else S._LAST, r.n_words, r.n_removed, r.kept_text) for r in got.collect()) == sorted(want)
    assert sum(w[2] for w in want) >= 60 and S.remove_repeats(none).count() == 0


def test_equal_hashes_are_compared(monkeypatch):
    monkeypatch.setattr(S, "window_hashes", lambda h, k: np.zeros(len(h) - k + 1, np.uint64))
    one = lambda *a: np.array(a, np.int64)
    found = S.repeats(one(1, 2, 3), one(0, 0, 0), one(0, 0, 5), one(2, 2, 1), [b"a b c", b"b c d", b"c d"], 2)
    assert [x.tolist() for x in found] == [[2, 3], [0, 0], [0, 5], [1, 1]]


def pieces_hold(rows, got, size):
    lib = Encoder(tokenizer("byte_bpe_50k.json")).tok
    left = Counter()
    for d, t in rows:
        left[(d, tuple([*lib.encode(t, add_special_tokens=False).ids, 0]))] += 1
    made = defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and r.length > 0
        made[r.doc_id].append(r)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(seqs) == list(range(len(seqs)))
    for d, parts in made.items():
        if len({id_ for id_, _ in left if id_ == d}) and sum(n for (i, _), n in left.items() if i == d) == 1:
            ids, at = [], 0
            for r in sorted(parts, key=lambda r: r.start):
                assert r.start == at
                ids += np.frombuffer(r.ids, "<u4").tolist()
                at += r.length
            assert left[(d, tuple(ids))] == 1 and parts[0].doc_tokens == len(ids)
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in left.items())
    return seqs


def test_packing(spark, docs, none, rows):
    many = docs.unionByName(spark.createDataFrame([(100 + i, prose(i, 5 + 37 * i % 400), "x") for i in range(60)], SCHEMA)).repartition(5, "text")
    got = pack(many, tokenizer("byte_bpe_50k.json"), size=256, windows=4).collect()
    seqs = pieces_hold([(r.doc_id, r.text or "") for r in many.collect()], got, 256)
    assert sum(n for s in seqs.values() for _, n in s) > 0.9 * 256 * len(seqs)
    assert pack(none, tokenizer("byte_bpe_50k.json")).count() == 0


def test_decontamination_is_one_python_map(spark, docs):
    """Each map in a row takes a worker a core, which stays for the stages behind."""
    bench = spark.createDataFrame([(k, prose(k, 20)) for k in range(8)], "item_id long, text string")
    for block_bytes in (1 << 20, 300):
        plan = decontaminate(docs, bench, block_bytes=block_bytes)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1


def test_open_windows_keep_no_whole_documents():
    for windows, docs in ((2, [1003]), (1, [5, 2006, 4])):  # a rest, and a cut that fills a window
        p = Packer(8, windows, 1)
        for d, n in enumerate(docs):
            for _ in p.add(d, np.arange(n, dtype="<u4")):
                pass
            assert p.held and all(ids.base is None for w in p.held for _, _, ids, _ in w)


def test_slices_end_by_giving_back(monkeypatch):
    from gambrel.llm import common

    given, batch = [], pa.record_batch({"t": ["a"] * 600})
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    slices = common.byte_slices(iter([batch]), 0)
    assert [next(slices).num_rows for _ in range(3)] == [256, 256, 88] and not given
    assert next(slices, None) is None and given == [1] and not [*common.byte_slices(iter([]), 0)]


def test_merge_windows_keeps_every_id():
    r = random.Random(3)
    pieces = [((p, w, n), r.randrange(1, 100)) for p in range(6) for w in range(3) for n in range(r.randrange(1, 4))]
    out = merge_windows(pieces, 300, 10)
    by = defaultdict(list)
    for key, cut, take, _, _ in out:
        by[key].append((cut, take))
    for key, length in pieces:
        at = 0
        for cut, take in sorted(by[key]):
            assert cut == at and take > 0
            at += take
        assert at == length


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


PII = "mail a@b.com, x.y@c-d.org. 10.0.0.1 and 300.1.1.1 00001.2.3.4 4111 1111 1111 1111 or 4111111111111112 +1 (504) 555-2652 +12 3 éa@é.fr a.b@c@d.ef @ 1.2.3.4.5.6.7.8 +++1--------9 "


DIGITS = lambda m: re.sub("[^0-9]", "", m)
KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(DIGITS(m)) <= 19 and luhn(DIGITS(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(DIGITS(m)) <= 15),
]


def plain_spans(text: str) -> list[tuple]:
    """(start, rank, kind, end) by the plain expressions of the contract."""
    return sorted((m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(KINDS) for m in re.finditer(p, text) if ok(m.group()))


def test_base_pii(spark):
    texts = [PII, None, "", "x" * 50_000 + "@", "1" * 30_000, "a" * 20_000 + "1 b@c.de", PII, "é日 +44 20 7946 0958", "1-2 " * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in find_spans(df).collect():
        text = texts[r.doc_id] or ""
        shift = 0
        if len(text) > 20_000 and "@" in text:  # the plain expression is quadratic there
            text = re.sub(r"^[ax]{10000,}", "", text)
            shift = len(texts[r.doc_id]) - len(text)
        want = [(a + shift, k, kind, b + shift) for a, k, kind, b in plain_spans(text)]
        assert [(s.start, s.rank, s.kind, s.end) for s in r.base_spans] == want, r.doc_id


def test_many_tokens_in_one_text(spark):
    """A table of figures: the cost of a text is in proportion to its tokens, and all of them are placed."""
    rows = [f"row{i} 10.0.{i % 256}.{i % 200} x{i}@y.org +1 (555) 100-{1000 + i} end" for i in range(5000)]
    df = spark.createDataFrame([(1, "\n".join(rows))], "doc_id long, text string")
    began = time.time()
    r = find_spans(df).first()
    took = time.time() - began
    assert [(s.start, s.rank, s.kind, s.end) for s in r.base_spans] == plain_spans("\n".join(rows)) and len(r.base_spans) == 15_000
    assert took < 60


def test_contexts_find_unseen_identifiers(spark):
    seeds = [(i, f"please write to user at mail{i}@site.com today") for i in range(6)]
    unseen = [(10, "please write to user at mail10_site.com today"), (11, "the year 1999 was long")]
    df = spark.createDataFrame(seeds + unseen, "doc_id long, text string")
    trusted = bootstrap(instances(detect(df), ["doc_id"]))
    assert sorted(r.left for r in trusted.collect()) == ["at", "user at"]
    spans = {r.doc_id: r for r in find_spans(df).collect()}
    assert [df.where("doc_id = 10").first().text[s.start : s.end] for s in spans[10].found_spans] == ["mail10_site.com"]
    assert not spans[11].spans and all(len(spans[i].base_spans) == 1 and not spans[i].found_spans for i in range(6))
    clean = {r.doc_id: r.text for r in redact(df).collect()}
    assert clean[0] == "please write to user at [EMAIL] today" and clean[10] == "please write to user at [CONTEXT] today" and clean[11] == unseen[1][1]
    again = spark.createDataFrame([(1, None), (None, "a@b.com 1.1.1.1"), (None, "a@b.com 1.1.1.1")], "doc_id long, text string")
    assert sorted(r.text or "" for r in redact(again).collect()) == ["", "[EMAIL] [IP]", "[EMAIL] [IP]"]
    assert redact(again.limit(0)).count() == 0


def test_found_spans_against_plain_python(spark, sf_dir):
    """Patterns, scores and spans of all texts, from the base spans on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    more = [(9000 + i, f'ask with token = "{i:08x}{"ab12" * 6}" or code {i}9{"0a" * 3}; call +1 (555) 100-200{i}') for i in range(4)] + [(9100, 'token = "9f-unseen" (555) 777-8888')]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    texts, found = {r.doc_id: r.text or "" for r in docs.collect()}, {r.doc_id: r for r in find_spans(docs).collect()}
    seen, graph = [], defaultdict(dict)
    for d, text in texts.items():
        before = 0, ""
        for m in re.finditer(r"(?<!\S)\S*[0-9@]\S*", text):
            value = m[0].lstrip("\"'([{<|")
            start = m.end() - len(value)
            value = value.rstrip("\"')]}>.,;:!?|#$%&*")
            words = re.sub("[0-9]+", "0", (before[1] + text[before[0] : m.start()]).lower()).split()
            before = m.end(), m[0]
            if len(value) < 4 or not words:
                continue
            known = any(s.start < start + len(value) and s.end > start for s in found[d].base_spans)
            key = bool(re.fullmatch("[0-9a-f]{32,}", value) and re.search("[a-f]", value) and re.search("[0-9]", value))
            for p in {words[-1], " ".join(words[-2:])}:
                seen.append((d, start, start + len(value), p, known))
                graph[p][value.lower()] = graph[p].get(value.lower(), False) or known or key
    seed = defaultdict(bool)
    for values in graph.values():
        for v, is_seed in values.items():
            seed[v] |= is_seed
    score = {(p, v): float(s) for p, values in graph.items() for v, s in values.items()}
    for _ in range(3):
        sure = {p: sum(score[p, v] for v in values) / (len(values) + 1) for p, values in graph.items()}
        doubt = defaultdict(lambda: 1.0)
        for p, v in score:
            doubt[v] *= 1 - min(sure[p], 0.999)
        score = {(p, v): 1.0 if seed[v] else 1 - doubt[v] for p, v in score}
    trusted = {p for p, values in graph.items() if sum(values.values()) >= 3 and sum(score[p, v] for v in values) / (len(values) + 1) >= 0.6}
    want = defaultdict(set)
    for d, start, end, p, known in seen:
        if p in trusted and not known:
            want[d].add((start, end))
    assert "token =" in trusted and "(0)" in trusted and any(texts[9100][a:b] == "9f-unseen" for a, b in want[9100])
    assert {d: sorted((s.start, s.end) for s in r.found_spans) for d, r in found.items() if r.found_spans} == {d: sorted(v) for d, v in want.items() if v}


def test_quality_model_against_plain_python(spark, sf_dir):
    from gambrel.llm.quality_rules import rules, score, voted

    shaped = features(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    names = list(rules())
    votes = np.array([[r[f"__vote_{n}"] for n in names] for r in voted(shaped).orderBy("doc_id").collect()])
    prior, good, bad = 0.7, np.full(len(names), 0.9), np.full(len(names), 0.4)

    def posterior():
        odds = np.full(len(votes), np.log(prior / (1 - prior)))
        for j in range(len(names)):
            odds += np.where(votes[:, j] == 1, np.log(good[j] / bad[j]), np.where(votes[:, j] == -1, np.log((1 - good[j]) / (1 - bad[j])), 0))
        return 1 / (1 + np.exp(-odds))

    for _ in range(30):
        w = posterior()
        new = [np.array([(c[votes[:, j] == 1].sum() + 2 * first) / (c[votes[:, j] != 0].sum() + 2) for j in range(len(names))]).clip(0.001, 0.999) for c, first in ((w, 0.9), (1 - w, 0.4))]
        share = min(0.99, max(0.01, (w.sum() + 1.4) / (len(w) + 2)))
        moved = max(abs(share - prior), (abs(new[0] - good) + abs(new[1] - bad)).max())
        prior, (good, bad) = share, new
        if moved < 1e-4:
            break
    model = fit(shaped)
    assert abs(model.prior - prior) < 1e-9 and max(abs(model.on_good[n] - good[j]) + abs(model.on_bad[n] - bad[j]) for j, n in enumerate(names)) < 1e-9
    got = [r.quality for r in score(shaped, model).orderBy("doc_id").collect()]
    assert np.abs(np.array(got) - posterior()).max() < 1e-9


def test_quality_features(docs, none, rows):
    more = docs.unionByName(docs.sparkSession.createDataFrame([(50, "a b c a b c a\na b\nx\n\na b\n \n \n#*$|", ""), (51, "a a a a a", "")], SCHEMA))
    want = []
    for doc, text in [*rows, (50, "a b c a b c a\na b\nx\n\na b\n \n \n#*$|"), (51, "a a a a a")]:
        w = re.findall("[^\x20\x09-\x0D]+", text)
        runs, cover = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if runs[tuple(w[i : i + 3])] > 1:
                cover |= {i, i + 1, i + 2}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
        want.append((doc, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)))
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in features(more).collect()]
    key = lambda t: (t[0] is None, t)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert judge_quality(none).count() == 0


def test_quality_on_labelled_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    judged = judge_quality(docs.select("doc_id", "text")).select("doc_id", "base_failed", "kept").collect()
    good = [r.kept for r in judged if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in judged if labels.get(r.doc_id) == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)
    assert keep_good(docs).columns == docs.columns
    assert fit(features(docs.select("text"))).prior > 0.5


def test_contexts_of_any_width(spark):
    from gambrel.llm.pii import detect

    label = "w" * 100
    df = spark.createDataFrame([(0, "Customer Code" + " " * 90 + "AB12345"), (1, f"the {label}\n\tAB12345"), (2, "   AB12345"), (3, "code AB12345 and CD67890")], "doc_id int, text string")
    got = {r.doc_id: [t.left for t in r.tokens] for r in detect(df).collect()}
    assert got == {0: [["code", "customer code"]], 1: [[label, f"the {label}"]], 2: [], 3: [["code"], ["and", "ab0 and"]]}
