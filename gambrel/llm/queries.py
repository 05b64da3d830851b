"""The corpus queries: each applies one operator, with production parameters, to its whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gambrel.llm.common import bounded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gambrel.llm.decontamination import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gambrel.llm.pii import PATTERNS, find_spans, span_digest

    found = find_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(span_digest(F.col("base_spans")), 256).alias("base_sha256"), span_digest(F.col("spans")).alias("spans"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gambrel.llm.token_files import read_token_files, write_token_files

    manifest = write_token_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gambrel.llm.substring_dedup import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), k=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gambrel.llm.warc import assemble, read_archives, write_archives

    captures = assemble(read_archives(write_archives(table(spark, sf_dir, "pages"))))
    return captures.select(
        F.col("metadata.fields")["page-id"].cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        F.col("metadata.fields")["refers-to-page-id"].cast("long").alias("refers_to"),
    )


def op6_assign_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gambrel.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), shards=8)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gambrel.llm.common import materialise
    from gambrel.llm.quality_rules import features, fit, score

    shaped = materialise(features(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "quality-features")
    judged = score(shaped, fit(shaped))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op8_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gambrel.llm.common import scratch
    from gambrel.llm.token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, tokenizer("word_bpe_49k.json"), scratch(spark, "token-cache"), limit=2048)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gambrel.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0, size=1024)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gambrel.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")

#: Runs of letters, and the share of (document, run) pairs that lose a letter, in op11's words.
LETTERS, SLIP = r"[A-Za-z\u00C0-\u00FF]+", 97


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gambrel.llm.spelling import group_variants, vocabulary, words_of

    words = words_of(table(spark, sf_dir, "documents"), LETTERS)
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word")))
    at = (F.col("h") % F.char_length("word")).cast("int")
    slip = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    words = words.withColumn("h", h).select(F.when(F.col("h") % SLIP == 0, slip).otherwise(F.col("word")).alias("word"))
    return group_variants(vocabulary(words)).select("word", "form", "root", "n", F.col("n_near").cast("long").alias("n_near"), "form_n")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gambrel.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(fold != 0)
    scored = score(docs, fit(docs, labels, fold == 4))
    return scored.select("doc_id", (F.coalesce(fold, F.lit(1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gambrel.llm.hard_negatives import mine, prepared

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(prepared(table(spark, sf_dir, "embeddings"), label=label))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_find_pii, op3_token_files, op4_remove_repeats, op5_warc_captures, op6_assign_shards, op7_quality_rules, op8_count_tokens, op9_pack, op10_near_duplicates, op11_spelling_variants, op12_toxicity, op13_hard_negatives)}

_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The checksum's steps for half a byte, from its polynomial.
_NIBBLES = [reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(4), k) for k in range(16)]
_PLAIN = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": f"""WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0) x),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
l AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS ws FROM p),
h AS (SELECT doc_id, i, l2.m, item_id FROM (SELECT doc_id, i, m, array_to_string(ws[1:m], ' ') AS g FROM l, (SELECT DISTINCT m FROM wins) ms WHERE len(ws) >= m) l2 JOIN wins ON wins.m = l2.m AND wins.g = l2.g),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS q FROM h) x GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op4_remove_repeats": f"""WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
l AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS ws FROM p),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws, ' ') ORDER BY doc_id, i) AS nth FROM l WHERE len(ws) = 20),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE nth > 1),
k AS (SELECT p.doc_id, count(x.i) AS n_removed, coalesce(string_agg(p.word, ' ' ORDER BY p.i) FILTER (x.i IS NULL), '') AS kept FROM p LEFT JOIN x ON p.doc_id = x.doc_id AND p.i = x.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
    "op5_warc_captures": """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p),
c AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, 5 * (k // 4) + 1, 5) AS INTEGER) >> (15 - 5 * (k % 4))) & 31) + 1, 1), '' ORDER BY k) AS digest FROM p, (SELECT CAST(unnest(range(32)) AS INTEGER) AS k) ks GROUP BY page_id)
SELECT m.page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN m.page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN m.page_id = last THEN NULL ELSE last END AS refers_to FROM m JOIN c ON c.page_id = m.page_id""",
    "op11_spelling_variants": f"""WITH RECURSIVE t AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents) x GROUP BY 1, 2),
x AS (SELECT w, c, hex(encode(CAST(doc_id AS VARCHAR) || ':' || w)) AS k FROM t),
y AS (SELECT w, c, xor(list_reduce([CAST(strpos('0123456789ABCDEF', k[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) - 1 AS BIGINT) FOR i IN range(1, length(k) + 1)], lambda a, b: xor(a >> 4, {_NIBBLES}[1 + (xor(a, b) & 15)]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM x),
z AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS w, c FROM y),
v AS (SELECT w, CAST(sum(c) AS BIGINT) AS n FROM z WHERE length(w) >= 5 GROUP BY w HAVING sum(c) >= 3),
d AS (SELECT w, i, substr(w, 1, i - 1) || substr(w, i + 1) AS d FROM (SELECT w, CAST(unnest(range(1, length(w) + 1)) AS INTEGER) AS i FROM v) u),
p AS (SELECT a.w, b.w AS o FROM d a JOIN d b ON a.i = b.i AND a.d = b.d AND a.w <> b.w UNION SELECT w, d FROM d WHERE d IN (SELECT w FROM v) UNION SELECT d, w FROM d WHERE d IN (SELECT w FROM v)),
q AS (SELECT p.w, p.o, b.n, row_number() OVER (PARTITION BY p.w ORDER BY b.n DESC, p.o) AS nth, count(*) OVER (PARTITION BY p.w) AS n_near FROM p JOIN v b ON b.w = p.o),
f AS (SELECT v.w, v.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN q.n >= 2 * v.n THEN q.o END AS form, CASE WHEN q.n >= 2 * v.n THEN q.n END AS form_n FROM v LEFT JOIN q ON q.w = v.w AND q.nth = 1),
r AS (SELECT w, w AS word, 0 AS d FROM f UNION ALL SELECT r.w, f.form, r.d + 1 FROM r JOIN f ON f.w = r.word WHERE f.form IS NOT NULL),
e AS (SELECT w, arg_max(word, d) AS root FROM r GROUP BY w)
SELECT f.w AS word, form, root, n, n_near, form_n FROM f JOIN e ON e.w = f.w""",
    "op13_hard_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS x FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_dot_product(a.x, v.x) AS BIGINT) AS score FROM v a JOIN v ON a.vec_id % 100 = 0 AND v.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same) x WHERE nth <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
}
