"""Personal data by fixed patterns and by bootstrapped contexts.

Addresses, numbers and phone numbers that fixed expressions find are seeds, as are keys that their form alone gives away.
The word, and the two words, left of a seed are lexical patterns; identifier-like tokens are instances. A pattern is
trusted as far as its instances are, an unseen instance as far as some of its patterns are, for a few rounds over the
whole graph of patterns and instances; tokens that trusted patterns introduce are added. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gambrel.functions.polygon import let
from gambrel.llm.common import materialise, quoted, shut, without

#: The four kinds, in order. Anchors and possessive repeats change nothing in what matches, only that long runs of one
#: character class are passed once: a match that fails at a run's start fails anywhere in it.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold before the expression is tried.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
CONTEXT = "context"
#: Matches that a fold places at a time.
CHUNK = 128
SPAN = "struct<start:int,rank:int,kind:string,end:int>"
#: A key by its form: 32 hexadecimal digits or more, with a letter and a figure.
KEY = r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,}$"
TOKENS = "array<struct<start:int,end:int,value:string,left:array<string>>>"
ADDED = ("base_spans", "found_spans", "spans")


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap: array of (start, end, value, gap), in code points; gap is the text before.

    The text between matches and the matches themselves are two arrays; a fold over their lengths places them. A fold that
    appends copies what it has, so it works on CHUNK matches at a time, each chunk from 0 on, and a fold over the chunks'
    lengths moves them.
    """
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    one = "array<struct<start:int,end:int,value:string,gap:string>>"
    none = F.struct(F.lit(0).alias("at"), F.array().cast(one).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["g"])
        end = start + F.char_length(p["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["m"].alias("value"), p["g"].alias("gap")))).alias("out"))

    def move(acc: Column, c: Column) -> Column:
        return F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["before"], F.array(acc["at"])).alias("before"))

    def placed(chunks: Column) -> Column:
        before = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before")), move)["before"]
        by = lambda c, n: F.transform(c["out"], lambda m: F.struct((m["start"] + n).alias("start"), (m["end"] + n).alias("end"), m["value"].alias("value"), m["gap"].alias("gap")))
        return F.flatten(F.zip_with(chunks, before, by))

    def chunked(p: Column) -> Column:
        starts = F.when(F.size(p) > 0, F.sequence(F.lit(1), F.size(p), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(starts, lambda i: F.aggregate(F.slice(p, i, CHUNK), none, step)), placed)

    # the last gap has no match behind it
    return let(F.filter(pairs, lambda p: p["m"].isNotNull()), chunked)


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    digits = F.regexp_replace(value, "[^0-9]+", "")
    size = F.char_length(digits)
    if kind == "card":
        return F.when(size.between(12, 19), luhn(digits)).otherwise(False)
    return size.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, numeric: Column) -> Column:
    """Spans of the four kinds by start, then kind. ``numeric``: whether the text has a digit."""

    def of(rank: int, kind: str) -> Column:
        found = F.filter(matches(text, PATTERNS[kind]), lambda m: holds(kind, m["value"]))
        spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")))
        may = F.lit(True) if kind == "email" else numeric
        may = may & F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else may
        return F.when(may, spans).otherwise(F.array().cast(f"array<{SPAN}>"))

    kinds = [of(rank, kind) for rank, kind in enumerate(PATTERNS)]
    return F.sort_array(F.concat(*kinds))


def tokens(text: Column, some: Column) -> Column:
    """Identifier-like tokens: words with a figure or an @, less the signs around them, of four characters or more.

    Each with its patterns: the word to its left, and the two words to its left, in lower case with figures as 0. Words
    are looked for from the token before it on; a token with none there has no pattern and is left out.
    """

    def one(found: Column, m: Column, i: Column) -> Column:
        lead = F.char_length(F.regexp_extract(m["value"], r"^[\"'(\[{<|]*", 0))
        bare = F.regexp_replace(F.regexp_replace(m["value"], r"^[\"'(\[{<|]+", ""), r"[\"')\]}>.,;:!?|#$%&*]+$", "")
        before = F.concat(F.coalesce(F.get(found, i - 1)["value"], F.lit("")), m["gap"])
        back = F.slice(F.reverse(F.filter(F.split(F.regexp_replace(F.lower(before), "[0-9]+", "0"), r"\s+"), lambda w: w != "")), 1, 2)
        left = F.when(F.size(back) == 2, F.array(F.get(back, F.lit(0)), F.array_join(F.reverse(back), " "))).otherwise(back)
        start = m["start"] + lead
        return F.struct(start.alias("start"), (start + F.char_length(bare)).alias("end"), bare.alias("value"), left.alias("left"))

    every = let(matches(text, TOKEN), lambda found: F.transform(found, lambda m, i: one(found, m, i)))
    kept = F.filter(every, lambda t: (F.char_length(t["value"]) >= 4) & (F.size(t["left"]) > 0))
    return F.when(some, kept).otherwise(F.array().cast(TOKENS))


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add base_spans and tokens, each inside its row."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    out = without(docs, ["base_spans", "tokens", "__numeric"]).withColumn("__numeric", F.rlike(text, F.lit("[0-9]")))
    out = out.withColumn("base_spans", base_spans(text, F.col("__numeric")))
    return out.withColumn("tokens", tokens(text, F.col("__numeric") | F.contains(text, F.lit("@")))).drop("__numeric")


def instances(found: DataFrame, keys: list[str]) -> DataFrame:
    """A row a token and pattern: keys, start, end, value, left, known, seed.

    ``known``: a base span covers part of the token, which so is no find. Known tokens and keys by form are seeds.
    """
    one = lambda name: found.where(F.size(name) > 0).select(*keys, F.explode(name).alias("t"))
    tokens_ = one("tokens").select(*keys, F.col("t.end").alias("at"), F.lit(0).alias("side"), "t.start", "t.end", "t.value", "t.left")
    base = one("base_spans").select(*keys, F.col("t.start").alias("at"), F.lit(1).alias("side"), "t.start", "t.end", F.lit(None).cast("string").alias("value"), F.lit(None).cast("array<string>").alias("left"))
    # of the base spans that start before a token ends, one that ends after its start covers part of it
    before = Window.partitionBy(*keys).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, -1)
    known = F.coalesce(F.max(F.when(F.col("side") == 1, F.col("end"))).over(before) > F.col("start"), F.lit(False))
    rows = tokens_.unionByName(base).withColumn("known", known).where("side = 0")
    rows = rows.select(*keys, "start", "end", "value", F.explode("left").alias("left"), "known")
    return rows.withColumn("seed", F.col("known") | F.rlike("value", F.lit(KEY)))


def bootstrap(found: DataFrame, rounds: int = 3, trust: float = 0.6, seeds: int = 3) -> DataFrame:
    """Trusted patterns: (left, confidence), from all rows of ``instances``.

    An instance is a distinct value. A seed's score is 1; any other's is 1 less the product of its patterns' doubts. A
    pattern's confidence is the sum of its instances' scores over their number plus one. A pattern is trusted from
    ``trust`` on, if at least ``seeds`` distinct seeds show it.
    """
    edges = found.groupBy("left", F.lower("value").alias("value")).agg(F.max("seed").alias("seed"))
    edges = edges.withColumn("score", F.col("seed").cast("double"))
    confidence = lambda e: e.groupBy("left").agg((F.sum("score") / (F.count(F.lit(1)) + 1)).alias("confidence"), F.count_if("seed").alias("n_seeds"))
    for _ in range(rounds):
        edges = materialise(edges, "pii-edges")
        doubt = edges.join(confidence(edges), "left").groupBy("value").agg(F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999))))).alias("doubt"), F.max("seed").alias("known"))
        edges = edges.drop("score").join(doubt, "value").select("left", "value", "seed", F.when(F.col("known"), 1.0).otherwise(1 - F.col("doubt")).alias("score"))
    return confidence(edges).where((F.col("confidence") >= trust) & (F.col("n_seeds") >= seeds)).select("left", "confidence")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row a document: doc_id, row_digest (md5 of the text), base_spans, found_spans and spans (both, by start, then
    kind). Texts are read once, whole; what is found in them is written, then patterns are scored over all of it.

    Null texts are empty and have no spans. Repeated rows get the same spans and count once for the patterns. Null ids are
    an id like others. Other columns are not returned. An empty table gives no rows.
    """
    source = docs.select(quoted(id_col).alias("doc_id"), F.unhex(F.md5(F.coalesce(quoted(text_col), F.lit("")))).alias("row_digest"), quoted(text_col).alias("text"))
    found = materialise(detect(source).select("doc_id", "row_digest", "base_spans", "tokens"), "pii-found")
    rows = instances(found, ["doc_id", "row_digest"]).distinct()
    trusted = bootstrap(rows, **settings)
    span = F.struct("start", F.lit(len(PATTERNS)).alias("rank"), F.lit(CONTEXT).alias("kind"), "end")
    new = rows.where("not known").join(trusted, "left").groupBy("doc_id", "row_digest").agg(F.sort_array(F.collect_set(span)).alias("found_spans"))
    new = new.withColumn("__id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).drop("doc_id")
    full = found.drop("tokens").withColumn("__id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).join(new, ["__id", "row_digest"], "left").drop("__id")
    full = full.withColumn("found_spans", F.coalesce("found_spans", F.array().cast(f"array<{SPAN}>")))
    return full.withColumn("spans", F.sort_array(F.concat("base_spans", "found_spans")))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span as its kind in brackets; spans that overlap an earlier one lengthen it."""
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        mark = F.concat(F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.when(fresh, mark).otherwise(F.lit(""))).alias("out"))

    end = F.aggregate(spans, none, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(end["out"], F.substring(text, end["at"] + 1, F.char_length(text))))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents with personal data in ``text_col`` replaced by its kind; all rows and columns stay, whatever their
    names: a row travels as one struct.

    Null texts stay null. Repeated rows get the same answer. Only rows with spans are joined back by (id, digest).
    """
    spans = find_spans(docs, id_col, text_col, **settings).where(F.size("spans") > 0).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("row_digest").alias("digest"), "spans")
    spans = spans.dropDuplicates(["id", "digest"])
    keyed = shut(docs).select("row", F.coalesce(quoted(id_col).cast("string"), F.lit("")).alias("id"), F.unhex(F.md5(F.coalesce(quoted(text_col), F.lit("")))).alias("digest"))
    text = F.col("row").getField(text_col)
    new = F.when(F.col("spans").isNull(), text).otherwise(redacted(text, F.col("spans")))
    joined = keyed.join(spans, ["id", "digest"], "left")
    return joined.select(*[(new if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])


def span_digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
