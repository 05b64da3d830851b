"""Near-duplicate detection by ProbMinHash signatures, banding and exact verification.

A document is the multiset of its runs of five words; a run's weight is its count. Each weighted run is a Poisson process
whose arrivals fall on random registers, and a register keeps the run that arrives first, so two documents agree in a
register with their probability Jaccard similarity. Runs whose next arrival is later than every register's stop early.
Bands of equal registers name candidates; candidates are verified on their whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from gambrel.llm.common import byte_slices, materialise, quoted, scratch, shut
from gambrel.llm.decontamination import words_of
from gambrel.llm.substring_dedup import _mix, window_hashes, word_hashes
from gambrel.operators.components import components

SHINGLE, ALIKE = 5, 0.8
#: 25 bands of 5: a pair of similarity 0.8 shares none with a chance of 5 in 100,000.
BANDS, ROWS = 25, 5
#: Rows and bytes of text whose signatures are made together.
BLOCK_ROWS, BLOCK_BYTES = 1024, 2 << 20
#: Members of a bucket for which one copy of a leader's features is sent; members ranked in one task.
MEMBERS_A_COPY, MEMBERS_A_TASK = 256, 4096
#: Rows of runs that a task sends at a time.
ROWS_OUT = 1 << 16
#: Leaders of a bucket in its first, second, ... round; the last is repeated.
LEADERS = (1, 2, 16, 128, 1024)
#: Words of 64 bits of a content's map of runs.
MAP_WORDS = 16
MAPS = [*(f"m{k}" for k in range(MAP_WORDS)), "marks", "weight"]
#: Bits of a bitmap for each key, and the most bits of all, as a power of two (8 MB).
BITS_A_KEY, MOST_BITS = 32, 26
_BLOCK = 1 << 15  # bits of a value of bitmap_construct_agg
_STEP = np.uint64(0xD1342543DE82EF95)
_LAST = (1 << 63) - 1


def shingles(folded: list[bytes], counts: list[int], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of the runs of ``size`` words of space-joined texts, by document and hash.

    A document of fewer words, but not none, has one run of all its words.
    """
    import xxhash

    short = [(d, xxhash.xxh64_intdigest(folded[d])) for d, n in enumerate(counts) if 0 < n < size]
    data = b" ".join(folded[d] for d, n in enumerate(counts) if n >= size)
    docs, hashes = np.array([d for d, _ in short], np.int64), np.array([h for _, h in short], np.uint64)
    if data:
        owner = np.repeat(np.arange(len(counts)), [n if n >= size else 0 for n in counts])
        h = window_hashes(word_hashes(data)[2], size)
        inside = owner[: len(h)] == owner[size - 1 :]
        docs, hashes = np.concatenate((docs, owner[: len(h)][inside])), np.concatenate((hashes, h[inside]))
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return docs[at], hashes[at], np.diff(np.append(at, len(docs)))


def signatures(docs: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, m: int) -> np.ndarray:
    """``m`` registers for each of ``n`` documents: the element of the first arrival, by independent Poisson processes."""
    first = np.full(n * m, np.inf)
    kept = np.zeros(n * m, np.uint64)
    weights = weights.astype(float)
    alone = np.bincount(docs, minlength=n) == 1  # one element takes every register
    lone = alone[docs]
    kept.reshape(n, m)[docs[lone]] = hashes[lone][:, None]
    docs, hashes, weights = docs[~lone], hashes[~lone], weights[~lone]
    time, seed = np.zeros(len(docs)), hashes.copy()
    while len(docs):
        seed = _mix(seed + _STEP)
        time = time - np.log(((seed >> np.uint64(11)).astype(float) + 1.0) * 2.0**-53) / weights
        at = docs * m + (_mix(seed ^ _STEP) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        kept[at[won]] = hashes[won]
        go = time < first.reshape(n, m).max(axis=1)[docs]
        docs, hashes, weights, time, seed = docs[go], hashes[go], weights[go], time[go], seed[go]
    return kept.reshape(n, m)


def bands_of(kept: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(kept), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(kept), b + 1, np.uint64)
        for r in range(rows):
            h = _mix(h * _STEP + kept[:, b * rows + r])
        out[:, b] = h
    return out


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sorted (hash, count) pairs: the sum over shared i of 1 / sum over j of max(x_j / x_i, y_j / y_i)."""
    (ha, ca), (hb, cb) = a, b
    at = np.searchsorted(hb, ha)
    shared = np.zeros(len(ha), bool)
    inside = at < len(hb)
    shared[inside] = hb[at[inside]] == ha[inside]
    x, y = ca[shared].astype(float), cb[at[shared]].astype(float)
    if not len(x):
        return 0.0
    only_x, only_y = ca.sum() - x.sum(), cb.sum() - y.sum()
    if x.max() == y.max() == 1:  # all shared runs weigh alike
        return float(len(x) / (len(x) + only_x + only_y))
    codes, times = np.unique(x + 1j * y, return_counts=True)
    px, py = codes.real, codes.imag
    below = np.maximum(px[None, :] / px[:, None], py[None, :] / py[:, None]) @ times + only_x / px + only_y / py
    return float((times / below).sum())


_SIGNED = StructType([StructField("doc_id", LongType()), StructField("row_digest", BinaryType()), StructField("content", BinaryType()), StructField("bands", ArrayType(LongType()))])


def sign(rows: DataFrame, bands: int, per_band: int) -> DataFrame:
    """``rows`` (doc_id, row_digest, text) to (doc_id, row_digest, content digest of the folded words, band hashes)."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in byte_slices(batches, 2, BLOCK_ROWS, BLOCK_BYTES):
            folded = [b" ".join(words_of(t)) for t in some.column(2).to_pylist()]
            content = [xxhash.xxh3_128_digest(f) if f else None for f in folded]
            seen: dict[bytes, int] = {}
            which = [seen.setdefault(f, len(seen)) for f in folded]  # equal texts of a block are signed once
            texts = list(seen)
            found = shingles(texts, [t.count(b" ") + 1 if t else 0 for t in texts])
            made = bands_of(signatures(*found, len(texts), bands * per_band), bands, per_band).view(np.int64)[which]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(folded) + 1, dtype=np.int32) * bands), pa.array(made.reshape(-1)))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(content, pa.binary()), lists], names=_SIGNED.names)

    return rows.mapInArrow(run, _SIGNED)


def packed_features(texts: DataFrame) -> DataFrame:
    """(content, text) to (content, runs, counts): the sorted hashes of the runs and their counts, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in byte_slices(batches, 1, BLOCK_ROWS, BLOCK_BYTES):
            words = [words_of(t) for t in some.column(1).to_pylist()]
            d, h, c = shingles([b" ".join(w) for w in words], [len(w) for w in words])
            at = np.searchsorted(d, np.arange(len(words) + 1)).tolist()
            h, c = h.astype("<u8"), c.astype("<u4")
            cols = [[x[i:j].tobytes() for i, j in zip(at, at[1:])] for x in (h, c)]
            yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(x, pa.binary()) for x in cols)], names=["content", "runs", "counts"])

    return texts.mapInArrow(run, "content binary, runs binary, counts binary")


def likely(rows: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    """``rows`` less most of those whose ``col`` is none of ``keys``, to be joined with them: long rows then stay where they are.

    The keys' hashes are marked in a bitmap that has an upper size and is broadcast; too many keys for it let more rows through.
    Columns _block, _bit and _bits are its own.
    """
    log_bits = min(MOST_BITS, max(15, (BITS_A_KEY * keys.count()).bit_length()))
    place = F.pmod(F.xxhash64(col), F.lit(1 << log_bits))
    block, bit = (place / _BLOCK).cast("int"), (place % _BLOCK).cast("int")
    marks = keys.select(block.alias("_block"), bit.alias("_bit")).groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    found = rows.withColumns({"_block": block, "_bit": bit}).join(F.broadcast(marks), "_block")
    return found.where("shiftright(cast(conv(hex(substring(_bits, _bit div 8 + 1, 1)), 16, 10) as int), _bit % 8) % 2 = 1").select(rows.columns)


def verify(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """(p, q, leader, member, n, leader_comp, member_comp) with the probability Jaccard similarity of the whole texts.

    ``n`` says how many members the leader may meet. A copy of its features goes to every MEMBERS_A_COPY of them, ahead of
    the members, so the pairs of one leader are spread over tasks and its features are sent once a copy.
    """
    copies = F.ceil(F.col("n") / MEMBERS_A_COPY).cast("int")
    led = pairs.groupBy("leader").agg(F.max("n").alias("n")).select("leader", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"))
    led = led.join(features.withColumnRenamed("content", "leader"), "leader")
    told = pairs.withColumn("copy", F.pmod(F.xxhash64("member"), copies).cast("int")).drop("n").join(features.withColumnRenamed("content", "member"), "member")
    ahead = led.select("leader", "copy", *[F.lit(None).cast("binary").alias(c) for c in ("member", "p", "q", "leader_comp", "member_comp")], "runs", "counts")
    both = ahead.unionByName(told).repartition("leader", "copy").sortWithinPartitions("leader", "copy", F.col("member").asc_nulls_first())
    both = both.select("p", "q", "leader_comp", "member_comp", "leader", "member", "runs", "counts")
    schema = StructType([*both.select("p", "q", "leader_comp", "member_comp").schema.fields, StructField("alike", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            alike = []
            for leader, member, runs, counts in zip(*batch.columns[4:]):
                own = np.frombuffer(runs.as_buffer(), "<u8"), np.frombuffer(counts.as_buffer(), "<u4")
                if member.is_valid:
                    alike.append(probability_jaccard(head, own))
                else:
                    head = tuple(x.copy() for x in own)
            pairs = batch.filter(batch.column(5).is_valid())
            yield pa.RecordBatch.from_arrays([*pairs.columns[:4], pa.array(alike, pa.float64())], names=schema.names)

    return both.mapInArrow(run, schema)


def rare_runs(features: DataFrame, alike: float) -> DataFrame:
    """(bucket, content, odds): of each content its rarest runs, with the odds u / (1 - u) of the share u of rarer ones.

    Where contents share none of runs that weigh u of the one and v of the other, their similarity is at most
    1 / (1 + u / (1 - u) + v / (1 - v)). So alike contents share a run before which, in the common order (runs in fewer
    contents first), their odds add up to 1 / alike - 1 at most: one bucket at least holds both with such odds. Runs of
    one content alone are left out after they were weighed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, runs, counts in zip(*batch.columns):
                h, c = np.frombuffer(runs.as_buffer(), "<i8"), np.frombuffer(counts.as_buffer(), "<u4")
                for k in range(0, len(h), ROWS_OUT):
                    part = h[k : k + ROWS_OUT]
                    yield pa.RecordBatch.from_arrays([pa.repeat(content, len(part)), pa.array(part), pa.array(c[k : k + ROWS_OUT] / c.sum())], names=["content", "bucket", "share"])

    runs = materialise(features.select("content", "runs", "counts").mapInArrow(run, "content binary, bucket long, share double"), "near-runs")
    held = runs.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    weighed = runs.join(held, "bucket", "left").withColumn("held", F.coalesce("held", F.lit(1)))
    rarer = Window.partitionBy("content").orderBy("held", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    rare = weighed.withColumn("rarer", F.coalesce(F.sum("share").over(rarer), F.lit(0.0)))
    rare = rare.where((F.col("rarer") <= 1 - alike + 1e-9) & (F.col("held") > 1))
    return rare.select("bucket", "content", (F.col("rarer") / (1 - F.col("rarer"))).alias("odds"))


def run_maps(features: DataFrame) -> DataFrame:
    """(content, m0, m1, ..., marks, weight): a map of bits, one marked for each run by its hash, how many are, the sum of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, weights = np.zeros((batch.num_rows, MAP_WORDS * 64), bool), np.zeros(batch.num_rows, np.int64)
            for k, (runs, counts) in enumerate(zip(*batch.columns[1:])):
                maps[k, (_mix(np.frombuffer(runs.as_buffer(), "<u8")) % np.uint64(MAP_WORDS * 64)).astype(np.int64)] = True
                weights[k] = np.frombuffer(counts.as_buffer(), "<u4").sum()
            words = np.packbits(maps, axis=1).view(np.int64)
            columns = [*(np.ascontiguousarray(words[:, k]) for k in range(MAP_WORDS)), maps.sum(axis=1), weights]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=["content", *MAPS])

    return features.select("content", "runs", "counts").mapInArrow(run, "content binary, " + ", ".join(f"{c} long" for c in MAPS))


def may_be_alike(most: float) -> Column:
    """Whether the maps of a member and a leader (``a_``) allow the similarity 1 / (1 + ``most``).

    A mark of one map alone stands for a run, of a count of one or more, that the other lacks. So with c marks in both, and
    s and t the weights less the marks, the shared weights are at most s + c and t + c; that bounds the unshared u and v, and
    the similarity by 1 / (1 + u / (1 - u) + v / (1 - v)). The bound is met from the greater root in c on.
    """
    both = reduce(add, [F.bit_count(F.col(f"m{k}").bitwiseAND(F.col(f"a_m{k}"))) for k in range(MAP_WORDS)])
    x, y, top = F.col("weight"), F.col("a_weight"), most + 2
    s, t = x - F.col("marks"), y - F.col("a_marks")
    half = (x + y - top * (s + t)) / (2 * top)
    return both >= half + F.sqrt(F.greatest(half * half + (x * t + y * s - top * s * t) / top, F.lit(0.0))) - 1e-6


def relabel(df: DataFrame, col: str, grown: DataFrame) -> DataFrame:
    return df.join(grown.select(F.col("node").alias(col), F.col("label").alias("further")), col, "left").withColumn(col, F.coalesce("further", col)).drop("further")


def opened(members: DataFrame, most: float) -> DataFrame:
    """Those of ``members`` (bucket, content, meets, odds, comp) that may still be linked in their bucket: it has several
    components, and the least odds in it and their own add up to ``most`` or less. Adds the bucket's size and the
    component of its most central member.
    """
    sides = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("odds").alias("low"), F.max(F.struct("meets", "content", "comp"))["comp"].alias("big"), F.min("comp").alias("one"), F.max("comp").alias("other"))
    sides = sides.where("one <> other").drop("one", "other")
    return materialise(members.join(sides, "bucket").where(F.col("odds") + F.col("low") <= most).drop("low"), "near-open")


def led_pairs(members: DataFrame, leaders: int, order: list[Column], most: float, largest: int) -> tuple[DataFrame, DataFrame]:
    """The pairs that the first ``leaders`` of each bucket lead, each once, and the members that have not led.

    Buckets beyond MEMBERS_A_TASK are ranked in cells of that size first. Where members have maps, pairs must pass them.
    """
    ranked, own = members, [c for c in members.columns if c not in ("n", "big")]
    if largest > MEMBERS_A_TASK:
        cells = members.withColumn("cell", F.pmod(F.xxhash64("content"), F.ceil(F.col("n") / MEMBERS_A_TASK)))
        cells = cells.withColumn("nth", F.row_number().over(Window.partitionBy("bucket", "cell").orderBy(*order))).drop("cell")
        first = cells.where(F.col("nth") <= leaders).withColumn("nth", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).where(F.col("nth") <= leaders)
        ranked = members.join(first.select("bucket", "content", "nth"), ["bucket", "content"], "left").withColumn("nth", F.coalesce("nth", F.lit(leaders + 1)))
    else:
        ranked = members.withColumn("nth", F.row_number().over(Window.partitionBy("bucket").orderBy(*order)))
    maps = MAPS if set(MAPS) <= set(own) else []
    heads = ranked.where(F.col("nth") <= leaders).select("bucket", F.col("content").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("comp", "odds", *maps)])
    met = ranked.join(heads, "bucket").where("comp <> a_comp").where(F.col("odds") + F.col("a_odds") <= most)
    met = met.where(may_be_alike(most)) if maps else met
    # a pair of two leaders, or of several buckets, is met once, under the leader of the larger bucket
    leads = F.struct("n", F.col("a").alias("leader"), F.col("content").alias("member"), F.col("a_comp").alias("leader_comp"), F.col("comp").alias("member_comp"))
    pairs = met.groupBy(F.least("a", "content").alias("p"), F.greatest("a", "content").alias("q")).agg(F.max(leads).alias("top")).select("p", "q", "top.*")
    return pairs, ranked.where(F.col("nth") > leaders).select(own)


def join_buckets(members: DataFrame, nodes: DataFrame, features: DataFrame, alike: float) -> DataFrame:
    """(content, comp) for the contents of ``nodes``: their component by the links of all buckets.

    ``members`` (bucket, content, meets). In the first round one leader of each bucket meets the others, and contents that
    copy it join. Those in buckets that hold several components then are dealt to buckets of their rarest runs, where more
    leaders meet them, round by round, until no bucket holds two that may be linked and are not in one component. Members
    still open after the first of these rounds carry maps of their runs, and pairs whose maps exclude a link are not formed.
    """
    spark = members.sparkSession
    turn, met_at, most = 0, [], 1 / alike - 1 + 1e-9
    members = opened(members.withColumns({"comp": F.col("content"), "odds": F.lit(0.0)}), most)
    while largest := members.agg(F.max("n")).first()[0]:
        # every other round those outside the most central member's component lead
        order = [*([F.desc(F.col("comp") != F.col("big"))] if turn % 2 else []), "odds", F.desc("meets"), F.desc("content")]
        pairs, rest = led_pairs(members, LEADERS[min(turn, len(LEADERS) - 1)], order, most, largest)
        if met_at:
            pairs = pairs.join(spark.read.parquet(*met_at).select("p", "q"), ["p", "q"], "left_anti")
        met_at.append(scratch(spark, "near-met"))
        pairs = materialise(pairs, "near-pairs")
        # in later rounds few contents are left
        some = likely(features, pairs.select(F.explode(F.array("leader", "member")).alias("content")), "content") if turn else features
        verify(pairs, some).write.parquet(met_at[-1])
        links = spark.read.parquet(met_at[-1]).where(F.col("alike") >= alike).select(F.col("leader_comp").alias("a"), F.col("member_comp").alias("b"))
        if not links.isEmpty():
            grown = components(links)
            nodes = materialise(relabel(nodes, "comp", grown), "near-nodes")
            rest = relabel(rest, "comp", grown)
        if turn == 0:
            left = materialise(opened(rest, most).groupBy("content").agg(F.max("meets").alias("meets")), "near-left")
            rare = rare_runs(likely(features, left, "content").join(left, "content", "left_semi"), alike)
            rest = rare.join(left.join(nodes, "content"), "content")
        members = opened(materialise(rest, "near-rest"), most)
        if turn == 1:
            members = materialise(members.join(run_maps(features.join(members.select("content").distinct(), "content", "left_semi")), "content"), "near-maps")
        turn += 1
    return nodes


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alike: float = ALIKE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row a document: doc_id, row_digest (md5 of the text), class_id (the least id of its class), kept.

    Texts with the same folded words are one content; contents are linked where their similarity is ``alike`` or more,
    and a class is a connected component of links. In a bucket of equal bands one leader is compared with all others; what
    is not in one component then is compared further, wherever a pair shares one of its rarest runs, as alike pairs must.
    Pairs already in one component are skipped. A bucket so loses no link that joins classes, however many clusters it has.

    Documents without words (null, empty) are classes of their own. ``kept`` is true for the least (doc_id, row_digest)
    of a class, null ids last; rows equal in both are repeats of one document. Texts are taken whole, however long; a task
    holds BLOCK_BYTES of them, or one. Other columns are not returned. An empty table gives no rows.
    """
    source = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(quoted(text_col), F.lit("")))).alias("row_digest"), quoted(text_col).alias("text"))
    signed = materialise(sign(source, bands, rows), "near-signed")
    first = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "row_digest")
    contents = signed.where("content is not null").groupBy("content").agg(F.min(first).alias("first"), F.first("bands").alias("bands"))
    contents = materialise(contents, "near-contents")
    banded = contents.select("content", F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialise(banded.join(sizes, "bucket"), "near-members")
    # the content that meets most others leads: of a text and its copies, the text
    meets = members.groupBy("content").agg(F.sum("n").alias("meets"))
    members = materialise(members.drop("n").join(meets, "content"), "near-members")
    # the texts of all contents in any bucket, each from the least row that has it, become features once
    wanted = materialise(contents.join(meets, "content", "left_semi").select("content", "first.doc", "first.row_digest"), "near-wanted")
    texts = likely(source.withColumn("doc", F.coalesce("doc_id", F.lit(_LAST))), wanted, "doc").join(wanted, ["doc", "row_digest"]).dropDuplicates(["doc", "row_digest"])
    features = materialise(packed_features(texts.select("content", "text")), "near-features")
    classes = join_buckets(members, meets.select("content", F.col("content").alias("comp")), features, alike)

    labelled = contents.select("content", "first").join(classes, "content", "left").withColumn("label", F.coalesce("comp", "content"))
    best = labelled.groupBy("label").agg(F.min("first").alias("best"))
    owned = labelled.join(best, "label").select("content", "best")
    full = signed.select("doc_id", "row_digest", "content").join(owned, "content", "left")
    own = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "row_digest")
    best = F.coalesce("best", own)
    return full.select("doc_id", "row_digest", F.when(best["doc"] < _LAST, best["doc"]).alias("class_id"), (best == own).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents less all but the first of each class; repeated rows count once. All columns stay as they are,
    whatever their names: a row travels as one struct.
    """
    kept = near_duplicates(docs, id_col, text_col, **settings).where("kept").select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.col("row_digest").alias("digest")).distinct()
    keyed = shut(docs).select("row", F.coalesce(quoted(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.unhex(F.md5(F.coalesce(quoted(text_col), F.lit("")))).alias("digest"))
    return keyed.join(kept, ["doc", "digest"], "left_semi").dropDuplicates(["doc", "digest"]).select("row.*")
