"""Balanced label propagation: linked documents gather in their neighbours' shards under capacity quotas.

Documents with equal texts are linked; a group of them is a node that all of them neighbour, so no pair is made. A label
is a shard. The state is, for each group and shard, how many of its documents are there; each round joins that table to
the shards' capacity and moves documents to the shard where most of their group is, into free room or in exchange for as
many that wish the other way, until none moves.
Documents without links fill what is left, so row counts are at most one apart. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gambrel.llm.common import bin_of, bin_offsets, materialise, quoted

#: Bins of groups for running sums by target shard.
GROUP_BINS = 256


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _case(of: Column, values: list[int]) -> Column:
    out = F.when(of == 0, F.lit(values[0]))
    for s, v in enumerate(values[1:], 1):
        out = out.when(of == s, F.lit(v))
    return out.cast("long")


def rooms_for(wishes: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How many rows may go from a shard to another: those that change places, two shards or a ring of several, and those
    that end, directly or over others, where there is room. Shards and their room are the nodes of a small graph; rings in
    it, shortest first from each edge, are filled until there is none."""
    room = -1
    left = {k: n for k, n in wishes.items() if n}
    left |= {(t, room): n for t, n in enumerate(free) if n} | {(room, s): sum(wishes.values()) for s in range(len(free))}
    out = dict.fromkeys(wishes, 0)

    def ring(first: tuple[int, int]) -> list[tuple[int, int]]:
        came, todo = {first[1]: None}, [first[1]]
        for u in todo:
            for v in (v for (w, v) in sorted(left) if w == u and v not in came):
                came[v] = u
                todo.append(v)
        if first[0] not in came:
            return []
        edges, at = [first], first[0]
        while came[at] is not None:
            edges.append((came[at], at))
            at = came[at]
        return edges

    for first in sorted(wishes):
        while first in left and (edges := ring(first)):
            n = min(left[e] for e in edges)
            for e in edges:
                left[e] -= n
                if not left[e]:
                    del left[e]
                if e in out:
                    out[e] += n
    return out


def propagate(cells: DataFrame, quota: list[int], stale: int = 16) -> DataFrame:
    """(group, shard, n) after label propagation; no shard is filled beyond its quota by a move.

    In each round every cell wishes to the shard where most of its group is, in every other round of those with room; of
    equals to one with room, then by a hash of group, shard and round, so that ties go either way in turn. Rows that wish from one shard to another change places with
    as many that wish back, or in a ring, and go into what room there is beyond; who goes is settled by the order of the groups' hashes,
    summed by bins first. Room is what linked documents leave: the others give way. Each moved row brings the sum of squares
    of the cells up, so moves end; ``stale`` rounds without any, after which ties have gone every way, end the rounds.
    """
    shards = len(quota)
    cells = materialise(cells, "shard-cells")
    idle = turn = 0
    while idle < stale:
        turn += 1
        held = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
        free = [max(0, q - held.get(s, 0)) for s, q in enumerate(quota)]
        has = F.col("shard").isin([s for s in range(shards) if free[s]])
        # rounds take turns: shards with room only, then all, where an exchange may help
        rank = F.struct("n", has.alias("open"), F.xxhash64("group", "shard", F.lit(turn)).alias("tie"), "shard")
        best = F.max(F.when(has, rank) if turn % 2 else rank).over(Window.partitionBy("group"))
        wish = cells.withColumns({"own": rank, "best": best}).where((F.col("best") > F.col("own")) & (F.col("best.shard") != F.col("shard")))
        wish = wish.select("group", "shard", "n", F.col("best.shard").alias("target")).withColumn("bin", bin_of(F.col("group"), bins=GROUP_BINS))
        wish = materialise(wish, "shard-wishes")
        if wish.isEmpty():
            if turn % 2 == 0:
                break  # no group has a shard that it would rather be in
            idle += 1
            continue
        sums = wish.groupBy("shard", "target", "bin").agg(F.sum("n").alias("bin_n"))
        before = sums.withColumn("before", F.sum("bin_n").over(Window.partitionBy("shard", "target").orderBy("bin")) - F.col("bin_n")).drop("bin_n")
        total = {(r.shard, r.target): r.n for r in sums.groupBy("shard", "target").agg(F.sum("bin_n").alias("n")).collect()}  # at most shards^2 rows
        may = rooms_for(total, free)
        inside = Window.partitionBy("shard", "target", "bin").orderBy("group")
        # at most shards^2 * GROUP_BINS rows
        ranked = wish.withColumn("inside", F.sum("n").over(inside) - F.col("n")).join(F.broadcast(before), ["shard", "target", "bin"])
        most = _case(F.col("shard") * shards + F.col("target"), [may.get((s, t), 0) for s in range(shards) for t in range(shards)])
        take = F.greatest(F.lit(0), F.least(F.col("n"), most - F.col("before") - F.col("inside")))
        moved = materialise(ranked.withColumn("take", take).where("take > 0").select("group", "shard", "target", "take"), "shard-moves")
        if moved.isEmpty():
            idle += 1
            continue
        idle = 0
        gone = moved.select("group", "shard", (-F.col("take")).alias("n"))
        come = moved.select("group", F.col("target").alias("shard"), F.col("take").alias("n"))
        cells = cells.unionByName(gone).unionByName(come).groupBy("group", "shard").agg(F.sum("n").alias("n")).where("n > 0")
        cells = materialise(cells, "shard-cells")
    return cells


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law (``rows``), shard, slot (gapless
    from 0 in its shard), grown_shard (null under this law).

    Counts of shards are at most one apart. Null texts have no bytes and are linked to empty ones. Null ids and repeated
    rows are rows like others; rows equal in all columns are told apart only by the order they are met in. An empty table
    gives no rows. Texts are read once and reduced to digests; no row of any group is gathered in one task: ranks in a
    group, among unlinked rows and in a shard come from counts of hash bins and a row number inside a bin.
    """
    text = F.coalesce(quoted(text_col), F.lit(""))
    rows = docs.select(
        quoted(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("group"),
    ).withColumn("bin", bin_of(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(7)))
    rows = materialise(rows, "shard-rows")
    quota = quotas(rows.count(), shards)

    # rows of a group by bin: how many come before, how many there are
    binned = bin_offsets(rows, ["group"], "bin").withColumn("group_n", F.sum("bin_n").over(Window.partitionBy("group")))
    binned = materialise(binned.where("group_n > 1"), "shard-bins")
    cells = binned.groupBy("group", (F.col("bin") % shards).alias("shard")).agg(F.sum("bin_n").alias("n"))
    cells = propagate(cells, quota)

    # a shard that its first labels overfilled gives rows back, those of its smallest cells first
    over = Window.partitionBy("shard", "cut").orderBy("n", "group")
    cut = cells.withColumn("cut", bin_of(F.col("group"), bins=GROUP_BINS))
    base = cut.groupBy("shard", "cut").agg(F.sum("n").alias("cut_n"))
    base = base.withColumn("before", F.sum("cut_n").over(Window.partitionBy("shard").orderBy("cut")) - F.col("cut_n")).drop("cut_n")
    cut = cut.withColumn("inside", F.sum("n").over(over) - F.col("n")).join(F.broadcast(base), ["shard", "cut"])
    kept = F.greatest(F.lit(0), F.least(F.col("n"), _case(F.col("shard"), quota) - F.col("before") - F.col("inside")))
    cells = materialise(cut.withColumn("n", kept.cast("long")).where("n > 0").select("group", "shard", "n"), "shard-cells")
    held = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    left = [q - held.get(s, 0) for s, q in enumerate(quota)]

    # a group's ranks are dealt to its cells in order of shard; what no cell takes goes with the unlinked
    until = F.sum("n").over(Window.partitionBy("group").orderBy("shard"))
    lots = cells.withColumn("until", until).groupBy("group").agg(F.sort_array(F.collect_list(F.struct("until", "shard"))).alias("lots"))
    parts = binned.join(lots, "group").select("group", "bin", "bin_before", "lots")
    ranked = rows.join(parts, ["group", "bin"], "left")
    ranked = ranked.withColumn("rank", F.col("bin_before") + F.row_number().over(Window.partitionBy("group", "bin").orderBy("doc_id")) - 1)
    mine = F.filter("lots", lambda x: x["until"] > F.col("rank"))
    placed = materialise(ranked.withColumn("shard", F.get(mine, F.lit(0))["shard"]).drop("lots", "rank", "bin_before"), "shard-placed")

    rest = placed.where("shard is null")
    offsets = bin_offsets(rest, [], "bin", "bin_n", "bin_before")  # at most RANK_BINS rows
    nth = F.col("bin_before") + F.row_number().over(Window.partitionBy("bin").orderBy("doc_id", "group")) - 1
    ends, total = [], 0
    for n in left:
        total += n
        ends.append(total)
    shard = F.lit(shards - 1)
    for s in reversed(range(shards - 1)):
        shard = F.when(F.col("nth") < ends[s], s).otherwise(shard)
    filled = rest.drop("shard").join(F.broadcast(offsets.select("bin", "bin_before")), "bin").withColumn("nth", nth).withColumn("shard", shard)
    whole = placed.where("shard is not null").unionByName(filled.select(*placed.columns))

    whole = materialise(whole, "shard-whole")
    offsets = bin_offsets(whole, ["shard"], "bin").select("shard", "bin", "bin_before")  # at most shards * RANK_BINS rows
    slot = F.col("bin_before") + F.row_number().over(Window.partitionBy("shard", "bin").orderBy("doc_id", "group")) - 1
    return whole.join(F.broadcast(offsets), ["shard", "bin"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
