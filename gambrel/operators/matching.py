"""Matching rooms of graph pairs: least-cost assignment, graph edit distance, hierarchy similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gambrel.shared import beginnings, by_groups, settled


def least_cost(cost: np.ndarray) -> np.ndarray:
    """For each row its column, -1 for none; min(rows, columns) are matched at least total cost.

    Shortest augmenting paths over reduced costs, row after row; of equal columns the first.
    """
    rows, cols = cost.shape
    if rows > cols:
        out = np.full(rows, -1)
        for c, r in enumerate(least_cost(cost.T)):
            out[r] = c
        return out
    owner, price_r, price_c = np.full(cols, -1), np.zeros(rows), np.zeros(cols)
    for row in range(rows):
        slack, came, done = np.full(cols, np.inf), np.full(cols, -1), np.zeros(cols, bool)
        at, col, reach = row, -1, 0.0
        while at >= 0:
            reduced = reach + cost[at] - price_r[at] - price_c
            better = ~done & (reduced < slack)
            slack[better], came[better] = reduced[better], col
            col = int(np.argmin(np.where(done, np.inf, slack)))
            reach, done[col], at = slack[col], True, int(owner[col])
        seen = np.flatnonzero(done)
        price_c[seen] -= reach - slack[seen]
        price_r[row] += reach
        inner = seen[owner[seen] >= 0]
        price_r[owner[inner]] += reach - slack[inner]
        while col >= 0:
            before = int(came[col])
            owner[col] = owner[before] if before >= 0 else row
            col = before
    out = np.full(rows, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def assign(costs: DataFrame) -> DataFrame:
    """``costs``: (pair, a, b, oa, ob, cost), all room pairs of each graph pair, oa and ob their order. The matches."""

    columns = ["pair", "a", "b", "cost"]

    def one(table: pa.Table, starts: np.ndarray) -> pa.Table:
        cost, new = table.column("cost").to_numpy(), beginnings(table, ["pair", "oa"])
        ends = [*starts[1:].tolist(), len(cost)]
        rows = np.add.reduceat(new.astype(np.int64), starts).tolist()
        chosen: list[int] = []
        for first, end, n in zip(starts.tolist(), ends, rows):
            wide = cost[first:end].reshape(n, -1)
            chosen += [first + r * wide.shape[1] + c for r, c in enumerate(least_cost(wide).tolist()) if c >= 0]
        return table.select(columns).take(pa.array(chosen, pa.int64()))

    costs = costs.withColumn("cost", F.col("cost").cast("double"))
    return by_groups(costs, ["pair"], ["oa", "ob"], one, costs.select(columns).schema)


def _sides(pairs: DataFrame, nodes: DataFrame, extra: list[str]) -> tuple[DataFrame, DataFrame]:
    side = lambda g, s: pairs.select("pair", F.col(g).alias("graph")).join(nodes, "graph").select("pair", F.col("node").alias(s), F.col("ord").alias(f"o{s}"), F.col("name").alias(f"n{s}"), *[F.col(c).alias(f"{c}_{s}") for c in extra])
    return side("graph_a", "a"), side("graph_b", "b")


def _matched(pairs: DataFrame, nodes: DataFrame, weights: dict[str, float]) -> DataFrame:
    left, right = _sides(pairs, nodes, [c for c in weights if c != "name"])
    cost = F.when(F.col("na") == F.col("nb"), 0.0).otherwise(weights["name"])
    for c, w in weights.items():
        if c != "name":
            cost = cost + w * F.abs(F.col(f"{c}_a") - F.col(f"{c}_b"))
    return settled(assign(left.join(right, "pair").select("pair", "a", "b", "oa", "ob", cost.alias("cost"))), "matches")


def _counts(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    e = edges.groupBy("graph").agg(F.count(F.lit(1)).alias("e"))
    size = n.join(e, "graph", "left").select("graph", "n", F.coalesce("e", F.lit(0)).alias("e"))
    out = pairs
    for s in "ab":
        out = out.join(size.select(F.col("graph").alias(f"graph_{s}"), F.col("n").alias(f"n_{s}"), F.col("e").alias(f"e_{s}")), f"graph_{s}", "left")
    return out.fillna(0, ["n_a", "e_a", "n_b", "e_b"])


NAME_AREA = {"name": 0.7, "norm_area": 0.3}
HIERARCHY = {"name": 0.4, "connectivity": 0.2, "integration": 0.2, "choice": 0.2}


def edit_distance(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """N3, N3a, N3b of listed pairs (pair, graph_a, graph_b): (pair, node_cost, kept, removed, added, ged, similarity).

    Rooms are matched at least cost (name, share of area; a room left over costs 1). A first graph's edge is kept if both
    ends are matched and the second graph joins their images; the second's edges that none covers are added. Substitution
    costs at most 1 and a deletion with an insertion 2, so as many rooms as can be are matched.
    """
    matches = _matched(pairs, nodes, weights or NAME_AREA)
    costs = matches.groupBy("pair").agg(F.sum("cost").alias("sub"), F.count(F.lit(1)).alias("m"))
    ends = lambda g: pairs.select("pair", F.col(g).alias("graph")).join(edges, "graph").select("pair", "a", "b")
    images = matches.select("pair", "a", F.col("b").alias("image"))
    ea = ends("graph_a").withColumnRenamed("a", "p").withColumnRenamed("b", "q")
    ea = ea.join(images.select("pair", F.col("a").alias("p"), F.col("image").alias("ip")), ["pair", "p"], "left")
    ea = ea.join(images.select("pair", F.col("a").alias("q"), F.col("image").alias("iq")), ["pair", "q"], "left")
    ea = ea.select("pair", F.least("ip", "iq").alias("u"), F.greatest("ip", "iq").alias("v"), (F.col("ip").isNotNull() & F.col("iq").isNotNull()).alias("both"))
    eb = ends("graph_b").select("pair", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    here = eb.distinct().withColumn("here", F.lit(True))
    judged = ea.join(here, ["pair", "u", "v"], "left").withColumn("kept", F.col("both") & F.coalesce("here", F.lit(False)))
    fate = judged.groupBy("pair").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("removed"))
    added = eb.join(judged.where("kept").select("pair", "u", "v").distinct(), ["pair", "u", "v"], "left_anti").groupBy("pair").agg(F.count(F.lit(1)).alias("added"))
    out = _counts(pairs, nodes, edges)
    for part in (costs, fate, added):
        out = out.join(part, "pair", "left")
    out = out.fillna(0, ["sub", "m", "kept", "removed", "added"])
    out = out.withColumn("node_cost", F.col("sub") + F.col("n_a") + F.col("n_b") - 2 * F.col("m"))
    out = out.withColumn("ged", F.col("node_cost") + F.col("removed") + F.col("added"))
    most = F.col("n_a") + F.col("n_b") + F.col("e_a") + F.col("e_b")
    alike = F.when(most == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("ged") / F.nullif(most, F.lit(0))))
    return out.select("pair", "node_cost", "kept", "removed", "added", "ged", alike.alias("similarity"))


def hierarchy_similarity(pairs: DataFrame, nodes: DataFrame, central: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(pair, cost, similarity), by an own matching on names and the three centralities; no edges.

    Doubled edges can push connectivity over 1, and a substitution over a deletion with an insertion; use distinct edges.
    """
    joined = nodes.join(central, ["graph", "node"])
    costs = _matched(pairs, joined, weights or HIERARCHY).groupBy("pair").agg(F.sum("cost").alias("sub"), F.count(F.lit(1)).alias("m"))
    n = nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    out = pairs.join(costs, "pair", "left").fillna(0, ["sub", "m"])
    for s in "ab":
        out = out.join(n.select(F.col("graph").alias(f"graph_{s}"), F.col("n").alias(f"n_{s}")), f"graph_{s}", "left")
    total = F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))
    cost = F.col("sub") + total - 2 * F.col("m")
    return out.select("pair", cost.alias("cost"), F.when(total == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - cost / F.nullif(total, F.lit(0)))).alias("similarity"))


def match_table(pairs: DataFrame, nodes: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(pair, kind, a, b, cost): matched rooms, then those deleted and those inserted at a cost of 1."""
    matches = _matched(pairs, nodes, weights or NAME_AREA).withColumn("kind", F.lit("matched"))
    left, right = _sides(pairs, nodes, [])
    gone = left.join(matches, ["pair", "a"], "left_anti").select("pair", F.lit("deleted").alias("kind"), "a", F.lit(None).alias("b"), F.lit(1.0).alias("cost"))
    new = right.join(matches, ["pair", "b"], "left_anti").select("pair", F.lit("inserted").alias("kind"), F.lit(None).alias("a"), "b", F.lit(1.0).alias("cost"))
    return matches.select("pair", "kind", "a", "b", "cost").union(gone).union(new)
