"""Room graphs: sizes, hop distances, path counts and centralities of many graphs at once.

``nodes``: graph, node and more. ``edges``: graph, a, b, undirected; doubled edges count, as in the room editor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gambrel.functions import polygon as P
from gambrel.functions.labels import room_name
from gambrel.shared import settled


def room_graph(rooms: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rooms (graph, node, name, points) with norm_area, the share of the listed rooms' area, and the centroid; and
    the edges with both ends listed."""
    area = P.area(F.col("points"))
    total = F.sum(area).over(Window.partitionBy("graph"))
    middle = P.centroid(F.col("points"))
    nodes = rooms.select(
        "graph", "node", room_name(F.col("name")).alias("name"), (area / F.when(total == 0, 1.0).otherwise(total)).alias("norm_area"), middle[0].alias("cx"), middle[1].alias("cy")
    )
    known = nodes.select("graph", F.col("node").alias("a"))
    kept = edges.join(known, ["graph", "a"], "left_semi").join(known.withColumnRenamed("a", "b"), ["graph", "b"], "left_semi")
    return nodes, kept.select("graph", "a", "b")


def both_ways(edges: DataFrame) -> DataFrame:
    """The adjacency list."""
    return edges.select("graph", "a", "b").union(edges.select("graph", F.col("b").alias("a"), F.col("a").alias("b")))


def shortest_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, src, node, d, paths): hops from every node to every node it reaches, and the number of such paths.

    One join a hop, over the frontier only; each round is written, so the plan stays short.
    """
    near = settled(both_ways(edges).groupBy("graph", "a", "b").agg(F.count(F.lit(1)).alias("m")), "adjacency")
    start = nodes.select("graph", F.col("node").alias("src"), "node", F.lit(0).alias("d"), F.lit(1).cast("long").alias("paths"))
    reached = front = settled(start, "hops")
    while True:
        step = front.join(near.withColumnRenamed("a", "node"), ["graph", "node"])
        step = step.groupBy("graph", "src", F.col("b").alias("node")).agg((F.min("d") + 1).alias("d"), F.sum(F.col("paths") * F.col("m")).alias("paths"))
        front = settled(step.join(reached, ["graph", "src", "node"], "left_anti"), "hops")
        if front.isEmpty():
            return reached
        reached = settled(reached.unionByName(front), "hops")


def betweenness(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, node, between): over unordered pairs, the share of shortest paths that pass a node.

    Dependencies are folded back from the far end, a level of hops a round: a node has of each node one hop further the share
    of its ways that come through it. Rounds are as many as hops, rows as many as nodes times edges.
    """
    near = settled(both_ways(edges).groupBy("graph", "a", "b").agg(F.count(F.lit(1)).alias("m")), "adjacency")
    return folded_back(paths, near.withColumn("w", F.lit(1)), "d", lambda hop, back: hop == back + F.col("w")).groupBy("graph", "node").agg((F.sum("share") / 2).alias("between"))


def folded_back(paths: DataFrame, near: DataFrame, level: str, tight) -> DataFrame:
    """(graph, src, node, share): of all nodes beyond ``node`` on shortest ways from ``src``, the shares of the ways through it.

    ``paths``: (graph, src, node, level, d, paths); ``near``: (graph, a, b, m, w), m ways of a weight from a to b. A way from
    a level to the next is shortest where ``tight`` (the far distance, the near one) holds.
    """
    most = paths.agg(F.max(level)).first()[0] or 0
    at = lambda k: paths.where(F.col(level) == k)
    far = at(most).withColumn("share", F.lit(0.0))
    out = far.select("graph", "src", "node", "share").limit(0)
    for k in range(most, 1, -1):
        step = far.select("graph", "src", F.col("node").alias("b"), F.col("d").alias("db"), ((1 + F.col("share")) / F.col("paths")).alias("part")).join(near, ["graph", "b"])
        before = at(k - 1)
        met = before.hint("merge").join(step.select("graph", "src", F.col("a").alias("node"), "db", "part", "m", "w"), ["graph", "src", "node"]).where(tight(F.col("db"), F.col("d")))
        gained = met.groupBy("graph", "src", "node").agg(F.sum(F.col("paths") * F.col("m") * F.col("part")).alias("share"))
        far = settled(before.hint("merge").join(gained, ["graph", "src", "node"], "left").fillna(0.0, ["share"]), "shares")
        out = out.unionByName(far.select("graph", "src", "node", "share"))
    return out


def centralities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """N7 connectivity, N8 closeness integration, N9 betweenness choice of every node of every graph.

    A graph of one node has zeros; so do unreached nodes' integration and choice in graphs of under three.
    """
    paths = shortest_paths(nodes, edges)
    size = nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    degree = both_ways(edges).groupBy("graph", F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    reach = paths.where("d > 0").groupBy("graph", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("r"), F.sum("d").alias("far"))
    j = nodes.select("graph", "node").join(size, "graph")
    for part in (degree, reach, betweenness(paths, edges)):
        j = j.join(part, ["graph", "node"], "left")
    n, r = F.col("n"), F.col("r")
    return j.select(
        "graph",
        "node",
        F.when(n <= 1, 0.0).otherwise(F.coalesce(F.col("degree") / F.nullif(n - 1, F.lit(0)), F.lit(0.0))).alias("connectivity"),
        F.coalesce((r / F.nullif(n - 1, F.lit(0))) * (r / F.col("far")), F.lit(0.0)).alias("integration"),
        F.when(n < 3, 0.0).otherwise(F.coalesce(F.col("between") / F.nullif((n - 1) * (n - 2) / 2, F.lit(0.0)), F.lit(0.0))).alias("choice"),
    )


def ranking(central: DataFrame) -> DataFrame:
    """Nodes of each graph by the sum of the three, largest first; equals by node."""
    total = F.col("connectivity") + F.col("integration") + F.col("choice")
    return central.withColumn("place", F.row_number().over(Window.partitionBy("graph").orderBy(F.round(total, 9).desc(), "node")))


def toggle_edges(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Each change (graph, a, b) deletes that edge, in either direction, where it is there, and adds it elsewhere."""
    key = [F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")]
    had, now = edges.select("graph", "a", "b", *key), changes.select("graph", "a", "b", *key).dropDuplicates(["graph", "u", "v"])
    on = ["graph", "u", "v"]
    return had.join(now.drop("a", "b"), on, "left_anti").unionByName(now.join(had.drop("a", "b"), on, "left_anti")).select("graph", "a", "b")


def remove_rooms(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rooms (graph, node) with their edges."""
    left = nodes.join(gone, ["graph", "node"], "left_anti")
    out = edges
    for end in ("a", "b"):
        out = out.join(gone.withColumnRenamed("node", end), ["graph", end], "left_anti")
    return left, out.select("graph", "a", "b")


def bubble_layout(nodes: DataFrame, width: float = 400.0, height: float = 300.0, margin: float = 40.0) -> DataFrame:
    """Centroids fitted to a box, and a radius by area."""
    w = Window.partitionBy("graph")
    span = lambda c: F.max(c).over(w) - F.min(c).over(w)
    fit = lambda c, size: F.when(span(c) == 0, size / 2).otherwise(margin + (F.col(c) - F.min(c).over(w)) / span(c) * (size - 2 * margin))
    return nodes.select("*", fit("cx", width).alias("x"), fit("cy", height).alias("y"), (14 + 46 * F.sqrt("norm_area")).alias("radius"))
