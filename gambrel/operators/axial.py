"""Axial analysis as the method specifies it, apart from the closeness and betweenness in use: segments split at
crossings, turns as weights, NAIN and NACH, and rooms by the segments that touch them.

``lines``: (case, line, x0, y0, x1, y1). All steps are joins over a case's few hundred segments; shortest paths relax all
nodes of all cases at once, a join a round.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gambrel.functions import polygon as P
from gambrel.operators.graph import folded_back
from gambrel.shared import settled


def met_cells(lines: DataFrame) -> DataFrame:
    """(case, line, cx, cy): the grid cells that a line passes, column by column. A case's cells are its extent over the root
    of its lines, so a line passes a number of cells in proportion to that root, and few lines share one."""
    low = lambda a: F.least(f"{a}0", f"{a}1")
    high = lambda a: F.greatest(f"{a}0", f"{a}1")
    per = lines.groupBy("case").agg(F.min(low("x")).alias("left"), F.min(low("y")).alias("top"), F.greatest(F.max(high("x")) - F.min(low("x")), F.max(high("y")) - F.min(low("y")), F.lit(1e-9)).alias("size"), F.count(F.lit(1)).alias("n"))
    on = lines.hint("merge").join(per, "case").withColumn("cell", F.col("size") / F.ceil(F.sqrt("n")))
    column = lambda x: F.floor((x - F.col("left")) / F.col("cell")).cast("int")
    on = on.withColumn("cx", F.explode(F.sequence(column(low("x")), column(high("x")))))
    # the line's ys in its column, a hair wider than the column
    hair = F.col("cell") * 1e-6
    ends = [F.greatest(F.least(F.col("left") + F.col("cx") * F.col("cell") - hair, high("x")), low("x")), F.least(F.greatest(F.col("left") + (F.col("cx") + 1) * F.col("cell") + hair, low("x")), high("x"))]
    y = lambda x: F.when(F.col("x1") == F.col("x0"), F.col("y0")).otherwise(F.col("y0") + (x - F.col("x0")) * (F.col("y1") - F.col("y0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0.0)))
    other = lambda x: F.when(F.col("x1") == F.col("x0"), F.col("y1")).otherwise(y(x))
    row = lambda v: F.floor((v - F.col("top")) / F.col("cell")).cast("int")
    a, b = row(F.least(y(ends[0]), other(ends[1])) - hair), row(F.greatest(y(ends[0]), other(ends[1])) + hair)
    return on.select("case", "line", "cx", F.explode(F.sequence(a, b)).alias("cy"))


def segments(lines: DataFrame) -> DataFrame:
    """(case, seg, line, x0, y0, x1, y1): lines cut where others cross them. Lines meet in the grid cells they pass."""
    cells = settled(met_cells(lines), "line-cells")
    pairs = cells.withColumnRenamed("line", "line_p").join(cells.withColumnRenamed("line", "line_q"), ["case", "cx", "cy"]).where("line_p <> line_q").select("case", "line_p", "line_q").distinct()
    side = lambda s: lines.select("case", F.col("line").alias(f"line_{s}"), F.struct(F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"), F.col("y1").alias("by")).alias(s))
    met = pairs.hint("merge").join(side("p"), ["case", "line_p"]).hint("merge").join(side("q"), ["case", "line_q"]).where(P.segments_cross(F.col("p"), F.col("q")))
    dx, dy = F.col("p.bx") - F.col("p.ax"), F.col("p.by") - F.col("p.ay")
    ex, ey = F.col("q.bx") - F.col("q.ax"), F.col("q.by") - F.col("q.ay")
    t = ((F.col("q.ax") - F.col("p.ax")) * ey - (F.col("q.ay") - F.col("p.ay")) * ex) / (dx * ey - dy * ex)
    cuts = met.select("case", F.col("line_p").alias("line"), t.alias("t"))
    ends = lines.select("case", "line", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    w = Window.partitionBy("case", "line").orderBy("t")
    parts = cuts.union(ends).distinct().withColumn("u", F.lead("t").over(w)).where("u is not null").hint("merge").join(lines, ["case", "line"])
    at = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * F.col(t)
    out = parts.select("case", "line", "t", at("x0", "x1", "t").alias("sx"), at("y0", "y1", "t").alias("sy"), at("x0", "x1", "u").alias("ex"), at("y0", "y1", "u").alias("ey"))
    seg = F.row_number().over(Window.partitionBy("case").orderBy("line", "t"))
    return out.select("case", seg.alias("seg"), "line", F.col("sx").alias("x0"), F.col("sy").alias("y0"), F.col("ex").alias("x1"), F.col("ey").alias("y1"))


def turns(segs: DataFrame) -> DataFrame:
    """(case, a, b, weight) of segments that share an end: the turn between them over 180 degrees; both directions."""
    ends = segs.select("case", "seg", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("x1").alias("ox"), F.col("y1").alias("oy")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("x0").alias("ox"), F.col("y0").alias("oy")))).alias("e"))
    ends = ends.select("case", "seg", F.round("e.x", 6).alias("x"), F.round("e.y", 6).alias("y"), F.atan2(F.col("e.oy") - F.col("e.y"), F.col("e.ox") - F.col("e.x")).alias("out"))
    other = ends.select("case", F.col("seg").alias("b"), "x", "y", F.col("out").alias("bout"))
    met = ends.hint("merge").join(other, ["case", "x", "y"]).where("seg <> b")
    between = F.abs(F.col("out") - F.col("bout"))
    opened = F.least(between, 2 * math.pi - between)
    return met.groupBy("case", F.col("seg").alias("a"), "b").agg(F.min(F.lit(1.0) - opened / math.pi).alias("weight"))


def exterior_links(segs: DataFrame, silhouettes: DataFrame, opened: DataFrame | None = None) -> DataFrame:
    """(case, seg): segments with an end outside the silhouette (case, points), and those opened by hand."""
    j = segs.join(silhouettes, "case")
    out = j.where(~P.contains(F.col("points"), F.col("x0"), F.col("y0")) | ~P.contains(F.col("points"), F.col("x1"), F.col("y1"))).select("case", "seg")
    return out if opened is None else out.union(opened.select("case", "seg")).distinct()


def rooted(graph: DataFrame, exterior: DataFrame) -> DataFrame:
    """The graph with a root, segment 0, joined to exterior segments at no cost."""
    link = exterior.select("case", F.lit(0).alias("a"), F.col("seg").alias("b"), F.lit(0.0).alias("weight"))
    return graph.unionByName(link).unionByName(link.select("case", F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def weighted_paths(graph: DataFrame, digits: int = 9) -> DataFrame:
    """(case, src, node, d, hops, paths): least total turn from every segment to every other, the fewest segments of such
    ways, and how many ways have both.

    Straight steps cost nothing, so ways of the same turn are told apart by their steps; each step of a shortest way is then
    one hop further, and ways are counted hop by hop. Distances and hops relax together until none falls.
    """
    g = settled(graph, "axial-graph")
    nodes = g.select("case", F.col("a").alias("node")).distinct()
    at = settled(nodes.select("case", F.col("node").alias("src"), "node", F.lit(0.0).alias("d"), F.lit(0).alias("hops"), F.lit(True).alias("new")), "axial-d")
    while True:
        step = at.where("new").join(g.withColumnRenamed("a", "node"), ["case", "node"]).select("case", "src", F.col("b").alias("node"), F.round(F.col("d") + F.col("weight"), digits).alias("d"), (F.col("hops") + 1).alias("hops"), F.lit(True).alias("new"))
        # of equals the one that was there, which is not new
        both = at.withColumn("new", F.lit(False)).unionByName(step).groupBy("case", "src", "node").agg(F.min(F.struct("d", "hops", "new")).alias("m"))
        at = settled(both.select("case", "src", "node", "m.*"), "axial-d")
        if at.where("new").isEmpty():
            break
    reached = front = at.where("hops = 0").select("case", "src", "node", "d", "hops", F.lit(1).cast("long").alias("paths"))
    for k in range(1, (at.agg(F.max("hops")).first()[0] or 0) + 1):
        step = front.join(g.withColumnRenamed("a", "node"), ["case", "node"]).select("case", "src", F.col("b").alias("node"), F.round(F.col("d") + F.col("weight"), digits).alias("d"), "paths")
        step = step.groupBy("case", "src", "node", "d").agg(F.sum("paths").alias("paths"))
        front = settled(at.where(F.col("hops") == k).drop("new").join(step, ["case", "src", "node", "d"]).select("case", "src", "node", "d", "hops", "paths"), "axial-paths")
        reached = reached.unionByName(front)
    return reached


def nain(paths: DataFrame) -> DataFrame:
    """(case, seg, nain): the nodes reached, itself counted, to the 1.2th over total turn plus 2."""
    r = paths.groupBy("case", F.col("src").alias("seg")).agg(F.count(F.lit(1)).alias("nc"), F.sum("d").alias("td"))
    return r.select("case", "seg", (F.pow("nc", F.lit(1.2)) / (F.col("td") + 2)).alias("nain"), "td")


def nach(paths: DataFrame, total: DataFrame, graph: DataFrame, digits: int = 9) -> DataFrame:
    """(case, seg, nach): log2 of choice plus 1 over log2 of total turn plus 3; choice is, over unordered pairs, the share
    of the shortest ways (least turn, then fewest segments) through the segment."""
    near = graph.select(F.col("case").alias("graph"), "a", "b", F.lit(1).alias("m"), F.col("weight").alias("w"))
    back = folded_back(paths.withColumnRenamed("case", "graph"), near, "hops", lambda far, d: far == F.round(d + F.col("w"), digits))
    choice = back.groupBy(F.col("graph").alias("case"), F.col("node").alias("seg")).agg((F.sum("share") / 2).alias("ch"))
    j = total.select("case", "seg", "td").hint("merge").join(choice, ["case", "seg"], "left").fillna(0.0, ["ch"])
    return j.select("case", "seg", (F.log2(F.col("ch") + 1) / F.log2(F.col("td") + 3)).alias("nach"))


def room_values(segs: DataFrame, values: DataFrame, rooms: DataFrame, column: str) -> DataFrame:
    """(case, node, value) of rooms (case, node, points): their most central touching segment's; null untouched."""
    p = segs.join(values, ["case", "seg"]).join(rooms, "case")
    edge = F.struct(F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"), F.col("y1").alias("by"))
    touch = P.contains(F.col("points"), F.col("x0"), F.col("y0")) | P.contains(F.col("points"), F.col("x1"), F.col("y1")) | F.exists(P.edges(F.col("points")), lambda e: P.segments_cross(e, edge))
    best = p.where(touch).groupBy("case", "node").agg(F.max(column).alias("value"))
    return rooms.select("case", "node").join(best, ["case", "node"], "left")


def room_difference(a, b, worst: float = 1.0):
    """Of two rooms' values; the worst where one is untouched."""
    return F.when(a.isNull() | b.isNull(), worst).otherwise(F.abs(a - b))
