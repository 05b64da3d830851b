"""Drawings made from the star-schema tables by arithmetic that SQL repeats, so that operators can be held against SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Parts of an image of walls and labels.
IMAGE_PARTS = 10


def image(part: Column) -> Column:
    return F.floor(part / IMAGE_PARTS).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_polygons(spark: SparkSession, sf_dir: str, vertices: int = 32) -> DataFrame:
    """(vec_id, points): vertices at equal angles, of radius 1 plus an embedding's entry."""
    turn = 2 * math.pi / vertices
    point = lambda e, k: F.array((1 + e.cast("double")) * F.cos(k * turn), (1 + e.cast("double")) * F.sin(k * turn))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, vertices), point).alias("points"))


def star_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, pa, pb): each polygon of even number with the next, a vertex for each of an embedding's 64 entries."""
    p = star_polygons(spark, sf_dir, 64)
    left = p.where("vec_id % 2 = 0").select(F.col("vec_id").alias("a"), F.col("points").alias("pa"))
    right = p.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("points").alias("pb"))
    return left.join(right, "a").select("a", "b", "pa", "pb")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph, node, name, x0, y0, x1, y1): a box a part; the brand is its plan."""
    k, s = F.col("p_partkey"), F.col("p_size")
    x0, y0 = (k * 37 % 400).cast("double"), (k * 91 % 300).cast("double")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("graph"), k.alias("node"), F.col("p_type").alias("name"), x0.alias("x0"), y0.alias("y0"), (x0 + s + 2).alias("x1"), (y0 + k % 40 + 3).alias("y1"), s.alias("size"))


def rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    return boxes(spark, sf_dir).select("graph", "node", "name", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")).alias("points"))


def nation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One graph of the nations; an edge for each pair of different nations with any line of trade."""
    t = lambda n: table(spark, sf_dir, n)
    trade = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = trade.where("c_nationkey <> s_nationkey").select(F.lit(0).alias("graph"), F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).distinct()
    return t("nation").select(F.lit(0).alias("graph"), F.col("n_nationkey").alias("node")), pairs


def plan_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rooms, edges and pairs of graphs of four and three parts in turn, each graph with the next. Rooms are named by their
    place, every fifth part by an X, so that a graph has no name twice and matches of least cost have no equals; they are
    joined where the sum of their keys is no multiple of three."""
    k, place = F.col("p_partkey"), F.col("p_partkey") % 7 % 4
    graph = F.floor(k / 7) * 2 + F.when(k % 7 > 3, 1).otherwise(0)
    name = F.when(k % 5 == 0, "X").otherwise(F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), (place + 1).cast("int")))
    nodes = table(spark, sf_dir, "part").select(graph.alias("graph"), k.alias("node"), (place + 1).alias("ord"), name.alias("name"), ((F.col("p_size") + 2) * (k % 40 + 3) + F.sqrt(k)).alias("w"))
    nodes = nodes.withColumn("norm_area", F.col("w") / F.sum("w").over(Window.partitionBy("graph"))).drop("w")
    other = nodes.select("graph", F.col("node").alias("b"))
    edges = nodes.select("graph", F.col("node").alias("a")).join(other, "graph").where("a < b and (a + b) % 3 <> 0")
    g = nodes.select("graph").distinct()
    pairs = g.join(g.select((F.col("graph") - 1).alias("graph")), "graph")
    return nodes, edges, pairs.select(F.col("graph").alias("pair"), F.col("graph").alias("graph_a"), (F.col("graph") + 1).alias("graph_b"))


def walls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, axis, coord, a, b): a wall for each line of an order; ``IMAGE_PARTS`` parts in a row share an image, so images
    grow in number with the tables, not in size."""
    k = F.col("l_orderkey")
    a = (k * 53 % 500).cast("int")
    return table(spark, sf_dir, "lineitem").select(image(F.col("l_partkey")).alias("img"), F.when(F.col("l_partkey") % 2 == 0, "h").otherwise("v").alias("axis"), (F.col("l_suppkey") * 17 % 600).cast("int").alias("coord"), a.alias("a"), (a + F.col("l_quantity").cast("int") * 6).alias("b")).distinct()


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, id, cx, cy): a label for each part, in the image of its walls."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(image(k).alias("img"), k.alias("id"), (k * 29 % 560).cast("double").alias("cx"), (k * 43 % 580).cast("double").alias("cy"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, width, height, area, opening inputs): a cell a part."""
    k = F.col("p_partkey")
    w, h = F.col("p_size").cast("int"), (k % 40 + 1).cast("int")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("img"), k.alias("comp"), w.alias("width"), h.alias("height"), F.greatest(F.lit(1), F.floor(w * h * (k % 10 + 1) / 10)).cast("long").alias("area"), ((k % 7) / 100).alias("holes"), (1 - (k % 5) / 10).alias("axis"))


def axial_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case, line, x0, y0, x1, y1): a line a supplier, ten a case: across, upright or slanted by its key."""
    k = F.col("s_suppkey")
    at, low = (9.0 * (k % 10) + 0.5).cast("double"), F.lit(-5.0)
    end = lambda a, b, c: F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c)
    return table(spark, sf_dir, "supplier").select(F.floor(k / 10).alias("case"), k.alias("line"), end(low, at, at).alias("x0"), end(at, low, low).alias("y0"), end(F.lit(95.0), at, at + 40.0).alias("x1"), end(at, F.lit(95.0), F.lit(95.0)).alias("y1"))


def plan_pixels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs of dark pixels, sizes and labels of a painted plan for every tenth supplier: two rooms in walls ten thick, side by side, with a
    door of 35 and its symbol between them; every third plan is a diamond with a wall down its middle instead.
    """
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").where(k % 10 == 0).select(k.alias("img"), (k % 3 == 0).alias("bent"), (110 + 7 * (k % 4)).cast("int").alias("mid"))
    box = lambda *c: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("int").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), c)])
    m = F.col("mid")
    straight = [box(10, 10, 250, 19), box(10, 140, 250, 149), box(10, 10, 19, 149), box(241, 10, 250, 149), box(m, 10, m + 9, 60), box(m, 95, m + 9, 149), box(m - 18, 74, m - 10, 81)]
    flat = s.where("not bent").select("img", F.inline(F.array(*straight)))
    flat = flat.select("img", F.explode(F.sequence("y0", "y1")).alias("y"), "x0", "x1")
    bent = s.where("bent").select("img", F.explode(F.sequence(F.lit(8), F.lit(212))).alias("y")).withColumn("dy", F.abs(F.col("y") - 110))
    part = lambda low, high: F.struct(F.greatest(low, F.lit(0)).cast("int").alias("x0"), high.cast("int").alias("x1"))
    outer, inner = 102 - F.col("dy"), F.greatest(90 - F.col("dy"), F.lit(0))
    ring = F.array(part(130 - outer, 130 - inner), part(130 + inner, 130 + outer), part(F.lit(126), F.when(F.col("dy") <= 96, 134).otherwise(125)))
    bent = bent.select("img", "y", F.inline(ring)).where("x0 <= x1")
    px = flat.unionByName(bent.select("img", "y", "x0", "x1")).withColumn("gray", F.lit(30))
    sizes = s.select("img", F.lit(270).alias("width"), F.lit(220).alias("height"))
    name = lambda n, x, y: F.struct(F.lit(n).alias("ord"), F.concat(F.lit("RUANG "), F.lit("AB"[n])).alias("name"), x.cast("double").alias("cx"), y.cast("double").alias("cy"))
    low, high = F.when(F.col("bent"), 90).otherwise(60), F.when(F.col("bent"), 170).otherwise(200)
    down = F.when(F.col("bent"), 110).otherwise(115)
    at = s.select("img", F.inline(F.array(name(0, low, down), name(1, high, down))))
    return px, sizes, at.select("*", *[(F.col(c) + d).alias(n) for n, c, d in (("x0", "cx", -10), ("y0", "cy", -5), ("x1", "cx", 10), ("y1", "cy", 5))])


def vector_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drawings, words and pages in points: the ``IMAGE_PARTS`` parts of an image as rooms in two rows of five, each a black
    rectangle of a size by its key with its name in the middle; and on every page a title block far off, with a number.
    """
    k = F.col("p_partkey")
    x0, y0 = (40.0 + 70 * (k % 5)).cast("double"), (40.0 + 60 * F.floor(k % IMAGE_PARTS / 5)).cast("double")
    x1, y1 = x0 + 44 + k % 3 * 4, y0 + 36 + k % 4 * 3
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    seg = lambda *c: F.struct(*[v.cast("double").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), c)])
    ring = lambda a, b, c, d: F.array(seg(a, b, c, b), seg(c, b, c, d), seg(c, d, a, d), seg(a, d, a, b))
    p = table(spark, sf_dir, "part")
    black = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    none = F.lit(None).cast("array<double>")
    draw = lambda id_, fill, color, n, segs, a, b, c, d: [id_.alias("draw_id"), fill.alias("fill"), color.alias("color"), F.lit(n).alias("n_items"), segs.alias("segs"), a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1")]
    rooms_ = p.select(image(k).alias("page"), *draw(k, black, none, 4, ring(x0, y0, x1, y1), x0, y0, x1, y1))
    pages = p.select(image(k).alias("page")).distinct().select("page", F.lit(600.0).alias("width"), F.lit(300.0).alias("height"))
    far = [F.lit(v) for v in (500.0, 200.0, 560.0, 260.0)]
    block = pages.select("page", *draw(F.lit(-1).cast("long"), black, none, 4, ring(*far), *far))
    word = lambda text, a, b, c, d: [a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"), text.alias("text")]
    texts = p.select(image(k).alias("page"), *word(F.element_at(F.split("p_name", " "), 1), cx - 6, cy - 3, cx + 6, cy + 3))
    title = pages.select("page", *word(F.lit("JUDUL"), *[F.lit(v) for v in (510.0, 220.0, 530.0, 226.0)])).unionByName(pages.select("page", *word(F.lit("2.50"), *[F.lit(v) for v in (300.0, 45.0, 302.0, 46.0)])))
    return rooms_.unionByName(block), texts.unionByName(title), pages
