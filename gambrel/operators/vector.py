"""Vector drawings of plan pages: classes, the largest cluster, and masks from their lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gambrel.functions import polygon as P
from gambrel.functions.labels import token
from gambrel.operators import runs as R
from gambrel.operators.components import components
from gambrel.shared import by_groups, partitions, settled

DARK, ITEMS, BENT, GAP, ZOOM = 1.5, 10, 0.02, 40.0, 2.0


def _sum(color: Column) -> Column:
    return F.aggregate(color, F.lit(0.0), lambda a, c: a + c)


def drawing_class(fill: Column, color: Column, n_items: Column, points: Column) -> Column:
    """V2: wall if filled dark; curve if stroked dark, unfilled, of ten items or more and bent; else null."""
    return F.when(fill.isNotNull() & (_sum(fill) < DARK), "wall").when(fill.isNull() & color.isNotNull() & (_sum(color) < DARK) & (n_items >= ITEMS) & (P.straightness(points) >= BENT), "curve")


def joined_in_cell(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, gap: float) -> list[int]:
    """For each rect, sorted by x0, the place of the first one that it is joined to over rects within ``gap``.

    A sweep over the left sides: of each slot, a rect's top side, only what reaches furthest to the right can still be met,
    so a rect looks at the slots that it covers, not at all rects nearby.
    """
    root = list(range(len(x0)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    slots = np.unique(y0)
    first, end = np.searchsorted(slots, y0), np.searchsorted(slots, y1 + gap, "right")
    reach, last = np.full(len(slots), -np.inf), np.zeros(len(slots), np.int64)
    for i, (a, b, x, right) in enumerate(zip(first.tolist(), end.tolist(), x0.tolist(), (x1 + gap).tolist())):
        here = reach[a:b]
        met = here >= x
        for k in set(last[a:b][met].tolist()):
            p, q = sorted((top(i), top(k)))
            root[q] = p
        last[a:b][met | (here < right)] = i
        np.maximum(here, right, out=here)
    return [top(i) for i in range(len(root))]


def rect_clusters(rects: DataFrame, gap: float = GAP, cell: float = 128.0) -> DataFrame:
    """V3: rects (page, id, x0, y0, x1, y1) with the cluster of those within ``gap`` of each other.

    Of equal rects the one with the least id stands for all. These are dealt to the grid cells that they, grown by the gap,
    touch. A cell joins its rects by itself, in order of their left sides, and gives each one link to the first of its cluster
    there, not one for each near pair; clusters of cells are then joined over the rects that they share.
    """
    at = lambda c: F.floor(c / cell).cast("int")
    sides = ["x0", "y0", "x1", "y1"]
    boxed = rects.withColumn("box", F.struct("page", *[F.col(c).cast("double").alias(c) for c in sides]))
    alone = settled(boxed.groupBy("box").agg(F.min("id").alias("id")), "rects")
    grown = alone.select("box.*", "id").withColumn("gx", F.explode(F.sequence(at(F.col("x0") - gap), at(F.col("x1") + gap)))).withColumn("gy", F.explode(F.sequence(at(F.col("y0") - gap), at(F.col("y1") + gap))))
    kind = dict(rects.dtypes)
    keys = ["page", "gx", "gy"]

    def one(table: pa.Table, starts: np.ndarray) -> pa.Table:
        box, found = [table.column(c).to_numpy() for c in sides], []
        for first, end in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
            found += [first + k for k in joined_in_cell(*(c[first:end] for c in box), gap)]
        page, own = table.column("page"), table.column("id")
        return pa.Table.from_arrays([page, own, own.take(pa.array(found, pa.int64()))], names=["page", "a", "b"])

    links = by_groups(grown, keys, ["x0", "id"], one, f"page {kind['page']}, a {kind['id']}, b {kind['id']}").where("a <> b")
    found = components(links.select(F.struct("page", F.col("a").alias("id")).alias("a"), F.struct("page", F.col("b").alias("id")).alias("b")))
    named = alone.withColumn("node", F.struct("box.page", "id")).join(found, "node", "left")
    return boxed.join(named.select("box", F.coalesce("label.id", "id").alias("cluster")), "box").drop("box")


def largest_cluster(rects: DataFrame, gap: float = GAP) -> DataFrame:
    """V3: the rects of each page's cluster of most rects, the one with the least id of equals."""
    c = rect_clusters(rects, gap)
    best = c.groupBy("page", "cluster").agg(F.count(F.lit(1)).alias("n")).groupBy("page").agg(F.max_by("cluster", F.struct("n", -F.col("cluster"))).alias("cluster"))
    return c.join(best, ["page", "cluster"], "left_semi")


def lines_as_runs(segments: DataFrame, zoom: float = ZOOM) -> DataFrame:
    """V4: line items (img, x0, y0, x1, y1, in points) as the runs of a mask, one sample a pixel of the longer side."""
    s = segments.select("img", *[(F.col(c) * zoom).alias(c) for c in ("x0", "y0", "x1", "y1")])
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))).cast("int"))
    p = s.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = p.select("img", F.round(F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("k") / F.col("n")).cast("int").alias("y"), F.round(F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("k") / F.col("n")).cast("int").alias("x"))
    return R.runs_of(at.distinct())


def lines_as_boxes(segments: DataFrame) -> DataFrame:
    """The same mask as ``lines_as_runs`` gives without zoom, as boxes (img, y0, x0, y1, x1) that may overlap: one for a line along
    an axis between whole pixels, else one a sample."""
    s = segments.select("img", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    whole = F.lit(True)
    for c in ("x0", "y0", "x1", "y1"):
        whole &= F.col(c) == F.floor(c)
    box = lambda *ends: F.struct(*[e.cast("int").alias(n) for e, n in zip(ends, ("y0", "x0", "y1", "x1"))])
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(dx), F.abs(dy))).cast("int"))
    at = lambda k: (F.round(F.col("y0") + dy * k / n), F.round(F.col("x0") + dx * k / n))
    straight = F.array(box(F.least("y0", "y1"), F.least("x0", "x1"), F.greatest("y0", "y1"), F.greatest("x0", "x1")))
    return s.select("img", F.inline(F.when(whole & ((dx == 0) | (dy == 0)), straight).otherwise(F.transform(F.sequence(F.lit(0), n), lambda k: box(*at(k), *at(k))))))


def page_mask(segments: DataFrame, words: DataFrame, sizes: DataFrame, zoom: float = ZOOM, margin: int = 6) -> DataFrame:
    """V4: a page's line mask less boxes around its words (img, x0, y0, x1, y1, in points)."""
    boxes = words.select("img", *[F.round(F.col(c) * zoom).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return R.minus(lines_as_runs(segments, zoom), R.boxes_as_runs(boxes, margin), sizes)


def page_words(words: DataFrame, boxes: DataFrame, slack: float = 1.0) -> DataFrame:
    """Words (img, x0, y0, x1, y1, text) inside the plan's box (img, px0, py0, px1, py1), with numeric where they have
    a digit."""
    j = words.join(boxes, "img")
    inside = (F.col("x0") >= F.col("px0") - slack) & (F.col("y0") >= F.col("py0") - slack) & (F.col("x1") <= F.col("px1") + slack) & (F.col("y1") <= F.col("py1") + slack)
    return j.where(inside).select("img", token(F.col("text")).alias("text"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), "x0", "y0", "x1", "y1", F.rlike("text", F.lit("[0-9]")).alias("numeric"))


def overlapping_boxes(boxes: DataFrame, cell: float = 32.0) -> DataFrame:
    """(graph, a, b) of boxes (graph, node, x0, y0, x1, y1), a below b, that share more than 1 in both dimensions. Boxes
    meet in the grid cells they touch, dealt to as many tasks as a shuffle has, however few bytes they are: the work is the pairs. A pair counts in the cell of the corner where its intersection begins."""
    at = lambda c: F.floor(c / cell)
    dealt = boxes.withColumn("gx", F.explode(F.sequence(at(F.col("x0")), at(F.col("x1"))))).withColumn("gy", F.explode(F.sequence(at(F.col("y0")), at(F.col("y1")))))
    dealt = dealt.repartition(partitions(boxes), "graph", "gx", "gy")
    side = lambda s: dealt.select("graph", "gx", "gy", F.col("node").alias(s), *[F.col(c).alias(f"{s}{c}") for c in ("x0", "y0", "x1", "y1")])
    j = side("a").hint("merge").join(side("b"), ["graph", "gx", "gy"]).where("a < b").where((F.col("gx") == at(F.greatest("ax0", "bx0"))) & (F.col("gy") == at(F.greatest("ay0", "by0"))))
    met = P.box_overlap(*[F.col(f"{s}{c}") for s in "ab" for c in ("x0", "y0", "x1", "y1")])
    return j.where(met.isNotNull()).select("graph", "a", "b")
