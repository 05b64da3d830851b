"""R2: distances of mask pixels from the background, and nearest pairs of components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from gambrel.operators import runs as R
from gambrel.operators.components import components
from gambrel.shared import by_groups, settled

#: The steps of the 3 x 3 metric, along an axis and across.
STRAIGHT, ACROSS = 0.955, 1.3693
#: Cells by which components find their nearest parts, from coarse to fine; each divides the one before.
CELLS = (256, 32)
#: So far, in lines, stands for no background.
FAR = 1 << 30


def euclid(dx, g):
    return np.sqrt(dx * dx + g * g)


def chamfer(dx, g):
    """The least cost of straight and oblique steps."""
    low = np.minimum(dx, g)
    return np.where(np.isinf(g), np.inf, STRAIGHT * (np.maximum(dx, g) - low) + ACROSS * low)


def along_line(g: np.ndarray, left: bool, right: bool, cost) -> np.ndarray:
    """Distances of the pixels of a run from ``g``, their distances up and down a column; ``left``, ``right``: whether
    background lies beside the run. Either metric grows with both of its parts, so the nearest of a column is enough, and
    shifts need go no further than the largest distance found so far."""
    n = len(g)
    wide = np.concatenate([[0.0 if left else np.inf], g, [0.0 if right else np.inf]])
    best = cost(0.0, wide)
    for k in range(1, n + 1):
        if cost(float(k), 0.0) >= best[1:-1].max():
            break
        best[k:] = np.minimum(best[k:], cost(float(k), wide[:-k]))
        best[:-k] = np.minimum(best[:-k], cost(float(k), wide[k:]))
    return best[1:-1]


def down_columns(image: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Each pixel's distance from the background above it; ``before``: how much of the mask lies over each column."""
    out, far = image.astype(np.int32), before.astype(np.int32)
    for line in out:
        far += 1
        far *= line
        line[:] = far
    return out


def along_lines(g: np.ndarray, x0: np.ndarray, x1: np.ndarray, width: int, cost) -> np.ndarray:
    """``along_line`` of many runs, their pixels' ``g`` one after the other: runs that touch no side of the image at once, with
    a pixel of background between them, which is nearer than what lies beyond."""
    size = x1 - x0 + 1
    side = (x0 <= 0) | (x1 >= width - 1)
    of = np.repeat(side, size)
    inner = size[~side]
    at = np.arange(inner.sum()) + np.repeat(np.arange(1, len(inner) + 1), inner)
    wide = np.zeros(inner.sum() + len(inner) + 1)
    wide[at] = g[~of]
    best, k = cost(0.0, wide), 1
    while k < len(wide) and cost(float(k), 0.0) < best.max():
        best[k:] = np.minimum(best[k:], cost(float(k), wide[:-k]))
        best[:-k] = np.minimum(best[:-k], cost(float(k), wide[k:]))
        k += 1
    out = np.empty(len(g))
    out[~of] = best[at]
    ends = np.cumsum(size)
    for r in np.flatnonzero(side):
        part = slice(ends[r] - size[r], ends[r])
        out[part] = along_line(g[part], x0[r] > 0, x1[r] < width - 1, cost)
    return out


def _beyond(boxes: DataFrame, tall: DataFrame) -> DataFrame:
    """For each stripe and column of ``tall`` images (img, width, height, lines), the nearest line of background above the
    stripe and the nearest below it, in rows like those of boxes: (img, y0, x0, y1, x1, stripe, width, height, lines)."""
    stripes = tall.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / F.col("lines")).cast("int"))))
    rows = stripes.hint("merge").join(boxes, ["img", "stripe"], "left")
    kept = ["stripe", "width", "height", "lines", "x", "first", "last"]
    schema = StructType([tall.schema["img"], *[StructField(n, IntegerType()) for n in kept]])

    def one(keys: tuple, table: pa.Table) -> pa.Table:
        stripe = keys[1].as_py()
        width, height, lines = (table.column(c)[0].as_py() for c in ("width", "height", "lines"))
        low, high = stripe * lines, min(height, stripe * lines + lines) - 1
        free = ~R.paint(*[table.column(c).drop_null().to_numpy() for c in ("y0", "x0", "y1", "x1")], low, high, 0, width - 1)
        some = free.any(axis=0)
        first, last = low + free.argmax(axis=0), high - free[::-1].argmax(axis=0)
        same = [pa.array(np.full(width, v), pa.int32()) for v in (stripe, width, height, lines)]
        cols = [pa.array(np.arange(width), pa.int32()), pa.array(first, pa.int32(), mask=~some), pa.array(last, pa.int32(), mask=~some)]
        return pa.Table.from_arrays([R.repeated(keys[0], width), *same, *cols], names=schema.names)

    lines = rows.groupBy("img", "stripe").applyInArrow(one, schema)
    w = Window.partitionBy("img", "x").orderBy("stripe")
    up = F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    down = F.first("first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return lines.select("img", up.alias("y0"), F.col("x").alias("x0"), down.alias("y1"), F.col("x").alias("x1"), "stripe", "width", "height", "lines")


def distances(mask: DataFrame, sizes: DataFrame, metric: str = "euclid") -> DataFrame:
    """R2: (img, y, x0, x1, d): each run's pixels' distances from the nearest pixel off the mask (runs, or boxes as
    ``walls.boxes`` gives them), infinite where there is none; beyond the image's border nothing counts. ``metric``: euclid,
    or chamfer as 3 x 3 steps give it.

    Two passes over a stripe of lines, painted in a task: distances along columns, then of each line's runs the least of
    (shift, column distance) along it; nothing off a run but the pixels beside it can be nearer. Where an image has more
    than one stripe, each gets the nearest background of its columns above and below. Boxes are shuffled, never pixels.
    """
    cost = {"euclid": euclid, "chamfer": chamfer}[metric]
    height = F.greatest(F.lit(16), F.least(F.lit(R.STRIPE), F.floor(F.lit(R.TILE) / F.greatest(F.col("width"), F.lit(1))))).cast("int")
    canvas = sizes.select("img", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height")).withColumn("lines", height)
    boxes = R.in_stripes(R.as_boxes(mask).join(canvas, "img"), F.col("lines"))
    tall = canvas.where("height > lines and width > 0")
    rows = boxes.withColumn("beyond", F.lit(False))
    if not tall.isEmpty():
        rows = rows.unionByName(_beyond(boxes.drop("width", "height", "lines"), tall).withColumn("beyond", F.lit(True)))
    schema = StructType([canvas.schema["img"], *[StructField(n, IntegerType()) for n in ("y", "x0", "x1")], StructField("d", ArrayType(DoubleType()))])

    def one(keys: tuple, table: pa.Table) -> pa.Table:
        width, height, lines = (table.column(c)[0].as_py() for c in ("width", "height", "lines"))
        first = keys[1].as_py() * lines
        last = min(height, first + lines) - 1
        own = table.filter(pc.invert(table.column("beyond")))
        if not own.num_rows:
            return pa.Table.from_arrays([pa.array([], keys[0].type), *[pa.array([], pa.int32())] * 3, pa.array([], pa.list_(pa.float64()))], names=schema.names)
        box = [own.column(c).to_numpy() for c in ("y0", "x0", "y1", "x1")]
        top, left, end, right = max(first, int(box[0].min())), int(box[1].min()), min(first + lines - 1, int(box[2].max())), int(box[3].max())
        image = R.paint(*box, top, end, left, right)
        up, down = np.full(image.shape[1], FAR), np.full(image.shape[1], FAR)
        further = table.filter(table.column("beyond"))
        at = further.column("x0").to_numpy() - left
        on = (at >= 0) & (at < len(up))
        if top > first:
            up[:] = 0
        else:
            up[at[on]] = top - 1 - further.column("y0").fill_null(top - 1 - FAR).to_numpy()[on]
        if end < last:
            down[:] = 0
        else:
            down[at[on]] = further.column("y1").fill_null(end + 1 + FAR).to_numpy()[on] - end - 1
        g = np.minimum(down_columns(image, up), down_columns(image[::-1], down)[::-1])[image]
        g = np.where(g >= FAR, np.inf, g)
        y, x0, x1 = R.lines_of(image, top, left)
        d = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(x1 - x0 + 1)]), pa.int32()), pa.array(along_lines(g, x0, x1, width, cost)))
        return pa.Table.from_arrays([R.repeated(keys[0], len(y)), *[pa.array(c, pa.int32()) for c in (y, x0, x1)], d], names=schema.names)

    return rows.groupBy("img", "stripe").applyInArrow(one, schema)


def near_squares(image: np.ndarray, most: int) -> np.ndarray:
    """Squares of an image's pixels' distances from the background, at most that of ``most``; 0 off the mask. Columns first, then
    shifts along lines: nothing further than ``most`` is looked at."""
    square = image.astype(np.min_scalar_type(2 * most * most)) * (most * most)
    for axis in (0, 1):
        best, square_t = square.copy(), square if axis == 0 else square.T
        best_t = best if axis == 0 else best.T
        for k in range(1, most):
            further = square_t + square.dtype.type(k * k)
            np.minimum(best_t[k:], further[:-k], out=best_t[k:])
            np.minimum(best_t[:-k], further[k:], out=best_t[:-k])
        square = best
    return square


def near_sums(mask: DataFrame, sizes: DataFrame, least: float, most: int) -> DataFrame:
    """R2: (img, pixels, thick, total): of each image's mask pixels (runs, or boxes as ``walls.boxes`` gives them), their number,
    that of those ``least`` or more from the background, and the sum of their distances, ``most`` at most each; beyond the
    image's border nothing counts, and images without a pixel drop out.

    A task draws a stripe with ``most`` lines more, and only its sums leave it.
    """
    canvas = sizes.where("height > 0 and width > 0").select("img", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    lines = F.greatest(F.lit(16), F.least(F.lit(R.STRIPE), F.floor(F.lit(R.TILE) / F.col("width")))).cast("int")
    boxes = R.as_boxes(mask).hint("merge").join(canvas.withColumn("lines", lines), "img")
    last = F.floor((F.col("height") - 1) / F.col("lines")).cast("int")
    of = lambda y: F.least(F.greatest(F.floor(y / F.col("lines")).cast("int"), F.lit(0)), last)
    rows = boxes.withColumn("stripe", F.explode(F.sequence(of(F.col("y0") - most), of(F.col("y1") + most))))
    squares = sorted({d for x in range(most) for y in range(most) if 0 < (d := x * x + y * y) < most * most} | {most * most})
    roots = [math.sqrt(q) for q in squares]
    schema = StructType([canvas.schema["img"], StructField("pixels", LongType()), StructField("thick", LongType()), StructField("total", DoubleType())])

    def one(table: pa.Table, starts: np.ndarray) -> pa.Table:
        box = [table.column(c).to_numpy() for c in ("y0", "x0", "y1", "x1")]
        head = zip(*(table.column(c).to_numpy()[starts].tolist() for c in ("width", "height", "lines", "stripe")))
        sums = []
        for first, end, (width, height, step, k) in zip(starts.tolist(), [*starts[1:].tolist(), len(box[0])], head):
            own = [e[first:end] for e in box]
            low, high = k * step, min(height, k * step + step) - 1
            # around the boxes, ``most`` further to each side
            top, bottom = max(low, int(own[0].min())) - most, min(high, int(own[2].max())) + most
            left, right = max(0, int(own[1].min())) - most, min(width - 1, int(own[3].max())) + most
            if top + most > bottom - most or left + most > right - most:
                sums.append((0, 0, 0.0))
                continue
            image = R.paint(*own, top, bottom, left, right)
            # beyond the image's border there is no background
            edges = [max(0, -top), min(height, bottom + 1) - top, max(0, -left), min(width, right + 1) - left]
            for beyond in (image[: edges[0]], image[edges[1] :], image[:, : edges[2]], image[:, edges[3] :]):
                beyond[:] = True
            square = near_squares(image, most)[max(low - top, edges[0]) : min(high - top + 1, edges[1]), edges[2] : edges[3]]
            n = [int(np.count_nonzero(square == q)) for q in squares]
            sums.append((sum(n), sum(k for k, d in zip(n, roots) if d >= least), sum(k * d for k, d in zip(n, roots))))
        cols = [pa.array(c, kind) for c, kind in zip(zip(*sums), (pa.int64(), pa.int64(), pa.float64()))]
        return pa.Table.from_arrays([table.column("img").take(pa.array(starts)), *cols], names=schema.names)

    parts = by_groups(rows, ["img", "stripe"], [], one, schema, spread=True)
    return parts.groupBy("img").agg(F.sum("pixels").alias("pixels"), F.sum("thick").alias("thick"), F.sum("total").alias("total")).where("pixels > 0")


def at_least(far: DataFrame, distance: float) -> DataFrame:
    """The pixels of ``distances`` that are so far from the background, as runs."""
    px = far.select("img", "y", "x0", F.posexplode("d").alias("k", "v")).where(F.col("v") >= distance)
    return R.runs_of(px.select("img", "y", (F.col("x0") + F.col("k")).alias("x")))


def half_thickness(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """(img, half): the median 3 x 3 distance of an image's mask pixels."""
    px = distances(mask, sizes, "chamfer").select("img", F.explode("d").alias("d"))
    return px.groupBy("img").agg(F.median("d").alias("half"))


def _boxes(pieces: DataFrame, side: int) -> DataFrame:
    """(img, comp, cy, cx, x0, y0, x1, y1): the bounds of a component's pieces in each cell."""
    cells = pieces.groupBy("img", "comp", F.floor(F.col("y") / side).alias("cy"), F.floor(F.col("x0") / side).alias("cx"))
    return cells.agg(F.min("x0").alias("bx0"), F.min("y").alias("by0"), F.max("x1").alias("bx1"), F.max("y").alias("by1"))


def component_gaps(labels: DataFrame, least: int = 800) -> DataFrame:
    """(img, i, j, gap, xi, yi, xj, yj) for the pairs of large components of each image: their least distance and the
    pixels that are so near; of equals the first by line and column.

    Branch and bound over grid cells: bounds of a component's parts in coarse cells give each pair of components a distance
    that it surely has at most, and pairs of cells that are further apart drop out; finer cells of the rest likewise; only
    runs in the cells left are held against each other. The result has a row a pair of components, so images with many large
    ones give many rows; the work inside a pair is a few cells, not all runs.
    """
    big = R.measures(labels).where(F.col("area") >= least).select("img", "comp")
    lines = labels.join(big, ["img", "comp"], "left_semi").select("img", "comp", "y", "x0", "x1")
    fine = CELLS[-1]
    # runs cut at the finest cells' borders, so that a piece lies in one cell of every size
    cell = lambda c: F.floor(F.col(c) / fine)
    pieces = lines.withColumn("c", F.explode(F.sequence(cell("x0"), cell("x1")))).select("img", "comp", "y", F.greatest("x0", F.col("c") * fine).cast("int").alias("x0"), F.least("x1", (F.col("c") + 1) * fine - 1).cast("int").alias("x1"))
    pieces = settled(pieces, "pieces")
    left, before = None, None
    for side in CELLS:
        boxes = _boxes(pieces, side)
        one = lambda s: boxes.select("img", F.col("comp").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("cy", "cx", "bx0", "by0", "bx1", "by1")])
        if left is None:
            pairs = one("i").join(one("j"), "img").where("i < j")
        else:
            up = before // side
            parent = lambda s: one(s).withColumns({f"py_{s}": F.floor(F.col(f"cy_{s}") / up), f"px_{s}": F.floor(F.col(f"cx_{s}") / up)})
            kept = left.withColumnsRenamed({f"c{a}_{s}": f"p{a}_{s}" for a in "yx" for s in "ij"})
            pairs = kept.join(parent("i"), ["img", "i", "py_i", "px_i"]).join(parent("j"), ["img", "j", "py_j", "px_j"])
        apart = lambda a: F.greatest(F.col(f"b{a}0_j") - F.col(f"b{a}1_i"), F.col(f"b{a}0_i") - F.col(f"b{a}1_j"), F.lit(0)).cast("long")
        across = lambda a: F.greatest(F.col(f"b{a}1_j") - F.col(f"b{a}0_i"), F.col(f"b{a}1_i") - F.col(f"b{a}0_j")).cast("long")
        square = lambda f: f("x") * f("x") + f("y") * f("y")
        pairs = pairs.withColumns({"near": square(apart), "far": square(across)})
        most = F.min("far").over(Window.partitionBy("img", "i", "j"))
        left = settled(pairs.withColumn("most", most).where("near <= most").select("img", "i", "j", "cy_i", "cx_i", "cy_j", "cx_j"), "cells")
        before = side
    piece = lambda s: pieces.select("img", F.col("comp").alias(s), F.floor(F.col("y") / fine).alias(f"cy_{s}"), F.floor(F.col("x0") / fine).alias(f"cx_{s}"), F.col("y").alias(f"y{s}"), F.col("x0").alias(f"a{s}"), F.col("x1").alias(f"b{s}"))
    met = left.join(piece("i"), ["img", "i", "cy_i", "cx_i"]).join(piece("j"), ["img", "j", "cy_j", "cx_j"])
    both = F.greatest("ai", "aj")
    xi = F.when(F.col("bi") < F.col("aj"), F.col("bi")).when(F.col("bj") < F.col("ai"), F.col("ai")).otherwise(both)
    xj = F.when(F.col("bi") < F.col("aj"), F.col("aj")).when(F.col("bj") < F.col("ai"), F.col("bj")).otherwise(both)
    met = met.withColumns({"xi": xi, "xj": xj})
    square = (F.col("yi") - F.col("yj")).cast("long") * (F.col("yi") - F.col("yj")) + (F.col("xi") - F.col("xj")).cast("long") * (F.col("xi") - F.col("xj"))
    nearest = met.groupBy("img", "i", "j").agg(F.min(F.struct(square.alias("d"), "yi", "xi", "yj", "xj")).alias("m"))
    return nearest.select("img", "i", "j", F.sqrt(F.col("m.d").cast("double")).alias("gap"), "m.xi", "m.yi", "m.xj", "m.yj")


def longest_tree_edge(gaps: DataFrame) -> DataFrame:
    """(img, longest): the longest edge of the least spanning tree of components.

    In each round every group of components takes its shortest edge to another one, and what these edges join becomes one
    group; a handful of rounds, each a join. Equal gaps go by i and j, so no round closes a ring.
    """
    edges = settled(gaps.select("img", "i", "j", "gap", F.col("i").alias("gi"), F.col("j").alias("gj")), "tree-edges")
    longest = edges.select("img").distinct().withColumn("longest", F.lit(0.0))
    while not edges.isEmpty():
        both = edges.select("img", F.col("gi").alias("g"), "i", "j", "gap", "gi", "gj").unionByName(edges.select("img", F.col("gj").alias("g"), "i", "j", "gap", "gi", "gj"))
        taken = both.groupBy("img", "g").agg(F.min(F.struct("gap", "i", "j", "gi", "gj")).alias("e")).select("img", "e.*").distinct()
        taken = settled(taken, "tree-taken")
        longest = settled(longest.unionByName(taken.select("img", F.col("gap").alias("longest"))).groupBy("img").agg(F.max("longest").alias("longest")), "tree-longest")
        group = components(taken.select(F.struct("img", F.col("gi").alias("g")).alias("a"), F.struct("img", F.col("gj").alias("g")).alias("b")))
        name = lambda c: group.select(F.col("node.img").alias("img"), F.col("node.g").alias(c), F.col("label.g").alias(f"{c}2"))
        edges = edges.join(name("gi"), ["img", "gi"]).join(name("gj"), ["img", "gj"]).where("gi2 <> gj2")
        edges = settled(edges.select("img", "i", "j", "gap", F.col("gi2").alias("gi"), F.col("gj2").alias("gj")), "tree-edges")
    return longest
