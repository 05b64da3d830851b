"""One-dimensional runs, and masks as tables of runs: (img, y, x0, x1), ends inclusive.

A mask of any size is a few rows a line, so filters, joins and windows do what per-pixel loops would: runs of one line are
gaps and islands, touching runs of neighbouring lines are a range join, and dilation widens runs and merges them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from gambrel.operators.components import components
from gambrel.shared import by_groups, settled

#: Lines of an image that one task labels.
STRIPE = 1024
#: Pixels that a task paints at once.
TILE = 1 << 20


def islands(points: DataFrame, keys: list[str], at: str, bridge: int = 0, least: int = 1) -> DataFrame:
    """(keys, start, stop, n) of positions on a line: gaps of up to ``bridge`` missing positions are closed, shorter
    runs than ``least`` dropped."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.coalesce(F.col(at) - F.lag(at).over(w) - 1 > bridge, F.lit(True)).cast("int")
    grouped = points.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    out = grouped.groupBy(*keys, "__run").agg(F.min(at).alias("start"), F.max(at).alias("stop"), F.count(F.lit(1)).alias("n")).drop("__run")
    return out.where(F.col("stop") - F.col("start") + 1 >= least)


def dashed_lines(points: DataFrame, keys: list[str], line: list[str], at: str, least: int = 5, shortest: int = 8, longest: int = 26, gap: int = 22, span: int = 120) -> DataFrame:
    """Of each ``keys``, the longest chain of dashes on one line; of equals the first: (keys, line, start, stop)."""
    return chained_dashes(islands(points, [*keys, *line], at, bridge=2), keys, line, least, shortest, longest, gap, span)


def chained_dashes(dashes: DataFrame, keys: list[str], line: list[str], least: int = 5, shortest: int = 8, longest: int = 26, gap: int = 22, span: int = 120) -> DataFrame:
    """``dashed_lines`` of runs (keys, line, start, stop) whose own gaps are closed."""
    dashes = dashes.where((F.col("stop") - F.col("start") + 1).between(shortest, longest))
    w = Window.partitionBy(*keys, *line).orderBy("start")
    new = F.coalesce(F.col("start") - F.lag("stop").over(w) > gap, F.lit(True)).cast("int")
    chained = dashes.withColumn("__new", new).withColumn("__chain", F.sum("__new").over(w)).groupBy(*keys, *line, "__chain")
    chains = chained.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("dashes"))
    good = chains.where((F.col("dashes") >= least) & (F.col("stop") - F.col("start") >= span))
    order = Window.partitionBy(*keys).orderBy((F.col("stop") - F.col("start")).desc(), *line, "start")
    return good.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").select(*keys, *line, "start", "stop")


def runs_of(pixels: DataFrame) -> DataFrame:
    """A mask's runs from its pixels (img, y, x)."""
    return islands(pixels, ["img", "y"], "x").select("img", "y", F.col("start").alias("x0"), F.col("stop").alias("x1"))


def merged(runs: DataFrame, bridge: int = 0, least: int = 1) -> DataFrame:
    """Overlapping and adjoining runs of a line as one, also those up to ``bridge`` apart; shorter ones than ``least`` drop out."""
    w = Window.partitionBy("img", "y").orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("x0") > reach + 1 + bridge, F.lit(True)).cast("int")
    g = runs.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w))
    out = g.groupBy("img", "y", "__run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("__run")
    return out.where(F.col("x1") - F.col("x0") + 1 >= least) if least > 1 else out


def ink(pixels: DataFrame, level: int) -> DataFrame:
    """The runs of pixels (img, y, x, gray) darker than ``level``; or of runs of one gray (img, y, x0, x1, gray)."""
    dark = pixels.where(F.col("gray") < level)
    return merged(dark.select("img", "y", "x0", "x1")) if "x0" in pixels.columns else runs_of(dark.select("img", "y", "x"))


def across(runs: DataFrame) -> DataFrame:
    """The same mask with lines and columns exchanged: (img, y, x0, x1), y a column and x0, x1 lines."""
    return painted(as_boxes(runs).select("img", F.col("x0").alias("y0"), F.col("y0").alias("x0"), F.col("x1").alias("y1"), F.col("y1").alias("x1")))


def redrawn(sizes: DataFrame, layers: list[DataFrame], draw, reach: tuple[int, int] = (0, 0), pad: tuple[int, int] = (0, 0), near: int | None = None) -> DataFrame:
    """The runs of what ``draw`` makes of masks (runs or boxes), for each image of ``sizes`` (img, width, height and, if it has
    one, radius): it gets an image of each and the radius, and gives an image as large.

    A task draws a stripe of an image, of so many pixels at most; ``reach``, as so many radii and lines, is how far the masks
    are drawn beyond it, ``pad`` likewise how far beyond the image's borders, both drawn and given back. What lies further out
    is not in the images. Masks are shuffled once. ``near``: boxes (img, y0, x0, y1, x1, own) instead, into which equal runs of
    an area that follow each other are put; own is the stripe's first run of the area, over runs at most so far apart.
    """
    radius = F.col("radius").cast("int") if "radius" in sizes.columns else F.lit(0)
    whole = sizes.where("height > 0 and width > 0").select("img", *[F.col(c).cast("int").alias(c) for c in ("width", "height")], radius.alias("radius"))
    lines = F.greatest(F.lit(16), F.least(F.lit(STRIPE), F.floor(F.lit(TILE) / F.col("width")))).cast("int")
    whole = whole.where("radius is not null").withColumn("lines", lines)
    corners = ("y0", "x0", "y1", "x1")
    last = F.floor((F.col("height") - 1) / F.col("lines")).cast("int")
    rows = whole.select("*", F.explode(F.sequence(F.lit(0), last)).alias("stripe"), F.lit(-1).alias("layer"), *[F.lit(v).alias(c) for c, v in zip(corners, (0, 0, -1, -1))])
    far = reach[0] * F.col("radius") + reach[1]
    of = lambda line: F.least(F.greatest(F.floor(line / F.col("lines")).cast("int"), F.lit(0)), last)
    for k, layer in enumerate(layers):
        met = as_boxes(layer).hint("merge").join(whole, "img")
        stripe = F.explode(F.sequence(of(F.col("y0") - far), of(F.col("y1") + far))).alias("stripe")
        rows = rows.unionByName(met.select(*whole.columns, stripe, F.lit(k).alias("layer"), *corners))
    names = ("y", "x0", "x1") if near is None else corners
    schema = StructType([whole.schema["img"], *[StructField(n, IntegerType()) for n in names], *([] if near is None else [StructField("own", LongType())])])
    masks = np.arange(len(layers) + 1)

    def one(table: pa.Table, starts: np.ndarray) -> pa.Table:
        box = [table.column(c).to_numpy() for c in corners]
        layer = table.column("layer").to_numpy()
        head = zip(*(table.column(c).to_numpy()[starts].tolist() for c in ("width", "height", "radius", "lines", "stripe")))
        at, found = [], [(np.zeros(0, np.int64),) * (len(schema) - 1)]
        for first, end, (width, height, r, step, k) in zip(starts.tolist(), [*starts[1:].tolist(), len(layer)], head):
            more, beyond = reach[0] * r + reach[1], pad[0] * r + pad[1]
            low, high = (k * step if k else -beyond), (k * step + step - 1 if k * step + step < height else height - 1 + beyond)
            top, bottom = max(-beyond, low - more), min(height - 1 + beyond, high + more)
            cut = (first + np.searchsorted(layer[first:end], masks)).tolist()
            images = [paint(*[e[i:j] for e in box], top, bottom, -beyond, width - 1 + beyond) for i, j in zip(cut, cut[1:])]
            y, x0, x1 = lines_of(draw(images, r)[low - top : high - top + 1], low, -beyond)
            if near is None:
                found.append((y, x0, x1))
            else:
                root = label_lines(y, x0, x1, near)
                found.append(stacked(y, x0, x1, (y[root] << 32) + x0[root]))
            at.append(np.full(len(found[-1][0]), first))
        cols = [pa.array(np.concatenate(c), pa.int32() if n != "own" else pa.int64()) for n, c in zip(schema.names[1:], zip(*found))]
        return pa.Table.from_arrays([table.column("img").take(pa.array(np.concatenate([np.zeros(0, np.int64), *at]))), *cols], names=schema.names)

    return by_groups(rows, ["img", "stripe"], ["layer"], one, schema, spread=True)


def widened(image: np.ndarray, shape: dict[int, int]) -> np.ndarray:
    """An image's pixels widened by a shape: its half width for each line above and below."""
    height, width = image.shape
    sums = np.zeros((height, width + 1), np.int32)
    np.cumsum(image, axis=1, out=sums[:, 1:])
    place = np.arange(width)
    out, wide = np.zeros_like(image), {}
    for dy, w in shape.items():
        if abs(dy) >= height:
            continue
        if w not in wide:
            wide = {w: sums[:, np.minimum(place + w + 1, width)] > sums[:, np.maximum(place - w, 0)]}
        if dy >= 0:
            out[dy:] |= wide[w][: height - dy]
        else:
            out[:dy] |= wide[w][-dy:]
    return out


def complement(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """What the mask leaves of images of ``sizes`` (img, width, height)."""
    return redrawn(sizes.select("img", "width", "height"), [runs], lambda images, _: ~images[0])


def disc(radius: int) -> dict[int, int]:
    return {dy: int(math.sqrt(radius * radius - dy * dy)) for dy in range(-radius, radius + 1)}


def square(radius: int) -> dict[int, int]:
    return dict.fromkeys(range(-radius, radius + 1), radius)


def dilated(runs: DataFrame, shape: dict[int, int]) -> DataFrame:
    """Runs widened by a shape: its half width for each line above and below."""
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dy, w in shape.items()])
    wide = runs.select("img", "y", "x0", "x1", F.explode(offsets).alias("o"))
    return merged(wide.select("img", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x0") - F.col("o.w")).alias("x0"), (F.col("x1") + F.col("o.w")).alias("x1")))


def eroded(runs: DataFrame, sizes: DataFrame, shape: dict[int, int]) -> DataFrame:
    """What stays of a mask when its complement in the image grows by the shape; outside the image nothing grows."""
    most = max(map(abs, shape))
    return redrawn(sizes.select("img", "width", "height"), [runs], lambda images, _: ~widened(~images[0], shape), reach=(0, most))


def closed(runs: DataFrame, sizes: DataFrame, radius: int | DataFrame) -> DataFrame:
    """Dilation, then erosion, by a disc of ``radius``, a number or (img, radius), on a canvas widened so that borders do
    not matter."""
    canvas = sizes.select("img", "width", "height")
    canvas = canvas.withColumn("radius", F.lit(radius)) if isinstance(radius, int) else canvas.hint("merge").join(radius, "img")

    def draw(images: list[np.ndarray], r: int) -> np.ndarray:
        # lines of one width, above and below, follow each other
        shape = dict(sorted(disc(r).items(), key=lambda s: abs(s[0])))
        return ~widened(~widened(images[0], shape), shape)

    return redrawn(canvas, [runs], draw, reach=(2, 1), pad=(1, 1))


def minus(runs: DataFrame, other: DataFrame, sizes: DataFrame) -> DataFrame:
    """The runs less those of another mask."""
    return redrawn(sizes.select("img", "width", "height"), [runs, other], lambda images, _: images[0] & ~images[1])


def label_lines(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> np.ndarray:
    """For each run, sorted by (y, x0), the place of the first run that it is connected to."""
    n = len(y)
    root = np.arange(n)
    if not n:
        return root
    low = int(x0.min()) - reach
    wide = int(x1.max()) + reach - low + 1
    line = (y - y[0]).astype(np.int64) * wide - low
    # touching runs of the next line lie together, as runs and lines are in order
    first, last = np.searchsorted(line + x1, line + wide + x0 - reach, "left"), np.searchsorted(line + x0, line + wide + x1 + reach, "right")
    n_met = np.maximum(last - first, 0)
    i = np.repeat(np.arange(n), n_met)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n_met) - n_met, n_met) + np.repeat(first, n_met)
    while len(i):
        p, q = root[i], root[j]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return root


def as_boxes(mask: DataFrame) -> DataFrame:
    """(img, y0, x0, y1, x1) of a mask given as such boxes, which may overlap, or as runs; empty ones drop out."""
    ends = ("y0", "y1") if "y0" in mask.columns else ("y", "y")
    cols = zip(("y0", "x0", "y1", "x1"), (ends[0], "x0", ends[1], "x1"))
    return mask.select("img", *[F.col(c).cast("int").alias(n) for n, c in cols]).where("y0 <= y1 and x0 <= x1")


def in_stripes(boxes: DataFrame, lines=STRIPE) -> DataFrame:
    """Boxes once for each stripe of so many lines that they reach."""
    at = lambda c: F.floor(F.col(c) / lines).cast("int")
    return boxes.withColumn("stripe", F.explode(F.sequence(at("y0"), at("y1"))))


def paint(y0: np.ndarray, x0: np.ndarray, y1: np.ndarray, x1: np.ndarray, first: int, last: int, left: int, right: int) -> np.ndarray:
    """Lines ``first`` to ``last`` and columns ``left`` to ``right`` of an image of boxes."""
    out = np.zeros((last - first + 1, right - left + 1), bool)
    ends = [np.maximum(y0, first) - first, np.maximum(x0, left) - left, np.minimum(y1, last) - first + 1, np.minimum(x1, right) - left + 1]
    for a, b, c, d in zip(*(e.tolist() for e in ends)):
        if a < c and b < d:
            out[a:c, b:d] = True
    return out


def lines_of(image: np.ndarray, y: int, x: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (y, x0, x1) of an image whose first pixel is (y, x)."""
    wide = image.shape[1] + 1
    flat = np.zeros((image.shape[0], wide), bool)
    flat[:, :-1] = image
    flat = np.concatenate([[False], flat.ravel()])
    turns = np.flatnonzero(flat[1:] != flat[:-1])
    start, stop = turns[::2], turns[1::2] - 1
    return start // wide + y, start % wide + x, stop % wide + x


def stacked(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Boxes (y0, x0, y1, x1) of runs: equal ones on lines that follow each other, and of the same ``of``, are one box."""
    of = np.zeros(len(y), np.int64) if of is None else of
    order = np.lexsort((y, x1, x0, of))
    y, x0, x1, own = y[order], x0[order], x1[order], of[order]
    new = np.ones(len(y), bool)
    new[1:] = (x0[1:] != x0[:-1]) | (x1[1:] != x1[:-1]) | (y[1:] != y[:-1] + 1) | (own[1:] != own[:-1])
    return y[new], x0[new], y[np.append(new[1:], [True] * min(1, len(y)))], x1[new], own[new]


def as_runs(boxes: DataFrame) -> DataFrame:
    """The lines of boxes that do not touch to the left or right, as ``painted`` gives them, as runs."""
    rest = [c for c in boxes.columns if c not in ("img", "y0", "x0", "y1", "x1")]
    return boxes.select("img", F.explode(F.sequence("y0", "y1")).alias("y"), "x0", "x1", *rest)


def painted(boxes: DataFrame, less: DataFrame | None = None, sizes: DataFrame | None = None, tall: bool = False) -> DataFrame:
    """The runs of a mask of boxes (img, y0, x0, y1, x1), without the pixels of ``less`` and inside the images of ``sizes`` (img,
    width, height), where these are given; ``tall``: as boxes, into which equal runs of lines that follow each other are put.
    Boxes are dealt to stripes of lines, and a task paints a stripe, so many pixels at a time: what is shuffled is the boxes, not
    their lines."""
    boxes = as_boxes(boxes)
    if sizes is not None:
        edge = sizes.select("img", (F.col("width") - 1).cast("int").alias("right"), (F.col("height") - 1).cast("int").alias("bottom"))
        low, high = (lambda c: F.greatest(c, F.lit(0)).alias(c)), (lambda c, end: F.least(c, end).alias(c))
        boxes = as_boxes(boxes.hint("merge").join(edge, "img").select("img", low("y0"), low("x0"), high("y1", "bottom"), high("x1", "right")))
    boxes = in_stripes(boxes).withColumn("off", F.lit(False))
    if less is not None:
        boxes = boxes.unionByName(in_stripes(as_boxes(less)).withColumn("off", F.lit(True)))
    names = ("y0", "x0", "y1", "x1") if tall else ("y", "x0", "x1")
    schema = StructType([boxes.schema["img"], *[StructField(n, IntegerType()) for n in names]])

    def one(table: pa.Table, starts: np.ndarray) -> pa.Table:
        off = table.column("off").to_numpy()
        every = [table.column(c).to_numpy() for c in ("y0", "x0", "y1", "x1")]
        stripe, at, found = table.column("stripe").to_numpy()[starts], [], [(np.zeros(0, np.int64),) * len(names)]
        for first, end, k in zip(starts.tolist(), [*starts[1:].tolist(), len(off)], stripe.tolist()):
            ink, gone = ([e[first:end][which] for e in every] for which in (~off[first:end], off[first:end]))
            if not len(ink[0]):
                continue
            left, right = int(ink[1].min()), int(ink[3].max())
            low, high = max(k * STRIPE, int(ink[0].min())), min(k * STRIPE + STRIPE - 1, int(ink[2].max()))
            step = max(1, TILE // (right - left + 1))
            for y in range(low, high + 1, step):
                last = min(high, y + step - 1)
                image, hole = (paint(*[e[(box[0] <= last) & (box[2] >= y)] for e in box], y, last, left, right) for box in (ink, gone))
                lines = lines_of(image & ~hole if len(gone[0]) else image, y, left)
                found.append(stacked(*lines)[:4] if tall else lines)
                at.append(np.full(len(found[-1][0]), first))
        cols = [pa.array(np.concatenate(c), pa.int32()) for c in zip(*found)]
        img = table.column("img").take(pa.array(np.concatenate([np.zeros(0, np.int64), *at])))
        return pa.Table.from_arrays([img, *cols], names=schema.names)

    return by_groups(boxes, ["img", "stripe"], [], one, schema, spread=True)


def repeated(key: pa.Scalar, n: int) -> pa.Array:
    """A group's key as a column; keys may be structs."""
    return pa.array([key.as_py()], key.type).take(pa.array(np.zeros(n, np.int64)))


def free_areas(mask: DataFrame, sizes: DataFrame, eight: bool = False) -> DataFrame:
    """(img, comp, area, x0, y0, x1, y1), as ``measures`` of the labelled complement of a mask of boxes or runs in images
    of ``sizes`` (img, width, height), without a row a run: a task paints a stripe, labels what is free and measures it;
    areas that go on in the next stripe are joined by their runs at the seam."""
    reach = 1 if eight else 0
    whole = sizes.where("height > 0 and width > 0").select("img", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    stripes = whole.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / STRIPE).cast("int"))))
    rows = stripes.hint("merge").join(in_stripes(as_boxes(mask)), ["img", "stripe"], "left")
    seam = ArrayType(StructType([StructField(n, IntegerType()) for n in ("y", "x0", "x1")]))
    ints = [StructField(n, IntegerType()) for n in ("x0", "y0", "x1", "y1")]
    schema = StructType([whole.schema["img"], StructField("own", LongType()), StructField("area", LongType()), *ints, StructField("seam", seam)])

    def one(keys: tuple, table: pa.Table) -> pa.Table:
        width, height = (table.column(c)[0].as_py() for c in ("width", "height"))
        first = keys[1].as_py() * STRIPE
        last = min(height, first + STRIPE) - 1
        box = [table.column(c).drop_null().to_numpy() for c in ("y0", "x0", "y1", "x1")]
        found = []
        step = max(1, TILE // width)
        for y in range(first, last + 1, step):
            end = min(last, y + step - 1)
            on = (box[0] <= end) & (box[2] >= y)
            found.append(lines_of(~paint(*[e[on] for e in box], y, end, 0, width - 1), y, 0))
        y, x0, x1 = (np.concatenate(c) for c in zip(*found))
        root = label_lines(y, x0, x1, reach)
        comp, at = np.unique(root, return_inverse=True)
        low, high, right = np.full(len(comp), width), np.zeros(len(comp), np.int64), np.zeros(len(comp), np.int64)
        np.minimum.at(low, at, x0)
        np.maximum.at(right, at, x1)
        np.maximum.at(high, at, y)
        area = np.bincount(at, x1 - x0 + 1, len(comp)).astype(np.int64)
        seams: list[list | None] = [None] * len(comp)
        for k in np.flatnonzero(((y == first) & (first > 0)) | ((y == last) & (last < height - 1))):
            seams[at[k]] = [*(seams[at[k]] or []), {"y": int(y[k]), "x0": int(x0[k]), "x1": int(x1[k])}]
        own = (y[comp].astype(np.int64) << 32) + x0[comp]
        cols = [pa.array(c, pa.int32()) for c in (low, y[comp], right, high)]
        kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("y", "x0", "x1")]))
        return pa.Table.from_arrays([repeated(keys[0], len(comp)), pa.array(own), pa.array(area), *cols, pa.array(seams, kind)], names=schema.names)

    parts = rows.groupBy("img", "stripe").applyInArrow(one, schema)
    if whole.where(F.col("height") > STRIPE).isEmpty():
        return parts.select("img", F.col("own").alias("comp"), "area", "x0", "y0", "x1", "y1")
    parts = settled(parts, "areas").withColumn("node", F.struct("img", "own"))
    edge = parts.select("img", "node", F.inline("seam"))
    low = edge.where((F.col("y") + 1) % STRIPE == 0).select("img", (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("node").alias("a"))
    touch = low.join(edge.where(F.col("y") % STRIPE == 0), ["img", "y"]).where((F.col("u0") <= F.col("x1") + reach) & (F.col("u1") + reach >= F.col("x0")))
    found = components(touch.select("a", F.col("node").alias("b")))
    named = parts.join(found, "node", "left").withColumn("comp", F.coalesce("label.own", "own"))
    ends = [f(c).alias(f"b{c}") for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    return named.groupBy("img", "comp").agg(F.sum("area").alias("area"), *ends).withColumnsRenamed({f"b{c}": c for c in ("x0", "y0", "x1", "y1")})


def labelled(runs: DataFrame, eight: bool = False) -> DataFrame:
    """(img, y, x0, x1, comp) of connected components; comp is the first run's place, y * 2^32 + x0.

    Stripes of STRIPE lines are labelled each by itself, many small ones at once, then the labels of runs that touch across stripes are joined, so
    an image of any height is spread over tasks and only labels at the seams meet.
    """
    reach = 1 if eight else 0
    runs = runs.select("img", F.col("y").cast("int").alias("y"), F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1")).withColumn("stripe", F.floor(F.col("y") / STRIPE).cast("int"))
    schema = StructType([*runs.schema.fields, StructField("own", LongType())])

    def one(table: pa.Table, starts: np.ndarray) -> pa.Table:
        y, x0, x1 = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
        # stripes one below the other, two lines apart
        size = np.diff([*starts, len(y)])
        last = y[np.append(starts[1:], len(y)) - 1]
        down = np.cumsum(np.append(0, last[:-1] + 2 - y[starts][1:]))
        root = label_lines(y + np.repeat(down, size), x0, x1, reach)
        return table.append_column("own", pa.array((y[root] << 32) + x0[root]))

    named = settled(by_groups(runs, ["img", "stripe"], ["y", "x0"], one, schema), "stripes").withColumn("node", F.struct("img", "own"))
    low = named.where((F.col("y") + 1) % STRIPE == 0).select("img", (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("node").alias("a"))
    if low.isEmpty():
        return named.select("img", "y", "x0", "x1", F.col("own").alias("comp"))
    touch = low.join(named.where(F.col("y") % STRIPE == 0), ["img", "y"]).where((F.col("u0") <= F.col("x1") + reach) & (F.col("u1") + reach >= F.col("x0")))
    found = components(touch.select("a", F.col("node").alias("b")))
    return settled(named.join(found, "node", "left").select("img", "y", "x0", "x1", F.coalesce("label.own", "own").alias("comp")), "labelled")


def free_boxes(mask: DataFrame, sizes: DataFrame, eight: bool = False) -> DataFrame:
    """(img, y0, x0, y1, x1, comp): what ``labelled`` gives of the mask's complement in images of ``sizes``, with equal runs
    that follow each other as one box. Images that fit in a stripe are drawn and labelled in one go, others line by line."""
    fits = (F.col("height") <= STRIPE) & (F.col("width").cast("long") * F.col("height") <= TILE)
    canvas = sizes.select("img", "width", "height")
    out = redrawn(canvas.where(fits), [mask], lambda images, _: ~images[0], near=int(eight)).withColumnRenamed("own", "comp")
    large = canvas.where(~fits)
    if large.isEmpty():
        return out
    rest = labelled(complement(mask, large), eight)
    return out.unionByName(rest.select("img", F.col("y").alias("y0"), "x0", F.col("y").alias("y1"), "x1", "comp"))


def measures(labels: DataFrame) -> DataFrame:
    """(img, comp, area, x0, y0, x1, y1) of labelled runs or boxes."""
    low, high = ("y0", "y1") if "y0" in labels.columns else ("y", "y")
    size = F.sum((F.col("x1") - F.col("x0") + 1) * (F.col(high) - F.col(low) + 1).cast("long")).cast("long")
    return labels.groupBy("img", "comp").agg(size.alias("area"), F.min("x0").alias("bx0"), F.min(low).alias("by0"), F.max("x1").alias("bx1"), F.max(high).alias("by1")).select("img", "comp", "area", F.col("bx0").alias("x0"), F.col("by0").alias("y0"), F.col("bx1").alias("x1"), F.col("by1").alias("y1"))


def boxes_as_runs(boxes: DataFrame, margin: int = 0) -> DataFrame:
    """Boxes (img, x0, y0, x1, y1) as runs, for holes punched around labels."""
    lines = boxes.select("img", (F.col("x0") - margin).alias("x0"), (F.col("x1") + margin).alias("x1"), F.explode(F.sequence((F.col("y0") - margin).cast("int"), (F.col("y1") + margin).cast("int"))).alias("y"))
    return lines.select("img", "y", F.floor("x0").cast("int").alias("x0"), F.ceil("x1").cast("int").alias("x1"))


def discs_as_runs(centres: DataFrame, radius: int) -> DataFrame:
    """Discs about (img, cx, cy) as runs."""
    at = centres.select("img", F.round("cy").cast("int").alias("y"), F.round("cx").cast("int").alias("x0"), F.round("cx").cast("int").alias("x1"))
    return dilated(at, disc(radius))


def at_pixel(labels: DataFrame, points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points with the component at their pixel; points on none drop out."""
    on = points.join(labels.select("img", F.col("y").alias(y), F.col("x0").alias("__a"), F.col("x1").alias("__b"), "comp"), ["img", y])
    return on.where((F.col(x) >= F.col("__a")) & (F.col(x) <= F.col("__b"))).drop("__a", "__b")


def pixel_count(runs: DataFrame) -> Column:
    return F.sum(F.col("x1") - F.col("x0") + 1)
