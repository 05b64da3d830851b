"""Rooms from masks: traced polygons, claims, circulation, doors, closing radii, silhouettes; and shapes of room rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gambrel.functions import polygon as P
from gambrel.operators import distance
from gambrel.operators import runs as R
from gambrel.shared import by_groups, settled


def simplified(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """A closed outline less points nearer than ``tolerance`` to the chord of those kept (Douglas and Peucker)."""
    if len(points) < 4:
        return points
    far = max(range(len(points)), key=lambda i: math.dist(points[0], points[i]))
    ring = [*points, points[0]]
    keep, stack = {0, far, len(points)}, [(0, far), (far, len(points))]
    while stack:
        a, b = stack.pop()
        (ax, ay), (bx, by) = ring[a], ring[b]
        length = math.hypot(bx - ax, by - ay) or 1.0
        worst, at = 0.0, -1
        for i in range(a + 1, b):
            d = abs((bx - ax) * (ay - ring[i][1]) - (by - ay) * (ax - ring[i][0])) / length if (ax, ay) != (bx, by) else math.dist(ring[i], ring[a])
            if d > worst:
                worst, at = d, i
        if worst > tolerance:
            keep.add(at)
            stack += [(a, at), (at, b)]
    return [ring[i] for i in sorted(keep - {len(points)})]


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The convex hull, by sorted turns."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    half = []
    for order in (points, points[::-1]):
        chain: list[tuple[float, float]] = []
        for p in order:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        half += chain[:-1]
    return half


def outline(rows: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The longest boundary of runs (y, x0, x1), along pixel edges: each run's sides and the parts of its top and bottom
    that no run of the next line touches are chained end to end."""
    by_line: dict[int, list[tuple[int, int]]] = {}
    for y, a, b in rows:
        by_line.setdefault(y, []).append((a, b + 1))
    steps: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def bare(a: int, b: int, others: list[tuple[int, int]]):
        at = a
        for c, d in sorted(others):
            if d <= at or c >= b:
                continue
            if c > at:
                yield at, c
            at = max(at, d)
        if at < b:
            yield at, b

    for y, spans in by_line.items():
        for a, b in spans:
            steps.setdefault((b, y), []).append((b, y + 1))
            steps.setdefault((a, y + 1), []).append((a, y))
            for c, d in bare(a, b, by_line.get(y - 1, [])):
                steps.setdefault((c, y), []).append((d, y))
            for c, d in bare(a, b, by_line.get(y + 1, [])):
                steps.setdefault((d, y + 1), []).append((c, y + 1))
    best: list[tuple[int, int]] = []
    widest = -1.0
    while steps:
        start = min(steps)
        chain, at = [], start
        while True:
            chain.append(at)
            out = steps[at]
            nxt = out.pop()
            if not out:
                del steps[at]
            at = nxt
            if at == start or at not in steps:
                break
        area = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(chain, [*chain[1:], chain[0]])))
        if area > widest:
            best, widest = chain, area
    return best


def traced(labels: DataFrame, tolerance: float = 10.0, share: float = 0.0) -> DataFrame:
    """(img, comp, points) of labelled runs: the outer outline, simplified; components under three points drop out.
    ``share`` of the outline's length, if given, is the tolerance instead.

    A task traces its components one after the other.
    """

    def one(table: pa.Table, starts: np.ndarray) -> pa.Table:
        y, x0, x1 = (table.column(c).to_pylist() for c in ("y", "x0", "x1"))
        at, points = [], []
        for first, end in zip(starts.tolist(), [*starts[1:].tolist(), len(y)]):
            if y[end - 1] - y[first] == end - first - 1 and len(set(y[first:end])) == end - first and x0[first:end].count(x0[first]) == x1[first:end].count(x1[first]) == end - first:
                # of a rectangle the corners are enough
                low, high, left, right = y[first], y[end - 1] + 1, x0[first], x1[first] + 1
                found = [(left, low), (right, low), (right, high), (left, high)]
            else:
                found = outline(list(zip(y[first:end], x0[first:end], x1[first:end])))
            line = [(float(x), float(y)) for x, y in found]
            length = sum(math.dist(p, q) for p, q in zip(line, [*line[1:], line[0]]))
            line = simplified(line, share * length if share else tolerance)
            if len(line) >= 3:
                at.append(first)
                points.append([list(p) for p in line])
        key = table.select(["img", "comp"]).take(pa.array(at, pa.int64()))
        return key.append_column("points", pa.array(points, pa.list_(pa.list_(pa.float64()))))

    kind = dict(labels.dtypes)["img"]
    return by_groups(labels.select("img", "comp", "y", "x0", "x1"), ["img", "comp"], ["y", "x0"], one, f"img {kind}, comp long, points array<array<double>>")


def hulls(labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, points) of runs, from the least and largest x of each line."""
    ends = labels.groupBy(*keys, "y").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))

    def one(table: pa.Table, starts: np.ndarray) -> pa.Table:
        y, x0, x1 = (table.column(c).to_numpy().astype(float) for c in ("y", "x0", "x1"))
        found = []
        for first, end in zip(starts.tolist(), [*starts[1:].tolist(), len(y)]):
            lines = y[first:end].tolist()
            found.append([list(p) for p in hull([*zip(x0[first:end].tolist(), lines), *zip(x1[first:end].tolist(), lines)])])
        return table.select(keys).take(pa.array(starts)).append_column("points", pa.array(found, pa.list_(pa.list_(pa.float64()))))

    kind = dict(labels.dtypes)
    return by_groups(ends.select(*keys, "y", "x0", "x1"), keys, ["y"], one, ", ".join(f"{k} {kind[k]}" for k in keys) + ", points array<array<double>>")


def thick(ink: DataFrame, sizes: DataFrame, least: float = 1.85) -> DataFrame:
    """Runs of ink at least ``least`` (1.85 or 2.2) from the background, as ``distance.at_least`` gives them, by
    erosion: all eight neighbours are ink; from 2.2 on also the four pixels two steps away along the axes."""
    shape = {-2: 0, -1: 1, 0: 2, 1: 1, 2: 0} if least > 1.91 else R.square(1)
    return R.eroded(ink, sizes, shape)


def organic_walls(pixels: DataFrame, sizes: DataFrame, label_boxes: DataFrame, dark: int = 150, least: int = 150, margin: int = 4) -> DataFrame:
    """Thick ink less boxes around labels, less blobs under ``least`` pixels."""
    mask = thick(R.ink(pixels, dark), sizes)
    mask = R.labelled(R.minus(mask, R.boxes_as_runs(label_boxes, margin), sizes), eight=True)
    big = R.measures(mask).where(F.col("area") >= least).select("img", "comp")
    return mask.join(big, ["img", "comp"], "left_semi").select("img", "y", "x0", "x1")


def rectilinear_walls(pixels: DataFrame, sizes: DataFrame, dark: int = 110, least: int = 40, gap: int = 2) -> DataFrame:
    """Thick ink in runs along lines or columns whose last pixel is ``least`` or more past the first."""
    core = settled(thick(R.ink(pixels, dark), sizes), "straight-core")
    h, v = (R.merged(m, gap - 1, least + 1).select("img", "y", "x0", "x1") for m in (core, R.across(core)))
    return R.merged(h.union(R.across(v)))


def wall_fit(rectilinear: DataFrame, organic: DataFrame, sizes: DataFrame) -> DataFrame:
    """(img, fit): rectilinear over organic wall pixels, 1 without any; under 0.7 a plan is taken as organic."""
    count = lambda m, c: m.groupBy("img").agg(R.pixel_count(m).alias(c))
    j = sizes.select("img").join(count(rectilinear, "r"), "img", "left").join(count(organic, "o"), "img", "left")
    return j.select("img", F.when(F.coalesce("o", F.lit(0)) == 0, 1.0).otherwise(F.coalesce("r", F.lit(0)) / F.col("o")).alias("fit"))


def claimed(labels: DataFrame, names: DataFrame, silhouette_px: DataFrame, most: float = 0.5) -> DataFrame:
    """(img, ord, name, comp): each label (img, ord, name, cx, cy) claims the free component at its rounded centre.

    A component over ``most`` of the silhouette's pixels is refused before it is claimed; of labels on one component the
    first by ord has it.
    """
    at = names.select("img", "ord", "name", F.bround("cx").cast("int").alias("x"), F.bround("cy").cast("int").alias("y"))
    fits = R.measures(labels).join(silhouette_px, "img").where(F.col("area") <= most * F.col("pixels")).select("img", "comp")
    met = R.at_pixel(labels, at).join(fits, ["img", "comp"])
    return met.withColumn("nth", F.row_number().over(Window.partitionBy("img", "comp").orderBy("ord"))).where("nth = 1").select("img", "ord", "name", "comp")


def circulation(labels: DataFrame, used: DataFrame, least: int = 600) -> DataFrame:
    """Components nobody claimed, of ``least`` pixels or more, as rooms named sirkulasi."""
    free = R.measures(labels).where(F.col("area") >= least).join(used.select("img", "comp"), ["img", "comp"], "left_anti")
    return free.select("img", "comp", "area", F.lit("sirkulasi").alias("name"), F.lit("terkaan").alias("source"))


def clipped_boxes(boxes: DataFrame, labels: DataFrame, least: int = 8, some: int = 4) -> DataFrame:
    """Each box (img, id, comp, x0, y0, x1, y1; high ends outside) as the extent of its own component in it, if that has
    ``some`` pixels there; a box without a component stays as it is. Boxes under ``least`` in a dimension drop out."""
    part = boxes.withColumnsRenamed({"x0": "bx0", "x1": "bx1", "y0": "by0", "y1": "by1"}).join(labels, ["img", "comp"])
    part = part.where((F.col("y") >= F.col("by0")) & (F.col("y") < F.col("by1")) & (F.col("x1") >= F.col("bx0")) & (F.col("x0") < F.col("bx1")))
    low, high = F.greatest("x0", "bx0"), F.least(F.col("x1") + 1, F.col("bx1"))
    own = part.groupBy("img", "id").agg(F.min(low).alias("cx0"), F.min("y").alias("cy0"), F.max(high).alias("cx1"), (F.max("y") + 1).alias("cy1"), F.sum(high - low).alias("px")).where(F.col("px") >= some)
    out = boxes.join(own, ["img", "id"], "left").select("img", "id", *[F.coalesce(f"c{c}", c).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return out.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))


def closing_radii(thickness: DataFrame, attempts: int = 8, factor: float = 1.6, least: int = 8) -> DataFrame:
    """(img, attempt, radius) from (img, half) of wall pixels: 8 or four half thicknesses, then 1.6 times each."""
    start = thickness.groupBy("img").agg(F.greatest(F.lit(float(least)), 4 * F.median("half")).alias("start"))
    return start.select("img", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt"), "start").select("img", "attempt", F.bround(F.col("start") * F.pow(F.lit(factor), F.col("attempt"))).cast("int").alias("radius"))


def best_radius(scores: DataFrame) -> DataFrame:
    """Of tried radii (img, attempt, radius, resolved), the first with most labels resolved; none without any."""
    return scores.where("resolved > 0").groupBy("img").agg(F.max_by(F.struct("attempt", "radius", "resolved"), F.struct("resolved", -F.col("attempt"))).alias("b")).select("img", "b.*")


def bridge_cutoff(gaps: DataFrame, jump: float = 1.6) -> DataFrame:
    """(img, cutoff): the gap before the largest relative jump of the sorted gaps, if that is ``jump`` or more; else
    the largest gap."""
    w = Window.partitionBy("img").orderBy("gap", "i", "j")
    j = gaps.withColumn("next", F.lead("gap").over(w)).withColumn("ratio", F.col("next") / F.greatest("gap", F.lit(1e-9)))
    out = j.groupBy("img").agg(F.max("gap").alias("most"), F.max(F.col("ratio")).alias("ratio"), F.max_by("gap", F.struct("ratio", -F.col("gap"))).alias("before"))
    return out.select("img", F.when(F.col("ratio") >= jump, F.col("before")).otherwise(F.col("most")).alias("cutoff"))


def merge_radius(gaps: DataFrame, images: DataFrame, margin: int = 8) -> DataFrame:
    """(img, radius): half the longest edge of the least spanning tree of components, cut to an integer, and a margin;
    the margin alone for one component."""
    found = distance.longest_tree_edge(gaps).select("img", (F.floor(F.col("longest") / 2) + margin).cast("int").alias("radius"))
    return images.select("img").join(found, "img", "left").fillna(margin, ["radius"])


def silhouettes(mask: DataFrame, sizes: DataFrame, radius: int | DataFrame, tolerance: float = 6.0, least: int = 800, tries: int = 6) -> DataFrame:
    """(img, points, how) of each image's mask: closed at ``radius``, a number or (img, radius), then at 1.5 times and
    one more, until at most one large component is left, whose outline it is; else the hull. Images that are done leave the
    next try."""
    done, todo = None, mask
    radii = sizes.select("img", F.lit(radius).alias("radius")) if isinstance(radius, int) else radius
    for _ in range(tries):
        labels = R.labelled(R.closed(todo, sizes, radii), eight=True)
        m = R.measures(labels)
        ok = m.groupBy("img").agg(F.count_if(F.col("area") >= least).alias("big"), F.max_by("comp", F.struct("area", -F.col("comp"))).alias("comp")).where("big <= 1").select("img", "comp")
        mine = labels.join(ok, ["img", "comp"], "left_semi")
        found = traced(mine, tolerance).select("img", "points", F.lit("traced").alias("how"))
        done = found if done is None else done.unionByName(found)
        todo = settled(todo.join(ok, "img", "left_anti"), "open-masks")
        if todo.isEmpty():
            break
        radii = radii.select("img", (F.floor(F.col("radius") * 1.5) + 1).cast("int").alias("radius"))
    return done.unionByName(hulls(todo, ["img"]).select("img", "points", F.lit("hull").alias("how")))


def robust_silhouette(bridged: DataFrame, plain: DataFrame, hull_area: DataFrame, least: float = 0.4) -> DataFrame:
    """The bridged outline where it has ``least`` of the hull's area, else the plain one."""
    j = plain.select("img", F.col("points").alias("p")).join(bridged.select("img", F.col("points").alias("b")), "img", "left").join(hull_area, "img", "left")
    good = F.coalesce(P.area(F.col("b")) >= least * F.col("hull_area"), F.lit(False))
    return j.select("img", F.when(good, F.col("b")).otherwise(F.col("p")).alias("points"))


def doors(segments: DataFrame, labels: DataFrame, ink: DataFrame, rooms: DataFrame, offset: int = 10, share: float = 0.55, samples: int = 12, gap: tuple[int, int] = (12, 90), half: int = 5, symbol: int = 40, window: int = 55, off: int = 4) -> DataFrame:
    """(img, a, b, x, y): doors between traced rooms or circulation (img, comp).

    Along a wall, components 10 to either side of each inked position are counted; the commonest of each side must differ
    and cover ``share`` of the inked positions. An ink-free stretch of the wall's band, 12 to 90 long, is a door if ink of
    its symbol, ``symbol`` pixels, lies in a window to one side, ``off`` lines from the wall on. Horizontal walls first, the first door of two rooms counts.
    """
    s = segments.withColumn("seg", F.struct("axis", "coord", "a", "b"))
    at = s.select("img", "seg", "axis", "coord", F.explode(F.sequence("a", "b")).alias("t"))
    xy = lambda shift: (F.when(F.col("axis") == "h", F.col("t")).otherwise(F.col("coord") + shift).alias("x"), F.when(F.col("axis") == "h", F.col("coord") + shift).otherwise(F.col("t")).alias("y"))
    on = R.at_pixel(ink.withColumn("comp", F.lit(0).cast("long")), at.select("img", "seg", "axis", "coord", "t", *xy(0))).drop("comp", "x", "y")
    inked = on.groupBy("img", "seg").agg(F.count(F.lit(1)).alias("inked")).where(F.col("inked") >= samples)
    sides = []
    for name, shift in (("a", -offset), ("b", offset)):
        near = R.at_pixel(labels, on.select("img", "seg", *xy(shift))).groupBy("img", "seg", "comp").agg(F.count(F.lit(1)).alias("n"))
        sides.append(near.groupBy("img", "seg").agg(F.max_by(F.struct("comp", "n"), F.struct("n", -F.col("comp"))).alias(name)))
    pair = inked.join(sides[0], ["img", "seg"]).join(sides[1], ["img", "seg"])
    pair = pair.where((F.col("a.comp") != F.col("b.comp")) & (F.col("a.n") >= share * F.col("inked")) & (F.col("b.n") >= share * F.col("inked")))
    for c in "ab":
        pair = pair.join(rooms.select("img", F.col("comp").alias("rc")), (F.col("rc") == F.col(f"{c}.comp")) & (rooms["img"] == pair["img"]), "left_semi")
    pair = pair.select("img", "seg", F.col("a.comp").alias("a"), F.col("b.comp").alias("b"))
    # ink anywhere in the band around the wall, by position along it
    mine = at.join(pair.select("img", "seg"), ["img", "seg"], "left_semi")
    band = mine.withColumn("shift", F.explode(F.sequence(F.lit(-half), F.lit(half))))
    some = R.at_pixel(ink.withColumn("comp", F.lit(0).cast("long")), band.select("img", "seg", "t", *xy(F.col("shift")))).select("img", "seg", "t").distinct()
    bare = R.islands(mine.select("img", "seg", "t").join(some, ["img", "seg", "t"], "left_anti"), ["img", "seg"], "t")
    holes = bare.where((F.col("stop") - F.col("start") + 1).between(*gap)).withColumn("mid", F.floor((F.col("start") + F.col("stop")) / 2).cast("int"))
    placed = holes.join(pair, ["img", "seg"]).select("img", "seg", "a", "b", "mid", F.when(F.col("seg.axis") == "h", F.col("mid")).otherwise(F.col("seg.coord")).alias("x"), F.when(F.col("seg.axis") == "h", F.col("seg.coord")).otherwise(F.col("mid")).alias("y"))
    # the window's lines on either side, ``off`` or more from the wall; ends are half-open
    reach, horizontal = window // 2, F.col("seg.axis") == "h"
    line = lambda before, dy, low, high: F.struct(F.lit(before).alias("before"), (F.col("y") + dy).cast("int").alias("py"), (F.col("x") + low).alias("w0"), (F.col("x") + high).alias("w1"))
    lines = lambda before, ys, low, high: F.transform(F.sequence(F.lit(ys[0]), F.lit(ys[1])), lambda d: line(before, d, low, high))
    across, along = ((-window, -off - 1), (off, window - 1)), (-reach, reach - 1)
    flat = F.concat(*[lines(k == 0, ys, *along) for k, ys in enumerate(across)])
    upright = F.concat(*[lines(k == 0, along, *xs) for k, xs in enumerate(across)])
    spot = placed.select("img", "seg", "a", "b", "mid", "x", "y", F.inline(F.when(horizontal, flat).otherwise(upright)))
    met = spot.join(ink.select("img", F.col("y").alias("py"), "x0", "x1"), ["img", "py"]).where("x0 <= w1 and x1 >= w0")
    amount = F.sum(F.least("x1", "w1") - F.greatest("x0", "w0") + 1)
    strong = met.groupBy("img", "seg", "a", "b", "mid", "x", "y", "before").agg(amount.alias("px")).where(F.col("px") >= symbol)
    first = Window.partitionBy("img", F.least("a", "b"), F.greatest("a", "b")).orderBy("seg.axis", "seg.coord", "seg.a", "mid")
    return strong.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("img", "a", "b", "x", "y")


def look_broken(rooms: DataFrame, most: float = 0.3) -> DataFrame:
    """(img, duplicated, broken): the share of rooms (img, points) whose bounds, in whole units, another room has too."""
    box = P.bounds(F.col("points"))
    b = rooms.select("img", F.struct(*[F.bround(box[k]).alias(k) for k in ("x0", "y0", "x1", "y1")]).alias("box")).groupBy("img", "box").agg(F.count(F.lit(1)).alias("n"))
    out = b.groupBy("img").agg((F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("duplicated"))
    return out.withColumn("broken", F.col("duplicated") > most)


def room_points(points: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A room's polygon, or its box as one."""
    corner = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    return F.coalesce(points, F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)))


def with_ids(rooms: DataFrame) -> DataFrame:
    """Rooms (img, ord, id, name, source) with an id of their own where they have none, and no null name or source."""
    return rooms.withColumn("id", F.when(F.coalesce("id", F.lit("")) == "", F.concat(F.lit("r"), (F.col("ord") + 1).cast("string"))).otherwise(F.col("id"))).fillna({"name": "", "source": "kosong"})


def trace_plan(sizes: DataFrame, walls: DataFrame, names: DataFrame, silhouette: DataFrame, silhouette_px: DataFrame) -> DataFrame:
    """Rooms of plans from wall masks: free areas inside the silhouette (runs), claimed by labels, the rest as
    circulation, traced: (img, comp, name, source, points)."""
    outside = R.complement(silhouette, sizes)
    labels = R.labelled(R.complement(R.merged(walls.select("img", "y", "x0", "x1").unionByName(outside)), sizes))
    mine = claimed(labels, names, silhouette_px).select("img", "comp", "name", F.lit("tulisan").alias("source"))
    rooms = mine.unionByName(circulation(labels, mine).select("img", "comp", "name", "source"))
    return rooms.join(traced(labels.join(rooms.select("img", "comp"), ["img", "comp"], "left_semi")), ["img", "comp"])
