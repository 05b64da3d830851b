"""Whole floor plans, from pixels and labels to silhouettes, rooms and doors; each image takes the way its walls ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gambrel.functions import polygon as P
from gambrel.operators import rooms, tracing, vector, walls
from gambrel.operators import runs as R
from gambrel.shared import settled

#: How dark ink is for dashes and for doors; how far a folding door's line reaches beyond its dashes; how near
#: the ends of walls at a corner are; the share of straight walls under which a plan is organic.
DASH, DOOR, BEFORE, BEYOND, CORNER, FIT = 90, 110, 30, 40, 90, 0.7


def wall_lines(pixels: DataFrame, sizes: DataFrame, labels: DataFrame) -> DataFrame:
    """(img, axis, coord, a, b): the walls of plans: ink lines and the folding door, less short lines at labels and combs."""
    dashes = R.merged(R.ink(pixels, DASH), bridge=2).select("img", "y", F.col("x0").alias("start"), F.col("x1").alias("stop"))
    fold = R.chained_dashes(dashes, ["img"], ["y"])
    fold = fold.select("img", F.lit("h").alias("axis"), F.col("y").alias("coord"), (F.col("start") - BEFORE).alias("a"), (F.col("stop") + BEYOND).alias("b"))
    lines = settled(tracing.ink_lines(pixels, sizes, labels).unionByName(fold).select("img", "axis", *[F.col(c).cast("int").alias(c) for c in ("coord", "a", "b")]), "lines")
    return settled(walls.comb_patterns(walls.away_from_labels(lines, labels).select("img", "axis", "coord", "a", "b")), "walls")


def barriers(lines: DataFrame, gap: int = CORNER) -> DataFrame:
    """Walls over their whole spans, and lines three wide between ends that should meet at a corner, as runs."""
    met = walls.corners(lines, gap).select("img", F.col("hx").alias("x0"), F.col("hy").alias("y0"), F.col("vx").alias("x1"), F.col("vy").alias("y1"))
    joins = R.dilated(vector.lines_as_runs(met, zoom=1.0), R.square(1))
    return R.merged(walls.barriers(lines).select("img", "y", "x0", "x1").unionByName(joins.select("img", "y", "x0", "x1")))


def areas(lines: DataFrame, sizes: DataFrame, silhouettes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Free areas (img, y, x0, x1, comp) between walls and inside silhouettes, and (img, pixels) of the silhouettes; an image
    without one is taken whole."""
    inside = tracing.filled(silhouettes)
    has = silhouettes.select("img").distinct()
    outside = R.complement(inside, sizes.join(has, "img", "left_semi"))
    comps = R.labelled(R.complement(R.merged(barriers(lines).unionByName(outside.select("img", "y", "x0", "x1"))), sizes))
    filled = inside.groupBy("img").agg(R.pixel_count(inside).alias("n"))
    return comps, sizes.join(filled, "img", "left").select("img", F.coalesce("n", F.col("width").cast("long") * F.col("height")).alias("pixels"))


def _label_boxes(lines: DataFrame, sizes: DataFrame, silhouettes: DataFrame, comps: DataFrame, left: DataFrame, traced: DataFrame) -> DataFrame:
    """Rooms of labels without an area of their own: the nearest walls' box, missing sides from the silhouette's bounds,
    clipped to the label's area, drawn apart from the others and from the bounds of traced rooms."""
    b = P.bounds(F.col("points"))
    frame = silhouettes.select("img", *[F.floor(b[c]).cast("int").alias(f"s{c}") for c in ("x0", "y0", "x1", "y1")])
    whole = sizes.join(frame, "img", "left").select("img", *[F.coalesce(f"s{c}", F.lit(0)).alias(f"s{c}") for c in ("x0", "y0")], F.coalesce("sx1", "width").alias("sx1"), F.coalesce("sy1", "height").alias("sy1"))
    near = walls.nearest_walls(left.select("img", F.col("ord").alias("id"), "cx", "cy"), lines).join(whole, "img")
    boxes = near.select("img", "id", *[F.coalesce(c, f"s{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    spots = left.select("img", F.col("ord").alias("id"), F.bround("cx").cast("int").alias("x"), F.bround("cy").cast("int").alias("y"))
    own = R.at_pixel(comps, spots).select("img", "id", "comp")
    boxes = rooms.clipped_boxes(boxes.join(own, ["img", "id"], "left"), comps)
    fixed = traced.select("img", F.col("ord").alias("id"), F.lit(True).alias("fixed"), b.alias("b")).select("img", "id", "fixed", "b.x0", "b.y0", "b.x1", "b.y1")
    side = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    every = boxes.select("img", "id", F.lit(False).alias("fixed"), *side).unionByName(fixed.select("img", "id", "fixed", *side))
    apart = walls.separated_boxes(every.select("img", "id", F.col("id").alias("ord"), "fixed", "x0", "y0", "x1", "y1")).where("not fixed")
    return apart.select("img", "ord", rooms.room_points(F.lit(None).cast(P.POINTS), *[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("points"))


def rectilinear_plan(pixels: DataFrame, sizes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Silhouettes (img, points), rooms (img, id, name, source, points) and doors (img, a, b, x, y; a and b are ids) of
    plans with straight walls.

    ``pixels``: (img, y, x, gray), those that are white may be missing, or runs of one gray (img, y, x0, x1, gray); ``labels``: (img, ord, name, cx, cy). A label has the
    traced area around it, if it is the first there and the area is at most half the silhouette, else a box; areas without a
    label are circulation. An image without labels has circulation only; one without walls is one area if it is not too big.
    """
    lines = wall_lines(pixels, sizes, labels)
    none = labels.select("img", *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")]).limit(0)
    mask = settled(rooms.organic_walls(pixels, sizes, none), "walls")
    silhouettes = settled(tracing.outer_silhouette(mask, sizes), "silhouettes")
    comps, px = areas(lines, sizes, silhouettes)
    claims = settled(rooms.claimed(comps, labels, px), "claims")
    free = rooms.circulation(comps, claims).select("img", "comp")
    drawn = rooms.traced(comps.join(claims.select("img", "comp").unionByName(free), ["img", "comp"], "left_semi"))
    drawn = settled(drawn, "drawn")
    named = claims.join(drawn, ["img", "comp"]).select("img", "ord", "name", F.lit("tulisan").alias("source"), "comp", "points")
    left = labels.join(named, ["img", "ord"], "left_anti")
    boxed = _label_boxes(lines, sizes, silhouettes, comps, left, named).join(labels.select("img", "ord", "name"), ["img", "ord"])
    boxed = boxed.select("img", "ord", "name", F.lit("tulisan").alias("source"), F.lit(None).cast("long").alias("comp"), "points")
    around = free.join(drawn, ["img", "comp"]).select("img", F.lit(None).cast("int").alias("ord"), F.lit("sirkulasi").alias("name"), F.lit("terkaan").alias("source"), "comp", "points")
    order = Window.partitionBy("img").orderBy(F.asc_nulls_last("ord"), "comp")
    found = named.unionByName(boxed).unionByName(around).withColumn("id", F.concat(F.lit("r"), F.row_number().over(order)))
    found = settled(found, "rooms")
    ink = settled(R.ink(pixels, DOOR), "door-ink")
    open_ = rooms.doors(lines, comps, ink, found.where("comp is not null").select("img", "comp"))
    name = lambda c: found.where("comp is not null").select("img", F.col("comp").alias(c), F.col("id").alias(f"{c}_id"))
    doors = open_.join(name("a"), ["img", "a"]).join(name("b"), ["img", "b"])
    return silhouettes, found.select("img", "id", "name", "source", "points"), doors.select("img", F.col("a_id").alias("a"), F.col("b_id").alias("b"), "x", "y")


def wall_fits(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(img, fit) from pixels."""
    none = sizes.select("img", *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")]).limit(0)
    return rooms.wall_fit(rooms.rectilinear_walls(pixels, sizes), rooms.organic_walls(pixels, sizes, none), sizes)


def _ids(found: DataFrame) -> DataFrame:
    return found.select("img", F.concat(F.lit("r"), F.row_number().over(Window.partitionBy("img").orderBy("ord"))).alias("id"), "name", "source", "points")


def analyse(pixels: DataFrame, sizes: DataFrame, labels: DataFrame, fit: float = FIT, most: float = 0.3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """R18 with routing: silhouettes (img, points), rooms (img, id, name, source, points, mode) and doors (img, a, b, x, y).

    Images whose walls are straight to less than ``fit`` (W14) are organic from the start; those whose rectilinear rooms
    share their bounds too often (R17, ``most``) are done again as organic ones, without doors. ``labels``: (img, ord, name,
    cx, cy, x0, y0, x1, y1). All images of a way are worked on together; a way that no image takes is not run.
    """
    fits = settled(wall_fits(pixels, sizes), "fits")

    def of(images: DataFrame) -> list[DataFrame]:
        return [df.hint("merge").join(images, "img", "left_semi") for df in (pixels, sizes, labels)]

    parts, bent = [], fits.where(F.col("fit") < fit).select("img")
    straight = fits.where(F.col("fit") >= fit).select("img")
    doors = None
    if not straight.isEmpty():
        silhouettes, found, doors = rectilinear_plan(*of(straight))
        broken = settled(rooms.look_broken(found, most).where("broken").select("img"), "broken")
        keep = lambda df: df.join(broken, "img", "left_anti")
        parts.append((keep(silhouettes), keep(found).withColumn("mode", F.lit("rectilinear"))))
        doors, bent = keep(doors), bent.unionByName(broken)
    if not bent.isEmpty():
        silhouettes, found = tracing.organic_plan(*of(bent))
        parts.append((silhouettes.select("img", "points"), _ids(found).withColumn("mode", F.lit("organic"))))
    if not parts:
        parts.append((sizes.select("img", F.lit(None).cast(P.POINTS).alias("points")).limit(0), sizes.select("img", *[F.lit("").alias(c) for c in ("id", "name", "source")], F.lit(None).cast(P.POINTS).alias("points"), F.lit("").alias("mode")).limit(0)))
    outlines, found = parts[0]
    for s, r in parts[1:]:
        outlines, found = outlines.unionByName(s), found.unionByName(r)
    if doors is None:
        doors = sizes.select("img", F.lit("").alias("a"), F.lit("").alias("b"), F.lit(0).alias("x"), F.lit(0).alias("y")).limit(0)
    return outlines, found, doors
