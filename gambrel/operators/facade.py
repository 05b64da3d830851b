"""Openings of elevations: envelope, cells, classification, sizes and the void-to-solid ratio, for many images at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gambrel.functions import polygon as P
from gambrel.operators import rooms
from gambrel.operators import runs as R
from gambrel.shared import settled

OUTLINE, INK = 100, 200
MIN_DIM, EXTENT, MIN_AREA, HOLES, AXIS = 15, 0.5, 30, 0.05, 0.75


def ink_boxes(pixels: DataFrame, level: int) -> DataFrame:
    """Boxes (img, y0, x0, y1, x1) of the pixels (img, y, x, gray) as dark as ``level``; or of runs or boxes of one gray, as they are."""
    dark = pixels.where(F.col("gray") <= level)
    return R.as_boxes(dark if "x0" in pixels.columns else R.runs_of(dark))


def envelope(pixels: DataFrame, sizes: DataFrame, outline: int = OUTLINE, window: float = 0.35, bridge: int = 15) -> DataFrame:
    """A1: (img, x0, y0, x1, y1, status) of each building; status ``no_building`` where there is no ink.

    Columns whose topmost ink is less than ``window`` of the height under the roof line are the building's; gaps that a
    closing of width ``bridge`` shuts are filled; the longest run, the first of equals, gives the width, ink in it the height.
    """
    ink = settled(ink_boxes(pixels, outline), "outline-ink")
    top = ink.select("img", "y0", F.explode(F.sequence("x0", "x1")).alias("x")).groupBy("img", "x").agg(F.min("y0").alias("top"))
    roof = ink.groupBy("img").agg(F.min("y0").alias("roof")).hint("merge").join(sizes, "img")
    columns = top.hint("merge").join(roof, "img").where(F.col("top") < F.col("roof") + window * F.col("height"))
    spans = R.islands(columns, ["img"], "x", bridge=bridge - 1)
    widest = spans.groupBy("img").agg(F.max_by(F.struct("start", "stop"), F.struct(F.col("stop") - F.col("start"), -F.col("start"))).alias("s"))
    lines = ink.join(widest, "img").where((F.col("x1") >= F.col("s.start")) & (F.col("x0") <= F.col("s.stop")))
    found = lines.groupBy("img").agg(F.first("s").alias("s"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    out = sizes.select("img").hint("merge").join(found, "img", "left")
    return out.select("img", F.col("s.start").alias("x0"), "y0", F.col("s.stop").alias("x1"), "y1", F.when(F.col("s").isNull(), "no_building").otherwise("ok").alias("status"))


def cells(pixels: DataFrame, sizes: DataFrame, envelopes: DataFrame, ink: int = INK) -> tuple[DataFrame, DataFrame]:
    """A2: the 4-connected areas free of ink, as labelled boxes and as measures; those at the image's border, under 30
    pixels, or outside the envelope by more than 2 are left out."""
    labels = settled(R.free_boxes(ink_boxes(pixels, ink), sizes), "areas")
    sized = R.measures(labels).hint("merge").join(sizes, "img").hint("merge").join(envelopes.where("status = 'ok'").select("img", F.col("x0").alias("ex0"), F.col("y0").alias("ey0"), F.col("x1").alias("ex1"), F.col("y1").alias("ey1")), "img")
    border = (F.col("x0") == 0) | (F.col("y0") == 0) | (F.col("x1") == F.col("width") - 1) | (F.col("y1") == F.col("height") - 1)
    within = (F.col("x0") >= F.col("ex0") - 2) & (F.col("y0") >= F.col("ey0") - 2) & (F.col("x1") <= F.col("ex1") + 2) & (F.col("y1") <= F.col("ey1") + 2)
    good = sized.where(~border & (F.col("area") >= MIN_AREA) & within).select("img", "comp", "area", "x0", "y0", "x1", "y1")
    return labels.join(good.select("img", "comp"), ["img", "comp"], "left_semi"), good


def _boxes(labels: DataFrame) -> DataFrame:
    """Labelled runs as boxes; boxes as they are."""
    return labels if "y0" in labels.columns else labels.select("img", F.col("y").alias("y0"), "x0", F.col("y").alias("y1"), "x1", "comp")


def hole_share(labels: DataFrame, measures: DataFrame, least: int = MIN_DIM) -> DataFrame:
    """A4: (img, comp, holes): of each cell, the share of its filled outline in holes at least ``least`` wide and high."""
    key = F.struct("img", "comp")
    at = measures.select("img", "comp", F.col("x0").alias("cx"), F.col("y0").alias("cy"))
    local = _boxes(labels).hint("merge").join(at, ["img", "comp"])
    # each cell on a canvas of its own, one pixel wider on all sides
    moved = lambda c, by: (F.col(c) - F.col(by) + 1).cast("int").alias(c)
    canvas = local.select(key.alias("img"), moved("y0", "cy"), moved("x0", "cx"), moved("y1", "cy"), moved("x1", "cx"))
    size = measures.select(key.alias("img"), (F.col("x1") - F.col("x0") + 3).cast("int").alias("width"), (F.col("y1") - F.col("y0") + 3).cast("int").alias("height"))
    gaps = R.measures(R.free_boxes(canvas, size, eight=True)).where("x0 > 0 and y0 > 0")
    wide = F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 1 >= least
    held = gaps.groupBy(F.col("img.img").alias("img"), F.col("img.comp").alias("comp")).agg(F.sum("area").alias("all"), F.sum(F.when(wide, F.col("area")).otherwise(0)).alias("big"))
    return measures.join(held, ["img", "comp"], "left").select("img", "comp", F.coalesce(F.col("big") / (F.col("area") + F.col("all")), F.lit(0.0)).alias("holes"))


def straight_share(labels: DataFrame, share: float = 0.02) -> DataFrame:
    """A5: (img, comp, axis): of a cell's outline, simplified by ``share`` of its length, the share along the axes."""
    return rooms.traced(R.as_runs(_boxes(labels)), share=share).select("img", "comp", P.axis_share(F.col("points")).alias("axis"))


def is_opening(area: Column, width: Column, height: Column, holes: Column, axis: Column) -> Column:
    """A cell wide, filled, whole and straight enough; all others are wall."""
    return (F.least(width, height) >= MIN_DIM) & (area / (width * height) >= EXTENT) & (holes < HOLES) & (axis >= AXIS)


def classified(labels: DataFrame, measures: DataFrame) -> DataFrame:
    """Measures with holes, axis and opening. Holes and sides are found only for cells that pass the cheap tests."""
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    cheap = measures.where(is_opening(F.col("area"), w, h, F.lit(0.0), F.lit(1.0)))
    mine = labels.join(cheap.select("img", "comp"), ["img", "comp"], "left_semi")
    j = measures.join(hole_share(mine, cheap), ["img", "comp"], "left").join(straight_share(mine), ["img", "comp"], "left")
    return j.withColumn("opening", F.coalesce(is_opening(F.col("area"), w, h, F.col("holes"), F.col("axis")), F.lit(False)))


def logical_openings(labels: DataFrame, kernel: int = 7) -> DataFrame:
    """Openings closer than the kernel as one: (img, opening, area_px, x0, y0, x1, y1), measured without it; largest first by nth."""
    own, half = _boxes(labels).drop("comp"), kernel // 2
    wider = own.select("img", *[(F.col(c) + d).alias(c) for c, d in (("y0", -half), ("x0", -half), ("y1", half), ("x1", half))])
    wide = R.labelled(R.painted(wider), eight=True)
    joined = R.at_pixel(wide, own.select("img", F.col("y0").alias("y"), F.col("x0").alias("x"), F.struct("y0", "x0", "y1", "x1").alias("box")))
    m = R.measures(joined.select("img", "box.*", "comp"))
    nth = F.row_number().over(Window.partitionBy("img").orderBy(F.desc("area"), "comp"))
    return m.select("img", F.col("comp").alias("opening"), F.col("area").alias("area_px"), "x0", "y0", "x1", "y1", nth.alias("nth"))


def ratios(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Opening and wall pixels, their ratio (null without wall) and the openings' share, of cells (keys, area, opening)."""
    s = cells.groupBy(*keys).agg(F.sum(F.when(F.col("opening"), F.col("area")).otherwise(0)).alias("opening_px"), F.sum(F.when(F.col("opening"), 0).otherwise(F.col("area"))).alias("wall_px"))
    both = F.col("opening_px") + F.col("wall_px")
    return s.select(*keys, "opening_px", "wall_px", (F.col("opening_px") / F.nullif("wall_px", F.lit(0))).alias("ratio"), (F.col("opening_px") / F.nullif(both, F.lit(0))).alias("opening_share"))


def opening_sizes(openings: DataFrame, keys: list[str]) -> DataFrame:
    """Number, least, largest and median size."""
    a = F.col("area_px")
    return openings.groupBy(*keys).agg(F.count(F.lit(1)).alias("openings"), F.min(a).alias("least"), F.max(a).alias("largest"), F.median(a).alias("median"))


def analyze(pixels: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A1 to A10: one row an image (status, ratio, shares of the cells and of the envelope, sizes), and its openings with
    their share of the classified area.

    ``pixels``: (img, y, x, gray) of all or only the dark ones, or runs (img, y, x0, x1, gray) or boxes (img, y0, x0, y1, x1, gray) of them; ``sizes``: (img, width, height). An image without a
    building has a row with that status and nulls.
    """
    env = settled(envelope(pixels, sizes), "envelopes")
    labels, measures = cells(pixels, sizes, env)
    labels, measures = settled(labels, "cell-boxes"), settled(measures, "cells")
    judged = settled(classified(labels, measures), "judged")
    mine = labels.join(judged.where("opening").select("img", "comp"), ["img", "comp"], "left_semi")
    openings = logical_openings(mine)
    totals = ratios(judged, ["img"])
    total = F.col("opening_px") + F.col("wall_px")
    shared = openings.join(totals, "img").withColumn("area_frac", F.col("area_px") / F.when(total == 0, 1).otherwise(total)).drop("opening_px", "wall_px", "ratio", "opening_share")
    box = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    summary = env.join(totals, "img", "left").withColumn("envelope_share", F.col("opening_px") / box)
    return summary.join(opening_sizes(openings, ["img"]), "img", "left").fillna(0, ["openings"]), shared
