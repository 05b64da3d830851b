"""Rooms drawn or changed by hand, accepted into a case's latest version if they keep clear of its other rooms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gambrel.functions import polygon as P
from gambrel.shared import settled

#: Fixed value: the name of a room that nobody named.
NEW = "Ruangan baru"
#: Shapes of a cell in the first batch; each batch ends at so many times the place where the one before ended.
BATCH = 8


def _cells(rooms: DataFrame, cell: float) -> DataFrame:
    """Rooms once for each grid cell that their bounds touch."""
    b = P.bounds(F.col("points"))
    at = lambda c: F.floor(b[c] / cell).cast("int")
    return rooms.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1"))))


def overlapping(rooms: DataFrame, others: DataFrame, cell: float = 128.0) -> DataFrame:
    """(case, id) of ``rooms`` (case, id, points) that overlap (G10) one of ``others``, itself left out; what has under three
    points overlaps nothing. Rooms meet in the grid cells that their bounds touch, so only near ones are held together.

    One overlap decides a room, so each meets the shapes of its cells in batches that grow, and only those not yet hit meet
    the next: the fuller a cell, the sooner its rooms are decided. Equal shapes of a case are one, with two of their ids.
    """
    whole = lambda df: df.where(F.size("points") >= 3).select("case", "id", "points")
    keys = ["case", "cx", "cy"]
    shapes = whole(others).groupBy("case", "points").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("points")))
    near = settled(_cells(shapes, cell).select(*keys, "low", "high", F.col("points").alias("there"), P.bounds(F.col("points")).alias("b"), nth.alias("nth")), "room-cells")
    left = settled(_cells(whole(rooms), cell).select(*keys, "id", "points", P.bounds(F.col("points")).alias("a")), "rooms-open")
    last = near.agg(F.max("nth")).first()[0] or 0
    touch = (F.col("a.x0") <= F.col("b.x1")) & (F.col("b.x0") <= F.col("a.x1")) & (F.col("a.y0") <= F.col("b.y1")) & (F.col("b.y0") <= F.col("a.y1"))
    found, low, high = left.select("case", "id").limit(0), 0, BATCH
    while low < last:
        met = left.join(near.where((F.col("nth") > low) & (F.col("nth") <= high)), keys).where(touch & ((F.col("id") != F.col("low")) | (F.col("id") != F.col("high"))))
        hit = settled(met.where(P.polygons_overlap(F.col("points"), F.col("there"))).select("case", "id").distinct(), "rooms-hit")
        found, low, high = found.unionByName(hit), high, high * BATCH
        if low < last:
            left = settled(left.join(hit, ["case", "id"], "left_anti"), "rooms-open")
    return found


def close_rooms(drawn: DataFrame, current: DataFrame, cell: float = 128.0) -> DataFrame:
    """``drawn`` (case, id, name, points) with a verdict and the name it gets.

    Rejected are polygons of under three points, and those that overlap another room of their case's latest version
    (``current``: case, id, points). A changed room has its old id and is not held against its old shape. The polygons of a
    batch are judged each by itself, against the version they were drawn on. A room without a name gets a default one.
    """
    bad = overlapping(drawn, current, cell).withColumn("hit", F.lit(True))
    j = drawn.join(bad, ["case", "id"], "left")
    few = F.coalesce(F.size("points"), F.lit(0)) < 3
    verdict = F.when(few, "perlu tiga titik").when(F.col("hit"), "menimpa ruang lain").otherwise("diterima")
    named = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", NEW).otherwise(F.col("name"))
    return j.select("case", "id", named.alias("name"), "points", verdict.alias("verdict"))


def next_version(current: DataFrame, judged: DataFrame) -> DataFrame:
    """The rooms (case, id, name, points) of the next version: accepted ones in place of, or beside, the current ones."""
    new = judged.where("verdict = 'diterima'").select("case", "id", "name", "points")
    return current.join(new.select("case", "id"), ["case", "id"], "left_anti").select("case", "id", "name", "points").unionByName(new)
