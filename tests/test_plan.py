"""Distances, nearest components and whole plans from painted pixels."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from gambrel.functions import polygon as P
from gambrel.operators import distance, plan, rooms, runs, tracing
from test_tracing import area, on, pixels, sizes

LABELS = "img string, ord int, name string, cx double, cy double, x0 double, y0 double, x1 double, y1 double"


def label(img, k, name, x, y):
    return (img, k, name, float(x), float(y), x - 10.0, y - 5.0, x + 10.0, y + 5.0)


@pytest.mark.parametrize("metric", ["euclid", "chamfer"])
def test_distances_against_all_pairs(spark, metric):
    cost = {"euclid": math.hypot, "chamfer": lambda dx, dy: 0.955 * (max(dx, dy) - min(dx, dy)) + 1.3693 * min(dx, dy)}[metric]
    r = random.Random(3)
    cells = {(y, x) for y in range(30) for x in range(40) if r.random() < 0.85} | area(spark, [(0, 0, 20, 12)])
    far = distance.distances(runs.runs_of(pixels(spark, cells)), sizes(spark, 40, 30), metric)
    got = {(q.y, q.x0 + k): v for q in far.collect() for k, v in enumerate(q.d)}
    off = [(y, x) for y in range(30) for x in range(40) if (y, x) not in cells]
    assert got == pytest.approx({(y, x): min(cost(abs(x - b), abs(y - a)) for a, b in off) for y, x in cells})


def test_thick_ink_is_far_from_the_background(spark):
    r = random.Random(8)
    mask = runs.runs_of(pixels(spark, {(y, x) for y in range(30) for x in range(40) if r.random() < 0.93}))
    far = distance.distances(mask, sizes(spark, 40, 30))
    for least in (1.85, 2.2):
        assert on(rooms.thick(mask, sizes(spark, 40, 30), least)) == on(distance.at_least(far, least))


def test_whole_image_has_no_background(spark):
    mask = runs.runs_of(pixels(spark, area(spark, [(0, 0, 4, 3)])))
    assert {v for q in distance.distances(mask, sizes(spark, 5, 4)).collect() for v in q.d} == {math.inf}
    assert distance.distances(mask.limit(0), sizes(spark, 5, 4)).count() == 0


def test_half_thickness_is_fractional(spark):
    """A wall of ten lines: distances 1 to 5 steps, twice each."""
    half = distance.half_thickness(runs.runs_of(pixels(spark, area(spark, [(20, 20, 900, 29)]))), sizes(spark, 1000, 50)).first().half
    assert half == pytest.approx(0.955 * 3, abs=1e-6)
    radii = rooms.closing_radii(spark.createDataFrame([("p", half)], "img string, half double")).orderBy("attempt").collect()
    assert [q.radius for q in radii][:3] == [round(4 * half), round(4 * half * 1.6), round(4 * half * 1.6**2)]


def test_gaps_against_all_pixels(spark):
    r = random.Random(6)
    cells = set()
    for _ in range(14):
        x, y = r.randrange(0, 500), r.randrange(0, 400)
        cells |= area(spark, [(x, y, x + r.randrange(8, 60), y + r.randrange(8, 40))])
    comps = runs.labelled(runs.runs_of(pixels(spark, cells)), eight=True)
    by = {}
    for q in comps.collect():
        by.setdefault(q.comp, []).extend((q.y, x) for x in range(q.x0, q.x1 + 1))
    edge = {c: [p for p in px if sum((p[0] + a, p[1] + b) in cells for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))) < 4] for c, px in by.items() if len(px) >= 100}
    want = {(i, j): min(math.dist(p, q) for p in edge[i] for q in edge[j]) for i in edge for j in edge if i < j}
    gaps = distance.component_gaps(comps, 100)
    got = gaps.collect()
    assert {(q.i, q.j): q.gap for q in got} == pytest.approx(want) and len(want) > 20
    assert all(math.dist((q.yi, q.xi), (q.yj, q.xj)) == pytest.approx(q.gap) and (q.yi, q.xi) in by[q.i] and (q.yj, q.xj) in by[q.j] for q in got)
    tree, longest = {min(edge)}, 0.0
    while len(tree) < len(edge):
        gap, new = min((g, (set(k) - tree).pop()) for k, g in want.items() if len(set(k) & tree) == 1)
        tree, longest = tree | {new}, max(longest, gap)
    assert distance.longest_tree_edge(gaps).first().longest == pytest.approx(longest)


#: Two rooms of 106 by 120 with a door between them; its symbol stands in the left one.
WALLS = [(10, 10, 250, 19), (10, 140, 250, 149), (10, 10, 19, 149), (241, 10, 250, 149), (126, 10, 135, 60), (126, 95, 135, 149)]
SYMBOL = (108, 74, 116, 81)


def test_rectilinear_plan(spark):
    df = spark.createDataFrame([label("p", 0, "DAPUR", 70, 115), label("p", 1, "KAMAR", 190, 75)], LABELS)
    outline, found, doors = plan.rectilinear_plan(pixels(spark, area(spark, [*WALLS, SYMBOL])), sizes(spark, 270, 200), df)
    got = {q.name: q for q in found.withColumn("area", P.area(F.col("points"))).collect()}
    assert {(q.id, q.name, q.source) for q in got.values()} == {("r1", "DAPUR", "tulisan"), ("r2", "KAMAR", "tulisan")}
    assert all(0.9 * 106 * 120 < q.area < 1.25 * 106 * 120 for q in got.values())
    assert [(q.a, q.b) for q in doors.collect()] == [("r1", "r2")] and abs(doors.first().y - 77) < 6 and abs(doors.first().x - 130) < 6
    assert abs(outline.withColumn("area", P.area(F.col("points"))).first().area - 241 * 140) < 0.05 * 241 * 140


def slanted(w=260, h=220):
    """A diamond with thick walls, and a wall down its middle."""
    cx, cy = w // 2, h // 2
    return {(y, x) for y in range(h) for x in range(w) if 90 <= abs(x - cx) + abs(y - cy) <= 102 or (abs(x - cx) <= 4 and abs(y - cy) <= 96)}


def test_routing(spark):
    """A straight plan, a slanted one and an empty one in one run: each goes its way, and the first two have their rooms."""
    rows = [(i, y, x, 30) for i, cells in (("a", area(spark, [*WALLS, SYMBOL])), ("b", slanted())) for y, x in cells]
    px = spark.createDataFrame(rows, "img string, y int, x int, gray int")
    size = spark.createDataFrame([("a", 270, 200), ("b", 260, 220), ("c", 50, 50)], "img string, width int, height int")
    df = spark.createDataFrame([label("a", 0, "DAPUR", 70, 115), label("a", 1, "KAMAR", 190, 75), label("b", 0, "AULA", 90, 110), label("b", 1, "TAMAN", 170, 110)], LABELS)
    outlines, found, doors = plan.analyse(px, size, df)
    got = {(q.img, q.name): q for q in found.withColumn("area", P.area(F.col("points"))).collect()}
    want = {("a", "DAPUR"): ("rectilinear", "tulisan"), ("a", "KAMAR"): ("rectilinear", "tulisan"), ("b", "AULA"): ("organic", "poligon-organik"), ("b", "TAMAN"): ("organic", "poligon-organik")}
    assert {k: (q.mode, q.source) for k, q in got.items() if k[0] != "c"} == want
    assert all(0.75 * 85 * 85 < got[("b", n)].area < 1.1 * 90 * 90 for n in ("AULA", "TAMAN"))
    assert [(q.img, q.a, q.b) for q in doors.collect()] == [("a", "r1", "r2")]
    assert {q.img for q in outlines.collect()} == {"a", "b"}


def test_boxes_keep_to_their_own_area(spark):
    comps = spark.createDataFrame([("p", y, 10, 29, 1) for y in range(5, 25)] + [("p", y, 40, 60, 2) for y in range(5, 25)], "img string, y int, x0 int, x1 int, comp long")
    boxes = spark.createDataFrame([("p", 1, 1, 0, 0, 50, 40), ("p", 2, None, 0, 0, 9, 9), ("p", 3, 2, 0, 0, 41, 7), ("p", 4, 1, 25, 0, 31, 40)], "img string, id int, comp long, x0 int, y0 int, x1 int, y1 int")
    got = {q.id: (q.x0, q.y0, q.x1, q.y1) for q in rooms.clipped_boxes(boxes, comps).collect()}
    # 1 and 4 shrink to their area, 3 and 4 to under eight; 2 has none
    assert got == {1: (10, 5, 30, 25), 2: (0, 0, 9, 9)}
