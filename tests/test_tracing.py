from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from gambrel.functions import polygon as P
from gambrel.operators import rooms, runs, tracing, walls

BOX = "img string, x0 int, y0 int, x1 int, y1 int"


def box_runs(spark, boxes):
    return runs.merged(runs.boxes_as_runs(spark.createDataFrame([("p", *b) for b in boxes], BOX)))


def sizes(spark, w, h):
    return spark.createDataFrame([("p", w, h)], "img string, width int, height int")


def on(df):
    return {(r.y, x) for r in df.collect() for x in range(r.x0, r.x1 + 1)}


def pixels(spark, cells, gray=30):
    return spark.createDataFrame([("p", y, x, gray) for y, x in cells], "img string, y int, x int, gray int")


def area(spark, cells):
    return {(y, x) for x0, y0, x1, y1 in cells for y in range(y0, y1 + 1) for x in range(x0, x1 + 1)}


def test_rays_against_steps(spark):
    r = random.Random(4)
    cells = {(y, x) for y in range(40) for x in range(50) if r.random() < 0.03}
    mask = runs.runs_of(pixels(spark, cells))
    points = [("p", k, float(r.randrange(50)), float(r.randrange(40)), r.choice([3, 9, 80])) for k in range(40)]
    df = spark.createDataFrame(points, "img string, id int, cx double, cy double, cap int")

    def cast(x, y, dx, dy, cap):
        for _ in range(cap):
            if not (0 <= x + dx < 50 and 0 <= y + dy < 40):
                break
            x, y = x + dx, y + dy
            if (y, x) in cells:
                break
        return x if dx else y

    want = {k: tuple(cast(int(cx), int(cy), dx, dy, cap) for dx, dy in ((-1, 0), (0, -1), (1, 0), (0, 1))) for _, k, cx, cy, cap in points}
    got = {q.id: (q.x0, q.y0, q.x1, q.y1) for q in tracing.ray_boxes(mask, sizes(spark, 50, 40), df).collect()}
    assert got == want


def test_combs_against_plain(spark):
    r = random.Random(11)
    lines = sorted({(r.randrange(0, 160), r.randrange(0, 60), r.randrange(60, 140)) for _ in range(30)})
    starts = sorted({(c, a) for c, a, _ in lines})
    lines = [next(q for q in lines if q[:2] == s) for s in starts]
    gone, i = set(), 0
    while i < len(lines):
        k = i + 1
        while k < len(lines) and lines[k][0] - lines[k - 1][0] <= 24:
            k += 1
        free = list(range(i, k))
        while free:
            c, a, b = lines[free[0]]
            long = lambda n: max(1, lines[n][2] - lines[n][1])
            mine = [n for n in free if n == free[0] or (max(b - a, long(n)) / min(b - a, long(n)) <= 1.6 and min(b, lines[n][2]) - max(a, lines[n][1]) > 0.5 * max(b - a, long(n)))]
            free = [n for n in free if n not in mine]
            steps = [lines[q][0] - lines[p][0] for p, q in zip(mine, mine[1:])]
            mean = sum(steps) / len(steps) if steps else 0
            if len(mine) >= 4 and mean > 0 and math.sqrt(sum((s - mean) ** 2 for s in steps) / len(steps)) / mean <= 0.35:
                gone |= set(mine)
        i = k
    df = spark.createDataFrame([("p", "h", *q) for q in lines], "img string, axis string, coord int, a int, b int")
    got = sorted((q.coord, q.a, q.b) for q in walls.comb_patterns(df).collect())
    assert got == [q for n, q in enumerate(lines) if n not in gone]


def test_boxes_give_way_in_order(spark):
    rows = [("p", 1, 0, False, 0.0, 0.0, 10.0, 10.0), ("p", 2, 1, False, 6.0, 1.0, 20.0, 9.0), ("p", 3, 2, True, 15.0, 0.0, 30.0, 10.0)]
    df = spark.createDataFrame(rows, "img string, id int, ord int, fixed boolean, x0 double, y0 double, x1 double, y1 double")
    got = {q.id: (q.x0, q.y0, q.x1, q.y1) for q in walls.separated_boxes(df).collect()}
    assert got == {1: (0, 0, 10, 10), 2: (10, 1, 15, 9), 3: (15, 0, 30, 10)}


def test_ink_lines(spark):
    cells = area(spark, [(10, 20, 190, 27), (10, 100, 160, 100), (10, 140, 60, 140)])
    at = spark.createDataFrame([], "img string, cx double, cy double")
    got = {(q.axis, q.coord, q.a, q.b) for q in tracing.ink_lines(pixels(spark, cells), sizes(spark, 200, 160), at).collect()}
    # long thin lines whole, short ones not; a thick wall's outer lines are thin too
    assert got == {("h", 100, 10, 160), ("h", 23, 12, 188), *(("h", y, 10, 190) for y in (20, 21, 26, 27))}


def test_bridges_and_silhouettes(spark):
    """Four walls with gaps at two corners become one ring."""
    walls_ = [(10, 10, 120, 18), (10, 10, 18, 120), (30, 112, 120, 120), (112, 30, 120, 120)]
    mask, s = box_runs(spark, walls_), sizes(spark, 140, 140)
    full = on(tracing.bridged(mask))
    assert on(mask) < full
    assert runs.measures(runs.labelled(tracing.bridged(mask), eight=True)).count() == 1
    out = tracing.outer_silhouette(mask, s).withColumn("area", P.area(F.col("points"))).first()
    assert abs(out.area - 111 * 111) < 500
    alone = tracing.traced_silhouette(mask).withColumn("area", P.area(F.col("points"))).first()
    assert alone.area < out.area


def test_filled(spark):
    df = spark.createDataFrame([("p", [[2.0, 2.0], [12.0, 2.0], [12.0, 9.0], [2.0, 9.0]])], "img string, points array<array<double>>")
    assert on(tracing.filled(df)) == {(y, x) for y in range(2, 10) for x in range(2, 13)}


def test_organic_plan(spark):
    """Two rooms with a door between them, and a label on a wall of neither."""
    w = [(10, 10, 250, 19), (10, 140, 250, 149), (10, 10, 19, 149), (241, 10, 250, 149), (126, 10, 135, 60), (126, 85, 135, 149)]
    labels = [("p", 0, "DAPUR", 70.0, 75.0, 60.0, 70.0, 80.0, 80.0), ("p", 1, "KAMAR", 190.0, 75.0, 180.0, 70.0, 200.0, 80.0), ("p", 2, "R200", 70.0, 30.0, 65.0, 28.0, 75.0, 32.0), ("p", 3, "JUDUL", 20.0, 180.0, 10.0, 175.0, 30.0, 185.0)]
    df = spark.createDataFrame(labels, "img string, ord int, name string, cx double, cy double, x0 double, y0 double, x1 double, y1 double")
    _, found = tracing.organic_plan(pixels(spark, area(spark, w)), sizes(spark, 270, 200), df)
    got = {q.name: q for q in found.withColumn("area", P.area(F.col("points"))).collect()}
    assert set(got) == {"DAPUR", "KAMAR"} and {q.source for q in got.values()} == {"poligon-organik"}
    # closing rounds a room's corners and simplifying cuts them, so it lies inside its walls
    least, most = sorted(q.area for q in got.values())
    assert 0.75 * 106 * 120 < least and most <= 1.02 * 106 * 120


def test_page_plan(spark):
    mask = box_runs(spark, [(10, 10, 150, 14), (10, 100, 150, 104), (10, 10, 14, 104), (146, 10, 150, 104)])
    names = spark.createDataFrame([("p", 1, "HALL", 60.0, 50.0), ("p", 2, "R90", 70.0, 50.0), ("p", 3, "", 70.0, 60.0)], "img string, id int, name string, cx double, cy double")
    outline, found = tracing.page_plan(mask, sizes(spark, 170, 120), names)
    assert [(q.name, q.points) for q in found.collect()] == [("HALL", [[14.0, 14.0], [132.0, 14.0], [132.0, 100.0], [14.0, 100.0]])]
    assert outline.count() == 1


def test_doors_need_a_symbol_off_the_wall(spark):
    wall = area(spark, [(10, 60, 60, 63), (90, 60, 200, 63)])
    seg = spark.createDataFrame([("p", "h", 61, 10, 200)], "img string, axis string, coord int, a int, b int")
    labels = spark.createDataFrame([("p", y, 0, 219, 1 if y < 55 else 2) for y in range(120) if not 55 <= y <= 68], "img string, y int, x0 int, x1 int, comp long")
    known = spark.createDataFrame([("p", 1), ("p", 2)], "img string, comp long")
    door = lambda cells: [(q.x, q.y) for q in rooms.doors(seg, labels, runs.runs_of(pixels(spark, cells)), known).collect()]
    assert door(wall) == []
    assert door(wall | area(spark, [(70, 75, 80, 85)])) == [(75, 61)]
