from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gambrel.functions import polygon as P
from gambrel.operators import distance, facade, rooms, runs, vector, walls


def mask(seed: int, h: int, w: int, share: float) -> list[list[bool]]:
    r = random.Random(seed)
    return [[r.random() < share for _ in range(w)] for _ in range(h)]


def frame(spark, m):
    return spark.createDataFrame([("i", y, x) for y, line in enumerate(m) for x, v in enumerate(line) if v], "img string, y int, x int")


def pixels(df):
    return {(r.y, x) for r in df.collect() for x in range(r.x0, r.x1 + 1)}


def sizes(spark, h, w):
    return spark.createDataFrame([("i", w, h)], "img string, width int, height int")


def flood(cells, eight):
    left, out = set(cells), []
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not (a and b))]
    while left:
        todo, comp = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            comp.add((y, x))
            for a, b in steps:
                if (y + a, x + b) in left:
                    left.remove((y + a, x + b))
                    todo.append((y + a, x + b))
        out.append(frozenset(comp))
    return set(out)


@pytest.mark.parametrize("eight", [False, True])
def test_components_and_complement(spark, eight):
    m = mask(3, 14, 17, 0.45)
    r = runs.runs_of(frame(spark, m))
    want = {(y, x) for y, line in enumerate(m) for x, v in enumerate(line) if v}
    assert pixels(r) == want
    assert pixels(runs.complement(r, sizes(spark, 14, 17))) == {(y, x) for y in range(14) for x in range(17)} - want
    lab = runs.labelled(r, eight).collect()
    comps = {}
    for q in lab:
        comps.setdefault(q.comp, set()).update((q.y, x) for x in range(q.x0, q.x1 + 1))
    assert {frozenset(c) for c in comps.values()} == flood(want, eight)


def test_dilation_erosion_closing(spark):
    m = mask(4, 12, 15, 0.6)
    on = {(y, x) for y, line in enumerate(m) for x, v in enumerate(line) if v}
    r, s = runs.runs_of(frame(spark, m)), sizes(spark, 12, 15)
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    assert pixels(runs.dilated(r, runs.square(1))) == {(y + a, x + b) for y, x in on for a, b in near}
    thick = {(y, x) for y, x in on if all((y + a, x + b) in on or not (0 <= y + a < 12 and 0 <= x + b < 15) for a, b in near)}
    assert pixels(rooms.thick(r, s)) == thick
    assert on <= pixels(runs.closed(r, s, 2))
    assert pixels(runs.minus(r, r, s)) == set()


def test_runs(spark):
    df = spark.createDataFrame([("k", x) for x in (1, 2, 3, 6, 7, 20, 21, 22, 23)], "k string, x int")
    got = lambda **a: sorted((r.start, r.stop) for r in runs.islands(df, ["k"], "x", **a).collect())
    assert got() == [(1, 3), (6, 7), (20, 23)] and got(bridge=2) == [(1, 7), (20, 23)] and got(least=4) == [(20, 23)]
    dash = spark.createDataFrame([("i", 5, x) for d in range(7) for x in range(d * 25, d * 25 + 12)], "img string, y int, x int")
    assert [(r.y, r.start, r.stop) for r in runs.dashed_lines(dash, ["img"], ["y"], "x").collect()] == [(5, 0, 161)]
    for step, found in ((33, True), (34, False)):  # dashes of twelve, 22 or 23 from the end of one to the start of the next
        far = spark.createDataFrame([("i", 5, x) for d in range(6) for x in range(d * step, d * step + 12)], "img string, y int, x int")
        assert (runs.dashed_lines(far, ["img"], ["y"], "x").count() == 1) is found
    radii = [r.radius for r in rooms.closing_radii(spark.createDataFrame([("i", 1.0), ("j", 3.3)], "img string, half double")).orderBy("img", "attempt").collect()]
    want = []
    for start in (8.0, 13.2):
        for _ in range(8):
            want.append(int(round(start)))
            start *= 1.6
    assert radii == want


def paint(spark, boxes, dark=30):
    rows = set()
    for x0, y0, x1, y1 in boxes:
        for t in (0, 1):
            rows |= {(y0 + t, x) for x in range(x0, x1 + 1)} | {(y1 - t, x) for x in range(x0, x1 + 1)}
            rows |= {(y, x0 + t) for y in range(y0, y1 + 1)} | {(y, x1 - t) for y in range(y0, y1 + 1)}
    return spark.createDataFrame([("f", y, x, dark) for y, x in rows], "img string, y int, x int, gray int")


def test_synthetic_facade(spark):
    """A wall of 340 by 580 with openings of 100 by 200, 100 by 100 and 100 by 180."""
    px = paint(spark, [(80, 60, 420, 640), (130, 130, 230, 330), (280, 400, 380, 500), (150, 450, 250, 630)])
    s = spark.createDataFrame([("f", 500, 700), ("empty", 50, 50)], "img string, width int, height int")
    summary, openings = facade.analyze(px, s)
    got = {r.img: r for r in summary.collect()}
    nominal = 48000 / 149200
    assert abs(got["f"].ratio - nominal) / nominal <= 0.05 and got["f"].openings == 3
    assert (got["f"].x0, got["f"].y0, got["f"].x1, got["f"].y1) == (80, 60, 420, 640)
    assert got["empty"].status == "no_building" and got["empty"].ratio is None and got["empty"].openings == 0
    sized = openings.orderBy("nth").collect()
    assert [r.nth for r in sized] == [1, 2, 3] and sum(r.area_frac for r in sized) < 0.3


def test_rooms_are_traced_and_claimed(spark):
    s = spark.createDataFrame([("p", 60, 40)], "img string, width int, height int")
    wall = runs.boxes_as_runs(spark.createDataFrame([("p", x0, y0, x1, y1) for x0, y0, x1, y1 in ((0, 0, 59, 1), (0, 38, 59, 39), (0, 0, 1, 39), (58, 0, 59, 39), (28, 0, 29, 39))], "img string, x0 int, y0 int, x1 int, y1 int"))
    names = spark.createDataFrame([("p", 0, "A", 10.0, 10.0), ("p", 1, "B", 12.0, 12.0), ("p", 2, "C", 28.5, 5.0)], "img string, ord int, name string, cx double, cy double")
    inside = runs.boxes_as_runs(spark.createDataFrame([("p", 0, 0, 59, 39)], "img string, x0 int, y0 int, x1 int, y1 int"))
    px = spark.createDataFrame([("p", 2400)], "img string, pixels long")
    got = {r.name: r for r in rooms.trace_plan(s, wall, names, inside, px).withColumn("area", P.area(F.col("points"))).collect()}
    assert set(got) == {"A", "sirkulasi"}
    assert got["A"].area == 26 * 36 and got["sirkulasi"].area == 28 * 36 and got["sirkulasi"].source == "terkaan"


def test_wall_cleanup(spark):
    comb = [("i", "v", 10 + 12 * k, 0, 100) for k in range(6)] + [("i", "v", 300, 0, 100), ("i", "h", 5, 0, 400)]
    seg = spark.createDataFrame(comb, "img string, axis string, coord int, a int, b int")
    assert sorted((r.axis, r.coord) for r in walls.comb_patterns(seg).collect()) == [("h", 5), ("v", 300)]
    pair = spark.createDataFrame([("i", "h", 10, 0, 50), ("i", "h", 14, 60, 120), ("i", "h", 200, 0, 30)], "img string, axis string, coord int, a int, b int")
    assert [(r.coord, r.a, r.b) for r in walls.cluster_runs(pair).collect()] == [(12, 0, 120)]
    at = spark.createDataFrame([("i", 1, 50.0, 50.0)], "img string, id int, cx double, cy double")
    assert walls.nearest_walls(at, seg).select("x0", "x1", "y0", "y1").first() == (34, 58, 5, None)


def test_token_groups_and_boxes(spark):
    t = spark.createDataFrame([("i", 10.0, 10.0, "MEETING", 0.0, 0.0, 20.0, 20.0), ("i", 30.0, 20.0, "ROOM", 20.0, 12.0, 40.0, 28.0), ("i", 300.0, 20.0, "HALL", 290.0, 10.0, 310.0, 30.0)], "img string, cx double, cy double, text string, x0 double, y0 double, x1 double, y1 double")
    assert sorted(len(r.parts) for r in walls.group_tokens(t).collect()) == [1, 2]
    b = spark.createDataFrame([("i", 1, 0, True, 0.0, 0.0, 10.0, 10.0), ("i", 2, 1, False, 6.0, 0.0, 20.0, 10.0)], "img string, id int, ord int, fixed boolean, x0 double, y0 double, x1 double, y1 double")
    assert {r.id: (r.x0, r.x1) for r in walls.separated_boxes(b).collect()} == {1: (0, 10), 2: (10, 20)}


def test_gaps_radius_and_silhouettes(spark):
    m = [[(2 <= x <= 31 or 36 <= x <= 65) and 2 <= y <= 31 for x in range(70)] for y in range(35)]
    lab = runs.labelled(runs.runs_of(frame(spark, m)))
    gaps = distance.component_gaps(lab)
    assert [r.gap for r in gaps.collect()] == [5.0]
    assert rooms.merge_radius(gaps, sizes(spark, 35, 70)).first().radius == 10
    assert rooms.bridge_cutoff(spark.createDataFrame([("i", 1, 2, 3.0), ("i", 1, 3, 4.0), ("i", 2, 3, 40.0)], "img string, i int, j int, gap double")).first().cutoff == 4.0
    out = rooms.silhouettes(runs.runs_of(frame(spark, m)), sizes(spark, 35, 70), 4, tolerance=3.0).withColumn("area", P.area(F.col("points"))).first()
    assert out.how == "traced" and abs(out.area - 64 * 30) < 40


def test_vector_layers(spark):
    d = spark.createDataFrame([([0.1, 0.1, 0.1], None, 1, [[0.0, 0.0], [1.0, 0.0]]), (None, [0.0, 0.0, 0.0], 12, [[0.0, 0.0], [5.0, 4.0], [10.0, 0.0]]), (None, [0.0, 0.0, 0.0], 12, [[0.0, 0.0], [5.0, 0.0]]), ([1.0, 1.0, 1.0], None, 3, [[0.0, 0.0]])], "f array<double>, c array<double>, n int, p array<array<double>>")
    assert [r.v for r in d.select(vector.drawing_class(F.col("f"), F.col("c"), F.col("n"), F.col("p")).alias("v")).collect()] == ["wall", "curve", None, None]
    line = spark.createDataFrame([("i", 1.0, 2.0, 4.0, 2.0)], "img string, x0 double, y0 double, x1 double, y1 double")
    assert [(r.y, r.x0, r.x1) for r in vector.lines_as_runs(line).collect()] == [(4, 2, 8)]


@pytest.mark.parametrize("eight", [False, True])
def test_components_across_stripes(spark, monkeypatch, eight):
    monkeypatch.setattr(runs, "STRIPE", 4)
    r = random.Random(8)
    pixels_ = {(y, x) for y in range(30) for x in range(24) if r.random() < 0.55}
    df = runs.runs_of(spark.createDataFrame([("i", y, x) for y, x in pixels_], "img string, y int, x int"))
    near = [(-1, 0), (1, 0), (0, -1), (0, 1)] + [(a, b) for a in (-1, 1) for b in (-1, 1)] * eight
    want, left = set(), set(pixels_)
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            seen.add((y, x))
            for a, b in near:
                if (y + a, x + b) in left:
                    left.remove((y + a, x + b))
                    todo.append((y + a, x + b))
        want.add(frozenset(seen))
    got = {}
    for q in runs.labelled(df, eight=eight).collect():
        got.setdefault(q.comp, set()).update((q.y, x) for x in range(q.x0, q.x1 + 1))
    assert set(map(frozenset, got.values())) == want
    assert all(c == min((y << 32) + x for y, x in cells) for c, cells in got.items())
