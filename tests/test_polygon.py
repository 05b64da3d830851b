from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from gambrel.functions import labels as L
from gambrel.functions import polygon as P
from gambrel.operators import outline
from gambrel.operators.rooms import hull, simplified
from gambrel.operators.rooms import outline as boundary

SQUARE = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]
ELL = [[0.0, 0.0], [3.0, 0.0], [3.0, 1.0], [1.0, 1.0], [1.0, 3.0], [0.0, 3.0]]

WING = [[0.0, 0.0], [6.0, 0.0], [6.0, 1.0], [3.0, 1.0], [3.0, 1.5], [0.0, 1.5]]


def one(spark, points, expr):
    return spark.createDataFrame([(points,)], "points array<array<double>>").select(expr.alias("v")).first().v


def turned(points, angle, scale=1.0, dx=0.0, dy=0.0):
    c, s = math.cos(angle), math.sin(angle)
    return [[scale * (x * c - y * s) + dx, scale * (x * s + y * c) + dy] for x, y in points]


def test_area_centroid_bounds(spark):
    p = F.col("points")
    assert one(spark, ELL, P.area(p)) == 5.0
    assert one(spark, SQUARE, P.centroid(p)) == [1.0, 1.0]
    assert one(spark, [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]], P.centroid(p)) == [1.0, 1.0]
    n = one(spark, ELL, P.normalized(p))
    assert abs(one(spark, n, P.area(p)) - 1) < 1e-12
    assert max(math.hypot(*q) for q in one(spark, ELL, P.normalized_by_radius(p))) == pytest.approx(1)
    assert tuple(one(spark, ELL, P.bounds(p))) == (0, 0, 3, 3)


def test_inside_distance_crossing(spark):
    p = F.col("points")
    assert one(spark, ELL, P.contains(p, F.lit(0.5), F.lit(2.5))) and not one(spark, ELL, P.contains(p, F.lit(2.0), F.lit(2.0)))
    assert one(spark, SQUARE, P.boundary_distance(p, F.lit(5.0), F.lit(1.0))) == 3.0
    assert one(spark, SQUARE, P.inside_with_margin(p, F.lit(5.0), F.lit(1.0), 4.0)) and not one(spark, SQUARE, P.inside_with_margin(p, F.lit(5.0), F.lit(1.0), 2.0))
    assert one(spark, SQUARE, P.nearest_vertex(p, F.lit(1.9), F.lit(0.2))) == 1 and one(spark, SQUARE, P.nearest_vertex(p, F.lit(90.0), F.lit(0.0))) is None
    away = F.array(*[F.array(*[F.lit(v) for v in q]) for q in turned(SQUARE, 0, dx=5)])
    near = F.array(*[F.array(*[F.lit(v) for v in q]) for q in turned(SQUARE, 0.4, dx=1)])
    assert not one(spark, SQUARE, P.polygons_overlap(p, away)) and one(spark, SQUARE, P.polygons_overlap(p, near))
    assert one(spark, [[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]], P.straightness(p)) == pytest.approx(0, abs=1e-9)
    assert one(spark, [[0.0, 0.0], [1.0, 1.0], [2.0, 0.0]], P.straightness(p)) > 0.2
    assert one(spark, [[-1.0, 0.5], [0.5, 2.0], [1.0, 0.0], [0.0, 0.51]], P.panel_points(p, F.lit(100.0), F.lit(10.0))) == [[0, 5], [50, 10], [100, 0]]


@pytest.mark.parametrize("other, most", [(turned(ELL, math.radians(37)), 1e-9), (turned(ELL, math.pi), 1e-9), (turned(ELL, 0, 3, 7, -2), 1e-9), (ELL[2:] + ELL[:2], 1e-9)])
def test_outline_distance_is_invariant(spark, other, most):
    df = spark.createDataFrame([("p", ELL), ("q", other)], "id string, points array<array<double>>")
    pairs = spark.createDataFrame([("p", "q")], "a string, b string")
    assert outline.descriptor_distance(pairs, outline.descriptors(df, "id"), "id").first().distance <= most


def test_outline_distance_sees_winding_and_stretch(spark):
    df = spark.createDataFrame([("p", ELL), ("r", ELL[::-1]), ("w", WING), *[(f"s{k}", [[x * (1 + k / 10), y] for x, y in WING]) for k in range(1, 4)]], "id string, points array<array<double>>")
    pairs = df.where("id not in ('p', 'w')").select(F.when(F.col("id") == "r", "p").otherwise("w").alias("a"), F.col("id").alias("b"))
    d = {r.b: r.distance for r in outline.descriptor_distance(pairs, outline.descriptors(df, "id"), "id").collect()}
    assert d["r"] > 0.5 and d["s1"] < d["s2"] < d["s3"]
    same = {r.b: r.distance for r in outline.descriptor_distance(pairs, outline.descriptors(df, "id", orient=True), "id").collect()}
    assert same["r"] < 1e-9


def test_overlap_and_rotation(spark):
    df = spark.createDataFrame([(1, ELL, turned(ELL, math.radians(30)))], "k int, a array<array<double>>, b array<array<double>>")
    df = df.select("k", P.normalized(F.col("a")).alias("a"), P.normalized(F.col("b")).alias("b"))
    r = df.select(outline.overlap(F.col("a"), F.col("a"), 40).alias("same"), outline.overlap(F.col("a"), F.col("b"), 40).alias("ab"), outline.overlap(F.col("b"), F.col("a"), 40).alias("ba"), outline.overlap(F.col("a"), F.col("b"), 40, window=1.2).alias("w")).first()
    assert r.same == 1.0 and r.ab == r.ba < 1 and 0 < r.w < 1
    best = outline.best_rotation(df, ["k"], "a", "b", steps=12, coarse=25, fine=60).first()
    assert best.angle_step == 11 and best.overlap > 0.97


def plain_overlap(a, b, box, g):
    x0, y0, x1, y1 = box
    both = some = 0
    for j in range(g):
        y = y0 + (j + 0.5) * (y1 - y0) / g
        for i in range(g):
            x = x0 + (i + 0.5) * (x1 - x0) / g
            inside = [sum((p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0] for p, q in zip(poly, [*poly[1:], poly[0]])) % 2 for poly in (a, b)]
            both, some = both + min(inside), some + max(inside)
    return both / some if some else 0.0


def test_overlap_against_cells(spark):
    """Random and crossing outlines, edges on cell centres, flat and empty ones."""
    r = random.Random(2)
    shapes = [[[r.uniform(-1, 1), r.uniform(-1, 1)] for _ in range(r.randrange(3, 12))] for _ in range(24)]
    shapes += [SQUARE, [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]], [[1.0, 0.0], [2.0, 0.0], [3.0, 0.0]], [[0.0, 0.0], [0.0, 5.0]]]
    rows = [(k, shapes[k], shapes[k + 1]) for k in range(len(shapes) - 1)] + [(99, [], [])]
    df = spark.createDataFrame(rows, "k int, a array<array<double>>, b array<array<double>>")
    got = {q.k: (q.o, q.w) for q in df.select("k", outline.overlap(F.col("a"), F.col("b"), 20).alias("o"), outline.overlap(F.col("a"), F.col("b"), 24, window=1.2).alias("w")).collect()}
    for k, a, b in rows[:-1]:
        xs, ys = zip(*a, *b)
        want = plain_overlap(a, b, [1.15 * f(c) for f in (min, max) for c in (xs, ys)], 20), plain_overlap(a, b, [-1.2, -1.2, 1.2, 1.2], 24)
        assert got[k] == pytest.approx(want, abs=1e-12), k
    assert got[99] == (0.0, 0.0)


def test_verdicts_and_labels(spark):
    rows = [(0.1,), (0.15,), (0.4,)]
    assert [r.v for r in spark.createDataFrame(rows, "d double").select(L.outline_verdict(F.col("d")).alias("v")).collect()] == ["sangat dekat", "sedang", "jauh"]
    assert [r.v for r in spark.createDataFrame([(0.75,), (0.76,), (0.45,)], "d double").select(L.band(F.col("d")).alias("v")).collect()] == ["medium", "high", "low"]
    texts = [("toilet ", 0.9), ("3.50", 0.9), ("A", 0.9), ("R200", 0.44), (None, 0.9)]
    assert [bool(r.v) for r in spark.createDataFrame(texts, "t string, s double").select(L.is_token(F.col("t"), F.col("s")).alias("v")).collect()] == [True, False, False, False, False]
    pages = [("x\nLANTAI 1\nDENAH LANTAI", "DENAH LANTAI"), ("TAMPAK\nabc", "TAMPAK"), ("abc\n12", "Halaman 3"), ("abc\r\n\t DENAH LANTAI 1\u00a0\r\nX", "DENAH LANTAI 1"), ("平面図\u2028abc", "平面図")]
    assert [r.v for r in spark.createDataFrame(pages, "t string, w string").select(L.page_label(F.col("t"), F.lit(3)).alias("v")).collect()] == [w for _, w in pages]
    parts = spark.createDataFrame([([(2.0, 1.0, "ROOM"), (1.0, 1.0, "MEETING")],), ([(1.0, 1.0, "ROOM")],), ([(1.0, 1.0, "MEETINGROOM"), (2.0, 1.0, "ROOM")],), ([(1.0, 1.0, "WAITING ROOM"), (2.0, 1.0, "ROOM")],)], "p array<struct<cy:double,cx:double,text:string>>")
    assert [r.v for r in parts.select(L.joined_label(F.col("p")).alias("v")).collect()] == ["MEETING ROOM", None, "MEETING ROOM", "WAITING ROOM"]
    stems = [("dir/plan.v1.png", "plan_v1"), (".png", "_png"), ("a b/", "a_b"), ("", "kasus"), (None, "kasus"), ("x" * 90 + ".jpg", "x" * 80)]
    assert [r.v for r in spark.createDataFrame(stems, "t string, w string").select(L.stem(F.col("t"), "kasus").alias("v")).collect()] == [w for _, w in stems]
    kinds = [("A.JPEG", "", ".jpeg"), (".gif", "image/jpg", ".jpg"), (None, "IMAGE/WEBP", ".webp"), ("a.txt", "x/jpeg", ".png"), (None, None, ".png")]
    assert [r.v for r in spark.createDataFrame(kinds, "f string, c string, w string").select(L.extension(F.col("f"), F.col("c")).alias("v")).collect()] == [w for _, _, w in kinds]


def test_boundary_hull_simplification():
    rows = [(y, 2, 9) for y in range(3, 8)]
    ring = boundary(rows)
    assert sorted(simplified([(float(x), float(y)) for x, y in ring], 1.0)) == [(2, 3), (2, 8), (10, 3), (10, 8)]
    r = random.Random(1)
    pts = [(r.random(), r.random()) for _ in range(200)]
    h = hull(pts)
    assert all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= -1e-12 for a, b in zip(h, [*h[1:], h[0]]) for p in pts)
