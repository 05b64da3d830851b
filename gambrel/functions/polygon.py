"""Polygon measures as column expressions. A polygon is ``array<array<double>>`` of (x, y), closed implicitly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<array<double>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once a row; what a lambda's body only names is worked out at each call."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _x(p: Column) -> Column:
    return F.get(p, F.lit(0))


def _y(p: Column) -> Column:
    return F.get(p, F.lit(1))


def edges(points: Column) -> Column:
    """array<struct<ax,ay,bx,by>>: each vertex with the next, the last with the first."""
    n = F.size(points)
    following = F.concat(F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(1), F.least(n, F.lit(1))))
    return F.zip_with(points, following, lambda a, b: F.struct(_x(a).alias("ax"), _y(a).alias("ay"), _x(b).alias("bx"), _y(b).alias("by")))


def _total(of: Column, term) -> Column:
    return F.aggregate(of, F.lit(0.0), lambda acc, e: acc + term(e))


def _cross(e: Column) -> Column:
    return e["ax"] * e["by"] - e["bx"] * e["ay"]


def signed_area(points: Column) -> Column:
    return _total(edges(points), _cross) / 2


def area(points: Column) -> Column:
    """G1: the shoelace area, without sign."""
    return F.abs(signed_area(points))


def vertex_mean(points: Column) -> Column:
    """The mean of the vertices."""
    n = F.size(points)
    return F.array(_total(points, _x) / n, _total(points, _y) / n)


def centroid(points: Column) -> Column:
    """The centroid of the area; the mean of the vertices where the area is under 1e-9."""
    a = signed_area(points)
    cx = _total(edges(points), lambda e: (e["ax"] + e["bx"]) * _cross(e)) / (6 * a)
    cy = _total(edges(points), lambda e: (e["ay"] + e["by"]) * _cross(e)) / (6 * a)
    return F.when(F.abs(a) < 1e-9, vertex_mean(points)).otherwise(F.array(cx, cy))


def shifted(points: Column, by: Column, over: Column) -> Column:
    return F.transform(points, lambda p: F.array((_x(p) - _x(by)) / over, (_y(p) - _y(by)) / over))


def normalized(points: Column) -> Column:
    """Centred on the centroid, of area 1; a polygon without area is only centred."""
    root = F.sqrt(area(points))
    by = F.struct(centroid(points).alias("c"), F.when(root == 0, 1.0).otherwise(root).alias("over"))
    return let(by, lambda v: shifted(points, v["c"], v["over"]))


def normalized_by_radius(points: Column) -> Column:
    """Centred on the vertex mean, of largest radius 1."""

    def around(c: Column) -> Column:
        most = F.array_max(F.transform(points, lambda p: F.hypot(_x(p) - _x(c), _y(p) - _y(c))))
        return let(F.when(most == 0, 1.0).otherwise(most), lambda m: shifted(points, c, m))

    return let(vertex_mean(points), around)


def rotated(points: Column, angle: Column) -> Column:
    """By ``angle`` radians about the origin."""
    cos, sin = F.cos(angle), F.sin(angle)
    return F.transform(points, lambda p: F.array(_x(p) * cos - _y(p) * sin, _x(p) * sin + _y(p) * cos))


def bounds(points: Column) -> Column:
    """struct<x0,y0,x1,y1>."""
    xs, ys = F.transform(points, _x), F.transform(points, _y)
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def contains(points: Column, x: Column, y: Column, guard: float = 0.0) -> Column:
    """Whether a point is inside, by the even-odd rule, edges half-open in y; ``guard`` is added to their rise."""

    return contains_by_edges(edges(points), x, y, guard)


def contains_by_edges(sides: Column, x: Column, y: Column, guard: float = 0.0) -> Column:
    def crosses(e: Column) -> Column:
        at = (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"] + guard) + e["ax"]
        return ((e["ay"] > y) != (e["by"] > y)) & (x < at)

    return F.size(F.filter(sides, crosses)) % 2 == 1


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to a segment."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / square)))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def boundary_distance(points: Column, x: Column, y: Column) -> Column:
    return F.array_min(F.transform(edges(points), lambda e: segment_distance(x, y, e["ax"], e["ay"], e["bx"], e["by"])))


def inside_with_margin(points: Column, x: Column, y: Column, margin: float = 15.0) -> Column:
    """Inside, or outside by at most ``margin``."""
    return contains(points, x, y) | (boundary_distance(points, x, y) <= margin)


def nearest_vertex(points: Column, x: Column, y: Column, within: float = 12.0) -> Column:
    """The position of the nearest vertex closer than ``within``, the first of equals; else null."""
    near = F.transform(points, lambda p, i: F.struct(F.hypot(_x(p) - x, _y(p) - y).alias("d"), i.alias("i")))
    best = F.array_min(near)
    return F.when(best["d"] < within, best["i"])


def _side(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
    return (qx - px) * (ry - py) - (qy - py) * (rx - px)


def segments_cross(a: Column, b: Column) -> Column:
    """Whether two edges (struct<ax,ay,bx,by>) cross in a point inside both."""
    one = _side(a["ax"], a["ay"], a["bx"], a["by"], b["ax"], b["ay"]) * _side(a["ax"], a["ay"], a["bx"], a["by"], b["bx"], b["by"])
    two = _side(b["ax"], b["ay"], b["bx"], b["by"], a["ax"], a["ay"]) * _side(b["ax"], b["ay"], b["bx"], b["by"], a["bx"], a["by"])
    return (one < 0) & (two < 0)


def polygons_overlap(a: Column, b: Column) -> Column:
    """A vertex of either is inside the other, or two edges cross."""
    inside = lambda of, sides: F.exists(of, lambda p: contains_by_edges(sides, _x(p), _y(p), 1e-9))
    met = lambda v: inside(a, v["b"]) | inside(b, v["a"]) | F.exists(v["a"], lambda e: F.exists(v["b"], lambda f: segments_cross(e, f)))
    return let(F.struct(edges(a).alias("a"), edges(b).alias("b")), met)


def box_overlap(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """struct<x0,y0,x1,y1> of two boxes' intersection; null if it is 1 or less in a dimension."""
    x0, y0, x1, y1 = F.greatest(ax0, bx0), F.greatest(ay0, by0), F.least(ax1, bx1), F.least(ay1, by1)
    return F.when((x1 - x0 > 1) & (y1 - y0 > 1), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def panel_points(fractions: Column, width: Column, height: Column) -> Column:
    """Fractional points on a panel: clamped to 0..1, scaled, a last point within 3 of the first left out; null if
    fewer than three remain."""
    clamp = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    scaled = F.transform(fractions, lambda p: F.array(clamp(_x(p)) * width, clamp(_y(p)) * height))
    first, last = F.get(scaled, F.lit(0)), F.get(scaled, F.size(scaled) - 1)
    double = (F.size(scaled) > 1) & (F.hypot(_x(first) - _x(last), _y(first) - _y(last)) < 3)
    kept = F.when(double, F.slice(scaled, F.lit(1), F.greatest(F.size(scaled) - 1, F.lit(0)))).otherwise(scaled)
    return F.when(F.size(kept) >= 3, kept)


def straightness(points: Column) -> Column:
    """Of a path, the largest distance from its principal axis over the diagonal of its bounds, in closed form; 0 for
    under three points or none apart."""

    def about(c: Column) -> Column:
        dx, dy = (lambda p: _x(p) - _x(c)), (lambda p: _y(p) - _y(c))
        sxx, syy, sxy = (_total(points, f) for f in (lambda p: dx(p) * dx(p), lambda p: dy(p) * dy(p), lambda p: dx(p) * dy(p)))
        return let(0.5 * F.atan2(2 * sxy, sxx - syy), lambda angle: across(c, angle))

    def across(c: Column, angle: Column) -> Column:
        most = F.array_max(F.transform(points, lambda p: F.abs((_y(p) - _y(c)) * F.cos(angle) - (_x(p) - _x(c)) * F.sin(angle))))
        return let(bounds(points), lambda b: most / F.nullif(F.hypot(b["x1"] - b["x0"], b["y1"] - b["y0"]), F.lit(0.0)))

    return F.when(F.size(points) < 3, 0.0).otherwise(F.coalesce(let(vertex_mean(points), about), F.lit(0.0)))


def axis_share(points: Column, within: float = 14.0) -> Column:
    """A5: the share of an outline's length in sides at most ``within`` degrees off an axis; 0 for under four points."""
    length = lambda e: F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"])
    turn = lambda e: F.pmod(F.degrees(F.atan2(e["by"] - e["ay"], e["bx"] - e["ax"])), F.lit(90.0))
    along = lambda e: F.least(turn(e), 90 - turn(e)) <= within
    share = let(edges(points), lambda v: _total(F.filter(v, along), length) / F.nullif(_total(v, length), F.lit(0.0)))
    return F.when(F.size(points) < 4, 0.0).otherwise(F.coalesce(share, F.lit(0.0)))
