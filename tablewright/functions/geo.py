"""Plane geometry as column expressions.

point ``struct<x,y>``, segment and box ``struct<x1,y1,x2,y2>`` (box: high corner
first), line ``struct<a,b,c>`` for ax+by+c=0, circle ``struct<x,y,r>``, path and
polygon ``array<struct<x,y>>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.core import bound

EPSILON = 1e-6  # fixed value: coordinates closer than this count as equal
EARTH_RADIUS_M = 6378168.0  # fixed value
EARTH_RADIUS_MILES = 3958.747716  # fixed value


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def same(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= EPSILON


def left(a: Column, b: Column) -> Column:
    return b["x"] - a["x"] > EPSILON


def right(a: Column, b: Column) -> Column:
    return left(b, a)


def below(a: Column, b: Column) -> Column:
    return b["y"] - a["y"] > EPSILON


def above(a: Column, b: Column) -> Column:
    return below(b, a)


def same_point(a: Column, b: Column) -> Column:
    return same(a["x"], b["x"]) & same(a["y"], b["y"])


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def add(a: Column, b: Column) -> Column:
    return point(a["x"] + b["x"], a["y"] + b["y"])


def subtract(a: Column, b: Column) -> Column:
    return point(a["x"] - b["x"], a["y"] - b["y"])


def multiply(a: Column, b: Column) -> Column:
    """Product as complex numbers: scale and turn."""
    return point(a["x"] * b["x"] - a["y"] * b["y"], a["x"] * b["y"] + a["y"] * b["x"])


def divide(a: Column, b: Column) -> Column:
    size = b["x"] * b["x"] + b["y"] * b["y"]
    return point((a["x"] * b["x"] + a["y"] * b["y"]) / size, (a["y"] * b["x"] - a["x"] * b["y"]) / size)


def slope(a: Column, b: Column) -> Column:
    """Slope through two points; the greatest double when they are one above the other."""
    return F.when(same(a["x"], b["x"]), F.lit(1.7976931348623157e308)).otherwise((a["y"] - b["y"]) / (a["x"] - b["x"]))


# -- boxes ---------------------------------------------------------------------


def box(a: Column, b: Column) -> Column:
    return F.struct(
        F.greatest(a["x"], b["x"]).alias("x1"), F.greatest(a["y"], b["y"]).alias("y1"), F.least(a["x"], b["x"]).alias("x2"),
        F.least(a["y"], b["y"]).alias("y2"),
    )


def _le(a: Column, b: Column) -> Column:
    return a - b <= EPSILON


def _lt(a: Column, b: Column) -> Column:
    return b - a > EPSILON


def box_overlaps(a: Column, b: Column) -> Column:
    return _le(a["x2"], b["x1"]) & _le(b["x2"], a["x1"]) & _le(a["y2"], b["y1"]) & _le(b["y2"], a["y1"])


def box_contains(a: Column, b: Column) -> Column:
    return _le(b["x1"], a["x1"]) & _le(a["x2"], b["x2"]) & _le(b["y1"], a["y1"]) & _le(a["y2"], b["y2"])


def box_contains_point(a: Column, p: Column) -> Column:
    return (p["x"] <= a["x1"]) & (p["x"] >= a["x2"]) & (p["y"] <= a["y1"]) & (p["y"] >= a["y2"])


def box_left(a: Column, b: Column) -> Column:
    return _lt(a["x1"], b["x2"])


def box_below(a: Column, b: Column) -> Column:
    return _lt(a["y1"], b["y2"])


def box_width(a: Column) -> Column:
    return a["x1"] - a["x2"]


def box_height(a: Column) -> Column:
    return a["y1"] - a["y2"]


def box_area(a: Column) -> Column:
    return box_width(a) * box_height(a)


def box_center(a: Column) -> Column:
    return point((a["x1"] + a["x2"]) / 2, (a["y1"] + a["y2"]) / 2)


def box_diagonal(a: Column) -> Column:
    return segment(point(a["x1"], a["y1"]), point(a["x2"], a["y2"]))


def box_intersect(a: Column, b: Column) -> Column:
    cut = F.struct(
        F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"), F.greatest(a["x2"], b["x2"]).alias("x2"),
        F.greatest(a["y2"], b["y2"]).alias("y2"),
    )
    return F.when(box_overlaps(a, b), cut)


# -- segments and lines --------------------------------------------------------


def segment(a: Column, b: Column) -> Column:
    return F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def segment_length(s: Column) -> Column:
    return F.hypot(s["x1"] - s["x2"], s["y1"] - s["y2"])


def _cross(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    return ux * vy - uy * vx


def _run(s: Column) -> tuple[Column, Column]:
    return s["x2"] - s["x1"], s["y2"] - s["y1"]


def parallel(s: Column, t: Column) -> Column:
    return same(_cross(*_run(s), *_run(t)), F.lit(0.0))


def perpendicular(s: Column, t: Column) -> Column:
    (ax, ay), (bx, by) = _run(s), _run(t)
    return same(ax * bx + ay * by, F.lit(0.0))


@bound
def segments_cross(s: Column, t: Column) -> Column:
    """Do two segments meet? Ends count; collinear ones meet where they overlap."""
    side = lambda p, x, y: _cross(*_run(p), x - p["x1"], y - p["y1"])
    d1, d2 = side(s, t["x1"], t["y1"]), side(s, t["x2"], t["y2"])
    d3, d4 = side(t, s["x1"], s["y1"]), side(t, s["x2"], s["y2"])
    span = lambda p: F.struct(
        F.greatest(p["x1"], p["x2"]).alias("x1"), F.greatest(p["y1"], p["y2"]).alias("y1"), F.least(p["x1"], p["x2"]).alias("x2"),
        F.least(p["y1"], p["y2"]).alias("y2"),
    )
    return (d1 * d2 <= 0) & (d3 * d4 <= 0) & box_overlaps(span(s), span(t))


def closest_point(s: Column, p: Column) -> Column:
    """Point of a segment nearest to ``p``."""
    dx, dy = _run(s)
    size = dx * dx + dy * dy
    along = ((p["x"] - s["x1"]) * dx + (p["y"] - s["y1"]) * dy) / size
    u = F.when(size == 0, F.lit(0.0)).otherwise(F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0)))
    return point(s["x1"] + u * dx, s["y1"] + u * dy)


def point_segment_distance(p: Column, s: Column) -> Column:
    return distance(p, closest_point(s, p))


def line_through(a: Column, b: Column) -> Column:
    """ax + by + c = 0, with b = -1 unless the line is vertical."""
    vertical = same(a["x"], b["x"])
    m = (a["y"] - b["y"]) / (a["x"] - b["x"])
    return F.struct(
        F.when(vertical, F.lit(-1.0)).otherwise(m).alias("a"), F.when(vertical, F.lit(0.0)).otherwise(F.lit(-1.0)).alias("b"),
        F.when(vertical, a["x"]).otherwise(a["y"] - m * a["x"]).alias("c"),
    )


def lines_meet(p: Column, q: Column) -> Column:
    """Crossing point of two lines; NULL when parallel."""
    det = p["a"] * q["b"] - q["a"] * p["b"]
    meet = point((p["b"] * q["c"] - q["b"] * p["c"]) / det, (q["a"] * p["c"] - p["a"] * q["c"]) / det)
    return F.when(~same(det, F.lit(0.0)), meet)


def point_line_distance(p: Column, line: Column) -> Column:
    return F.abs(line["a"] * p["x"] + line["b"] * p["y"] + line["c"]) / F.hypot(line["a"], line["b"])


# -- paths and polygons --------------------------------------------------------


def _next(pts: Column) -> Column:
    """Points shifted by one, the first one last."""
    n = F.size(pts)
    return F.concat(F.slice(pts, F.lit(2), n - 1), F.slice(pts, 1, 1))


def path_length(pts: Column, closed: bool = False) -> Column:
    n = F.size(pts)
    steps = F.zip_with(pts, _next(pts), lambda a, b: distance(a, b))
    used = steps if closed else F.slice(steps, F.lit(1), n - 1)
    return F.aggregate(used, F.lit(0.0), lambda s, d: s + d)


def path_area(pts: Column) -> Column:
    turns = F.zip_with(pts, _next(pts), lambda a, b: a["x"] * b["y"] - a["y"] * b["x"])
    return F.abs(F.aggregate(turns, F.lit(0.0), lambda s, d: s + d)) / 2


def bounding_box(pts: Column) -> Column:
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.struct(
        F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"), F.array_min(xs).alias("x2"), F.array_min(ys).alias("y2")
    )


def polygon_center(pts: Column) -> Column:
    n = F.size(pts)
    total = lambda f: F.aggregate(pts, F.lit(0.0), lambda s, p: s + p[f])
    return point(total("x") / n, total("y") / n)


@bound
def polygon_circle(pts: Column) -> Column:
    """Circle about the mean point whose radius is the mean distance of the points."""
    c = polygon_center(pts)
    r = F.aggregate(pts, F.lit(0.0), lambda s, p: s + distance(p, c)) / F.size(pts)
    return F.struct(c["x"].alias("x"), c["y"].alias("y"), r.alias("r"))


@bound
def polygon_contains(pts: Column, p: Column) -> Column:
    """Even number of edge crossings to the right means outside; the edge counts as inside."""
    def crosses(a: Column, b: Column) -> Column:
        spans = (a["y"] > p["y"]) != (b["y"] > p["y"])
        x = a["x"] + (p["y"] - a["y"]) * (b["x"] - a["x"]) / F.when(spans, b["y"] - a["y"])
        return F.coalesce(spans & (p["x"] < x), F.lit(False))

    hits = F.size(F.filter(F.zip_with(pts, _next(pts), crosses), lambda h: h))
    on_edge = F.exists(F.zip_with(pts, _next(pts), lambda a, b: point_segment_distance(p, segment(a, b))), lambda d: d <= EPSILON)
    return (hits % 2 == 1) | on_edge


@bound
def polygons_overlap(a: Column, b: Column) -> Column:
    """Any edges meet, or one holds the other."""
    edges = lambda pts: F.zip_with(pts, _next(pts), segment)
    meet = F.exists(edges(a), lambda s: F.exists(edges(b), lambda t: segments_cross(s, t)))
    return meet | polygon_contains(a, F.get(b, F.lit(0))) | polygon_contains(b, F.get(a, F.lit(0)))


@bound
def same_polygon(a: Column, b: Column) -> Column:
    """Equal point cycles, in either direction and from any start."""
    n = F.size(a)

    def matches(shift: Column, forward: bool) -> Column:
        at = lambda i: F.get(b, F.pmod(shift + i if forward else shift - i, n))
        return F.forall(F.sequence(F.lit(0), n - 1), lambda i: same_point(F.get(a, i), at(i)))

    return (n == F.size(b)) & F.exists(F.sequence(F.lit(0), n - 1), lambda k: matches(k, True) | matches(k, False))


# -- circles and conversions ---------------------------------------------------


def circle(center: Column, r: Column) -> Column:
    return F.struct(center["x"].alias("x"), center["y"].alias("y"), r.cast("double").alias("r"))


def circle_area(c: Column) -> Column:
    return F.pi() * c["r"] * c["r"]


def circle_contains_point(c: Column, p: Column) -> Column:
    return distance(c, p) <= c["r"]


def circle_contains(a: Column, b: Column) -> Column:
    return _le(distance(a, b), a["r"] - b["r"])


def circles_overlap(a: Column, b: Column) -> Column:
    return _le(distance(a, b), a["r"] + b["r"])


def circle_distance(a: Column, b: Column) -> Column:
    return F.greatest(distance(a, b) - (a["r"] + b["r"]), F.lit(0.0))


def box_to_circle(b: Column) -> Column:
    c = box_center(b)
    return circle(c, distance(c, point(b["x1"], b["y1"])))


def circle_to_box(c: Column) -> Column:
    d = c["r"] / F.sqrt(F.lit(2.0))
    return box(point(c["x"] - d, c["y"] - d), point(c["x"] + d, c["y"] + d))


def box_to_polygon(b: Column) -> Column:
    return F.array(point(b["x2"], b["y2"]), point(b["x2"], b["y1"]), point(b["x1"], b["y1"]), point(b["x1"], b["y2"]))


def circle_to_polygon(c: Column, n: int) -> Column:
    def corner(i: Column) -> Column:
        turn = i * (2 * F.pi() / n)
        return point(c["x"] - c["r"] * F.cos(turn), c["y"] + c["r"] * F.sin(turn))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), corner)


# -- sphere and n dimensions ---------------------------------------------------


def ll_to_earth(lat: Column, lon: Column) -> Column:
    la, lo = F.radians(lat), F.radians(lon)
    r = F.lit(EARTH_RADIUS_M)
    return F.array(r * F.cos(la) * F.cos(lo), r * F.cos(la) * F.sin(lo), r * F.sin(la))


def earth_distance(a: Column, b: Column) -> Column:
    """Great-circle metres between two points of the sphere."""
    chord = euclidean(a, b) / (2 * EARTH_RADIUS_M)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(chord, F.lit(1.0)))


def lon_lat_miles(a: Column, b: Column) -> Column:
    """Great-circle miles between points with x = longitude and y = latitude."""
    la, lb = F.radians(a["y"]), F.radians(b["y"])
    apart = F.abs(F.radians(a["x"]) - F.radians(b["x"]))
    apart = F.when(apart > F.pi(), 2 * F.pi() - apart).otherwise(apart)
    h = F.sqrt(F.pow(F.sin(F.abs(la - lb) / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(F.sin(apart / 2), 2))
    return 2 * EARTH_RADIUS_MILES * F.asin(F.least(h, F.lit(1.0)))


def _fold(a: Column, b: Column, one) -> Column:
    return F.aggregate(F.zip_with(a, b, one), F.lit(0.0), lambda s, d: s + d)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def taxicab(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x.cast("double") - y))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)))


def cube(a: Column, b: Column) -> Column:
    """n-dimensional box from two corners."""
    return F.struct(F.zip_with(a, b, lambda x, y: F.least(x, y)).alias("lo"), F.zip_with(a, b, lambda x, y: F.greatest(x, y)).alias("hi"))


def cube_overlaps(a: Column, b: Column) -> Column:
    le = lambda p, q: F.forall(F.zip_with(p, q, lambda x, y: x <= y), lambda t: t)
    return le(a["lo"], b["hi"]) & le(b["lo"], a["hi"])


def cube_contains(a: Column, b: Column) -> Column:
    le = lambda p, q: F.forall(F.zip_with(p, q, lambda x, y: x <= y), lambda t: t)
    return le(a["lo"], b["lo"]) & le(b["hi"], a["hi"])


def cube_union(a: Column, b: Column) -> Column:
    return F.struct(
        F.zip_with(a["lo"], b["lo"], lambda x, y: F.least(x, y)).alias("lo"), F.zip_with(a["hi"], b["hi"], lambda x, y: F.greatest(x, y)).alias("hi")
    )


def cube_intersect(a: Column, b: Column) -> Column:
    return F.struct(
        F.zip_with(a["lo"], b["lo"], lambda x, y: F.greatest(x, y)).alias("lo"), F.zip_with(a["hi"], b["hi"], lambda x, y: F.least(x, y)).alias("hi")
    )


def cube_size(a: Column) -> Column:
    return F.aggregate(F.zip_with(a["hi"], a["lo"], lambda x, y: x - y), F.lit(1.0), lambda s, d: s * d)


def cube_enlarge(a: Column, r: float) -> Column:
    """Grow (or shrink to the middle) by ``r`` on every side."""
    mid = lambda x, y: (x + y) / 2
    lo = F.zip_with(a["lo"], a["hi"], lambda x, y: F.when(x - r <= y + r, x - r).otherwise(mid(x, y)))
    hi = F.zip_with(a["lo"], a["hi"], lambda x, y: F.when(x - r <= y + r, y + r).otherwise(mid(x, y)))
    return F.struct(lo.alias("lo"), hi.alias("hi"))


# -- float intervals -----------------------------------------------------------


def seg(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))


def seg_overlaps(a: Column, b: Column) -> Column:
    return (a["lo"] <= b["hi"]) & (b["lo"] <= a["hi"])


def seg_contains(a: Column, b: Column) -> Column:
    return (a["lo"] <= b["lo"]) & (b["hi"] <= a["hi"])


def seg_left(a: Column, b: Column) -> Column:
    return a["hi"] < b["lo"]


def seg_union(a: Column, b: Column) -> Column:
    return seg(F.least(a["lo"], b["lo"]), F.greatest(a["hi"], b["hi"]))


def seg_intersect(a: Column, b: Column) -> Column:
    return seg(F.greatest(a["lo"], b["lo"]), F.least(a["hi"], b["hi"]))


def seg_size(a: Column) -> Column:
    return a["hi"] - a["lo"]
