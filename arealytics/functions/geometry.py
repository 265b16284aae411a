"""Polygon and line measures on array columns: no explode and no shuffle.

A polygon feature is `array<array<array<struct<x,y>>>>`: parts, then rings (the first is the outer ring, the rest are
holes), then vertices. A line feature is `array<array<struct<x,y>>>`: parts, then vertices.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POLYGON_TYPE = "array<array<array<struct<x:double,y:double>>>>"
LINE_TYPE = "array<array<struct<x:double,y:double>>>"


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A one-part polygon with one closed, anticlockwise ring."""
    def at(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(F.array(at(x0, y0), at(x1, y0), at(x1, y1), at(x0, y1), at(x0, y0))))


def vertices(polygon: Column) -> Column:
    return F.flatten(F.flatten(polygon))


def once(value: Column, use) -> Column:
    """use(value) with the value made a single time, however often it is named: a lambda variable is not written out again in place."""
    return F.get(F.transform(F.array(value), use), 0)


def bounds(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
                    F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def ring_edges(ring: Column) -> Column:
    """The ring's edges with some length, closing it if its last vertex does not repeat the first."""
    n = F.size(ring)

    def edge(i):
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        return F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    all_edges = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), edge))
    return F.filter(all_edges, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))


def _ring_moments(ring: Column) -> Column:
    """Signed area and first moments of a ring, measured from its first vertex to keep digits."""
    x0, y0 = F.get(ring, 0)["x"], F.get(ring, 0)["y"]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(total, e):
        ax, ay, bx, by = e["x1"] - x0, e["y1"] - y0, e["x2"] - x0, e["y2"] - y0
        cross = ax * by - bx * ay
        return F.struct((total["a"] + cross / 2).alias("a"), (total["mx"] + (ax + bx) * cross / 6).alias("mx"),
                        (total["my"] + (ay + by) * cross / 6).alias("my"))

    return F.aggregate(ring_edges(ring), zero, add,
                       lambda t: F.struct(t["a"].alias("a"), (t["mx"] + t["a"] * x0).alias("mx"),
                                          (t["my"] + t["a"] * y0).alias("my")))


def ring_area(ring: Column) -> Column:
    """Signed area: positive when the ring runs anticlockwise. The same sum as in the moments, alone."""
    x0, y0 = F.get(ring, 0)["x"], F.get(ring, 0)["y"]
    return F.aggregate(ring_edges(ring), F.lit(0.0), lambda total, e: total + ((e["x1"] - x0) * (e["y2"] - y0) - (e["x2"] - x0) * (e["y1"] - y0)) / 2)


def _polygon_moments(polygon: Column) -> Column:
    # The ring sums are made first and bound to a lambda variable, so each ring is walked once.
    sums = F.transform(polygon, lambda part: F.transform(part, _ring_moments))

    def signed(m, i):
        # An outer ring adds and a hole takes away, whichever way the publisher drew it.
        sign = F.when(i == 0, F.sign(m["a"])).otherwise(-F.sign(m["a"]))
        return F.struct((m["a"] * sign).alias("a"), (m["mx"] * sign).alias("mx"), (m["my"] * sign).alias("my"))

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.aggregate(F.flatten(F.transform(sums, lambda part: F.transform(part, signed))), zero,
                       lambda t, m: F.struct((t["a"] + m["a"]).alias("a"), (t["mx"] + m["mx"]).alias("mx"),
                                             (t["my"] + m["my"]).alias("my")))


def polygon_area(polygon: Column) -> Column:
    # An outer ring adds and a hole takes away, as in the moments.
    sums = F.flatten(F.transform(polygon, lambda part: F.transform(F.transform(part, ring_area), lambda a, i: F.when(i == 0, a * F.sign(a)).otherwise(a * -F.sign(a)))))
    return F.aggregate(sums, F.lit(0.0), lambda total, a: total + a)


def polygon_centroid(polygon: Column) -> Column:
    m = _polygon_moments(polygon)
    return F.struct(F.try_divide(m["mx"], m["a"]).alias("x"), F.try_divide(m["my"], m["a"]).alias("y"))


def is_convex(polygon: Column) -> Column:
    """Is the polygon one ring that turns one way only and once round? Such a ring neither meets itself nor winds twice."""
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("least"), F.lit(0.0).alias("most"))

    def once_round(edges):
        def turn(e, i):
            after = F.get(edges, (i + 1) % F.size(edges))
            ax, ay, bx, by = e["x2"] - e["x1"], e["y2"] - e["y1"], after["x2"] - after["x1"], after["y2"] - after["y1"]
            return F.atan2(ax * by - ay * bx, ax * bx + ay * by)
        return F.aggregate(F.transform(edges, turn), zero, lambda t, a: F.struct(
            (t["total"] + a).alias("total"), F.least(t["least"], a).alias("least"), F.greatest(t["most"], a).alias("most")),
            lambda t: (F.abs(F.abs(t["total"]) - 2 * math.pi) < 1e-6) & ((t["least"] == 0) | (t["most"] == 0)) & (t["most"] - t["least"] < math.pi - 1e-6))
    # Rings and edges are bound to lambda variables, so each is made once.
    rings = F.transform(F.flatten(polygon), ring_edges)
    return F.coalesce((F.size(polygon) == 1) & (F.size(F.flatten(polygon)) == 1) & F.exists(rings, once_round), F.lit(False))


def polygon_is_empty(polygon: Column) -> Column:
    return polygon.isNull() | (F.size(vertices(polygon)) == 0)


def as_multipolygon(rings: Column) -> Column:
    """Promote one polygon's rings to a one-part polygon feature."""
    return F.when(rings.isNotNull(), F.array(rings))


def map_vertices(polygon: Column, change) -> Column:
    """Apply `change(x, y) -> struct<x,y>` to every vertex."""
    return F.transform(polygon, lambda part: F.transform(part, lambda ring: F.transform(
        ring, lambda p: change(p["x"], p["y"]))))


def snap_polygon(polygon: Column, size: float) -> Column:
    """Move every vertex to a grid and drop vertices that repeat the one before; rings left with under four vertices go."""
    def snap_ring(ring):
        moved = F.transform(ring, lambda p: F.struct((F.round(p["x"] / size) * size).alias("x"),
                                                     (F.round(p["y"] / size) * size).alias("y")))
        return F.filter(moved, lambda p, i: (i == 0) | (p != F.get(moved, i - 1)))

    def snap_part(part):
        return F.filter(F.transform(part, snap_ring), lambda ring: F.size(ring) >= 4)
    return F.filter(F.transform(polygon, snap_part), lambda part: F.size(part) > 0)
