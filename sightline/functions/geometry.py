"""Planar geometry as Column expressions.

A ring is ``ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>``.  Everything stays inside the
JVM: rings are small arrays, so higher-order functions are enough.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INSIDE_TOLERANCE = 1e-12
PARALLEL_TOLERANCE = 1e-15
POINT_TOLERANCE = 0.001
RING_TYPE = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` names it or in what lambda."""
    return F.transform(F.array(value), use)[0]


def same_point(a: Column, b: Column) -> Column:
    return (a["x"] == b["x"]) & (a["y"] == b["y"])


def box_ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Closed counter-clockwise ring of a box."""
    return F.array(
        point(west, south), point(east, south), point(east, north), point(west, north),
        point(west, south),
    )


def box_intersects(
    lw: Column, ls: Column, le: Column, ln: Column,
    rw: Column, rs: Column, re: Column, rn: Column,
) -> Column:
    """Inclusive overlap of two boxes: touching edges count."""
    return (le >= rw) & (lw <= re) & (ln >= rs) & (ls <= rn)


def in_box(x: Column, y: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    return x.between(west, east) & y.between(south, north)


def _previous_points(ring: Column) -> Column:
    return F.concat(
        F.slice(ring, -1, 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
    )


def signed_area(ring: Column) -> Column:
    """Shoelace area; positive when counter-clockwise.  Open and closed rings agree."""
    cross = F.zip_with(
        _previous_points(ring), ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    )
    return F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v) / F.lit(2.0)


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def open_ring(ring: Column) -> Column:
    """Drop the closing point when the ring repeats its first point."""
    closed = (F.size(ring) > 1) & same_point(F.element_at(ring, 1), F.element_at(ring, -1))
    return F.when(closed, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def close_ring(ring: Column) -> Column:
    return F.concat(ring, F.slice(ring, 1, 1))


def outer_ring(rings: Column) -> Column:
    """Open outer ring of a polygon, or NULL when it is degenerate."""
    opened = open_ring(F.try_element_at(rings, F.lit(1)))
    return bound(opened, lambda ring: F.when((F.size(ring) >= 3) & (area(ring) != 0), ring))


def _line_crossing(s: Column, e: Column, cs: Column, ce: Column) -> Column:
    dx, dy = e["x"] - s["x"], e["y"] - s["y"]
    cdx, cdy = ce["x"] - cs["x"], ce["y"] - cs["y"]
    denominator = dx * cdy - dy * cdx
    t = F.try_divide((cs["x"] - s["x"]) * cdy - (cs["y"] - s["y"]) * cdx, denominator)
    return F.when(F.abs(denominator) < PARALLEL_TOLERANCE, point(e["x"], e["y"])).otherwise(
        point(s["x"] + t * dx, s["y"] + t * dy)
    )


def convex_intersection(subject: Column, clip: Column) -> Column:
    """Sutherland-Hodgman clip of one open convex ring by another, either orientation."""
    # Named in the lambda of the edges, the orientation would be computed anew for each of them.
    edges = bound(
        F.when(signed_area(clip) > 0, F.lit(1.0)).otherwise(F.lit(-1.0)),
        lambda orientation: F.zip_with(
            _previous_points(clip), clip,
            lambda a, b: F.struct(a.alias("s"), b.alias("e"), orientation.alias("o")),
        ),
    )

    def inside(p: Column, edge: Column) -> Column:
        s, e = edge["s"], edge["e"]
        side = (e["x"] - s["x"]) * (p["y"] - s["y"]) - (e["y"] - s["y"]) * (p["x"] - s["x"])
        return edge["o"] * side >= -INSIDE_TOLERANCE

    def kept(a: Column, b: Column, edge: Column) -> Column:
        # Only segments that cross the edge have their crossing computed.
        crossing = _line_crossing(a["p"], b["p"], edge["s"], edge["e"])
        return (
            F.when(b["in"] & ~a["in"], F.array(crossing, b["p"]))
            .when(b["in"], F.array(b["p"]))
            .when(a["in"], F.array(crossing))
            .otherwise(F.slice(F.array(b["p"]), 1, 0))
        )

    def cut(polygon: Column, edge: Column) -> Column:
        marked = F.transform(polygon, lambda p: F.struct(p.alias("p"), inside(p, edge).alias("in")))
        return bound(marked, lambda m: F.flatten(F.zip_with(_previous_points(m), m, lambda a, b: kept(a, b, edge))))

    return F.aggregate(edges, subject.cast(RING_TYPE), cut)


def ring_bounds(ring: Column) -> Column:
    xs = F.transform(ring, lambda p: p["x"])
    ys = F.transform(ring, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("west"), F.array_min(ys).alias("south"),
        F.array_max(xs).alias("east"), F.array_max(ys).alias("north"),
    )


def ring_overlaps_box(ring: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    b = ring_bounds(ring)
    return box_intersects(b["west"], b["south"], b["east"], b["north"], west, south, east, north)


def simplify_ring(ring: Column, maximum_points: int = 500) -> Column:
    """Keep every k-th point when the ring is longer than ``maximum_points``; close it."""

    def closed(thinned: Column) -> Column:
        meets = same_point(F.element_at(thinned, 1), F.element_at(thinned, -1))
        return F.when(meets, thinned).otherwise(close_ring(thinned))

    def thinned(unclosed: Column) -> Column:
        # The step is counted once for a ring, not once for a point: that would be quadratic in the ring.
        stride = F.ceil(F.size(unclosed) / F.lit(float(maximum_points - 1))).cast("int")
        return bound(stride, lambda n: bound(F.filter(unclosed, lambda p, i: i % n == 0), closed))

    return bound(ring, lambda r: F.when(F.size(r) <= maximum_points, r).otherwise(bound(open_ring(r), thinned)))


def focus_point(ring: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Centre of the envelope of the ring points inside the box; NULL when none is."""
    inside = F.filter(ring, lambda p: in_box(p["x"], p["y"], west, south, east, north))
    b = ring_bounds(inside)
    return F.when(
        F.size(inside) > 0,
        point(
            F.bround((b["west"] + b["east"]) / 2, 6), F.bround((b["south"] + b["north"]) / 2, 6)
        ),
    )


def box_around(lat: Column, lon: Column, offset: float = 0.075) -> Column:
    """Box of +-offset degrees around a point, clamped to the globe, six decimals."""
    return F.struct(
        F.bround(F.greatest(F.lit(-180.0), lon - offset), 6).alias("west"),
        F.bround(F.greatest(F.lit(-90.0), lat - offset), 6).alias("south"),
        F.bround(F.least(F.lit(180.0), lon + offset), 6).alias("east"),
        F.bround(F.least(F.lit(90.0), lat + offset), 6).alias("north"),
    )


def projected_to_pixel(x: Column, y: Column, minx: Column, maxy: Column, resolution: Column) -> Column:
    return point((x - minx) / resolution, (maxy - y) / resolution)


def pixel_in_tile(p: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    return p["x"].between(x, x + w) & p["y"].between(y, y + h)


def points_close(a: Column, b: Column) -> Column:
    return (F.abs(a["x"] - b["x"]) <= POINT_TOLERANCE) & (F.abs(a["y"] - b["y"]) <= POINT_TOLERANCE)


def valid_rings(rings: Column) -> Column:
    """1-5 closed rings of at least four WGS84 points, at most 100 points together."""
    total = F.aggregate(F.transform(rings, F.size), F.lit(0), lambda a, n: a + n)
    return F.coalesce(
        F.size(rings).between(1, 5)
        & F.forall(
            rings,
            lambda r: (F.size(r) >= 4)
            & same_point(F.try_element_at(r, F.lit(1)), F.try_element_at(r, F.lit(-1)))
            & F.forall(r, lambda p: p["x"].between(-180, 180) & p["y"].between(-90, 90)),
        )
        & (total <= 100),
        F.lit(False),
    )


def valid_box(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.coalesce(
        (west >= -180) & (west < east) & (east <= 180)
        & (south >= -90) & (south < north) & (north <= 90),
        F.lit(False),
    )


def drop_altitude(rings: Column) -> Column:
    """``ARRAY<ARRAY<ARRAY<DOUBLE>>>`` positions to x/y rings; NULL when a position is short."""
    ok = F.forall(rings, lambda r: F.forall(r, lambda p: F.size(p) >= 2))
    flat = F.transform(
        rings,
        lambda r: F.transform(
            r, lambda p: point(F.try_element_at(p, F.lit(1)), F.try_element_at(p, F.lit(2)))
        ),
    )
    return F.when(ok, flat)
