"""Closed-form coordinate transforms: Web Mercator and UTM (Krueger series) on WGS84."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid and UTM scale: fixed values.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING_SOUTH = 10000000.0

_N = FLATTENING / (2 - FLATTENING)
_RECTIFYING = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ECC = 2 * math.sqrt(_N) / (1 + _N)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def lonlat_to_mercator(lon: Column, lat: Column) -> Column:
    return F.struct(
        (F.radians(lon) * SEMI_MAJOR).alias("x"),
        (F.asinh(F.tan(F.radians(lat))) * SEMI_MAJOR).alias("y"),
    )


def mercator_to_lonlat(x: Column, y: Column) -> Column:
    return F.struct(
        F.degrees(x / SEMI_MAJOR).alias("x"),
        F.degrees(F.atan(F.sinh(y / SEMI_MAJOR))).alias("y"),
    )


def _zone(epsg: int) -> tuple[float, float]:
    """Central meridian (degrees) and false northing of a UTM code."""
    if 32601 <= epsg <= 32660:
        return (epsg - 32600) * 6 - 183.0, 0.0
    if 32701 <= epsg <= 32760:
        return (epsg - 32700) * 6 - 183.0, FALSE_NORTHING_SOUTH
    raise ValueError(f"unsupported projection EPSG:{epsg}")


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, as a lambda variable."""
    return F.get(F.transform(F.array(value), then), 0)


def lonlat_to_utm(lon: Column, lat: Column, epsg: int | Column) -> Column:
    meridian, false_northing = _zone_columns(epsg) if isinstance(epsg, Column) else _zone(epsg)
    phi, lam = F.radians(lat), F.radians(lon - meridian)
    conformal = F.struct(F.sinh(F.atanh(F.sin(phi)) - _ECC * F.atanh(_ECC * F.sin(phi))).alias("t"), lam.alias("lam"))

    def angles(p: Column) -> Column:
        return F.struct(
            F.atan2(p["t"], F.cos(p["lam"])).alias("xi"), F.atanh(F.sin(p["lam"]) / F.sqrt(1 + p["t"] * p["t"])).alias("eta")
        )

    def placed(p: Column) -> Column:
        east, north = p["eta"], p["xi"]
        for j, a in enumerate(_ALPHA, start=1):
            east = east + a * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"])
            north = north + a * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"])
        return F.struct(
            (FALSE_EASTING + UTM_SCALE * _RECTIFYING * east).alias("x"),
            (false_northing + UTM_SCALE * _RECTIFYING * north).alias("y"),
        )

    return _let(_let(conformal, angles), placed)


def utm_to_lonlat(x: Column, y: Column, epsg: int | Column) -> Column:
    meridian, false_northing = _zone_columns(epsg) if isinstance(epsg, Column) else _zone(epsg)
    given = F.struct(
        ((y - false_northing) / (UTM_SCALE * _RECTIFYING)).alias("xi"), ((x - FALSE_EASTING) / (UTM_SCALE * _RECTIFYING)).alias("eta")
    )

    def angles(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        for j, b in enumerate(_BETA, start=1):
            xi = xi - b * F.sin(2 * j * p["xi"]) * F.cosh(2 * j * p["eta"])
            eta = eta - b * F.cos(2 * j * p["xi"]) * F.sinh(2 * j * p["eta"])
        return F.struct(xi.alias("xi"), eta.alias("eta"))

    def conformal(p: Column) -> Column:
        return F.struct(
            F.asin(F.sin(p["xi"]) / F.cosh(p["eta"])).alias("chi"), F.atan2(F.sinh(p["eta"]), F.cos(p["xi"])).alias("lam")
        )

    def placed(p: Column) -> Column:
        phi = p["chi"]
        for j, d in enumerate(_DELTA, start=1):
            phi = phi + d * F.sin(2 * j * p["chi"])
        return F.struct((meridian + F.degrees(p["lam"])).alias("x"), F.degrees(phi).alias("y"))

    return _let(_let(_let(given, angles), conformal), placed)


def project(x: Column, y: Column, source: str, target: str) -> Column:
    """Point transform between EPSG:4326, EPSG:3857 and the UTM zones."""
    if source == target:
        return F.struct(x.alias("x"), y.alias("y"))
    if source != "EPSG:4326":
        code = int(source.split(":")[1])
        lonlat = mercator_to_lonlat(x, y) if code == 3857 else utm_to_lonlat(x, y, code)
        if target == "EPSG:4326":
            return lonlat
        return project(lonlat["x"], lonlat["y"], "EPSG:4326", target)
    code = int(target.split(":")[1])
    return lonlat_to_mercator(x, y) if code == 3857 else lonlat_to_utm(x, y, code)


def _zone_columns(code: Column) -> tuple[Column, Column]:
    """Central meridian and false northing of UTM codes 326zz and 327zz in a column."""
    zone = code % 100
    return (zone * 6 - 183).cast("double"), F.when(code >= 32700, F.lit(10_000_000.0)).otherwise(F.lit(0.0))


def project_by(x: Column, y: Column, source: Column, target: Column) -> Column:
    """``project`` between systems that differ by row; NULL where one is not supported."""
    def code(name: Column) -> Column:
        return F.regexp_extract(name, r"^EPSG:(\d+)$", 1).try_cast("int")

    def is_utm(epsg: Column) -> Column:
        return (epsg % 100).between(1, 60) & F.floor(epsg / 100).isin(326, 327)

    given, wanted = code(source), code(target)
    same = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    lonlat = (
        F.when(given == 4326, same).when(given == 3857, mercator_to_lonlat(x, y))
        .when(is_utm(given), utm_to_lonlat(x, y, given))
    )

    def onward(p: Column) -> Column:
        return (
            F.when(wanted == 4326, p).when(wanted == 3857, lonlat_to_mercator(p["x"], p["y"]))
            .when(is_utm(wanted), lonlat_to_utm(p["x"], p["y"], wanted))
        )

    return F.when(source == target, same).otherwise(_let(lonlat, onward))


def project_ring(ring: Column, source: str, target: str) -> Column:
    return F.transform(ring, lambda p: project(p["x"], p["y"], source, target))


def project_box(
    west: Column, south: Column, east: Column, north: Column, source: str, target: str,
    points_per_edge: int = 21,
) -> Column:
    """Envelope of a box after transform, with points added along every edge."""
    steps = F.array(*[F.lit(i / float(points_per_edge + 1)) for i in range(points_per_edge + 2)])
    edge = F.concat(
        F.transform(steps, lambda t: F.struct((west + (east - west) * t).alias("x"), south.alias("y"))),
        F.transform(steps, lambda t: F.struct((west + (east - west) * t).alias("x"), north.alias("y"))),
        F.transform(steps, lambda t: F.struct(west.alias("x"), (south + (north - south) * t).alias("y"))),
        F.transform(steps, lambda t: F.struct(east.alias("x"), (south + (north - south) * t).alias("y"))),
    )

    def envelope(moved: Column) -> Column:
        xs, ys = F.transform(moved, lambda p: p["x"]), F.transform(moved, lambda p: p["y"])
        return F.struct(
            F.array_min(xs).alias("west"), F.array_min(ys).alias("south"),
            F.array_max(xs).alias("east"), F.array_max(ys).alias("north"),
        )

    # The points are moved once, not once for every side of the envelope.
    return _let(project_ring(edge, source, target), envelope)
