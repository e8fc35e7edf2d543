"""Web-Mercator tile addresses and screen positions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.scalars import percent

MERCATOR_LIMIT = math.pi * 6378137.0
MAX_LATITUDE = 85.05112878


def _scale(zoom: Column) -> Column:
    return F.pow(F.lit(2.0), zoom)


def tile_x(lon: Column, zoom: Column) -> Column:
    return ((lon + 180) / 360 * _scale(zoom)).cast("bigint")


def tile_y(lat: Column, zoom: Column) -> Column:
    clamped = F.greatest(F.least(lat, F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE))
    return (
        (1 - F.asinh(F.tan(F.radians(clamped))) / math.pi) / 2 * _scale(zoom)
    ).cast("bigint")


def tile_bounds(x: Column, y: Column, zoom: Column) -> Column:
    span = F.lit(MERCATOR_LIMIT * 2) / _scale(zoom)
    left = F.lit(-MERCATOR_LIMIT) + x * span
    top = F.lit(MERCATOR_LIMIT) - y * span
    return F.struct(
        left.alias("left"), (top - span).alias("bottom"), (left + span).alias("right"),
        top.alias("top"),
    )


def screen_position(box: Column, grid: Column) -> Column:
    """Where a projected box sits on its grid, as clamped percentages."""
    width, height = grid["maxx"] - grid["minx"], grid["maxy"] - grid["miny"]
    return F.struct(
        percent((box["minx"] - grid["minx"]) / width).alias("left_percent"),
        percent((grid["maxy"] - box["maxy"]) / height).alias("top_percent"),
        percent((box["maxx"] - box["minx"]) / width).alias("width_percent"),
        percent((box["maxy"] - box["miny"]) / height).alias("height_percent"),
    )


def preview_value(scaled: Column, valid: Column) -> Column:
    """0 for invalid cells, otherwise 1-255."""
    clipped = F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0))
    return F.when(valid & scaled.isNotNull(), F.rint(clipped * 254 + 1)).otherwise(0).cast("smallint")


def overlay_rgb(after: Column, valid: Column, candidate: Column) -> Column:
    """Grey image with candidate cells tinted red."""
    grey = F.when(valid & after.isNotNull(), F.rint(after * 255)).otherwise(F.lit(0.0))
    tint = F.rint(grey * 0.35)
    return F.struct(
        F.when(candidate, F.lit(255.0)).otherwise(grey).cast("smallint").alias("r"),
        F.when(candidate, tint).otherwise(grey).cast("smallint").alias("g"),
        F.when(candidate, tint).otherwise(grey).cast("smallint").alias("b"),
    )


def alpha(r: Column, g: Column, b: Column) -> Column:
    return F.when((r != 0) | (g != 0) | (b != 0), 255).otherwise(0).cast("smallint")
