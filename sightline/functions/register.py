"""SQL names for the scalar functions, as inlined SQL functions."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

from sightline.functions.tilemath import MAX_LATITUDE, MERCATOR_LIMIT

_RING = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"

DEFINITIONS = {
    "tile_x": "(lon DOUBLE, zoom INT) RETURNS BIGINT RETURN CAST((lon + 180) / 360 * POW(2D, zoom) AS BIGINT)",
    "tile_y": (
        "(lat DOUBLE, zoom INT) RETURNS BIGINT RETURN CAST((1 - ASINH(TAN(RADIANS("
        f"GREATEST(LEAST(lat, {MAX_LATITUDE}D), -{MAX_LATITUDE}D)))) / {math.pi}D) / 2 * POW(2D, zoom) AS BIGINT)"
    ),
    "tile_left": (
        f"(x BIGINT, zoom INT) RETURNS DOUBLE RETURN -{MERCATOR_LIMIT}D + x * ({2 * MERCATOR_LIMIT}D / POW(2D, zoom))"
    ),
    "tile_top": (
        f"(y BIGINT, zoom INT) RETURNS DOUBLE RETURN {MERCATOR_LIMIT}D - y * ({2 * MERCATOR_LIMIT}D / POW(2D, zoom))"
    ),
    "ring_area": (
        f"(ring {_RING}) RETURNS DOUBLE RETURN ABS(AGGREGATE(ZIP_WITH(CONCAT(SLICE(ring, -1, 1), "
        "SLICE(ring, 1, GREATEST(SIZE(ring) - 1, 0))), ring, (a, b) -> a.x * b.y - b.x * a.y), "
        "0D, (s, v) -> s + v)) / 2"
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions; returns their names."""
    for name, body in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(DEFINITIONS)
