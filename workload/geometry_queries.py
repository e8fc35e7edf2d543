"""Geometry, projection, tile and place queries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions import geometry as geo
from sightline.functions import projection, tilemath
from sightline.operators import places, tiles
from sightline.sources.catalog import resolve_link
from workload.catalog_queries import footprinted
from workload.registry import Inputs, query

R6 = lambda c: F.bround(c, 6)


@query(
    "ring_measures",
    """SELECT item_id, round_even((east - west) * (north - south), 6) AS ring_area, round_even(west, 6) AS west,
       round_even(north, 6) AS north, NOT (east < -110e0 OR west > -100e0 OR north < 22e0 OR south > 30e0) AS touches FROM {v_item}""",
)
def ring_measures(t: Inputs) -> DataFrame:
    ring = F.col("footprint")[0]
    b = geo.ring_bounds(ring)
    box = [F.lit(v) for v in (-110.0, 22.0, -100.0, 30.0)]
    return footprinted(t.v_item).select(
        "item_id", R6(geo.area(ring)).alias("ring_area"), R6(b["west"]).alias("west"), R6(b["north"]).alias("north"),
        geo.ring_overlaps_box(ring, *box).alias("touches"),
    )


@query(
    "ring_validity",
    """SELECT item_id, k % 5 <> 0 AND k % 7 <> 0 AND k % 11 <> 0 AND k % 13 <> 0 AS valid_footprint,
       k % 3 <> 0 AS valid_extent FROM {v_item}""",
)
def ring_validity(t: Inputs) -> DataFrame:
    k, ring = F.col("k"), F.col("footprint")[0]
    broken = (
        F.when(k % 5 == 0, F.array(geo.open_ring(ring)))  # not closed
        .when(k % 7 == 0, F.array(F.slice(ring, 1, 3)))  # too few points
        .when(k % 11 == 0, F.array_repeat(ring, 6))  # too many rings
        .when(k % 13 == 0, F.array(F.transform(ring, lambda p: geo.point(p["x"] - 360, p["y"]))))  # off the globe
        .otherwise(F.array(ring))
    )
    west = F.when(k % 3 == 0, F.col("east")).otherwise(F.col("west"))
    return footprinted(t.v_item).select(
        "item_id", geo.valid_rings(broken).alias("valid_footprint"),
        geo.valid_box(west, F.col("south"), F.col("east"), F.col("north")).alias("valid_extent"),
    )


@query("footprint_positions", "SELECT item_id, k % 8 <> 0 AS usable, CASE WHEN k % 8 <> 0 THEN 5 END AS points FROM {v_item}")
def footprint_positions(t: Inputs) -> DataFrame:
    spots = F.transform(
        F.col("footprint")[0],
        lambda p: F.when(F.col("k") % 8 == 0, F.array(p["x"])).otherwise(F.array(p["x"], p["y"], F.lit(12.5))),
    )
    flat = geo.drop_altitude(F.array(spots))
    return footprinted(t.v_item).select(
        "item_id", flat.isNotNull().alias("usable"), F.when(flat.isNotNull(), F.size(flat[0])).alias("points")
    )


def _long_rings(t: Inputs) -> DataFrame:
    """Closed rings of 600 to 1199 points around each supplier's site."""
    n = F.col("s_suppkey") % 600 + 600
    ring = F.transform(
        F.sequence(F.lit(0), n.cast("int")),
        lambda i: geo.point(F.cos(i * 2 * math.pi / n) * 2 + 85, F.sin(i * 2 * math.pi / n) + 28),
    )
    closed = F.concat(F.slice(ring, 1, n.cast("int")), F.slice(ring, 1, 1))
    return t.supplier.select("s_suppkey", closed.alias("ring"))


@query(
    "simplified_rings",
    """SELECT s_suppkey, CAST(ceil((s_suppkey % 600 + 600) / ceil((s_suppkey % 600 + 600) / 499e0)) + 1 AS BIGINT) AS points
       FROM {supplier}""",
)
def simplified_rings(t: Inputs) -> DataFrame:
    return _long_rings(t).select("s_suppkey", F.size(geo.simplify_ring(F.col("ring"))).cast("bigint").alias("points"))


@query(
    "focus_points",
    """SELECT item_id, CASE WHEN k % 2 = 0 THEN round_even((west + east) / 2, 4) END AS x,
       CASE WHEN k % 2 = 0 THEN round_even(south, 4) END AS y FROM {v_item}""",
)
def focus_points(t: Inputs) -> DataFrame:
    half = (F.col("north") + F.col("south")) / 2
    top = F.when(F.col("k") % 2 == 0, half).otherwise(F.col("south") - 1)
    p = geo.focus_point(F.col("footprint")[0], F.col("west"), F.col("south") - 1, F.col("east"), top)
    return footprinted(t.v_item).select("item_id", F.bround(p["x"], 4).alias("x"), F.bround(p["y"], 4).alias("y"))


_R = 6378137.0


@query(
    "mercator_points",
    f"""SELECT item_id, round_even(radians(west) * {_R}e0, 4) AS x, round_even(asinh(tan(radians(south))) * {_R}e0, 4) AS y FROM {{v_item}}""",
)
def mercator_points(t: Inputs) -> DataFrame:
    p = projection.project(F.col("west"), F.col("south"), "EPSG:4326", "EPSG:3857")
    return t.v_item.select("item_id", F.bround(p["x"], 4).alias("x"), F.bround(p["y"], 4).alias("y"))


@query("utm_round_trip", "SELECT item_id, round_even(west, 6) AS west, round_even(south, 6) AS south FROM {v_item}")
def utm_round_trip(t: Inputs) -> DataFrame:
    """Longitude and latitude after a trip through their own UTM zone's metres."""
    near = F.lit(-111.0) + (F.col("west") + 111.0) / 10
    there = projection.project(near, F.col("south"), "EPSG:4326", "EPSG:32612")
    back = projection.project(F.col("p.x"), F.col("p.y"), "EPSG:32612", "EPSG:4326")
    moved = t.v_item.select("item_id", there.alias("p")).select("item_id", back.alias("q"))
    return moved.select("item_id", R6(-111.0 + (F.col("q.x") + 111.0) * 10).alias("west"), R6("q.y").alias("south"))


_TX = "CAST(trunc((({lon}) + 180) / 360 * pow(2, {z})) AS BIGINT)"
_TY = "CAST(trunc((1 - asinh(tan(radians(greatest(least({lat}, 85.05112878e0), -85.05112878e0)))) / pi()) / 2 * pow(2, {z})) AS BIGINT)"


def _tile(lon: str, lat: str, z: str) -> tuple[str, str]:
    return _TX.format(lon=lon, z=z), _TY.format(lat=lat, z=z)


_X, _Y = _tile("west", "north", "8 + k % 7")
_SPAN = f"(2 * {math.pi * _R!r}e0 / pow(2, 8 + k % 7))"


@query(
    "tile_addresses",
    f"""SELECT item_id, x, y, round_even(-{math.pi * _R!r}e0 + x * span, 4) AS tile_left, round_even({math.pi * _R!r}e0 - y * span, 4) AS tile_top
        FROM (SELECT item_id, {_X} AS x, {_Y} AS y, {_SPAN} AS span FROM {{v_item}}) q""",
)
def tile_addresses(t: Inputs) -> DataFrame:
    zoom = (8 + F.col("k") % 7).cast("int")
    addressed = t.v_item.select(
        "item_id", tilemath.tile_x(F.col("west"), zoom).alias("x"), tilemath.tile_y(F.col("north"), zoom).alias("y"),
        zoom.alias("z"),
    )
    b = tilemath.tile_bounds(F.col("x"), F.col("y"), F.col("z"))
    return addressed.select("item_id", "x", "y", F.bround(b["left"], 4).alias("tile_left"), F.bround(b["top"], 4).alias("tile_top"))


@query(
    "sql_functions",
    f"SELECT item_id, {_X} AS x, {_Y} AS y, round_even((east - west) * (north - south), 6) AS ring_area FROM {{v_item}}",
)
def sql_functions(t: Inputs) -> DataFrame:
    """The same addresses and areas through the registered SQL functions."""
    from sightline.functions.register import register

    register(t.spark)
    return footprinted(t.v_item).selectExpr(
        "item_id", "tile_x(west, CAST(8 + k % 7 AS INT)) AS x", "tile_y(north, CAST(8 + k % 7 AS INT)) AS y",
        "bround(ring_area(footprint[0]), 6) AS ring_area",
    )


_X0, _Y1 = _tile("west", "south", "z")
_X1, _Y0 = _tile("east", "north", "z")
_COVER = f"""
    SELECT item_id, z, x, unnest(range(y0, y1 + 1)) AS y FROM (
      SELECT item_id, z, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM (
        SELECT item_id, z, {_X0} AS x0, {_X1} AS x1, {_Y0} AS y0, {_Y1} AS y1
        FROM (SELECT *, unnest(range(8, 15)) AS z FROM {{v_item}}) a) b) c
"""


@query(
    "tile_cover",
    f"""SELECT item_id, z, count(*) AS tile_count, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, CAST(sum(x * y) AS BIGINT) AS xy_sum
        FROM ({_COVER}) c GROUP BY item_id, z""",
)
def tile_cover(t: Inputs) -> DataFrame:
    """The tiles of every item at all zooms, summed up per item and zoom."""
    x, y = F.col("x").cast("bigint"), F.col("y").cast("bigint")
    return tiles.tile_cover(t.v_item, 8, 14).groupBy("item_id", "z").agg(
        F.count(F.lit(1)).alias("tile_count"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"),
        F.sum(x * y).alias("xy_sum"),
    )


@query(
    "tile_set_differences",
    f"""WITH cover AS (SELECT DISTINCT z, x, y FROM ({_COVER}) c)
        SELECT z, x, y, 'missing' AS difference FROM cover WHERE (x + y) % 13 = 0
        UNION ALL SELECT z + 10, x, y, 'unexpected' FROM cover WHERE (x + y) % 17 = 0""",
)
def tile_set_differences(t: Inputs) -> DataFrame:
    expected = tiles.tile_set(t.v_item, 8, 14)
    actual = expected.where("(x + y) % 13 <> 0").unionAll(
        expected.where("(x + y) % 17 = 0").select(F.col("z") + 10, "x", "y")
    )
    return tiles.tile_set_differences(expected, actual, ["z", "x", "y"])


@query(
    "place_lookup",
    """SELECT query_id, label, CASE WHEN label IS NOT NULL THEN round_even(greatest(-180e0, lon - 0.075e0), 6) END AS west,
       CASE WHEN label IS NOT NULL THEN round_even(greatest(-90e0, lat - 0.075e0), 6) END AS south,
       CASE WHEN label IS NOT NULL THEN round_even(least(180e0, lon + 0.075e0), 6) END AS east,
       CASE WHEN label IS NOT NULL THEN round_even(least(90e0, lat + 0.075e0), 6) END AS north,
       CASE WHEN length(trim(query)) < 2 THEN 'Enter a place name between 2 and 120 characters.'
            WHEN label IS NULL THEN 'No place match was found.' END AS problem
       FROM {v_ask} q LEFT JOIN {v_place} p ON lower(trim(q.query)) = lower(p.name)""",
)
def place_lookup(t: Inputs) -> DataFrame:
    return places.resolve_places(t.v_ask, t.v_place).drop("query")


_POINTS = "SELECT k AS point_id, k % 4 AS case_id, west AS lon, south AS lat FROM {v_item}"
_COVERAGE = "SELECT CAST(r_regionkey AS BIGINT) AS case_id, -115e0 + r_regionkey AS west, 22e0 AS south, -100e0 AS east, 30e0 + r_regionkey AS north FROM {region}"


@query(
    "coverage_points",
    f"""SELECT point_id, p.case_id, lon BETWEEN west AND east AND lat BETWEEN south AND north AS inside
        FROM ({_POINTS}) p JOIN ({_COVERAGE}) c ON p.case_id = c.case_id""",
)
def coverage_points(t: Inputs) -> DataFrame:
    return places.inside_coverage(t.sql(_POINTS), t.sql(_COVERAGE)).select("point_id", "case_id", "inside")


# One area per customer, most a few degrees wide, some very wide, some outside all polygons.
_AREA_BOX = """SELECT CAST(c_custkey AS BIGINT) AS area_id, w AS west, s AS south, w + d AS east, s + d * 0.7e0 AS north FROM (
    SELECT c_custkey, -121e0 + 0.31e0 * CAST(c_custkey % 103 AS DOUBLE) AS w, 19e0 + 0.23e0 * CAST((c_custkey * 7) % 97 AS DOUBLE) AS s,
           CASE WHEN c_custkey % 50 = 0 THEN 20e0 ELSE 0.2e0 + 0.3e0 * CAST(c_custkey % 4 AS DOUBLE) END AS d FROM {customer}) x"""
_POLYGONS = "SELECT k AS polygon_id, west AS pw, south AS ps, east + 0.000001e0 * CAST(k % 100003 AS DOUBLE) AS pe, north AS pn FROM {v_item}"
_LARGEST = f"""SELECT area_id, polygon_id, area_rank FROM (
        SELECT a.area_id, polygon_id, row_number() OVER (PARTITION BY a.area_id ORDER BY (pe - pw) * (pn - ps) DESC, polygon_id) AS area_rank
        FROM ({_POLYGONS}) p JOIN ({_AREA_BOX}) a ON NOT (pe < west OR pw > east OR pn < south OR ps > north)) x WHERE area_rank <= 3"""


def _largest(t: Inputs) -> DataFrame:
    ring = geo.box_ring(F.col("pw"), F.col("ps"), F.col("pe"), F.col("pn"))
    return places.largest_areas(t.sql(_POLYGONS).select("polygon_id", ring.alias("ring")), t.sql(_AREA_BOX))


@query("largest_areas", _LARGEST)
def largest_areas(t: Inputs) -> DataFrame:
    return _largest(t).select("area_id", "polygon_id", "area_rank")


@query(
    "short_areas",
    f"""SELECT a.area_id, count(l.polygon_id) AS kept FROM ({_AREA_BOX}) a LEFT JOIN ({_LARGEST}) l ON l.area_id = a.area_id
        GROUP BY a.area_id HAVING count(l.polygon_id) < 3""",
)
def short_areas(t: Inputs) -> DataFrame:
    return places.short_areas(t.sql(_AREA_BOX), _largest(t))


@query(
    "resolved_links",
    """SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'https://a.example.org/x/item.json'
         WHEN page_id % 6 = 1 THEN 'https://a.example.org/x/y/item.json' WHEN page_id % 6 = 2 THEN 'https://a.example.org/root.json'
         WHEN page_id % 6 = 3 THEN 'https://b.example.org/z.json' END AS href FROM {pages}""",
)
def resolved_links(t: Inputs) -> DataFrame:
    case = F.col("page_id") % 6
    href = (
        F.when(case == 0, "../item.json").when(case == 1, " ./item.json").when(case == 2, "/root.json")
        .when(case == 3, "//b.example.org/z.json").when(case == 4, "ftp://c.example.org/q").otherwise("  ")
    )
    return t.pages.select("page_id", resolve_link(F.lit("https://a.example.org/x/y/catalog.json"), href).alias("href"))
