"""Labeling packet queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.geometry import close_ring, point
from sightline.operators import labeling
from sightline.operators.tiles import review_tiles as lay_tiles
from workload.registry import Inputs, query

SIZE, OVERLAP = 40, 8
_LAST = "greatest({n} - 40, 0)"
_STARTS = "(CASE WHEN {n} <= 40 THEN [0] ELSE list_sort(list_distinct(list_concat(range(0, {n} - 40 + 1, 32), [{n} - 40]))) END)"
_TILES = f"""
    SELECT packet_id, x, y, least(40, width - x) AS w, least(40, height - y) AS h,
           concat('T-', printf('%03d', row_number() OVER (PARTITION BY packet_id ORDER BY y, x))) AS tile_id
    FROM (SELECT packet_id, width, height, x, unnest(ys) AS y FROM (
          SELECT packet_id, width, height, unnest({_STARTS.format(n='width')}) AS x, {_STARTS.format(n='height')} AS ys FROM {{v_packet}}) a) b
"""


def tiles(t: Inputs) -> DataFrame:
    return lay_tiles(t.v_packet, SIZE, OVERLAP)


@query("review_tiles", f"SELECT packet_id, tile_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h FROM ({_TILES}) t")
def review_tiles(t: Inputs) -> DataFrame:
    return tiles(t).select("packet_id", "tile_id", *[F.col(c).cast("bigint").alias(c) for c in "xywh"])


# Reviews follow the tiles: one is missing, one unknown, some pending, some mistimed.
_N = "CAST(substr(tile_id, 3) AS BIGINT)"
_REVIEWS = """
    SELECT packet_id, CASE WHEN packet_id % 11 = 3 AND n = 2 THEN 'T-888' ELSE tile_id END AS tile_id,
           CASE WHEN n = 1 THEN CASE WHEN packet_id % 13 = 4 THEN 'reviewed-no-reference-region' ELSE 'regions-drawn' END
                WHEN packet_id % 5 = 0 AND n = 3 THEN '' WHEN packet_id % 17 = 6 AND n = 4 THEN 'regions-drawn' ELSE 'reviewed-no-reference-region' END AS decision,
           CASE WHEN packet_id % 5 = 0 AND n = 3 THEN NULL WHEN packet_id % 19 = 8 AND n = 2 THEN NULL ELSE 1 END AS saved_at
    FROM (SELECT *, CAST(substr(tile_id, 3) AS BIGINT) AS n FROM {tiles_here}) q WHERE NOT (packet_id % 7 = 2 AND n = 2)
"""
_REV = _REVIEWS.replace("{tiles_here}", f"({_TILES})")


def reviews(t: Inputs) -> DataFrame:
    return t.spark.sql(_REVIEWS.replace("{tiles_here}", "{laid}"), laid=tiles(t).select("packet_id", "tile_id"))


@query(
    "review_gaps",
    f"""WITH r AS ({_REV}), t AS ({_TILES}) SELECT packet_id, tile_id, 'tile review is missing' AS reason FROM t
        WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.packet_id = t.packet_id AND r.tile_id = t.tile_id)
        UNION ALL SELECT DISTINCT packet_id, tile_id, 'tile review is unknown' FROM r
        WHERE NOT EXISTS (SELECT 1 FROM t WHERE r.packet_id = t.packet_id AND r.tile_id = t.tile_id)""",
)
def review_gaps(t: Inputs) -> DataFrame:
    return labeling.missing_reviews(tiles(t), reviews(t))


def regions(t: Inputs) -> DataFrame:
    """Triangles with legs of three pixels; some are shifted, flat or elsewhere."""
    joined = t.v_region.join(t.v_packet.select("packet_id", "minx", "maxy", "resolution"), "packet_id")
    x, y, s, jump = F.col("px"), F.col("py"), F.col("side"), F.col("jump")
    pixel = lambda dx, dy: point(x + dx + jump, y + dy)
    ground = lambda dx, dy: point(F.col("minx") + 2 * (x + dx + jump), F.col("maxy") - 2 * (y + dy))
    zero = F.lit(0.0)
    corners = F.array(ground(zero, zero), ground(s, zero), ground(s, s))
    pixels = F.array(pixel(zero + F.col("nudge"), zero), pixel(s, zero), pixel(s, s))
    return joined.select(
        "packet_id", "tile_id", "region_id", "geometry_crs", corners.alias("points"), corners.alias("projected_points"),
        pixels.alias("pixel_points"), close_ring(corners).alias("ring"),
    )


# Tile T-001 starts at the origin and is 40 pixels wide and high at least.
_REGION_FAULT = """CASE WHEN tile_id = 'T-999' THEN 'region references an unknown tile'
    WHEN geometry_crs <> 'EPSG:32612' THEN 'region does not use the packet grid CRS'
    WHEN side = 0 THEN 'region has no measurable projected area' WHEN nudge > 0 THEN 'pixel coordinates are inconsistent'
    WHEN jump > 0 THEN 'region falls outside its declared tile' END"""


@query("region_placement", f"SELECT packet_id, region_id, tile_id, {_REGION_FAULT} AS reason FROM {{v_region}}")
def region_placement(t: Inputs) -> DataFrame:
    return labeling.region_faults(regions(t), tiles(t), t.v_packet)


def drafts(t: Inputs) -> DataFrame:
    where = point(F.col("minx") + 2 * (F.col("packet_id") % 60).cast("double"), F.col("maxy") - 2.0)
    return t.v_packet.select("packet_id", F.lit("T-001").alias("tile_id"), F.array(where).alias("points"))


@query(
    "draft_placement",
    """SELECT packet_id, 'T-001' AS tile_id, CASE WHEN packet_id % 60 > 40 THEN 'draft falls outside its declared tile' END AS reason
       FROM {v_packet}""",
)
def draft_placement(t: Inputs) -> DataFrame:
    return labeling.draft_faults(drafts(t), tiles(t), t.v_packet)


_COUNTS = f"""t AS ({_TILES}), r AS ({_REV}),
    n AS (SELECT p.packet_id, (SELECT count(*) FROM t WHERE t.packet_id = p.packet_id) AS total_tiles,
            (SELECT count(*) FROM r WHERE r.packet_id = p.packet_id AND decision <> '') AS reviewed_tiles,
            (SELECT count(*) FROM {{v_region}} g WHERE g.packet_id = p.packet_id) AS provisional_regions,
            CASE WHEN p.packet_id % 3 = 0 THEN 1 ELSE 0 END AS incomplete_drafts FROM {{v_packet}} p)"""


@query(
    "labeling_readiness",
    f"""WITH {_COUNTS} SELECT packet_id, total_tiles, reviewed_tiles, provisional_regions, CAST(incomplete_drafts AS BIGINT) AS incomplete_drafts,
        concat_ws(';', CASE WHEN reviewed_tiles <> total_tiles THEN concat('tile coverage is incomplete: ', CAST(reviewed_tiles AS STRING), '/', CAST(total_tiles AS STRING), ' reviewed') END,
          CASE WHEN incomplete_drafts > 0 THEN '1 incomplete labeling drafts remain' END) AS issues,
        reviewed_tiles = total_tiles AND incomplete_drafts = 0 AS ready_for_adjudication FROM n""",
)
def labeling_readiness(t: Inputs) -> DataFrame:
    out = labeling.readiness(tiles(t), reviews(t), regions(t), drafts(t).where("packet_id % 3 = 0"))
    return out.withColumn("issues", F.array_join("blocking_issues", ";")).drop("blocking_issues")


@query(
    "labeling_rules",
    f"""WITH {_COUNTS},
        drawn AS (SELECT packet_id, tile_id, count(*) AS n FROM {{v_region}} GROUP BY packet_id, tile_id)
        SELECT packet_id, 'export' AS subject, 'export does not match the manifest checksum' AS reason FROM {{v_packet}} WHERE packet_id % 6 = 1
        UNION ALL SELECT packet_id, 'export', 'export does not match the processing run' FROM {{v_packet}} WHERE packet_id % 10 = 1
        UNION ALL SELECT packet_id, 'export', 'reviewed tile count is inconsistent' FROM n WHERE reviewed_tiles <> total_tiles
        UNION ALL SELECT packet_id, 'export', 'coverage status is inconsistent' FROM n WHERE reviewed_tiles <> total_tiles
        UNION ALL SELECT packet_id, tile_id, 'tile review is missing' FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.packet_id = t.packet_id AND r.tile_id = t.tile_id)
        UNION ALL SELECT packet_id, tile_id, 'tile review is unknown' FROM r WHERE NOT EXISTS (SELECT 1 FROM t WHERE r.packet_id = t.packet_id AND r.tile_id = t.tile_id)
        UNION ALL SELECT packet_id, tile_id, 'reviewed tiles require saved_at' FROM r WHERE decision <> '' AND saved_at IS NULL
        UNION ALL SELECT r.packet_id, r.tile_id, 'tile is marked regions drawn but has no saved region' FROM r LEFT JOIN drawn d ON d.packet_id = r.packet_id AND d.tile_id = r.tile_id
          WHERE decision = 'regions-drawn' AND d.n IS NULL
        UNION ALL SELECT r.packet_id, r.tile_id, 'tile is marked no region but has saved regions' FROM r JOIN drawn d ON d.packet_id = r.packet_id AND d.tile_id = r.tile_id
          WHERE decision = 'reviewed-no-reference-region'
        UNION ALL SELECT packet_id, region_id, {_REGION_FAULT} AS reason FROM {{v_region}} WHERE ({_REGION_FAULT}) IS NOT NULL
        UNION ALL SELECT packet_id, 'T-001', 'draft falls outside its declared tile' FROM {{v_packet}} WHERE packet_id % 3 = 0 AND packet_id % 60 > 40
        UNION ALL SELECT packet_id, region_id, 'export contains duplicate region IDs' FROM {{v_region}} GROUP BY packet_id, region_id HAVING count(*) > 1""",
)
def labeling_rules(t: Inputs) -> DataFrame:
    laid = tiles(t)
    totals = laid.groupBy("packet_id").agg(F.count(F.lit(1)).alias("coverage_total"))
    exports = t.v_packet.join(totals, "packet_id").select(
        "packet_id",
        F.when(F.col("packet_id") % 10 == 1, "other").otherwise(F.col("processing_run_id")).alias("processing_run_id"),
        F.when(F.col("packet_id") % 6 == 1, "other").otherwise(F.col("manifest_sha256")).alias("manifest_sha256"),
        F.lit("complete").alias("coverage_status"), F.col("coverage_total").alias("coverage_reviewed"), "coverage_total",
    )
    return labeling.export_violations(t.v_packet, laid, exports, reviews(t), regions(t), drafts(t).where("packet_id % 3 = 0"))
