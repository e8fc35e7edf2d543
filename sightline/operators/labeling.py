"""Labeling packets and exports: containment, consistency and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import geometry as geo
from sightline.operators.contracts import stack
from sightline.operators.evaluation import duplicates

MIN_REGION_AREA = 0.5
KEYS = ["packet_id", "tile_id"]


def missing_reviews(tiles: DataFrame, reviews: DataFrame) -> DataFrame:
    """Tiles without a review and reviews of unknown tiles."""
    missing = tiles.select(*KEYS).join(reviews.select(*KEYS), KEYS, "left_anti")
    unknown = reviews.select(*KEYS).distinct().join(tiles.select(*KEYS), KEYS, "left_anti")
    return missing.withColumn("reason", F.lit("tile review is missing")).unionByName(
        unknown.withColumn("reason", F.lit("tile review is unknown"))
    )


def _pixels(points: Column) -> Column:
    return F.transform(
        points,
        lambda p: geo.projected_to_pixel(p["x"], p["y"], F.col("minx"), F.col("maxy"), F.col("resolution")),
    )


def _outside(points: Column) -> Column:
    return F.exists(points, lambda p: ~geo.pixel_in_tile(p, F.col("x"), F.col("y"), F.col("w"), F.col("h")))


def region_faults(regions: DataFrame, tiles: DataFrame, packets: DataFrame) -> DataFrame:
    """Every region with its first fault in ``reason`` (NULL when sound).

    ``regions(packet_id, region_id, tile_id, points, projected_points, pixel_points,
    ring, geometry_crs)``, ``packets(packet_id, crs, minx, maxy, resolution, …)``.
    """
    joined = regions.join(
        packets.select("packet_id", "crs", "minx", "maxy", "resolution"), "packet_id"
    ).join(tiles.select(*KEYS, "x", "y", "w", "h"), KEYS, "left")
    expected = _pixels(F.col("points"))
    far = F.exists(
        F.zip_with("pixel_points", expected, lambda a, b: geo.points_close(a, b)), lambda ok: ~ok
    )
    reason = (
        F.when(F.col("w").isNull(), "region references an unknown tile")
        .when(F.col("geometry_crs") != F.col("crs"), "region does not use the packet grid CRS")
        .when(F.col("points") != F.col("projected_points"), "projected points are inconsistent")
        .when(F.col("ring") != geo.close_ring(F.col("points")), "polygon ring is inconsistent")
        .when(F.size("pixel_points") != F.size("points"), "pixel point count is inconsistent")
        .when(geo.area(F.col("points")) < MIN_REGION_AREA, "region has no measurable projected area")
        .when(far, "pixel coordinates are inconsistent")
        .when(_outside(F.col("pixel_points")), "region falls outside its declared tile")
    )
    return joined.select("packet_id", "region_id", "tile_id", reason.alias("reason"))


def draft_faults(drafts: DataFrame, tiles: DataFrame, packets: DataFrame) -> DataFrame:
    joined = drafts.join(
        packets.select("packet_id", "minx", "maxy", "resolution"), "packet_id"
    ).join(tiles.select(*KEYS, "x", "y", "w", "h"), KEYS, "left")
    reason = F.when(F.col("w").isNull(), "draft is for an unknown tile").when(
        _outside(_pixels(F.col("points"))), "draft falls outside its declared tile"
    )
    return joined.select(*KEYS, reason.alias("reason"))


def packet_faults(packets: DataFrame, tiles: DataFrame) -> DataFrame:
    """Unusable grids, boxes outside the grid, packets without tiles."""
    grid = packets.where(
        ~F.coalesce(
            (F.col("width") > 0) & (F.col("height") > 0) & (F.col("resolution") > 0) & (F.col("crs") != ""),
            F.lit(False),
        )
    ).select("packet_id", F.col("packet_id").cast("string").alias("subject"), F.lit("packet grid is unusable").alias("reason"))
    placed = tiles.join(packets.select("packet_id", "width", "height"), "packet_id")
    off = placed.where(
        (F.col("x") < 0) | (F.col("y") < 0) | (F.col("w") <= 0) | (F.col("h") <= 0)
        | (F.col("x") + F.col("w") > F.col("width")) | (F.col("y") + F.col("h") > F.col("height"))
    ).select("packet_id", F.col("tile_id").alias("subject"), F.lit("tile is out of bounds").alias("reason"))
    bare = packets.join(tiles.select("packet_id"), "packet_id", "left_anti").select(
        "packet_id", F.col("packet_id").cast("string").alias("subject"), F.lit("packet requires at least one tile").alias("reason")
    )
    return stack(grid, off, bare)


def _tile_counts(tiles: DataFrame, reviews: DataFrame) -> DataFrame:
    total = tiles.groupBy("packet_id").agg(F.count(F.lit(1)).alias("total_tiles"))
    done = reviews.groupBy("packet_id").agg(F.count_if(F.col("decision") != "").alias("reviewed_tiles"))
    return total.join(done, "packet_id", "left").na.fill(0, ["reviewed_tiles"])


def export_violations(
    packets: DataFrame, tiles: DataFrame, exports: DataFrame, reviews: DataFrame,
    regions: DataFrame, drafts: DataFrame,
) -> DataFrame:
    """Every rule an export breaks ``(packet_id, subject, reason)``.

    ``exports(packet_id, processing_run_id, manifest_sha256, coverage_status,
    coverage_reviewed, coverage_total)``; ``packets`` holds the same identity columns.
    """
    identity = exports.join(
        packets.select("packet_id", F.col("processing_run_id").alias("_run"), F.col("manifest_sha256").alias("_sha")),
        "packet_id", "left",
    )
    counts = exports.join(_tile_counts(tiles, reviews), "packet_id")
    expected = F.when(F.col("reviewed_tiles") == F.col("total_tiles"), "complete").otherwise("partial")

    def rules(df: DataFrame, *pairs: tuple[Column, str]) -> DataFrame:
        reasons = F.array_compact(F.array(*[F.when(bad, text) for bad, text in pairs]))
        return df.select("packet_id", F.lit("export").alias("subject"), F.explode(reasons).alias("reason"))

    per_tile = regions.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_regions"))
    decided = reviews.join(per_tile, KEYS, "left").na.fill(0, ["_regions"])
    stamped = F.when((F.col("decision") != "") & F.col("saved_at").isNull(), "reviewed tiles require saved_at").when(
        (F.col("decision") == "") & F.col("saved_at").isNotNull(), "pending tiles cannot have saved_at"
    )
    consistent = F.when(
        (F.col("decision") == "regions-drawn") & (F.col("_regions") == 0),
        "tile is marked regions drawn but has no saved region",
    ).when(
        (F.col("decision") == "reviewed-no-reference-region") & (F.col("_regions") > 0),
        "tile is marked no region but has saved regions",
    )

    def named(df: DataFrame, subject: str) -> DataFrame:
        return df.where(F.col("reason").isNotNull()).select("packet_id", F.col(subject).alias("subject"), "reason")

    def twice(df: DataFrame, key: str, text: str) -> DataFrame:
        return duplicates(df, ["packet_id", key]).select("packet_id", F.col(key).alias("subject"), F.lit(text).alias("reason"))

    return stack(
        packet_faults(packets, tiles),
        rules(
            identity,
            (F.col("_run").isNull(), "export does not match the packet ID"),
            (F.col("_run") != F.col("processing_run_id"), "export does not match the processing run"),
            (F.col("_sha") != F.col("manifest_sha256"), "export does not match the manifest checksum"),
        ),
        rules(
            counts,
            (F.col("coverage_total") != F.col("total_tiles"), "total tile count is inconsistent"),
            (F.col("coverage_reviewed") != F.col("reviewed_tiles"), "reviewed tile count is inconsistent"),
            (F.col("coverage_status") != expected, "coverage status is inconsistent"),
        ),
        named(missing_reviews(tiles, reviews), "tile_id"),
        named(decided.withColumn("reason", stamped), "tile_id"),
        named(decided.withColumn("reason", consistent), "tile_id"),
        named(region_faults(regions, tiles, packets), "region_id"),
        named(draft_faults(drafts, tiles, packets), "tile_id"),
        twice(tiles, "tile_id", "packet contains duplicate tile IDs"),
        twice(reviews, "tile_id", "export contains duplicate tile reviews"),
        twice(regions, "region_id", "export contains duplicate region IDs"),
        twice(drafts, "tile_id", "export contains duplicate tile drafts"),
    )


def readiness(tiles: DataFrame, reviews: DataFrame, regions: DataFrame, drafts: DataFrame) -> DataFrame:
    """Reviewed share, open drafts, blocking issues and the ready flag of each packet."""
    count = lambda df, name: df.groupBy("packet_id").agg(F.count(F.lit(1)).alias(name))
    joined = (
        _tile_counts(tiles, reviews)
        .join(count(regions, "provisional_regions"), "packet_id", "left")
        .join(count(drafts, "incomplete_drafts"), "packet_id", "left")
        .na.fill(0, ["provisional_regions", "incomplete_drafts"])
    )
    issues = F.array_compact(
        F.array(
            F.when(
                F.col("reviewed_tiles") != F.col("total_tiles"),
                F.format_string("tile coverage is incomplete: %d/%d reviewed", "reviewed_tiles", "total_tiles"),
            ),
            F.when(
                F.col("incomplete_drafts") > 0,
                F.format_string("%d incomplete labeling drafts remain", "incomplete_drafts"),
            ),
        )
    )
    return joined.withColumn("blocking_issues", issues).withColumn(
        "ready_for_adjudication", F.size("blocking_issues") == 0
    )
