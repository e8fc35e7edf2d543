"""Web tiles and review tile grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.tilemath import alpha, tile_bounds, tile_x, tile_y
from sightline.operators.raster import resample_bilinear

MAX_REVIEW_TILES = 4096


def tile_cover(boxes: DataFrame, low_zoom: int = 8, high_zoom: int = 14) -> DataFrame:
    """Every ``(z, x, y)`` covering each box; other columns are kept."""
    zoomed = boxes.withColumn("z", F.explode(F.sequence(F.lit(low_zoom), F.lit(high_zoom))))
    z = F.col("z")
    # The rows of tiles are computed once a box and zoom, not once for every column of tiles.
    sided = zoomed.withColumn("_y", F.struct(tile_y(F.col("north"), z).alias("low"), tile_y(F.col("south"), z).alias("high")))
    rows = sided.withColumn("x", F.explode(F.sequence(tile_x(F.col("west"), z), tile_x(F.col("east"), z))))
    return rows.withColumn("y", F.explode(F.sequence(F.col("_y.low"), F.col("_y.high")))).drop("_y")


def tile_set(boxes: DataFrame, low_zoom: int = 8, high_zoom: int = 14) -> DataFrame:
    """The ``(z, x, y)`` covering any of the boxes, some more than once; equal boxes are covered once."""
    return tile_cover(boxes.select("west", "south", "east", "north").distinct(), low_zoom, high_zoom).select("z", "x", "y")


def tile_set_differences(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles missing from, or unexpected in, the actual set; empty when both agree."""
    def marked(df: DataFrame, want: bool) -> DataFrame:
        return df.select(*keys, F.lit(want).alias("_want"), F.lit(not want).alias("_have"))

    # One grouped pass over both sets; a set difference each way would make and shuffle each of them twice.
    sides = marked(expected, True).unionAll(marked(actual, False)).groupBy(*keys).agg(
        F.bool_or("_want").alias("_want"), F.bool_or("_have").alias("_have")
    )
    return sides.where(F.col("_want") != F.col("_have")).select(
        *keys, F.when(F.col("_want"), F.lit("missing")).otherwise(F.lit("unexpected")).alias("difference")
    )


def tile_grids(cover: DataFrame, tile_size: int = 256) -> DataFrame:
    """Pixel grid of each tile in Web Mercator metres."""
    b = tile_bounds(F.col("x"), F.col("y"), F.col("z"))
    return cover.withColumn("_b", b).select(
        *cover.columns, F.col("_b.left").alias("minx"), F.col("_b.top").alias("maxy"),
        ((F.col("_b.right") - F.col("_b.left")) / tile_size).alias("resolution"),
        F.lit(tile_size).alias("width"), F.lit(tile_size).alias("height"),
    )


def assemble_tiles(cover: DataFrame, source: DataFrame, source_grid: DataFrame, source_crs: str, tile_size: int = 256) -> DataFrame:
    """Resample one source band per role into the pixels of every tile.

    ``cover(role, z, x, y)``, ``source(role, row, col, value)``,
    ``source_grid(role, minx, maxy, resolution)``.  Source cells are shuffled once per
    role, not once per tile.
    """
    keys = ["role", "z", "x", "y"]
    grids = tile_grids(cover.select(*keys), tile_size)
    rows = grids.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(tile_size - 1))).alias("row"))
    cells = rows.repartition(*keys, "row").select(
        *keys, "row", F.explode(F.sequence(F.lit(0), F.lit(tile_size - 1))).alias("col")
    )
    return resample_bilinear(
        cells, grids, source, source_grid, "EPSG:3857", source_crs,
        keys=("role",), cell_keys=("z", "x", "y"),
    )


def tile_tallies(pixels: DataFrame) -> DataFrame:
    """Tiles per role, with transparency, and with imagery; ``pixels(role, z, x, y, r, g, b)``."""
    per_tile = pixels.groupBy("role", "z", "x", "y").agg(
        F.min(alpha(F.col("r"), F.col("g"), F.col("b"))).alias("lo"),
        F.max(alpha(F.col("r"), F.col("g"), F.col("b"))).alias("hi"),
    )
    return per_tile.groupBy("role", "z").agg(
        F.count(F.lit(1)).alias("tile_count"),
        F.count_if(F.col("lo") < 255).alias("tiles_with_transparency"),
        F.count_if(F.col("hi") > 0).alias("tiles_with_imagery"),
    )


def _axis_starts(length: Column, size: int, overlap: int) -> Column:
    last = F.greatest(length - size, F.lit(0))
    steps = F.sequence(F.lit(0), last, F.lit(size - overlap))
    return F.when(last == 0, F.array(F.lit(0))).otherwise(F.array_union(steps, F.array(last)))


def review_tiles(packets: DataFrame, size: int = 1024, overlap: int = 128) -> DataFrame:
    """Overlapping review tiles of each ``packets(packet_id, width, height)``, numbered row by row."""
    xs, ys = _axis_starts(F.col("width"), size, overlap), _axis_starts(F.col("height"), size, overlap)
    laid = packets.withColumn("_xs", xs).withColumn("_ys", ys)
    count = F.size("_xs") * F.size("_ys")
    checked = laid.withColumn(
        "_columns",
        F.when(count > MAX_REVIEW_TILES, F.raise_error(F.lit("labeling grid exceeds the tile limit"))).otherwise(F.size("_xs")),
    )
    tiles = checked.select("*", F.posexplode("_ys").alias("_r", "y")).select("*", F.posexplode("_xs").alias("_c", "x"))
    return tiles.select(
        "packet_id",
        F.concat(F.lit("T-"), F.format_string("%03d", F.col("_r") * F.col("_columns") + F.col("_c") + 1)).alias("tile_id"),
        (F.col("_r") + 1).alias("tile_row"), (F.col("_c") + 1).alias("tile_column"),
        "x", "y",
        F.least(F.lit(size), F.col("width") - F.col("x")).alias("w"),
        F.least(F.lit(size), F.col("height") - F.col("y")).alias("h"),
    )
