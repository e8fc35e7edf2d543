"""Raster algebra on pixel tables.

A raster is a table ``(run_id, role, row, col, value)`` with nodata as NULL; a pair
of aligned rasters is ``(run_id, row, col, before, after)`` holding every cell of
its grid.  Neighbourhood work is done in square blocks that carry a halo of
neighbouring cells: one shuffle on (run, block) serves every window pass of a chain,
and no task ever holds more than one block, however large one raster is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.scalars import broken, computed_once

from sightline.functions.projection import project, project_box
from sightline.operators.ranking import exact_percentiles
from sightline.session import small_side

MAX_PIXELS = 1_000_000_000
#: Cells along the side of a source block when resampling; a block's values travel as one array.
RESAMPLE_BLOCK = 64


@dataclass(frozen=True)
class ChangePolicy:
    """Scoring and clean-up parameters of one change run."""

    score_threshold: float = 0.5
    tolerance: int = 2
    opening: int = 1
    closing: int = 1
    connectivity: int = 8
    minimum_pixels: int = 512
    maximum_candidates: int = 500

    @property
    def reach(self) -> int:
        return self.tolerance + 2 * self.opening + 2 * self.closing


# --- grids and lattices -----------------------------------------------------------


def build_grids(runs: DataFrame, target_crs: str, resolution: float) -> DataFrame:
    """Snap each run's WGS84 box outward to whole cells of the target grid."""
    res = F.lit(float(resolution))
    b = project_box(
        F.col("west"), F.col("south"), F.col("east"), F.col("north"), "EPSG:4326", target_crs
    )
    snapped = runs.withColumn("_b", computed_once(b)).select(
        *runs.columns,
        (F.floor(F.col("_b.west") / res) * res).alias("minx"),
        (F.floor(F.col("_b.south") / res) * res).alias("miny"),
        (F.ceil(F.col("_b.east") / res) * res).alias("maxx"),
        (F.ceil(F.col("_b.north") / res) * res).alias("maxy"),
    )
    sized = (
        snapped.withColumn("crs", F.lit(target_crs)).withColumn("resolution", res)
        .withColumn("width", F.rint((F.col("maxx") - F.col("minx")) / res).cast("int"))
        .withColumn("height", F.rint((F.col("maxy") - F.col("miny")) / res).cast("int"))
    )
    return sized.withColumn(
        "problem",
        F.when(
            (F.col("width") <= 0) | (F.col("height") <= 0)
            | (F.col("width").cast("bigint") * F.col("height") > MAX_PIXELS),
            "declared processing grid is empty or exceeds pixel limit",
        ),
    )


def lattice(grids: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """All cells of each grid.  Rows are spread over tasks before columns are added."""
    rows = grids.select(*keys, "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"))
    spread = rows.repartition(*keys, "row")
    return spread.select(*keys, "row", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col"))


def pair_roles(pixels: DataFrame, grids: DataFrame | None = None) -> DataFrame:
    """Bring the before and after values of a cell into one row.

    With ``grids`` the result also holds the cells that no pixel row mentions.
    """
    rows = pixels.select("run_id", "row", "col", "role", "value")
    if grids is not None:
        rows = rows.unionByName(_blank_cells(grids))
    return _paired(rows, "run_id", "row", "col")


def _blank_cells(grids: DataFrame) -> DataFrame:
    return lattice(grids).select(
        "run_id", "row", "col", F.lit(None).cast("string").alias("role"), F.lit(None).cast("double").alias("value")
    )


def _paired(rows: DataFrame, *keys: str) -> DataFrame:
    clean = F.when(~F.isnan("value"), F.col("value").cast("double"))
    return rows.groupBy(*keys).agg(
        F.max(F.when(F.col("role") == "before", clean)).alias("before"),
        F.max(F.when(F.col("role") == "after", clean)).alias("after"),
    )


# --- polygons to pixels -----------------------------------------------------------


def ring_to_pixels(ring: Column, transform: Column) -> Column:
    """Ring points in (column, row) units of a six-number affine ``a,b,c,d,e,f``."""
    a, b, c, d, e, f = (transform[i] for i in range(6))
    det = a * e - b * d
    return F.transform(
        ring,
        lambda p: F.struct(
            ((e * (p["x"] - c) - b * (p["y"] - f)) / det).alias("x"),
            ((a * (p["y"] - f) - d * (p["x"] - c)) / det).alias("y"),
        ),
    )


def polygon_runs(polygons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scan-line fill: ``(keys, row, c0, c1)`` runs of cells whose centre is inside.

    ``polygons(keys…, rings, width, height)`` with ring points in pixel units; holes
    follow from the even-odd rule.  Each edge yields only the rows it crosses, so the
    work is the edge length, not the bounding box.
    """
    keys = list(keys)
    rings = polygons.select(*keys, "width", "height", F.explode("rings").alias("_ring"))
    edges = rings.select(
        *keys, "width", "height",
        F.explode(
            F.zip_with(
                F.concat(F.slice("_ring", -1, 1), F.slice("_ring", 1, F.greatest(F.size("_ring") - 1, F.lit(0)))),
                "_ring", lambda p, q: F.struct(p.alias("p"), q.alias("q")),
            )
        ).alias("_e"),
    )
    low, high = F.least("_e.p.y", "_e.q.y"), F.greatest("_e.p.y", "_e.q.y")
    first = F.greatest(F.ceil(low - 0.5), F.lit(0)).cast("int")
    last = F.least(F.ceil(high - 0.5) - 1, F.col("height") - 1).cast("int")
    hits = (
        edges.withColumn("_first", first).withColumn("_last", last).where("_last >= _first")
        .withColumn("row", F.explode(F.sequence("_first", "_last")))
        .select(
            *keys, "width", "row",
            (
                F.col("_e.p.x")
                + (F.col("row") + 0.5 - F.col("_e.p.y")) * (F.col("_e.q.x") - F.col("_e.p.x"))
                / (F.col("_e.q.y") - F.col("_e.p.y"))
            ).alias("_x"),
        )
    )
    spans = hits.groupBy(*keys, "row").agg(
        F.sort_array(F.collect_list("_x")).alias("_xs"), F.first("width").alias("width")
    )
    pairs = spans.select(
        *keys, "row", "width",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.floor(F.size("_xs") / 2).cast("int")),
                lambda i: F.struct(
                    F.element_at("_xs", (2 * i - 1).cast("int")).alias("lo"),
                    F.element_at("_xs", (2 * i).cast("int")).alias("hi"),
                ),
            )
        ).alias("_s"),
    )
    return pairs.select(
        *keys, "row",
        F.greatest(F.ceil(F.col("_s.lo") - 0.5), F.lit(0)).cast("int").alias("c0"),
        F.least(F.ceil(F.col("_s.hi") - 0.5) - 1, F.col("width") - 1).cast("int").alias("c1"),
    ).where("c1 >= c0")


def run_cells(runs: DataFrame) -> DataFrame:
    columns = [c for c in runs.columns if c not in ("c0", "c1")]
    return runs.select(*columns, F.explode(F.sequence("c0", "c1")).alias("col"))


def rasterize(polygons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells ``(keys, row, col)`` covered by each polygon."""
    return run_cells(polygon_runs(polygons, keys))


# --- resampling -------------------------------------------------------------------


def _source_blocks(source: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, _rb, _cb, _cells)``: values of square blocks, row by row, NULL where a cell has none.

    A block also holds the first row and column of the blocks below and right of it, so that the four
    cells around any place lie in the block of the upper left one.  A cell given twice counts with its
    greater value.
    """
    side = RESAMPLE_BLOCK + 1
    usable = source.where(F.col("value").isNotNull() & ~F.isnan("value"))
    inside = usable.select(
        *keys, F.col("value").cast("double").alias("_value"), F.floor(F.col("row") / RESAMPLE_BLOCK).alias("_rb"),
        F.floor(F.col("col") / RESAMPLE_BLOCK).alias("_cb"), F.pmod("row", F.lit(RESAMPLE_BLOCK)).cast("int").alias("_r"),
        F.pmod("col", F.lit(RESAMPLE_BLOCK)).cast("int").alias("_c"),
    )

    def held(up: int, left: int) -> Column:
        return F.struct(
            (F.col("_rb") - up).alias("rb"), (F.col("_cb") - left).alias("cb"),
            ((F.col("_r") + up * RESAMPLE_BLOCK) * side + F.col("_c") + left * RESAMPLE_BLOCK).alias("at"),
        )

    top, first = F.col("_r") == 0, F.col("_c") == 0
    places = (
        F.when(top & first, F.array(held(0, 0), held(1, 0), held(0, 1), held(1, 1)))
        .when(top, F.array(held(0, 0), held(1, 0))).when(first, F.array(held(0, 0), held(0, 1))).otherwise(F.array(held(0, 0)))
    )
    dealt = inside.select(*keys, "_value", F.explode(places).alias("_p")).select(
        *keys, F.col("_p.rb").alias("_rb"), F.col("_p.cb").alias("_cb"), F.struct(F.col("_p.at").alias("at"), F.col("_value").alias("v")).alias("_cell")
    )
    blocks = dealt.groupBy(*keys, "_rb", "_cb").agg(F.sort_array(F.collect_list("_cell")).alias("_list"))

    def filled(cell: Column, i: Column) -> Column:
        gap = F.array_repeat(F.lit(None).cast("double"), cell["at"] - F.coalesce(F.get("_list", i - 1)["at"], F.lit(-1)) - 1)
        again = F.get("_list", i + 1)["at"].eqNullSafe(cell["at"])
        return F.when(again, gap).otherwise(F.concat(gap, F.array(cell["v"])))

    return blocks.select(*keys, "_rb", "_cb", F.flatten(F.transform("_list", filled)).alias("_cells"))


def resample_bilinear(
    cells: DataFrame, grids: DataFrame, source: DataFrame, source_grids: DataFrame,
    target_crs: str, source_crs: str, keys: Sequence[str] = ("run_id",),
    cell_keys: Sequence[str] = (),
) -> DataFrame:
    """Value of every target cell from the four surrounding source cells.

    ``keys`` name the source raster; ``cell_keys`` tell apart several target grids that
    read the same source (the tiles of one image).

    ``grids``/``source_grids`` hold ``keys, minx, maxy, resolution``.  Nodata taps are
    left out and the other weights rescaled; a cell with no usable tap is NULL.

    A target cell goes once to the source block that its place falls into and reads its taps there;
    source cells are shuffled once, as blocks, whatever the number of target grids.
    """
    keys, both = list(keys), [*keys, *cell_keys]
    target = small_side(grids.select(*both, "minx", "maxy", "resolution"))
    src = small_side(
        source_grids.select(
            *keys, F.col("minx").alias("_sx"), F.col("maxy").alias("_sy"),
            F.col("resolution").alias("_sr"),
        )
    )
    placed = cells.join(target, both).join(src, keys)
    x = F.col("minx") + (F.col("col") + 0.5) * F.col("resolution")
    y = F.col("maxy") - (F.col("row") + 0.5) * F.col("resolution")
    placed = placed.withColumn("_p", project(x, y, target_crs, source_crs))
    placed = placed.select(
        *both, "row", "col",
        ((F.col("_p.x") - F.col("_sx")) / F.col("_sr") - 0.5).alias("_u"),
        ((F.col("_sy") - F.col("_p.y")) / F.col("_sr") - 0.5).alias("_v"),
    )
    block = {name: F.floor(F.floor(place) / RESAMPLE_BLOCK) for name, place in (("_rb", "_v"), ("_cb", "_u"))}
    met = placed.withColumns(block).join(_source_blocks(source, keys), [*keys, "_rb", "_cb"], "left")
    fu, fv = F.col("_u") - F.floor("_u"), F.col("_v") - F.floor("_v")
    upper_left = (F.floor("_v") - F.col("_rb") * RESAMPLE_BLOCK) * (RESAMPLE_BLOCK + 1) + F.floor("_u") - F.col("_cb") * RESAMPLE_BLOCK
    total, weights = F.lit(0.0), F.lit(0.0)
    for dr, dc in ((0, 0), (0, 1), (1, 0), (1, 1)):
        weight = (fv if dr else 1 - fv) * (fu if dc else 1 - fu)
        value = F.get("_cells", (upper_left + dr * (RESAMPLE_BLOCK + 1) + dc).cast("int"))
        total = total + F.coalesce(weight * value, F.lit(0.0))
        weights = weights + F.when(value.isNotNull(), weight).otherwise(0.0)
    return met.select(*both, "row", "col", F.try_divide(total, weights).alias("value"))


# --- quality ----------------------------------------------------------------------


def role_quality(pixels: DataFrame, lower: float = 2.0, upper: float = 98.0) -> DataFrame:
    """Per (run, role): valid count, extremes and the stretch percentiles."""
    clean = pixels.where(F.col("value").isNotNull() & ~F.isnan("value"))
    keys = ["run_id", "role"]
    basic = clean.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("valid_pixel_count"),
        F.min("value").cast("double").alias("value_min"),
        F.max("value").cast("double").alias("value_max"),
    )
    limits = exact_percentiles(
        clean, keys, "value",
        {"normalization_low": lower / 100.0, "normalization_high": upper / 100.0},
    )
    return basic.join(limits, keys)


def quality_violations(quality: DataFrame, aoi: DataFrame, min_valid_fraction: float = 0.99) -> DataFrame:
    """Roles whose coverage or stretch range is unusable; ``aoi(run_id, aoi_pixel_count)``."""
    joined = quality.join(aoi, "run_id").withColumn(
        "valid_fraction", F.col("valid_pixel_count") / F.col("aoi_pixel_count")
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("valid_fraction") < min_valid_fraction, "valid AOI coverage is below the minimum"),
            F.when(
                F.col("normalization_low") >= F.col("normalization_high"),
                "raster has no usable normalization range",
            ),
        )
    )
    return joined.select("run_id", "role", "valid_fraction", F.explode(reasons).alias("reason"))


def common_valid_fraction(paired: DataFrame, aoi: DataFrame) -> DataFrame:
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    counts = paired.groupBy("run_id").agg(F.count_if(both).alias("common_valid_pixel_count"))
    return counts.join(aoi, "run_id").withColumn(
        "common_valid_fraction",
        F.try_divide(F.col("common_valid_pixel_count").cast("double"), F.col("aoi_pixel_count").cast("double")),
    )


# --- stretch, score, clean --------------------------------------------------------


def stretch(value: Column, low: Column, high: Column) -> Column:
    """Percentile stretch to 0-1; nodata stays NULL, and a raster without a range becomes nodata."""
    scaled = F.try_divide(value - low, high - low)
    return F.when(scaled.isNotNull(), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))


def normalise_pair(paired: DataFrame, quality: DataFrame) -> DataFrame:
    limits = quality.groupBy("run_id").agg(
        *[
            F.max(F.when(F.col("role") == role, F.col(f"normalization_{end}"))).alias(f"_{role}_{end}")
            for role in ("before", "after")
            for end in ("low", "high")
        ]
    )
    joined = paired.join(small_side(limits), "run_id")
    return joined.select(
        "run_id", "row", "col",
        stretch(F.col("before"), F.col("_before_low"), F.col("_before_high")).alias("before"),
        stretch(F.col("after"), F.col("_after_low"), F.col("_after_high")).alias("after"),
    )


def in_blocks(cells: DataFrame, reach: int, size: int = 256) -> DataFrame:
    """Send every cell to its own block and to each block whose halo contains it."""
    def touched(axis: str) -> Column:
        first = F.greatest(F.floor((F.col(axis) - reach) / F.lit(size)), F.lit(0))
        return F.explode(F.sequence(first, F.floor((F.col(axis) + reach) / F.lit(size))))

    return (
        cells.withColumn("_br", touched("row")).withColumn("_bc", touched("col"))
        .repartition("run_id", "_br", "_bc")
    )


def _own_block(size: int) -> Column:
    return (F.floor(F.col("row") / size) == F.col("_br")) & (F.floor(F.col("col") / size) == F.col("_bc"))


def _along(axis: str):
    """Window walking one line of a block: ``row`` walks a row, ``col`` a column."""
    order = "col" if axis == "row" else "row"
    return Window.partitionBy("run_id", "_br", "_bc", axis).orderBy(order)


def _shifted(name: str, offset: int, window) -> Column:
    if offset == 0:
        return F.col(name)
    return F.lag(name, -offset).over(window) if offset < 0 else F.lead(name, offset).over(window)


def _spread(df: DataFrame, name: str, reach: int, axes: Sequence[str], grow: bool) -> DataFrame:
    """Square erosion or dilation of a boolean column, one line pass per axis."""
    if reach == 0:
        return df
    for axis in axes:
        window = _along(axis)
        combined = None
        for offset in range(-reach, reach + 1):
            near = F.coalesce(_shifted(name, offset, window), F.lit(False))
            combined = near if combined is None else (combined | near if grow else combined & near)
        df = df.withColumn(name, combined)
    return df


def score_cells(normalised: DataFrame, policy: ChangePolicy, size: int = 256) -> DataFrame:
    """Common-valid guard, symmetric neighbourhood score, threshold and clean-up.

    Input holds every grid cell.  Output adds ``common_valid``, ``score``,
    ``exceeds`` (threshold mask) and ``cleaned`` to each cell.
    """
    if policy.reach == 0:
        return _score(normalised, policy)
    return _score(in_blocks(normalised, policy.reach, size), policy).where(_own_block(size)).drop("_br", "_bc")


def score_pixels(
    pixels: DataFrame, quality: DataFrame, policy: ChangePolicy, grids: DataFrame | None = None, size: int = 256
) -> DataFrame:
    """``score_cells`` straight from role rows, with a single shuffle of the pixels.

    Values are stretched per row, sent to their blocks, and only there paired, scored
    and cleaned.  ``grids`` adds the cells no row mentions; leave it out when the pixel
    table already holds every cell.
    """
    limits = small_side(quality.select("run_id", "role", "normalization_low", "normalization_high"))
    clean = F.when(~F.isnan("value"), F.col("value").cast("double"))
    rows = pixels.join(limits, ["run_id", "role"]).select(
        "run_id", "row", "col", "role",
        stretch(clean, F.col("normalization_low"), F.col("normalization_high")).alias("value"),
    )
    if policy.reach == 0:
        return _score(pair_roles(rows, grids), policy)
    if grids is not None:
        rows = rows.unionByName(_blank_cells(grids))
    paired = _paired(in_blocks(rows, policy.reach, size), "run_id", "_br", "_bc", "row", "col")
    return _score(paired, policy).where(_own_block(size)).drop("_br", "_bc")


def _score(cells: DataFrame, policy: ChangePolicy) -> DataFrame:
    t, place = policy.tolerance, [c for c in ("_br", "_bc") if c in cells.columns]
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    cells = cells.withColumn("common_valid", both)
    if t == 0:
        scored = cells.withColumn("score", F.when(both, F.abs(F.col("after") - F.col("before"))))
    else:
        scored = _neighbourhood_score(cells, t)
    marked = scored.withColumn(
        "exceeds", F.coalesce(F.col("score") >= policy.score_threshold, F.lit(False))
    ).withColumn("cleaned", F.col("exceeds"))
    # Axes alternate so that neighbouring passes share a sort.
    marked = _spread(marked, "cleaned", policy.opening, ("col", "row"), grow=False)
    marked = _spread(marked, "cleaned", policy.opening + policy.closing, ("row", "col"), grow=True)
    marked = _spread(marked, "cleaned", policy.closing, ("col", "row"), grow=False)
    return marked.select(
        "run_id", *place, "row", "col", "before", "after", "common_valid", "score", "exceeds", "cleaned"
    )


def _neighbourhood_score(cells: DataFrame, t: int) -> DataFrame:
    """Greater of the two one-way minimum differences inside a (2t+1) square."""
    offsets = range(-t, t + 1)
    line = _along("row")
    wide = cells.select(
        "*",
        *[
            _shifted(name, o, line).alias(f"_{name}_{o + t}")
            for name in ("before", "after") for o in offsets if o != 0
        ],
        F.least(*[F.coalesce(_shifted("common_valid", o, line), F.lit(False)) for o in offsets]).alias("_line"),
    ).withColumns({f"_before_{t}": F.col("before"), f"_after_{t}": F.col("after")})
    column = _along("col")

    def one_way(centre: str, other: str) -> Column:
        return F.least(
            *[
                F.abs(F.col(centre) - _shifted(f"_{other}_{o + t}", r, column))
                for r in offsets for o in offsets
            ]
        )

    guarded = wide.select(
        "run_id", "_br", "_bc", "row", "col", "before", "after",
        F.least(*[F.coalesce(_shifted("_line", r, column), F.lit(False)) for r in offsets]).alias("common_valid"),
        one_way("after", "before").alias("_forward"),
        one_way("before", "after").alias("_reverse"),
    )
    return guarded.withColumn(
        "score", F.when(F.col("common_valid"), F.greatest("_forward", "_reverse"))
    ).drop("_forward", "_reverse")


def eroded_valid(paired: DataFrame, iterations: int, size: int = 256) -> DataFrame:
    """Common-valid mask after ``iterations`` 3x3 erosions; beyond the edge is invalid."""
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    cells = in_blocks(paired.select("run_id", "row", "col", both.alias("common_valid")), iterations, size)
    out = _spread(cells, "common_valid", iterations, ("row", "col"), grow=False)
    return out.where(_own_block(size)).select("run_id", "row", "col", "common_valid")


def open_close(mask: DataFrame, opening: int, closing: int, name: str = "flag", size: int = 256) -> DataFrame:
    """Opening then closing of a dense boolean mask ``(run_id, row, col, flag)``."""
    cells = in_blocks(mask.select("run_id", "row", "col", name), 2 * (opening + closing), size)
    cells = _spread(cells, name, opening, ("row", "col"), grow=False)
    cells = _spread(cells, name, opening + closing, ("col", "row"), grow=True)
    cells = _spread(cells, name, closing, ("row", "col"), grow=False)
    return cells.where(_own_block(size)).select("run_id", "row", "col", name)


def run_funnel(cells: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pixels surviving each stage of a run, and its candidate count."""
    stages = cells.groupBy("run_id").agg(
        F.count_if("common_valid").alias("common_valid_pixel_count"),
        F.count_if("exceeds").alias("threshold_pixel_count"),
        F.count_if("cleaned").alias("cleaned_pixel_count"),
    )
    kept = candidates.groupBy("run_id").agg(
        F.sum("pixel_count").alias("candidate_pixel_count"), F.count(F.lit(1)).alias("candidate_count")
    )
    return stages.join(kept, "run_id", "left").na.fill(0, ["candidate_pixel_count", "candidate_count"])


# --- contracts --------------------------------------------------------------------


def grid_violations(rasters: DataFrame, grids: DataFrame) -> DataFrame:
    """Rasters that disagree with their run's grid, or have none, and grids without a raster.

    ``rasters(run_id, role, crs, width, height, transform, bands, nodata_is_nan)``.  A field that is NULL on
    either side breaks its rule.
    """
    g = grids.select(
        "run_id", F.col("crs").alias("g_crs"), F.col("width").alias("g_width"),
        F.col("height").alias("g_height"), F.col("transform").alias("g_transform"),
    )
    close = F.forall(
        F.zip_with("transform", "g_transform", lambda a, b: F.abs(a - b) <= 1e-9),
        lambda ok: F.coalesce(ok, F.lit(False)),
    )
    reasons = F.array_compact(
        F.array(
            F.when(broken(F.col("bands") == 1), "aligned artifact is not single-band"),
            F.when(broken(F.col("crs") == F.col("g_crs")), "aligned artifact CRS changed"),
            F.when(
                broken((F.col("width") == F.col("g_width")) & (F.col("height") == F.col("g_height"))),
                "aligned artifact dimensions changed",
            ),
            F.when(broken(close), "aligned artifact transform changed"),
            F.when(broken(F.col("nodata_is_nan")), "aligned artifact must use NaN nodata"),
        )
    )
    read = rasters.select("run_id", "role", "crs", "width", "height", "transform", "bands", "nodata_is_nan", F.lit(True).alias("_raster"))
    both = read.join(g.withColumn("_grid", F.lit(True)), "run_id", "full_outer")
    alone = F.when(F.col("_grid").isNull(), "run has no grid").when(F.col("_raster").isNull(), "grid has no raster")
    return both.select("run_id", "role", F.explode(F.when(alone.isNotNull(), F.array(alone)).otherwise(reasons)).alias("reason"))


def raster_violations(rasters: DataFrame, max_dimension: int = 200_000) -> DataFrame:
    """Source-raster metadata rules against the run's box.

    ``rasters(run_id, role, driver, crs, bands, dtype, nodata, width, height, transform,
    color, r_west…r_north, west…north)``; the rotated flag is kept beside the reasons.  A field that is NULL
    breaks its rule.
    """
    t = F.col("transform")
    finite = F.forall("transform", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    numeric = F.col("dtype").rlike("^(u?int(8|16|32|64)|float(16|32|64))$")
    apart = (
        (F.col("r_east") <= F.col("west")) | (F.col("r_west") >= F.col("east"))
        | (F.col("r_north") <= F.col("south")) | (F.col("r_south") >= F.col("north"))
    )
    reasons = F.array_compact(
        F.array(
            F.when(broken(F.col("driver") == "GTiff"), "raster driver must be GTiff"),
            F.when(F.col("crs").isNull(), "raster is missing a CRS"),
            F.when(broken(F.col("bands") == 1), "raster must contain exactly one band"),
            F.when(broken(numeric), "raster dtype is not supported"),
            F.when(F.col("nodata").isNull(), "raster must declare nodata"),
            F.when(
                broken((F.col("width") <= max_dimension) & (F.col("height") <= max_dimension)),
                "raster dimensions exceed the safety limit",
            ),
            F.when(
                F.col("width").cast("bigint") * F.col("height") > MAX_PIXELS,
                "raster pixel count exceeds the safety limit",
            ),
            F.when(broken(finite & (F.size("transform") >= 6)), "raster transform contains non-finite values"),
            F.when(F.abs(t[0] * t[4] - t[1] * t[3]) <= 1e-18, "raster transform is not invertible"),
            F.when(broken(F.col("color").isin("gray", "undefined")), "raster band is not grayscale"),
            F.when(broken(~apart), "raster does not intersect the processing AOI"),
        )
    )
    rotated = (F.abs(t[1]) > 0) | (F.abs(t[3]) > 0)
    return rasters.select(
        "run_id", "role", rotated.alias("rotated_transform"), F.explode(reasons).alias("reason")
    )


def control_residuals(points: DataFrame, before: DataFrame, after: DataFrame, metres_per_cell: float = 10.0) -> DataFrame:
    """Cell-index distance of control points between two grids, in metres.

    ``points(run_id, point_id, x, y)``; grids hold ``run_id, minx, maxy, resolution``.
    """
    def index(name: str, grid: DataFrame) -> DataFrame:
        return grid.select("run_id", F.struct("minx", "maxy", "resolution").alias(name))

    joined = points.join(index("b", before), "run_id").join(index("a", after), "run_id")

    def cell(name: str) -> tuple[Column, Column]:
        g = F.col(name)
        return (
            F.floor((F.col("x") - g["minx"]) / g["resolution"]),
            F.floor((g["maxy"] - F.col("y")) / g["resolution"]),
        )

    (bc, br), (ac, ar) = cell("b"), cell("a")
    metres = F.hypot((bc - ac).cast("double"), (br - ar).cast("double")) * metres_per_cell
    return joined.select("run_id", "point_id", metres.alias("residual_metres")).withColumn(
        "within_tolerance", F.col("residual_metres") <= 10
    )
