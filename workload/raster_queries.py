"""Raster, candidate and resampling queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import tilemath
from sightline.functions.projection import project_box
from sightline.operators import raster, regions, tiles
from sightline.operators.raster import ChangePolicy
from sightline.plans.change_run import detect_changes, normalised_cells
from sightline.session import reliable_checkpoint
from workload.registry import Inputs, query

# Policies without clean-up keep the SQL twins of labels and outlines small; FULL runs every step.
# Runs of these tables grow with them, so SHARP and LOOSE have a limit that none reaches; crowded_runs shows refusals.
R6 = lambda c: F.bround(c, 6)
SHARP = ChangePolicy(score_threshold=0.5, tolerance=0, opening=0, closing=0, minimum_pixels=4, maximum_candidates=2**63 - 1)
LOOSE = ChangePolicy(score_threshold=0.2, tolerance=1, opening=0, closing=0, minimum_pixels=1, maximum_candidates=2**63 - 1)

FULL = ChangePolicy(score_threshold=0.05, tolerance=1, opening=1, closing=1, minimum_pixels=1, maximum_candidates=10_000)


def pixels(t: Inputs) -> DataFrame:
    """The derived pixel table, written once because the chain reads it several times."""
    return reliable_checkpoint(
        t.v_pix.select("run_id", "role", F.col("r").alias("row"), F.col("c").alias("col"), F.col("v").alias("value"))
    )


# SQL twins of the chain, one common table expression per stage.
_QUALITY = """SELECT run_id, role, count(*) AS valid_pixel_count, min(v) AS value_min, max(v) AS value_max,
    quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM {v_pix} GROUP BY run_id, role"""
_NORM = f"""
    quality AS ({_QUALITY}),
    cells AS (SELECT run_id, r, c FROM (SELECT run_id, width, unnest(range(height)) AS r FROM {{v_grid}}) g, LATERAL (SELECT unnest(range(g.width)) AS c) h),
    sides AS (SELECT p.run_id, p.r, p.c, p.role, least(greatest((v - lo) / (hi - lo), 0e0), 1e0) AS n
              FROM {{v_pix}} p JOIN quality q ON p.run_id = q.run_id AND p.role = q.role),
    norm AS (SELECT g.run_id, g.r, g.c, max(n) FILTER (WHERE role = 'before') AS b, max(n) FILTER (WHERE role = 'after') AS a
             FROM cells g LEFT JOIN sides s ON g.run_id = s.run_id AND g.r = s.r AND g.c = s.c GROUP BY g.run_id, g.r, g.c)"""
_STEPS = "(SELECT unnest(range(-1, 2)) AS dr) x, (SELECT unnest(range(-1, 2)) AS dc) y"
_SCORE1 = f"""{_NORM},
    near AS (SELECT n.run_id, n.r, n.c, count(*) FILTER (WHERE m.a IS NOT NULL AND m.b IS NOT NULL) AS ok,
                    min(abs(n.a - m.b)) AS fwd, min(abs(n.b - m.a)) AS rev
             FROM norm n CROSS JOIN {_STEPS} LEFT JOIN norm m ON m.run_id = n.run_id AND m.r = n.r + dr AND m.c = n.c + dc
             GROUP BY n.run_id, n.r, n.c),
    score1 AS (SELECT run_id, r, c, ok = 9 AS common_valid, CASE WHEN ok = 9 THEN greatest(fwd, rev) END AS score FROM near)"""
_MASK0 = f"{_NORM}, mask AS (SELECT run_id, r, c, abs(a - b) AS score, a - b AS delta FROM norm WHERE abs(a - b) >= 0.5e0)"


def _square(name: str, source: str, flag: str, k: int, test: str) -> str:
    """One morphology pass over the dense table ``source`` as SQL."""
    steps = f"(SELECT unnest(range(-{k}, {k} + 1)) AS dr) x, (SELECT unnest(range(-{k}, {k} + 1)) AS dc) y"
    return f"""{name} AS (SELECT n.run_id, n.r, n.c, coalesce({test}, false) AS {flag} FROM {source} n CROSS JOIN {steps}
        LEFT JOIN {source} m ON m.run_id = n.run_id AND m.r = n.r + dr AND m.c = n.c + dc GROUP BY n.run_id, n.r, n.c)"""


_ALL9, _ANY = "count(*) FILTER (WHERE m.f) = 9", "bool_or(m.f)"


@query("pixel_lattice", f"WITH {_NORM} SELECT run_id, r AS cell_row, c AS cell_col FROM cells")
def pixel_lattice(t: Inputs) -> DataFrame:
    return raster.lattice(t.v_grid).select("run_id", F.col("row").alias("cell_row"), F.col("col").alias("cell_col"))


@query("role_quality", f"""SELECT run_id, role, valid_pixel_count, value_min, value_max, round_even(lo, 6) AS normalization_low,
    round_even(hi, 6) AS normalization_high FROM ({_QUALITY}) q""")
def role_quality(t: Inputs) -> DataFrame:
    return raster.role_quality(pixels(t)).select(
        "run_id", "role", "valid_pixel_count", "value_min", "value_max",
        R6("normalization_low").alias("normalization_low"), R6("normalization_high").alias("normalization_high"),
    )


_AOI = "SELECT run_id, CAST(width AS BIGINT) * height AS aoi_pixel_count FROM {v_grid}"


@query("coverage_faults", f"""SELECT q.run_id, q.role, round_even(valid_pixel_count / aoi_pixel_count, 6) AS valid_fraction,
    'valid AOI coverage is below the minimum' AS reason FROM ({_QUALITY}) q JOIN ({_AOI}) a ON q.run_id = a.run_id
    WHERE valid_pixel_count / aoi_pixel_count < 0.99e0""")
def coverage_faults(t: Inputs) -> DataFrame:
    bad = raster.quality_violations(raster.role_quality(pixels(t)), t.sql(_AOI))
    return bad.select("run_id", "role", R6("valid_fraction").alias("valid_fraction"), "reason")


@query("common_valid", f"""WITH {_NORM} SELECT n.run_id, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS common_valid_pixel_count,
    round_even(count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) / max(aoi_pixel_count), 6) AS common_valid_fraction
    FROM norm n JOIN ({_AOI}) x ON n.run_id = x.run_id GROUP BY n.run_id""")
def common_valid(t: Inputs) -> DataFrame:
    out = raster.common_valid_fraction(raster.pair_roles(pixels(t)), t.sql(_AOI))
    return out.select("run_id", "common_valid_pixel_count", R6("common_valid_fraction").alias("common_valid_fraction"))


@query("normalised_cells", f"WITH {_NORM} SELECT run_id, r AS cell_row, c AS cell_col, round_even(b, 6) AS before_value, round_even(a, 6) AS after_value FROM norm")
def normalised(t: Inputs) -> DataFrame:
    return normalised_cells(pixels(t), t.v_grid).select(
        "run_id", F.col("row").alias("cell_row"), F.col("col").alias("cell_col"),
        R6("before").alias("before_value"), R6("after").alias("after_value"),
    )


@query(
    "preview_values",
    f"""WITH {_MASK0} SELECT n.run_id, n.r AS cell_row, n.c AS cell_col,
        CASE WHEN n.b IS NULL THEN 0 ELSE CAST(round_even(n.b * 254 + 1, 0) AS INT) END AS preview,
        CASE WHEN m.r IS NOT NULL THEN 255 WHEN n.a IS NULL THEN 0 ELSE CAST(round_even(n.a * 255, 0) AS INT) END AS red,
        CASE WHEN n.a IS NULL THEN 0 WHEN m.r IS NOT NULL THEN CAST(round_even(round_even(n.a * 255, 0) * 0.35e0, 0) AS INT)
             ELSE CAST(round_even(n.a * 255, 0) AS INT) END AS green
        FROM norm n LEFT JOIN mask m ON n.run_id = m.run_id AND n.r = m.r AND n.c = m.c""",
)
def preview_values(t: Inputs) -> DataFrame:
    cells = normalised_cells(pixels(t), t.v_grid)
    change = F.coalesce(F.abs(F.col("after") - F.col("before")) >= 0.5, F.lit(False))
    rgb = tilemath.overlay_rgb(F.col("after"), F.col("after").isNotNull(), change)
    return cells.select(
        "run_id", F.col("row").alias("cell_row"), F.col("col").alias("cell_col"),
        tilemath.preview_value(F.col("before"), F.col("before").isNotNull()).cast("int").alias("preview"),
        rgb["r"].cast("int").alias("red"), rgb["g"].cast("int").alias("green"),
    )


@query("score_exact", f"""WITH {_NORM} SELECT run_id, r AS cell_row, c AS cell_col, a IS NOT NULL AND b IS NOT NULL AS common_valid,
    round_even(abs(a - b), 6) AS score FROM norm""")
def score_exact(t: Inputs) -> DataFrame:
    return _scored(t, SHARP)


@query("score_tolerant", f"WITH {_SCORE1} SELECT run_id, r AS cell_row, c AS cell_col, common_valid, round_even(score, 6) AS score FROM score1")
def score_tolerant(t: Inputs) -> DataFrame:
    return _scored(t, LOOSE)


def _scored(t: Inputs, policy: ChangePolicy) -> DataFrame:
    cells = raster.score_cells(normalised_cells(pixels(t), t.v_grid), policy)
    return cells.select("run_id", F.col("row").alias("cell_row"), F.col("col").alias("cell_col"), "common_valid", R6("score").alias("score"))


@query("eroded_valid", f"WITH {_SCORE1} SELECT run_id, count(*) FILTER (WHERE common_valid) AS eroded_pixels, count(*) AS pixels FROM score1 GROUP BY run_id")
def eroded_valid(t: Inputs) -> DataFrame:
    paired = raster.pair_roles(pixels(t), t.v_grid)
    return raster.eroded_valid(paired, 1).groupBy("run_id").agg(
        F.count_if("common_valid").alias("eroded_pixels"), F.count(F.lit(1)).alias("pixels")
    )


_FLAG = "flag0 AS (SELECT run_id, r, c, coalesce(abs(a - b) >= 0.1e0, false) AS f FROM norm)"
_MORPH = f"""{_NORM}, {_FLAG}, {_square('e1', 'flag0', 'f', 1, _ALL9)}, {_square('d1', 'e1', 'f', 1, _ANY)},
    {_square('d2', 'd1', 'f', 1, _ANY)}, {_square('e2', 'd2', 'f', 1, _ALL9)}"""


@query("cleaned_mask", f"WITH {_MORPH} SELECT run_id, r AS cell_row, c AS cell_col FROM e2 WHERE f")
def cleaned_mask(t: Inputs) -> DataFrame:
    cells = normalised_cells(pixels(t), t.v_grid)
    flag = F.coalesce(F.abs(F.col("after") - F.col("before")) >= 0.1, F.lit(False))
    cleaned = raster.open_close(cells.withColumn("flag", flag), 1, 1)
    return cleaned.where("flag").select("run_id", F.col("row").alias("cell_row"), F.col("col").alias("cell_col"))


def _reach(eight: bool) -> str:
    near = "abs(m.r - w.r) <= 1 AND abs(m.c - w.c) <= 1" if eight else "abs(m.r - w.r) + abs(m.c - w.c) = 1"
    return f"""/*recursive*/ {_MASK0}, reach(run_id, r0, c0, r, c) AS (
        SELECT run_id, r, c, r, c FROM mask
        UNION SELECT w.run_id, w.r0, w.c0, m.r, m.c FROM reach w JOIN mask m ON m.run_id = w.run_id AND {near}),
        labelled AS (SELECT run_id, r, c, min(CAST(r0 AS BIGINT) * 2147483648 + c0) AS root FROM reach GROUP BY run_id, r, c)"""


@query("components_eight", f"WITH {_reach(True)} SELECT run_id, r AS cell_row, c AS cell_col, root FROM labelled")
def components_eight(t: Inputs) -> DataFrame:
    return _labelled(t, 8)


@query("components_four", f"WITH {_reach(False)} SELECT run_id, r AS cell_row, c AS cell_col, root FROM labelled")
def components_four(t: Inputs) -> DataFrame:
    return _labelled(t, 4)


def _labelled(t: Inputs, connectivity: int) -> DataFrame:
    cells = raster.score_cells(normalised_cells(pixels(t), t.v_grid), SHARP)
    labelled = regions.label_components(cells.where("cleaned").select("run_id", "row", "col"), connectivity)
    return labelled.select("run_id", F.col("row").alias("cell_row"), F.col("col").alias("cell_col"), "root")


_KEPT = f"""{_reach(True)},
    kept AS (SELECT run_id, root, count(*) AS pixel_count, row_number() OVER (PARTITION BY run_id ORDER BY root) AS label
             FROM labelled GROUP BY run_id, root HAVING count(*) >= 4),
    cand AS (SELECT l.run_id, k.label, l.r, l.c, m.score, m.delta FROM labelled l JOIN kept k ON l.run_id = k.run_id AND l.root = k.root
             JOIN mask m ON m.run_id = l.run_id AND m.r = l.r AND m.c = l.c)"""


@query(
    "candidate_measures",
    f"""WITH {_KEPT} SELECT concat(run_id, '-candidate-', printf('%04d', label)) AS candidate_id, count(*) AS pixel_count,
        count(*) * 4e0 AS area_square_meters, round_even(avg(score), 6) AS mean_change_score, round_even(quantile_cont(score, 0.95), 6) AS p95_change_score,
        round_even(max(score), 6) AS max_change_score, round_even(avg(delta), 6) AS mean_signed_delta,
        round_even(avg(CASE WHEN delta > 0 THEN 1e0 ELSE 0e0 END), 6) AS brightening_fraction,
        round_even(avg(CASE WHEN delta < 0 THEN 1e0 ELSE 0e0 END), 6) AS darkening_fraction,
        400000e0 + 2e0 * min(c) AS minx, 4480000e0 - 2e0 * (max(r) + 1) AS miny, 400000e0 + 2e0 * (max(c) + 1) AS maxx, 4480000e0 - 2e0 * min(r) AS maxy
        FROM cand GROUP BY run_id, label""",
)
def candidate_measures(t: Inputs) -> DataFrame:
    """The flagship: pixels to measured change candidates."""
    run = detect_changes(pixels(t), t.v_grid, SHARP)
    shares = ("mean_change_score", "p95_change_score", "max_change_score", "mean_signed_delta", "brightening_fraction", "darkening_fraction")
    return run.measures.select(
        "candidate_id", "pixel_count", "area_square_meters", *[R6(c).alias(c) for c in shares], "minx", "miny", "maxx", "maxy"
    )


@query(
    "tolerant_candidates",
    f"""WITH /*recursive*/ {_SCORE1}, hits AS (SELECT run_id, r, c FROM score1 WHERE score >= 0.2e0), reach(run_id, r0, c0, r, c) AS (
        SELECT run_id, r, c, r, c FROM hits
        UNION SELECT w.run_id, w.r0, w.c0, m.r, m.c FROM reach w JOIN hits m ON m.run_id = w.run_id AND abs(m.r - w.r) <= 1 AND abs(m.c - w.c) <= 1),
        roots AS (SELECT run_id, r, c, min(CAST(r0 AS BIGINT) * 2147483648 + c0) AS root FROM reach GROUP BY run_id, r, c)
        SELECT run_id, count(DISTINCT root) AS candidate_count, count(*) AS candidate_pixel_count FROM roots GROUP BY run_id""",
)
def tolerant_candidates(t: Inputs) -> DataFrame:
    run = detect_changes(pixels(t), t.v_grid, LOOSE)
    return run.funnel.select("run_id", "candidate_count", "candidate_pixel_count")


@query(
    "run_funnel",
    f"""WITH {_KEPT}, n AS (SELECT run_id, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS common_valid_pixel_count,
          count(*) FILTER (WHERE abs(a - b) >= 0.5e0) AS threshold_pixel_count FROM norm GROUP BY run_id),
        k AS (SELECT run_id, CAST(sum(pixel_count) AS BIGINT) AS candidate_pixel_count, count(*) AS candidate_count FROM kept GROUP BY run_id)
        SELECT n.run_id, common_valid_pixel_count, threshold_pixel_count, threshold_pixel_count AS cleaned_pixel_count,
               coalesce(candidate_pixel_count, 0) AS candidate_pixel_count, coalesce(candidate_count, 0) AS candidate_count
        FROM n LEFT JOIN k ON n.run_id = k.run_id""",
)
def run_funnel(t: Inputs) -> DataFrame:
    return detect_changes(pixels(t), t.v_grid, SHARP).funnel


_FULL = f"""{_SCORE1}, flag0 AS (SELECT run_id, r, c, coalesce(score >= 0.05e0, false) AS f FROM score1),
    {_square('e1', 'flag0', 'f', 1, _ALL9)}, {_square('d1', 'e1', 'f', 1, _ANY)}, {_square('d2', 'd1', 'f', 1, _ANY)}, {_square('e2', 'd2', 'f', 1, _ALL9)}"""


@query(
    "policy_funnel",
    f"""WITH {_FULL} SELECT s.run_id, count(*) FILTER (WHERE common_valid) AS common_valid_pixel_count, count(*) FILTER (WHERE z.f) AS threshold_pixel_count,
        count(*) FILTER (WHERE e.f AND common_valid) AS cleaned_pixel_count
        FROM score1 s JOIN flag0 z ON z.run_id = s.run_id AND z.r = s.r AND z.c = s.c JOIN e2 e ON e.run_id = s.run_id AND e.r = s.r AND e.c = s.c GROUP BY s.run_id""",
)
def policy_funnel(t: Inputs) -> DataFrame:
    """Pixels left after tolerance, opening and closing."""
    return detect_changes(pixels(t), t.v_grid, FULL).funnel.select(
        "run_id", "common_valid_pixel_count", "threshold_pixel_count", "cleaned_pixel_count"
    )


@query("crowded_runs", f"WITH {_KEPT} SELECT run_id, count(*) AS candidate_count FROM kept GROUP BY run_id HAVING count(*) > 2")
def crowded_runs(t: Inputs) -> DataFrame:
    """Runs with more candidates than a policy of two allows."""
    run = detect_changes(pixels(t), t.v_grid, replace(SHARP, maximum_candidates=2))
    return run.crowded


@query("outline_areas", f"WITH {_KEPT} SELECT run_id, label, count(*) * 4e0 AS outline_area FROM cand GROUP BY run_id, label")
def outline_areas(t: Inputs) -> DataFrame:
    """Area inside every candidate's rings, holes taken off."""
    from sightline.functions.geometry import signed_area

    run = detect_changes(pixels(t), t.v_grid, SHARP)
    rings = regions.outline_rings(regions.outlines(run.candidates), t.v_grid)
    return rings.groupBy("run_id", "label").agg((-F.sum(signed_area(F.col("points")))).alias("outline_area"))


@query(
    "outline_corners",
    f"""WITH {_KEPT}, corner AS (SELECT run_id, label, r + dr AS r, c + dc AS c, sum(CASE WHEN dr = dc THEN 1 ELSE 0 END) AS diag, count(*) AS n
          FROM cand, (SELECT unnest(range(0, 2)) AS dr) x, (SELECT unnest(range(0, 2)) AS dc) y GROUP BY run_id, label, r + dr, c + dc)
        SELECT run_id, label, CAST(sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND diag IN (0, 2) THEN 2 ELSE 0 END) AS BIGINT) AS corners
        FROM corner GROUP BY run_id, label""",
)
def outline_corners(t: Inputs) -> DataFrame:
    """Ring corners per candidate; a touch point counts once per ring passing it."""
    run = detect_changes(pixels(t), t.v_grid, SHARP)
    return regions.outlines(run.candidates).groupBy("run_id", "label").agg(F.count(F.lit(1)).alias("corners"))


@query("candidate_features")
def candidate_features(t: Inputs) -> DataFrame:
    from sightline.sources.sinks import features

    run = detect_changes(pixels(t), t.v_grid, SHARP)
    rings = regions.outline_rings(regions.outlines(run.candidates), t.v_grid)
    return features(rings, run.measures).select("candidate_id", "feature")


@query("candidate_envelopes")
def candidate_envelopes(t: Inputs) -> DataFrame:
    run = detect_changes(pixels(t), t.v_grid, SHARP)
    return regions.geographic_envelopes(regions.outline_corners(run.candidates), t.v_grid, "EPSG:32612")


@query(
    "screen_positions",
    f"""WITH {_KEPT} SELECT concat('C-', printf('%03d', label)) AS display_id, cand.run_id,
        round_even(100e0 * min(c) / max(width), 6) AS left_percent, round_even(100e0 * min(r) / max(height), 6) AS top_percent,
        round_even(100e0 * (max(c) + 1 - min(c)) / max(width), 6) AS width_percent FROM cand JOIN {{v_grid}} g ON g.run_id = cand.run_id
        GROUP BY cand.run_id, label""",
)
def screen_positions(t: Inputs) -> DataFrame:
    run = detect_changes(pixels(t), t.v_grid, SHARP)
    grid = t.v_grid.select("run_id", F.struct("minx", "miny", "maxx", "maxy").alias("g"))
    p = tilemath.screen_position(F.struct("minx", "miny", "maxx", "maxy"), F.col("g"))
    return run.measures.join(grid, "run_id").select(
        regions.display_id(F.col("label")).alias("display_id"), "run_id", p["left_percent"].alias("left_percent"),
        p["top_percent"].alias("top_percent"), p["width_percent"].alias("width_percent"),
    )


# --- grids, resampling, contracts ---------------------------------------------------

_PLACES = "SELECT CAST(k AS STRING) AS run_id, west, south, east, north FROM {v_item}"


@query(
    "snapped_grids",
    """SELECT run_id, CAST(ceil(x1 / 5000e0) - floor(x0 / 5000e0) AS INT) AS width, CAST(ceil(y1 / 5000e0) - floor(y0 / 5000e0) AS INT) AS height,
       floor(x0 / 5000e0) * 5000e0 AS minx, ceil(y1 / 5000e0) * 5000e0 AS maxy FROM (
       SELECT CAST(k AS STRING) AS run_id, radians(west) * 6378137e0 AS x0, radians(east) * 6378137e0 AS x1,
              asinh(tan(radians(south))) * 6378137e0 AS y0, asinh(tan(radians(north))) * 6378137e0 AS y1 FROM {v_item}) q""",
)
def snapped_grids(t: Inputs) -> DataFrame:
    return raster.build_grids(t.sql(_PLACES), "EPSG:3857", 5000.0).select("run_id", "width", "height", "minx", "maxy")


_POLY = """SELECT prediction AS poly, x0 + 0.25e0 AS x0, y0 + 0.25e0 AS y0, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h FROM {v_pred}"""


@query(
    "polygon_cells",
    f"""SELECT poly, r AS cell_row, c AS cell_col FROM ({_POLY}) p, (SELECT unnest(range(48)) AS r) x, (SELECT unnest(range(64)) AS c) y
        WHERE c + 0.5e0 >= x0 AND c + 0.5e0 < x0 + w AND r + 0.5e0 >= y0 AND r + 0.5e0 < y0 + h
          AND NOT (c + 0.5e0 >= x0 + 2 AND c + 0.5e0 < x0 + 4 AND r + 0.5e0 >= y0 + 2 AND r + 0.5e0 < y0 + 4)
          AND NOT (c + 0.5e0 - x0) + (r + 0.5e0 - y0) < 1.75e0""",
)
def polygon_cells(t: Inputs) -> DataFrame:
    """A box with one corner cut off and a square hole, as cells."""
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    spot = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    outer = F.array(spot(x + 1.75, y), spot(x + w, y), spot(x + w, y + h), spot(x, y + h), spot(x, y + 1.75))
    hole = F.array(spot(x + 2, y + 2), spot(x + 4, y + 2), spot(x + 4, y + 4), spot(x + 2, y + 4))
    shapes = t.sql(_POLY).select("poly", F.array(outer, hole).alias("rings"), F.lit(64).alias("width"), F.lit(48).alias("height"))
    return raster.rasterize(shapes, ["poly"]).select("poly", F.col("row").alias("cell_row"), F.col("col").alias("cell_col"))


@query(
    "resampled_cells",
    """WITH cells AS (SELECT run_id, role, rr AS r, cc AS c FROM {v_grid} g, (SELECT unnest(['before', 'after']) AS role) o,
            LATERAL (SELECT unnest(range(g.height)) AS rr) a, LATERAL (SELECT unnest(range(g.width)) AS cc) b),
       taps AS (SELECT run_id, role, r, c, r + dr AS sr, c + dc AS sc, (CASE dr WHEN 1 THEN 0.25e0 ELSE 0.75e0 END) * 0.5e0 AS w
                FROM cells, (SELECT unnest(range(2)) AS dr) x, (SELECT unnest(range(2)) AS dc) y)
       SELECT t.run_id, t.role, t.r AS cell_row, t.c AS cell_col, round_even(sum(w * v) / sum(CASE WHEN v IS NOT NULL THEN w END), 6) AS resampled
       FROM taps t LEFT JOIN {v_pix} p ON p.run_id = t.run_id AND p.r = t.sr AND p.c = t.sc AND p.role = t.role GROUP BY t.run_id, t.role, t.r, t.c""",
)
def resampled_cells(t: Inputs) -> DataFrame:
    """Both roles on a grid shifted by half a column and a quarter row."""
    shifted = t.v_grid.select(
        "run_id", F.explode(F.array(F.lit("before"), F.lit("after"))).alias("role"), (F.col("minx") + 1.0).alias("minx"),
        (F.col("maxy") - 0.5).alias("maxy"), "resolution", "width", "height",
    )
    keys = ("run_id", "role")
    given = t.v_grid.join(shifted.select(*keys), "run_id")
    out = raster.resample_bilinear(
        raster.lattice(shifted, keys), shifted, pixels(t).select(*keys, "row", "col", "value"), given, "EPSG:32612", "EPSG:32612", keys
    )
    return out.select(*keys, F.col("row").alias("cell_row"), F.col("col").alias("cell_col"), F.bround("value", 6).alias("resampled"))


_CONTROL = """SELECT concat('run-', CAST(s_suppkey % 2 AS STRING)) AS run_id, s_suppkey AS point_id,
    400000e0 + 1.5e0 * (s_suppkey % 97) AS x, 4480000e0 - 1.25e0 * (s_suppkey % 89) AS y FROM {supplier}"""


@query(
    "control_residuals",
    f"""SELECT run_id, point_id, round_even(10e0 * sqrt(pow(floor((x - 400000e0) / 2e0) - floor((x - 400000.75e0) / 2e0), 2)
        + pow(floor((4480000e0 - y) / 2e0) - floor((4480003e0 - y) / 2e0), 2)), 6) AS residual_metres FROM ({_CONTROL}) p""",
)
def control_residuals(t: Inputs) -> DataFrame:
    moved = t.v_grid.select("run_id", (F.col("minx") + 0.75).alias("minx"), (F.col("maxy") + 3).alias("maxy"), "resolution")
    out = raster.control_residuals(t.sql(_CONTROL), t.v_grid, moved)
    return out.select("run_id", "point_id", R6("residual_metres").alias("residual_metres"))


_RASTERS = """SELECT concat('src-', CAST(p_partkey AS STRING)) AS run_id, CASE WHEN p_partkey % 2 = 0 THEN 'before' ELSE 'after' END AS role, p_partkey AS k,
    1000 + p_size AS width, 2000 + p_size AS height FROM {part}"""


def _rasters(t: Inputs) -> DataFrame:
    k = F.col("k")
    shape = lambda skew: F.array(F.lit(2.0), skew, F.lit(10.0), F.lit(0.0), F.lit(-2.0), F.lit(50.0))
    return t.sql(_RASTERS).select(
        "run_id", "role", F.when(k % 5 == 0, "PNG").otherwise("GTiff").alias("driver"),
        F.when(k % 7 != 0, "EPSG:32612").alias("crs"), F.when(k % 11 == 0, 3).otherwise(1).alias("bands"),
        F.when(k % 13 == 0, "complex64").otherwise("float32").alias("dtype"), F.when(k % 17 != 0, F.lit(0.0)).alias("nodata"),
        F.when(k % 19 == 0, 300000).otherwise(F.col("width")).alias("width"), "height",
        shape(F.when(k % 23 == 0, F.lit(float("nan"))).otherwise(F.lit(0.0))).alias("transform"),
        F.when(k % 29 == 0, "red").otherwise("gray").alias("color"),
        F.lit(0.0).alias("r_west"), F.lit(0.0).alias("r_south"), F.lit(1.0).alias("r_east"), F.lit(1.0).alias("r_north"),
        F.when(k % 31 == 0, F.lit(1.0)).otherwise(F.lit(0.5)).alias("west"), F.lit(0.5).alias("south"), F.lit(2.0).alias("east"), F.lit(2.0).alias("north"),
    )


@query(
    "raster_metadata_faults",
    f"""SELECT reason, count(*) AS n FROM (SELECT unnest([CASE WHEN k % 5 = 0 THEN 'raster driver must be GTiff' END, CASE WHEN k % 7 = 0 THEN 'raster is missing a CRS' END,
        CASE WHEN k % 11 = 0 THEN 'raster must contain exactly one band' END, CASE WHEN k % 13 = 0 THEN 'raster dtype is not supported' END,
        CASE WHEN k % 17 = 0 THEN 'raster must declare nodata' END, CASE WHEN k % 19 = 0 THEN 'raster dimensions exceed the safety limit' END,
        CASE WHEN k % 23 = 0 THEN 'raster transform contains non-finite values' END, CASE WHEN k % 29 = 0 THEN 'raster band is not grayscale' END,
        CASE WHEN k % 31 = 0 THEN 'raster does not intersect the processing AOI' END]) AS reason FROM ({_RASTERS}) r) x WHERE reason IS NOT NULL GROUP BY reason""",
)
def raster_metadata_faults(t: Inputs) -> DataFrame:
    return raster.raster_violations(_rasters(t)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "grid_contract_faults",
    f"""SELECT run_id, role, unnest(CASE WHEN k % 11 = 0 AND k % 7 = 0 THEN ['aligned artifact is not single-band', 'aligned artifact CRS changed']
        WHEN k % 11 = 0 THEN ['aligned artifact is not single-band'] WHEN k % 7 = 0 THEN ['aligned artifact CRS changed'] ELSE [] END) AS reason FROM ({_RASTERS}) r
        UNION ALL SELECT run_id, role, 'aligned artifact transform changed' FROM ({_RASTERS}) r WHERE k % 23 = 0
        UNION ALL SELECT run_id, role, 'aligned artifact dimensions changed' FROM ({_RASTERS}) r WHERE k % 19 = 0
        UNION ALL SELECT run_id, role, 'aligned artifact must use NaN nodata' FROM ({_RASTERS}) r WHERE k % 17 = 0""",
)
def grid_contract_faults(t: Inputs) -> DataFrame:
    rasters = _rasters(t).withColumn("nodata_is_nan", F.col("nodata").isNotNull())
    grids = t.sql(_RASTERS).select(
        "run_id", F.lit("EPSG:32612").alias("crs"), "width", "height",
        F.array(F.lit(2.0), F.lit(0.0), F.lit(10.0), F.lit(0.0), F.lit(-2.0), F.lit(50.0)).alias("transform"),
    )
    return raster.grid_violations(rasters, grids)


@query(
    "run_parameter_faults",
    """SELECT run_id, unnest(list_filter([CASE WHEN k % 5 = 0 THEN 'score threshold is out of range' END, CASE WHEN k % 7 = 0 THEN 'registration tolerance is out of range' END,
       CASE WHEN k % 11 = 0 THEN 'connectivity must be 4 or 8' END, CASE WHEN k % 13 = 0 THEN 'lower percentile must be less than upper percentile' END,
       CASE WHEN k % 17 = 0 THEN 'thumbnail size is out of range' END], lambda x: x IS NOT NULL)) AS reason FROM (SELECT concat('src-', CAST(p_partkey AS STRING)) AS run_id, p_partkey AS k FROM {part}) r""",
)
def run_parameter_faults(t: Inputs) -> DataFrame:
    from sightline.operators.contracts import parameter_violations

    k = F.col("k")
    runs = t.sql(_RASTERS).select(
        "run_id", F.when(k % 5 == 0, 1.5).otherwise(0.5).alias("score_threshold"), F.when(k % 7 == 0, 4).otherwise(2).alias("tolerance"),
        F.lit(1).alias("opening"), F.lit(1).alias("closing"), F.when(k % 11 == 0, 6).otherwise(8).alias("connectivity"),
        F.lit(512).alias("minimum_pixels"), F.lit(500).alias("maximum_candidates"), F.lit(1.0).alias("resolution"),
        F.when(k % 13 == 0, 99.0).otherwise(2.0).alias("lower_percentile"), F.lit(98.0).alias("upper_percentile"),
        F.when(k % 17 == 0, 16).otherwise(512).alias("thumbnail_max_size"), F.lit(0.99).alias("min_valid_fraction"),
    )
    return parameter_violations(runs)


# Runs whose parameters are each missing in turn: no field is set in run k that has k % 14 as its number.
_UNSET = "SELECT concat('src-', CAST(k AS STRING)) AS run_id, " + ", ".join(
    f"CASE WHEN k % 14 = {i} THEN NULL ELSE {v} END AS {c}"
    for i, (c, v) in enumerate({
        "score_threshold": "0.25e0 * CAST(k % 6 AS DOUBLE)", "tolerance": "k % 5", "opening": "k % 7 - 1", "closing": "k % 9 - 2",
        "connectivity": "k % 3 * 4", "minimum_pixels": "k % 10", "maximum_candidates": "k * 7", "resolution": "0.5e0 * CAST(k % 8 AS DOUBLE)",
        "lower_percentile": "CAST(k % 102 AS DOUBLE)", "upper_percentile": "CAST(k % 103 AS DOUBLE)", "thumbnail_max_size": "k % 3000",
        "min_valid_fraction": "0.125e0 * CAST(k % 10 AS DOUBLE)",
    }.items())
) + " FROM (SELECT p_partkey AS k FROM {part}) r"
_RANGES = {
    "score threshold is out of range": "score_threshold > 0 AND score_threshold <= 1", "registration tolerance is out of range": "tolerance BETWEEN 0 AND 3",
    "opening iterations are out of range": "opening BETWEEN 0 AND 3", "closing iterations are out of range": "closing BETWEEN 0 AND 3",
    "connectivity must be 4 or 8": "connectivity IN (4, 8)", "minimum component size is out of range": "minimum_pixels >= 1",
    "maximum candidate count is out of range": "maximum_candidates BETWEEN 1 AND 10000", "target resolution must be positive": "resolution > 0",
    "percentile is out of range": "lower_percentile BETWEEN 0 AND 100 AND upper_percentile BETWEEN 0 AND 100",
    "lower percentile must be less than upper percentile": "lower_percentile < upper_percentile",
    "thumbnail size is out of range": "thumbnail_max_size BETWEEN 64 AND 2048",
    "minimum valid fraction is out of range": "min_valid_fraction > 0 AND min_valid_fraction <= 1",
}


@query("unset_parameters", " UNION ALL ".join(f"SELECT run_id, '{reason}' AS reason FROM ({_UNSET}) p WHERE ({ok}) IS NOT TRUE" for reason, ok in _RANGES.items()))
def unset_parameters(t: Inputs) -> DataFrame:
    from sightline.operators.contracts import parameter_violations

    return parameter_violations(t.sql(_UNSET))


# Rasters and grids with one field missing in turn, rasters without a grid and grids without a raster.
_HALF_SET = "SELECT k, concat('src-', CAST(k AS STRING)) AS run_id, CASE WHEN k % 2 = 0 THEN 'before' ELSE 'after' END AS role, " + ", ".join(
    f"CASE WHEN k % 19 = {i} THEN NULL ELSE {v} END AS {c}"
    for i, (c, v) in enumerate({
        "driver": "CASE WHEN k % 5 = 0 THEN 'PNG' ELSE 'GTiff' END", "crs": "'EPSG:32612'", "bands": "1 + k % 2", "dtype": "'float32'", "nodata": "0e0",
        "width": "1000 + size", "height": "2000 + size", "color": "CASE WHEN k % 3 = 0 THEN 'red' ELSE 'gray' END", "nodata_is_nan": "k % 4 <> 0",
        "step": "2e0", "r_west": "0e0", "r_east": "1e0", "west": "0.125e0 * CAST(k % 10 AS DOUBLE)", "g_crs": "CASE WHEN k % 6 = 0 THEN 'EPSG:4326' ELSE 'EPSG:32612' END",
        "g_width": "1000 + size", "g_height": "2000 + size - k % 2", "g_step": "2e0",
    }.items())
) + " FROM (SELECT p_partkey AS k, p_size AS size FROM {part}) r"


def _half_set(t: Inputs) -> DataFrame:
    shape = lambda step: F.when(F.col(step).isNotNull(), F.array(F.col(step), F.lit(0.0), F.lit(10.0), F.lit(0.0), F.lit(-2.0), F.lit(50.0)))
    south, north = F.lit(0.0), F.lit(1.0)
    return t.sql(_HALF_SET).withColumns({
        "transform": shape("step"), "g_transform": shape("g_step"), "r_south": south, "r_north": north, "south": south, "north": north, "east": F.lit(2.0),
    })


_SOURCE_RULES = {
    "raster driver must be GTiff": "driver = 'GTiff'", "raster is missing a CRS": "crs IS NOT NULL", "raster must contain exactly one band": "bands = 1",
    "raster dtype is not supported": "dtype = 'float32'", "raster must declare nodata": "nodata IS NOT NULL",
    "raster dimensions exceed the safety limit": "width <= 200000 AND height <= 200000", "raster transform contains non-finite values": "step IS NOT NULL",
    "raster band is not grayscale": "color IN ('gray', 'undefined')", "raster does not intersect the processing AOI": "NOT (r_east <= west OR r_west >= 2e0)",
}
_GRID_RULES = {
    "aligned artifact is not single-band": "bands = 1", "aligned artifact CRS changed": "crs = g_crs",
    "aligned artifact dimensions changed": "width = g_width AND height = g_height", "aligned artifact transform changed": "step = g_step",
    "aligned artifact must use NaN nodata": "nodata_is_nan",
}


@query("unset_raster_fields", " UNION ALL ".join(f"SELECT run_id, role, '{reason}' AS reason FROM ({_HALF_SET}) p WHERE ({ok}) IS NOT TRUE" for reason, ok in _SOURCE_RULES.items()))
def unset_raster_fields(t: Inputs) -> DataFrame:
    return raster.raster_violations(_half_set(t)).select("run_id", "role", "reason")


@query(
    "unset_grid_fields",
    " UNION ALL ".join(
        f"SELECT run_id, role, '{reason}' AS reason FROM ({_HALF_SET}) p WHERE k % 23 > 1 AND ({ok}) IS NOT TRUE" for reason, ok in _GRID_RULES.items()
    ) + f""" UNION ALL SELECT run_id, role, 'run has no grid' FROM ({_HALF_SET}) p WHERE k % 23 = 0
        UNION ALL SELECT run_id, NULL, 'grid has no raster' FROM ({_HALF_SET}) p WHERE k % 23 = 1""",
)
def unset_grid_fields(t: Inputs) -> DataFrame:
    rows = _half_set(t)
    grids = rows.where("k % 23 <> 0").select("run_id", *[F.col(f"g_{c}").alias(c) for c in ("crs", "width", "height", "transform")])
    return raster.grid_violations(rows.where("k % 23 <> 1"), grids)


# --- tiles ---------------------------------------------------------------------------

_TILE_PIX = "SELECT role, CAST(12 AS INT) AS z, CAST(floor(c / 16) AS BIGINT) AS x, CAST(floor(r / 16) AS BIGINT) AS y, CASE WHEN v < 20000 THEN 0 ELSE 7 END AS band, run_id FROM {v_pix}"


@query(
    "tile_tallies",
    f"""SELECT role, count(*) AS tile_count, count(*) FILTER (WHERE lo = 0) AS tiles_with_transparency, count(*) FILTER (WHERE hi > 0) AS tiles_with_imagery
        FROM (SELECT role, x, y, min(band) AS lo, max(band) AS hi FROM ({_TILE_PIX}) p GROUP BY role, x, y) q GROUP BY role""",
)
def tile_tallies(t: Inputs) -> DataFrame:
    band = t.sql(_TILE_PIX).select("role", "z", "x", "y", F.col("band").alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))
    return tiles.tile_tallies(band).drop("z")


# Krueger series between the ellipsoid and its transverse Mercator plane, from the third flattening.
_FLAT = 1 / 298.257223563
_N = _FLAT / (2 - _FLAT)
_ECC = (_FLAT * (2 - _FLAT)) ** 0.5
_SCALE = 0.9996 * 6378137 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Coefficients of the powers of the third flattening, from the power of the harmonic on.
_FORWARD = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (13 / 48, -3 / 5, 557 / 1440), (61 / 240, -103 / 140), (49561 / 161280,))
_BACK = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (1 / 48, 1 / 15, -437 / 1440), (17 / 480, -37 / 840), (4397 / 161280,))
_LATITUDE = ((2, -2 / 3, -2, 116 / 45), (7 / 3, -8 / 5, -227 / 45), (56 / 15, -136 / 35), (4279 / 630,))


def _series(table, term: str, sign: str) -> str:
    factors = [sum(c * _N ** (j + i) for i, c in enumerate(row)) for j, row in enumerate(table, start=1)]
    return "".join(f" {sign} {f!r} * {term.format(k=f'{2 * j}e0')}" for j, f in enumerate(factors, start=1))


def _tile_row(lat: str) -> str:
    return f"CAST(trunc((1 - asinh(tan(radians({lat}))) / pi()) / 2 * pow(2, z)) AS BIGINT)"


_TILE_PIXELS = f"""WITH g AS (SELECT DISTINCT concat(run_id, '/', p.role) AS role, minx, maxy, maxx, miny FROM {{v_grid}} JOIN (SELECT DISTINCT run_id, role FROM {{v_pix}}) p USING (run_id)),
    corner AS (SELECT role, (y / {_SCALE!r}) AS xi, (x - 5e5) / {_SCALE!r} AS eta FROM g, LATERAL (SELECT unnest([minx, maxx]) AS x) a, LATERAL (SELECT unnest([miny, maxy]) AS y) b),
    sphere AS (SELECT role, xi{_series(_BACK, "sin({k} * xi) * cosh({k} * eta)", "-")} AS xi, eta{_series(_BACK, "cos({k} * xi) * sinh({k} * eta)", "-")} AS eta FROM corner),
    turned AS (SELECT role, asin(sin(xi) / cosh(eta)) AS chi, -111e0 + degrees(atan2(sinh(eta), cos(xi))) AS lon FROM sphere),
    box AS (SELECT role, min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north
            FROM (SELECT role, lon, degrees(chi{_series(_LATITUDE, "sin({k} * chi)", "+")}) AS lat FROM turned) q GROUP BY role),
    edges AS (SELECT role, z, CAST(trunc((west + 180) / 360 * pow(2, z)) AS BIGINT) AS x0, CAST(trunc((east + 180) / 360 * pow(2, z)) AS BIGINT) AS x1,
                {_tile_row("north")} AS y0, {_tile_row("south")} AS y1 FROM box, (SELECT unnest(range(8, 15)) AS z) zs),
    cover AS (SELECT role, z, x, y FROM edges, LATERAL (SELECT unnest(range(x0, x1 + 1)) AS x) a, LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y) b),
    cells AS (SELECT role, z, x, y, tr, tc, radians(-180 + 360 * (x + (tc + 0.5e0) / 256) / pow(2, z)) AS lam, pi() * (1 - 2 * (y + (tr + 0.5e0) / 256) / pow(2, z)) AS psi
              FROM cover, (SELECT unnest(range(256)) AS tr) a, (SELECT unnest(range(256)) AS tc) b),
    bent AS (SELECT *, sinh(psi - {_ECC!r} * atanh({_ECC!r} * tanh(psi))) AS t, lam - radians(-111e0) AS dl FROM cells),
    flat AS (SELECT role, z, x, y, tr, tc, atan2(t, cos(dl)) AS xi, asinh(sin(dl) / sqrt(t * t + cos(dl) * cos(dl))) AS eta FROM bent),
    placed AS (SELECT role, z, x, y, tr, tc, (5e5 + {_SCALE!r} * (eta{_series(_FORWARD, "cos({k} * xi) * sinh({k} * eta)", "+")}) - minx) / 2 - 0.5e0 AS u,
                 (maxy - {_SCALE!r} * (xi{_series(_FORWARD, "sin({k} * xi) * cosh({k} * eta)", "+")})) / 2 - 0.5e0 AS v FROM flat JOIN g USING (role)),
    taps AS (SELECT role, z, x, y, tr, tc, floor(v) + dr AS r, floor(u) + dc AS c, abs(1 - dr - (v - floor(v))) * abs(1 - dc - (u - floor(u))) AS w
             FROM placed, (SELECT unnest(range(2)) AS dr) a, (SELECT unnest(range(2)) AS dc) b),
    shown AS (SELECT t.role, z, x, y, tr, tc, sum(w * p.v) / sum(CASE WHEN p.v IS NOT NULL THEN w END) AS value
              FROM taps t LEFT JOIN (SELECT concat(run_id, '/', role) AS role, r, c, v FROM {{v_pix}}) p ON p.role = t.role AND p.r = t.r AND p.c = t.c GROUP BY t.role, z, x, y, tr, tc)
    SELECT role, z, x, y, count(value) AS filled, count(*) AS cells, round_even(avg(value), 2) AS mean_value FROM shown GROUP BY role, z, x, y"""


@query("tile_pixels", _TILE_PIXELS)
def tile_pixels(t: Inputs) -> DataFrame:
    """Filled pixels per tile and zoom when the raster of a role is cut into web tiles."""
    band = F.concat_ws("/", "run_id", "role").alias("role")
    source = pixels(t).select(band, "row", "col", "value")
    grid = t.v_grid.join(t.v_pix.select("run_id", band).distinct(), "run_id")
    box = project_box(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), "EPSG:32612", "EPSG:4326")
    boxes = grid.withColumn("_b", box).select("role", "_b.west", "_b.south", "_b.east", "_b.north")
    cover = tiles.tile_cover(boxes).select("role", "z", "x", "y")
    out = tiles.assemble_tiles(cover, source, grid.select("role", "minx", "maxy", "resolution"), "EPSG:32612")
    return out.groupBy("role", "z", "x", "y").agg(
        F.count("value").alias("filled"), F.count(F.lit(1)).alias("cells"), F.bround(F.avg("value"), 2).alias("mean_value")
    )
