import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import raster, regions
from sightline.operators.raster import ChangePolicy
from sightline.plans.change_run import detect_changes, holds_every_cell

QUIET = dict(score_threshold=0.5, tolerance=0, opening=0, closing=0, minimum_pixels=4, maximum_candidates=20)


def table(spark, before, after, run="r"):
    """A paired pixel table holding every cell; NaN becomes NULL."""
    rows = [
        (run, r, c, None if np.isnan(before[r, c]) else float(before[r, c]), None if np.isnan(after[r, c]) else float(after[r, c]))
        for r in range(before.shape[0]) for c in range(before.shape[1])
    ]
    return spark.createDataFrame(rows, "run_id string, row int, col int, before double, after double")


def unit(df):
    return df.withColumn("before", raster.stretch(F.col("before"), F.lit(0.0), F.lit(100.0))).withColumn(
        "after", raster.stretch(F.col("after"), F.lit(0.0), F.lit(100.0))
    )


def grid(spark, shape, run="r"):
    h, w = shape
    return spark.createDataFrame([(run, w, h, 1.0, 0.0, float(h))], "run_id string, width int, height int, resolution double, minx double, maxy double")


def candidates(spark, before, after, **policy):
    policy = ChangePolicy(**{**QUIET, **policy})
    cells = raster.score_cells(unit(table(spark, before, after)), policy, size=8)
    mask = cells.where("cleaned").select("run_id", "row", "col")
    labelled = regions.label_components(mask, policy.connectivity, size=8)
    return cells, labelled, regions.retain_components(labelled, policy)


def test_block_candidate(spark):
    before, after = np.full((24, 24), 20.0), np.full((24, 24), 20.0)
    after[8:16, 9:17] = 90
    cells, labelled, kept = candidates(spark, before, after)
    inside = regions.candidate_cells(labelled, kept)
    m = regions.candidate_measures(inside, cells, grid(spark, before.shape)).collect()
    assert len(m) == 1
    m = m[0]
    assert (m["pixel_count"], m["area_square_meters"]) == (64, 64.0)
    assert m["mean_change_score"] == pytest.approx(0.7) and m["brightening_fraction"] == 1.0 and m["darkening_fraction"] == 0.0
    assert (m["minx"], m["miny"], m["maxx"], m["maxy"]) == (9.0, 8.0, 17.0, 16.0)
    assert m["candidate_id"] == "r-candidate-0001"
    corners = [(r["r"], r["c"]) for r in regions.outlines(inside).orderBy("position").collect()]
    assert corners == [(8, 9), (8, 17), (16, 17), (16, 9)]
    funnel = raster.run_funnel(cells, kept).first()
    assert (funnel["threshold_pixel_count"], funnel["candidate_pixel_count"], funnel["candidate_count"]) == (64, 64, 1)


def test_speckle_is_opened_away(spark):
    before, after = np.full((20, 20), 20.0), np.full((20, 20), 20.0)
    after[10, 10] = 100
    after[:, 19] = np.nan
    cells, _, kept = candidates(spark, before, after, opening=1, minimum_pixels=1)
    f = raster.run_funnel(cells, kept).first()
    assert (f["threshold_pixel_count"], f["cleaned_pixel_count"], f["candidate_count"]) == (1, 0, 0)


@pytest.mark.parametrize("tolerance,expected", [(0, 2), (1, 0)])
def test_shift_is_tolerated(spark, tolerance, expected):
    before, after = np.full((20, 20), 10.0), np.full((20, 20), 10.0)
    before[5:15, 5:10] = 90
    after[5:15, 6:11] = 90
    _, _, kept = candidates(spark, before, after, tolerance=tolerance, minimum_pixels=1)
    assert kept.count() == expected


@pytest.mark.parametrize("connectivity,expected", [(8, 1), (4, 2)])
def test_diagonal(spark, connectivity, expected):
    before, after = np.full((12, 12), 10.0), np.full((12, 12), 10.0)
    after[7, 7] = after[8, 8] = 90  # across a block corner
    _, _, kept = candidates(spark, before, after, connectivity=connectivity, minimum_pixels=1)
    assert kept.count() == expected


def test_a_run_with_too_many_candidates_is_refused(spark):
    before, after = np.zeros((16, 16)), np.zeros((16, 16))
    after[2, 2] = after[2, 12] = 100
    _, labelled, kept = candidates(spark, before, after, minimum_pixels=1, maximum_candidates=1)
    assert kept.count() == 0
    sizes = regions.component_sizes(labelled, ChangePolicy(**{**QUIET, "minimum_pixels": 1}))
    assert [r["candidate_count"] for r in regions.crowded_runs(sizes, 1).collect()] == [2]
    assert regions.crowded_runs(sizes, 2).count() == 0


def test_a_constant_raster_does_not_stop_the_table(spark):
    rng = np.random.default_rng(0)
    rasters = {"flat": (np.full((12, 12), 5.0), rng.random((12, 12))), "good": (rng.random((12, 12)), rng.random((12, 12)))}
    rows = [(run, role, r, c, float(side[r, c])) for run, pair in rasters.items() for role, side in zip(("before", "after"), pair) for r in range(12) for c in range(12)]
    pixels = spark.createDataFrame(rows, "run_id string, role string, row int, col int, value double")
    grids = spark.createDataFrame([(run, 12, 12, 1.0, 0.0, 12.0) for run in rasters], "run_id string, width int, height int, resolution double, minx double, maxy double")
    run = detect_changes(pixels, grids, ChangePolicy(**QUIET), dense=True)
    assert {(r["run_id"], r["reason"]) for r in run.violations.collect()} == {
        ("flat", "raster has no usable normalization range"), ("flat", "no common valid pixels after edge guard")
    }
    assert run.cells.where("run_id = 'good' AND common_valid").count() == 144


def test_missing_lines_are_noticed(spark):
    grids = spark.createDataFrame([("r", 6, 6)], "run_id string, width int, height int")
    rows = [("r", role, r, c, 1.0) for role in ("before", "after") for r in range(6) for c in range(6)]
    whole = spark.createDataFrame(rows, "run_id string, role string, row int, col int, value double")
    assert holds_every_cell(whole, grids)
    assert not holds_every_cell(whole.where("row <> 3"), grids)


def shifted(a, dr, dc, fill):
    out = np.full_like(a, fill)
    h, w = a.shape
    out[max(0, -dr):h - max(0, dr), max(0, -dc):w - max(0, dc)] = a[max(0, dr):h + min(0, dr), max(0, dc):w + min(0, dc)]
    return out


def square(mask, k, grow):
    parts = [shifted(mask, dr, dc, False) for dr in range(-k, k + 1) for dc in range(-k, k + 1)]
    return np.logical_or.reduce(parts) if grow else np.logical_and.reduce(parts)


@pytest.mark.parametrize("tolerance,opening,closing,size", [(1, 0, 1, 8), (2, 1, 1, 16), (3, 0, 2, 256), (0, 2, 1, 8)])
def test_chain_equals_brute_force(spark, tolerance, opening, closing, size):
    rng = np.random.default_rng(tolerance * 10 + opening)
    smooth = lambda: np.kron(rng.random((9, 11)), np.ones((3, 3)))[:25, :31] * 100
    before, after = smooth(), smooth()
    before[rng.random(before.shape) < 0.02] = np.nan
    after[3:5, 20:23] = np.nan
    policy = ChangePolicy(**{**QUIET, "score_threshold": 0.25, "tolerance": tolerance, "opening": opening, "closing": closing})
    got = raster.score_cells(unit(table(spark, before, after)), policy, size=size).toPandas().set_index(["row", "col"]).sort_index()
    b, a = before / 100, after / 100
    valid = np.isfinite(b) & np.isfinite(a)
    if tolerance:
        valid = square(valid, tolerance, False)
    offsets = [(r, c) for r in range(-tolerance, tolerance + 1) for c in range(-tolerance, tolerance + 1)]
    forward = np.fmin.reduce([np.abs(a - shifted(b, r, c, np.nan)) for r, c in offsets])
    reverse = np.fmin.reduce([np.abs(b - shifted(a, r, c, np.nan)) for r, c in offsets])
    score = np.where(valid, np.maximum(forward, reverse), np.nan)
    mask = np.nan_to_num(score, nan=-1) >= 0.25
    clean = mask
    for k, grow in ((opening, False), (opening, True), (closing, True), (closing, False)):
        clean = square(clean, k, grow) if k else clean
    assert len(got) == before.size
    assert (got["common_valid"].to_numpy().reshape(before.shape) == valid).all() or tolerance == 0
    assert np.allclose(got["score"].to_numpy(float).reshape(before.shape), score, equal_nan=True)
    assert (got["exceeds"].to_numpy().reshape(before.shape) == mask).all()
    assert (got["cleaned"].to_numpy().reshape(before.shape) == clean).all()


def flood(mask, eight):
    label, out = 0, np.full(mask.shape, -1, dtype="int64")
    near = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r or c) and (eight or not (r and c))]
    for start in zip(*np.nonzero(mask)):
        if out[start] >= 0:
            continue
        ident, stack = (int(start[0]) << 31) + int(start[1]), [start]
        out[start] = ident
        while stack:
            r, c = stack.pop()
            for dr, dc in near:
                n = (r + dr, c + dc)
                if 0 <= n[0] < mask.shape[0] and 0 <= n[1] < mask.shape[1] and mask[n] and out[n] < 0:
                    out[n] = ident
                    stack.append(n)
    return out


@pytest.mark.parametrize("connectivity", [4, 8])
def test_labels_equal_flood_fill(spark, connectivity):
    mask = np.random.default_rng(9).random((40, 37)) < 0.45
    mask[20, :] = True  # one long line through many blocks
    rows = [("r", int(r), int(c)) for r, c in zip(*np.nonzero(mask))]
    got = regions.label_components(spark.createDataFrame(rows, "run_id string, row int, col int"), connectivity, size=8).toPandas()
    want = flood(mask, connectivity == 8)
    assert len(got) == mask.sum()
    assert (got["root"].to_numpy() == want[got["row"], got["col"]]).all()


def test_outlines_cover_labels_and_both_walks_agree(spark):
    mask = np.random.default_rng(2).random((18, 18)) < 0.6
    labels = flood(mask, True)
    ids = {v: i + 1 for i, v in enumerate(sorted(set(labels[mask])))}
    rows = [("r", ids[labels[r, c]], int(r), int(c)) for r, c in zip(*np.nonzero(mask))]
    cells = spark.createDataFrame(rows, "run_id string, label int, row int, col int")
    walked, doubled = regions.outlines(cells), regions.outlines(cells, small=0)
    key = lambda df: sorted(tuple(r) for r in df.select("label", "ring", "position", "r", "c").collect())
    assert key(walked) == key(doubled)
    rings = regions.outline_rings(walked, grid(spark, mask.shape)).toPandas()
    from shapely_free import ring_area

    area = rings.assign(a=[ring_area(p) for p in rings["points"]]).groupby("label")["a"].sum()
    for label, count in zip(*np.unique([r[1] for r in rows], return_counts=True)):
        assert -area[label] == count
    assert (rings[~rings.is_hole].groupby("label").size() == 1).all()  # one outer ring each


def test_polygon_cells_with_hole_and_concave_ring(spark):
    outer = [(1.2, 1.1), (14.3, 2.2), (12.6, 12.7), (7.3, 5.6), (2.1, 13.4)]
    hole = [(4.2, 3.3), (6.4, 3.1), (5.2, 5.7)]
    shape = lambda pts: [{"x": x, "y": y} for x, y in pts]
    df = spark.createDataFrame([("p", [shape(outer), shape(hole)], 13, 12)], "id string, rings array<array<struct<x:double,y:double>>>, width int, height int")
    got = {(r["row"], r["col"]) for r in raster.rasterize(df, ["id"]).collect()}

    def inside(x, y):
        hit = False
        for ring in (outer, hole):
            for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
                if (y0 > y) != (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
                    hit = not hit
        return hit

    assert got == {(r, c) for r in range(12) for c in range(13) if inside(c + 0.5, r + 0.5)}


def test_resampling_a_ramp(spark):
    """A plane is reproduced exactly away from the edge; nodata taps are left out."""
    rows = [("r", r, c, None if (r, c) == (4, 4) else 3.0 * c - 2.0 * r) for r in range(10) for c in range(10)]
    source = spark.createDataFrame(rows, "run_id string, row int, col int, value double")
    src = spark.createDataFrame([("r", 100.0, 200.0, 2.0)], "run_id string, minx double, maxy double, resolution double")
    dst = spark.createDataFrame([("r", 100.5, 199.0, 1.0, 16, 16)], "run_id string, minx double, maxy double, resolution double, width int, height int")
    out = raster.resample_bilinear(raster.lattice(dst), dst, source, src, "EPSG:32612", "EPSG:32612")
    for r in out.collect():
        u = (100.5 + r["col"] + 0.5 - 100) / 2 - 0.5
        v = (200 - (199.0 - r["row"] - 0.5)) / 2 - 0.5
        taps = [(i, j) for i in (int(np.floor(v)), int(np.floor(v)) + 1) for j in (int(np.floor(u)), int(np.floor(u)) + 1)]
        usable = [t for t in taps if 0 <= t[0] < 10 and 0 <= t[1] < 10 and t != (4, 4)]
        if len(usable) == 4:
            assert r["value"] == pytest.approx(3 * u - 2 * v)
        elif not [t for t in usable if abs(v - t[0]) < 1 and abs(u - t[1]) < 1]:
            assert r["value"] is None


def test_resampling_across_blocks(spark):
    """Several targets of one source, over block borders, negative rows, gaps, a doubled cell, a NaN and cells off the source."""
    rng = np.random.default_rng(4)
    source = {(r, c): float(rng.integers(0, 1000)) for r in range(-3, 140) for c in range(150) if rng.random() < 0.8}
    rows = [("a", r, c, v) for (r, c), v in source.items()] + [("a", 63, 64, float("nan")), ("b", 0, 0, 7.0)]
    twice = next(iter(source))
    rows.append(("a", *twice, source[twice] - 5))
    source.pop((63, 64), None)
    rows = [r for r in rows if r[:3] != ("a", 63, 64) or np.isnan(r[3])]
    given = spark.createDataFrame(rows, "run_id string, row int, col int, value double")
    src = spark.createDataFrame([("a", 10.0, 300.0, 2.0), ("b", 0.0, 0.0, 1.0)], "run_id string, minx double, maxy double, resolution double")
    targets = {("a", 1): (3.0, 308.0, 2.5, 130, 125), ("a", 2): (10.0, 300.0, 2.0, 150, 140), ("b", 1): (50.0, 50.0, 1.0, 2, 2), ("c", 1): (0.0, 0.0, 1.0, 2, 2)}
    dst = spark.createDataFrame(
        [(*k, *v) for k, v in targets.items()], "run_id string, part int, minx double, maxy double, resolution double, width int, height int"
    )
    src = src.union(spark.createDataFrame([("c", 0.0, 0.0, 1.0)], src.schema))
    lattice = raster.lattice(dst, ("run_id", "part"))
    out = raster.resample_bilinear(lattice, dst, given, src, "EPSG:32612", "EPSG:32612", cell_keys=("part",))
    got = {(r["run_id"], r["part"], r["row"], r["col"]): r["value"] for r in out.collect()}
    assert len(got) == out.count() == sum(w * h for *_, w, h in targets.values())
    for (run, part, row, col), value in got.items():
        if run != "a":
            assert value is None
            continue
        minx, maxy, size, *_ = targets[run, part]
        u, v = (minx + (col + 0.5) * size - 10) / 2 - 0.5, (300 - (maxy - (row + 0.5) * size)) / 2 - 0.5
        i, j = int(np.floor(v)), int(np.floor(u))
        taps = [(w, source[r, c]) for r, c, w in (
            (i, j, (1 - v + i) * (1 - u + j)), (i, j + 1, (1 - v + i) * (u - j)), (i + 1, j, (v - i) * (1 - u + j)), (i + 1, j + 1, (v - i) * (u - j)),
        ) if w > 0 and (r, c) in source]
        assert value == (pytest.approx(sum(w * x for w, x in taps) / sum(w for w, _ in taps)) if taps else None)


def test_quality_and_stretch(spark):
    values = np.arange(1, 37).reshape(6, 6)[2:6, 0:4]
    rows = [("r", role, int(r), int(c), float(values[r, c])) for role in ("before", "after") for r in range(4) for c in range(4)]
    pixels = spark.createDataFrame(rows, "run_id string, role string, row int, col int, value double")
    q = raster.role_quality(pixels, 0, 100).where("role = 'before'").first()
    assert (q["valid_pixel_count"], q["normalization_low"], q["normalization_high"]) == (16, values.min(), values.max())


def test_grid_snaps_outward(spark):
    runs = spark.createDataFrame([("r", -112.18, 40.49, -112.11, 40.55)], "run_id string, west double, south double, east double, north double")
    g = raster.build_grids(runs, "EPSG:32612", 10.0).first()
    assert g["problem"] is None and g["minx"] % 10 == 0 and g["maxy"] % 10 == 0
    assert g["width"] == round((g["maxx"] - g["minx"]) / 10) and g["height"] == round((g["maxy"] - g["miny"]) / 10)


def test_queries_list_the_candidates_of_a_very_crowded_run(spark):
    """10,201 squares of four pixels, more than a run may have under the default parameter ranges."""
    from types import SimpleNamespace

    from pyspark.sql import functions as F

    from workload import raster_queries

    side = 303
    cells = spark.range(side * side).select(F.expr(f"CAST(id DIV {side} AS INT)").alias("r"), F.expr(f"CAST(id % {side} AS INT)").alias("c"))
    ground = F.when((F.col("r") % 3 < 2) & (F.col("c") % 3 < 2), F.col("square")).otherwise(100.0 * (F.col("r") % 2))
    roles = spark.createDataFrame([("before", 0.0), ("after", 100.0)], "role string, square double")
    pix = cells.crossJoin(roles).select(F.lit("crowded").alias("run_id"), "role", "r", "c", ground.alias("v"))
    grid = spark.createDataFrame([("crowded", side, side, 2.0, 0.0, 0.0)], "run_id string, width int, height int, resolution double, minx double, maxy double")
    row = raster_queries.run_funnel(SimpleNamespace(v_pix=pix, v_grid=grid)).first()
    assert (row["candidate_count"], row["candidate_pixel_count"]) == (10_201, 40_804)


def test_outlines_of_many_labels_are_walked_together(spark):
    """Labels of two runs, with holes and touching rings, in one group: the rings of each walked alone."""
    places = np.argwhere(np.random.default_rng(11).random((8, 9, 9)) < 0.6).tolist()
    rows = [(f"run-{label % 2}", label, r, c) for label, r, c in places]
    cells = spark.createDataFrame(rows, "run_id string, label int, row int, col int")
    segments = regions.outline_segments(cells).toPandas()
    key = ["run_id", "label", "ring", "position", "r", "c"]
    alone = [regions._stitch_small(part) for _, part in segments.groupby(["run_id", "label"])]
    alone = sorted(tuple(x) for part in alone for x in part[key].itertuples(index=False))
    assert sorted(regions._stitch_small(segments)[key].itertuples(index=False, name=None)) == alone
    found = regions.outlines(cells).select(*key).collect()
    assert sorted(tuple(r) for r in found) == alone == sorted(tuple(r) for r in regions.outlines(cells, small=0).select(*key).collect())
    corners = regions.outline_corners(cells).collect()
    assert sorted((x[0], x[1], x[4], x[5]) for x in alone) == sorted(tuple(r) for r in corners)
