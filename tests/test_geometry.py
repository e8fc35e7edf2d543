import math
import random

import pytest
from pyspark.sql import functions as F

from sightline.functions import geometry as geo
from sightline.functions import projection, scalars, tilemath

RING = "array<struct<x:double,y:double>>"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def convex(rng, n):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    cx, cy = rng.uniform(-2, 2), rng.uniform(-2, 2)
    points = [(cx + 2 * math.cos(a), cy + 1.5 * math.sin(a)) for a in angles]
    return points if rng.random() < 0.5 else points[::-1]


def shoelace(points):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1]))) / 2


def sampled_overlap(a, b, steps=400):
    """Common area by counting the centres of a fine lattice inside both rings."""
    def inside(ring, x, y):
        hit = False
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if (y0 > y) != (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
                hit = not hit
        return hit

    lo, hi = -4.5, 4.5
    cell = (hi - lo) / steps
    total = 0
    for i in range(steps):
        for j in range(steps):
            x, y = lo + (i + 0.5) * cell, lo + (j + 0.5) * cell
            total += inside(a, x, y) and inside(b, x, y)
    return total * cell * cell


def test_convex_intersection_matches_sampling(spark):
    rng = random.Random(3)
    pairs = [(convex(rng, rng.randint(3, 7)), convex(rng, rng.randint(3, 7))) for _ in range(12)]
    df = spark.createDataFrame([(i, ring(a), ring(b)) for i, (a, b) in enumerate(pairs)], f"i int, a {RING}, b {RING}")
    shared = geo.convex_intersection(F.col("a"), F.col("b"))
    rows = df.select("i", F.when(F.size(shared) >= 3, geo.area(shared)).otherwise(0.0).alias("s"), geo.area(F.col("a")).alias("area")).collect()
    for row in rows:
        a, b = pairs[row["i"]]
        assert row["s"] == pytest.approx(sampled_overlap(a, b, 250), abs=0.08)
        assert row["area"] == pytest.approx(shoelace(a))


def test_two_squares(spark):
    df = spark.createDataFrame(
        [(ring([(0, 0), (2, 0), (2, 2), (0, 2)]), ring([(1, 0), (1, 2), (3, 2), (3, 0)]))], f"a {RING}, b {RING}"
    )
    row = df.select(geo.convex_intersection(F.col("a"), F.col("b")).alias("i")).select(
        geo.area(F.col("i")).alias("s"), geo.ring_bounds(F.col("i")).alias("b")
    ).first()
    assert row["s"] == 2.0 and tuple(row["b"]) == (1.0, 0.0, 2.0, 2.0)


def test_outer_ring_guards(spark):
    square = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    flat = [(0, 0), (1, 1), (2, 2), (0, 0)]
    df = spark.createDataFrame([([ring(square)],), ([ring(flat)],), ([],)], f"r array<{RING}>")
    got = [r["o"] for r in df.select(geo.outer_ring(F.col("r")).alias("o")).collect()]
    assert len(got[0]) == 4 and got[1] is None and got[2] is None


@pytest.mark.parametrize("n", [400, 500, 501, 1200, 4999])
def test_simplify(spark, n):
    points = [(math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)]
    closed = points + points[:1]
    df = spark.createDataFrame([(ring(closed),)], f"r {RING}")
    got = [(p["x"], p["y"]) for p in df.select(geo.simplify_ring(F.col("r")).alias("s")).first()["s"]]
    if len(closed) <= 500:
        assert got == closed
    else:
        kept = points[:: math.ceil(n / 499)]
        assert got == kept + kept[:1] and len(got) <= 500


def test_projections(spark):
    df = spark.createDataFrame([(-111.0, 40.0), (-112.15, 40.52), (-109.2, -3.0)], "lon double, lat double")
    for code in ("EPSG:32612", "EPSG:3857"):
        there = df.select("lon", "lat", projection.project(F.col("lon"), F.col("lat"), "EPSG:4326", code).alias("p"))
        back = there.select("lon", "lat", "p", projection.project(F.col("p.x"), F.col("p.y"), code, "EPSG:4326").alias("q"))
        for r in back.collect():
            assert r["q"]["x"] == pytest.approx(r["lon"], abs=1e-9)
            assert r["q"]["y"] == pytest.approx(r["lat"], abs=1e-9)
    on_axis = df.limit(1).select(projection.project(F.col("lon"), F.col("lat"), "EPSG:4326", "EPSG:32612").alias("p")).first()["p"]
    # Meridian arc to 40 degrees north on WGS84 is 4,429,529.030 m; UTM scales it by 0.9996.
    assert on_axis["x"] == pytest.approx(500000.0, abs=1e-6)
    assert on_axis["y"] == pytest.approx(4429529.0302 * 0.9996, abs=0.01)
    with pytest.raises(ValueError):
        projection.project(F.col("lon"), F.col("lat"), "EPSG:4326", "EPSG:2154")


def test_tiles_and_previews(spark):
    df = spark.createDataFrame([(85.36, 28.18, 10), (-180.0, 89.9, 3)], "lon double, lat double, z int")
    rows = df.select(tilemath.tile_x(F.col("lon"), F.col("z")).alias("x"), tilemath.tile_y(F.col("lat"), F.col("z")).alias("y")).collect()
    for r, (lon, lat, z) in zip(rows, [(85.36, 28.18, 10), (-180.0, 85.05112878, 3)]):
        assert r["x"] == int((lon + 180) / 360 * 2**z)
        assert r["y"] == int((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * 2**z)
    v = spark.createDataFrame([(0.0, True), (1.0, True), (0.5, True), (None, True), (0.4, False)], "v double, ok boolean")
    assert [r[0] for r in v.select(tilemath.preview_value(F.col("v"), F.col("ok"))).collect()] == [1, 255, 128, 0, 0]


def test_scalars(spark):
    df = spark.createDataFrame([(None, 0.5), (0.5, 0.5), (0.5, 0.6)], "a double, b double")
    assert [r[0] for r in df.select(scalars.resolution_delta(F.col("a"), F.col("b"))).collect()] == pytest.approx([100, 0, 20])
    assert [r[0] for r in df.select(scalars.optional_delta(F.col("a"), F.col("b"))).collect()] == [None, 0.0, 0.1]
    assert df.select(scalars.rate(F.lit(1), F.lit(0))).first()[0] is None
    assert df.select(scalars.percent(F.lit(1.7))).first()[0] == 100.0
    first = df.select(scalars.first_number(F.lit(0.0), F.lit(7.5)), scalars.first_text(F.lit(""), F.lit("b"))).first()
    assert tuple(first) == (7.5, "b")
    one = df.select(scalars.fingerprint(b=F.lit(1), a=F.lit("x")).alias("f")).first()["f"]
    import hashlib

    assert one == hashlib.sha256(b'{"a":"x","b":1}').hexdigest()


def test_box_around_is_clamped(spark):
    row = spark.range(1).select(geo.box_around(F.lit(89.99), F.lit(-179.99)).alias("b")).first()["b"]
    assert tuple(row) == (-180.0, 89.915, -179.915, 90.0)


def test_simplifying_a_long_ring_is_linear(spark):
    """A ring of 40,000 points took minutes when its step was counted for every point."""
    import time

    n = 40_000
    spots = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: geo.point(i.cast("double"), (i % 7).cast("double")))
    long = spark.range(1).select(spots.alias("ring")).localCheckpoint()
    start = time.time()
    got = long.select(geo.simplify_ring(F.col("ring")).alias("r")).first()["r"]
    assert time.time() - start < 30
    step = math.ceil(n / 499)
    assert [p["x"] for p in got] == [float(x) for x in range(1, n + 1, step)] + [1.0]
    none = spark.range(1).select(geo.simplify_ring(F.lit(None).cast(RING)).alias("r")).first()["r"]
    assert none is None


def test_tile_sets_are_compared_in_one_pass(spark):
    from sightline.operators.tiles import tile_set_differences

    made = lambda rows: spark.createDataFrame(rows, "z int, x int")
    want, have = made([(1, 1), (1, 1), (2, 5), (None, 3), (4, None)]), made([(2, 5), (2, 5), (7, 7), (4, None)])
    out = tile_set_differences(want, have, ["z", "x"])
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 1, "missing"), (None, 3, "missing"), (7, 7, "unexpected")], key=str)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2  # each set is made once


def test_costly_steps_are_computed_once_a_row(spark):
    """Snapped grids move a box's points once; tile covers compute the rows of tiles once a zoom."""
    from sightline.operators.raster import build_grids
    from sightline.operators.tiles import tile_cover

    boxes = spark.range(1).selectExpr("id AS run_id", "1D + id AS west", "1D + id AS south", "2D + id AS east", "2D + id AS north")
    grids = build_grids(boxes, "EPSG:3857", 5000.0)._jdf.queryExecution().optimizedPlan().toString()
    assert grids.upper().count("ASINH(") == 1
    cover = tile_cover(boxes)._jdf.queryExecution().optimizedPlan().toString()
    assert all("ASINH" not in line.upper() for line in cover.splitlines() if "Generate" in line)


def test_overlaps_read_written_cells(spark):
    """Cells are written once; the joins and areas of the overlaps would each make them again."""
    from sightline.operators import evaluation

    box = "array(array(struct(0D AS x, -0D AS y), struct(4D AS x, -0D AS y), struct(4D AS x, -4D AS y), struct(0D AS x, -4D AS y)))"
    cases = spark.range(1).selectExpr("'c' AS case_id", "8 AS width", "8 AS height", "array(1D, 0D, 0D, 0D, -1D, 0D) AS transform", f"{box} AS evaluation_rings")
    shapes = spark.range(1).selectExpr("'c' AS case_id", "id AS reference", "id AS prediction", f"{box} AS rings")
    evaluated, expected, predicted = evaluation.cell_tables(cases, shapes, shapes)
    assert [df.count() for df in (evaluated, expected, predicted)] == [16, 16, 16]
    found = evaluation.overlaps(predicted, expected)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r["iou"] for r in found.collect()] == [1.0]
