"""Nearest earlier pairs and boxes that meet, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sightline.operators.pairs import nearest_earlier
from sightline.operators.places import largest_areas, meeting_boxes, short_areas

ITEM = "item_id STRING, acquired_at TIMESTAMP, u DOUBLE, v DOUBLE, w DOUBLE, h DOUBLE, note STRING"


def sheared(df):
    """Footprints whose points (x, y) have x - y / 2 from u to u + w."""
    corners = [("0", "0"), ("w", "0"), ("w", "h"), ("0", "h"), ("0", "0")]
    ring = ", ".join(f"struct(u + {a} + (v + {b}) / 2 AS x, v + {b} AS y)" for a, b in corners)
    return df.selectExpr(
        "item_id", "acquired_at", f"array(array({ring})) AS footprint", "u + v / 2 AS west", "v AS south",
        "u + w + (v + h) / 2 AS east", "v + h AS north", "note",
    )


def plain_nearest(rows):
    out = set()
    for i, t, u, v, w, h, _ in rows:
        earlier = [
            (-s.timestamp(), j) for j, s, a, b, c, d, _ in rows
            if s and t and s < t and c > 0 and w > 0 and min(u + w, a + c) > max(u, a) and min(v + h, b + d) > max(v, b)
        ]
        if earlier:
            out.add((min(earlier)[1], i))
    return out


@pytest.mark.parametrize("cell", [0.3, 2.0])
def test_nearest_earlier(spark, cell):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(220):
        hot = i % 2 == 0
        u, v = (5.0, 5.0) if hot else (rng.uniform(0, 8), rng.uniform(-8, 8))
        at = start + timedelta(days=rng.randrange(40))
        rows.append((f"i{i:03}", at, u + rng.random() / 9, v + rng.random() / 9, rng.uniform(0.05, 0.9), rng.uniform(0.05, 0.9), None))
    rows += [("late", None, 5.0, 5.0, 0.5, 0.5, ""), ("flat", start + timedelta(days=60), 5.0, 5.0, 0.0, 0.5, ""), ("wide", start + timedelta(days=20), 0.0, -8.0, 9.0, 16.0, "x")]
    items = sheared(spark.createDataFrame(rows, ITEM).repartition(5))
    got = [tuple(r) for r in nearest_earlier(items, cell).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_nearest(rows)
    assert nearest_earlier(items.limit(0)).count() == 0
    assert nearest_earlier(items.where("item_id = 'i001'")).count() == 0


def test_a_long_history_without_overlap_is_looked_through(spark):
    """All footprints share a cell; only the first and the last overlap."""
    start = datetime(2024, 1, 1)
    rows = [(f"i{i:03}", start + timedelta(days=i), 0.01 * (i % 40), 0.011 * (i // 40), 0.009, 0.009, None) for i in range(40)]
    rows.append(("last", start + timedelta(days=99), 0.0, 0.0, 0.009, 0.009, None))
    assert [tuple(r) for r in nearest_earlier(sheared(spark.createDataFrame(rows, ITEM))).collect()] == [("i000", "last")]


def test_boxes_of_all_sizes_meet_once(spark):
    rng = random.Random(6)

    def boxes(n):
        out = []
        for i in range(n):
            w, s, d = rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice([0.0, 0.2, 1.0, 3.0, 30.0])
            out.append((i, w, s, w + d, s + d * rng.random()))
        return out

    items, areas = boxes(150), boxes(60)
    frames = [spark.createDataFrame(r, f"{n} INT, west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE") for r, n in ((items, "item"), (areas, "area"))]
    got = [(r["area"], r["item"]) for r in meeting_boxes(*frames, "item", "area").collect()]
    want = {(a, i) for i, w, s, e, n in items for a, aw, as_, ae, an in areas if e >= aw and w <= ae and n >= as_ and s <= an}
    assert len(got) == len(set(got)) and set(got) == want


def test_areas_find_their_largest_polygons(spark):
    ring = "array(struct(w AS x, 0D AS y), struct(w + d AS x, 0D AS y), struct(w + d AS x, 1D AS y), struct(w AS x, 1D AS y), struct(w AS x, 0D AS y))"
    shapes = spark.createDataFrame([(i, float(i), 0.5 + i % 5) for i in range(20)], "polygon_id INT, w DOUBLE, d DOUBLE").selectExpr("polygon_id", f"{ring} AS ring")
    shapes = shapes.unionAll(spark.range(1).selectExpr("99", "array(struct(5D AS x, 0D AS y))"))
    areas = spark.createDataFrame([(1, 3.6, 0.0, 9.9, 0.5), (2, 18.0, 0.0, 18.2, 9.0), (3, 50.0, 0.0, 60.0, 1.0)], "area_id INT, west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE")
    best = largest_areas(shapes, areas)
    got = {(r["area_id"], r["area_rank"]): r["polygon_id"] for r in best.collect()}
    assert got == {(1, 1): 4, (1, 2): 9, (1, 3): 3, (2, 1): 14, (2, 2): 18, (2, 3): 17}
    short = short_areas(areas, best.where(F.col("area_rank") < 3)).collect()
    assert sorted(map(tuple, short)) == [(1, 2), (2, 2), (3, 0)]


def test_largest_areas_makes_no_list_of_all_touching_pairs(spark, monkeypatch):
    """Many polygons under many areas: each area looks at a few blocks, and ties go to the least id."""
    from sightline.functions import geometry as geo
    from sightline.operators import places

    monkeypatch.setattr(places, "meeting_boxes", lambda *a: pytest.fail("listed every touching pair"))
    rng = random.Random(5)
    boxes, wanted = [], []
    for i in range(1500):
        x, y, d = rng.uniform(0, 9), rng.uniform(0, 9), rng.choice((0.25, 0.5, 0.5, 3.0))
        boxes.append((i, x, y, x + d, y + d))
    for i in range(300):
        x, y, d = rng.uniform(-3, 11), rng.uniform(-3, 11), rng.choice((0.2, 1.5, 9.0))
        wanted.append((i, x, y, x + d, y + d))
    polygons = spark.createDataFrame(boxes, "polygon_id long, w double, s double, e double, n double")
    ring = geo.box_ring(*[F.col(c) for c in "wsen"])
    areas = spark.createDataFrame(wanted, "area_id long, west double, south double, east double, north double")
    sizes = {r["polygon_id"]: r["a"] for r in polygons.select("polygon_id", geo.area(ring).alias("a")).collect()}
    want = set()
    for a, aw, as_, ae, an in wanted:
        met = sorted((-sizes[i], i) for i, w, s, e, n in boxes if not (e < aw or w > ae or n < as_ or s > an))
        want |= {(a, i, k) for k, (_, i) in enumerate(met[:3], 1)}
    found = places.largest_areas(polygons.select("polygon_id", ring.alias("ring")), areas)
    assert {(r["area_id"], r["polygon_id"], r["area_rank"]) for r in found.collect()} == want


def test_clipping_names_its_orientation_once(spark):
    """An orientation named in the lambda of the edges is computed for every edge, a crossing outside a branch for every segment."""
    from sightline.functions import geometry as geo

    ring = geo.box_ring(*[F.col("id") + i for i in (0, 0, 4, 4)])
    shown = spark.range(1).select(geo.convex_intersection(F.slice(ring, 1, 4), F.slice(ring, 1, 4)).alias("i"))
    plan = shown._jdf.queryExecution().analyzed().toString()
    assert "o, CASE" not in plan and "x, CASE WHEN (abs(" not in plan


def test_footprints_are_never_broadcast(spark):
    """Footprints made of a few numbers are many times larger than those, so both sides of a pair are shuffled."""
    from sightline.functions import geometry as geo
    from sightline.operators import pairs

    box = [F.lit(float(v)) for v in (0, 0, 1, 1)]
    known = F.lit(None)
    items = spark.range(40).select(
        F.col("id").cast("string").alias("item_id"), F.timestamp_seconds("id").alias("acquired_at"), F.array(geo.box_ring(*box)).alias("footprint"),
        *[v.alias(c) for v, c in zip(box, ("west", "south", "east", "north"))], known.cast("string").alias("product_type"),
        F.array(F.lit("VV")).alias("polarizations"), *[known.cast("double").alias(c) for c in ("resolution_range_m", "resolution_azimuth_m", "incidence_angle_deg", "grazing_angle_deg")],
        *[known.cast("string").alias(c) for c in ("observation_direction", "orbit_state")],
    )
    found = pairs.compare_pairs(pairs.nearest_earlier(items), items)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 39 and found.where("before_overlap_percent = 100").count() == 39


def test_polygons_that_no_area_can_want_are_left_out(spark, monkeypatch):
    """Small polygons under large ones are filed in no list; areas on any edge, and turned ones, get what they touch."""
    from sightline.functions import geometry as geo
    from sightline.operators import places

    looked = []
    plain = places.largest_touching
    monkeypatch.setattr(places, "largest_touching", lambda boxes, areas, top: looked.append(boxes.count()) or plain(boxes, areas, top))
    rng = random.Random(11)
    boxes = []
    for i in range(6000):
        x, y, d = rng.randrange(10) / 10, rng.uniform(0, 1), rng.choice((0.3, 0.4, 0.5)) + rng.randrange(50) / 1000
        boxes.append((i // 2, x, y, x + d, y + d))
    boxes += [(-1, -3.0, -3.0, 9.0, -2.0), (-2, 3.0, 3.0, 3.0, 3.0), (None, 2.0, 2.0, 2.6, 2.6)]
    wanted = []
    for i in range(400):
        x, y, d = rng.uniform(-0.5, 2), rng.uniform(-0.5, 2), rng.choice((0.0, 0.1, 0.6))
        wanted.append((i, x, y, x + d, y + d))
    wanted.append((400, 0.9 + 0.549, 0.0, 1.6, 1.0))
    polygons = spark.createDataFrame(boxes, "polygon_id long, w double, s double, e double, n double")
    ring = geo.box_ring(*[F.col(c) for c in "wsen"])
    sizes = [r["a"] for r in polygons.select(geo.area(ring).alias("a")).collect()]

    def want(areas):
        out = []
        for a, aw, as_, ae, an in areas:
            met = sorted((-sizes[k], i is not None, i or 0) for k, (i, w, s, e, n) in enumerate(boxes) if not (e < aw or w > ae or n < as_ or s > an))
            out += [(a, round(-m[0], 9), k) for k, m in enumerate(met[:3], 1)]
        return sorted(out)

    for areas in (wanted, [*wanted, (401, 0.6, 0.5, 0.5, 0.6)]):
        frame = spark.createDataFrame(areas, "area_id long, west double, south double, east double, north double")
        found = places.largest_areas(polygons.select("polygon_id", ring.alias("ring")), frame)
        assert sorted((r["area_id"], round(r["polygon_area"], 9), r["area_rank"]) for r in found.collect()) == want(areas)
    assert looked[0] < 1500 and looked[1] == 6003


def test_many_footprints_that_look_back_are_shuffled(spark, monkeypatch):
    """Only a bounded number of rows with rings may be broadcast, whatever their size on disk."""
    from sightline.operators import pairs

    plans = []
    plain = pairs.reliable_checkpoint
    monkeypatch.setattr(pairs, "reliable_checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    monkeypatch.setattr(pairs, "FEW", 60)
    start = datetime(2024, 1, 1)
    rows = [(f"i{i:03}", start + timedelta(days=i), 0.0 if i == 99 else 0.01 * (i % 10), 0.0 if i == 99 else 0.011 * (i // 10), 0.009, 0.009, None) for i in range(100)]
    assert [tuple(r) for r in nearest_earlier(sheared(spark.createDataFrame(rows, ITEM))).collect()] == [("i000", "i099")]
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans[1:3])
