import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import catalog, pairs
from sightline.operators.catalog import SearchRequest
from sightline.sources import catalog as scans

ITEM = "item_id string, provider string, seq long, acquired_at timestamp, west double, south double, east double, north double, " \
       "product_type string, polarizations array<string>, resolution_range_m double, resolution_azimuth_m double"


def item(i, seq=0, day=1, box=(0, 0, 1, 1), product="GEC", pols=("VV",), rng=0.5, azm=0.5, provider="p"):
    return (i, provider, seq, dt.datetime(2025, 1, day), *map(float, box), product, list(pols), rng, azm)


def request(**kw):
    return SearchRequest(**{"box": (0, 0, 1, 1), "start_at": "2025-01-01", "end_at": "2025-01-31", **kw})


def test_predicate_rules(spark):
    df = spark.createDataFrame(
        [item("touch", box=(1, 1, 2, 2)), item("apart", box=(1.1, 0, 2, 1)), item("late", day=31), item("nores", rng=None, azm=None),
         item("half", rng=None, azm=3.0), item("noprod", product=None), item("dual", pols=("VV", "VH"))], ITEM,
    )
    ids = lambda r: {x["item_id"] for x in catalog.matching(df, r).collect()}
    assert ids(request()) == {"touch", "late", "nores", "half", "noprod", "dual"}
    assert ids(request(max_resolution_m=1.0)) == {"touch", "late", "noprod", "dual"}
    assert ids(request(max_resolution_m=3.0)) == {"touch", "late", "noprod", "dual", "half"}
    assert ids(request(product_types=("GEC",))) == {"touch", "late", "nores", "half", "dual"}
    assert ids(request(polarizations=("VV", "VH"))) == {"dual"}


def test_search_filters_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    spark.createDataFrame([item("a")], ITEM).write.parquet(str(tmp_path / "acq"))
    df = catalog.matching(spark.read.parquet(str(tmp_path / "acq")), request(product_types=("GEC",))).select("item_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters")[1].split("ReadSchema")[0]
    for part in ("GreaterThanOrEqual(acquired_at", "LessThanOrEqual(acquired_at", "LessThanOrEqual(west", "product_type"):
        assert part in pushed
    read = plan.split("ReadSchema")[1]
    assert "seq" not in read and "polarizations" not in read


def test_last_arrival_order_and_page(spark):
    df = spark.createDataFrame(
        [item("a", 1, 2), item("a", 3, 5), item("a", 2, 9), item("b", 4, 5), item("c", 5, 7, provider="q")], ITEM
    )
    rows = [(r["item_id"], r["seq"]) for r in catalog.in_search_order(catalog.latest_arrivals(df)).collect()]
    assert rows == [("c", 5), ("a", 3), ("b", 4)]
    got = catalog.search(df, request(page_size=1), offset=1).collect()
    assert [r["item_id"] for r in got] == ["a"]


def test_request_join_equals_brute_force(spark):
    rng = random.Random(4)
    boxes = []
    for i in range(300):
        size = rng.choice([0.05, 0.5, 3, 40, 170])
        w, s = rng.uniform(-179, 179 - size), rng.uniform(-89, 0)
        boxes.append((w, s, w + size, min(s + size, 90)))
    items = [item(f"i{i}", i, rng.randint(1, 28), b) for i, b in enumerate(boxes)]
    asks = []
    for i in range(40):
        w, s = rng.uniform(-170, 170), rng.uniform(-80, 80)
        asks.append((i, w, s, w + 5, s + 4, dt.datetime(2025, 1, 5), dt.datetime(2025, 1, rng.randint(6, 28)), [], [], [], None))
    schema = "request_id int, west double, south double, east double, north double, start_at timestamp, end_at timestamp, providers array<string>, product_types array<string>, polarizations array<string>, max_resolution_m double"
    got = sorted((r["request_id"], r["item_id"]) for r in catalog.match_requests(spark.createDataFrame(items, ITEM), spark.createDataFrame(asks, schema)).collect())
    want = sorted(
        (a[0], i[0]) for a in asks for i in items
        if not (i[6] < a[1] or i[4] > a[3] or i[7] < a[2] or i[5] > a[4]) and a[5] <= i[3] <= a[6]
    )
    assert want and got == want


def test_a_request_for_the_whole_globe_adds_few_rows(spark):
    schema = "request_id int, west double, south double, east double, north double, start_at timestamp, end_at timestamp, providers array<string>, product_types array<string>, polarizations array<string>, max_resolution_m double"
    globe = (1, -180.0, -90.0, 180.0, 90.0, dt.datetime(2015, 1, 1), dt.datetime(2025, 12, 31), [], [], [], None)
    asks = spark.createDataFrame([globe], schema)
    assert catalog.filed_requests(asks, [0, 1, 2, 3, 4, 5]).count() < 100
    items = spark.createDataFrame([item("a"), item("wide", box=(-180, -90, 180, 90)), item("b", box=(170, 80, 171, 81))], ITEM)
    assert {r["item_id"] for r in catalog.match_requests(items, asks).collect()} == {"a", "wide", "b"}
    assert catalog.match_requests(items, asks.limit(0)).count() == 0 and catalog.match_requests(items.limit(0), asks).count() == 0


def test_provider_status(spark):
    requested = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", True), ("e", True)], "provider string, configured boolean")
    results = spark.createDataFrame([("a",), ("a",), ("b",), ("d",)], "provider string")
    warnings = spark.createDataFrame([("b",)], "provider string")
    pages = spark.createDataFrame([("a", False, False), ("d", True, False), ("e", False, True)], "provider string, has_more boolean, failed boolean")
    got = {r["provider"]: tuple(r)[1:] for r in catalog.provider_report(requested, results, warnings, pages).collect()}
    assert got == {
        "a": ("complete", 2, False, 0), "b": ("partial", 1, False, 1), "c": ("failed", 0, False, 1),
        "d": ("partial", 1, True, 0), "e": ("failed", 0, False, 1),
    }
    assert catalog.overall_status(catalog.provider_report(requested, results, warnings, pages)).first()["status"] == "partial"


def breadth_first(links, root, limit):
    queue, seen, items, links_seen = [root], [], [], 0
    while queue and len(seen) < limit:
        url = queue.pop(0)
        if url in seen:
            continue
        seen.append(url)
        for _, _, rel, to in sorted(l for l in links if l[0] == url):
            if to is None:
                continue
            if rel == "child" and to not in seen:
                queue.append(to)
            if rel == "item":
                links_seen += 1
                items += [to] if to not in items else []
    return seen, items, links_seen


@pytest.mark.parametrize("limit", [1, 4, 9, 100])
def test_walk_equals_queue(spark, limit):
    rng = random.Random(8)
    links = [(f"c{rng.randint(0, 12)}", p, "child", f"c{rng.randint(0, 14)}") for p in range(40)]
    links += [(f"c{rng.randint(0, 14)}", 100 + p, "item", rng.choice([None, f"i{rng.randint(0, 30)}"])) for p in range(50)]
    df = spark.createDataFrame(links, "parent_url string, pos int, rel string, url string")
    catalogs, items = catalog.traverse(df, "c0", limit)
    seen, found, links_seen = breadth_first(links, "c0", limit)
    assert [r["url"] for r in catalogs.orderBy("position").collect()] == seen
    assert [r["url"] for r in items.orderBy("position").collect()] == found
    docs = items.select(F.col("url").alias("source_url"), F.when(F.col("position") % 3 == 0, "bad").alias("problem"))
    indexed = catalog.indexed_items(items, docs, 4)
    c = catalog.traversal_coverage(catalogs, df, indexed, items).first()
    assert (c["catalogs_visited"], c["item_links_seen"]) == (len(seen), links_seen)
    good = [i for i in range(1, len(found) + 1) if i % 3]
    assert c["items_indexed"] == min(4, len(good))
    assert c["items_skipped"] == sum(1 for i in range(1, (good[3] if len(good) >= 4 else len(found)) + 1) if i % 3 == 0)


def test_documents_and_listing(spark, tmp_path):
    good = {
        "id": "item-1", "bbox": [-112.18, 40.49, -112.11, 40.55],
        "geometry": {"type": "Polygon", "coordinates": [[[0, 0, 9], [1, 0, 9], [1, 1, 9], [0, 0, 9]]]},
        "properties": {"datetime": "2025-07-15T05:36:24.5Z", "product:type": "GEC", "sar:polarizations": ["VV"], "sar:resolution_range": 0, "sar:pixel_spacing_range": 0.5},
        "assets": {"a": {"href": "x.tif"}, "b": {"href": ""}},
    }
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps({**good, "id": " "}))
    docs = scans.read_documents(spark, str(tmp_path)).withColumn("source_url", F.concat(F.lit("https://h/x/"), F.substring_index("source_url", "/", -1)))
    items = scans.normalise_items(docs)
    one = scans.accepted(items).first()
    assert (one["item_id"], one["product_type"], one["resolution_range_m"], one["license"]) == ("item-1", "GEC", 0.5, "unknown")
    assert one["acquired_at"].microsecond == 500000
    assert {r["name"]: r["href"] for r in scans.asset_rows(scans.accepted(items)).collect()} == {"a": "https://h/x/x.tif", "b": None}
    assert sorted(r["code"] for r in scans.item_warnings(items).collect()) == ["empty_asset_href", "item_invalid"]
    xml = '<R><Contents><Key>p/q r.TIF</Key><ETag>"e"</ETag><Size>12</Size></Contents><Contents><Key></Key><Size>x</Size></Contents></R>'
    objects = scans.listing_objects(spark.createDataFrame([("l", xml)], "listing_url string, body string"), "https://b/").collect()
    assert (objects[0]["href"], objects[0]["media_type"], objects[0]["size_bytes"], objects[0]["etag"]) == ("https://b/p/q%20r.TIF", "image/tiff; application=geotiff", 12, "e")
    assert objects[1]["object_key"] is None and objects[1]["size_bytes"] is None


PAIR = "item_id string, acquired_at timestamp, footprint array<array<struct<x:double,y:double>>>, product_type string, polarizations array<string>, " \
       "resolution_range_m double, resolution_azimuth_m double, observation_direction string, orbit_state string, incidence_angle_deg double, grazing_angle_deg double"


def acquisition(i, day, x, direction="left", orbit="ascending", angle=40.0):
    pts = [(x, 0), (x + 2, 0), (x + 2, 2), (x, 2), (x, 0)]
    return (i, dt.datetime(2025, 1, day), [[{"x": float(a), "y": float(b)} for a, b in pts]], "GEC", ["VV"], 0.5, 0.5, direction, orbit, angle, 90 - angle)


def test_pair_evidence(spark):
    acq = spark.createDataFrame(
        [acquisition("a", 1, 0), acquisition("b", 26, 1), acquisition("c", 27, 0, "right", "descending", 50.0), acquisition("far", 28, 9)], PAIR
    )
    chosen = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a"), ("a", "far"), ("a", "ghost")], "before_id string, after_id string")
    got = {(r["before_id"], r["after_id"]): r for r in pairs.compare_pairs(chosen, acq).collect()}
    ab = got["a", "b"]
    assert ab["separation"] == dt.timedelta(days=25) and ab["separation_seconds"] == 25 * 86400
    assert tuple(ab["common_box"]) == (1, 0, 2, 2) and (ab["before_overlap_percent"], ab["after_overlap_percent"]) == (50, 50)
    assert ab["warnings"] == [] and ab["common_footprint"][0] == ab["common_footprint"][-1]
    assert got["a", "c"]["warnings"] == [
        "observation directions differ", "orbit states differ", "incidence angle differs by more than 5 degrees"
    ]
    assert [got[k]["problem"] for k in (("b", "a"), ("a", "far"), ("a", "ghost"))] == [
        "before acquisition must precede after acquisition",
        "acquisition footprints do not have a polygonal intersection", "acquisition is unknown",
    ]


def test_any_geometry_with_coordinates_is_an_item(spark):
    def body(geometry, polarizations=("VV",)):
        return json.dumps({
            "id": "i", "bbox": [0, 0, 1, 1], "geometry": geometry, "assets": {}, "links": [],
            "properties": {"datetime": "2025-01-01T00:00:00Z", "sar:polarizations": list(polarizations)},
        })

    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    docs = [
        ("polygon", body({"type": "Polygon", "coordinates": [ring]}, ["VV", 3, None, {"a": 1}, "VH"])),
        ("many", body({"type": "MultiPolygon", "coordinates": [[ring]]})), ("point", body({"type": "Point", "coordinates": [0.5, 0.5]})),
        ("empty", body({"type": "Polygon", "coordinates": []})), ("hollow", body({"type": "Polygon", "coordinates": [[]]})),
        ("untyped", body({"coordinates": [ring]})),
    ]
    rows = {r["source_url"]: r for r in scans.normalise_items(spark.createDataFrame(docs, "source_url string, body string")).collect()}
    assert {k for k, r in rows.items() if r["problem"] is None} == {"polygon", "many", "point"}
    assert rows["polygon"]["polarizations"] == ["VV", "VH"]
    assert rows["polygon"]["footprint"] is not None and rows["many"]["footprint"] is None
    assert json.loads(rows["point"]["geometry"]) == {"type": "Point", "coordinates": [0.5, 0.5]}


def test_bad_pages_are_reported(spark):
    key = "<Contents><Key>a</Key></Contents>"
    pages = [
        ("good", f"<ListBucketResult>{key}</ListBucketResult>"),
        ("cut", f"<ListBucketResult>{key}<IsTruncated>true</IsTruncated></ListBucketResult>"),
        ("more", f"<ListBucketResult>{key}<IsTruncated>true</IsTruncated><NextContinuationToken>t</NextContinuationToken></ListBucketResult>"),
        ("broken", f"<ListBucketResult>{key}<Cont"), ("none", None),
    ]
    got = scans.listing_page_warnings(spark.createDataFrame(pages, "listing_url string, body string")).collect()
    assert {r["source_url"]: r["code"] for r in got} == {"cut": "listing_truncated", "broken": "listing_unreadable", "none": "listing_unreadable"}
    found = [("ok", '{"features": [], "links": []}'), ("list", "[]"), ("half", '{"features": ['), ("other", '{"features": {}}'), ("null", None)]
    bad = scans.unread_pages(spark.createDataFrame(found, "page_url string, body string"))
    assert {r["source_url"] for r in bad.collect()} == {"list", "half", "other", "null"}


def test_sites_on_the_equator_have_one_key(spark):
    boxes = spark.createDataFrame([(-0.1, 0.08, -0.1, 0.08), (-0.08, 0.1, -0.08, 0.1)], "south double, north double, west double, east double")
    assert {r[0] for r in boxes.select(catalog.revisit_key()).collect()} == {"0.00,0.00"}


def test_requests_meet_acquisitions_in_a_shuffled_join(spark):
    """Requests and acquisitions filed in cells are many times larger than the tables they come from."""
    items = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0)], "item_id string, west double, south double, east double, north double").selectExpr(
        "*", "timestamp_ntz'2024-01-05' AS acquired_at", "'p' AS provider", "'GEC' AS product_type", "array('VV') AS polarizations",
        "1D AS resolution_range_m", "1D AS resolution_azimuth_m",
    )
    asked = spark.range(3).selectExpr(
        "id AS request_id", "0D AS west", "0D AS south", "2D AS east", "2D AS north", "timestamp_ntz'2024-01-01' AS start_at",
        "timestamp_ntz'2024-02-01' AS end_at", "array('p') AS providers", "array('GEC') AS product_types", "array('VV') AS polarizations", "2D AS max_resolution_m",
    )
    hits = catalog.match_requests(items, asked)
    assert "Broadcast" not in hits._jdf.queryExecution().executedPlan().toString()
    assert {r["request_id"] for r in hits.collect()} == {0, 1, 2}


def test_page_items_carry_columns_and_pages_are_read_once(spark):
    """Columns of the documents come along without a join; a page's body is parsed in one place of the plan."""
    from sightline.sources import catalog as scans

    body = '{"features":[{"links":[{"rel":"self","href":"https://a.example.org/1"}]}],"links":[]}'
    pages = spark.createDataFrame([("https://p.example.org/0", 7, body)], "page_url string, page_no int, body string")
    found = scans.feature_page_items(pages).where("source_url IS NOT NULL")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructField(features") == 1
    assert [(r["page_no"], r["source_url"]) for r in scans.normalise_items(found, ["page_no"]).collect()] == [(7, "https://a.example.org/1")]


def test_pages_pass_over_the_matches_once(spark):
    """Whether a request goes on after its page is told by one more match, not by counting all of them again."""
    rows = [(r, "p", f"i{k}", dt.datetime(2025, 1, 1 + k % 3), k) for r, n in ((1, 1), (2, 2), (3, 3), (4, 9)) for k in range(n)] + [(None, "p", "x", None, 0)] * 4
    matches = spark.createDataFrame(rows, "request_id int, provider string, item_id string, acquired_at timestamp, seq int")
    paged = catalog.request_pages(matches, 1, 2)
    assert paged.columns == ["request_id", "provider", "item_id", "acquired_at", "seq", "position", "total", "next_offset"]
    want = []
    for r, n in ((2, 2), (3, 3), (4, 9)):
        order = sorted(range(n), key=lambda k: (-(k % 3), f"i{k}"))
        want += [(r, f"i{k}", p, n, 3 if n > 3 else None) for p, k in enumerate(order[:3], 1) if p > 1]
    got = paged.select("request_id", "item_id", "position", "total", "next_offset")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    narrow = got.drop("total")
    assert "Join" not in narrow._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, narrow.collect()), key=str) == sorted([(*w[:3], w[4]) for w in want], key=str)
