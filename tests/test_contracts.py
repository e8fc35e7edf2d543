import hashlib
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sightline.operators import contracts, labeling, places, tiles
from sightline.sources import artifacts, manifests, sinks


def test_artifact_files(spark, tmp_path):
    root = tmp_path / "bundle"
    root.mkdir()
    png = b"\x89PNG\r\n\x1a\n123"
    for name, data in (("ok.png", png), ("fake.png", b"nope"), ("size.txt", b"abc"), ("sum.txt", b"abc"), ("here.txt", b"x")):
        (root / name).write_bytes(data)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = [("ok", "ok.png", "image/png", "available", len(png), sha(png)), ("fake", "fake.png", "image/png", "available", 4, sha(b"nope")),
            ("size", "size.txt", "text/plain", "available", 9, sha(b"abc")), ("sum", "sum.txt", "text/plain", "available", 3, sha(b"abd")),
            ("gone", "gone.txt", "text/plain", "available", 3, sha(b"abc")), ("here", "here.txt", "text/plain", "missing", 0, ""),
            ("away", "away.txt", "text/plain", "missing", 0, ""), ("up", "../up.txt", "text/plain", "available", 1, "")]
    declared = spark.createDataFrame(
        [("b", *r) for r in rows], "bundle_id string, artifact_id string, path string, media_type string, status string, size_bytes long, sha256 string"
    )
    files = artifacts.relative_to(artifacts.scan_files(spark, str(root)), str(root)).withColumn("bundle_id", F.lit("b"))
    got = {r["artifact_id"]: r["reason"] for r in contracts.artifact_audit(declared, files).collect()}
    assert got == {
        "ok": None, "fake": "signature does not match media type", "size": "file size changed", "sum": "file checksum changed",
        "gone": "file is missing", "here": "artifact marked missing is present", "away": None, "up": "path is unsafe",
    }
    unsummed = contracts.artifact_audit(declared.where("artifact_id = 'ok'").withColumn("sha256", F.lit(None).cast("string")), files)
    assert {(r["artifact_id"], r["path"]): r["reason"] for r in unsummed.collect()} == {
        ("ok", "ok.png"): "file checksum changed",
        **{(None, name): "file is not declared" for name in ("fake.png", "size.txt", "sum.txt", "here.txt")},
    }


def test_large_files_are_hashed_in_pieces(spark, tmp_path):
    data = {"empty": b"", "a b%20c": b"ab", "limit": b"12345678", "over": b"123456789", "long": bytes(range(256)) * 12_000}
    (tmp_path / "in").mkdir()
    for name, content in data.items():
        (tmp_path / "in" / name).write_bytes(content)
    got = artifacts.relative_to(artifacts.scan_files(spark, str(tmp_path), whole_bytes=8), str(tmp_path)).collect()
    assert {r["path"]: (r["length"], r["sha256"], bytes(r["magic"])) for r in got} == {
        f"in/{name}": (len(content), hashlib.sha256(content).hexdigest(), content[:8]) for name, content in data.items() if content
    }
    assert artifacts.scan_files(spark, str(tmp_path), "*.none").count() == 0


def test_repeated_ids_and_summaries(spark):
    declared = spark.createDataFrame([("b", "a1", "available")], "bundle_id string, artifact_id string, status string")
    candidates = spark.createDataFrame([("b", "c", ["a1"])] * 2, "bundle_id string, candidate_id string, evidence_artifact_ids array<string>")
    assessments = spark.createDataFrame([("b", "e", 1, "c", [], None)] * 2, "bundle_id string, assessment_id string, seq int, candidate_id string, evidence_artifact_ids array<string>, supersedes_event_id string")
    summaries = spark.createDataFrame([("b", ["c", "ghost"], ["a1", "a9"])], "bundle_id string, candidate_ids array<string>, artifact_ids array<string>")
    got = contracts.reference_violations(declared, candidates, assessments, summaries).collect()
    assert sorted((r["subject"], r["reason"]) for r in got) == [
        ("a9", "summary names an unavailable artifact"), ("c", "candidate ID is duplicated"),
        ("e", "assessment ID is duplicated"), ("ghost", "summary names an unknown candidate"),
    ]


def test_parents_without_children_break_the_rules(spark):
    bundles = spark.createDataFrame([("b",), ("empty",)], "bundle_id string")
    roles = spark.createDataFrame([("b", "before", "x"), ("b", "after", "y")], "bundle_id string, role string, acquisition_id string")
    assert [r["bundle_id"] for r in contracts.role_violations(bundles, roles).collect()] == ["empty"]
    cases = spark.createDataFrame([(1,), (2,)], "case_id int")
    acquisitions = spark.createDataFrame([(1, 0, "before", "a" * 64), (1, 1, "after", None)], "case_id int, position int, role string, checksum string")
    seen = spark.createDataFrame([(1, "o", "k")], "case_id int, observation_id string, citation_id string")
    residuals = spark.createDataFrame([(1, 0.1)] * 5, "case_id int, metres double")
    got = contracts.case_violations(cases, acquisitions, seen, seen.select("case_id", "citation_id"), residuals)
    assert sorted((r["case_id"], r["reason"]) for r in got.collect()) == [
        (1, "checksum must be SHA-256"), (2, "acquisitions must be ordered before, then after"), (2, "citations must be a non-empty list"),
        (2, "observations must be a non-empty list"), (2, "residuals must contain five controls"),
    ]


@pytest.mark.parametrize("path,safe", [("a/b.txt", True), ("/a", False), ("a//b", False), ("./a", False), ("a/../b", False), ("a\\b", False), ("s3://a", False)])
def test_safe_paths(spark, path, safe):
    assert spark.range(1).select(contracts.safe_path(F.lit(path))).first()[0] is safe


def test_manifests(spark, tmp_path):
    sound = {
        "contract_version": "1.0.0", "run_id": "r", "selection_id": "s", "grid": {"crs": "EPSG:32612"},
        "artifacts": [{"role": role, "kind": "aligned-raster", "sha256": "a" * 64} for role in ("before", "after")],
    }
    (tmp_path / "ok.json").write_text(json.dumps(sound))
    loaded = manifests.read_run_manifests(spark, str(tmp_path / "ok.json"))
    assert manifests.require_sound(loaded).count() == 1
    (tmp_path / "odd.json").write_text(json.dumps({**sound, "artifacts": sound["artifacts"][:1]}))
    with pytest.raises(manifests.ManifestError):
        manifests.require_sound(manifests.read_run_manifests(spark, str(tmp_path / "odd.json")))
    (tmp_path / "broken.json").write_text('{"run_id": 3')
    with pytest.raises(Exception):
        manifests.read_run_manifests(spark, str(tmp_path / "broken.json")).collect()


def test_runs_are_written_once(spark, tmp_path):
    df = spark.range(3)
    path = sinks.write_run(df, str(tmp_path), "run-1", "cells")
    assert sinks.is_published(spark, path) and sinks.read_run(spark, str(tmp_path), "run-1", "cells").count() == 3
    with pytest.raises(AnalysisException):
        sinks.write_run(df, str(tmp_path), "run-1", "cells")
    with pytest.raises(FileNotFoundError):
        sinks.read_run(spark, str(tmp_path), "run-2", "cells")


def test_feature_text(spark, tmp_path):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 0.0, "y": 1.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 0.0}]
    rings = spark.createDataFrame([("r", 1, 5, True, ring), ("r", 1, 2, False, ring)], "run_id string, label int, ring long, is_hole boolean, points array<struct<x:double,y:double>>")
    measures = spark.createDataFrame([("r", 1, "r-candidate-0001", 4)], "run_id string, label int, candidate_id string, pixel_count int")
    rows = sinks.features(rings, measures)
    feature = json.loads(rows.first()["feature"])
    assert feature["id"] == "r-candidate-0001" and len(feature["geometry"]["coordinates"]) == 2
    assert feature["geometry"]["coordinates"][0][1] == [0.0, 1.0] and feature["properties"]["pixel_count"] == 4
    sinks.write_features(rows, str(tmp_path / "features"))
    assert spark.read.text(str(tmp_path / "features")).count() == 1


# --- labeling -----------------------------------------------------------------------


@pytest.fixture
def packet(spark):
    packets = spark.createDataFrame([("p", 10, 10, 0.0, 10.0, 1.0, "EPSG:3857", "run", "sha")], "packet_id string, width int, height int, minx double, maxy double, resolution double, crs string, processing_run_id string, manifest_sha256 string")
    laid = tiles.review_tiles(packets, 10, 2)
    exports = spark.createDataFrame([("p", "run", "sha", "complete", 1, 1)], "packet_id string, processing_run_id string, manifest_sha256 string, coverage_status string, coverage_reviewed long, coverage_total long")
    reviews = spark.createDataFrame([("p", "T-001", "regions-drawn", 1)], "packet_id string, tile_id string, decision string, saved_at int")
    point = "array<struct<x:double,y:double>>"
    pts = lambda *xy: [{"x": float(a), "y": float(b)} for a, b in xy]
    ground = pts((1, 9), (3, 9), (3, 7))
    regions = spark.createDataFrame([("p", "T-001-R-01", "T-001", ground, ground, pts((1, 1), (3, 1), (3, 3)), ground + ground[:1], "EPSG:3857")],
                                    f"packet_id string, region_id string, tile_id string, points {point}, projected_points {point}, pixel_points {point}, ring {point}, geometry_crs string")
    drafts = spark.createDataFrame([], f"packet_id string, tile_id string, points {point}")
    return packets, laid, exports, reviews, regions, drafts


def test_sound_export_is_ready(packet):
    packets, laid, exports, reviews, regions, drafts = packet
    assert labeling.export_violations(*packet).collect() == []
    r = labeling.readiness(laid, reviews, regions, drafts).first()
    assert r["ready_for_adjudication"] and r["provisional_regions"] == 1 and r["blocking_issues"] == []


@pytest.mark.parametrize("change,reason", [
    ({"pixel_points": "transform(pixel_points, p -> named_struct('x', p.x + 0.5D, 'y', p.y))"}, "pixel coordinates are inconsistent"),
    ({"geometry_crs": "'EPSG:4326'"}, "region does not use the packet grid CRS"),
    ({"tile_id": "'T-009'"}, "region references an unknown tile"),
    ({"ring": "points"}, "polygon ring is inconsistent"),
    ({"projected_points": "slice(points, 1, 2)"}, "projected points are inconsistent"),
])
def test_region_faults(packet, change, reason):
    packets, laid, _, _, regions, _ = packet
    broken = regions.withColumns({k: F.expr(v) for k, v in change.items()})
    assert labeling.region_faults(broken, laid, packets).first()["reason"] == reason


def test_partial_export(packet, spark):
    packets, laid, exports, reviews, regions, drafts = packet
    open_review = reviews.withColumns({"decision": F.lit(""), "saved_at": F.lit(None).cast("int")})
    draft = regions.select("packet_id", "tile_id", F.expr("array(named_struct('x', 99D, 'y', 5D))").alias("points"))
    reasons = {r["reason"] for r in labeling.export_violations(packets, laid, exports, open_review, regions, draft).collect()}
    assert reasons == {"reviewed tile count is inconsistent", "coverage status is inconsistent", "draft falls outside its declared tile"}
    r = labeling.readiness(laid, open_review, regions, draft).first()
    assert r["blocking_issues"] == ["tile coverage is incomplete: 0/1 reviewed", "1 incomplete labeling drafts remain"]


@pytest.mark.parametrize("length,want", [(100, [0]), (1024, [0]), (1100, [0, 76]), (3000, [0, 896, 1792, 1976]), (1920, [0, 896])])
def test_tile_starts(spark, length, want):
    df = spark.createDataFrame([("p", length, 10)], "packet_id string, width int, height int")
    assert sorted(r["x"] for r in tiles.review_tiles(df, 1024, 128).collect()) == want


def test_too_many_review_tiles(spark):
    df = spark.createDataFrame([("p", 100000, 100000)], "packet_id string, width int, height int")
    with pytest.raises(Exception, match="tile limit"):
        tiles.review_tiles(df, 1024, 128).collect()


def test_largest_areas_and_short_areas(spark):
    square = lambda x, s: [{"x": float(a), "y": float(b)} for a, b in ((x, 0), (x + s, 0), (x + s, s), (x, s), (x, 0))]
    polygons = spark.createDataFrame([("a", i, square(i, s)) for i, s in enumerate((1, 4, 2, 3))] + [("b", 9, square(0, 1))], "area_id string, polygon_id int, ring array<struct<x:double,y:double>>")
    areas = spark.createDataFrame([("a", 0.0, 0.0, 9.0, 9.0), ("b", 5.0, 5.0, 9.0, 9.0)], "area_id string, west double, south double, east double, north double")
    best = places.largest_areas(polygons, areas)
    assert [r["polygon_id"] for r in best.orderBy("area_rank").collect()] == [1, 3, 2]
    assert [r["area_id"] for r in places.short_areas(areas, best).collect()] == ["b"]
