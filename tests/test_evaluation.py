import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import evaluation, matching

RINGS = "array<array<struct<x:double,y:double>>>"


def box(x0, y0, x1, y1):
    return [[{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]]


PREDICTED = [("match", (1, 16, 4, 19)), ("geometry", (6, 16, 8, 18)), ("water-moisture", (10, 16, 12, 18)), ("speckle", (14, 17, 15, 18)),
             ("shadow-layover", (17, 16, 19, 18)), ("registration-artifact", (21, 16, 23, 18)), ("other", (25, 16, 27, 18))]


def inputs(spark, area=(0, 0, 30, 20), predicted=PREDICTED, expected=((1, 16, 4, 19),)):
    cases = spark.createDataFrame([("c", "f", 30, 20, [1.0, 0.0, 0.0, 0.0, -1.0, 20.0], box(*area))], f"case_id string, fixture_id string, width int, height int, transform array<double>, evaluation_rings {RINGS}")
    refs = spark.createDataFrame([("c", i, box(*b), "synthetic-established") for i, b in enumerate(expected)], f"case_id string, reference long, rings {RINGS}, review_status string")
    preds = spark.createDataFrame([("c", i, n, box(*b)) for i, (n, b) in enumerate(predicted)], f"case_id string, prediction long, id string, rings {RINGS}")
    notes = spark.createDataFrame([("c", n, n, "synthetic-established") for n, _ in PREDICTED[1:]], "case_id string, candidate_id string, failure_class string, review_status string")
    return cases, refs, preds, notes


def test_golden_report(spark):
    cases, refs, preds, notes = inputs(spark)
    counts, matches, fps = evaluation.case_counts(cases, refs, preds, notes)
    rows = evaluation.set_report(counts).collect()
    assert len(rows) == 2
    for r in rows:
        assert (r["tp"], r["fp"], r["fn"]) == (1, 6, 0)
        assert (r["precision"], r["recall"], r["f1"]) == (pytest.approx(1 / 7), 1.0, 0.25)
        assert (r["evaluated_pixels"], r["pixel_tp"], r["pixel_fp"], r["pixel_fn"], r["pixel_tn"]) == (600, 9, 21, 0, 570)
        assert r["pixel_iou"] == pytest.approx(0.3) and r["mean_matched_iou"] == 1.0 and r["unclassified_fp"] == 0
    classes = evaluation.failure_class_counts(cases, fps, notes).collect()
    assert {r["failure_class"]: r["false_positive_count"] for r in classes} == dict.fromkeys(evaluation.FAILURE_CLASSES, 1)
    assert evaluation.stray_annotations(notes, fps).count() == 0
    assert evaluation.review_statuses(refs, notes).first()["review_statuses"] == ["synthetic-established"]


def test_empty_case_and_narrow_area(spark):
    cases, refs, preds, notes = inputs(spark)
    none = evaluation.with_rates(evaluation.case_counts(cases, refs.limit(0), preds.limit(0), notes.limit(0))[0]).first()
    assert none["precision"] is None and none["pixel_iou"] is None and none["mean_matched_iou"] is None and none["pixel_tn"] == 600
    cases, refs, preds, notes = inputs(spark, area=(0, 0, 5, 20))
    narrow = evaluation.case_counts(cases, refs, preds, notes)[0].first()
    assert (narrow["tp"], narrow["fp"], narrow["evaluated_pixels"]) == (1, 0, 100)


def by_recursion(overlaps, threshold):
    """Plain augmenting search, one prediction after another."""
    wishes = {}
    for (p, r), v in overlaps.items():
        if v >= threshold:
            wishes.setdefault(p, []).append((-v, r))
    taken = {}

    def place(p, tried):
        for _, r in sorted(wishes[p]):
            if r not in tried:
                tried.add(r)
                if r not in taken or place(taken[r], tried):
                    taken[r] = p
                    return True
        return False

    for p in sorted(wishes):
        place(p, set())
    return {(p, r) for r, p in taken.items()}


def test_matching_equals_recursion(spark):
    rng = random.Random(1)
    rows, want = [], set()
    for case in range(25):
        pairs = {(rng.randint(0, 9), rng.randint(0, 5)): round(rng.random(), 2) for _ in range(rng.randint(1, 22))}
        rows += [(f"c{case}", p, r, v) for (p, r), v in pairs.items()]
        want |= {(f"c{case}", p, r) for p, r in by_recursion(pairs, 0.4)}
    got = matching.match_regions(spark.createDataFrame(rows, "case_id string, prediction long, reference long, iou double"), 0.4)
    assert {tuple(x) for x in got.select("case_id", "prediction", "reference").collect()} == want


def test_copies_do_not_change_the_matching(spark):
    """Thousands of equal predictions over two overlapping references."""
    pairs = {(p, r): (0.9 if r == 0 else 0.8) for p in range(3000) for r in (0, 1)}
    pairs[(5000, 1)] = 0.95
    df = spark.createDataFrame([("c", p, r, v) for (p, r), v in pairs.items()], "case_id string, prediction long, reference long, iou double")
    assert {tuple(x)[1:] for x in matching.match_regions(df, 0.5).collect()} == by_recursion(pairs, 0.5)


def test_gate(spark):
    cases, refs, _, notes = inputs(spark)
    stamp = F.lit(None).cast("timestamp")
    refs = refs.withColumns({"region_id": F.lit("r"), "reviewer": F.lit(None).cast("string"), "reviewed_at": stamp})
    notes = notes.withColumns({"reviewer": F.lit(None).cast("string"), "reviewed_at": stamp})
    tuning = spark.createDataFrame([("x",)], "fixture_id string")
    assert evaluation.evaluation_violations(cases, refs, notes, tuning).count() == 0
    pending = refs.withColumn("review_status", F.lit("pending"))
    reasons = {r["reason"] for r in evaluation.evaluation_violations(cases, pending, notes, cases.select("fixture_id"), "pipeline-benchmark").collect()}
    assert reasons == {
        "evaluation fixture overlaps a tuning fixture", "pending labels cannot enter metrics",
        "pipeline benchmarks require domain-reviewed labels", "pipeline benchmarks require derived public SAR provenance",
    }
    assert evaluation.evaluation_violations(cases.limit(0), refs.limit(0), notes.limit(0), tuning).first()["subject"] == "set"


def test_cells_are_never_broadcast(spark):
    """A few KB on disk may hold many million cells, so no join may gather them on the driver."""
    cases, refs, preds, notes = inputs(spark)
    _, matches, fps = evaluation.case_counts(cases, refs, preds, notes)
    for df in (matches, fps, evaluation.stray_annotations(notes, fps)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    held = evaluation.region_faults(cases, refs, preds)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in held and "rightHint=(strategy=merge)" in held


def test_shapes_are_never_broadcast(spark):
    """A shape's rings are many times larger than the columns they are made of, which the estimate goes by."""
    cases, refs, preds, _ = inputs(spark)
    for shapes, key in ((refs, "reference"), (preds, "prediction")):
        plan = evaluation.pixel_polygons(shapes, cases, ["case_id", key])._jdf.queryExecution()
        assert "leftHint=(strategy=merge)" in plan.optimizedPlan().toString()
        assert "Broadcast" not in plan.executedPlan().toString()
