"""Evaluation of predicted regions against reference labels, all cases in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.projection import project_by
from sightline.functions.scalars import computed_once, rate
from sightline.operators.matching import match_regions
from sightline.operators.raster import rasterize, ring_to_pixels
from sightline.session import reliable_checkpoint, spread

# Failure classes of a false positive: fixed values.
FAILURE_CLASSES = (
    "geometry", "water-moisture", "speckle", "shadow-layover", "registration-artifact", "other",
)


def pixel_polygons(shapes: DataFrame, cases: DataFrame, keys: list[str]) -> DataFrame:
    """Shapes of a case in pixel units of its grid, ready to rasterize.

    ``shapes(case_id, …, rings)``; ``cases(case_id, width, height, transform)``.  With ``geometry_crs`` and
    ``grid_crs`` among the cases' columns, geometry moves from the one to the other first, case by case.
    """
    systems = [c for c in ("geometry_crs", "grid_crs") if c in cases.columns]
    g = cases.select("case_id", "width", "height", "transform", *systems)
    rings = F.col("rings")
    if len(systems) == 2:
        rings = F.transform(rings, lambda r: F.transform(r, lambda p: project_by(p["x"], p["y"], F.col("geometry_crs"), F.col("grid_crs"))))
    # Rings are many times larger than their estimate, so shapes are not broadcast; cases have one row each.
    return spread(shapes).join(g, "case_id").select(
        *keys, "width", "height", computed_once(F.transform(rings, lambda r: ring_to_pixels(r, F.col("transform")))).alias("rings"),
    )


def evaluated_cells(cases: DataFrame) -> DataFrame:
    """Cells inside each case's evaluation geometry."""
    shapes = cases.select("case_id", F.col("evaluation_rings").alias("rings"))
    return rasterize(pixel_polygons(shapes, cases, ["case_id"]), ["case_id"])


def clipped_cells(shapes: DataFrame, cases: DataFrame, evaluated: DataFrame, key: str) -> DataFrame:
    """Cells of each shape inside the evaluated geometry."""
    cells = rasterize(pixel_polygons(shapes, cases, ["case_id", key]), ["case_id", key])
    return cells.join(evaluated, ["case_id", "row", "col"], "left_semi")


def cell_tables(cases: DataFrame, regions: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells that are evaluated, expected and predicted, each written once for all that read them."""
    evaluated = spread(reliable_checkpoint(evaluated_cells(cases)))
    expected = spread(reliable_checkpoint(clipped_cells(regions, cases, evaluated, "reference")))
    predicted = spread(reliable_checkpoint(clipped_cells(predictions, cases, evaluated, "prediction")))
    return evaluated, expected, predicted


def overlaps(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """Intersection, union and IoU of every overlapping (prediction, reference)."""
    shared = (
        predicted.join(expected, ["case_id", "row", "col"])
        .groupBy("case_id", "prediction", "reference").agg(F.count(F.lit(1)).alias("intersection"))
    )
    p_area = predicted.groupBy("case_id", "prediction").agg(F.count(F.lit(1)).alias("_p"))
    r_area = expected.groupBy("case_id", "reference").agg(F.count(F.lit(1)).alias("_r"))
    return (
        shared.join(p_area, ["case_id", "prediction"]).join(r_area, ["case_id", "reference"])
        .withColumn("union_area", F.col("_p") + F.col("_r") - F.col("intersection"))
        .select(
            "case_id", "prediction", "reference", "intersection", "union_area",
            (F.col("intersection") / F.col("union_area")).alias("iou"),
        )
    )


def pixel_counts(evaluated: DataFrame, predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """TP/FP/FN/TN cells per case from one grouped pass over the three masks."""
    def flagged(df: DataFrame, e: bool, p: bool, x: bool) -> DataFrame:
        return df.select("case_id", "row", "col", F.lit(e).alias("e"), F.lit(p).alias("p"), F.lit(x).alias("x"))

    cells = (
        flagged(evaluated, True, False, False)
        .unionAll(flagged(predicted, False, True, False))
        .unionAll(flagged(expected, False, False, True))
        .groupBy("case_id", "row", "col")
        .agg(F.bool_or("e").alias("e"), F.bool_or("p").alias("p"), F.bool_or("x").alias("x"))
    )
    return cells.groupBy("case_id").agg(
        F.count_if("e").alias("evaluated_pixels"),
        F.count_if(F.expr("p AND x")).alias("pixel_tp"),
        F.count_if(F.expr("p AND NOT x")).alias("pixel_fp"),
        F.count_if(F.expr("NOT p AND x")).alias("pixel_fn"),
        F.count_if(F.expr("e AND NOT p AND NOT x")).alias("pixel_tn"),
    )


COUNTS = (
    "tp", "fp", "fn", "evaluated_pixels", "pixel_tp", "pixel_fp", "pixel_fn", "pixel_tn",
    "matched_regions", "reference_regions", "matched_iou_sum", "unclassified_fp",
)


def region_faults(cases: DataFrame, regions: DataFrame, predictions: DataFrame) -> DataFrame:
    """``(case_id, subject, reason)``: what must not enter a report.

    Candidate ids that repeat within a case, and reference regions without a pixel in the evaluated area.
    """
    evaluated = spread(reliable_checkpoint(evaluated_cells(cases)))
    held = clipped_cells(regions, cases, evaluated, "reference").select("case_id", "reference").distinct()
    hollow = regions.join(held, ["case_id", "reference"], "left_anti")
    twice = duplicates(predictions, ["case_id", "id"])
    return hollow.select(
        "case_id", F.col("reference").cast("string").alias("subject"), F.lit("reference region covers no evaluated pixel").alias("reason")
    ).unionByName(twice.select("case_id", F.col("id").alias("subject"), F.lit("candidate IDs must be unique within a case").alias("reason")))


def case_counts(
    cases: DataFrame, regions: DataFrame, predictions: DataFrame, annotations: DataFrame,
    threshold: float = 0.5,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw counts per case, the matches, and the false positives.

    ``regions(case_id, reference, rings)``, ``predictions(case_id, prediction, id, rings)``
    with integer positions in ``reference`` and ``prediction``.
    """
    evaluated, expected, predicted = cell_tables(cases, regions, predictions)
    iou = spread(reliable_checkpoint(overlaps(predicted, expected)))
    matches = spread(reliable_checkpoint(match_regions(iou, threshold))).join(
        iou.select("case_id", "prediction", "reference", "iou"), ["case_id", "prediction", "reference"]
    )
    live = predicted.select("case_id", "prediction").distinct()
    unmatched = spread(live.join(matches, ["case_id", "prediction"], "left_anti"))
    false_positives = spread(unmatched.join(predictions.select("case_id", "prediction", "id"), ["case_id", "prediction"]))
    matched = matches.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("matched_regions"), F.sum("iou").alias("matched_iou_sum")
    )
    live_n = live.groupBy("case_id").agg(F.count(F.lit(1)).alias("_live"))
    refs_n = regions.groupBy("case_id").agg(F.count(F.lit(1)).alias("reference_regions"))
    classed = (
        false_positives.join(
            annotations.select("case_id", F.col("candidate_id").alias("id")).distinct(), ["case_id", "id"], "left_semi"
        ).groupBy("case_id").agg(F.count(F.lit(1)).alias("_classed"))
    )
    counts = (
        cases.select("case_id", "fixture_id")
        .join(pixel_counts(evaluated, predicted, expected), "case_id", "left")
        .join(matched, "case_id", "left").join(live_n, "case_id", "left")
        .join(refs_n, "case_id", "left").join(classed, "case_id", "left").na.fill(0)
        .withColumn("tp", F.col("matched_regions"))
        .withColumn("fp", F.col("_live") - F.col("matched_regions"))
        .withColumn("fn", F.col("reference_regions") - F.col("matched_regions"))
        .withColumn("unclassified_fp", F.col("_live") - F.col("matched_regions") - F.col("_classed"))
        .select("case_id", "fixture_id", *COUNTS)
    )
    return counts, matches, false_positives


def with_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, pixel IoU and mean matched IoU; empty ratios are NULL."""
    c = F.col
    return counts.withColumns(
        {
            "precision": rate(c("tp"), c("tp") + c("fp")),
            "recall": rate(c("tp"), c("tp") + c("fn")),
            "f1": rate(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")),
            "pixel_precision": rate(c("pixel_tp"), c("pixel_tp") + c("pixel_fp")),
            "pixel_recall": rate(c("pixel_tp"), c("pixel_tp") + c("pixel_fn")),
            "pixel_iou": rate(c("pixel_tp"), c("pixel_tp") + c("pixel_fp") + c("pixel_fn")),
            "pixel_f1": rate(2 * c("pixel_tp"), 2 * c("pixel_tp") + c("pixel_fp") + c("pixel_fn")),
            "mean_matched_iou": rate(c("matched_iou_sum"), c("matched_regions")),
        }
    )


def set_report(counts: DataFrame) -> DataFrame:
    """Case rows and the micro-average over all cases (``case_id`` NULL)."""
    sums = counts.rollup("case_id").agg(*[F.sum(name).alias(name) for name in COUNTS])
    return with_rates(sums)


def failure_class_counts(cases: DataFrame, false_positives: DataFrame, annotations: DataFrame) -> DataFrame:
    """Zero-filled class counts per case over the six fixed classes."""
    classes = F.explode(F.array(*[F.lit(name) for name in FAILURE_CLASSES])).alias("failure_class")
    grid = cases.select("case_id", classes)
    seen = (
        false_positives.select("case_id", F.col("id").alias("candidate_id"))
        .join(annotations.select("case_id", "candidate_id", "failure_class"), ["case_id", "candidate_id"])
        .groupBy("case_id", "failure_class").agg(F.count(F.lit(1)).alias("_n"))
    )
    return grid.join(seen, ["case_id", "failure_class"], "left").select(
        "case_id", "failure_class", F.coalesce("_n", F.lit(0)).cast("bigint").alias("false_positive_count")
    )


def review_statuses(regions: DataFrame, annotations: DataFrame) -> DataFrame:
    both = regions.select("case_id", "review_status").unionAll(annotations.select("case_id", "review_status"))
    return both.groupBy("case_id").agg(F.sort_array(F.collect_set("review_status")).alias("review_statuses"))


def stray_annotations(annotations: DataFrame, false_positives: DataFrame) -> DataFrame:
    """Annotations that name a candidate which is not a false positive."""
    return annotations.join(
        false_positives.select("case_id", F.col("id").alias("candidate_id")), ["case_id", "candidate_id"], "left_anti"
    )


def tuning_overlap(cases: DataFrame, tuning: DataFrame) -> DataFrame:
    return cases.select("case_id", "fixture_id").join(tuning.select("fixture_id"), "fixture_id", "left_semi")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def _violation(df: DataFrame, subject: Column, reason: str) -> DataFrame:
    return df.select(subject.cast("string").alias("subject"), F.lit(reason).alias("reason"))


def evaluation_violations(
    cases: DataFrame, regions: DataFrame, annotations: DataFrame, tuning: DataFrame,
    purpose: str = "software-verification", source_kind: str = "synthetic",
) -> DataFrame:
    """Every reason an evaluation set may not be scored; empty when it may."""
    labels = regions.select(
        "case_id", F.col("region_id").alias("id"), "review_status", "reviewer", "reviewed_at"
    ).unionAll(
        annotations.select("case_id", F.col("candidate_id").alias("id"), "review_status", "reviewer", "reviewed_at")
    )
    name = F.concat_ws("/", "case_id", "id")
    reviewed = F.col("review_status").isin("engineering-reviewed", "domain-reviewed")
    unsigned = F.col("reviewer").isNull() | F.col("reviewed_at").isNull()
    signed = F.col("reviewer").isNotNull() | F.col("reviewed_at").isNotNull()
    too_big = F.col("width").cast("bigint") * F.col("height") > 25_000_000
    checks = [
        _violation(duplicates(cases, ["case_id"]), F.col("case_id"), "evaluation case IDs must be unique"),
        _violation(duplicates(cases, ["fixture_id"]), F.col("fixture_id"), "evaluation fixture IDs must be unique"),
        _violation(duplicates(regions, ["case_id", "region_id"]), F.concat_ws("/", "case_id", "region_id"),
                   "reference region IDs must be unique within a case"),
        _violation(duplicates(annotations, ["case_id", "candidate_id"]), F.concat_ws("/", "case_id", "candidate_id"),
                   "annotation IDs must be unique within a case"),
        _violation(tuning_overlap(cases, tuning), F.col("fixture_id"), "evaluation fixture overlaps a tuning fixture"),
        _violation(cases.where(too_big), F.col("case_id"), "evaluation grid exceeds 25 million pixels"),
        _violation(labels.where(F.col("review_status") == "pending"), name, "pending labels cannot enter metrics"),
        _violation(labels.where(reviewed & unsigned), name, "reviewed labels require reviewer and reviewed_at"),
        _violation(labels.where(~reviewed & signed), name, "unreviewed labels cannot name a reviewer"),
    ]
    if purpose == "pipeline-benchmark":
        checks.append(
            _violation(labels.where(F.col("review_status") != "domain-reviewed"), name,
                       "pipeline benchmarks require domain-reviewed labels")
        )
        if source_kind != "derived-public-sar":
            checks.append(
                _violation(cases, F.col("case_id"), "pipeline benchmarks require derived public SAR provenance")
            )
    empty = cases.limit(1).agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    checks.append(_violation(empty, F.lit("set"), "evaluation set must contain at least one case"))
    out = checks[0]
    for check in checks[1:]:
        out = out.unionAll(check)
    return out


def read_predictions(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Prediction collections ``(case_id, body)`` to ``(case_id, prediction, id, rings)``."""
    from sightline import schemas
    from sightline.functions.geometry import drop_altitude

    parsed = documents.withColumn("_d", F.from_json("body", schemas.PREDICTION_PAGE))
    fault = F.when(
        ~F.col("_d.type").eqNullSafe("FeatureCollection"), "prediction collection type must be FeatureCollection"
    )
    rows = parsed.withColumn("problem", fault).select(
        "case_id", "problem", F.posexplode_outer("_d.features").alias("prediction", "_f")
    )
    return rows.select(
        "case_id", "problem", F.col("prediction").cast("bigint").alias("prediction"), F.col("_f.id").alias("id"),
        drop_altitude(F.col("_f.geometry.coordinates")).alias("rings"),
    )
