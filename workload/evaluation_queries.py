"""Region evaluation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.projection import utm_to_lonlat
from sightline.operators import evaluation, matching
from workload.registry import Inputs, query

R6 = lambda c: F.bround(c, 6)


def _box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A pixel-unit box kept off cell centres, as one ring in map units (y up)."""
    spot = lambda a, b: F.struct((a + 0.25).cast("double").alias("x"), (-(b + 0.25)).cast("double").alias("y"))
    return F.array(F.array(spot(x, y), spot(x + w, y), spot(x + w, y + h), spot(x, y + h)))


def cases(t: Inputs) -> DataFrame:
    zero, c = F.lit(0), F.col
    transform = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)])
    return t.v_case.select(
        "case_id", "fixture_id", "width", "height", transform.alias("transform"),
        _box(zero, zero, c("eval_w"), c("eval_h")).alias("evaluation_rings"),
    ).withColumn("case_id", c("case_id").cast("string"))


def _shapes(df: DataFrame, *keep: str) -> DataFrame:
    rings = _box(F.col("x0"), F.col("y0"), F.col("w"), F.col("h"))
    return df.select(F.col("case_id").cast("string").alias("case_id"), *keep, rings.alias("rings"))


def references(t: Inputs) -> DataFrame:
    return _shapes(t.v_ref, "reference", "review_status")


def predictions(t: Inputs) -> DataFrame:
    return _shapes(t.v_pred, "prediction", "id")


def annotations(t: Inputs) -> DataFrame:
    return t.v_annotation.withColumn("case_id", F.col("case_id").cast("string"))


# A box from x to x+w shifted by a quarter covers the cells x .. x+w-1 (centre at +0.5).
_AREA = "greatest(least({a}.x0 + {a}.w, 62) - {a}.x0, 0) * greatest(least({a}.y0 + {a}.h, 46) - {a}.y0, 0)"
_IOU = f"""
    raw AS (SELECT p.case_id, p.prediction, r.reference, p.id,
              greatest(least(p.x0 + p.w, r.x0 + r.w, 62) - greatest(p.x0, r.x0), 0) * greatest(least(p.y0 + p.h, r.y0 + r.h, 46) - greatest(p.y0, r.y0), 0) AS intersection,
              {_AREA.format(a='p')} AS pa, {_AREA.format(a='r')} AS ra
            FROM {{v_pred}} p JOIN {{v_ref}} r ON p.case_id = r.case_id),
    overlap AS (SELECT case_id, prediction, reference, id, intersection, pa + ra - intersection AS union_area,
                intersection / (pa + ra - intersection) AS iou FROM raw WHERE intersection > 0)"""
# References never overlap and no prediction is half of two of them, so a reference
# goes to the first prediction that clears the threshold.
_MATCH = f"""{_IOU},
    matches AS (SELECT case_id, reference, min(prediction) AS prediction FROM overlap WHERE iou >= 0.5 GROUP BY case_id, reference),
    scored AS (SELECT m.case_id, m.prediction, m.reference, o.iou FROM matches m JOIN overlap o
               ON m.case_id = o.case_id AND m.prediction = o.prediction AND m.reference = o.reference),
    live AS (SELECT case_id, prediction, id FROM {{v_pred}} p WHERE {_AREA.format(a='p')} > 0),
    fps AS (SELECT l.* FROM live l WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.case_id = l.case_id AND m.prediction = l.prediction))"""


@query("region_overlaps", f"WITH {_IOU} SELECT CAST(case_id AS STRING) AS case_id, prediction, reference, CAST(intersection AS BIGINT) AS intersection, CAST(union_area AS BIGINT) AS union_area, round_even(iou, 6) AS iou FROM overlap")
def region_overlaps(t: Inputs) -> DataFrame:
    cs = cases(t)
    _, expected, predicted = evaluation.cell_tables(cs, references(t), predictions(t))
    return evaluation.overlaps(predicted, expected).withColumn("iou", R6("iou"))


def _on_earth(df: DataFrame, column: str) -> DataFrame:
    """Rings of pixel units placed on a 2 m grid of zone 12 and written as longitudes and latitudes."""
    return df.withColumn(
        column,
        F.transform(column, lambda r: F.transform(r, lambda p: utm_to_lonlat(400000 + 2 * p["x"], 4480000 + 2 * p["y"], 32612))),
    )


@query("lonlat_overlaps", f"WITH {_IOU} SELECT CAST(case_id AS STRING) AS case_id, prediction, reference, CAST(intersection AS BIGINT) AS intersection, CAST(union_area AS BIGINT) AS union_area, round_even(iou, 6) AS iou FROM overlap")
def lonlat_overlaps(t: Inputs) -> DataFrame:
    """The overlaps when all geometry is in degrees and the grids are in metres."""
    transform = F.array(*[F.lit(v) for v in (2.0, 0.0, 400000.0, 0.0, -2.0, 4480000.0)])
    cs = _on_earth(cases(t), "evaluation_rings").withColumns(
        {"transform": transform, "geometry_crs": F.lit("EPSG:4326"), "grid_crs": F.lit("EPSG:32612")}
    )
    _, expected, predicted = evaluation.cell_tables(cs, _on_earth(references(t), "rings"), _on_earth(predictions(t), "rings"))
    return evaluation.overlaps(predicted, expected).withColumn("iou", R6("iou"))


@query(
    "region_faults",
    f"""SELECT CAST(case_id AS STRING) AS case_id, CAST(reference AS STRING) AS subject, 'reference region covers no evaluated pixel' AS reason
        FROM (SELECT case_id, reference, x0 + CASE WHEN reference % 7 = 0 THEN 62 ELSE 0 END AS x0, y0, w, h FROM {{v_ref}}) r WHERE {_AREA.format(a='r')} <= 0
        UNION ALL SELECT CAST(case_id AS STRING), id, 'candidate IDs must be unique within a case' FROM
          (SELECT case_id, CASE WHEN prediction % 10 = 1 THEN concat('cand-', CAST(prediction - 1 AS STRING)) ELSE id END AS id FROM {{v_pred}}) p GROUP BY case_id, id HAVING count(*) > 1""",
)
def region_faults(t: Inputs) -> DataFrame:
    """Every seventh region moved off the evaluated area, every tenth id used again."""
    away = t.v_ref.withColumn("x0", F.col("x0") + F.when(F.col("reference") % 7 == 0, 62).otherwise(0))
    again = F.when(F.col("prediction") % 10 == 1, F.concat(F.lit("cand-"), (F.col("prediction") - 1).cast("string"))).otherwise(F.col("id"))
    return evaluation.region_faults(cases(t), _shapes(away, "reference"), predictions(t).withColumn("id", again))


def _counts(t: Inputs):
    return evaluation.case_counts(cases(t), references(t), predictions(t), annotations(t))


@query("region_matches", f"WITH {_MATCH} SELECT CAST(case_id AS STRING) AS case_id, prediction, reference, round_even(iou, 6) AS iou FROM scored")
def region_matches(t: Inputs) -> DataFrame:
    _, matches, _ = _counts(t)
    return matches.withColumn("iou", R6("iou"))


@query("tangled_matches")
def tangled_matches(t: Inputs) -> DataFrame:
    """Matching at a low threshold with references that overlap each other."""
    cs = cases(t)
    wide = _shapes(t.v_ref.withColumns({"w": F.col("w") + 10, "x0": F.col("x0") - 1}), "reference")
    _, expected, predicted = evaluation.cell_tables(cs, wide, predictions(t))
    return matching.match_regions(evaluation.overlaps(predicted, expected), 0.1)


_CASE = f"""{_MATCH},
    cells AS (SELECT case_id, x, y FROM {{v_case}}, (SELECT unnest(range(62)) AS x) a, (SELECT unnest(range(46)) AS y) b),
    marks AS (SELECT c.case_id, EXISTS (SELECT 1 FROM {{v_pred}} p WHERE p.case_id = c.case_id AND x >= p.x0 AND x < p.x0 + p.w AND y >= p.y0 AND y < p.y0 + p.h) AS p,
              EXISTS (SELECT 1 FROM {{v_ref}} r WHERE r.case_id = c.case_id AND x >= r.x0 AND x < r.x0 + r.w AND y >= r.y0 AND y < r.y0 + r.h) AS e FROM cells c),
    px AS (SELECT case_id, count(*) AS evaluated_pixels, count(*) FILTER (WHERE p AND e) AS pixel_tp, count(*) FILTER (WHERE p AND NOT e) AS pixel_fp,
           count(*) FILTER (WHERE e AND NOT p) AS pixel_fn, count(*) FILTER (WHERE NOT e AND NOT p) AS pixel_tn FROM marks GROUP BY case_id),
    counted AS (SELECT CAST(c.case_id AS STRING) AS case_id,
        (SELECT count(*) FROM scored s WHERE s.case_id = c.case_id) AS tp,
        (SELECT count(*) FROM fps f WHERE f.case_id = c.case_id) AS fp,
        (SELECT count(*) FROM {{v_ref}} r WHERE r.case_id = c.case_id) - (SELECT count(*) FROM scored s WHERE s.case_id = c.case_id) AS fn,
        evaluated_pixels, pixel_tp, pixel_fp, pixel_fn, pixel_tn,
        coalesce((SELECT sum(iou) FROM scored s WHERE s.case_id = c.case_id), 0) AS iou_sum,
        (SELECT count(*) FROM fps f WHERE f.case_id = c.case_id AND NOT EXISTS (SELECT 1 FROM {{v_annotation}} n WHERE n.case_id = f.case_id AND n.candidate_id = f.id)) AS unclassified_fp
        FROM {{v_case}} c JOIN px ON px.case_id = c.case_id)"""
_RATES = """round_even(tp / nullif(tp + fp, 0), 6) AS precision_rate, round_even(tp / nullif(tp + fn, 0), 6) AS recall_rate,
    round_even(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round_even(pixel_tp / nullif(pixel_tp + pixel_fp + pixel_fn, 0), 6) AS pixel_iou,
    round_even(iou_sum / nullif(tp, 0), 6) AS mean_matched_iou"""
_SUMS = "tp, fp, fn, evaluated_pixels, pixel_tp, pixel_fp, pixel_fn, pixel_tn, unclassified_fp"


def _report(df: DataFrame) -> DataFrame:
    return df.select(
        "case_id", *_SUMS.split(", "), R6("precision").alias("precision_rate"), R6("recall").alias("recall_rate"), R6("f1").alias("f1"),
        R6("pixel_iou").alias("pixel_iou"), R6("mean_matched_iou").alias("mean_matched_iou"),
    )


@query("case_report", f"WITH {_CASE} SELECT case_id, {_SUMS}, {_RATES} FROM counted")
def case_report(t: Inputs) -> DataFrame:
    counts, _, _ = _counts(t)
    return _report(evaluation.with_rates(counts))


@query(
    "set_report",
    f"""WITH {_CASE}, summed AS (SELECT case_id, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _SUMS.split(', '))}, sum(iou_sum) AS iou_sum
        FROM counted GROUP BY ROLLUP (case_id)) SELECT case_id, {_SUMS}, {_RATES} FROM summed""",
)
def set_report(t: Inputs) -> DataFrame:
    counts, _, _ = _counts(t)
    return _report(evaluation.set_report(counts))


@query(
    "failure_classes",
    f"""WITH {_MATCH} SELECT CAST(c.case_id AS STRING) AS case_id, k.failure_class, count(n.candidate_id) AS false_positive_count
        FROM {{v_case}} c CROSS JOIN (SELECT unnest(['geometry', 'water-moisture', 'speckle', 'shadow-layover', 'registration-artifact', 'other']) AS failure_class) k
        LEFT JOIN (SELECT a.* FROM {{v_annotation}} a JOIN fps f ON f.case_id = a.case_id AND f.id = a.candidate_id) n
          ON n.case_id = c.case_id AND n.failure_class = k.failure_class GROUP BY c.case_id, k.failure_class""",
)
def failure_classes(t: Inputs) -> DataFrame:
    _, _, fps = _counts(t)
    return evaluation.failure_class_counts(cases(t), fps, annotations(t))


@query(
    "stray_annotations",
    f"""WITH {_MATCH} SELECT CAST(a.case_id AS STRING) AS case_id, a.candidate_id FROM {{v_annotation}} a
        WHERE NOT EXISTS (SELECT 1 FROM fps f WHERE f.case_id = a.case_id AND f.id = a.candidate_id)""",
)
def stray_annotations(t: Inputs) -> DataFrame:
    _, _, fps = _counts(t)
    return evaluation.stray_annotations(annotations(t), fps).select("case_id", "candidate_id")


@query(
    "review_statuses",
    """SELECT CAST(case_id AS STRING) AS case_id, string_agg(DISTINCT review_status, ',' ORDER BY review_status) AS statuses FROM (
       SELECT case_id, review_status FROM {v_ref} UNION ALL SELECT case_id, review_status FROM {v_annotation}) x GROUP BY case_id""",
)
def review_statuses(t: Inputs) -> DataFrame:
    out = evaluation.review_statuses(references(t), annotations(t))
    return out.select("case_id", F.array_join("review_statuses", ",").alias("statuses"))


_TUNING = "SELECT concat('fixture-', CAST(CAST(floor(s_suppkey / 10) AS BIGINT) AS STRING)) AS fixture_id FROM {supplier} WHERE s_suppkey % 30 = 0"


@query("tuning_overlap", f"""SELECT CAST(case_id AS STRING) AS case_id, fixture_id FROM {{v_case}} WHERE fixture_id IN (SELECT fixture_id FROM ({_TUNING}) t)""")
def tuning_overlap(t: Inputs) -> DataFrame:
    return evaluation.tuning_overlap(cases(t), t.sql(_TUNING)).select("case_id", "fixture_id")


@query(
    "evaluation_gate",
    f"""SELECT reason, count(*) AS n FROM (
        SELECT 'evaluation fixture overlaps a tuning fixture' AS reason FROM {{v_case}} WHERE fixture_id IN (SELECT fixture_id FROM ({_TUNING}) t)
        UNION ALL SELECT 'pending labels cannot enter metrics' FROM {{v_annotation}} WHERE review_status = 'pending'
        UNION ALL SELECT 'reviewed labels require reviewer and reviewed_at' FROM {{v_ref}} WHERE reference % 7 = 0
        UNION ALL SELECT 'unreviewed labels cannot name a reviewer' FROM {{v_annotation}} WHERE review_status = 'pending'
        UNION ALL SELECT 'pipeline benchmarks require domain-reviewed labels' FROM {{v_ref}} WHERE review_status <> 'domain-reviewed'
        UNION ALL SELECT 'pipeline benchmarks require domain-reviewed labels' FROM {{v_annotation}} WHERE review_status <> 'domain-reviewed') v GROUP BY reason""",
)
def evaluation_gate(t: Inputs) -> DataFrame:
    regions = references(t).select(
        "case_id", F.col("reference").cast("string").alias("region_id"), "review_status",
        F.when(F.col("reference") % 7 != 0, "r").alias("reviewer"), F.lit("2026-01-01").cast("timestamp").alias("reviewed_at"),
    )
    marks = annotations(t).withColumns({"reviewer": F.lit("r"), "reviewed_at": F.lit("2026-01-01").cast("timestamp")})
    found = evaluation.evaluation_violations(
        cases(t), regions, marks, t.sql(_TUNING), "pipeline-benchmark", "derived-public-sar"
    )
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prediction_scan",
    """SELECT CAST(case_id AS STRING) AS case_id, CASE WHEN case_id % 4 = 3 THEN 'prediction collection type must be FeatureCollection' END AS problem, id, 5 AS points FROM {v_pred}""",
)
def prediction_scan(t: Inputs) -> DataFrame:
    """Predictions read back from collections of at most two hundred features."""
    coordinates = F.transform("rings", lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(p["x"], p["y"])))
    feature = F.struct(
        F.lit("Feature").alias("type"), F.col("id"),
        F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
    )
    kind = F.when(F.col("case_id").cast("bigint") % 4 == 3, "Feature").otherwise("FeatureCollection")
    documents = predictions(t).groupBy("case_id").agg(F.collect_list(feature).alias("features")).select(
        "case_id", F.to_json(F.struct(kind.alias("type"), "features")).alias("body")
    )
    return evaluation.read_predictions(t.spark, documents).select(
        "case_id", "problem", "id", F.size(F.col("rings")[0]).alias("points")
    )
