"""Strict loads of run manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import schemas


class ManifestError(ValueError):
    """A manifest breaks its contract."""


def read_run_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Versioned run manifests; malformed JSON fails the job."""
    return spark.read.schema(schemas.RUN_MANIFEST).option("mode", "FAILFAST").option("multiLine", True).json(path)


def manifest_violations(manifests: DataFrame) -> DataFrame:
    """Missing or wrong required fields, one row each."""
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("contract_version").eqNullSafe("1.0.0"), "contract version is not supported"),
            F.when(F.coalesce("run_id", F.lit("")) == "", "run id is missing"),
            F.when(F.coalesce("selection_id", F.lit("")) == "", "selection id is missing"),
            F.when(F.col("grid").isNull(), "grid is missing"),
            F.when(
                F.coalesce(
                    F.exists("artifacts", lambda a: ~F.coalesce(a["sha256"].rlike("^[a-f0-9]{64}$"), F.lit(False))),
                    F.lit(True),
                ),
                "artifact checksum is not SHA-256",
            ),
            F.when(
                F.sort_array(
                    F.transform(
                        F.filter("artifacts", lambda a: a["kind"] == "aligned-raster"), lambda a: a["role"]
                    )
                ) != F.array(F.lit("after"), F.lit("before")),
                "manifest must contain one aligned raster for each role",
            ),
        )
    )
    return manifests.select("run_id", F.explode(reasons).alias("reason"))


def require_sound(manifests: DataFrame) -> DataFrame:
    """The manifests, or an error naming one breach."""
    breach = manifest_violations(manifests).first()
    if breach is not None:
        raise ManifestError(f"run {breach['run_id']}: {breach['reason']}")
    return manifests
