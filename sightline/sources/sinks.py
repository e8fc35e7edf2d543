"""Immutable run output and feature collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_run(df: DataFrame, root: str, run_id: str, table: str) -> str:
    """Publish a table of a run once; an existing run is never overwritten.

    The committer moves the files into place only when every task has finished and
    then writes ``_SUCCESS``.
    """
    path = f"{root.rstrip('/')}/{run_id}/{table}"
    df.write.mode("errorifexists").parquet(path)
    return path


def is_published(spark: SparkSession, path: str) -> bool:
    """Whether the folder holds a finished write."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def read_run(spark: SparkSession, root: str, run_id: str, table: str) -> DataFrame:
    path = f"{root.rstrip('/')}/{run_id}/{table}"
    if not is_published(spark, path):
        raise FileNotFoundError(f"run output is not complete: {path}")
    return spark.read.parquet(path)


def feature_json(identifier: Column, rings: Column, properties: Column) -> Column:
    """One GeoJSON polygon feature as text."""
    coordinates = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"), identifier.alias("id"),
            F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
            properties.alias("properties"),
        )
    )


def features(rings: DataFrame, measures: DataFrame) -> DataFrame:
    """Feature text of every candidate: outer ring first, then its holes."""
    shaped = rings.groupBy("run_id", "label").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("is_hole", "ring", "points"))), lambda s: s["points"]
        ).alias("_rings")
    )
    properties = [c for c in measures.columns if c not in ("run_id", "label")]
    return measures.join(shaped, ["run_id", "label"]).select(
        "run_id", "label", "candidate_id",
        feature_json(F.col("candidate_id"), F.col("_rings"), F.struct(*properties)).alias("feature"),
    )


def write_features(feature_rows: DataFrame, path: str) -> None:
    """Feature lines, one folder per run."""
    feature_rows.select("run_id", F.col("feature").alias("value")).write.mode("errorifexists").partitionBy(
        "run_id"
    ).text(path)
