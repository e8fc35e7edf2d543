"""Assessment log as a stream: intake, exactly-once append, supersession, current view.

Order is arrival order: batch after batch, and by ``seq`` inside a batch.  An event that names anything
but the current event of its candidate is a conflict, however late or early it is; there is no late merge.

Decisions and views are kept as one folder per batch under a shared path.  A batch that runs again after
a failure writes the same folder again, so nothing is counted twice, and a view is never deleted before
its successor is whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from sightline.operators.review import check_drafts, current_assessments, decide_drafts

OUTCOMES = ("accepted", "replay", "conflict", "unknown-candidate")


def table_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table as a stream, whether it is one file or a folder of files.

    A file source takes a plain path for a folder; written as a pattern, it also takes a file.
    """
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def intake(drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a stream of drafts into sound ones and rejects with their problem."""
    checked = check_drafts(drafts)
    return checked.where(F.col("problem").isNull()).drop("problem"), checked.where(F.col("problem").isNotNull())


def first_requests(drafts: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Drop repeated request ids seen within ``delay``; state stays bounded."""
    return drafts.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["bundle_id", "request_id"])


def _with(schema: StructType, **columns: str) -> StructType:
    """``schema`` and more columns, as a new type."""
    return StructType([*schema.fields, *StructType.fromDDL(", ".join(f"{n} {t}" for n, t in columns.items())).fields])


def _batches(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All batch folders with their number in ``batch``."""
    return spark.read.schema(_with(schema, batch="bigint")).option("basePath", folder).parquet(folder)


def decide(drafts: DataFrame, candidates: DataFrame, folder: str) -> DataStreamWriter:
    """A writer that appends the decision on every draft to ``folder``; read it with ``decisions``.

    Each batch is one ``decide_drafts`` over its drafts, the current events left by the batch before and the
    request ids accepted so far.  The requests are those of the batch only: a join on them reads the
    accepted part of the log, and no state grows in memory.
    """
    schema = _with(drafts.schema, event_id="string", outcome="string")
    current_schema = "bundle_id string, candidate_id string, event_id string"
    known = candidates.select("bundle_id", "candidate_id")

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        log = f"{folder}/decisions"
        requests = current = None
        if number:
            current = spark.read.schema(current_schema).parquet(f"{folder}/current/batch={number - 1}")
            accepted = _batches(spark, log, schema).where(F.col("batch") < number).where("outcome = 'accepted'")
            asked = batch.select("bundle_id", "request_id").distinct()
            requests = accepted.join(asked, ["bundle_id", "request_id"], "left_semi").select("bundle_id", "request_id", "event_id")
        decide_drafts(batch, known, current, requests).write.mode("overwrite").parquet(f"{log}/batch={number}")
        made = spark.read.schema(schema).parquet(f"{log}/batch={number}").where("outcome = 'accepted'")
        latest = made.groupBy("bundle_id", "candidate_id").agg(F.max_by("event_id", "seq").alias("event_id"))
        if current is not None:
            kept = current.join(latest.select("bundle_id", "candidate_id"), ["bundle_id", "candidate_id"], "left_anti")
            latest = latest.unionByName(kept)
        latest.write.mode("overwrite").parquet(f"{folder}/current/batch={number}")

    return drafts.writeStream.foreachBatch(append).option("checkpointLocation", f"{folder}/progress")


def decisions(spark: SparkSession, folder: str, drafts: DataFrame) -> DataFrame:
    """All decisions that ``decide`` has written for this stream."""
    return _batches(spark, f"{folder}/decisions", _with(drafts.schema, event_id="string", outcome="string")).drop("batch")


def keep_current(events: DataFrame, folder: str) -> DataStreamWriter:
    """A writer that keeps the current event of every candidate; read it with ``current_view``.

    A batch is folded first and merged with the view before it, so its work follows the batch and the
    number of candidates, not the length of the log.
    """
    schema = events.schema

    def merge(batch: DataFrame, number: int) -> None:
        rows = current_assessments(batch)
        if number:
            rows = current_assessments(rows.unionByName(batch.sparkSession.read.schema(schema).parquet(f"{folder}/view/batch={number - 1}")))
        rows.write.mode("overwrite").parquet(f"{folder}/view/batch={number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/progress")


def current_view(spark: SparkSession, folder: str, events: DataFrame) -> DataFrame:
    """The newest whole view that ``keep_current`` has written."""
    parts = _batches(spark, f"{folder}/view", events.schema)
    last = parts.agg(F.max("batch")).first()[0]
    return parts.where(F.col("batch") == F.lit(last)).drop("batch")
