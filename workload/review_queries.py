"""Assessment-log queries, as tables and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators import review
from sightline.session import checkpoint_folder
from sightline.streaming import assessments
from workload.registry import Inputs, query
from workload.views import VIEWS

_PROBLEM = """CASE WHEN disposition = 'undecided' THEN 'Choose a valid assessment action.'
    WHEN disposition = 'needs-context' AND note = '' THEN 'Add a note describing the context needed.' END"""


@query("checked_drafts", f"SELECT seq, trim(note) AS note, {_PROBLEM} AS problem FROM {{v_evt}}")
def checked_drafts(t: Inputs) -> DataFrame:
    return review.check_drafts(t.v_evt).select("seq", "note", "problem")


@query(
    "first_requests",
    "SELECT bundle_id, request_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id, request_id ORDER BY seq) AS n FROM {v_evt}) x WHERE n = 1",
)
def first_requests(t: Inputs) -> DataFrame:
    return review.first_of_request(t.v_evt).select("bundle_id", "request_id", "seq")


_CURRENT = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bundle_id, candidate_id ORDER BY seq DESC) AS n FROM {v_evt}) x WHERE n = 1"


@query("current_assessments", f"SELECT bundle_id, candidate_id, event_id, disposition FROM ({_CURRENT}) c")
def current(t: Inputs) -> DataFrame:
    return review.current_assessments(t.v_evt).select("bundle_id", "candidate_id", "event_id", "disposition")


@query(
    "assessment_history",
    """SELECT candidate_id, event_id, row_number() OVER (PARTITION BY bundle_id, candidate_id ORDER BY seq) AS position,
       seq = max(seq) OVER (PARTITION BY bundle_id, candidate_id) AS is_latest FROM {v_evt}""",
)
def assessment_history(t: Inputs) -> DataFrame:
    return review.assessment_history(t.v_evt).select("candidate_id", "event_id", "position", "is_latest")


@query(
    "unresolved_candidates",
    "SELECT bundle_id, candidate_id FROM {v_cand} c WHERE NOT EXISTS (SELECT 1 FROM {v_evt} e WHERE e.bundle_id = c.bundle_id AND e.candidate_id = c.candidate_id)",
)
def unresolved_candidates(t: Inputs) -> DataFrame:
    return review.unresolved(t.v_cand, t.v_evt).select("bundle_id", "candidate_id")


@query(
    "supersession_conflicts",
    """SELECT candidate_id, event_id, supersedes_event_id, previous AS current_event_id,
       CASE WHEN previous IS NULL THEN 'correction has no prior event' ELSE 'correction does not supersede the current event' END AS reason
       FROM (SELECT *, lag(event_id) OVER (PARTITION BY bundle_id, candidate_id ORDER BY seq) AS previous FROM {v_evt}) x
       WHERE supersedes_event_id IS DISTINCT FROM previous""",
)
def supersession_conflicts(t: Inputs) -> DataFrame:
    return review.supersession_conflicts(t.v_evt).select(
        "candidate_id", "event_id", "supersedes_event_id", "current_event_id", "reason"
    )


@query(
    "numbered_events",
    """SELECT bundle_id, seq, concat('assessment-', CASE WHEN n + 7 < 10000 THEN lpad(CAST(n + 7 AS STRING), 4, '0') ELSE CAST(n + 7 AS STRING) END) AS event_id
       FROM (SELECT bundle_id, seq, row_number() OVER (PARTITION BY bundle_id ORDER BY seq) AS n FROM {v_evt}) x""",
)
def numbered_events(t: Inputs) -> DataFrame:
    return review.number_events(t.v_evt.select("bundle_id", "seq"), base=7)


_QUEUE = f"""SELECT c.bundle_id, c.candidate_id, c.score, e.disposition AS current_disposition, e.disposition IS NOT NULL AS reviewed
    FROM {{v_cand}} c LEFT JOIN ({_CURRENT}) e ON e.bundle_id = c.bundle_id AND e.candidate_id = c.candidate_id"""


@query(
    "review_queue",
    f"""SELECT bundle_id, candidate_id, score, current_disposition, reviewed,
        row_number() OVER (ORDER BY reviewed, score DESC, candidate_id) AS position FROM ({_QUEUE}) q""",
)
def review_queue(t: Inputs) -> DataFrame:
    queue = review.review_queue(t.v_cand, review.current_assessments(t.v_evt))
    return review.queue_positions(queue).select("bundle_id", "candidate_id", "score", "current_disposition", "reviewed", "position")


@query("pending_queue", f"SELECT bundle_id, candidate_id, score FROM ({_QUEUE}) q WHERE NOT reviewed")
def pending_queue(t: Inputs) -> DataFrame:
    queue = review.review_queue(t.v_cand, review.current_assessments(t.v_evt))
    return review.filter_queue(queue, "pending").select("bundle_id", "candidate_id", "score")


@query(
    "queue_counts",
    f"""SELECT bundle_id, count(*) AS all_count, count(*) FILTER (WHERE NOT reviewed) AS pending_count, count(*) FILTER (WHERE reviewed) AS reviewed_count
        FROM ({_QUEUE}) q GROUP BY bundle_id""",
)
def queue_counts(t: Inputs) -> DataFrame:
    return review.queue_counts(review.review_queue(t.v_cand, review.current_assessments(t.v_evt)))


@query(
    "evidence_export",
    """SELECT bundle_id, candidate_id, 'candidate' AS part, 0 AS seq, CAST(k AS STRING) AS subject FROM {v_cand}
       UNION ALL SELECT e.bundle_id, e.candidate_id, 'assessment', e.seq, e.disposition FROM {v_evt} e
       JOIN {v_cand} c ON c.bundle_id = e.bundle_id AND c.candidate_id = e.candidate_id""",
)
def evidence_export(t: Inputs) -> DataFrame:
    bundles = t.v_cand.select("bundle_id").distinct().withColumn("status", F.lit("succeeded"))
    out = review.evidence_export(t.v_cand, bundles, t.v_evt)
    subject = F.coalesce(F.get_json_object("record", "$.candidate.k"), F.get_json_object("record", "$.disposition"))
    return out.select("bundle_id", "candidate_id", "part", "seq", subject.alias("subject"))


# --- streams ------------------------------------------------------------------------


def _shared_folder(t: Inputs) -> str:
    """A new folder in the cluster's shared checkpoint area."""
    return f"{checkpoint_folder(t.spark)}/sightline-stream-{uuid.uuid4().hex}"


def _event_stream(t: Inputs) -> DataFrame:
    """The events table, a file or a folder of files, read as a stream and shaped like the log view."""
    raw = assessments.table_stream(t.spark, f"{t.folder}/events.parquet", t.events.schema)
    return t.spark.sql(VIEWS["v_evt"], events=raw)


def _run_to_end(t: Inputs, stream: DataFrame) -> DataFrame:
    """Drain what is there, then hand back the written table."""
    folder = _shared_folder(t)
    run = (
        stream.writeStream.outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/state").format("parquet").start(f"{folder}/out")
    )
    run.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("streamed_intake", f"SELECT seq, trim(note) AS note FROM {{v_evt}} WHERE ({_PROBLEM}) IS NULL")
def streamed_intake(t: Inputs) -> DataFrame:
    good, _ = assessments.intake(_event_stream(t))
    return _run_to_end(t, good.select("seq", "note"))


@query(
    "streamed_rejects",
    f"SELECT seq, {_PROBLEM} AS problem FROM {{v_evt}} WHERE ({_PROBLEM}) IS NOT NULL",
)
def streamed_rejects(t: Inputs) -> DataFrame:
    _, bad = assessments.intake(_event_stream(t))
    return _run_to_end(t, bad.select("seq", "problem"))


@query("streamed_requests", "SELECT DISTINCT bundle_id, request_id FROM {v_evt}")
def streamed_requests(t: Inputs) -> DataFrame:
    """Every request once, however often it is sent within a year of event time."""
    sent = _event_stream(t).select("bundle_id", "request_id", F.col("created_at").cast("timestamp").alias("created_at"))
    return _run_to_end(t, assessments.first_requests(sent, "created_at", "366 days").select("bundle_id", "request_id"))


# One draft after another.  Candidates are six events in a row and only the last two of nine share a request
# id, so blocks of eighteen events are decided side by side.
_DECIDED = f"""WITH /*recursive*/ sound AS (
      SELECT seq, bundle_id, candidate_id, request_id, trim(supersedes_event_id) AS names, 'assessment-' || CASE WHEN seq < 10000 THEN lpad(CAST(seq AS VARCHAR), 4, '0') ELSE CAST(seq AS VARCHAR) END AS own_id,
        CAST(floor(seq / 18) AS BIGINT) AS block, row_number() OVER (PARTITION BY CAST(floor(seq / 18) AS BIGINT) ORDER BY seq) AS n
      FROM {{v_evt}} WHERE ({_PROBLEM}) IS NULL),
    drafts AS (SELECT s.*, c.candidate_id IS NOT NULL AS known FROM sound s
      LEFT JOIN (SELECT * FROM {{v_cand}} WHERE k % 10 <> 9) c ON c.bundle_id = s.bundle_id AND c.candidate_id = s.candidate_id),
    steps AS (
      SELECT DISTINCT block, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS bundle_id, CAST(NULL AS VARCHAR) AS candidate_id, CAST(NULL AS VARCHAR) AS current_id,
        CAST(NULL AS VARCHAR) AS taken_request, CAST(NULL AS VARCHAR) AS taken_bundle, CAST(NULL AS VARCHAR) AS taken_id,
        CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS event_id
      FROM drafts
      UNION ALL
      SELECT block, n, bundle_id, candidate_id, CASE WHEN outcome = 'accepted' THEN own_id ELSE here END,
        CASE WHEN outcome = 'accepted' THEN request_id ELSE taken_request END, CASE WHEN outcome = 'accepted' THEN bundle_id ELSE taken_bundle END,
        CASE WHEN outcome = 'accepted' THEN own_id ELSE taken_id END, seq, outcome,
        CASE outcome WHEN 'accepted' THEN own_id WHEN 'replay' THEN taken_id END
      FROM (SELECT x.*, CASE WHEN taken_request = request_id AND taken_bundle = bundle_id THEN 'replay' WHEN NOT known THEN 'unknown-candidate'
              WHEN names IS DISTINCT FROM here THEN 'conflict' ELSE 'accepted' END AS outcome
            FROM (SELECT d.*, s.taken_request, s.taken_bundle, s.taken_id,
                    CASE WHEN s.candidate_id = d.candidate_id AND s.bundle_id = d.bundle_id THEN s.current_id END AS here
                  FROM steps s JOIN drafts d ON d.block = s.block AND d.n = s.n + 1) x) y)
    SELECT seq, outcome, event_id FROM steps WHERE n > 0"""


@query("streamed_decisions", _DECIDED)
def streamed_decisions(t: Inputs) -> DataFrame:
    """Accept, replay, conflict or unknown-candidate for every sound draft."""
    good, _ = assessments.intake(_event_stream(t))
    drafts = good.select("seq", "request_id", "bundle_id", "candidate_id", "disposition", "note", "supersedes_event_id")
    folder = _shared_folder(t)
    assessments.decide(drafts, t.v_cand.where("k % 10 <> 9"), folder).trigger(availableNow=True).start().awaitTermination()
    return assessments.decisions(t.spark, folder, drafts).select("seq", "outcome", "event_id")


@query("streamed_current", f"SELECT bundle_id, candidate_id, event_id FROM ({_CURRENT}) c")
def streamed_current(t: Inputs) -> DataFrame:
    """The current view kept by a stream, one row per candidate."""
    folder, events = _shared_folder(t), _event_stream(t).select("bundle_id", "candidate_id", "event_id", "seq")
    assessments.keep_current(events, folder).trigger(availableNow=True).start().awaitTermination()
    return assessments.current_view(t.spark, folder, events).select("bundle_id", "candidate_id", "event_id")
