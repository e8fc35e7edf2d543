"""Folding the append-only assessment log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.operators.ranking import preceding, ranked
from sightline.session import reliable_checkpoint

DISPOSITIONS = ("supported", "rejected", "needs-context")
MAX_NOTE = 500


def draft_problem() -> Column:
    """Reason a draft is refused, or NULL; reads the draft's own columns."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return (
        F.when(blank("request_id"), "Request ID must not be empty.")
        .when(blank("bundle_id"), "Bundle ID must not be empty.")
        .when(blank("candidate_id"), "Candidate ID must not be empty.")
        .when(~F.coalesce(F.col("disposition").isin(*DISPOSITIONS), F.lit(False)), "Choose a valid assessment action.")
        .when(F.length(F.trim("note")) > MAX_NOTE, "Notes must be 500 characters or fewer.")
        .when((F.col("disposition") == "needs-context") & blank("note"), "Add a note describing the context needed.")
        .when(
            F.col("supersedes_event_id").isNotNull() & blank("supersedes_event_id"),
            "Superseded event ID must not be empty.",
        )
    )


def check_drafts(drafts: DataFrame) -> DataFrame:
    """Trimmed drafts with their ``problem``; works on tables and streams."""
    checked = drafts.withColumn("problem", draft_problem())
    for name in ("request_id", "bundle_id", "candidate_id", "note", "supersedes_event_id"):
        checked = checked.withColumn(name, F.trim(name))
    return checked.withColumn("note", F.coalesce("note", F.lit("")))


def first_of_request(drafts: DataFrame) -> DataFrame:
    """One row per request id: the first arrival; later copies are replays of it."""
    rest = [c for c in drafts.columns if c not in ("bundle_id", "request_id")]
    picked = drafts.groupBy("bundle_id", "request_id").agg(F.min_by(F.struct(*rest), F.col("seq")).alias("_r"))
    return picked.select("bundle_id", "request_id", *[F.col(f"_r.{c}").alias(c) for c in rest])


def current_assessments(events: DataFrame) -> DataFrame:
    """Last event of every candidate, combined before the shuffle."""
    rest = [c for c in events.columns if c not in ("bundle_id", "candidate_id")]
    picked = events.groupBy("bundle_id", "candidate_id").agg(F.max_by(F.struct(*rest), F.col("seq")).alias("_r"))
    return picked.select("bundle_id", "candidate_id", *[F.col(f"_r.{c}").alias(c) for c in rest])


def assessment_history(events: DataFrame) -> DataFrame:
    """Events of every candidate in order: ``position`` and the ``is_latest`` flag.

    One row per event, so a candidate with a very long history stays spread out.
    """
    placed = ranked(events, ["bundle_id", "candidate_id"], ["seq"], "position")
    last = events.groupBy("bundle_id", "candidate_id").agg(F.max("seq").alias("_last"))
    return placed.join(last, ["bundle_id", "candidate_id"]).withColumn(
        "is_latest", F.col("seq") == F.col("_last")
    ).drop("_last")


def unresolved(observations: DataFrame, events: DataFrame) -> DataFrame:
    """Observations without any event."""
    return observations.join(events.select("bundle_id", "candidate_id"), ["bundle_id", "candidate_id"], "left_anti")


def supersession_conflicts(events: DataFrame) -> DataFrame:
    """Stored events that do not supersede exactly the event before them.

    The log is range-sorted once and each event looks one row back, so no candidate's log is sorted in one task.
    """
    joined = preceding(events, ["bundle_id", "candidate_id"], ["seq"], "event_id", "_previous")
    named = F.col("supersedes_event_id")
    return joined.where(~named.eqNullSafe(F.col("_previous"))).select(
        "bundle_id", "candidate_id", "seq", "event_id", "supersedes_event_id",
        F.col("_previous").alias("current_event_id"),
        F.when(F.col("_previous").isNull(), "correction has no prior event")
        .otherwise("correction does not supersede the current event").alias("reason"),
    )


def number_events(events: DataFrame, base: int = 0) -> DataFrame:
    """``assessment-NNNN`` ids running per bundle in arrival order, after ``base``."""
    placed = ranked(events, ["bundle_id"], ["seq"], "_n")
    number = F.col("_n") + base
    return placed.withColumn(
        "event_id", F.concat(F.lit("assessment-"), F.format_string("%04d", number))
    ).drop("_n")


def _reached(links: DataFrame) -> DataFrame:
    """Nodes of ``(node, up)`` whose chain ends in a root (``up`` is the node itself), by pointer jumping."""
    while True:
        above = links.select(F.col("node").alias("up"), F.col("up").alias("_top"))
        links = reliable_checkpoint(
            links.join(above, "up").select("node", F.col("_top").alias("up"), (F.col("_top") != F.col("up")).alias("_moved"))
        )
        moving = links.where("_moved").limit(1).count()
        links = links.drop("_moved")
        if not moving:
            return links.select("node")


def _accepted(drafts: DataFrame) -> DataFrame:
    """``node`` of every draft that is accepted when those with a ``replay_of`` stand back.

    An event is followed by the first later draft that names it, so accepted drafts are those that a chain
    of first namers ties to the candidate's current event (or to a draft that names nothing, where there is
    none).  Finding first namers is a grouped minimum and following chains is pointer jumping, so one
    candidate may hold the whole log.
    """
    keys = ["bundle_id", "candidate_id"]
    open_ = drafts.where("replay_of IS NULL AND is_known")
    roots = (
        open_.where(F.col("supersedes_event_id").eqNullSafe(F.col("current_event_id")))
        .groupBy(*keys).agg(F.min("seq").alias("node")).select("node", F.col("node").alias("up"))
    )
    named = open_.select(*keys, F.col("event_id").alias("supersedes_event_id"), F.col("seq").alias("up"))
    later = (
        open_.where("supersedes_event_id IS NOT NULL").select(*keys, "supersedes_event_id", "seq")
        .join(named, [*keys, "supersedes_event_id"]).where("seq > up")
        .groupBy("up").agg(F.min("seq").alias("node")).select("node", "up")
    )
    return _reached(reliable_checkpoint(roots.unionAll(later)))


def decide_drafts(
    drafts: DataFrame, candidates: DataFrame, current: DataFrame | None = None, requests: DataFrame | None = None
) -> DataFrame:
    """``drafts`` with ``event_id`` and ``outcome``: accepted, replay, unknown-candidate or conflict.

    Drafts are decided in the order of ``seq``, which is unique in a log.  A request id belongs to its
    bundle from the moment a draft with it is accepted; later drafts with it are replays and carry that
    first event's id, whatever their candidate.  Otherwise the candidate must be in ``candidates`` and the
    draft must name the candidate's current event, or nothing where there is none.  An event's id is its
    arrival number.  ``current (bundle_id, candidate_id, event_id)`` and ``requests (bundle_id,
    request_id, event_id)`` carry what was accepted before.

    Which drafts are replays depends on what is accepted and the other way round; both are computed in
    turn until the replays stay the same.  Each turn settles at least the first draft that was wrong.
    """
    keys = ["bundle_id", "candidate_id"]
    fields = list(drafts.columns)
    known = candidates.groupBy(*keys).agg(F.lit(True).alias("is_known"))
    rows = drafts.withColumn("event_id", F.format_string("assessment-%04d", "seq")).join(known, keys, "left")
    rows = rows.withColumn("is_known", F.coalesce("is_known", F.lit(False)))
    before = F.lit(None).cast("string")
    if current is None:
        rows = rows.withColumn("current_event_id", before)
    else:
        rows = rows.join(current.select(*keys, F.col("event_id").alias("current_event_id")), keys, "left")
    if requests is None:
        rows = rows.withColumn("_earlier", before)
    else:
        rows = rows.join(requests.select("bundle_id", "request_id", F.col("event_id").alias("_earlier")), ["bundle_id", "request_id"], "left")
    rows = reliable_checkpoint(rows)
    replays, seen = rows.select("*", F.col("_earlier").alias("replay_of")), None
    while True:
        accepted = rows.join(_accepted(replays).select(F.col("node").alias("seq"), F.lit(True).alias("_in")), "seq", "left")
        firsts = (
            accepted.where("_in").groupBy("bundle_id", "request_id")
            .agg(F.min("seq").alias("_first"), F.min_by("event_id", "seq").alias("_event"))
        )
        replay_of = F.coalesce("_earlier", F.when(F.col("seq") > F.col("_first"), F.col("_event")))
        replays = reliable_checkpoint(
            accepted.join(reliable_checkpoint(firsts), ["bundle_id", "request_id"], "left").withColumn("replay_of", replay_of).drop("_first", "_event")
        )
        now = tuple(replays.where("replay_of IS NOT NULL").agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("seq", "replay_of"))).first())
        if now == seen or (seen is None and not now[0]):
            break
        seen = now
        replays = replays.drop("_in")
    outcome = (
        F.when(F.col("replay_of").isNotNull(), "replay").when(~F.col("is_known"), "unknown-candidate")
        .when(F.col("_in"), "accepted").otherwise("conflict")
    )
    event = F.when(outcome == "replay", F.col("replay_of")).when(outcome == "accepted", F.col("event_id"))
    return replays.select(*fields, event.alias("event_id"), outcome.alias("outcome"))


def review_queue(candidates: DataFrame, current: DataFrame) -> DataFrame:
    """Candidates with their current disposition, flagged ``reviewed``."""
    latest = current.select("bundle_id", "candidate_id", F.col("disposition").alias("current_disposition"))
    return candidates.join(latest, ["bundle_id", "candidate_id"], "left").withColumn(
        "reviewed", F.col("current_disposition").isNotNull()
    )


def filter_queue(queue: DataFrame, view: str = "all") -> DataFrame:
    if view == "pending":
        return queue.where(~F.col("reviewed"))
    if view == "reviewed":
        return queue.where(F.col("reviewed"))
    return queue


def in_queue_order(queue: DataFrame) -> DataFrame:
    return queue.orderBy("reviewed", F.desc("score"), "candidate_id")


def queue_positions(queue: DataFrame) -> DataFrame:
    """The queue with each candidate's ``position`` in its order, by a range sort."""
    return ranked(queue, [], ["reviewed", F.desc("score"), "candidate_id"], "position")


def queue_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("bundle_id").agg(
        F.count(F.lit(1)).alias("all_count"),
        F.count_if(~F.col("reviewed")).alias("pending_count"),
        F.count_if("reviewed").alias("reviewed_count"),
    )


def evidence_export(candidates: DataFrame, bundles: DataFrame, events: DataFrame) -> DataFrame:
    """Export records as JSON lines: one per candidate, one per assessment of it.

    ``(bundle_id, candidate_id, part, seq, record)``; the parts of a candidate sort by
    (part, seq).  Assessments stay separate lines, so no log is gathered in one row.
    """
    head = candidates.join(bundles, "bundle_id")
    body = [c for c in candidates.columns if c not in ("bundle_id",)]
    provenance = [c for c in bundles.columns if c != "bundle_id"]
    first = head.select(
        "bundle_id", "candidate_id", F.lit("candidate").alias("part"), F.lit(0).cast("bigint").alias("seq"),
        F.to_json(
            F.struct(
                F.lit("1.0.0").alias("exportVersion"), F.col("bundle_id").alias("bundleId"),
                F.struct(*provenance).alias("provenance"), F.struct(*body).alias("candidate"),
            )
        ).alias("record"),
    )
    known = events.join(candidates.select("bundle_id", "candidate_id"), ["bundle_id", "candidate_id"], "left_semi")
    rest = known.select(
        "bundle_id", "candidate_id", F.lit("assessment").alias("part"), "seq",
        F.to_json(F.struct(*[c for c in events.columns if c not in ("bundle_id", "candidate_id")])).alias("record"),
    )
    return first.unionByName(rest)
