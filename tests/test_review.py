import json
import random

import pytest
from pyspark.sql import functions as F

from sightline.operators import review
from sightline.streaming import assessments

DRAFT = "seq long, request_id string, bundle_id string, candidate_id string, disposition string, note string, supersedes_event_id string"


def draft(seq, request="r", candidate="c", disposition="supported", note="", names=None, bundle="b"):
    return (seq, request, bundle, candidate, disposition, note, names)


def test_draft_rules(spark):
    rows = [draft(1), draft(2, request=" "), draft(3, disposition="maybe"), draft(4, note="x" * 501), draft(5, note=" " + "x" * 500 + " "),
            draft(6, disposition="needs-context", note="  "), draft(7, names=" "), draft(8, names=" e ")]
    got = {r["seq"]: (r["problem"], r["supersedes_event_id"]) for r in review.check_drafts(spark.createDataFrame(rows, DRAFT)).collect()}
    assert [s for s, (p, _) in got.items() if p is None] == [1, 5, 8] and got[8][1] == "e"


def test_history_and_conflicts_on_a_hot_candidate(spark):
    """One candidate owns most of the log; its chain is broken in two places."""
    rows = [(i, f"e{i}", "b", "hot", None if i == 0 else f"e{i - 1}") for i in range(400)]
    rows[100] = (100, "e100", "b", "hot", "e7")
    rows[200] = (200, "e200", "b", "hot", None)
    rows += [(500, "f0", "b", "cold", "ghost")]
    log = spark.createDataFrame(rows, "seq long, event_id string, bundle_id string, candidate_id string, supersedes_event_id string")
    bad = {r["event_id"]: r["current_event_id"] for r in review.supersession_conflicts(log).collect()}
    assert bad == {"e100": "e99", "e200": "e199", "f0": None}
    history = review.assessment_history(log).where("candidate_id = 'hot'").collect()
    assert all(r["position"] == r["seq"] + 1 for r in history) and [r["seq"] for r in history if r["is_latest"]] == [399]
    assert review.current_assessments(log).where("candidate_id = 'hot'").first()["event_id"] == "e399"


def test_queue(spark):
    cands = spark.createDataFrame([("b", "c1", 0.2), ("b", "c2", 0.9), ("b", "c3", 0.9), ("b", "c4", 0.1)], "bundle_id string, candidate_id string, score double")
    now = spark.createDataFrame([("b", "c2", "supported")], "bundle_id string, candidate_id string, disposition string")
    queue = review.review_queue(cands, now)
    assert [r["candidate_id"] for r in review.in_queue_order(queue).collect()] == ["c3", "c1", "c4", "c2"]
    assert tuple(review.queue_counts(queue).first())[1:] == (4, 3, 1)
    assert [r["candidate_id"] for r in review.filter_queue(queue, "reviewed").collect()] == ["c2"]


def test_event_numbers_continue(spark):
    log = spark.createDataFrame([(5, "b"), (9, "b"), (1, "x")], "seq long, bundle_id string")
    got = sorted((r["bundle_id"], r["seq"], r["event_id"]) for r in review.number_events(log, 9998).collect())
    assert got == [("b", 5, "assessment-9999"), ("b", 9, "assessment-10000"), ("x", 1, "assessment-9999")]


def decide_in_order(rows, known):
    """One draft after another, the plain way."""
    current, accepted, out = {}, {}, {}
    for seq, request, bundle, candidate, _, _, names in rows:
        if (bundle, request) in accepted:
            out[seq] = ("replay", accepted[bundle, request])
        elif (bundle, candidate) not in known:
            out[seq] = ("unknown-candidate", None)
        elif names != current.get((bundle, candidate)):
            out[seq] = ("conflict", None)
        else:
            event = f"assessment-{seq:04d}"
            current[bundle, candidate] = accepted[bundle, request] = event
            out[seq] = ("accepted", event)
    return out


def tangled_log(rng, n):
    rows, last = [], {}
    for seq in range(n):
        bundle, candidate = rng.choice("bx"), f"c{rng.randint(0, 4)}"
        names = last.get((bundle, candidate)) if rng.random() < 0.7 else rng.choice([None, "assessment-0003"])
        rows.append(draft(seq, f"r{rng.randint(0, 70 * n // 90)}", candidate, names=names, bundle=bundle))
        last[bundle, candidate] = f"assessment-{seq:04d}" if rng.random() < 0.8 else last.get((bundle, candidate))
    return rows


KNOWN = {(b, f"c{i}") for b in "bx" for i in range(4)}


@pytest.mark.parametrize("batches", [1, 3])
def test_stream_decisions(spark, tmp_path, batches):
    rows = tangled_log(random.Random(batches), 90)
    source, step = tmp_path / "in", -(-len(rows) // batches)
    source.mkdir()
    candidates = spark.createDataFrame(sorted(KNOWN), "bundle_id string, candidate_id string")
    for i in range(batches):
        part = rows[i * step:(i + 1) * step]
        random.Random(i).shuffle(part)
        spark.createDataFrame(part, DRAFT).repartition(3).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(DRAFT).parquet(str(source))
        assessments.decide(stream, candidates, str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    got = {r["seq"]: (r["outcome"], r["event_id"]) for r in assessments.decisions(spark, str(tmp_path / "log"), stream).collect()}
    assert got == decide_in_order(rows, KNOWN)
    assert {o for o, _ in got.values()} == set(assessments.OUTCOMES)


def test_decisions_on_a_long_tangled_log(spark):
    rows = tangled_log(random.Random(8), 400)
    drafts = spark.createDataFrame(rows, DRAFT).repartition(7)
    got = review.decide_drafts(drafts, spark.createDataFrame(sorted(KNOWN), "bundle_id string, candidate_id string"))
    assert {r["seq"]: (r["outcome"], r["event_id"]) for r in got.collect()} == decide_in_order(rows, KNOWN)


def test_one_candidate_may_hold_the_whole_log(spark):
    """50,000 sound drafts of one candidate, each naming the one before, in shuffled files; one is sent twice."""
    n = 50_000
    drafts = spark.range(n).selectExpr(
        "id AS seq", "concat('r', id) AS request_id", "'b' AS bundle_id", "'hot' AS candidate_id", "'supported' AS disposition", "'' AS note",
        "CASE WHEN id > 0 THEN format_string('assessment-%04d', id - 1) END AS supersedes_event_id",
    )
    again = drafts.where("seq = 25000").withColumn("seq", F.lit(n).cast("bigint"))
    late = drafts.where("seq = 30000").selectExpr("CAST(60000 AS BIGINT) AS seq", "'rx' AS request_id", "bundle_id", "candidate_id", "disposition", "note", "supersedes_event_id")
    known = spark.createDataFrame([("b", "hot")], "bundle_id string, candidate_id string")
    log = drafts.unionByName(again).unionByName(late).repartition(16, F.xxhash64("seq"))
    got = {r["outcome"]: r["n"] for r in review.decide_drafts(log, known).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"accepted": n, "replay": 1, "conflict": 1}


def test_refused_drafts_do_not_own_their_request(spark):
    rows = [draft(1, "r", "ghost"), draft(2, "r", "c0"), draft(3, "r", "c1"), draft(4, "q", "c0", names="assessment-0002")]
    got = review.decide_drafts(spark.createDataFrame(rows, DRAFT), spark.createDataFrame(sorted(KNOWN), "bundle_id string, candidate_id string"))
    assert [(r["outcome"], r["event_id"]) for r in got.orderBy("seq").collect()] == [
        ("unknown-candidate", None), ("accepted", "assessment-0002"), ("replay", "assessment-0002"), ("accepted", "assessment-0004")
    ]


@pytest.mark.parametrize("as_folder", [True, False])
def test_current_view_reads_files_and_folders(spark, tmp_path, as_folder):
    rows = [(i, f"e{i}", "b", f"c{i % 7}") for i in range(100)]
    frame = spark.createDataFrame(rows, "seq long, event_id string, bundle_id string, candidate_id string")
    frame.repartition(4 if as_folder else 1).write.parquet(str(tmp_path / "events.parquet"))
    path = tmp_path / "events.parquet" if as_folder else next((tmp_path / "events.parquet").glob("part-*"))
    stream = assessments.table_stream(spark, str(path), frame.schema)
    assessments.keep_current(stream, str(tmp_path / "kept")).trigger(availableNow=True).start().awaitTermination()
    got = {r["candidate_id"]: r["seq"] for r in assessments.current_view(spark, str(tmp_path / "kept"), stream).collect()}
    assert got == {f"c{i % 7}": i for i in range(93, 100)}


def test_requests_once_within_the_delay(spark, tmp_path):
    """Repeats inside the delay go, in a later batch too; a draft behind the watermark is dropped and counted; old state is let go."""
    batches = [
        [("r1", "12:00"), ("r1", "12:05"), ("r2", "12:30")],
        [("r1", "12:31"), ("r3", "10:00"), ("r4", "12:40")],
        [("r5", "23:00")],
        [("r6", "23:05")],
    ]
    out, dropped, held = str(tmp_path / "out"), 0, []
    for rows in batches:
        frame = spark.createDataFrame([("b", r, f"2026-01-01 {at}:00") for r, at in rows], "bundle_id string, request_id string, at string")
        frame.withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = assessments.table_stream(spark, str(tmp_path / "in"), frame.withColumn("at", F.to_timestamp("at")).schema)
        run = assessments.first_requests(stream, "at", "1 hour").writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state"))
        run = run.format("parquet").start(out)
        run.awaitTermination()
        dropped += sum(s["numRowsDroppedByWatermark"] for p in run.recentProgress for s in p["stateOperators"])
        held.append(run.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert sorted(r["request_id"] for r in spark.read.parquet(out).collect()) == ["r1", "r2", "r4", "r5", "r6"]
    assert dropped == 1 and max(held) <= 3 and held[-1] <= 2


def test_exported_records_hold_whole_events(spark):
    events = spark.createDataFrame([(3, "e3", "b", "c", "q", "supported", "n", None)], "seq long, event_id string, bundle_id string, candidate_id string, request_id string, disposition string, note string, supersedes_event_id string")
    cands = spark.createDataFrame([("b", "c", 0.5)], "bundle_id string, candidate_id string, score double")
    bundles = spark.createDataFrame([("b", "succeeded")], "bundle_id string, status string")
    rows = {r["part"]: json.loads(r["record"]) for r in review.evidence_export(cands, bundles, events).collect()}
    assert rows["assessment"] == {"seq": 3, "event_id": "e3", "request_id": "q", "disposition": "supported", "note": "n"}


def test_intake_splits(spark):
    good, bad = assessments.intake(spark.createDataFrame([draft(1), draft(2, disposition="maybe")], DRAFT))
    assert [r["seq"] for r in good.collect()] == [1] and [r["seq"] for r in bad.collect()] == [2]
