"""Artifact, bundle, lineage and case contract queries."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.scalars import fingerprint, short_id
from sightline.operators import contracts
from sightline.operators.evaluation import duplicates
from sightline.operators.raster import ChangePolicy
from sightline.plans.change_run import change_run_ids
from sightline.session import checkpoint_folder
from sightline.sources import artifacts as artifact_files
from sightline.sources import manifests, sinks
from workload.registry import Inputs, query

# Character counts stand for bytes in the declarations, so both engines agree on sizes.
_FILES = "SELECT bundle_id, path, chars AS length, sha256(text) AS sha256 FROM {v_file}"


def files(t: Inputs) -> DataFrame:
    return t.v_file.select(
        "bundle_id", "path", F.col("chars").alias("length"), F.sha2("text", 256).alias("sha256"),
        F.encode(F.substring("text", 1, 8), "UTF-8").alias("magic"),
    )


def declared(t: Inputs) -> DataFrame:
    digest = F.when(F.col("tamper") == 0, F.lit("0" * 64)).otherwise(F.sha2("text", 256))
    return t.v_declared.select(
        "bundle_id", "artifact_id", "path", "media_type", "status", F.col("declared_chars").alias("size_bytes"), digest.alias("sha256"),
        "doc_id",
    )


_AUDIT = """SELECT coalesce(d.bundle_id, f.bundle_id) AS bundle_id, d.artifact_id, coalesce(d.path, f.path) AS path, CASE
    WHEN d.doc_id IS NULL THEN 'file is not declared' WHEN d.doc_id % 71 = 0 THEN 'path is unsafe' WHEN d.status = 'missing' AND f.path IS NOT NULL THEN 'artifact marked missing is present'
    WHEN d.status = 'missing' THEN NULL WHEN f.path IS NULL THEN 'file is missing'
    WHEN f.chars <= 0 OR f.chars > 268435456 THEN 'file exceeds its size limit' WHEN f.chars <> declared_chars THEN 'file size changed'
    WHEN d.tamper = 0 THEN 'file checksum changed' WHEN d.media_type = 'image/png' THEN 'signature does not match media type' END AS reason
    FROM {v_declared} d FULL JOIN {v_file} f ON f.bundle_id = d.bundle_id AND f.path = d.path"""


@query("artifact_audit", _AUDIT)
def artifact_audit(t: Inputs) -> DataFrame:
    return contracts.artifact_audit(declared(t), files(t))


@query(
    "artifact_faults",
    f"""SELECT bundle_id, coalesce(artifact_id, path) AS subject, reason FROM ({_AUDIT}) a WHERE reason IS NOT NULL
        UNION ALL SELECT bundle_id, artifact_id, 'artifact ID is duplicated' FROM {{v_declared}} GROUP BY bundle_id, artifact_id HAVING count(*) > 1
        UNION ALL SELECT bundle_id, path, 'artifact path is reused' FROM {{v_declared}} GROUP BY bundle_id, path HAVING count(*) > 1""",
)
def artifact_faults(t: Inputs) -> DataFrame:
    return contracts.artifact_violations(declared(t), files(t))


_BUNDLES = """SELECT DISTINCT doc_id % 40 AS bundle_id, CASE WHEN doc_id % 40 % 3 = 0 THEN 'partial' ELSE 'succeeded' END AS status,
    doc_id % 40 % 2 AS warning_count, concat('change-', CAST(doc_id % 40 AS STRING)) AS change_run_id, concat('source-', CAST(doc_id % 40 AS STRING)) AS source_run_id FROM {documents}"""


@query(
    "bundle_states",
    f"""WITH b AS (SELECT x.*, (SELECT count(*) FROM {{v_declared}} d WHERE d.bundle_id = x.bundle_id AND d.status = 'missing') AS missing FROM ({_BUNDLES}) x)
        SELECT bundle_id, 'succeeded bundle has missing artifacts' AS reason FROM b WHERE status = 'succeeded' AND missing > 0
        UNION ALL SELECT bundle_id, 'partial bundle declares no missing artifact' FROM b WHERE status = 'partial' AND missing = 0
        UNION ALL SELECT bundle_id, 'partial bundle explains nothing' FROM b WHERE status = 'partial' AND warning_count = 0""",
)
def bundle_states(t: Inputs) -> DataFrame:
    return contracts.bundle_state_violations(t.sql(_BUNDLES), declared(t))


_CANDS = """SELECT doc_id % 40 AS bundle_id, concat('c-', CAST(doc_id AS STRING)) AS candidate_id,
    concat('art-', CAST(doc_id AS STRING)) AS art1, concat('art-', CAST(doc_id + 40 AS STRING)) AS art2 FROM {documents}"""
_SUMMARIES = """SELECT bundle_id, concat('c-', CAST(bundle_id AS STRING)) AS c1, concat('c-', CAST(bundle_id + 41 AS STRING)) AS c2,
    concat('art-', CAST(bundle_id AS STRING)) AS a1 FROM (SELECT DISTINCT doc_id % 40 AS bundle_id FROM {documents}) b"""
_ASSESS = """SELECT event_id % 40 AS bundle_id, concat('a-', CAST(event_id AS STRING)) AS assessment_id, event_id AS seq,
    concat('c-', CAST(event_id AS STRING)) AS candidate_id, concat('art-', CAST(event_id AS STRING)) AS art1,
    CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN concat('a-', CAST(event_id + 40 AS STRING))
         ELSE concat('a-', CAST(event_id - 40 AS STRING)) END AS supersedes_event_id FROM {events}"""
_AVAILABLE = "SELECT DISTINCT bundle_id, artifact_id FROM {v_declared} WHERE status <> 'missing'"


@query(
    "bundle_references",
    f"""WITH av AS ({_AVAILABLE}), c AS ({_CANDS}), a AS ({_ASSESS}),
        used AS (SELECT bundle_id, candidate_id AS subject, art1 AS artifact_id FROM c UNION ALL SELECT bundle_id, candidate_id, art2 FROM c
                 UNION ALL SELECT bundle_id, assessment_id, art1 FROM a)
        SELECT bundle_id, subject, 'references an unavailable artifact' AS reason FROM used u
          WHERE NOT EXISTS (SELECT 1 FROM av WHERE av.bundle_id = u.bundle_id AND av.artifact_id = u.artifact_id)
        UNION ALL SELECT bundle_id, assessment_id, 'assessment references an unknown candidate' FROM a
          WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.bundle_id = a.bundle_id AND c.candidate_id = a.candidate_id)
        UNION ALL SELECT a.bundle_id, a.assessment_id, 'supersedes an unknown or later event' FROM a LEFT JOIN a p ON p.bundle_id = a.bundle_id AND p.assessment_id = a.supersedes_event_id
          WHERE a.supersedes_event_id IS NOT NULL AND (p.seq IS NULL OR p.seq >= a.seq)
        UNION ALL SELECT bundle_id, candidate_id, 'candidate ID is duplicated' FROM c GROUP BY bundle_id, candidate_id HAVING count(*) > 1
        UNION ALL SELECT bundle_id, assessment_id, 'assessment ID is duplicated' FROM a GROUP BY bundle_id, assessment_id HAVING count(*) > 1
        UNION ALL SELECT bundle_id, cid, 'summary names an unknown candidate' FROM (
          SELECT bundle_id, c1 AS cid FROM ({_SUMMARIES}) s1 UNION ALL SELECT bundle_id, c2 FROM ({_SUMMARIES}) s2) x
          WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.bundle_id = x.bundle_id AND c.candidate_id = x.cid)
        UNION ALL SELECT bundle_id, a1, 'summary names an unavailable artifact' FROM ({_SUMMARIES}) s3
          WHERE NOT EXISTS (SELECT 1 FROM av WHERE av.bundle_id = s3.bundle_id AND av.artifact_id = s3.a1)""",
)
def bundle_references(t: Inputs) -> DataFrame:
    candidates = t.sql(_CANDS).select("bundle_id", "candidate_id", F.array("art1", "art2").alias("evidence_artifact_ids"))
    assessments = t.sql(_ASSESS).withColumn("evidence_artifact_ids", F.array("art1"))
    summaries = t.sql(_SUMMARIES).select("bundle_id", F.array("c1", "c2").alias("candidate_ids"), F.array("a1").alias("artifact_ids"))
    return contracts.reference_violations(declared(t), candidates, assessments, summaries)


_COMPONENTS = """SELECT doc_id % 40 AS bundle_id, CASE WHEN doc_id % 3 = 0 THEN 'candidates' ELSE concat('part-', CAST(doc_id AS STRING)) END AS name,
    concat('p/', CAST(doc_id - CASE WHEN doc_id % 89 = 88 THEN 40 ELSE 0 END AS STRING)) AS path,
    CASE WHEN doc_id % 13 = 0 THEN 999 ELSE doc_id % 40 END AS declared_bundle_id, CASE WHEN doc_id % 17 = 0 THEN '2.0.0' ELSE '1.0.0' END AS version,
    concat('change-', CAST(CASE WHEN doc_id % 21 = 0 THEN 0 ELSE doc_id % 40 END AS STRING)) AS change_run_id, concat('source-', CAST(doc_id % 40 AS STRING)) AS source_run_id FROM {documents}"""
_ROLES = """SELECT doc_id % 40 AS bundle_id, CASE WHEN doc_id % 80 < 40 THEN 'before' ELSE 'after' END AS role,
    concat('acq-', CAST(doc_id % 400 AS STRING)) AS acquisition_id FROM {documents} WHERE (doc_id % 40 % 4 <> 0 OR doc_id % 120 < 40) AND doc_id % 40 <> 22"""
_AOIS = "SELECT doc_id % 40 AS bundle_id, doc_id, text AS geometry_text FROM {documents}"


@query(
    "bundle_components",
    f"""WITH c AS ({_COMPONENTS}), r AS ({_ROLES})
        SELECT bundle_id, name AS subject, 'component has a different bundle ID' AS reason FROM c WHERE declared_bundle_id <> bundle_id
        UNION ALL SELECT bundle_id, name, 'component has a different contract version' FROM c WHERE version <> '1.0.0'
        UNION ALL SELECT bundle_id, name, 'candidate and manifest change-run IDs differ' FROM c WHERE name = 'candidates' AND change_run_id <> concat('change-', CAST(bundle_id AS STRING))
        UNION ALL SELECT bundle_id, path, 'component path is reused' FROM c GROUP BY bundle_id, path HAVING count(*) > 1
        UNION ALL SELECT bundle_id, 'acquisitions', 'acquisitions must contain exactly before and after roles' FROM r GROUP BY bundle_id
          HAVING count(*) <> 2 OR count(*) FILTER (WHERE role = 'before') <> 1 OR count(*) FILTER (WHERE role = 'after') <> 1
        UNION ALL SELECT DISTINCT doc_id % 40, 'acquisitions', 'acquisitions must contain exactly before and after roles' FROM {{documents}} WHERE doc_id % 40 NOT IN (SELECT bundle_id FROM r)
        UNION ALL SELECT bundle_id, acquisition_id, 'acquisition IDs must be unique' FROM r GROUP BY bundle_id, acquisition_id HAVING count(*) > 1
        UNION ALL SELECT bundle_id, 'aoi', 'AOI geometry checksum does not match' FROM ({_AOIS}) a WHERE doc_id % 19 = 0
        UNION ALL SELECT bundle_id, 'aoi', 'AOI polygon rings must be closed' FROM ({_AOIS}) a WHERE doc_id % 23 = 0""",
)
def bundle_components(t: Inputs) -> DataFrame:
    spot = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    corner = [spot(0, 0), spot(1, 0), spot(1, 1)]
    ring = F.when(F.col("doc_id") % 23 == 0, F.array(*corner)).otherwise(F.array(*corner, corner[0]))
    aois = t.sql(_AOIS).select(
        "bundle_id", F.array(ring).alias("rings"), "geometry_text",
        F.when(F.col("doc_id") % 19 == 0, "bad").otherwise(F.sha2("geometry_text", 256)).alias("geometry_sha256"),
    )
    return contracts.component_violations(t.sql(_BUNDLES), t.sql(_COMPONENTS), t.sql(_ROLES), aois)


_VIEWS = """SELECT DISTINCT doc_id % 40 AS bundle_id, CASE WHEN doc_id % 40 % 3 = 0 THEN 'stale' ELSE 'current' END AS freshness,
    CASE WHEN doc_id % 40 % 6 = 0 THEN NULL ELSE 'aged' END AS freshness_reason, CASE WHEN doc_id % 40 % 5 = 0 THEN 'denied' ELSE 'allowed' END AS permission,
    CASE WHEN doc_id % 40 % 10 = 0 THEN NULL ELSE 'policy' END AS permission_reason FROM {documents}"""
_PAIR_ROLES = "SELECT bundle_id, role, acquisition_id FROM (SELECT DISTINCT doc_id % 40 AS bundle_id, 'before' AS role, 'a' AS acquisition_id FROM {documents} UNION ALL SELECT DISTINCT doc_id % 40, 'after', 'b' FROM {documents} WHERE doc_id % 40 <> 7) r"


@query(
    "display_rules",
    f"""WITH v AS ({_VIEWS}), c AS ({_CANDS})
        SELECT bundle_id, 'bundle' AS subject, 'stale bundle needs a reason' AS reason FROM v WHERE freshness = 'stale' AND freshness_reason IS NULL
        UNION ALL SELECT bundle_id, 'bundle', 'denied permission needs a reason' FROM v WHERE permission = 'denied' AND permission_reason IS NULL
        UNION ALL SELECT bundle_id, 'acquisitions', 'acquisitions must contain exactly before and after roles' FROM v WHERE bundle_id = 7
        UNION ALL SELECT bundle_id, candidate_id, 'references an unavailable artifact' FROM c WHERE NOT EXISTS (SELECT 1 FROM {{v_declared}} d WHERE d.bundle_id = c.bundle_id AND d.artifact_id = c.art1)""",
)
def display_rules(t: Inputs) -> DataFrame:
    candidates = t.sql(_CANDS).select("bundle_id", "candidate_id", F.array("art1").alias("evidence_artifact_ids"))
    return contracts.display_violations(t.sql(_VIEWS), t.sql(_PAIR_ROLES), candidates, declared(t))


_CASES = "SELECT DISTINCT doc_id % 50 AS case_id FROM {documents}"
_OBS = "SELECT doc_id % 50 AS case_id, concat('o-', CAST(doc_id - CASE WHEN doc_id % 83 = 82 THEN 50 ELSE 0 END AS STRING)) AS observation_id, doc_id % 9 AS citation_id FROM {documents} WHERE doc_id % 50 <> 11"
_CITES = "SELECT DISTINCT doc_id % 50 AS case_id, doc_id % 8 AS citation_id FROM {documents} WHERE doc_id % 50 <> 12"
_RES = "SELECT c.case_id, 2e0 * r_regionkey + c.case_id % 4 AS metres FROM ({cases}) c CROSS JOIN {region} WHERE r_regionkey < 5 - CASE WHEN c.case_id % 10 = 3 THEN 1 ELSE 0 END AND c.case_id <> 21".replace("{cases}", _CASES)
_CASE_ACQ = """SELECT case_id, position, CASE WHEN (position = 0) = (case_id % 9 <> 4) THEN 'before' ELSE 'after' END AS role,
    CASE WHEN case_id % 12 = 5 AND position = 1 THEN 'nothex' ELSE repeat('ab', 32) END AS checksum FROM (
    SELECT DISTINCT doc_id % 50 AS case_id, 0 AS position FROM {documents} UNION ALL SELECT DISTINCT doc_id % 50, 1 FROM {documents}) p WHERE case_id <> 24"""
_UNCITED = f"SELECT o.* FROM ({_OBS}) o WHERE NOT EXISTS (SELECT 1 FROM ({_CITES}) c WHERE c.case_id = o.case_id AND c.citation_id = o.citation_id)"


@query("uncited_observations", _UNCITED)
def uncited_observations(t: Inputs) -> DataFrame:
    return contracts.uncited(t.sql(_OBS), t.sql(_CITES)).select("case_id", "observation_id", "citation_id")


@query(
    "case_rules",
    f"""SELECT case_id, CAST(case_id AS STRING) AS subject, 'acquisitions must be ordered before, then after' AS reason FROM ({_CASES}) c WHERE case_id % 9 = 4 OR case_id = 24
        UNION ALL SELECT case_id, role, 'checksum must be SHA-256' FROM ({_CASE_ACQ}) a WHERE checksum = 'nothex'
        UNION ALL SELECT case_id, CAST(case_id AS STRING), 'citations must be a non-empty list' FROM ({_CASES}) c WHERE case_id = 12
        UNION ALL SELECT case_id, CAST(case_id AS STRING), 'observations must be a non-empty list' FROM ({_CASES}) c WHERE case_id = 11
        UNION ALL SELECT case_id, observation_id, 'observation IDs must be unique' FROM ({_OBS}) o GROUP BY case_id, observation_id HAVING count(*) > 1
        UNION ALL SELECT case_id, observation_id, 'citation is not declared' FROM ({_UNCITED}) u
        UNION ALL SELECT case_id, CAST(case_id AS STRING), 'residuals must contain five controls' FROM ({_CASES}) c WHERE case_id % 10 = 3 OR case_id = 21""",
)
def case_rules(t: Inputs) -> DataFrame:
    return contracts.case_violations(t.sql(_CASES), t.sql(_CASE_ACQ), t.sql(_OBS), t.sql(_CITES), t.sql(_RES))


@query(
    "attribution_rules",
    f"""SELECT case_id, 'required source attribution is missing' AS reason FROM ({_CASES}) c WHERE case_id % 6 = 0
        UNION ALL SELECT case_id, 'five-point grid alignment is outside tolerance' FROM ({_CASES}) c WHERE case_id % 10 = 3 OR case_id % 4 = 3 OR case_id = 21
        UNION ALL SELECT case_id, 'thumbnail is too small' FROM ({_CASES}) c WHERE case_id % 5 = 0""",
)
def attribution_rules(t: Inputs) -> DataFrame:
    cases = t.sql(_CASES)
    credits = t.sql(
        f"SELECT c.case_id, CASE WHEN r_regionkey = 0 AND c.case_id % 6 <> 0 THEN 'Contains Copernicus Sentinel data' ELSE r_name END AS attribution FROM ({_CASES}) c CROSS JOIN {{region}}"
    )
    thumbs = cases.select("case_id", F.when(F.col("case_id") % 5 == 0, 600).otherwise(720).alias("width"), F.lit(960).alias("height"))
    return contracts.attribution_violations(cases.withColumn("tolerance_metres", F.lit(10.0)), credits, t.sql(_RES), thumbs)


_RUNS = """SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 41 = 0 THEN -1 ELSE o_custkey END AS source_run_id,
    concat('m', CAST(CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE o_custkey % 7 END AS STRING)) AS source_manifest_sha256,
    concat('q', CAST(o_custkey % 5 AS STRING)) AS source_quality_sha256, o_orderkey % 9 AS candidate_count FROM {orders}"""
_MANIFESTS = "SELECT c_custkey AS run_id, concat('m', CAST(c_custkey % 7 AS STRING)) AS manifest_sha256, concat('q', CAST(c_custkey % 5 + CASE WHEN c_custkey % 29 = 0 THEN 1 ELSE 0 END AS STRING)) AS quality_sha256 FROM {customer}"
_FEATURES = "SELECT l_orderkey AS run_id, CASE WHEN l_partkey % 50 = 0 THEN l_orderkey + 1 ELSE l_orderkey END AS feature_run_id FROM {lineitem}"


@query(
    "lineage_faults",
    f"""WITH j AS (SELECT r.*, m.manifest_sha256, m.quality_sha256, m.run_id AS known, coalesce(f.n, 0) AS n, coalesce(f.alien, 0) AS alien FROM ({_RUNS}) r
          LEFT JOIN ({_MANIFESTS}) m ON m.run_id = r.source_run_id
          LEFT JOIN (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE feature_run_id <> run_id) AS alien FROM ({_FEATURES}) x GROUP BY run_id) f ON f.run_id = r.run_id)
        SELECT run_id, 'change and processing runs do not share lineage' AS reason FROM j WHERE known IS NULL
        UNION ALL SELECT run_id, 'processing manifest checksum does not match' FROM j WHERE source_manifest_sha256 <> manifest_sha256
        UNION ALL SELECT run_id, 'quality report checksum does not match' FROM j WHERE source_quality_sha256 <> quality_sha256
        UNION ALL SELECT run_id, 'candidate count does not match change manifest' FROM j WHERE n <> candidate_count
        UNION ALL SELECT run_id, 'candidate feature does not match the change run' FROM j WHERE alien > 0""",
)
def lineage_faults(t: Inputs) -> DataFrame:
    return contracts.lineage_violations(t.sql(_RUNS), t.sql(_MANIFESTS), t.sql(_FEATURES))


_PINNED = "SELECT k AS run_id, 'before' AS role, item_id FROM {v_item} UNION ALL SELECT k, 'after', item_id FROM {v_item}"
_USED = "SELECT k AS run_id, 'before' AS role, CASE WHEN k % 20 = 0 THEN 'other' ELSE item_id END AS item_id FROM {v_item} UNION ALL SELECT k, CASE WHEN k % 30 = 0 THEN 'context' ELSE 'after' END, item_id FROM {v_item}"


@query(
    "input_role_faults",
    """SELECT k AS run_id, 'before' AS role FROM {v_item} WHERE k % 20 = 0 UNION ALL SELECT k, 'after' FROM {v_item} WHERE k % 30 = 0
       UNION ALL SELECT k, 'context' FROM {v_item} WHERE k % 30 = 0""",
)
def input_role_faults(t: Inputs) -> DataFrame:
    return contracts.input_role_violations(t.sql(_PINNED), t.sql(_USED)).drop("reason")


@query(
    "canonical_fingerprints",
    """SELECT page_id, sha256(concat('{"name":"', CAST(page_id % 7 AS STRING), '","page":', CAST(page_id AS STRING), ',"zone":null}')) AS digest,
       concat('page-', substr(sha256(concat('{"name":"', CAST(page_id % 7 AS STRING), '","page":', CAST(page_id AS STRING), ',"zone":null}')), 1, 20)) AS short_id FROM {pages}""",
)
def canonical_fingerprints(t: Inputs) -> DataFrame:
    digest = fingerprint(
        zone=F.lit(None).cast("string"), page=F.col("page_id"), name=(F.col("page_id") % 7).cast("string")
    )
    return t.pages.select("page_id", digest.alias("digest"), short_id("page", digest).alias("short_id"))


_SOURCE_RUNS = "SELECT m.*, concat('b', CAST(run_id AS STRING)) AS before_sha256, concat('a', CAST(run_id AS STRING)) AS after_sha256 FROM ({manifests}) m".replace("{manifests}", _MANIFESTS)
_RUN_IDS = f"""SELECT run_id, concat('change-', substr(sha256(concat(
    '{{"parameters":{{"closing":1,"connectivity":8,"maximum_candidates":500,"minimum_pixels":512,"opening":1,"score_threshold":0.5,"tolerance":2}},"software_commit":"c0ffee","source_aligned_artifacts":{{"after":"',
    after_sha256, '","before":"', before_sha256, '"}},"source_processing_manifest_sha256":"', manifest_sha256, '","source_processing_run_id":"', CAST(run_id AS STRING),
    '","source_quality_report_sha256":"', quality_sha256, '"}}')), 1, 20)) AS change_run_id FROM ({_SOURCE_RUNS}) r"""


@query("change_run_ids", _RUN_IDS)
def run_ids(t: Inputs) -> DataFrame:
    return change_run_ids(t.sql(_SOURCE_RUNS), ChangePolicy(), "c0ffee").select("run_id", "change_run_id")


@query("published_runs", f"SELECT run_id, change_run_id, true AS second_refused FROM ({_RUN_IDS}) r")
def published_runs(t: Inputs) -> DataFrame:
    """Run ids written as a run's table, a second write that must fail, and the table read back."""
    root, ids = f"{checkpoint_folder(t.spark)}/sightline-runs-{uuid.uuid4().hex}", run_ids(t)
    sinks.write_run(ids, root, "change-all", "runs")
    try:
        sinks.write_run(ids.limit(0), root, "change-all", "runs")
        refused = False
    except AnalysisException:
        refused = True
    return sinks.read_run(t.spark, root, "change-all", "runs").withColumn("second_refused", F.lit(refused))


@query("checksum_faults", "SELECT doc_id FROM {documents} WHERE doc_id % 19 = 0")
def checksum_faults(t: Inputs) -> DataFrame:
    stored = F.when(F.col("doc_id") % 19 == 0, "f" * 64).otherwise(F.sha2("text", 256))
    return contracts.checksum_violations(
        t.documents.select("doc_id", F.col("text").alias("geometry_text"), stored.alias("geometry_sha256"))
    ).select("doc_id")


# Selections stored with a field missing or wrong, by their key's last digits.
_STORED = """SELECT concat('sel-', CAST(k AS STRING)) AS selection_id, concat('acq-', CAST(k AS STRING)) AS before_id, concat('acq-', CAST(k + 1 AS STRING)) AS after_id,
    'aoi-1' AS aoi_id, k, CASE WHEN k % 13 = 0 THEN NULL ELSE k % 10 END AS before_at, CASE WHEN k % 13 = 1 THEN NULL ELSE k % 7 END AS after_at,
    CASE WHEN k % 13 = 2 THEN NULL ELSE CAST(k % 5 AS DOUBLE) END AS before_overlap_percent, CASE WHEN k % 13 = 3 THEN NULL ELSE CAST(k % 6 AS DOUBLE) END AS after_overlap_percent,
    CASE WHEN k % 13 = 4 THEN NULL ELSE k % 3 > 0 END AS before_allowed, CASE WHEN k % 13 = 5 THEN NULL ELSE k % 4 > 0 END AS after_allowed,
    CASE WHEN k % 13 = 6 THEN NULL ELSE k % 11 = 0 END AS tampered FROM {v_item}"""
_SELECTION_RULES = {
    "before acquisition must precede after acquisition": "before_at < after_at", "footprints do not overlap": "before_overlap_percent > 0 AND after_overlap_percent > 0",
    "source host is not allowlisted": "before_allowed AND after_allowed", "manifest checksum does not match": "NOT tampered",
}


@query("stored_selections", " UNION ALL ".join(f"SELECT selection_id, '{reason}' AS reason FROM ({_STORED}) s WHERE ({ok}) IS NOT TRUE" for reason, ok in _SELECTION_RULES.items()))
def stored_selections(t: Inputs) -> DataFrame:
    from sightline.operators.pairs import manifest_checksum, selection_violations

    stored = F.when(~F.col("tampered"), manifest_checksum()).when(F.col("tampered"), F.lit("0" * 64))
    return selection_violations(t.sql(_STORED).withColumn("manifest_sha256", stored))


@query(
    "unset_checksums",
    """SELECT doc_id, 'doc' AS of FROM {documents} WHERE doc_id % 19 IN (0, 3, 5)
       UNION ALL SELECT doc_id, 'AOI geometry checksum does not match' FROM {documents} WHERE doc_id % 19 IN (0, 3, 5)
       UNION ALL SELECT doc_id, 'AOI polygon rings must be closed' FROM {documents} WHERE doc_id % 17 IN (1, 2, 4)""",
)
def unset_checksums(t: Inputs) -> DataFrame:
    """Documents and AOIs whose geometry, checksum or rings are missing, empty or wrong."""
    case = F.col("doc_id") % 19
    text = F.when(case != 5, F.concat(F.lit("g"), F.col("doc_id").cast("string")))
    stored = F.when(case == 0, "f" * 64).when(case != 3, F.sha2(text, 256))
    ring = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y")))
    closed, kind = F.concat(ring, F.slice(ring, 1, 1)), F.col("doc_id") % 17
    rings = F.when(kind == 1, F.array(ring)).when(kind == 2, F.array(F.slice(ring, 1, 0))).when(kind != 4, F.array(closed, closed))
    rows = t.documents.select("doc_id", F.col("doc_id").alias("bundle_id"), text.alias("geometry_text"), stored.alias("geometry_sha256"), rings.alias("rings"))
    none = rows.limit(0)
    bundles = none.select("bundle_id", F.lit("").alias("change_run_id"), F.lit("").alias("source_run_id"))
    components = none.select("bundle_id", *[F.lit("").alias(c) for c in ("name", "path", "declared_bundle_id", "version", "change_run_id", "source_run_id")])
    found = contracts.component_violations(bundles, components, none.select("bundle_id", F.lit("").alias("role"), F.lit("").alias("acquisition_id")), rows)
    return contracts.checksum_violations(rows).select("doc_id", F.lit("doc").alias("of")).unionAll(
        found.select(F.col("bundle_id").cast("bigint").alias("doc_id"), F.col("reason").alias("of"))
    )


@query("duplicate_ids", "SELECT provider, item_id, count(*) AS occurrences FROM {v_acq} GROUP BY provider, item_id HAVING count(*) > 1")
def duplicate_ids(t: Inputs) -> DataFrame:
    return duplicates(t.v_acq, ["provider", "item_id"])


@query(
    "ordered_warnings",
    """SELECT doc_id, CASE WHEN lang = source THEN lang ELSE concat(lang, ',', source) END AS warnings FROM {documents}""",
)
def ordered_warnings(t: Inputs) -> DataFrame:
    merged = contracts.ordered_distinct(F.array("lang", "source"), F.array("source", "lang"), F.array("lang"))
    return t.documents.select("doc_id", F.array_join(merged, ",").alias("warnings"))


@query(
    "manifest_faults",
    """SELECT reason, count(*) AS n FROM (SELECT 'contract version is not supported' AS reason FROM {part} WHERE p_partkey % 10 = 0
       UNION ALL SELECT 'selection id is missing' FROM {part} WHERE p_partkey % 12 = 0
       UNION ALL SELECT 'artifact checksum is not SHA-256' FROM {part} WHERE p_partkey % 14 = 0
       UNION ALL SELECT 'manifest must contain one aligned raster for each role' FROM {part} WHERE p_partkey % 16 = 0) v GROUP BY reason""",
)
def manifest_faults(t: Inputs) -> DataFrame:
    """Run manifests written and read back as JSON, then checked."""
    from sightline.schemas import RUN_MANIFEST

    k = F.col("p_partkey")
    artifact = lambda role, sha: F.struct(role.alias("role"), F.lit("aligned-raster").alias("kind"), sha.alias("sha256"))
    sound = F.lit("ab" * 32)
    text = F.to_json(
        F.struct(
            F.when(k % 10 == 0, "0.9.0").otherwise("1.0.0").alias("contract_version"), k.cast("string").alias("run_id"),
            F.when(k % 12 == 0, "").otherwise("sel").alias("selection_id"), F.struct(F.lit("EPSG:32612").alias("crs")).alias("grid"),
            F.array(
                artifact(F.lit("before"), F.when(k % 14 == 0, "zz").otherwise(sound)),
                artifact(F.when(k % 16 == 0, "before").otherwise("after"), sound),
            ).alias("artifacts"),
        )
    )
    parsed = t.part.select(F.explode(F.array(F.from_json(text, RUN_MANIFEST, {"mode": "FAILFAST"}))).alias("m")).select("m.*")
    return manifests.manifest_violations(parsed).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("stored_files")
def stored_files(t: Inputs) -> DataFrame:
    """Size, checksum and leading bytes of the table files themselves."""
    found = artifact_files.scan_files(t.spark, t.folder, "*.parquet")
    return artifact_files.relative_to(found, t.folder).select("path", "length", "sha256", F.hex("magic").alias("magic"))


@query(
    "exported_files",
    """SELECT bundle, length, sha256(body) AS sha256, left(hex(body), 16) AS magic FROM (SELECT concat('bundle=', CAST(bundle AS VARCHAR)) AS bundle,
         CAST(strlen(body) AS BIGINT) AS length, body FROM (SELECT CAST(floor(doc_id / 100) AS BIGINT) AS bundle,
           concat(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id), chr(10)) AS body FROM {documents} GROUP BY 1) b) c""",
)
def exported_files(t: Inputs) -> DataFrame:
    """Documents written as one text file per hundred ids, then found and hashed; files over 128 KiB in pieces."""
    folder = f"{checkpoint_folder(t.spark)}/sightline-files-{uuid.uuid4().hex}"
    lines = t.documents.select(F.floor(F.col("doc_id") / 100).alias("bundle"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    lines.repartition("bundle").sortWithinPartitions("bundle", "doc_id").select("bundle", "value").write.partitionBy("bundle").text(folder)
    found = artifact_files.scan_files(t.spark, folder, "*.txt", whole_bytes=1 << 17)
    return artifact_files.relative_to(found, folder).select(
        F.substring_index("path", "/", 1).alias("bundle"), "length", "sha256", F.hex("magic").alias("magic")
    )
