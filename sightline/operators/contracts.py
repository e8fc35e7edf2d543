"""Contract checks: every breach is a row, an empty result is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.scalars import broken
from sightline.operators.evaluation import duplicates

MAX_ARTIFACT_BYTES = 256 * 1024 * 1024

# Leading bytes of checked media types: fixed values.
SIGNATURES = {"image/png": "89504E470D0A1A0A", "application/pdf": "255044462D"}


def _reasons(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(breach, reason) for breach, reason in rules]))


def _violations(df: DataFrame, *subject: str, rules: list[tuple[Column, str]]) -> DataFrame:
    return df.select(*subject, F.explode(_reasons(*rules)).alias("reason"))


def stack(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def safe_path(path: Column) -> Column:
    """Relative, canonical, no parent steps, no scheme, no backslash."""
    odd = path.rlike(r"\\|://|\x00") | path.startswith("/")
    parts = F.split(path, "/")
    return F.coalesce(
        ~odd & ~F.exists(parts, lambda p: p.isin("", ".", "..")), F.lit(False)
    )


def artifact_audit(
    declared: DataFrame, files: DataFrame, max_bytes: int = MAX_ARTIFACT_BYTES
) -> DataFrame:
    """First fault of each declared artifact against the files found, and files that nothing declares.

    ``declared(bundle_id, artifact_id, path, media_type, status, size_bytes, sha256)``,
    ``files(bundle_id, path, length, sha256, magic)``.
    """
    found = files.select(
        "bundle_id", "path", F.col("length").alias("f_length"), F.col("sha256").alias("f_sha256"),
        F.hex("magic").alias("f_magic"),
    )
    signature = F.try_element_at(
        F.create_map(*[F.lit(v) for pair in SIGNATURES.items() for v in pair]), F.col("media_type")
    )
    missing = F.col("status") == "missing"
    present = F.col("f_length").isNotNull()
    reason = (
        F.when(F.col("_undeclared"), "file is not declared")
        .when(~safe_path(F.col("path")), "path is unsafe")
        .when(missing & present, "artifact marked missing is present")
        .when(missing, None)
        .when(~present, "file is missing")
        .when((F.col("f_length") <= 0) | (F.col("f_length") > max_bytes), "file exceeds its size limit")
        .when(~F.col("f_length").eqNullSafe(F.col("size_bytes")), "file size changed")
        .when(~F.col("f_sha256").eqNullSafe(F.col("sha256")), "file checksum changed")
        .when(signature.isNotNull() & ~F.col("f_magic").startswith(signature), "signature does not match media type")
    )
    both = declared.withColumn("_declared", F.lit(True)).join(found, ["bundle_id", "path"], "full")
    return both.withColumn("_undeclared", F.col("_declared").isNull()).select(
        "bundle_id", "artifact_id", "path", reason.alias("reason")
    )


def artifact_violations(declared: DataFrame, files: DataFrame) -> DataFrame:
    """Audit faults plus reused ids and paths."""
    audit = artifact_audit(declared, files).where(F.col("reason").isNotNull()).select(
        "bundle_id", F.coalesce("artifact_id", "path").alias("subject"), "reason"
    )
    ids = duplicates(declared, ["bundle_id", "artifact_id"]).select(
        "bundle_id", F.col("artifact_id").alias("subject"), F.lit("artifact ID is duplicated").alias("reason")
    )
    paths = duplicates(declared, ["bundle_id", "path"]).select(
        "bundle_id", F.col("path").alias("subject"), F.lit("artifact path is reused").alias("reason")
    )
    return stack(audit, ids, paths)


def bundle_state_violations(bundles: DataFrame, declared: DataFrame) -> DataFrame:
    """``bundles(bundle_id, status, warning_count)`` against their missing artifacts."""
    missing = declared.where("status = 'missing'").groupBy("bundle_id").agg(F.count(F.lit(1)).alias("_missing"))
    state = bundles.join(missing, "bundle_id", "left").na.fill(0, ["_missing"])
    return _violations(
        state, "bundle_id",
        rules=[
            ((F.col("status") == "succeeded") & (F.col("_missing") > 0), "succeeded bundle has missing artifacts"),
            ((F.col("status") == "partial") & (F.col("_missing") == 0), "partial bundle declares no missing artifact"),
            ((F.col("status") == "partial") & (F.col("warning_count") == 0), "partial bundle explains nothing"),
        ],
    )


def available_artifacts(declared: DataFrame) -> DataFrame:
    return declared.where("status <> 'missing'").select("bundle_id", "artifact_id").distinct()


def unresolved_evidence(holders: DataFrame, available: DataFrame, id_column: str) -> DataFrame:
    """Evidence ids of ``holders(bundle_id, <id>, evidence_artifact_ids)`` that resolve to nothing."""
    used = holders.select(
        "bundle_id", F.col(id_column).alias("subject"), F.explode("evidence_artifact_ids").alias("artifact_id")
    )
    return used.join(available, ["bundle_id", "artifact_id"], "left_anti").select(
        "bundle_id", "subject", F.lit("references an unavailable artifact").alias("reason")
    )


def unknown_candidates(rows: DataFrame, candidates: DataFrame, id_column: str, reason: str) -> DataFrame:
    known = candidates.select("bundle_id", "candidate_id").distinct()
    return rows.join(known, ["bundle_id", "candidate_id"], "left_anti").select(
        "bundle_id", F.col(id_column).alias("subject"), F.lit(reason).alias("reason")
    )


def supersession_violations(assessments: DataFrame) -> DataFrame:
    """File form of the log: a superseded id must name an earlier event of the bundle."""
    earlier = assessments.select(
        "bundle_id", F.col("assessment_id").alias("supersedes_event_id"), F.col("seq").alias("_at")
    ).groupBy("bundle_id", "supersedes_event_id").agg(F.min("_at").alias("_at"))
    follow = assessments.where(F.col("supersedes_event_id").isNotNull())
    joined = follow.join(earlier, ["bundle_id", "supersedes_event_id"], "left")
    return joined.where(F.col("_at").isNull() | (F.col("_at") >= F.col("seq"))).select(
        "bundle_id", F.col("assessment_id").alias("subject"),
        F.lit("supersedes an unknown or later event").alias("reason"),
    )


def repeated_ids(rows: DataFrame, id_column: str, reason: str) -> DataFrame:
    return duplicates(rows, ["bundle_id", id_column]).select("bundle_id", F.col(id_column).alias("subject"), F.lit(reason).alias("reason"))


def summary_violations(summaries: DataFrame, candidates: DataFrame, available: DataFrame) -> DataFrame:
    """``summaries(bundle_id, candidate_ids, artifact_ids)`` must name candidates and artifacts of their bundle."""
    named = summaries.select("bundle_id", F.explode("candidate_ids").alias("candidate_id"))
    used = summaries.select("bundle_id", F.explode("artifact_ids").alias("artifact_id"))
    return unknown_candidates(named, candidates, "candidate_id", "summary names an unknown candidate").unionByName(
        used.join(available, ["bundle_id", "artifact_id"], "left_anti").select(
            "bundle_id", F.col("artifact_id").alias("subject"), F.lit("summary names an unavailable artifact").alias("reason")
        )
    )


def reference_violations(
    declared: DataFrame, candidates: DataFrame, assessments: DataFrame, summaries: DataFrame | None = None
) -> DataFrame:
    """Candidate, assessment, summary and artifact ids of every bundle must resolve, and ids must not repeat."""
    available = available_artifacts(declared)
    extra = [] if summaries is None else [summary_violations(summaries, candidates, available)]
    return stack(
        *extra,
        repeated_ids(candidates, "candidate_id", "candidate ID is duplicated"),
        repeated_ids(assessments, "assessment_id", "assessment ID is duplicated"),
        unresolved_evidence(candidates, available, "candidate_id"),
        unresolved_evidence(assessments, available, "assessment_id"),
        unknown_candidates(assessments, candidates, "assessment_id", "assessment references an unknown candidate"),
        supersession_violations(assessments),
    )


def component_violations(bundles: DataFrame, components: DataFrame, acquisitions: DataFrame, aois: DataFrame) -> DataFrame:
    """Bundle-wide identity: components, roles, run ids, AOI rings and checksum.

    ``bundles(bundle_id, change_run_id, source_run_id)``,
    ``components(bundle_id, name, path, declared_bundle_id, version, change_run_id, source_run_id)``,
    ``acquisitions(bundle_id, role, acquisition_id)``,
    ``aois(bundle_id, rings, geometry_text, geometry_sha256)``.
    """
    joined = components.join(
        bundles.select(
            "bundle_id", F.col("change_run_id").alias("_change"), F.col("source_run_id").alias("_source")
        ), "bundle_id",
    )
    per_component = _violations(
        joined, "bundle_id", "name",
        rules=[
            (~F.col("declared_bundle_id").eqNullSafe(F.col("bundle_id")), "component has a different bundle ID"),
            (~F.col("version").eqNullSafe("1.0.0"), "component has a different contract version"),
            ((F.col("name") == "candidates") & ~F.col("change_run_id").eqNullSafe(F.col("_change")),
             "candidate and manifest change-run IDs differ"),
            ((F.col("name") == "candidates") & ~F.col("source_run_id").eqNullSafe(F.col("_source")),
             "candidate and manifest processing-run IDs differ"),
        ],
    ).withColumnRenamed("name", "subject")
    reused = duplicates(components, ["bundle_id", "path"]).select(
        "bundle_id", F.col("path").alias("subject"), F.lit("component path is reused").alias("reason")
    )
    ends = lambda r: F.try_element_at(r, F.lit(1)) == F.try_element_at(r, F.lit(-1))
    closed = (F.size("rings") > 0) & F.forall("rings", lambda r: F.coalesce(ends(r), F.lit(False)))
    aoi = _violations(
        aois.withColumn("subject", F.lit("aoi")), "bundle_id", "subject",
        rules=[
            (broken(F.sha2("geometry_text", 256) == F.col("geometry_sha256")), "AOI geometry checksum does not match"),
            (broken(closed), "AOI polygon rings must be closed"),
        ],
    )
    return stack(per_component, reused, role_violations(bundles, acquisitions), aoi)


def role_violations(bundles: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """Exactly one before and one after acquisition for every bundle, with distinct ids."""
    roles = acquisitions.groupBy("bundle_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("role") == "before").alias("b"), F.count_if(F.col("role") == "after").alias("a"),
    )
    every = bundles.select("bundle_id").distinct().join(roles, "bundle_id", "full")
    wrong = every.where("coalesce(n, 0) <> 2 OR b <> 1 OR a <> 1").select(
        "bundle_id", F.lit("acquisitions").alias("subject"),
        F.lit("acquisitions must contain exactly before and after roles").alias("reason"),
    )
    twice = duplicates(acquisitions, ["bundle_id", "acquisition_id"]).select(
        "bundle_id", F.col("acquisition_id").alias("subject"), F.lit("acquisition IDs must be unique").alias("reason")
    )
    return wrong.unionByName(twice)


def display_violations(
    views: DataFrame, acquisitions: DataFrame, candidates: DataFrame, artifacts: DataFrame
) -> DataFrame:
    """Rules of a display bundle; ``views(bundle_id, freshness, freshness_reason, permission, permission_reason)``."""
    state = _violations(
        views.withColumn("subject", F.lit("bundle")), "bundle_id", "subject",
        rules=[
            (broken(F.col("freshness").isin("current", "stale")), "freshness state is unknown"),
            ((F.col("freshness") == "stale") & F.col("freshness_reason").isNull(), "stale bundle needs a reason"),
            (broken(F.col("permission").isin("allowed", "denied")), "permission state is unknown"),
            ((F.col("permission") == "denied") & F.col("permission_reason").isNull(), "denied permission needs a reason"),
        ],
    )
    twice = duplicates(candidates, ["bundle_id", "candidate_id"]).select(
        "bundle_id", F.col("candidate_id").alias("subject"), F.lit("duplicate candidate ID").alias("reason")
    )
    return stack(
        state, role_violations(views, acquisitions), twice,
        unresolved_evidence(candidates, artifacts.select("bundle_id", "artifact_id").distinct(), "candidate_id"),
    )


def uncited(observations: DataFrame, citations: DataFrame) -> DataFrame:
    """Observations whose citation the case does not declare."""
    return observations.join(
        citations.select("case_id", "citation_id").distinct(), ["case_id", "citation_id"], "left_anti"
    )


def case_violations(
    cases: DataFrame, acquisitions: DataFrame, observations: DataFrame, citations: DataFrame, residuals: DataFrame
) -> DataFrame:
    """Rules of investigation cases; a case without any acquisition, citation or residual breaks them too.

    ``cases(case_id)``, ``acquisitions(case_id, position, role, checksum)``, ``residuals(case_id, metres)``.
    """
    order = acquisitions.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("role", "position").alias("first"), F.max_by("role", "position").alias("last"),
    )
    cases = cases.select("case_id").distinct()
    order = cases.join(order, "case_id", "full")
    five = cases.join(residuals.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")), "case_id", "full")
    counts = cases.join(
        citations.groupBy("case_id").agg(F.count(F.lit(1)).alias("_cites")), "case_id", "left"
    ).join(observations.groupBy("case_id").agg(F.count(F.lit(1)).alias("_seen")), "case_id", "left")

    def rows(df: DataFrame, subject: str, reason: str) -> DataFrame:
        return df.select("case_id", F.col(subject).cast("string").alias("subject"), F.lit(reason).alias("reason"))

    return stack(
        rows(order.where("coalesce(n, 0) <> 2 OR first IS DISTINCT FROM 'before' OR last IS DISTINCT FROM 'after'"), "case_id",
             "acquisitions must be ordered before, then after"),
        rows(acquisitions.where(~F.coalesce(F.col("checksum").rlike("^[a-f0-9]{64}$"), F.lit(False))), "role", "checksum must be SHA-256"),
        rows(counts.where(F.col("_cites").isNull()), "case_id", "citations must be a non-empty list"),
        rows(counts.where(F.col("_seen").isNull()), "case_id", "observations must be a non-empty list"),
        rows(duplicates(citations, ["case_id", "citation_id"]), "citation_id", "citation IDs must be unique"),
        rows(duplicates(observations, ["case_id", "observation_id"]), "observation_id", "observation IDs must be unique"),
        rows(uncited(observations, citations), "observation_id", "citation is not declared"),
        rows(five.where("coalesce(n, 0) <> 5"), "case_id", "residuals must contain five controls"),
    )


def attribution_violations(cases: DataFrame, attributions: DataFrame, residuals: DataFrame, thumbnails: DataFrame,
                           mission_notice: str = "Copernicus Sentinel") -> DataFrame:
    """Attribution, alignment and thumbnail rules; ``cases(case_id, tolerance_metres)``."""
    credit = attributions.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("_credits"), F.bool_or(F.contains("attribution", F.lit(mission_notice))).alias("_mission")
    )
    worst = residuals.groupBy("case_id").agg(F.max("metres").alias("_worst"), F.count(F.lit(1)).alias("_controls"))
    small = thumbnails.groupBy("case_id").agg(F.min(F.least("width", "height")).alias("_smallest"))
    joined = cases.join(credit, "case_id", "left").join(worst, "case_id", "left").join(small, "case_id", "left")
    return _violations(
        joined, "case_id",
        rules=[
            ((F.coalesce("_credits", F.lit(0)) < 3) | ~F.coalesce("_mission", F.lit(False)),
             "required source attribution is missing"),
            ((F.coalesce("_controls", F.lit(0)) != 5) | (F.col("_worst") > F.col("tolerance_metres")),
             "five-point grid alignment is outside tolerance"),
            (F.coalesce("_smallest", F.lit(0)) < 640, "thumbnail is too small"),
        ],
    )


def lineage_violations(runs: DataFrame, manifests: DataFrame, features: DataFrame) -> DataFrame:
    """Change runs against the processing runs and candidate collections they cite.

    ``runs(run_id, source_run_id, source_manifest_sha256, source_quality_sha256, candidate_count)``,
    ``manifests(run_id, manifest_sha256, quality_sha256)``, ``features(run_id, feature_run_id)``.
    """
    source = manifests.select(
        F.col("run_id").alias("source_run_id"), F.col("manifest_sha256").alias("_m"), F.col("quality_sha256").alias("_q")
    )
    found = features.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("feature_run_id") != F.col("run_id")).alias("_foreign")
    )
    joined = runs.join(source, "source_run_id", "left").join(found, "run_id", "left")
    known = F.col("_m").isNotNull()
    return _violations(
        joined, "run_id",
        rules=[
            (~known, "change and processing runs do not share lineage"),
            (known & ~F.col("source_manifest_sha256").eqNullSafe(F.col("_m")), "processing manifest checksum does not match"),
            (known & ~F.col("source_quality_sha256").eqNullSafe(F.col("_q")), "quality report checksum does not match"),
            (F.coalesce("_n", F.lit(0)) != F.col("candidate_count"), "candidate count does not match change manifest"),
            (F.coalesce("_foreign", F.lit(0)) > 0, "candidate feature does not match the change run"),
        ],
    )


def input_role_violations(selections: DataFrame, inputs: DataFrame) -> DataFrame:
    """Run inputs ``(run_id, role, item_id)`` that differ from the pinned selection."""
    pinned = selections.select("run_id", "role", F.col("item_id").alias("_pinned"))
    both = pinned.join(inputs.select("run_id", "role", F.col("item_id").alias("_used")), ["run_id", "role"], "full_outer")
    return both.where(~F.col("_pinned").eqNullSafe(F.col("_used"))).select(
        "run_id", "role", F.lit("processing inputs do not match pinned acquisitions").alias("reason")
    )


def parameter_violations(runs: DataFrame) -> DataFrame:
    """Run parameters that are NULL or outside their declared ranges."""
    c = F.col
    return _violations(
        runs, "run_id",
        rules=[
            (broken((c("score_threshold") > 0) & (c("score_threshold") <= 1)), "score threshold is out of range"),
            (broken(c("tolerance").between(0, 3)), "registration tolerance is out of range"),
            (broken(c("opening").between(0, 3)), "opening iterations are out of range"),
            (broken(c("closing").between(0, 3)), "closing iterations are out of range"),
            (broken(c("connectivity").isin(4, 8)), "connectivity must be 4 or 8"),
            (broken(c("minimum_pixels") >= 1), "minimum component size is out of range"),
            (broken(c("maximum_candidates").between(1, 10000)), "maximum candidate count is out of range"),
            (broken(c("resolution") > 0), "target resolution must be positive"),
            (broken(c("lower_percentile").between(0, 100) & c("upper_percentile").between(0, 100)), "percentile is out of range"),
            (broken(c("lower_percentile") < c("upper_percentile")), "lower percentile must be less than upper percentile"),
            (broken(c("thumbnail_max_size").between(64, 2048)), "thumbnail size is out of range"),
            (broken((c("min_valid_fraction") > 0) & (c("min_valid_fraction") <= 1)), "minimum valid fraction is out of range"),
        ],
    )


def ordered_distinct(*warnings: Column) -> Column:
    """Concatenate warning lists, keeping the first of each text."""
    return F.array_distinct(F.concat(*warnings))


def checksum_violations(documents: DataFrame) -> DataFrame:
    """Documents ``(doc_id, geometry_text, geometry_sha256)`` whose stored checksum is wrong or missing, or that have no geometry."""
    return documents.where(broken(F.sha2("geometry_text", 256) == F.col("geometry_sha256"))).select(
        "doc_id", F.lit("geometry checksum does not match").alias("reason")
    )
