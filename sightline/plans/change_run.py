"""From aligned pixel tables to change candidates: the complete batch plan."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.scalars import fingerprint, short_id
from sightline.operators import raster, regions
from sightline.operators.raster import ChangePolicy
from sightline.session import reliable_checkpoint


@dataclass
class ChangeRun:
    """Tables of a change run, all keyed by ``run_id``."""

    quality: DataFrame
    cells: DataFrame
    labelled: DataFrame
    retained: DataFrame
    candidates: DataFrame
    measures: DataFrame
    crowded: DataFrame

    @property
    def funnel(self) -> DataFrame:
        return raster.run_funnel(self.cells, self.retained)

    @property
    def violations(self) -> DataFrame:
        """``(run_id, reason)`` of runs whose result does not count; the other runs of the table stand."""
        flat = self.quality.where("normalization_low >= normalization_high").select(
            "run_id", F.lit("raster has no usable normalization range").alias("reason")
        ).distinct()
        valid = self.cells.groupBy("run_id").agg(F.count_if("common_valid").alias("n"))
        none = valid.where("n = 0").select("run_id", F.lit("no common valid pixels after edge guard").alias("reason"))
        many = self.crowded.select("run_id", F.lit("more candidates than the policy allows").alias("reason"))
        return flat.unionByName(none).unionByName(many)


def change_run_ids(runs: DataFrame, policy: ChangePolicy, software_commit: str) -> DataFrame:
    """``runs`` with ``change_run_id``: the same inputs, parameters and software always give the same id.

    ``runs(run_id, manifest_sha256, quality_sha256, before_sha256, after_sha256)`` are the source runs.
    """
    digest = fingerprint(
        parameters=F.struct(*[F.lit(value).alias(name) for name, value in sorted(asdict(policy).items())]),
        software_commit=F.lit(software_commit),
        source_aligned_artifacts=F.struct(F.col("after_sha256").alias("after"), F.col("before_sha256").alias("before")),
        source_processing_manifest_sha256=F.col("manifest_sha256"),
        source_processing_run_id=F.col("run_id").cast("string"),
        source_quality_report_sha256=F.col("quality_sha256"),
    )
    return runs.withColumn("change_run_id", short_id("change", digest))


def holds_every_cell(pixels: DataFrame, grids: DataFrame) -> bool:
    """Whether each role of each run has as many rows as its grid has cells."""
    counts = pixels.groupBy("run_id", "role").agg(F.count(F.lit(1)).alias("n"))
    cells = grids.select("run_id", (F.col("width").cast("bigint") * F.col("height")).alias("cells"))
    return not counts.join(cells, "run_id", "left").where("n IS DISTINCT FROM cells").limit(1).count()


def normalised_cells(pixels: DataFrame, grids: DataFrame, lower: float = 2.0, upper: float = 98.0) -> DataFrame:
    """Every grid cell with both stretched values."""
    quality = raster.role_quality(pixels, lower, upper)
    return raster.normalise_pair(raster.pair_roles(pixels, grids), quality)


def detect_changes(
    pixels: DataFrame, grids: DataFrame, policy: ChangePolicy, lower: float = 2.0, upper: float = 98.0,
    dense: bool = False,
) -> ChangeRun:
    """Stretch, score, clean, label, retain and measure all runs of a pixel table.

    The scored cells are written once: labels, measures and counts read them.  Say
    ``dense`` when ``pixels`` holds a row (NULL for nodata) for every cell of a role; row counts are
    checked, and missing cells are added when they do not bear it out.
    """
    dense = dense and holds_every_cell(pixels, grids)
    quality = reliable_checkpoint(raster.role_quality(pixels, lower, upper))
    cells = reliable_checkpoint(
        raster.score_pixels(pixels, quality, policy, None if dense else grids)
    )
    mask = cells.where("cleaned").select("run_id", "row", "col")
    labelled = reliable_checkpoint(regions.label_components(mask, policy.connectivity))
    retained = regions.retain_components(labelled, policy)
    crowded = regions.crowded_runs(regions.component_sizes(labelled, policy), policy.maximum_candidates)
    candidates = reliable_checkpoint(regions.candidate_cells(labelled, retained))
    measures = regions.candidate_measures(candidates, cells.where("cleaned"), grids)
    return ChangeRun(quality, cells, labelled, retained, candidates, measures, crowded)
