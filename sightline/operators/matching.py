"""One-to-one matching of predictions to references by overlap."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.components import connected_components
from sightline.session import reliable_checkpoint, ship_by_value, spread

ship_by_value(__name__)

MATCH_SCHEMA = "case_id string, prediction bigint, reference bigint"


def _augment(start: int, wishes: dict[int, list[int]], owner: dict[int, int]) -> bool:
    """Search one augmenting path from ``start`` and flip it into ``owner``."""
    seen: set[int] = set()
    trail, tried = [(start, iter(wishes[start]))], []
    while trail:
        ref = next((r for r in trail[-1][1] if r not in seen), None)
        if ref is None:
            trail.pop()
            if tried:
                tried.pop()
            continue
        seen.add(ref)
        tried.append(ref)
        if ref not in owner:
            owner.update({r: p for (p, _), r in zip(trail, tried)})
            return True
        trail.append((owner[ref], iter(wishes[owner[ref]])))
    return False


def _match_component(edges: pd.DataFrame) -> pd.DataFrame:
    ordered = edges.sort_values(["prediction", "iou", "reference"], ascending=[True, False, True])
    wishes = {int(p): [int(r) for r in g] for p, g in ordered.groupby("prediction", sort=True)["reference"]}
    owner: dict[int, int] = {}
    for prediction in wishes:
        _augment(prediction, wishes, owner)
    return pd.DataFrame(
        {
            "case_id": edges.case_id.iloc[0],
            "prediction": list(owner.values()),
            "reference": list(owner.keys()),
        }
    )


def match_regions(overlaps: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Maximum one-to-one matching of ``(case_id, prediction, reference, iou)``.

    Predictions are served in order, each trying its best overlap first.  A reference
    wanted only by predictions with no other choice goes to the first of them: a
    grouped minimum.  Only what is left goes to components, after dropping copies that
    can never win: of the predictions of a case with the same ordered wish list, no
    more than the length of that list can be matched, and always the first ones.
    """
    eligible = spread(reliable_checkpoint(overlaps.where(F.col("iou") >= threshold).select("case_id", "prediction", "reference", "iou")))
    choices = eligible.groupBy("case_id", "prediction").agg(F.count(F.lit(1)).alias("_choices"))
    edges = eligible.join(choices, ["case_id", "prediction"])
    stars = edges.groupBy("case_id", "reference").agg(
        F.max("_choices").alias("_busiest"), F.min("prediction").alias("prediction")
    )
    simple = stars.where(F.col("_busiest") == 1).select("case_id", "prediction", "reference")
    tangled = spread(
        reliable_checkpoint(
            edges.join(stars.where(F.col("_busiest") > 1).select("case_id", "reference"), ["case_id", "reference"], "left_semi")
        )
    )
    if tangled.limit(1).count() == 0:
        return simple
    return simple.unionByName(_match_tangled(tangled))


def _match_tangled(edges: DataFrame) -> DataFrame:
    edges = spread(reliable_checkpoint(_without_hopeless_copies(edges)))
    graph = edges.select("case_id", (F.col("prediction") * 2).alias("u"), (F.col("reference") * 2 + 1).alias("v"))
    roots = connected_components(graph, "case_id")
    placed = edges.join(
        roots.select("case_id", F.col("node").alias("_node"), "root"),
        (F.col("_node") == F.col("prediction") * 2) & (edges["case_id"] == roots["case_id"]),
    ).select(edges["case_id"], "prediction", "reference", "iou", "root")
    return placed.groupBy("case_id", "root").applyInPandas(_match_component, MATCH_SCHEMA)


def _without_hopeless_copies(edges: DataFrame) -> DataFrame:
    """Cut each group of equal wish lists to as many predictions as the list is long."""
    from sightline.operators.ranking import ranked

    lists = edges.groupBy("case_id", "prediction").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("iou")).alias("o"), "reference"))).alias("_w")
    ).select(
        "case_id", "prediction", F.size("_w").alias("_length"),
        F.sha2(F.to_json(F.transform("_w", lambda s: s["reference"])), 256).alias("_list"),
    )
    placed = ranked(lists, ["case_id", "_list"], ["prediction"], "_copy")
    kept = placed.where(F.col("_copy") <= F.col("_length")).select("case_id", "prediction")
    return edges.join(kept, ["case_id", "prediction"], "left_semi").select("case_id", "prediction", "reference", "iou")
