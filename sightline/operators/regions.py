"""Candidate regions: labels, retention, measurements and outlines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.components import connected_components
from sightline.operators.ranking import exact_percentiles, ranked
from sightline.operators.raster import ChangePolicy
from sightline.session import reliable_checkpoint, ship_by_value, small_side

ship_by_value(__name__)

LABEL_BLOCK = 256
SMALL_OUTLINE = 50_000


PIECE_SCHEMA = "run_id string, row int, col int, piece bigint"


def _label_block(connectivity: int):
    """Labeller of one block: joined cells share the least cell id among them."""
    steps = ((0, 1), (1, 0), (1, 1), (1, -1)) if connectivity == 8 else ((0, 1), (1, 0))

    def label(cells: pd.DataFrame) -> pd.DataFrame:
        row, col = cells["row"].to_numpy("int64"), cells["col"].to_numpy("int64")
        ident = (row << 31) + col
        order = np.argsort(ident)
        row, col, ident = row[order], col[order], ident[order]
        a, b = [], []
        for dr, dc in steps:
            other = ((row + dr) << 31) + (col + dc)
            at = np.minimum(np.searchsorted(ident, other), len(ident) - 1)
            hit = np.flatnonzero(ident[at] == other)
            a.append(hit)
            b.append(at[hit])
        a, b = np.concatenate(a), np.concatenate(b)
        root = np.arange(len(ident))
        while True:
            low = np.minimum(root[a], root[b])
            pulled = root.copy()
            np.minimum.at(pulled, root[a], low)
            np.minimum.at(pulled, root[b], low)
            while not np.array_equal(pulled, pulled[pulled]):
                pulled = pulled[pulled]
            if np.array_equal(pulled, root):
                break
            root = pulled
        return pd.DataFrame({"run_id": cells["run_id"].iloc[0], "row": row, "col": col, "piece": ident[root]})

    return label


def label_components(mask: DataFrame, connectivity: int = 8, size: int = LABEL_BLOCK) -> DataFrame:
    """``(run_id, row, col, root)``: cells of one component share their first cell's id.

    Every block (at most ``size`` squared cells) is labelled inside its own task; only
    the pieces that touch across a block border become graph edges.
    """
    br, bc = F.floor(F.col("row") / size).alias("_br"), F.floor(F.col("col") / size).alias("_bc")
    blocks = mask.select("run_id", "row", "col", br, bc).groupBy("run_id", "_br", "_bc")
    pieces = reliable_checkpoint(blocks.applyInPandas(_label_block(connectivity), PIECE_SCHEMA))
    r, c = F.col("row"), F.col("col")
    step = lambda dr, dc: F.struct((r + dr).alias("row"), (c + dc).alias("col"))
    bottom, right, left = (r + 1) % size == 0, (c + 1) % size == 0, c % size == 0
    diagonal = connectivity == 8
    over = F.array_compact(
        F.array(
            F.when(bottom, step(1, 0)), F.when(right, step(0, 1)),
            *([F.when(bottom | right, step(1, 1)), F.when(bottom | left, step(1, -1))] if diagonal else []),
        )
    )
    leaving = pieces.where(bottom | right | left).select(
        "run_id", F.col("piece").alias("u"), F.explode(over).alias("_n")
    ).select("run_id", "u", "_n.row", "_n.col")
    edges = leaving.join(pieces.withColumnRenamed("piece", "v"), ["run_id", "row", "col"]).select("run_id", "u", "v")
    roots = connected_components(edges).withColumnRenamed("node", "piece")
    return pieces.join(roots, ["run_id", "piece"], "left").select(
        "run_id", "row", "col", F.coalesce("root", "piece").alias("root")
    )


def component_sizes(labelled: DataFrame, policy: ChangePolicy) -> DataFrame:
    """``(run_id, root, pixel_count)`` of the components of at least the minimum size."""
    sizes = labelled.groupBy("run_id", "root").agg(F.count(F.lit(1)).alias("pixel_count"))
    return reliable_checkpoint(sizes.where(F.col("pixel_count") >= policy.minimum_pixels))


def crowded_runs(sizes: DataFrame, maximum: int) -> DataFrame:
    """``(run_id, candidate_count)`` of runs with more components than a run may have."""
    return sizes.groupBy("run_id").agg(F.count(F.lit(1)).alias("candidate_count")).where(F.col("candidate_count") > maximum)


def retain_components(labelled: DataFrame, policy: ChangePolicy) -> DataFrame:
    """Components of at least the minimum size, numbered in scan order per run.

    ``(run_id, root, pixel_count, label)``.  A run with more than the policy's maximum is refused whole,
    as ``crowded_runs`` reports, and the others stand.  Numbers come from a range sort.
    """
    sizes = component_sizes(labelled, policy)
    sizes = sizes.join(crowded_runs(sizes, policy.maximum_candidates), "run_id", "left_anti")
    return ranked(sizes, ["run_id"], ["root"], "label").withColumn("label", F.col("label").cast("int"))


def candidate_cells(labelled: DataFrame, retained: DataFrame) -> DataFrame:
    """Cells of the retained components with their label."""
    return labelled.join(retained.select("run_id", "root", "label"), ["run_id", "root"]).select(
        "run_id", "label", "row", "col"
    )


def candidate_measures(cells: DataFrame, scored: DataFrame, grids: DataFrame) -> DataFrame:
    """Size, extent and score components of every candidate.

    ``cells(run_id, label, row, col)``, ``scored`` the output of ``score_cells``,
    ``grids(run_id, resolution, minx, maxy, …)``.
    """
    keys = ["run_id", "label"]
    pixels = cells.join(
        scored.select(
            "run_id", "row", "col", "score", (F.col("after") - F.col("before")).alias("delta")
        ),
        ["run_id", "row", "col"],
    )
    pixels = reliable_checkpoint(pixels.select(*keys, "row", "col", "score", "delta"))
    basic = pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pixel_count"),
        F.avg("score").alias("mean_change_score"),
        F.max("score").alias("max_change_score"),
        F.avg("delta").alias("mean_signed_delta"),
        F.avg((F.col("delta") > 0).cast("double")).alias("brightening_fraction"),
        F.avg((F.col("delta") < 0).cast("double")).alias("darkening_fraction"),
        F.min("row").alias("min_row"), F.max("row").alias("max_row"),
        F.min("col").alias("min_col"), F.max("col").alias("max_col"),
    )
    p95 = exact_percentiles(pixels, keys, "score", {"p95_change_score": 0.95})
    g = small_side(grids.select("run_id", "resolution", F.col("minx").alias("_gx"), F.col("maxy").alias("_gy")))
    res = F.col("resolution")
    return (
        basic.join(p95, keys, "left").join(g, "run_id")
        .withColumn("area_square_meters", F.col("pixel_count") * res * res)
        .withColumn("minx", F.col("_gx") + F.col("min_col") * res)
        .withColumn("maxx", F.col("_gx") + (F.col("max_col") + 1) * res)
        .withColumn("miny", F.col("_gy") - (F.col("max_row") + 1) * res)
        .withColumn("maxy", F.col("_gy") - F.col("min_row") * res)
        .withColumn("candidate_id", candidate_id(F.col("run_id"), F.col("label")))
        .drop("_gx", "_gy", "resolution")
    )


def candidate_id(run_id: Column, label: Column) -> Column:
    return F.concat(run_id, F.lit("-candidate-"), F.format_string("%04d", label))


def display_id(label: Column) -> Column:
    return F.concat(F.lit("C-"), F.format_string("%03d", label))


# --- outlines ---------------------------------------------------------------------

# Directions of boundary steps with the region on the right-hand side.
EAST, SOUTH, WEST, NORTH = 0, 1, 2, 3


def _boundary_steps(cells: DataFrame) -> DataFrame:
    """Unit boundary steps: cell sides that no second cell of the label shares."""
    side = lambda kind, r, c, sign: F.struct(
        F.lit(kind).alias("kind"), r.alias("r"), c.alias("c"), F.lit(sign).alias("sign")
    )
    r, c = F.col("row"), F.col("col")
    sides = cells.select(
        "run_id", "label",
        F.explode(F.array(side("h", r, c, 1), side("h", r + 1, c, -1), side("v", r, c, 1), side("v", r, c + 1, -1))).alias("_s"),
    )
    kept = sides.groupBy("run_id", "label", "_s.kind", "_s.r", "_s.c").agg(F.sum("_s.sign").alias("sign")).where("sign <> 0")
    horizontal = F.col("kind") == "h"
    direction = (
        F.when(horizontal & (F.col("sign") > 0), EAST).when(horizontal, WEST)
        .when(F.col("sign") > 0, NORTH).otherwise(SOUTH)
    )
    return kept.select("run_id", "label", "r", "c", direction.alias("dir"))


def outline_segments(cells: DataFrame) -> DataFrame:
    """Straight boundary segments ``(run_id, label, dir, r0, c0, r1, c1)``."""
    steps = _boundary_steps(cells)
    lying = F.col("dir").isin(EAST, WEST)
    along, across = F.when(lying, F.col("c")).otherwise(F.col("r")), F.when(lying, F.col("r")).otherwise(F.col("c"))
    placed = steps.select("run_id", "label", "dir", across.alias("_across"), along.alias("_along"))
    line = Window.partitionBy("run_id", "label", "dir", "_across").orderBy("_along")
    grouped = placed.withColumn("_island", F.col("_along") - F.row_number().over(line))
    spans = grouped.groupBy("run_id", "label", "dir", "_across", "_island").agg(
        F.min("_along").alias("lo"), (F.max("_along") + 1).alias("hi")
    )
    forward = F.col("dir").isin(EAST, SOUTH)
    lying = F.col("dir").isin(EAST, WEST)
    start, end = F.when(forward, F.col("lo")).otherwise(F.col("hi")), F.when(forward, F.col("hi")).otherwise(F.col("lo"))
    return spans.select(
        "run_id", "label", "dir",
        F.when(lying, F.col("_across")).otherwise(start).alias("r0"),
        F.when(lying, start).otherwise(F.col("_across")).alias("c0"),
        F.when(lying, F.col("_across")).otherwise(end).alias("r1"),
        F.when(lying, end).otherwise(F.col("_across")).alias("c1"),
    )


OUTLINE_SCHEMA = "run_id string, label int, ring bigint, position bigint, r int, c int"


def _stitch_small(group: pd.DataFrame) -> pd.DataFrame:
    """Walk the segments of whole labels, any number of them, into rings, turning left where two rings touch."""
    n = len(group)
    owner = group.groupby(["run_id", "label"], sort=False).ngroup().to_numpy()
    d, r0, c0, r1, c1 = (group[name].to_numpy().astype(np.int64) for name in ("dir", "r0", "c0", "r1", "c1"))
    # Number the corners of each label; at most two segments leave one, in different directions.
    corners = np.stack([np.r_[c0, c1], np.r_[r0, r1], np.r_[owner, owner]])
    order = np.lexsort(corners)
    change = (corners[:, order[1:]] != corners[:, order[:-1]]).any(axis=0)
    corner = np.empty(2 * n, np.int64)
    corner[order] = np.cumsum(np.r_[0, change])
    leaving = np.full((n, 4), -1)
    leaving[corner[:n], d] = np.arange(n)
    left, right = leaving[corner[n:], (d + 3) % 4], leaving[corner[n:], (d + 1) % 4]
    following = np.where(left >= 0, left, right)
    # Ring: least segment on the cycle, by pointer doubling.
    ident = (r0 << 33) + (c0 << 2) + d
    ring, ahead = ident, following
    while (ring != ring[following]).any():
        ring, ahead = np.minimum(ring, ring[ahead]), ahead[ahead]
    # Position: steps left until the ring's first segment comes round again.
    first, steps, to = ident == ring, np.ones(n, np.int64), following.copy()
    while len(going := np.flatnonzero(~first[to])):
        steps[going], to[going] = steps[going] + steps[to[going]], to[to[going]]
    length = np.zeros(n, np.int64)
    length[to[first]] = steps[first]
    return pd.DataFrame({
        "run_id": group.run_id.to_numpy(), "label": group.label.to_numpy(), "ring": ring, "position": length[to] - steps, "r": r0, "c": c0,
    })


def _stitch_large(segments: DataFrame) -> DataFrame:
    """The same rings by pointer doubling: joins only, any outline length."""
    key = ["run_id", "label"]
    ident = F.shiftleft(F.col("r0").cast("bigint"), 33) + F.shiftleft(F.col("c0").cast("bigint"), 2) + F.col("dir")
    named = segments.withColumn("id", ident)
    leaving = named.groupBy(*key, "r0", "c0").agg(
        F.map_from_entries(F.collect_list(F.struct("dir", "id"))).alias("_out")  # at most two
    )
    ends = named.select(*key, "id", "dir", F.col("r1").alias("r0"), F.col("c1").alias("c0"))
    left, right = (F.col("dir") + 3) % 4, (F.col("dir") + 1) % 4
    linked = ends.join(leaving, [*key, "r0", "c0"]).select(
        *key, "id",
        F.coalesce(F.try_element_at("_out", left), F.try_element_at("_out", right)).alias("next"),
    )
    link = reliable_checkpoint(linked)
    # Ring id: least segment id on the cycle.
    state = link.withColumn("low", F.least("id", "next"))
    while True:
        ahead = state.select(*key, F.col("id").alias("next"), F.col("next").alias("_nn"), F.col("low").alias("_nl"))
        moved = state.join(ahead, [*key, "next"]).select(
            *key, "id", F.col("_nn").alias("next"), F.least("low", "_nl").alias("low"),
            (F.col("_nl") < F.col("low")).alias("changed"),
        )
        moved = reliable_checkpoint(moved)
        changed = moved.where("changed").limit(1).count()
        state = moved.drop("changed")
        if not changed:
            break
    rings = state.select(*key, "id", F.col("low").alias("ring"))
    # Position: steps left until the ring's first segment comes round again.
    walk = link.join(rings, [*key, "id"]).select(
        *key, "id", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"),
        F.lit(1).cast("bigint").alias("left"),
    )
    while True:
        ahead = walk.select(*key, F.col("id").alias("next"), F.col("next").alias("_nn"), F.col("left").alias("_nl"))
        walk = reliable_checkpoint(
            walk.join(ahead, [*key, "next"], "left").select(
                *key, "id", "ring", F.col("_nn").alias("next"),
                (F.col("left") + F.coalesce("_nl", F.lit(0))).alias("left"),
            )
        )
        if walk.where("next IS NOT NULL").limit(1).count() == 0:
            break
    sizes = walk.groupBy(*key, "ring").agg(F.count(F.lit(1)).alias("_n"))
    placed = walk.join(sizes, [*key, "ring"]).select(*key, "id", "ring", (F.col("_n") - F.col("left")).alias("position"))
    return named.join(placed, [*key, "id"]).select(
        *key, "ring", "position", F.col("r0").alias("r"), F.col("c0").alias("c")
    )


def outlines(cells: DataFrame, small: int = SMALL_OUTLINE) -> DataFrame:
    """Ring corners of every label ``(run_id, label, ring, position, r, c)`` on cell edges.

    Labels with few segments are walked many at a time in groups of about ``small`` segments; a label
    above that goes through pointer doubling instead, so no task holds a long outline.
    """
    segments = reliable_checkpoint(outline_segments(cells))
    groups = segments.count() // max(small, 1) + 1
    sizes = segments.groupBy("run_id", "label").agg(F.count(F.lit(1)).alias("_n"))
    sized = segments.join(sizes, ["run_id", "label"])
    together = F.pmod(F.xxhash64("run_id", "label"), F.lit(groups)).alias("_together")
    walked = sized.where(F.col("_n") <= small).drop("_n").groupBy(together).applyInPandas(_stitch_small, OUTLINE_SCHEMA)
    long = sized.where(F.col("_n") > small).drop("_n")
    if long.limit(1).count() == 0:
        return walked
    return walked.unionByName(_stitch_large(long).select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in OUTLINE_SCHEMA.split(", ")]))


def outline_corners(cells: DataFrame) -> DataFrame:
    """The corners ``(run_id, label, r, c)`` of ``outlines``, not put in order: one segment starts at each."""
    return outline_segments(cells).select("run_id", "label", F.col("r0").alias("r"), F.col("c0").alias("c"))


def outline_rings(corners: DataFrame, grids: DataFrame) -> DataFrame:
    """Closed projected rings ``(run_id, label, ring, is_hole, points)`` for GeoJSON output."""
    g = small_side(grids.select("run_id", "minx", "maxy", "resolution"))
    placed = corners.join(g, "run_id").select(
        "run_id", "label", "ring", "position",
        F.struct(
            (F.col("minx") + F.col("c") * F.col("resolution")).alias("x"),
            (F.col("maxy") - F.col("r") * F.col("resolution")).alias("y"),
        ).alias("p"),
    )
    rings = placed.groupBy("run_id", "label", "ring").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "p"))), lambda s: s["p"]).alias("_open")
    )
    from sightline.functions.geometry import close_ring, signed_area

    return rings.select(
        "run_id", "label", "ring", (signed_area(F.col("_open")) > 0).alias("is_hole"),
        close_ring(F.col("_open")).alias("points"),
    )


def geographic_envelopes(corners: DataFrame, grids: DataFrame, crs: str) -> DataFrame:
    """WGS84 box of each candidate from its outline corners ``(run_id, label, r, c)`` in any order."""
    from sightline.functions.projection import project

    g = small_side(grids.select("run_id", "minx", "maxy", "resolution"))
    x = F.col("minx") + F.col("c") * F.col("resolution")
    y = F.col("maxy") - F.col("r") * F.col("resolution")
    lonlat = corners.join(g, "run_id").select("run_id", "label", project(x, y, crs, "EPSG:4326").alias("p"))
    return lonlat.groupBy("run_id", "label").agg(
        F.bround(F.min("p.x"), 9).alias("west"), F.bround(F.min("p.y"), 9).alias("south"),
        F.bround(F.max("p.x"), 9).alias("east"), F.bround(F.max("p.y"), 9).alias("north"),
    )
