"""Curriculum mixing of catalog items: source targets, passes over documents, training positions.

Every source (a provider) has a weight and a schedule of how its share changes over training.  The
integral of the schedule up to a moment, times the source's target, is its cumulative token demand.  The
documents of a source stand in a fixed pseudo-random order, pass after pass; the words before a document
are an amount of demand, and inverting the demand curve at that amount gives its training position.

The words before a document come from a range sort: sums within each sorted part, plus the parts before
it.  A source that holds most rows is spread over many parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import id_key
from sightline.session import reliable_checkpoint

#: Weights by the sources' order, repeating, and the (progress, rate) knots of each weight's schedule.
WEIGHTS = (5, 2, 1)
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
MOST = 3


def source_targets(sizes: DataFrame, source: str = "provider", weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, weight_rank, target)`` from one row ``(source, source_size)`` per source.

    Targets share the sum of all sizes by weight.  None is above ``most`` times its source's size: going
    up in size per weight, the first source whose bound is not below an equal share of what is left sets
    the share of all after it.  The windows span the sources, not their rows: one task orders them, which
    suits sources that are providers or sites in the hundred thousands, not one source per item.
    """
    by_code_point = Window.orderBy(F.col(source).isNull(), source)
    ranked = sizes.withColumn("weight_rank", (F.row_number().over(by_code_point) - 1) % len(weights))
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), F.col("weight_rank") + 1)
    bound = F.col("source_size") * F.lit(float(most))
    order = [F.col("_ratio"), F.col(source).isNull(), F.col(source)]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    shares = (
        ranked.withColumn("_weight", weight).withColumn("_ratio", bound / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn(
            "_share",
            (F.col("_total") - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double")
            / F.sum("_weight").over(rest),
        )
        .withColumn("_at", F.row_number().over(Window.orderBy(*order)))
    )
    share = F.min(F.when(F.col("_ratio") >= F.col("_share"), F.struct("_at", "_share"))).over(Window.partitionBy())["_share"]
    return shares.withColumn("_of_all", share).select(
        source, "source_size", "weight_rank",
        F.when(F.col("source_size") > 0, F.least(bound, F.col("_of_all") * F.col("_weight"))).otherwise(F.lit(0.0)).alias("target"),
    )


def _moment(done: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The progress at which the integral of a piecewise linear rate reaches a share ``done`` of the whole."""
    areas = [(t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(knots, knots[1:], strict=False)]
    whole, before = sum(areas), 0.0
    out = F.lit(float(knots[-1][0]))
    parts = []
    for ((t0, r0), (t1, r1)), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        due = done * F.lit(whole) - F.lit(before)
        slope = (r1 - r0) / (t1 - t0)
        if slope:
            t = (F.sqrt(F.greatest(F.lit(r0 * r0) + F.lit(2 * slope) * due, F.lit(0.0))) - F.lit(r0)) / F.lit(slope)
        else:
            t = due / F.lit(r0)
        parts.append((F.lit((before + area) / whole), F.lit(t0) + t))
        before += area
    for upto, t in reversed(parts):
        out = F.when(done <= upto, t).otherwise(out)
    return F.least(F.greatest(out, F.lit(float(knots[0][0]))), F.lit(float(knots[-1][0])))


def mixing_plan(
    items: DataFrame, size: Column, id_col: str = "item_id", source: str = "provider",
    weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, most: int = MOST,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per item: ``id_col, source, *keep, size, source_size, target, passes, taken, positions``.

    A source's items are ordered by the MD5 of their id.  Pass ``p`` takes an item when the middle of its
    words, ``p`` source sizes and the words before it included, is within the target; so items stay whole,
    a source's taken words are at most one item away from its target, and no item is taken more than
    ``most`` times.  ``positions`` (ARRAY<DOUBLE>, 0 to 1) has the training position of each pass.  A null
    source is a source of its own, after all others; a null size counts as 0, and items of size 0 are not
    taken.  Reruns give the same rows.
    """
    names = [f"_keep{i}" for i in range(len(keep))]
    rows = items.select(
        F.col(id_col).alias("_id"), F.col(source).alias("_source"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)],
        F.coalesce(size.cast("bigint"), F.lit(0).cast("bigint")).alias("size"), F.md5(F.col(id_col).cast("string").cast("binary")).alias("_order"),
    )
    sort = [F.col("_source"), F.col("_order"), F.col("_id"), F.col("size")]
    placed = reliable_checkpoint(
        rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
        .withColumn("_place", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_place", 33))
    )
    sums = placed.groupBy("_source", "_part").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).select("_source", "_part", "_offset")
    totals = sums.groupBy("_source").agg(F.sum("_sum").alias("source_size"))
    targets = source_targets(totals, "_source", weights, most)
    parts = offsets.alias("o").join(targets.alias("t"), F.col("o._source").eqNullSafe(F.col("t._source"))).select(
        F.col("o._source").alias("_of"), F.col("_part").alias("_of_part"), "_offset", "source_size", "weight_rank", "target"
    )
    here = Window.partitionBy("_part", "_source").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum("size").over(here), F.lit(0)))
    known = local.join(
        reliable_checkpoint(parts), (F.col("_part") == F.col("_of_part")) & F.col("_source").eqNullSafe(F.col("_of"))
    ).withColumn("_before", F.col("_offset") + F.col("_local"))
    reached = (2 * F.col("target") - (2 * F.col("_before") + F.col("size")).cast("double")) / (2 * F.col("source_size")).cast("double")
    passes = F.when(F.col("size") > 0, F.greatest(F.least(F.floor(reached) + 1, F.lit(most)), F.lit(0))).otherwise(F.lit(0)).cast("bigint")

    def at(number: Column) -> Column:
        done = (number * F.col("source_size") + F.col("_before")) / F.col("target")
        moment = _moment(done, schedules[-1])
        for rank in range(len(schedules) - 1):
            moment = F.when(F.col("weight_rank") == rank, _moment(done, schedules[rank])).otherwise(moment)
        return moment

    planned = known.withColumn("passes", passes)
    positions = F.array_compact(F.array(*[F.when(F.col("passes") > p, at(F.lit(p))) for p in range(most)]))
    return planned.select(
        F.col("_id").alias(id_col), F.col("_source").alias(source), *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)],
        "size", "source_size", "target", "passes", (F.col("passes") * F.col("size")).alias("taken"), positions.alias("positions"),
    )


def curriculum(items: DataFrame, size: Column, id_col: str = "item_id", source: str = "provider", **options) -> DataFrame:
    """The items as training takes them: one row per pass, range-sorted by position, columns unchanged.

    Columns may have any name.  Rows that repeat are rows of their own: copies with one id and equal values
    take the passes planned for them in any order.  Items of equal position stand in any order.  A null size
    counts as 0, and items of size 0 are not taken; a null source is a source of its own.
    """
    rows = items.select(
        F.struct("*").alias("row"), F.col(id_col).alias("_key"), F.col(source).alias("_of"), size.cast("bigint").alias("_words")
    ).withColumn("_row", F.xxhash64(F.col("row").cast("string")))
    plan = mixing_plan(rows, F.col("_words"), "_key", "_of", keep=["_row"], **options).where("passes > 0")
    keys = ["_id", "_no_id", "_row"]
    copies = Window.partitionBy(*keys).orderBy(F.lit(1))
    taken = reliable_checkpoint(plan.select(*id_key("_key"), "_row", "positions"))
    taken = taken.withColumn("_copy", F.row_number().over(copies))
    present = rows.select("row", *id_key("_key"), "_row").withColumn("_copy", F.row_number().over(copies))
    joined = present.join(taken, [*keys, "_copy"]).select("row", F.explode("positions").alias("_position"))
    return joined.repartitionByRange("_position").sortWithinPartitions("_position").select("row.*")
