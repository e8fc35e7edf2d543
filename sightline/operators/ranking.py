"""Ranks and exact quantiles that never put a whole group into one task.

A plain ``row_number() over (partition by key)`` sorts each key in a single task.
That is fine when the group is bounded (a raster line, a tile) or when a small
rank limit lets Spark prune before the shuffle.  The helpers here serve the other
case: a key that may own a large share of the table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.session import reliable_checkpoint, ship_by_value, small_side

ship_by_value(__name__)


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rank"
) -> DataFrame:
    """1-based position of every row inside its key, by a range sort.

    Rows are range-partitioned by (key, order), so a hot key spreads over many
    partitions; a small (key, partition) count table supplies the offsets.  The
    sorted rows are written first because their physical position is the rank.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    sort = [F.col(k) for k in keys] + order
    placed = (
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_pid", F.shiftright("_mid", 33))
    )
    placed = reliable_checkpoint(placed)
    counts = placed.groupBy(*keys, "_pid").agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    offsets = offsets.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_pid").alias("_opid"), "_first", "_offset",
    )
    condition = F.col("_pid") == F.col("_opid")
    for i, key in enumerate(keys):
        condition = condition & F.col(key).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(offsets, condition).select(
        *[placed[c] for c in df.columns],
        (F.col("_mid") - F.col("_first") + 1 + F.col("_offset")).alias(name),
    )


def preceding(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the ``value`` of the row before it in its key, NULL for a key's first row.

    One range sort by (key, order), so a hot key spreads over many partitions.  Each task looks one row back;
    only the first row of a partition needs the last one of the partition before, which comes from a table
    of one row per partition.  Missing keys are a key of their own; other columns may have any name but
    ``_pid``, ``_at`` and ``_tail``.
    """
    keys, columns = list(keys), list(df.columns)
    fields = [*df.schema.fields, T.StructField(name, df.schema[value].dataType), T.StructField("_pid", T.IntegerType()), T.StructField("_at", T.LongType())]
    spread = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)

    def look_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            earlier = {c: pa.concat_arrays([pa.nulls(1, batch.column(c).type) if last is None else last.column(c), batch.column(c).slice(0, batch.num_rows - 1)]) for c in {*keys, value}}
            alike = pa.array([at > 0] + [True] * (batch.num_rows - 1))
            for key in keys:
                now, then = batch.column(key), earlier[key]
                both = pc.and_(now.is_null(), then.is_null())
                alike = pc.and_(alike, pc.or_(both, pc.fill_null(pc.equal(now, then), False)))
            found = pc.if_else(alike, earlier[value], pa.nulls(batch.num_rows, batch.column(value).type))
            places = pa.array(range(at, at + batch.num_rows), pa.int64())
            last, at = batch.slice(batch.num_rows - 1), at + batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, found, pa.array([number] * batch.num_rows, pa.int32()), places], names=[*columns, name, "_pid", "_at"]
            )

    seen = reliable_checkpoint(spread.mapInArrow(look_back, T.StructType(fields)))
    tails = seen.groupBy("_pid").agg(F.max_by(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(value).alias("v")), "_at").alias("_tail"))
    carried = small_side(tails.select("_pid", F.lag("_tail").over(Window.orderBy("_pid")).alias("_tail")))
    joined = seen.join(carried, "_pid", "left")
    carries = F.col("_at") == 0
    for i, key in enumerate(keys):
        carries = carries & F.col(key).eqNullSafe(F.col(f"_tail.k{i}"))
    return joined.select(*columns, F.when(carries, F.col("_tail.v")).otherwise(F.col(name)).alias(name))


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, name: str = "rank"
) -> DataFrame:
    """First ``n`` rows of every key; Spark cuts each task to ``n`` before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)


def last_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Row with the greatest ``order`` of every key, combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    percentiles: dict[str, float],
    accuracy: int = 10000,
    small: int = 100000,
) -> DataFrame:
    """Linear-interpolated percentiles per key, exact, for groups of any size.

    A mergeable sketch brackets each wanted rank; one aggregation then counts what
    lies outside the brackets and the distinct values inside.  Only those few
    values per key meet in one task: at most ``small``, or about a
    ``6 / accuracy`` share of the rows per percentile.
    """
    keys = list(keys)
    small = max(small, 2 * accuracy)  # below this the bracket would be under a few ranks wide
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    margin = 3.0 / accuracy
    wanted = list(percentiles.items())
    lows = [max(p - margin, 0.0) for _, p in wanted]
    highs = [min(p + margin, 1.0) for _, p in wanted]
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", lows + highs, accuracy).alias("_q"),
    )
    bounds = []
    for i, (_, p) in enumerate(wanted):
        low = F.col("_min") if lows[i] == 0.0 else F.col("_q")[i]
        high = F.col("_max") if highs[i] == 1.0 else F.col("_q")[len(wanted) + i]
        tiny = F.col("_n") <= small
        bounds.append(F.when(tiny, F.col("_min")).otherwise(low).alias(f"_lo{i}"))
        bounds.append(F.when(tiny, F.col("_max")).otherwise(high).alias(f"_hi{i}"))
    sketch = small_side(sketch.select(*keys, "_n", *bounds))

    joined = _join_keys(rows, sketch, keys)
    inside = F.lit(False)
    region = F.lit(0)
    for i in range(len(wanted)):
        inside = inside | F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
        region = region + (F.col("_v") > F.col(f"_hi{i}")).cast("int")
    grouped = (
        joined.withColumn("_in", F.when(inside, F.col("_v")))
        .withColumn("_region", F.when(inside, F.lit(-1)).otherwise(region))
        .groupBy(*keys, "_region", "_in")
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_from"), F.first("_n").alias("_n"))
    )
    upto = Window.partitionBy(*keys).orderBy("_from")
    cumulative = grouped.withColumn("_cum", F.sum("_c").over(upto))

    def at_rank(rank: Column) -> Column:
        hit = F.min(F.when(F.col("_cum") > rank, F.struct("_cum", "_in")))
        return F.when(hit["_in"].isNull(), F.raise_error(F.lit("quantile bracket missed its rank"))).otherwise(
            hit["_in"]
        )

    outputs = []
    for name, p in wanted:
        position = (F.max("_n") - 1) * F.lit(float(p))
        spot = (F.col("_n") - 1) * F.lit(float(p))
        low = at_rank(F.floor(spot))
        high = at_rank(F.least(F.floor(spot) + 1, F.col("_n") - 1))
        outputs.append((low + (high - low) * (position - F.floor(position))).alias(name))
    if not keys:
        return cumulative.agg(*outputs)
    return cumulative.groupBy(*keys).agg(*outputs)


def _join_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys) if keys else left.crossJoin(right)  # one row
