"""Place names to bounded search areas through a gazetteer table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions.geometry import box_around, in_box
from sightline.functions.scalars import place_key
from sightline.session import discard_tables, reliable_checkpoint, small_side, spread, tables_written


def resolve_places(queries: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``queries(query_id, query)`` to a label, a point and its +-0.075 degree box.

    ``gazetteer(name, label, lat, lon)``; a query without a match keeps a ``problem``.
    """
    names = gazetteer.select(place_key(F.col("name")).alias("_key"), "label", "lat", "lon")
    joined = queries.withColumn("_key", place_key(F.col("query"))).join(names, "_key", "left")
    box = box_around(F.col("lat"), F.col("lon"))
    found = F.col("label").isNotNull()
    return joined.withColumn("_b", F.when(found, box)).select(
        *queries.columns, "label",
        F.col("_b.west").alias("west"), F.col("_b.south").alias("south"),
        F.col("_b.east").alias("east"), F.col("_b.north").alias("north"),
        F.when(F.col("_key").isNull(), "Enter a place name between 2 and 120 characters.")
        .when(~found, "No place match was found.").alias("problem"),
    )


def inside_coverage(points: DataFrame, coverage: DataFrame) -> DataFrame:
    """Flag ``points(case_id, lon, lat)`` inside their case's ``coverage`` box."""
    return points.join(coverage, "case_id").withColumn(
        "inside",
        in_box(F.col("lon"), F.col("lat"), F.col("west"), F.col("south"), F.col("east"), F.col("north")),
    ).drop("west", "south", "east", "north")


def meeting_boxes(items: DataFrame, areas: DataFrame, item: str, area: str) -> DataFrame:
    """``(area, item, row)`` once for every pair of boxes that touch; ``row`` is the item's whole row.

    Both have ``west, south, east, north``.  Boxes meet in a hierarchy of grids at the larger of their two
    levels, as in ``match_requests``: an item is filed in the at most four cells of its own level and of the
    areas' larger levels, an area likewise, and a pair counts in the cell of its corner (max west, max south)
    only.  An area that holds most items is spread over its cells; adaptive execution splits the rest.
    """
    from sightline.operators.catalog import BASE_CELL, _cells, _level, _present, _size

    def leveled(df: DataFrame) -> DataFrame:
        return df.withColumn("_own", _level(F.greatest(F.col("_e") - F.col("_w"), F.col("_n") - F.col("_s")), BASE_CELL))

    def filed(df: DataFrame, others: list[int]) -> DataFrame:
        levels = F.array_distinct(F.array("_own", *[F.greatest("_own", F.lit(v)) for v in others]))
        cell = _size(F.col("_level"), BASE_CELL)
        return (
            df.withColumn("_level", F.explode(levels)).withColumn("_cx", _cells(F.col("_w"), F.col("_e"), cell))
            .withColumn("_cy", _cells(F.col("_s"), F.col("_n"), cell))
        )

    box = [F.col(c).alias(n) for c, n in zip(("west", "south", "east", "north"), ("_w", "_s", "_e", "_n"), strict=True)]
    left = leveled(items.select(F.col(item).alias("_item"), F.struct("*").alias("row"), *box))
    right = leveled(areas.select(F.col(area).alias("_area"), *box))
    there = filed(right, [v for (v,) in _present(left, "_own")]).select(
        "_area", "_level", "_cx", "_cy", *[F.col(c).alias("o" + c) for c in ("_w", "_s", "_e", "_n", "_own")]
    )
    size = _size(F.col("_level"), BASE_CELL)
    home = (F.floor(F.greatest("_w", "o_w") / size) == F.col("_cx")) & (F.floor(F.greatest("_s", "o_s") / size) == F.col("_cy"))
    touch = (F.col("_e") >= F.col("o_w")) & (F.col("_w") <= F.col("o_e")) & (F.col("_n") >= F.col("o_s")) & (F.col("_s") <= F.col("o_n"))
    here = filed(left, [v for (v,) in _present(right, "_own")])
    return here.join(there, ["_level", "_cx", "_cy"]).where((F.col("_level") == F.greatest("_own", "o_own")) & touch & home).select(
        F.col("_area").alias(area), F.col("_item").alias(item), "row"
    )


#: Polygons of a list that an area looks at in its first round; later rounds look at twice as many as the one before.
BLOCK = 16


def _lists(boxes: DataFrame, areas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Polygons and areas filed under lists ``(_level, _cx, _cy, _whole)`` that bring every touching pair together once.

    The cells are those of ``meeting_boxes``.  An area's own level has a list a cell of all polygons of that
    level or below; at larger levels of polygons it reads the list of the polygons of that very level.
    """
    from sightline.operators.catalog import BASE_CELL, _cells, _level, _present, _size

    def leveled(df: DataFrame) -> DataFrame:
        return df.withColumn("_own", _level(F.greatest(F.col("_e") - F.col("_w"), F.col("_n") - F.col("_s")), BASE_CELL))

    def filed(df: DataFrame, places: list) -> DataFrame:
        cell = _size(F.col("_level"), BASE_CELL)
        where = F.filter(F.array(*places), lambda p: p["level"].isNotNull())
        return (
            df.withColumn("_at", F.explode(where)).select("*", F.col("_at.level").alias("_level"), F.col("_at.whole").alias("_whole")).drop("_at", "_own")
            .withColumn("_cx", _cells(F.col("_w"), F.col("_e"), cell)).withColumn("_cy", _cells(F.col("_s"), F.col("_n"), cell))
        )

    def place(level, whole: bool, needed) -> Column:
        return F.struct(F.when(needed, F.lit(level) if isinstance(level, int) else level).alias("level"), F.lit(whole).alias("whole"))

    boxes, areas = leveled(boxes), leveled(areas)
    theirs, ours = [v for (v,) in _present(boxes, "_own") if v is not None], [v for (v,) in _present(areas, "_own") if v is not None]
    own = F.col("_own")
    return (
        filed(boxes, [place(v, True, own <= v) for v in ours] + [place(own, False, own > F.lit(min(ours, default=0)))]),
        filed(areas, [place(own, True, own.isNotNull())] + [place(v, False, own < v) for v in theirs]),
    )


#: Cells as parts of the width that nine tenths of the boxes do not exceed.
PARTS = (2, 4, 8)
#: Large boxes, for each set of sides beyond the cell, that the others of a cell are compared with, and boxes a cell,
#: on average, from which on they are.
COMPARED, CROWDED = 8, 40


def _width(boxes: DataFrame) -> float:
    """The width that nine tenths of the boxes do not exceed, 0 where they have none."""
    side = F.least(F.col("_e") - F.col("_w"), F.col("_n") - F.col("_s"))
    wide = boxes.where(side > 0).agg(F.percentile_approx(side, 0.9)).first()[0]
    return wide if wide is not None and math.isfinite(wide) else 0.0


def leading(boxes: DataFrame, top: int, width: float, parts: int) -> DataFrame | None:
    """``(_row)`` of the boxes that can be among the ``top`` largest of some area, or None where too few could be left out.

    ``boxes`` as in ``largest_touching``, cells of ``width / parts``.  An area meets a box in a point of one cell.
    Boxes that hold the box's part of that cell touch the area too.  So a box can be left out if in each of its cells
    ``top`` larger boxes hold its part.  It is compared with some of the largest that go on beyond the same sides of the
    cell, one from each of ``COMPARED`` groups, by grouped maxima.  Boxes much wider than ``width`` stay.
    """
    cell, place = F.lit(width / parts), ["_cx", "_cy"]
    spanned = ((F.col("_e") - F.col("_w")) / cell + 2) * ((F.col("_n") - F.col("_s")) / cell + 2)
    compared = F.coalesce((spanned <= (3 * parts + 2) ** 2) & ~F.isnan("_size"), F.lit(False))
    at = {c: F.floor(F.col("_" + c) / cell) for c in "wsen"}
    filled = (
        boxes.where(compared).withColumn("_cx", F.explode(F.sequence(at["w"], at["e"]))).withColumn("_cy", F.explode(F.sequence(at["s"], at["n"])))
        .select(
            *place, "_row", "_size",
            # What goes on beyond the cell has no end there.
            *[F.when(at[c] < F.col(p), F.lit(-math.inf)).otherwise(F.col("_" + c)).alias("_" + c) for c, p in (("w", "_cx"), ("s", "_cy"))],
            *[F.when(at[c] > F.col(p), F.lit(math.inf)).otherwise(F.col("_" + c)).alias("_" + c) for c, p in (("e", "_cx"), ("n", "_cy"))],
        )
    )
    sides = ["_w", "_s", "_e", "_n"]
    beyond = [(F.abs(F.col(c)) == math.inf).alias(c + "o") for c in sides]
    # Sides of equal boxes go together: all are taken from the last row of the greatest size.
    largest = filled.groupBy(*place, *beyond, F.pmod(F.xxhash64("_row"), F.lit(COMPARED)).alias("_group")).agg(
        F.max("_size").alias("_size"), *[F.max_by(c, "_size").alias(c) for c in sides]
    )
    held = small_side(largest.groupBy(*place).agg(F.collect_list(F.struct("_size", *sides)).alias("_large")))
    if held.count() * CROWDED > boxes.count():
        return None
    holds = lambda d: (d["_size"] > F.col("_size")) & (d["_w"] <= F.col("_w")) & (d["_s"] <= F.col("_s")) & (d["_e"] >= F.col("_e")) & (d["_n"] >= F.col("_n"))
    wanted = filled.join(held, place).where(F.size(F.filter("_large", holds)) < top).select("_row")
    return small_side(wanted.unionAll(boxes.where(~compared).select("_row")).distinct())


def largest_touching(boxes: DataFrame, areas: DataFrame, top: int) -> DataFrame:
    """``(_area, _row, _key, _size)``: the ``top`` boxes of greatest size, then least key, that touch each area.

    ``boxes(_row, _key, _size, _w, _s, _e, _n)``, ``areas(_area, _w, _s, _e, _n)``.  Every list of boxes is put
    in that order by a range sort and cut into blocks.  An area looks at the first block of its lists, then at
    the next 2, 4, ..., and leaves a list when its next block starts after the area's ``top``-th box, or ends.
    Blocks whose bounds miss the area are passed over.  So no list of all touching pairs is ever made.
    """
    from sightline.operators.catalog import BASE_CELL, _size
    from sightline.operators.ranking import first_per_key, ranked

    place = ["_level", "_cx", "_cy", "_whole"]
    order = [F.desc("_size"), "_key"]
    filed, wanted = _lists(boxes, areas)
    numbered = ranked(filed, place, [*order, "_row"], "_number")
    numbered = spread(reliable_checkpoint(numbered.withColumn("_block", F.floor((F.col("_number") - 1) / BLOCK))))
    head = F.max_by(F.struct(F.col("_size").alias("size"), F.col("_key").alias("key")), -F.col("_number")).alias("_head")
    bounds = [F.min("_w").alias("bw"), F.min("_s").alias("bs"), F.max("_e").alias("be"), F.max("_n").alias("bn")]
    blocks = spread(reliable_checkpoint(numbered.groupBy(*place, "_block").agg(head, *bounds)))
    last = blocks.groupBy(*place).agg(F.max("_block").alias("_last"), F.min("bw").alias("lw"), F.min("bs").alias("ls"), F.max("be").alias("le"), F.max("bn").alias("ln"))
    rows = numbered.select(*place, "_block", "_row", "_key", "_size", *[F.col("_" + c).alias("p" + c) for c in "wsen"])
    cell = _size(F.col("_level"), BASE_CELL)
    home = (F.floor(F.greatest("_w", "pw") / cell) == F.col("_cx")) & (F.floor(F.greatest("_s", "ps") / cell) == F.col("_cy"))
    touch = lambda p: (F.col(p + "e") >= F.col("_w")) & (F.col(p + "w") <= F.col("_e")) & (F.col(p + "n") >= F.col("_s")) & (F.col(p + "s") <= F.col("_n"))
    # An area beside all boxes of a list does not look at them.
    open_ = wanted.join(last, place).where(touch("l")).drop("lw", "ls", "le", "ln")
    open_ = spread(reliable_checkpoint(open_.withColumn("_from", F.lit(0).cast("bigint")).withColumn("_bar", F.lit(None).cast(blocks.schema["_head"].dataType))))
    before_bar = F.col("_bar").isNull() | (F.col("_head.size") > F.col("_bar.size")) | (
        (F.col("_head.size") == F.col("_bar.size")) & (F.col("_head.key") <= F.col("_bar.key"))
    )
    found, step = None, 1
    while found is None or open_.limit(1).count():
        to = F.least(F.col("_from") + (step - 1), F.col("_last"))
        looking = open_.withColumn("_block", F.explode(F.sequence("_from", to))).join(blocks, [*place, "_block"])
        hits = spread(looking.where(before_bar & touch("b")).drop("_head")).join(rows, [*place, "_block"]).where(touch("p") & home)
        hits = hits.select("_area", "_row", "_key", "_size")
        every = hits if found is None else found.unionAll(hits)
        found = spread(reliable_checkpoint(first_per_key(every, ["_area"], [*order, "_row"], top, "_rank").drop("_rank")))
        bar = found.groupBy("_area").agg(
            F.count(F.lit(1)).alias("_found"), F.max_by(F.struct(F.col("_size").alias("size"), F.col("_key").alias("key")), F.struct(-F.col("_size"), "_key")).alias("_bar")
        )
        bar = bar.where(F.col("_found") >= top).select("_area", "_bar")
        rest = open_.drop("_bar").withColumn("_block", F.col("_from") + step).where("_block <= _last")
        rest = spread(rest.join(blocks.select(*place, "_block", "_head"), [*place, "_block"])).join(bar, "_area", "left").where(before_bar)
        open_ = spread(reliable_checkpoint(rest.withColumn("_from", F.col("_block")).select(*open_.columns)))
        step *= 2
    return found


def largest_areas(polygons: DataFrame, areas: DataFrame, top: int = 3) -> DataFrame:
    """Largest polygons touching each area: ``polygons(polygon_id, ring)``, ``areas(area_id, west, south, east, north)``.

    The areas that a polygon touches are found here, by the bounds of its ring; degenerate rings touch none.
    Areas that keep fewer than ``top`` polygons are reported by ``short_areas``.
    """
    from sightline.functions.geometry import area, focus_point, ring_bounds, simplify_ring
    from sightline.operators.ranking import first_per_key

    box = [F.col(c) for c in ("west", "south", "east", "north")]
    bounds = polygons.where(F.size("ring") >= 3).select("polygon_id", "ring", area(F.col("ring")).alias("polygon_area"), ring_bounds(F.col("ring")).alias("_b"))
    sides = [F.col(f"_b.{c}").alias("_" + c[0]) for c in ("west", "south", "east", "north")]
    boxed = lambda df: df.select("_row", F.col("polygon_id").alias("_key"), F.col("polygon_area").alias("_size"), *sides)
    wanted = areas.select(F.col("area_id").alias("_area"), *[c.alias("_" + n) for c, n in zip(box, "wsen", strict=True)])
    spark = areas.sparkSession
    with tables_written() as paths:
        kept = spread(reliable_checkpoint(bounds.withColumn("_row", F.monotonically_increasing_id())))
        # The points of an area are what boxes are compared by, so its sides must be in order.
        turned = wanted.where(F.coalesce(~((F.col("_w") <= F.col("_e")) & (F.col("_s") <= F.col("_n"))) | F.isnan("_e") | F.isnan("_n"), F.lit(False)))
        width = 0.0 if turned.limit(1).count() else _width(boxed(kept))
    for parts in PARTS if width else ():
        with tables_written() as passing:
            few = leading(boxed(kept), top, width, parts)
        if few is None or few.count() * 2 > kept.count():
            break
        before = paths + passing
        with tables_written() as paths:
            kept = spread(reliable_checkpoint(kept.join(few, "_row", "left_semi")))
        discard_tables(spark, before)
    met = largest_touching(boxed(kept), wanted, top).select("_row", F.col("_area").alias("area_id"))
    best = spread(met.join(kept.drop("_b"), "_row")).join(areas, "area_id")
    best = first_per_key(best, ["area_id"], [F.desc("polygon_area"), "polygon_id", "_row"], top, "area_rank").drop("_row")
    return best.withColumn("focus", focus_point(F.col("ring"), *box)).withColumn(
        "ring", simplify_ring(F.col("ring"))
    ).drop("west", "south", "east", "north")


def short_areas(areas: DataFrame, largest: DataFrame, top: int = 3) -> DataFrame:
    """``(area_id, kept)`` of the areas that fewer than ``top`` polygons touch."""
    kept = largest.groupBy("area_id").agg(F.count(F.lit(1)).alias("kept"))
    return areas.select("area_id").join(kept, "area_id", "left").na.fill(0, ["kept"]).where(F.col("kept") < top)
