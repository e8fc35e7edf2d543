"""Catalog search, de-duplication, paging, revisit areas and coverage reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.geometry import box_intersects
from sightline.functions.scalars import clean_polarizations
from sightline.operators.ranking import first_per_key, last_per_key, ranked
from sightline.session import reliable_checkpoint, spread

TASK_PREFIX = "sar-data/task-data/"


@dataclass(frozen=True)
class SearchRequest:
    """One catalog question; empty filters match everything."""

    box: tuple[float, float, float, float]
    start_at: str
    end_at: str
    providers: Sequence[str] = ()
    product_types: Sequence[str] = ()
    polarizations: Sequence[str] = ()
    max_resolution_m: float | None = None
    page_size: int = 50
    month_column: str | None = field(default=None)


def _within_resolution(limit: Column) -> Column:
    """Coarsest stated resolution within the limit; no resolution at all fails."""
    return F.coalesce(
        F.greatest("resolution_range_m", "resolution_azimuth_m") <= limit, F.lit(False)
    )


def matching(acquisitions: DataFrame, request: SearchRequest) -> DataFrame:
    """Acquisitions that satisfy one request.

    Box, time and product tests are plain column comparisons, so they reach the
    Parquet scan.  When the table is partitioned by month, name that column
    (text ``yyyy-MM``) in ``month_column`` and a pruning predicate is added.
    """
    west, south, east, north = (F.lit(float(v)) for v in request.box)
    clock = acquisitions.schema["acquired_at"].dataType  # compare in the stored type: pushes down
    start, end = F.lit(request.start_at).cast(clock), F.lit(request.end_at).cast(clock)
    out = acquisitions.where(
        box_intersects(
            F.col("west"), F.col("south"), F.col("east"), F.col("north"), west, south, east, north
        )
        & F.col("acquired_at").between(start, end)
    )
    if request.month_column:
        out = out.where(
            F.col(request.month_column).between(request.start_at[:7], request.end_at[:7])
        )
    if request.providers:
        out = out.where(F.col("provider").isin(*request.providers))
    if request.product_types:
        out = out.where(F.col("product_type").isin(*request.product_types))
    if request.polarizations:
        wanted = F.array(*[F.lit(p) for p in request.polarizations])
        out = out.where(F.size(F.array_except(wanted, F.col("polarizations"))) == 0)
    if request.max_resolution_m is not None:
        out = out.where(_within_resolution(F.lit(float(request.max_resolution_m))))
    return out


def latest_arrivals(items: DataFrame, keys: Sequence[str] = ("provider", "item_id"), seq: str = "seq") -> DataFrame:
    """Keep the last arrival of every key."""
    return last_per_key(items, list(keys), seq)


def in_search_order(items: DataFrame) -> DataFrame:
    return items.orderBy(F.desc("acquired_at"), "provider", "item_id")


def in_merged_order(items: DataFrame) -> DataFrame:
    """Newest first, equal times in order of arrival."""
    return items.orderBy(F.desc("acquired_at"), "seq")


def page(items: DataFrame, offset: int, size: int) -> DataFrame:
    """One page of the search order; sorted top-k, no full sort kept."""
    return in_search_order(items).offset(offset).limit(size)


def search(acquisitions: DataFrame, request: SearchRequest, offset: int = 0) -> DataFrame:
    return page(latest_arrivals(matching(acquisitions, request)), offset, request.page_size)


# --- many requests at once -------------------------------------------------------

BASE_CELL = 1.0
BUCKET_DAYS = 30
#: Cell and bucket sizes grow by this power of two from one level to the next.
STEP = 2


def _cells(low: Column, high: Column, size: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def _level(extent: Column, unit: float) -> Column:
    """The first level whose size, ``unit * 2 ** (STEP * level)``, is at least the extent."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(1e-9)) / unit) / STEP)).cast("int")


def _size(level: Column, unit: float) -> Column:
    return F.lit(unit) * F.pow(F.lit(2.0), STEP * level)


def _days(t: Column) -> Column:
    return F.unix_date(t.cast("date"))


def _span(prefix: str = "") -> Column:
    west, south, east, north = (F.col(prefix + c) for c in ("west", "south", "east", "north"))
    return F.greatest(east - west, north - south)


def _present(df: DataFrame, *columns: str) -> list[tuple]:
    """Distinct levels; there are as many as sizes have powers of two, whatever the rows."""
    return sorted(tuple(r) for r in df.select(*columns).distinct().collect())


def filed_requests(requests: DataFrame, item_levels: list[int]) -> DataFrame:
    """Requests in the cells and buckets of their own size, and in those of larger acquisitions.

    That is at most four cells and two buckets a level, for a request of any extent and duration.
    """
    asked = requests.select(
        "request_id",
        F.col("west").alias("r_west"), F.col("south").alias("r_south"),
        F.col("east").alias("r_east"), F.col("north").alias("r_north"),
        F.col("start_at").alias("r_start"), F.col("end_at").alias("r_end"),
        F.col("providers").alias("r_providers"), F.col("product_types").alias("r_products"),
        F.col("polarizations").alias("r_polarizations"), F.col("max_resolution_m").alias("r_max"),
    )
    levels = F.array(*[F.lit(v).cast("int") for v in item_levels]) if item_levels else F.array().cast("array<int>")
    asked = asked.withColumn("_own", _level(_span("r_"), BASE_CELL)).withColumn(
        "_tlevel", _level((_days(F.col("r_end")) - _days(F.col("r_start")) + 1).cast("double"), float(BUCKET_DAYS))
    )
    asked = asked.withColumn(
        "_level", F.explode(F.array_union(F.array("_own"), F.filter(levels, lambda v: v > F.col("_own"))))
    )
    bucket = _size(F.col("_tlevel"), float(BUCKET_DAYS))
    cell = _size(F.col("_level"), BASE_CELL)
    return (
        asked.withColumn("_cx", _cells(F.col("r_west"), F.col("r_east"), cell))
        .withColumn("_cy", _cells(F.col("r_south"), F.col("r_north"), cell))
        .withColumn("_bucket", _cells(_days(F.col("r_start")), _days(F.col("r_end")), bucket))
    )


def match_requests(acquisitions: DataFrame, requests: DataFrame) -> DataFrame:
    """Every (request, acquisition) match for a table of requests.

    Boxes meet in a grid hierarchy at the larger of their two levels: each is filed at its own level, and
    the smaller at those levels of the other table that occur.  Times meet in buckets as long as the
    request.  So neither a wide request nor a wide acquisition is spelled out cell by cell, and a site
    with a very long history spreads over many keys.  A pair is kept only in the cell holding the corner
    (max west, max south): no duplicates, no distinct.
    """
    sized = acquisitions.withColumn("_own", _level(_span(), BASE_CELL))
    item_levels = [v for (v,) in _present(sized, "_own")]
    asked = filed_requests(requests, item_levels)
    pairs = _present(asked.select("_own", "_tlevel"), "_own", "_tlevel")
    meet = F.array(*[F.struct(F.greatest("_own", F.lit(a)).alias("level"), F.lit(t).alias("tlevel")) for a, t in pairs])
    if not pairs:
        meet = F.array().cast("array<struct<level: int, tlevel: int>>")
    filed = (
        sized.withColumn("_at", F.explode(F.array_distinct(meet)))
        .withColumn("_level", F.col("_at.level")).withColumn("_tlevel", F.col("_at.tlevel"))
        .withColumn("_cell", _size(F.col("_level"), BASE_CELL))
        .withColumn("_bucket", F.floor(_days(F.col("acquired_at")) / _size(F.col("_tlevel"), float(BUCKET_DAYS))))
        .withColumn("_cx", _cells(F.col("west"), F.col("east"), F.col("_cell")))
        .withColumn("_cy", _cells(F.col("south"), F.col("north"), F.col("_cell")))
        .drop("_at", "_own")
    )
    # A request filed above its own level waits for acquisitions of that very level only.
    filed = filed.withColumn("_item", _level(_span(), BASE_CELL))
    asked = asked.withColumnRenamed("_own", "_asked")
    home_x = F.floor(F.greatest("west", "r_west") / F.col("_cell")) == F.col("_cx")
    home_y = F.floor(F.greatest("south", "r_south") / F.col("_cell")) == F.col("_cy")
    absent = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    # Both sides are many times larger than the estimate of the tables they are filed from.
    kept = spread(filed).join(asked, ["_level", "_tlevel", "_cx", "_cy", "_bucket"]).where(
        (F.col("_level") == F.greatest("_item", "_asked"))
        & box_intersects(
            F.col("west"), F.col("south"), F.col("east"), F.col("north"),
            F.col("r_west"), F.col("r_south"), F.col("r_east"), F.col("r_north"),
        )
        & home_x & home_y
        & F.col("acquired_at").between(F.col("r_start"), F.col("r_end"))
        & (absent("r_providers") | F.array_contains("r_providers", F.col("provider")))
        & (absent("r_products") | F.coalesce(F.array_contains("r_products", F.col("product_type")), F.lit(False)))
        & (absent("r_polarizations")
           | (F.size(F.array_except("r_polarizations", "polarizations")) == 0))
        & (F.col("r_max").isNull() | _within_resolution(F.col("r_max")))
    )
    return kept.select("request_id", *acquisitions.columns)


def request_pages(matches: DataFrame, offset: int, size: int) -> DataFrame:
    """The same page of every request, numbered, with the request's next offset.

    One match after the page tells that there is a next one, so ``total`` is a left join that Spark leaves out, with
    its pass over all matches, where the column is not read.
    """
    order = [F.desc("acquired_at"), "provider", "item_id"]
    end = offset + size
    window = first_per_key(matches.where("request_id IS NOT NULL"), ["request_id"], order, end + 1, "position")
    more = F.max("position").over(Window.partitionBy("request_id")) > end
    shown = window.withColumn("next_offset", F.when(more, F.lit(end))).where(F.col("position").between(offset + 1, end))
    totals = matches.groupBy("request_id").agg(F.count(F.lit(1)).alias("total"))
    return shown.join(totals, "request_id", "left").select("request_id", *[c for c in matches.columns if c != "request_id"], "position", "total", "next_offset")


def first_per_provider(items: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    return first_per_key(items, ["provider"], [seq], n, "provider_rank")


# --- reports ----------------------------------------------------------------------


def revisit_key() -> Column:
    """Centre of the box on a quarter-degree grid, as text."""
    # Adding zero turns a negative zero, which would print as "-0.00", into zero.
    lat = F.rint((F.col("south") + F.col("north")) / 2 * 4) / 4 + F.lit(0.0)
    lon = F.rint((F.col("west") + F.col("east")) / 2 * 4) / 4 + F.lit(0.0)
    return F.format_string("%.2f,%.2f", lat, lon)


def revisit_areas(acquisitions: DataFrame, top: int = 25, sample: int = 20) -> DataFrame:
    """Sites seen at least twice, busiest first, with their first item ids."""
    keyed = acquisitions.withColumn("grid_key", revisit_key())
    totals = keyed.groupBy("grid_key").agg(
        F.min("west").alias("west"), F.min("south").alias("south"),
        F.max("east").alias("east"), F.max("north").alias("north"),
        F.count(F.lit(1)).alias("acquisition_count"),
        F.min("acquired_at").alias("first_acquired_at"),
        F.max("acquired_at").alias("last_acquired_at"),
    )
    best = totals.where("acquisition_count >= 2").orderBy(F.desc("acquisition_count"), "grid_key").limit(top)
    # At most ``top`` keys: always small enough to broadcast.
    members = keyed.join(F.broadcast(best.select("grid_key")), "grid_key", "left_semi")
    first = (
        first_per_key(members, ["grid_key"], ["acquired_at", "seq"], sample)
        .groupBy("grid_key")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("_ids"))
        .select("grid_key", F.transform("_ids", lambda s: s["item_id"]).alias("item_ids"))
    )
    products = members.where(F.coalesce("product_type", F.lit("")) != "").groupBy("grid_key").agg(
        F.sort_array(F.collect_set("product_type")).alias("products")
    )
    polarizations = members.select("grid_key", F.explode("polarizations").alias("_p")).groupBy("grid_key").agg(
        F.sort_array(F.collect_set("_p")).alias("polarizations")
    )
    empty = F.array().cast("array<string>")
    return (
        best.join(first, "grid_key").join(products, "grid_key", "left")
        .join(polarizations, "grid_key", "left")
        .withColumn("products", F.coalesce("products", empty))
        .withColumn("polarizations", F.coalesce("polarizations", empty))
        .orderBy(F.desc("acquisition_count"), "grid_key")
    )


def feasibility_totals(acquisitions: DataFrame, objects: DataFrame) -> DataFrame:
    """Acquisition, object, byte and listing-page totals in one row."""
    left = acquisitions.agg(F.count(F.lit(1)).alias("acquisition_count"))
    right = objects.agg(
        F.count(F.lit(1)).alias("resolved_object_count"),
        F.coalesce(F.sum(F.coalesce("size_bytes", F.lit(0))), F.lit(0)).alias("resolved_object_bytes"),
        F.countDistinct("listing_url").alias("listing_pages"),
    )
    return left.crossJoin(F.broadcast(right))  # one row by one row


def warning_counts(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("code").agg(F.count(F.lit(1)).alias("warning_count")).orderBy("code")


def warning_sample(warnings: DataFrame, size: int = 50, seq: str = "seq") -> DataFrame:
    """First warning of every code in arrival order, then the rest up to ``size``."""
    first = warnings.groupBy("code").agg(F.min(seq).alias("_first"))
    return (
        warnings.join(first, "code")
        .withColumn("opens_code", F.col(seq) == F.col("_first"))
        .drop("_first")
        .orderBy(F.desc("opens_code"), seq)
        .limit(size)
    )


def provider_report(
    requested: DataFrame, results: DataFrame, warnings: DataFrame, pages: DataFrame
) -> DataFrame:
    """Status of each requested provider.

    ``requested(provider, configured)``; ``pages(provider, has_more, failed)``.
    """
    found = results.groupBy("provider").agg(F.count(F.lit(1)).alias("_found"))
    warned = warnings.groupBy("provider").agg(F.count(F.lit(1)).alias("_warned"))
    paged = pages.groupBy("provider").agg(
        F.bool_or("has_more").alias("_more"), F.bool_or("failed").alias("_failed")
    )
    failed = ~F.col("configured") | F.coalesce("_failed", F.lit(False))
    more = F.coalesce("_more", F.lit(False)) & ~failed
    warning_count = F.when(failed, F.lit(1)).otherwise(F.coalesce("_warned", F.lit(0)))
    return (
        requested.join(found, "provider", "left").join(warned, "provider", "left")
        .join(paged, "provider", "left")
        .select(
            "provider",
            F.when(failed, "failed")
            .when(more | (warning_count > 0), "partial").otherwise("complete").alias("status"),
            F.when(failed, F.lit(0)).otherwise(F.coalesce("_found", F.lit(0))).cast("bigint").alias("result_count"),
            more.alias("has_more"),
            warning_count.cast("bigint").alias("warning_count"),
        )
    )


def overall_status(report: DataFrame) -> DataFrame:
    return report.agg(
        F.sum("result_count").alias("result_count"),
        F.when(F.bool_or(F.col("status") != "complete"), "partial")
        .when(F.sum("result_count") > 0, "complete").otherwise("empty").alias("status"),
    )


def merge_responses(responses: DataFrame) -> DataFrame:
    """Roll several provider responses into one summary row.

    ``responses(provider, fulfilled, status, sampled_result_count, cache, generated_at)``.
    """
    ok = F.col("fulfilled")
    failed = F.count_if(~ok)
    return responses.agg(
        F.coalesce(F.sum(F.when(ok, F.col("sampled_result_count"))), F.lit(0)).alias("sampled_result_count"),
        failed.alias("failed_count"),
        F.when(F.coalesce(F.bool_and(F.when(ok, F.col("cache") == "hit")), F.lit(True)) & (failed == 0), "hit")
        .otherwise("miss").alias("cache"),
        F.max(F.when(ok, F.col("generated_at"))).alias("generated_at"),
        F.when((failed > 0) | F.bool_or(F.col("status") != "complete"), "partial")
        .when(F.sum(F.when(ok, F.col("sampled_result_count"))) > 0, "complete")
        .otherwise("empty").alias("status"),
    )


# --- joins ------------------------------------------------------------------------


def resolve_objects(acquisitions: DataFrame, objects: DataFrame) -> DataFrame:
    """One row per acquisition and object stored under its task prefix."""
    task = F.regexp_extract("object_key", f"^{TASK_PREFIX}([^/]+)/", 1)
    keyed = objects.withColumn("task_id", F.nullif(task, F.lit(""))).where(F.col("task_id").isNotNull())
    return acquisitions.select("item_id", "task_id").where(F.col("task_id").isNotNull()).join(keyed, "task_id")


def resolution_warnings(acquisitions: DataFrame, objects: DataFrame) -> DataFrame:
    no_task = acquisitions.where(F.col("task_id").isNull()).select(
        F.lit("missing_task_id").alias("code"), "item_id"
    )
    task = F.regexp_extract("object_key", f"^{TASK_PREFIX}([^/]+)/", 1)
    stored = objects.select(task.alias("task_id")).distinct()
    nothing = (
        acquisitions.where(F.col("task_id").isNotNull()).join(stored, "task_id", "left_anti")
        .select(F.lit("s3_objects_not_found").alias("code"), "item_id")
    )
    return no_task.unionByName(nothing)


def overlay_prepared(live: DataFrame, prepared: DataFrame, key: str = "item_id") -> DataFrame:
    """Prepared rows replace live rows of the same id; prepared-only rows are added."""
    columns = [c for c in live.columns if c != key]
    fresh = prepared.select(key, F.struct(*columns).alias("_prepared"))
    stored = live.select(key, F.struct(*columns).alias("_live"))
    merged = stored.join(fresh, key, "full_outer").select(
        key,
        F.when(F.col("_prepared").isNotNull(), F.col("_prepared")).otherwise(F.col("_live")).alias("_row"),
        F.when(F.col("_prepared").isNotNull(), "prepared").otherwise("live").alias("origin"),
    )
    return merged.select(key, *[F.col(f"_row.{c}").alias(c) for c in columns], "origin")


def union_providers(**sources: DataFrame) -> DataFrame:
    """Stack provider tables, tagging each row with its provider name."""
    frames = [df.withColumn("provider", F.lit(name)) for name, df in sources.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def allowed_sources(items: DataFrame, hosts: DataFrame, url: str = "source_url") -> DataFrame:
    """Flag items whose https host is the provider's own; ``hosts(provider, host)`` is a short list."""
    host = F.try_parse_url(F.col(url), F.lit("HOST"))
    scheme = F.try_parse_url(F.col(url), F.lit("PROTOCOL"))
    return items.join(hosts, "provider", "left").withColumn(
        "source_allowed",
        F.coalesce((scheme == "https") & (host == F.col("host")), F.lit(False)),
    ).drop("host")


def event_side(acquired_at: Column, event_date: Column) -> Column:
    """``before`` / ``after`` the event day; NULL on the day itself."""
    day = acquired_at.cast("date")
    return F.when(day < event_date, "before").when(day > event_date, "after")


def scene_listing(
    items: DataFrame, start: str, end: str, case_start: str, case_end: str, id_pattern: str
) -> DataFrame:
    """Scenes of a date window in time order, with every fault named in ``problem``."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    window_ok = (
        (lo < hi) & (F.datediff(hi, lo) < 60)
        & (lo >= F.lit(case_start).cast("date")) & (hi <= F.lit(case_end).cast("date"))
    )
    problem = (
        F.when(~window_ok, "date range is outside the case window")
        .when(~F.col("item_id").rlike(id_pattern), "item is outside the case grid")
        .when(F.col("cloud_cover").isNull(), "cloud cover is missing")
        .when(F.col("cloud_shadow").isNull(), "cloud shadow is missing")
        .when(F.col("nodata").isNull(), "nodata is missing")
    )
    return (
        items.where(F.col("acquired_at").cast("date").between(lo, hi))
        .withColumn("crs", F.format_string("EPSG:%d", F.col("epsg")))
        .withColumn("problem", problem)
        .orderBy("acquired_at", "item_id")
    )


# --- link traversal ---------------------------------------------------------------


def traverse(
    links: DataFrame, root: str, max_catalogs: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Breadth-first walk of ``links(parent_url, pos, rel, url)``.

    Returns ``(catalogs(url, depth, position), items(url, position))`` in visiting
    order.  Each level is one join, one anti-join and one distributed ranking; the
    driver only sees a count per level.
    """
    spark = links.sparkSession
    links = links.where(F.col("url").isNotNull())
    child = links.where(F.col("rel") == "child").select("parent_url", "pos", "url")
    visited = spark.range(1).select(
        F.lit(root).alias("url"), F.lit(0).alias("depth"), F.lit(1).cast("bigint").alias("position")
    )

    def parents(catalogs: DataFrame) -> DataFrame:
        return catalogs.select(F.col("url").alias("parent_url"), "position")

    frontier, count, depth = visited, 1, 0
    while max_catalogs is None or count < max_catalogs:
        depth += 1
        nxt = (
            child.join(parents(frontier), "parent_url")
            .groupBy("url").agg(F.min(F.struct("position", "pos")).alias("_at"))
            .join(visited.select("url"), "url", "left_anti")
        )
        placed = ranked(nxt, [], ["_at"], "_r").select(
            "url", F.lit(depth).alias("depth"), (F.col("_r") + count).alias("position")
        )
        if max_catalogs is not None:
            placed = placed.where(F.col("position") <= max_catalogs)
        placed = reliable_checkpoint(placed)
        added = placed.count()
        if added == 0:
            break
        # One table per level; they are joined into one only every sixteenth, so little is written twice.
        visited = visited.unionByName(placed)
        if depth % 16 == 0:
            visited = reliable_checkpoint(visited)
        frontier, count = placed, count + added
    found = (
        links.where(F.col("rel") == "item").join(parents(visited), "parent_url")
        .groupBy("url").agg(F.min(F.struct("position", "pos")).alias("_at"), F.count(F.lit(1)).alias("link_count"))
    )
    items = ranked(found, [], ["_at"], "position").select("url", "position", "link_count")
    return visited, items


def indexed_items(
    items: DataFrame, documents: DataFrame, max_items: int | None = None
) -> DataFrame:
    """Traversed items with their document, in order, up to ``max_items`` valid ones.

    ``documents(source_url, problem, …)``; rows past the limit are left out, invalid
    rows before it stay with their ``problem``.
    """
    joined = items.join(documents, items["url"] == documents["source_url"], "left").withColumn(
        "problem",
        F.when(F.col("source_url").isNull(), "document is missing").otherwise(F.col("problem")),
    )
    if max_items is None:
        return joined
    valid = joined.where(F.col("problem").isNull()).select("position")
    last = valid.orderBy("position").offset(max_items - 1).limit(1).select(F.col("position").alias("_last"))
    return joined.join(F.broadcast(last), F.lit(True), "left").where(
        F.col("_last").isNull() | (F.col("position") <= F.col("_last"))
    ).drop("_last")


def traversal_coverage(catalogs: DataFrame, links: DataFrame, indexed: DataFrame, items: DataFrame) -> DataFrame:
    """Counters of a walk in one row."""
    open_links = (
        links.where((F.col("rel") == "child") & F.col("url").isNotNull())
        .join(catalogs.select(F.col("url").alias("parent_url")), "parent_url", "left_semi")
        .join(catalogs.select("url"), "url", "left_anti")
    )
    parts = [
        catalogs.agg(F.count(F.lit(1)).alias("catalogs_visited")),
        items.agg(F.coalesce(F.sum("link_count"), F.lit(0)).alias("item_links_seen"), F.count(F.lit(1)).alias("_all")),
        indexed.agg(
            F.count_if(F.col("problem").isNull()).alias("items_indexed"),
            F.count_if(F.col("problem").isNotNull()).alias("items_skipped"),
        ),
        open_links.agg((F.count(F.lit(1)) > 0).alias("catalog_limit_reached")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))  # each part is one row
    return out.withColumn(
        "item_limit_reached", F.col("_all") > F.col("items_indexed") + F.col("items_skipped")
    ).drop("_all")


def malformed_links(links: DataFrame) -> DataFrame:
    return links.where(F.col("rel").isin("child", "item") & F.col("url").isNull()).select(
        F.lit("malformed_link").alias("code"), F.col("parent_url").alias("source_url"),
        F.lit("child or item link has an invalid href").alias("message"),
    )


def normalise_request_polarizations(requests: DataFrame) -> DataFrame:
    return requests.withColumn("polarizations", clean_polarizations(F.col("polarizations")))
