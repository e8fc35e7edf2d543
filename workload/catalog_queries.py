"""Catalog queries: scans, search, paging, reports, joins, traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import geometry as geo
from sightline.functions.scalars import clean_polarizations, clean_products, parse_time, seconds_between
from sightline.operators import catalog, pairs
from sightline.operators.ranking import ranked
from sightline.sources import catalog as scans
from workload.registry import Inputs, query


def day(name: str) -> Column:
    return F.col(name).cast("date").cast("string")


def footprinted(df: DataFrame) -> DataFrame:
    """Acquisitions with their polarisation list and a box footprint."""
    ring = geo.box_ring(F.col("west"), F.col("south"), F.col("east"), F.col("north"))
    return df.withColumn("polarizations", F.split("pol_text", ",")).withColumn("footprint", F.array(ring))


REQUEST = catalog.SearchRequest(
    box=(-110.0, 25.0, -105.5, 29.5), start_at="1996-01-01 00:00:00", end_at="2000-12-31 00:00:00",
    product_types=("GEC", "GRD"), polarizations=("VV",), max_resolution_m=2.5, page_size=50,
)
_MATCH = """
    SELECT * FROM {v_acq}
    WHERE NOT (east < -110e0 OR west > -105.5e0 OR north < 25e0 OR south > 29.5e0)
      AND acquired_at >= TIMESTAMP '1996-01-01 00:00:00' AND acquired_at <= TIMESTAMP '2000-12-31 00:00:00'
      AND product_type IN ('GEC', 'GRD') AND pol_text IN ('VV', 'VV,VH')
      AND greatest(resolution_range_m, resolution_azimuth_m) <= 2.5e0
"""
_LATEST = f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider, item_id ORDER BY seq DESC) AS rn FROM ({_MATCH}) m) d
    WHERE rn = 1
"""
_SHOWN = "provider, item_id, seq, CAST(CAST(acquired_at AS DATE) AS STRING) AS acquired_on, product_type"


def shown(df: DataFrame) -> DataFrame:
    return df.select("provider", "item_id", "seq", day("acquired_at").alias("acquired_on"), "product_type")


@query("search_matches", f"SELECT {_SHOWN} FROM ({_MATCH}) m")
def search_matches(t: Inputs) -> DataFrame:
    return shown(catalog.matching(footprinted(t.v_acq), REQUEST))


@query("search_latest", f"SELECT {_SHOWN} FROM ({_LATEST}) m")
def search_latest(t: Inputs) -> DataFrame:
    hits = catalog.matching(footprinted(t.v_acq), REQUEST)
    return shown(catalog.latest_arrivals(hits))


@query("search_page", f"SELECT {_SHOWN} FROM ({_LATEST}) m ORDER BY acquired_at DESC, provider, item_id LIMIT 50 OFFSET 10")
def search_page(t: Inputs) -> DataFrame:
    return shown(catalog.search(footprinted(t.v_acq), REQUEST, offset=10))


def requests(t: Inputs) -> DataFrame:
    words = lambda c: F.filter(F.split(c, ","), lambda v: v != "")
    start = F.add_months(F.lit("1995-01-01").cast("date"), F.col("month_no").cast("int"))
    return t.v_request.select(
        "request_id", "west", "south", "east", "north",
        start.cast("timestamp_ntz").alias("start_at"),
        F.add_months(start, 2).cast("timestamp_ntz").alias("end_at"),
        words("provider_text").alias("providers"), words("product_text").alias("product_types"),
        words("want_pol_text").alias("polarizations"), "max_resolution_m",
    )


_REQUEST_MATCH = """
    SELECT r.request_id, a.provider, a.item_id, a.seq, a.acquired_at
    FROM {v_item} a JOIN {v_request} r
      ON NOT (a.east < r.west OR a.west > r.east OR a.north < r.south OR a.south > r.north)
     AND a.acquired_at >= DATE '1995-01-01' + to_months(CAST(r.month_no AS INT))
     AND a.acquired_at <= DATE '1995-01-01' + to_months(CAST(r.month_no + 2 AS INT))
     AND (r.provider_text = '' OR a.provider = r.provider_text)
     AND (r.product_text = '' OR a.product_type IN ('GEC', 'GRD'))
     AND (r.want_pol_text = '' OR a.pol_text IN ('VV', 'VV,VH'))
     AND (r.max_resolution_m IS NULL OR greatest(a.resolution_range_m, a.resolution_azimuth_m) <= r.max_resolution_m)
"""


@query("search_requests", f"SELECT request_id, provider, item_id FROM ({_REQUEST_MATCH}) m")
def search_requests(t: Inputs) -> DataFrame:
    return catalog.match_requests(footprinted(t.v_item), requests(t)).select("request_id", "provider", "item_id")


@query(
    "request_pages",
    f"""SELECT request_id, provider, item_id, position, CASE WHEN total > 3 THEN 3 END AS next_offset FROM (
        SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY acquired_at DESC, provider, item_id) AS position,
               count(*) OVER (PARTITION BY request_id) AS total FROM ({_REQUEST_MATCH}) m) p
        WHERE position > 1 AND position <= 3""",
)
def request_pages(t: Inputs) -> DataFrame:
    hits = catalog.match_requests(footprinted(t.v_item), requests(t))
    return catalog.request_pages(hits, 1, 2).select("request_id", "provider", "item_id", "position", "next_offset")


@query(
    "first_per_provider",
    """SELECT provider, item_id, seq, provider_rank FROM (
       SELECT *, row_number() OVER (PARTITION BY provider ORDER BY seq) AS provider_rank FROM {v_acq}) x
       WHERE provider_rank <= 500""",
)
def first_per_provider(t: Inputs) -> DataFrame:
    return catalog.first_per_provider(t.v_acq, 500).select("provider", "item_id", "seq", "provider_rank")


@query(
    "merged_order",
    f"""SELECT provider, item_id, seq, row_number() OVER (ORDER BY acquired_at DESC, seq) AS position
        FROM ({_LATEST}) m""",
)
def merged_order(t: Inputs) -> DataFrame:
    """Every merged hit with its place in the list, newest first."""
    hits = catalog.latest_arrivals(catalog.matching(footprinted(t.v_acq), REQUEST))
    return ranked(hits, [], [F.desc("acquired_at"), "seq"], "position").select("provider", "item_id", "seq", "position")


_KEY = """printf('%.2f,%.2f', round_even((south + north) / 2 * 4, 0) / 4 + 0e0, round_even((west + east) / 2 * 4, 0) / 4 + 0e0)"""


@query(
    "revisit_areas",
    f"""WITH keyed AS (SELECT *, {_KEY} AS grid_key FROM {{v_item}}),
        totals AS (SELECT grid_key, min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north,
                   count(*) AS acquisition_count, CAST(CAST(min(acquired_at) AS DATE) AS STRING) AS first_on,
                   CAST(CAST(max(acquired_at) AS DATE) AS STRING) AS last_on
                   FROM keyed GROUP BY grid_key HAVING count(*) >= 2 ORDER BY acquisition_count DESC, grid_key LIMIT 25),
        firsts AS (SELECT grid_key, string_agg(item_id, ',' ORDER BY rn) AS item_ids FROM (
                   SELECT grid_key, item_id, row_number() OVER (PARTITION BY grid_key ORDER BY acquired_at, seq) AS rn FROM keyed) x
                   WHERE rn <= 20 GROUP BY grid_key),
        prods AS (SELECT grid_key, string_agg(DISTINCT product_type, ',' ORDER BY product_type) AS products FROM keyed GROUP BY grid_key),
        pols AS (SELECT grid_key, string_agg(DISTINCT p, ',' ORDER BY p) AS polarizations FROM (
                 SELECT grid_key, unnest(string_split(pol_text, ',')) AS p FROM keyed) y GROUP BY grid_key)
        SELECT t.grid_key, round_even(west, 6) AS west, round_even(south, 6) AS south, round_even(east, 6) AS east,
               round_even(north, 6) AS north, acquisition_count, first_on, last_on, item_ids,
               coalesce(products, '') AS products, polarizations
        FROM totals t JOIN firsts USING (grid_key) JOIN prods USING (grid_key) JOIN pols USING (grid_key)""",
)
def revisit_areas(t: Inputs) -> DataFrame:
    areas = catalog.revisit_areas(footprinted(t.v_item))
    return areas.select(
        "grid_key", *[F.bround(c, 6).alias(c) for c in ("west", "south", "east", "north")], "acquisition_count",
        day("first_acquired_at").alias("first_on"), day("last_acquired_at").alias("last_on"),
        F.array_join("item_ids", ",").alias("item_ids"), F.array_join("products", ",").alias("products"),
        F.array_join("polarizations", ",").alias("polarizations"),
    )


@query(
    "feasibility_totals",
    """SELECT (SELECT count(*) FROM {v_item}) AS acquisition_count, count(*) AS resolved_object_count,
       CAST(sum(coalesce(size_bytes, 0)) AS BIGINT) AS resolved_object_bytes, count(DISTINCT listing_url) AS listing_pages FROM {v_object}""",
)
def feasibility_totals(t: Inputs) -> DataFrame:
    return catalog.feasibility_totals(t.v_item, t.v_object)


@query("warning_counts", "SELECT code, count(*) AS warning_count FROM {v_warning} GROUP BY code")
def warning_counts(t: Inputs) -> DataFrame:
    return catalog.warning_counts(t.v_warning)


@query(
    "warning_sample",
    """SELECT code, seq, opens_code FROM (SELECT *, seq = min(seq) OVER (PARTITION BY code) AS opens_code FROM {v_warning}) x
       ORDER BY opens_code DESC, seq LIMIT 50""",
)
def warning_sample(t: Inputs) -> DataFrame:
    return catalog.warning_sample(t.v_warning).select("code", "seq", "opens_code")


def _provider_report(t: Inputs) -> DataFrame:
    hits = catalog.latest_arrivals(catalog.matching(footprinted(t.v_acq), REQUEST))
    requested = t.sql(
        "SELECT DISTINCT provider, true AS configured FROM {v_acq} UNION ALL SELECT 'archive', false FROM {region} WHERE r_regionkey = 0"
    )
    pages = t.sql("SELECT provider, count(*) > 500 AS has_more, false AS failed FROM {v_acq} GROUP BY provider")
    return catalog.provider_report(requested, hits, t.v_warning, pages)


_REPORT = f"""
    SELECT p.provider, CASE WHEN NOT configured THEN 'failed' WHEN more OR warned > 0 THEN 'partial' ELSE 'complete' END AS status,
           found AS result_count, more AS has_more, CASE WHEN configured THEN warned ELSE 1 END AS warning_count
    FROM (SELECT q.provider, configured,
            (SELECT count(*) FROM ({_LATEST}) m WHERE m.provider = q.provider) AS found,
            (SELECT count(*) FROM {{v_warning}} w WHERE w.provider = q.provider) AS warned,
            (SELECT count(*) FROM {{v_acq}} a WHERE a.provider = q.provider) > 500 AS more
          FROM (SELECT DISTINCT provider, true AS configured FROM {{v_acq}} UNION ALL SELECT 'archive', false) q) p
"""


@query("provider_report", _REPORT)
def provider_report(t: Inputs) -> DataFrame:
    return _provider_report(t)


@query(
    "search_status",
    f"""SELECT CAST(sum(result_count) AS BIGINT) AS result_count, CASE WHEN bool_or(status <> 'complete') THEN 'partial'
        WHEN sum(result_count) > 0 THEN 'complete' ELSE 'empty' END AS status FROM ({_REPORT}) r""",
)
def search_status(t: Inputs) -> DataFrame:
    return catalog.overall_status(_provider_report(t))


_RESPONSES = """
    SELECT concat('source-', CAST(o_custkey % 5 AS STRING)) AS provider, o_orderstatus <> 'P' AS fulfilled,
           CASE WHEN o_orderkey % 3 = 0 THEN 'partial' ELSE 'complete' END AS status,
           o_orderkey % 20 AS sampled_result_count, CASE WHEN o_orderkey % 2 = 0 THEN 'hit' ELSE 'miss' END AS cache,
           o_orderdate AS generated_at FROM {orders}
"""


@query(
    "merged_responses",
    f"""SELECT CAST(coalesce(sum(CASE WHEN fulfilled THEN sampled_result_count END), 0) AS BIGINT) AS sampled_result_count,
        count(*) FILTER (WHERE NOT fulfilled) AS failed_count,
        CASE WHEN coalesce(bool_and(cache = 'hit') FILTER (WHERE fulfilled), true) AND count(*) FILTER (WHERE NOT fulfilled) = 0
             THEN 'hit' ELSE 'miss' END AS cache,
        CAST(CAST(max(generated_at) FILTER (WHERE fulfilled) AS DATE) AS STRING) AS generated_on,
        CASE WHEN count(*) FILTER (WHERE NOT fulfilled) > 0 OR bool_or(status <> 'complete') THEN 'partial' ELSE 'complete' END AS status
        FROM ({_RESPONSES}) r""",
)
def merged_responses(t: Inputs) -> DataFrame:
    merged = catalog.merge_responses(t.sql(_RESPONSES))
    return merged.withColumn("generated_on", day("generated_at")).drop("generated_at")


@query(
    "resolved_objects",
    """SELECT i.item_id, i.task_id, o.object_key, o.size_bytes FROM {v_item} i
       JOIN {v_object} o ON regexp_extract(o.object_key, '^sar-data/task-data/([^/]+)/', 1) = i.task_id""",
)
def resolved_objects(t: Inputs) -> DataFrame:
    return catalog.resolve_objects(t.v_item, t.v_object).select("item_id", "task_id", "object_key", "size_bytes")


@query(
    "resolution_warnings",
    """SELECT 'missing_task_id' AS code, item_id FROM {v_item} WHERE task_id IS NULL
       UNION ALL SELECT 's3_objects_not_found', item_id FROM {v_item} i WHERE task_id IS NOT NULL AND NOT EXISTS (
         SELECT 1 FROM {v_object} o WHERE regexp_extract(o.object_key, '^sar-data/task-data/([^/]+)/', 1) = i.task_id)""",
)
def resolution_warnings(t: Inputs) -> DataFrame:
    return catalog.resolution_warnings(t.v_item, t.v_object)


_LIVE = "SELECT item_id, product_type, k FROM {v_item} WHERE k % 4 <> 0"
_PREPARED = "SELECT item_id, 'PREPARED' AS product_type, k FROM {v_item} WHERE k % 6 = 0"


@query(
    "prepared_overlay",
    f"""SELECT coalesce(p.item_id, l.item_id) AS item_id, CASE WHEN p.item_id IS NOT NULL THEN p.product_type ELSE l.product_type END AS product_type,
        coalesce(p.k, l.k) AS k, CASE WHEN p.item_id IS NOT NULL THEN 'prepared' ELSE 'live' END AS origin
        FROM ({_LIVE}) l FULL OUTER JOIN ({_PREPARED}) p ON l.item_id = p.item_id""",
)
def prepared_overlay(t: Inputs) -> DataFrame:
    return catalog.overlay_prepared(t.sql(_LIVE), t.sql(_PREPARED))


@query("provider_union", "SELECT provider, item_id, product_type FROM {v_item}")
def provider_union(t: Inputs) -> DataFrame:
    items = t.v_item.drop("provider")
    both = catalog.union_providers(
        **{"open-sar": items.where("k % 2 = 0").drop("price"), "sentinel-1": items.where("k % 2 = 1")}
    )
    return both.select("provider", "item_id", "product_type")


@query(
    "allowed_sources",
    """SELECT item_id, provider, source_url LIKE concat('https://', CASE provider WHEN 'open-sar' THEN 'open-sar' ELSE 'sentinel' END, '.example.org/%')
       AS source_allowed FROM {v_item}""",
)
def allowed_sources(t: Inputs) -> DataFrame:
    hosts = t.sql(
        """SELECT DISTINCT provider, CASE provider WHEN 'open-sar' THEN 'open-sar.example.org'
           ELSE 'sentinel.example.org' END AS host FROM {v_acq}"""
    )
    return catalog.allowed_sources(t.v_item, hosts).select("item_id", "provider", "source_allowed")


@query(
    "event_sides",
    """SELECT item_id, CASE WHEN CAST(acquired_at AS DATE) < DATE '1998-06-01' THEN 'before'
       WHEN CAST(acquired_at AS DATE) > DATE '1998-06-01' THEN 'after' END AS side FROM {v_item}""",
)
def event_sides(t: Inputs) -> DataFrame:
    side = catalog.event_side(F.col("acquired_at"), F.lit("1998-06-01").cast("date"))
    return t.v_item.select("item_id", side.alias("side"))


_SCENES = """
    SELECT CASE WHEN k % 31 = 0 THEN concat('X-', item_id) ELSE item_id END AS item_id, acquired_at,
           CASE WHEN k % 12 = 0 THEN NULL ELSE CAST(k % 100 AS DOUBLE) END AS cloud_cover,
           CASE WHEN k % 14 = 0 THEN NULL ELSE 1e0 END AS cloud_shadow, 0e0 AS nodata, 32600 + k % 60 AS epsg
    FROM {v_item}
"""


@query(
    "scene_listing",
    f"""SELECT item_id, CAST(CAST(acquired_at AS DATE) AS STRING) AS acquired_on, concat('EPSG:', CAST(epsg AS STRING)) AS crs,
        CASE WHEN NOT regexp_full_match(item_id, 'acq-[0-9]+') THEN 'item is outside the case grid'
             WHEN cloud_cover IS NULL THEN 'cloud cover is missing' WHEN cloud_shadow IS NULL THEN 'cloud shadow is missing' END AS problem
        FROM ({_SCENES}) s WHERE CAST(acquired_at AS DATE) BETWEEN DATE '1998-05-01' AND DATE '1998-06-20'""",
)
def scene_listing(t: Inputs) -> DataFrame:
    scenes = catalog.scene_listing(
        t.sql(_SCENES), "1998-05-01", "1998-06-20", "1998-01-01", "1998-12-31", "^acq-[0-9]+$"
    )
    return scenes.select("item_id", day("acquired_at").alias("acquired_on"), "crs", "problem")


# --- scans of documents built from the tables ---------------------------------------


def item_documents(t: Inputs) -> DataFrame:
    """Acquisitions written as catalog-item JSON, some of them broken."""
    k = F.col("k")
    ring = F.array(
        *[F.array(F.col(x), F.col(y), F.lit(100.0)) for x, y in
          (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south"))]
    )
    when_text = F.concat(F.date_format("acquired_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".500Z"))
    properties = F.struct(
        F.when(k % 5 == 0, "").otherwise(when_text).alias("datetime"),
        F.when(k % 10 != 0, when_text).alias("start_datetime"),
        F.when(k % 3 == 0, "").otherwise(F.col("product_type")).alias("sar:product_type"),
        F.when(k % 3 == 0, F.col("product_type")).alias("product:type"),
        F.split("pol_text", ",").alias("sar:polarizations"),
        F.when(k % 6 == 0, 0.0).otherwise(F.col("resolution_range_m")).alias("sar:resolution_range"),
        F.lit(7.5).alias("sar:pixel_spacing_range"),
        F.col("resolution_azimuth_m").alias("sar:resolution_azimuth"),
        F.col("orbit_state").alias("sat:orbit_state"), F.col("task_id").alias("umbra:task_id"),
    )
    asset = lambda href: F.struct(href.alias("href"), F.lit("image/tiff").alias("type"), F.array(F.lit("data")).alias("roles"))
    body = F.to_json(
        F.struct(
            F.when(k % 37 == 0, "  ").otherwise(F.col("item_id")).alias("id"),
            F.when(k % 41 == 0, F.array(F.col("east"), F.col("south"), F.col("west"), F.col("north")))
            .otherwise(F.array(F.col("west"), F.col("south"), F.col("east"), F.col("north"))).alias("bbox"),
            F.when(k % 43 != 0, F.struct(F.lit("Polygon").alias("type"), F.when(k % 59 == 0, F.array().cast("array<array<array<double>>>")).otherwise(F.array(ring)).alias("coordinates"))).alias("geometry"),
            properties.alias("properties"),
            F.create_map(
                F.lit("main"), asset(F.concat(F.lit("../data/./"), F.col("item_id"), F.lit(".tif"))),
                F.lit("empty"), asset(F.lit(" ")),
            ).alias("assets"),
            F.array(F.struct(F.lit("self").alias("rel"), F.col("source_url").alias("href"))).alias("links"),
        )
    )
    return t.v_item.select(
        "k", F.col("source_url"), F.when(k % 47 == 0, F.lit("[1, 2]")).otherwise(body).alias("body")
    )


_FAULT = """CASE WHEN k % 47 = 0 THEN 'document is not an object' WHEN k % 43 = 0 THEN 'item geometry is missing'
    WHEN k % 37 = 0 THEN 'item id is missing' WHEN k % 10 = 0 THEN 'item acquisition time is missing'
    WHEN k % 41 = 0 THEN 'bbox must be an ordered WGS84 extent'
    WHEN k % 59 = 0 THEN 'geometry requires a type and non-empty coordinates' END"""
_FAULTS = f"SELECT *, {_FAULT} AS problem FROM {{v_item}}"


@query("item_faults", f"SELECT source_url, problem FROM ({_FAULTS}) f WHERE problem IS NOT NULL")
def item_faults(t: Inputs) -> DataFrame:
    return scans.normalise_items(item_documents(t)).where("problem IS NOT NULL").select("source_url", "problem")


@query(
    "item_scan",
    f"""SELECT source_url, item_id, CAST(CAST(acquired_at AS DATE) AS STRING) AS acquired_on, product_type,
        pol_text AS polarizations, CASE WHEN k % 6 = 0 THEN 7.5e0 ELSE coalesce(resolution_range_m, 7.5e0) END AS resolution_range_m,
        resolution_azimuth_m, orbit_state, task_id, 'unknown' AS license, 5 AS ring_points FROM ({_FAULTS}) f WHERE problem IS NULL""",
)
def item_scan(t: Inputs) -> DataFrame:
    items = scans.accepted(scans.normalise_items(item_documents(t)))
    return items.select(
        "source_url", "item_id", day("acquired_at").alias("acquired_on"), "product_type",
        F.array_join("polarizations", ",").alias("polarizations"), "resolution_range_m", "resolution_azimuth_m",
        "orbit_state", "task_id", "license", F.size(F.col("footprint")[0]).alias("ring_points"),
    )


@query(
    "asset_scan",
    f"""SELECT item_id, 'main' AS name, CASE WHEN source_url LIKE 'https:%' THEN
          concat(regexp_extract(source_url, '^(https://[^/]+)', 1), '/data/', item_id, '.tif') END AS href
        FROM ({_FAULTS}) f WHERE problem IS NULL
        UNION ALL SELECT item_id, 'empty', NULL FROM ({_FAULTS}) f WHERE problem IS NULL""",
)
def asset_scan(t: Inputs) -> DataFrame:
    items = scans.accepted(scans.normalise_items(item_documents(t)))
    return scans.asset_rows(items).select("item_id", "name", "href")


@query(
    "item_warnings",
    f"""SELECT code, count(*) AS n FROM (
        SELECT 'item_invalid' AS code FROM ({_FAULTS}) f WHERE problem IS NOT NULL
        UNION ALL SELECT 'empty_asset_href' FROM ({_FAULTS}) f WHERE problem IS NULL
        UNION ALL SELECT 'empty_asset_href' FROM ({_FAULTS}) f WHERE problem IS NULL AND source_url NOT LIKE 'https:%') w GROUP BY code""",
)
def item_warnings(t: Inputs) -> DataFrame:
    return scans.item_warnings(scans.normalise_items(item_documents(t))).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def _pages(t: Inputs) -> DataFrame:
    """Search pages of up to 20 features written from the item documents."""
    docs = item_documents(t).withColumn("page_no", F.floor(F.col("k") / 20))
    feature = F.when(F.col("k") % 47 == 0, F.lit("7")).otherwise(F.col("body"))
    return docs.groupBy("page_no").agg(F.sort_array(F.collect_list(F.struct("k", feature.alias("f")))).alias("_f")).select(
        F.concat(F.lit("https://search.example.org/"), F.col("page_no").cast("string")).alias("page_url"), "page_no",
        F.concat(
            F.lit('{"features":['), F.array_join(F.transform("_f", lambda s: s["f"]), ","),
            F.when(F.col("page_no") % 2 == 0, '],"links":[{"rel":"next","href":"https://search.example.org/n"}]}').otherwise('],"links":[]}'),
        ).alias("body"),
    )


_PAGES = "SELECT *, CAST(floor(k / 20) AS BIGINT) AS page_no FROM {v_item}"


@query(
    "page_features",
    f"""SELECT page_no, item_id FROM (SELECT *, {_FAULT} AS problem FROM ({_PAGES}) p) q
        WHERE problem IS NULL AND source_url LIKE 'https:%'""",
)
def page_features(t: Inputs) -> DataFrame:
    found = scans.feature_page_items(_pages(t)).where("source_url IS NOT NULL")
    return scans.accepted(scans.normalise_items(found, ["page_no"])).select("page_no", "item_id")


@query(
    "page_warnings",
    f"""SELECT concat('https://search.example.org/', CAST(page_no AS STRING)) AS source_url,
        CASE WHEN k % 47 = 0 THEN 'page holds a non-object feature' ELSE 'feature has no valid self link' END AS message
        FROM ({_PAGES}) p WHERE k % 47 = 0 OR source_url NOT LIKE 'https:%'""",
)
def page_warnings(t: Inputs) -> DataFrame:
    return scans.page_warnings(scans.feature_page_items(_pages(t))).select("source_url", "message")


@query("pages_with_more", f"SELECT page_no, page_no % 2 = 0 AS has_more FROM (SELECT DISTINCT page_no FROM ({_PAGES}) p) d")
def pages_with_more(t: Inputs) -> DataFrame:
    return scans.has_next_page(_pages(t)).select("page_no", "has_more")


def _listing(t: Inputs) -> DataFrame:
    """Object-listing XML pages of up to 1000 keys written from the order lines."""
    key = F.when((F.col("l_linenumber") == 3) & (F.col("l_orderkey") % 50 == 0), "").otherwise(F.col("object_key"))
    entry = F.concat(
        F.lit("<Contents><Key>"), key, F.lit('</Key><ETag>"e'), F.col("l_orderkey").cast("string"), F.lit('"</ETag><Size>'),
        F.coalesce(F.col("size_bytes").cast("string"), F.lit("n/a")), F.lit("</Size></Contents>"),
    )
    return t.v_object.groupBy("listing_url").agg(
        F.concat(F.lit("<ListBucketResult>"), F.array_join(F.collect_list(entry), ""), F.lit("</ListBucketResult>")).alias("body")
    )


@query(
    "object_listing",
    """SELECT listing_url, concat('https://bucket.example.org/', object_key) AS href,
       CASE WHEN object_key LIKE '%.tif' THEN 'image/tiff; application=geotiff' WHEN object_key LIKE '%.json' THEN 'application/json' END AS media_type,
       size_bytes, concat('e', CAST(l_orderkey AS STRING)) AS etag, regexp_extract(object_key, '([^/]*)$', 1) AS name
       FROM {v_object} WHERE NOT (l_linenumber = 3 AND l_orderkey % 50 = 0)""",
)
def object_listing(t: Inputs) -> DataFrame:
    found = scans.listing_objects(_listing(t), "https://bucket.example.org/")
    return found.where("object_key IS NOT NULL").select("listing_url", "href", "media_type", "size_bytes", "etag", "name")


@query(
    "listing_faults",
    "SELECT 'malformed_s3_object' AS code, listing_url AS source_url FROM {v_object} WHERE l_linenumber = 3 AND l_orderkey % 50 = 0",
)
def listing_faults(t: Inputs) -> DataFrame:
    return scans.listing_warnings(scans.listing_objects(_listing(t), "https://bucket.example.org/")).select("code", "source_url")


@query(
    "listing_page_faults",
    """SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'listing_unreadable' ELSE 'listing_truncated' END AS code, concat('page-', CAST(o_orderkey AS STRING)) AS source_url
       FROM {orders} WHERE o_orderkey % 7 = 0 OR (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0)""",
)
def listing_page_faults(t: Inputs) -> DataFrame:
    """A page per order: every seventh breaks off, every third is truncated, half of these without a token."""
    k = F.col("o_orderkey")
    token = F.when(k % 2 == 1, F.lit("<NextContinuationToken>t</NextContinuationToken>")).otherwise(F.lit("<NextContinuationToken/>"))
    page = F.concat(
        F.lit("<ListBucketResult><Contents><Key>a</Key></Contents>"),
        F.when(k % 3 == 0, F.concat(F.lit("<IsTruncated>true</IsTruncated>"), token)).otherwise(F.lit("<IsTruncated>false</IsTruncated>")),
        F.when(k % 7 == 0, F.lit("<Cont")).otherwise(F.lit("</ListBucketResult>")),
    )
    pages = t.orders.select(F.concat(F.lit("page-"), k.cast("string")).alias("listing_url"), page.alias("body"))
    return scans.listing_page_warnings(pages).select("code", "source_url")


@query(
    "page_faults",
    f"SELECT DISTINCT concat('https://search.example.org/', CAST(page_no AS STRING)) AS source_url FROM ({_PAGES}) p WHERE page_no % 5 = 0 OR page_no % 7 = 0",
)
def page_faults(t: Inputs) -> DataFrame:
    """Search pages of which some break off and some hold no list."""
    body = F.when(F.col("page_no") % 5 == 0, F.substring("body", 1, 9)).when(F.col("page_no") % 7 == 0, '{"features":{}}').otherwise(F.col("body"))
    return scans.unread_pages(_pages(t).withColumn("body", body)).select("source_url")


# --- traversal ----------------------------------------------------------------------

_WALK = """/*recursive*/ walk(url, depth) AS (
    SELECT 'https://c.example.org/0', 0
    UNION ALL SELECT l.url, w.depth + 1 FROM walk w JOIN {v_link} l ON l.parent_url = w.url AND l.rel = 'child' AND l.url IS NOT NULL)"""


@query("catalog_walk", f"WITH {_WALK} SELECT url, min(depth) AS depth FROM walk GROUP BY url")
def catalog_walk(t: Inputs) -> DataFrame:
    catalogs, _ = catalog.traverse(t.v_link, "https://c.example.org/0")
    return catalogs.select("url", "depth")


@query(
    "catalog_items",
    f"""WITH {_WALK} SELECT l.url, count(*) AS link_count FROM {{v_link}} l JOIN (SELECT DISTINCT url FROM walk) w
        ON l.parent_url = w.url WHERE l.rel = 'item' GROUP BY l.url""",
)
def catalog_items(t: Inputs) -> DataFrame:
    _, items = catalog.traverse(t.v_link, "https://c.example.org/0")
    return items.select("url", "link_count")


@query("malformed_links", "SELECT 'malformed_link' AS code, parent_url AS source_url FROM {v_link} WHERE url IS NULL")
def malformed_links(t: Inputs) -> DataFrame:
    return catalog.malformed_links(t.v_link).select("code", "source_url")


# --- pairs --------------------------------------------------------------------------

_PAIR = """
    SELECT p.before_id, p.after_id, b.acquired_at AS t_before, a.acquired_at AS t_after, b.product_type AS bp, a.product_type AS ap,
           b.pol_text AS bpol, a.pol_text AS apol, b.observation_direction AS bd, a.observation_direction AS ad,
           b.orbit_state AS bo, a.orbit_state AS ao, b.incidence_angle_deg AS bi, a.incidence_angle_deg AS ai,
           b.resolution_range_m AS br, a.resolution_range_m AS ar, b.resolution_azimuth_m AS bz, a.resolution_azimuth_m AS az,
           least(b.east, a.east) - greatest(b.west, a.west) AS iw, least(b.north, a.north) - greatest(b.south, a.south) AS ih,
           (b.east - b.west) * (b.north - b.south) AS b_area, (a.east - a.west) * (a.north - a.south) AS a_area,
           b.item_id IS NOT NULL AND a.item_id IS NOT NULL AS known
    FROM {v_pair} p LEFT JOIN {v_item} b ON b.item_id = p.before_id LEFT JOIN {v_item} a ON a.item_id = p.after_id
"""
_PAIR_OK = f"""SELECT *, CASE WHEN NOT known THEN 'acquisition is unknown' WHEN t_before >= t_after THEN 'before acquisition must precede after acquisition'
    WHEN iw <= 0 OR ih <= 0 THEN 'acquisition footprints do not have a polygonal intersection' END AS problem,
    coalesce(100e0 * abs(br - ar) / CASE WHEN br IS NOT NULL AND ar IS NOT NULL THEN least(br, ar) END, 100e0) AS rd,
    coalesce(100e0 * abs(bz - az) / CASE WHEN bz IS NOT NULL AND az IS NOT NULL THEN least(bz, az) END, 100e0) AS zd FROM ({_PAIR}) x"""


@query(
    "pair_comparability",
    f"""SELECT before_id, after_id, problem,
        CASE WHEN problem IS NULL THEN round_even(100e0 * iw * ih / b_area, 4) END AS before_overlap_percent,
        CASE WHEN problem IS NULL THEN round_even(100e0 * iw * ih / a_area, 4) END AS after_overlap_percent,
        round_even(rd, 6) AS range_delta, round_even(zd, 6) AS azimuth_delta, round_even(abs(bi - ai), 6) AS incidence_delta,
        CASE WHEN problem IS NULL THEN concat_ws(';',
          CASE WHEN bp IS DISTINCT FROM ap THEN 'product types differ' END,
          CASE WHEN left(bpol, 2) <> left(apol, 2) THEN 'no shared polarization' END,
          CASE WHEN bd IS DISTINCT FROM ad THEN 'observation directions differ' END,
          CASE WHEN bo <> ao THEN 'orbit states differ' END,
          CASE WHEN abs(bi - ai) > 5 THEN 'incidence angle differs by more than 5 degrees' END,
          CASE WHEN rd > 10 OR zd > 10 THEN 'spatial resolution differs by more than 10 percent' END) END AS warnings
        FROM ({_PAIR_OK}) y""",
)
def pair_comparability(t: Inputs) -> DataFrame:
    compared = pairs.compare_pairs(t.v_pair, footprinted(t.v_item))
    known = F.col("problem").eqNullSafe("acquisition is unknown")
    return compared.select(
        "before_id", "after_id", "problem",
        F.bround("before_overlap_percent", 4).alias("before_overlap_percent"),
        F.bround("after_overlap_percent", 4).alias("after_overlap_percent"),
        F.col("range_resolution_delta_percent").alias("range_delta"),
        F.col("azimuth_resolution_delta_percent").alias("azimuth_delta"),
        F.when(~known, F.col("incidence_angle_delta_deg")).alias("incidence_delta"),
        F.array_join("warnings", ";").alias("warnings"),
    )


@query(
    "nearest_pairs",
    """WITH sided AS (
        SELECT a.item_id AS after_id, b.item_id AS before_id, a.acquired_at AS a_at, b.acquired_at AS b_at,
          (least(a.u1, b.u1) - greatest(a.u0, b.u0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS shared,
          (b.u1 - b.u0) * (b.y1 - b.y0) AS b_area, (a.u1 - a.u0) * (a.y1 - a.y0) AS a_area,
          row_number() OVER (PARTITION BY a.item_id ORDER BY b.acquired_at DESC, b.item_id) AS spot
        FROM {v_slanted} a JOIN {v_slanted} b ON b.acquired_at < a.acquired_at
          AND a.u0 < b.u1 AND b.u0 < a.u1 AND a.y0 < b.y1 AND b.y0 < a.y1)
      SELECT before_id, after_id, CAST(date_diff('second', b_at, a_at) AS BIGINT) AS separation_seconds,
        round_even(100e0 * shared / b_area + 0.0000125e0, 2) AS before_overlap_percent, round_even(100e0 * shared / a_area + 0.0000125e0, 2) AS after_overlap_percent
      FROM sided WHERE spot = 1""",
)
def nearest_pairs(t: Inputs) -> DataFrame:
    x = lambda u, y: geo.point(F.col(u) + F.lit(0.25) * F.col(y), F.col(y))
    ring = F.array(x("u0", "y0"), x("u1", "y0"), x("u1", "y1"), x("u0", "y1"), x("u0", "y0"))
    items = t.v_slanted.withColumn("footprint", F.array(ring)).withColumn("polarizations", F.split("pol_text", ","))
    compared = pairs.compare_pairs(pairs.nearest_earlier(items), items)
    return compared.select(
        "before_id", "after_id", F.col("separation_seconds").cast("bigint").alias("separation_seconds"),
        # The offset keeps percentages that end in a rounded 5 off the limit between two results.
        *[F.bround(F.col(c) + F.lit(0.0000125), 2).alias(c) for c in ("before_overlap_percent", "after_overlap_percent")],
    )


_ROLES = """
    SELECT CAST(floor(k / 10) AS BIGINT) AS bundle_id, CASE WHEN k % 10 = 3 THEN 'before' ELSE 'after' END AS role, item_id
    FROM {v_item} WHERE k % 10 = 3 OR k % 10 = 4
    UNION ALL SELECT CAST(floor(k / 10) AS BIGINT), 'context', item_id FROM {v_item} WHERE k % 100 = 5
"""


@query(
    "prepared_bundles",
    f"""WITH roles AS ({_ROLES}) SELECT p.before_id, p.after_id, b.bundle_id FROM {{v_pair}} p
        JOIN roles b ON b.role = 'before' AND b.item_id = p.before_id
        JOIN roles a ON a.role = 'after' AND a.item_id = p.after_id AND a.bundle_id = b.bundle_id
        WHERE NOT EXISTS (SELECT 1 FROM roles c WHERE c.role = 'context' AND c.bundle_id = b.bundle_id)""",
)
def prepared_bundles(t: Inputs) -> DataFrame:
    return pairs.matching_bundles(t.v_pair, t.sql(_ROLES))


@query("selection_rules")
def selection_rules(t: Inputs) -> DataFrame:
    compared = pairs.compare_pairs(t.v_pair, footprinted(t.v_item)).withColumn("aoi_id", F.lit("aoi-1"))
    manifests = pairs.selection_manifests(compared)
    tampered = manifests.withColumns(
        {
            "before_at": F.lit(0), "after_at": F.col("separation_seconds"),
            "before_allowed": F.crc32("before_id") % 5 != 0, "after_allowed": F.lit(True),
            "manifest_sha256": F.when(F.crc32("after_id") % 7 == 0, F.lit("0" * 64)).otherwise(F.col("manifest_sha256")),
        }
    )
    return pairs.selection_violations(tampered).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "request_text",
    """SELECT doc_id, CASE WHEN length(trim(regexp_replace(lang, '\\s+', ' ', 'g'))) BETWEEN 2 AND 120 THEN lower(trim(lang)) END AS place_key,
       upper(lang) AS polarization, trim(source) AS product FROM {documents}""",
)
def request_text(t: Inputs) -> DataFrame:
    from sightline.functions.scalars import place_key

    return t.documents.select(
        "doc_id", place_key(F.concat(F.lit("  "), F.col("lang"), F.lit("\n "))).alias("place_key"),
        F.array_join(clean_polarizations(F.array(F.concat(F.col("lang"), F.lit(" ")), F.lit(" "))), ",").alias("polarization"),
        F.array_join(clean_products(F.array(F.col("source"), F.lit(""))), ",").alias("product"),
    )


@query(
    "parsed_times",
    """SELECT event_id, epoch_us(ts) AS us, date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) AS seconds FROM {events}""",
)
def parsed_times(t: Inputs) -> DataFrame:
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    at = parse_time(text)
    return t.events.select(
        "event_id", F.unix_micros(at).alias("us"),
        seconds_between(F.lit("2024-01-01T00:00:00Z").cast("timestamp"), at).cast("bigint").alias("seconds"),
    )
