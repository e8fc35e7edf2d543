"""Catalog documents: items, feature pages, object listings, link tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import schemas
from sightline.functions import geometry as geo
from sightline.functions.scalars import computed_once, first_number, first_text, parse_time

# Media types by object suffix: fixed values.
MEDIA_TYPES = {
    "json": "application/json",
    "tif": "image/tiff; application=geotiff",
    "tiff": "image/tiff; application=geotiff",
    "xml": "application/xml",
    "nitf": "application/vnd.nitf",
    "zip": "application/zip",
}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``source_url`` and ``body``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_url"), F.col("value").alias("body")
    )


def _without_dot_segments(path: Column) -> Column:
    return F.array_join(
        F.aggregate(
            F.split(path, "/"),
            F.array().cast("array<string>"),
            lambda acc, part: F.when(part == ".", acc)
            .when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
            .otherwise(F.concat(acc, F.array(part))),
        ),
        "/",
    )


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute https address of ``href`` seen from ``base``; NULL when unusable."""
    text = F.trim(href)
    origin = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(base, r"^[a-z]+://[^/?#]+([^?#]*/)", 1)
    joined = (
        F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), text)
        .when(text.startswith("//"), F.concat(F.lit("https:"), text))
        .when(text.startswith("/"), F.concat(origin, _without_dot_segments(text)))
        .otherwise(
            F.concat(
                origin,
                _without_dot_segments(
                    F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), text)
                ),
            )
        )
    )
    return F.when((text != "") & joined.rlike(r"^https://[^/?#]+"), joined)


def _no_coordinates(text: Column) -> Column:
    """Missing, null, or lists with nothing in them; otherwise a geometry of any type counts."""
    return ~F.coalesce(text.rlike("[0-9]"), F.lit(False))


def normalise_items(documents: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Catalog items from ``source_url`` and JSON ``body``; faults in ``problem``.

    Any geometry type with coordinates is an item; ``geometry`` keeps its JSON text, and ``footprint``
    holds the rings of polygons only.  Polarizations that are not text are left out.  The columns ``keep``
    of the documents are carried along.
    Rows with a NULL ``problem`` are usable acquisitions; the others are the
    quarantine and become ``item_invalid`` warnings.
    """
    parsed = documents.select(
        "source_url", *keep, (~F.coalesce(F.ltrim("body").startswith("{"), F.lit(False))).alias("_unread"),
        computed_once(F.from_json("body", schemas.CATALOG_ITEM)).alias("_d"),
    )
    p = F.col("_d.properties")
    box = [F.try_element_at(F.col("_d.bbox"), F.lit(i)) for i in range(1, 5)]
    rng = first_number(p["sar:resolution_range"], p["sar:pixel_spacing_range"])
    azm = first_number(p["sar:resolution_azimuth"], p["sar:pixel_spacing_azimuth"])
    when_text = first_text(p["datetime"], p["start_datetime"])
    item = parsed.select(
        "source_url", *keep,
        F.col("_d.id").alias("item_id"),
        parse_time(when_text).alias("acquired_at"),
        box[0].alias("west"), box[1].alias("south"), box[2].alias("east"), box[3].alias("north"),
        F.col("_d.geometry").alias("geometry"),
        F.get_json_object("_d.geometry", "$.type").alias("geometry_type"),
        geo.drop_altitude(
            F.when(
                F.get_json_object("_d.geometry", "$.type") == "Polygon",
                F.from_json(F.get_json_object("_d.geometry", "$.coordinates"), "array<array<array<double>>>"),
            )
        ).alias("footprint"),
        first_text(p["sar:product_type"], p["product:type"]).alias("product_type"),
        F.coalesce(
            F.transform(
                F.filter(p["sar:polarizations"], lambda v: F.schema_of_variant(v) == "STRING"),
                lambda v: F.try_variant_get(v, "$", "string"),
            ),
            F.array().cast("array<string>"),
        ).alias("polarizations"),
        rng.alias("resolution_range_m"), azm.alias("resolution_azimuth_m"),
        p["platform"].alias("platform"),
        p["sar:observation_direction"].alias("observation_direction"),
        p["sat:orbit_state"].alias("orbit_state"),
        p["view:incidence_angle"].alias("incidence_angle_deg"),
        p["umbra:grazing_angle_degrees"].alias("grazing_angle_deg"),
        F.coalesce(p["license"], F.lit("unknown")).alias("license"),
        p["umbra:task_id"].alias("task_id"),
        F.col("_d.assets").alias("assets"),
        F.col("_d.links").alias("links"),
        when_text.alias("_when"),
        F.size("_d.bbox").alias("_nbox"),
        (F.col("_unread") | F.col("_d").isNull()).alias("_unread"),
        p.isNull().alias("_noprops"), F.col("_d.geometry").isNull().alias("_nogeom"),
        _no_coordinates(F.get_json_object("_d.geometry", "$.coordinates")).alias("_nocoord"),
    )
    problem = (
        F.when(F.col("_unread"), "document is not an object")
        .when(F.col("_noprops"), "item properties is missing")
        .when(F.col("_nogeom"), "item geometry is missing")
        .when(F.col("_nbox").isNull() | (F.col("_nbox") < 4), "item bbox is missing or malformed")
        .when(F.coalesce(F.trim("item_id"), F.lit("")) == "", "item id is missing")
        .when(F.col("_when").isNull(), "item acquisition time is missing")
        .when(F.col("acquired_at").isNull(), "item acquisition time is malformed")
        .when(
            ~geo.valid_box(F.col("west"), F.col("south"), F.col("east"), F.col("north")),
            "bbox must be an ordered WGS84 extent",
        )
        .when(
            F.col("geometry_type").isNull() | F.col("_nocoord"),
            "geometry requires a type and non-empty coordinates",
        )
        .when(
            (F.col("resolution_range_m") <= 0) | (F.col("resolution_azimuth_m") <= 0),
            "resolution must be positive",
        )
    )
    return item.withColumn("problem", problem).drop(
        "_when", "_nbox", "_unread", "_noprops", "_nogeom", "_nocoord"
    )


def accepted(items: DataFrame) -> DataFrame:
    return items.where(F.col("problem").isNull()).drop("problem")


def asset_rows(items: DataFrame) -> DataFrame:
    """One row per named asset; an unusable href is NULL."""
    a = F.col("_a.value")
    rows = items.select("item_id", "source_url", F.explode(F.map_entries("assets")).alias("_a"))
    return rows.select(
        "item_id", "source_url",
        F.col("_a.key").alias("name"),
        resolve_link(F.col("source_url"), a["href"]).alias("href"),
        F.lit("stac").alias("origin"),
        a["type"].alias("media_type"), a["title"].alias("title"),
        F.coalesce(
            F.filter(a["roles"], lambda r: r.isNotNull()), F.array().cast("array<string>")
        ).alias("roles"),
    )


def item_warnings(items: DataFrame) -> DataFrame:
    """``item_invalid`` and ``empty_asset_href`` rows."""
    invalid = items.where(F.col("problem").isNotNull()).select(
        F.lit("item_invalid").alias("code"), "source_url", F.col("problem").alias("message")
    )
    empty = asset_rows(accepted(items)).where(F.col("href").isNull()).select(
        F.lit("empty_asset_href").alias("code"), "source_url",
        F.format_string("asset '%s' has no usable href", "name").alias("message"),
    )
    return invalid.unionByName(empty)


def feature_page_items(pages: DataFrame) -> DataFrame:
    """Explode search pages (``page_url``, ``page_no``, ``body``) into item documents.

    ``source_url`` is the feature's own https self link; features without one, or
    that are not objects, keep NULL and are reported by ``page_warnings``.
    """
    parsed = pages.withColumn("_p", computed_once(F.from_json("body", schemas.FEATURE_PAGE)))
    rows = parsed.select(
        "page_url", "page_no", F.posexplode("_p.features").alias("pos", "feature")
    )
    links = F.from_json("feature", "links ARRAY<STRUCT<rel: STRING, href: STRING>>")["links"]
    own = F.filter(links, lambda l: (l["rel"] == "self") & l["href"].rlike(r"^https://[^/?#]+"))
    return rows.select(
        "page_url", "page_no", "pos",
        computed_once(F.try_element_at(own, F.lit(1))["href"]).alias("source_url"),
        F.col("feature").alias("body"),
    )


def page_warnings(features: DataFrame) -> DataFrame:
    not_object = ~F.coalesce(F.ltrim("body").startswith("{"), F.lit(False))
    return features.where(not_object | F.col("source_url").isNull()).select(
        F.lit("feature_invalid").alias("code"), F.col("page_url").alias("source_url"),
        F.when(not_object, "page holds a non-object feature")
        .otherwise("feature has no valid self link").alias("message"),
    )


def unread_pages(pages: DataFrame) -> DataFrame:
    """Feature pages (``page_url``, ``body``) whose body is not an object with a list of features.

    Nothing can be taken from them, so each is a warning instead of no rows.
    """
    features = F.get_json_object("body", "$.features")
    return pages.where(~F.coalesce(features.startswith("["), F.lit(False))).select(
        F.lit("page_unreadable").alias("code"), F.col("page_url").alias("source_url"),
        F.lit("page has no list of features").alias("message"),
    )


def has_next_page(pages: DataFrame) -> DataFrame:
    links = F.from_json("body", schemas.FEATURE_PAGE)["links"]
    return pages.select(
        "page_url", "page_no",
        F.coalesce(F.exists(links, lambda l: l["rel"] == "next"), F.lit(False)).alias("has_more"),
    )


def listing_objects(pages: DataFrame, bucket_url: str) -> DataFrame:
    """Objects of bucket-listing XML pages (``listing_url``, ``body``, <=1000 keys each)."""
    parsed = pages.select(
        "listing_url", F.explode(F.from_xml("body", schemas.LISTING_PAGE)["Contents"]).alias("_o")
    )
    suffix = F.substring_index(F.lower("_o.Key"), ".", -1)
    media = F.create_map(*[F.lit(v) for pair in MEDIA_TYPES.items() for v in pair])
    return parsed.select(
        "listing_url",
        F.nullif(F.col("_o.Key"), F.lit("")).alias("object_key"),
        F.substring_index("_o.Key", "/", -1).alias("name"),
        F.concat(
            F.lit(bucket_url.rstrip("/") + "/"),
            F.replace(F.replace(F.url_encode("_o.Key"), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")),
        ).alias("href"),
        F.try_element_at(media, suffix).alias("media_type"),
        F.when(F.col("_o.Size").rlike("^[0-9]+$"), F.col("_o.Size").try_cast("bigint")).alias("size_bytes"),
        F.expr("trim(BOTH '\"' FROM _o.ETag)").alias("etag"),
    )


def listing_page_warnings(pages: DataFrame) -> DataFrame:
    """Listing pages that cannot be read, or that are cut off without a token for the next page."""
    read = pages.select("listing_url", "body", computed_once(F.from_xml("body", schemas.LISTING_PAGE)).alias("_p"))
    whole = F.coalesce(F.rtrim("body").endswith("</ListBucketResult>"), F.lit(False))
    cut = (F.lower("_p.IsTruncated") == "true") & (F.coalesce(F.trim("_p.NextContinuationToken"), F.lit("")) == "")
    message = F.when(F.col("_p").isNull() | ~whole, "listing page cannot be read").when(cut, "truncated listing has no continuation token")
    code = F.when(message == "listing page cannot be read", "listing_unreadable").otherwise("listing_truncated")
    return read.where(message.isNotNull()).select(code.alias("code"), F.col("listing_url").alias("source_url"), message.alias("message"))


def listing_warnings(objects: DataFrame) -> DataFrame:
    return objects.where(F.col("object_key").isNull()).select(
        F.lit("malformed_s3_object").alias("code"), F.col("listing_url").alias("source_url"),
        F.lit("listing entry has no key").alias("message"),
    )
