"""Explicit schemas of external documents; nothing is inferred from data."""

from __future__ import annotations

CATALOG_ITEM = """
    id STRING,
    bbox ARRAY<DOUBLE>,
    geometry STRING,
    properties STRUCT<
        datetime: STRING, start_datetime: STRING,
        `sar:product_type`: STRING, `product:type`: STRING,
        `sar:polarizations`: ARRAY<VARIANT>,
        `sar:resolution_range`: DOUBLE, `sar:pixel_spacing_range`: DOUBLE,
        `sar:resolution_azimuth`: DOUBLE, `sar:pixel_spacing_azimuth`: DOUBLE,
        platform: STRING, `sar:observation_direction`: STRING, `sat:orbit_state`: STRING,
        `view:incidence_angle`: DOUBLE, `umbra:grazing_angle_degrees`: DOUBLE,
        license: STRING, `umbra:task_id`: STRING,
        `eo:cloud_cover`: DOUBLE, `s2:cloud_shadow_percentage`: DOUBLE,
        `s2:nodata_pixel_percentage`: DOUBLE, `proj:epsg`: INT>,
    assets MAP<STRING, STRUCT<href: STRING, type: STRING, title: STRING, roles: ARRAY<STRING>>>,
    links ARRAY<STRUCT<rel: STRING, href: STRING>>
"""

FEATURE_PAGE = "features ARRAY<STRING>, links ARRAY<STRUCT<rel: STRING, href: STRING>>"

LISTING_PAGE = """
    Contents ARRAY<STRUCT<Key: STRING, ETag: STRING, Size: STRING>>,
    IsTruncated STRING, NextContinuationToken STRING
"""

PREDICTION_PAGE = """
    type STRING,
    features ARRAY<STRUCT<
        type: STRING, id: STRING,
        geometry: STRUCT<type: STRING, coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>>>
"""

RUN_MANIFEST = """
    contract_version STRING, run_id STRING, selection_id STRING, kind STRING,
    source_run_id STRING, source_manifest_sha256 STRING, source_quality_sha256 STRING,
    candidate_count BIGINT,
    grid STRUCT<crs: STRING, resolution: DOUBLE, width: INT, height: INT,
                minx: DOUBLE, miny: DOUBLE, maxx: DOUBLE, maxy: DOUBLE>,
    artifacts ARRAY<STRUCT<artifact_id: STRING, role: STRING, kind: STRING,
                           relative_path: STRING, sha256: STRING, size_bytes: BIGINT>>
"""
