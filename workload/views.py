"""Views over the driver tables, written in SQL that Spark and DuckDB both accept.

``{name}`` stands for a table or another view.  Every view reads whole tables, so all
queries grow with the data.
"""

from __future__ import annotations

_HEX = "'0123456789abcdef0123456789abcdef0123456789abcdef0123456789abcdef'"

VIEWS: dict[str, str] = {
    # Acquisitions: one order is one arrival; every tenth arrival repeats its predecessor's item.
    "v_base": """
        SELECT o_orderkey AS seq, o_custkey AS cust, o_orderdate AS acquired_at, o_totalprice AS price,
               o_orderkey - CASE WHEN o_orderkey % 10 = 9 THEN 1 ELSE 0 END AS k
        FROM {orders}
    """,
    "v_acq": """
        SELECT seq, k, concat('acq-', CAST(k AS STRING)) AS item_id,
               CASE WHEN k % 2 = 0 THEN 'open-sar' ELSE 'sentinel-1' END AS provider,
               acquired_at,
               -120e0 + 0.1e0 * CAST((cust * 7) % 300 AS DOUBLE) + 0.02e0 * CAST(k % 4 AS DOUBLE) - 0.05e0 * CAST(1 + k % 5 AS DOUBLE) AS west,
               20e0 + 0.1e0 * CAST((cust * 13) % 200 AS DOUBLE) - 0.05e0 * CAST(1 + k % 5 AS DOUBLE) AS south,
               -120e0 + 0.1e0 * CAST((cust * 7) % 300 AS DOUBLE) + 0.02e0 * CAST(k % 4 AS DOUBLE) + 0.05e0 * CAST(1 + k % 5 AS DOUBLE) AS east,
               20e0 + 0.1e0 * CAST((cust * 13) % 200 AS DOUBLE) + 0.05e0 * CAST(1 + k % 5 AS DOUBLE) AS north,
               CASE WHEN k % 11 = 0 THEN NULL WHEN k % 3 = 0 THEN 'GEC' WHEN k % 3 = 1 THEN 'SLC' ELSE 'GRD' END AS product_type,
               CASE k % 4 WHEN 0 THEN 'VV' WHEN 1 THEN 'VV,VH' WHEN 2 THEN 'HH' ELSE 'HH,HV' END AS pol_text,
               CASE WHEN k % 7 = 0 THEN NULL ELSE 0.5e0 * CAST(1 + k % 6 AS DOUBLE) END AS resolution_range_m,
               CASE WHEN k % 13 = 0 THEN NULL ELSE 0.5e0 * CAST(1 + k % 4 AS DOUBLE) END AS resolution_azimuth_m,
               CASE WHEN k % 17 = 0 THEN NULL WHEN k % 2 = 0 THEN 'left' ELSE 'right' END AS observation_direction,
               CASE WHEN k % 3 = 0 THEN 'ascending' ELSE 'descending' END AS orbit_state,
               CASE WHEN k % 19 = 0 THEN NULL ELSE 20e0 + CAST(k % 30 AS DOUBLE) END AS incidence_angle_deg,
               CASE WHEN k % 19 = 0 THEN NULL ELSE 70e0 - CAST(k % 30 AS DOUBLE) END AS grazing_angle_deg,
               CASE WHEN k % 9 = 0 THEN NULL ELSE concat('task-', CAST(k AS STRING)) END AS task_id,
               concat(CASE WHEN k % 23 = 0 THEN 'http' ELSE 'https' END, '://',
                      CASE WHEN k % 29 = 0 THEN 'mirror.example.org' WHEN k % 2 = 0 THEN 'open-sar.example.org'
                           ELSE 'sentinel.example.org' END,
                      '/items/', CAST(k AS STRING), '.json') AS source_url
        FROM {v_base}
    """,
    # Items: the latest arrival of each.
    "v_last": "SELECT b.* FROM {v_base} b JOIN (SELECT max(seq) AS last_seq FROM {v_base} GROUP BY k) m ON m.last_seq = b.seq",
    "v_item": "SELECT a.* FROM {v_acq} a JOIN (SELECT max(seq) AS last_seq FROM {v_base} GROUP BY k) m ON m.last_seq = a.seq",
    "v_request": """
        SELECT CAST(c_custkey AS BIGINT) AS request_id,
               -120e0 + 0.1e0 * CAST((c_custkey * 7) % 300 AS DOUBLE) - 0.3e0 AS west,
               20e0 + 0.1e0 * CAST((c_custkey * 13) % 200 AS DOUBLE) - 0.3e0 AS south,
               -120e0 + 0.1e0 * CAST((c_custkey * 7) % 300 AS DOUBLE) + 0.1e0 * CAST(c_custkey % 9 AS DOUBLE) AS east,
               20e0 + 0.1e0 * CAST((c_custkey * 13) % 200 AS DOUBLE) + 0.1e0 * CAST(c_custkey % 9 AS DOUBLE) AS north,
               c_custkey % 80 AS month_no,
               CASE WHEN c_custkey % 3 = 0 THEN 'open-sar' ELSE '' END AS provider_text,
               CASE WHEN c_custkey % 4 = 0 THEN 'GEC,GRD' ELSE '' END AS product_text,
               CASE WHEN c_custkey % 5 = 0 THEN 'VV' ELSE '' END AS want_pol_text,
               CASE WHEN c_custkey % 6 = 0 THEN 2e0 ELSE NULL END AS max_resolution_m
        FROM {customer}
    """,
    # Items with slanted footprints; every second one at one site.  A point (x, y) of a footprint has
    # ``u = x - y / 4`` from ``u0`` to ``u1``, so areas are those of the boxes in (u, y).
    "v_slanted": """
        SELECT k, item_id, acquired_at, u0, u1, y0, y1, u0 + 0.25e0 * y0 AS west, y0 AS south, u1 + 0.25e0 * y1 AS east, y1 AS north,
               product_type, pol_text, resolution_range_m, resolution_azimuth_m, observation_direction, orbit_state,
               incidence_angle_deg, grazing_angle_deg
        FROM (SELECT *, CASE WHEN k % 2 = 0 THEN -100e0 ELSE west END + 0.0037e0 * CAST(k % 41 AS DOUBLE) AS u0,
                     CASE WHEN k % 2 = 0 THEN -99.8e0 ELSE east END + 0.0037e0 * CAST(k % 41 AS DOUBLE) AS u1,
                     CASE WHEN k % 2 = 0 THEN 30e0 ELSE south END + 0.0041e0 * CAST(k % 37 AS DOUBLE) AS y0,
                     CASE WHEN k % 2 = 0 THEN 30.2e0 ELSE north END + 0.0041e0 * CAST(k % 37 AS DOUBLE) AS y1
              FROM {v_item}) x
    """,
    # Pairs chosen by a user: a site's first item with each other one, and some far apart.
    "v_pair": """
        SELECT DISTINCT concat('acq-', CAST(f.first_k AS STRING)) AS before_id,
               concat('acq-', CAST(b.k AS STRING)) AS after_id
        FROM {v_last} b JOIN (SELECT cust, min(k) AS first_k FROM {v_last} GROUP BY cust) f ON f.cust = b.cust
        WHERE b.k <> f.first_k
        UNION ALL
        SELECT DISTINCT concat('acq-', CAST(k AS STRING)), concat('acq-', CAST(k + 1 AS STRING))
        FROM {v_base} WHERE k % 10 = 3
    """,
    "v_warning": """
        SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 2 = 0 THEN 'open-sar' ELSE 'sentinel-1' END AS provider,
               CASE WHEN o_orderkey % 400 = 33 THEN 'item_invalid' WHEN o_orderkey % 7 = 0 THEN 'empty_asset_href'
                    WHEN o_orderkey % 7 = 3 THEN 'missing_task_id' ELSE 'malformed_link' END AS code
        FROM {orders}
    """,
    # Stored objects: one per order line, keyed under the order's task.
    "v_object": """
        SELECT concat(CASE WHEN l_linenumber % 6 = 5 THEN 'misc/' ELSE 'sar-data/task-data/task-' END,
                      CAST(l_orderkey AS STRING), '/part-', CAST(l_linenumber AS STRING),
                      CASE WHEN l_partkey % 3 = 0 THEN '.tif' WHEN l_partkey % 3 = 1 THEN '.json' ELSE '.bin' END) AS object_key,
               CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS size_bytes,
               concat('page-', CAST(CAST(floor(l_orderkey / 100) AS BIGINT) AS STRING)) AS listing_url,
               l_orderkey, l_linenumber
        FROM {lineitem}
    """,
    # Catalog links: a tree of catalogs over order keys, order lines as items.
    "v_link": """
        SELECT concat('https://c.example.org/', CAST(CAST(floor((o_orderkey - 1) / 40) AS BIGINT) AS STRING)) AS parent_url,
               o_orderkey AS pos, 'child' AS rel,
               CASE WHEN o_orderkey % 53 = 0 THEN NULL
                    ELSE concat('https://c.example.org/', CAST(o_orderkey AS STRING)) END AS url
        FROM {orders} WHERE o_orderkey > 0
        UNION ALL
        SELECT concat('https://c.example.org/', CAST(l_orderkey AS STRING)), 1000000000 + l_linenumber, 'item',
               concat('https://c.example.org/item/', CAST((l_orderkey * 8 + l_linenumber) % 40000 AS STRING))
        FROM {lineitem}
    """,
    # Rasters: two runs on a square grid; a side without rows is nodata.
    "v_side": "SELECT CAST(floor(sqrt(count(*) / 16e0)) AS BIGINT) AS side FROM {lineitem}",
    "v_pix": """
        SELECT concat('run-', CAST(l_suppkey % 2 AS STRING)) AS run_id,
               CASE WHEN l_linestatus = 'O' THEN 'after' ELSE 'before' END AS role,
               CAST((l_orderkey * 7 + l_linenumber) % side AS INT) AS r, CAST(l_partkey % side AS INT) AS c,
               max(l_extendedprice) AS v
        FROM {lineitem} CROSS JOIN {v_side}
        GROUP BY l_suppkey % 2, CASE WHEN l_linestatus = 'O' THEN 'after' ELSE 'before' END,
                 CAST((l_orderkey * 7 + l_linenumber) % side AS INT), CAST(l_partkey % side AS INT)
    """,
    "v_run": "SELECT DISTINCT concat('run-', CAST(l_suppkey % 2 AS STRING)) AS run_id FROM {lineitem}",
    "v_grid": """
        SELECT run_id, CAST(side AS INT) AS width, CAST(side AS INT) AS height, 2e0 AS resolution,
               400000e0 AS minx, 4480000e0 AS maxy, 400000e0 + 2e0 * side AS maxx, 4480000e0 - 2e0 * side AS miny,
               'EPSG:32612' AS crs
        FROM {v_run} CROSS JOIN {v_side}
    """,
    # Evaluation cases: ten slots of 16x16 per case on a 64x48 grid, one reference per slot.
    "v_ref": """
        SELECT CAST(floor(s_suppkey / 10) AS BIGINT) AS case_id, s_suppkey AS reference,
               ((s_suppkey % 10) % 4) * 16 + 1 + s_suppkey % 3 AS x0,
               CAST(floor((s_suppkey % 10) / 4) AS BIGINT) * 16 + 1 + s_suppkey % 2 AS y0,
               6 + s_suppkey % 5 AS w, 6 + s_suppkey % 4 AS h,
               CASE WHEN s_suppkey % 3 = 0 THEN 'domain-reviewed' ELSE 'engineering-reviewed' END AS review_status
        FROM {supplier}
    """,
    "v_pred": """
        SELECT CAST(floor(p_partkey / 200) AS BIGINT) AS case_id, p_partkey AS prediction,
               concat('cand-', CAST(p_partkey AS STRING)) AS id,
               ((CAST(floor(p_partkey / 20) AS BIGINT) % 10) % 4) * 16 + 1 + CAST(floor(p_partkey / 20) AS BIGINT) % 3
                 + (p_partkey % 20) % 4 AS x0,
               CAST(floor((CAST(floor(p_partkey / 20) AS BIGINT) % 10) / 4) AS BIGINT) * 16 + 1
                 + CAST(floor(p_partkey / 20) AS BIGINT) % 2 + CAST(floor((p_partkey % 20) / 4) AS BIGINT) AS y0,
               6 + CAST(floor(p_partkey / 20) AS BIGINT) % 5 AS w, 6 + CAST(floor(p_partkey / 20) AS BIGINT) % 4 AS h
        FROM {part}
    """,
    "v_case": """
        SELECT DISTINCT CAST(floor(p_partkey / 200) AS BIGINT) AS case_id,
               concat('fixture-', CAST(CAST(floor(p_partkey / 200) AS BIGINT) AS STRING)) AS fixture_id,
               64 AS width, 48 AS height, 62 AS eval_w, 46 AS eval_h
        FROM {part}
    """,
    "v_annotation": """
        SELECT CAST(floor(p_partkey / 200) AS BIGINT) AS case_id, concat(CASE WHEN p_partkey % 3 = 0 THEN 'note-' ELSE 'cand-' END, CAST(p_partkey AS STRING)) AS candidate_id,
               CASE p_partkey % 6 WHEN 0 THEN 'geometry' WHEN 1 THEN 'water-moisture' WHEN 2 THEN 'speckle'
                    WHEN 3 THEN 'shadow-layover' WHEN 4 THEN 'registration-artifact' ELSE 'other' END AS failure_class,
               CASE WHEN p_partkey % 10 = 0 THEN 'pending' ELSE 'domain-reviewed' END AS review_status
        FROM {part}
    """,
    # Artifacts: a document is a file; every eleventh declaration is tampered with.
    "v_file": """
        SELECT doc_id, doc_id % 40 AS bundle_id, concat('docs/', CAST(doc_id AS STRING), '.txt') AS path, text,
               CAST(length(text) AS BIGINT) AS chars
        FROM {documents} WHERE doc_id % 17 <> 0
    """,
    "v_declared": """
        SELECT doc_id % 40 AS bundle_id, concat('art-', CAST(doc_id - CASE WHEN doc_id % 97 = 96 THEN 40 ELSE 0 END AS STRING)) AS artifact_id,
               concat(CASE WHEN doc_id % 71 = 0 THEN '../' ELSE '' END, 'docs/', CAST(doc_id AS STRING), '.txt') AS path,
               CASE WHEN doc_id % 31 = 0 THEN 'image/png' ELSE 'text/plain' END AS media_type,
               CASE WHEN doc_id % 17 = 0 OR doc_id % 51 = 7 THEN 'missing' ELSE 'available' END AS status,
               CASE WHEN doc_id % 11 = 0 THEN n_chars + 1 ELSE n_chars END AS declared_chars,
               doc_id, text, doc_id % 13 AS tamper
        FROM {documents}
    """,
    # Assessment log: six consecutive events per candidate, each naming its predecessor.
    "v_evt": """
        SELECT event_id AS seq, concat('assessment-', CAST(event_id AS STRING)) AS event_id,
               concat('req-', CAST(event_id - CASE WHEN event_id % 9 = 8 THEN 1 ELSE 0 END AS STRING)) AS request_id,
               concat('bundle-', CAST(CAST(floor(event_id / 6) AS BIGINT) % 7 AS STRING)) AS bundle_id,
               concat('cand-', CAST(CAST(floor(event_id / 6) AS BIGINT) AS STRING)) AS candidate_id,
               CASE event_type WHEN 'view' THEN 'supported' WHEN 'click' THEN 'rejected' WHEN 'purchase' THEN 'needs-context'
                    WHEN 'signup' THEN 'supported' ELSE 'undecided' END AS disposition,
               CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('  note ', CAST(event_id AS STRING), ' ') END AS note,
               CASE WHEN event_id % 13 = 0 THEN concat('assessment-', CAST(event_id - 2 AS STRING))
                    WHEN event_id % 6 = 0 THEN NULL
                    ELSE concat('assessment-', CAST(event_id - 1 AS STRING)) END AS supersedes_event_id,
               ts AS created_at
        FROM {events}
    """,
    "v_cand": """
        SELECT concat('bundle-', CAST(k % 7 AS STRING)) AS bundle_id, concat('cand-', CAST(k AS STRING)) AS candidate_id,
               CAST((k * 37) % 100 AS DOUBLE) / 100e0 AS score, k
        FROM (SELECT DISTINCT CAST(floor(event_id / 5) AS BIGINT) AS k FROM {events}) x
    """,
    # Labeling packets: one per supplier.
    "v_packet": """
        SELECT s_suppkey AS packet_id, CAST(60 + (s_suppkey * 37) % 90 AS INT) AS width, CAST(50 + (s_suppkey * 53) % 70 AS INT) AS height,
               CAST(1000 * s_suppkey AS DOUBLE) AS minx, 5000e0 AS maxy, 2e0 AS resolution, 'EPSG:32612' AS crs,
               concat('run-', CAST(s_suppkey AS STRING)) AS processing_run_id,
               concat('sha-', CAST(s_suppkey % 5 AS STRING)) AS manifest_sha256
        FROM {supplier}
    """,
    # Regions drawn on packets: one triangle per part, placed in tile 1 of its packet.
    "v_region": """
        SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS packet_id,
               CASE WHEN p_partkey % 29 = 0 THEN 'T-999' ELSE 'T-001' END AS tile_id,
               concat('T-001-R-', CAST(p_partkey - CASE WHEN p_partkey % 41 = 40 THEN 1 ELSE 0 END AS STRING)) AS region_id,
               CAST(1 + p_partkey % 20 AS DOUBLE) AS px, CAST(1 + p_partkey % 17 AS DOUBLE) AS py,
               CASE WHEN p_partkey % 23 = 0 THEN 0e0 ELSE 3e0 END AS side,
               CASE WHEN p_partkey % 19 = 0 THEN 0.5e0 ELSE 0e0 END AS nudge,
               CASE WHEN p_partkey % 31 = 0 THEN 'EPSG:4326' ELSE 'EPSG:32612' END AS geometry_crs,
               CASE WHEN p_partkey % 37 = 0 THEN 100e0 ELSE 0e0 END AS jump
        FROM {part}
    """,
    # Places: nations with a point.
    "v_place": """
        SELECT n_name AS name, concat(n_name, ', ', r_name) AS label,
               -60e0 + 5.5e0 * CAST(n_nationkey AS DOUBLE) AS lat, -179.96e0 + 14.99e0 * CAST(n_nationkey AS DOUBLE) AS lon
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
    """,
    "v_ask": """
        SELECT c_custkey AS query_id,
               CASE WHEN c_custkey % 50 = 0 THEN ' x ' WHEN c_custkey % 9 = 0 THEN 'Atlantis'
                    ELSE concat('  nation_', CAST(c_nationkey AS STRING), ' ') END AS query
        FROM {customer}
    """,
}
