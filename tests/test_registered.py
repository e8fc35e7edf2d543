"""Registered queries against their SQL twins on the smallest tables."""

import os

import numpy as np
import pandas as pd
import pytest

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = (
    "search_latest", "request_pages", "revisit_areas", "catalog_walk", "item_scan", "object_listing", "pair_comparability",
    "role_quality", "score_tolerant", "cleaned_mask", "candidate_measures", "outline_areas", "set_report", "artifact_faults",
    "bundle_references", "case_rules", "labeling_rules", "supersession_conflicts", "evidence_export", "tile_cover", "streamed_intake",
    "resampled_cells", "exported_files", "streamed_requests",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = [
            "" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v))
            else repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_))
            else str(v)
            for v in df[c]
        ]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    import __spark_entry__ as entry

    got = plain(entry.queries()[name](spark, FOLDER).toPandas())
    want = plain(duck.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want) > 0
    assert got.equals(want)


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120
