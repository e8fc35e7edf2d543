"""Operators that carry rows take columns of any name, their own working names included."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sightline.llm.hrefs import href_verdicts
from sightline.llm.mixing import curriculum
from sightline.llm.nearcopies import without_near_copies
from sightline.llm.repeats import without_repeats
from sightline.llm.simhash import one_per_group

NAMES = ["_id", "_key", "_row", "row", "_href", "_best", "_text_hash", "_copy", "_hash", "root", "_of", "_source", "a.b", "size", "_position"]


@pytest.fixture(scope="module")
def rows(spark):
    """Two equal statements, one other, one null and one without an id, with a mark in every odd column."""
    values = [(1, "one two three four five six", "p", 6), (2, "one two three four five six", "p", 6), (3, "seven words stand here and no more", "q", 7),
              (4, None, None, 0), (None, "a row that has no id at all", "q", 8)]
    frame = spark.createDataFrame(values, "observation_id long, statement string, provider string, words int")
    return frame.select("*", *[F.concat(F.lit(n), F.coalesce(F.col("observation_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES])


def whole(frame, columns):
    got = frame.collect()
    assert frame.columns == columns
    for r in got:
        mark = "-" if r["observation_id"] is None else str(r["observation_id"])
        assert all(r[n] == n + mark for n in NAMES)
    return sorted((r["observation_id"] for r in got), key=lambda i: (i is None, i or 0))


def test_one_per_group(rows):
    assert whole(one_per_group(rows), rows.columns) == [1, 3, 4, None]


def test_without_near_copies(rows):
    assert whole(without_near_copies(rows), rows.columns) == [1, 3, 4, None]


def test_without_repeats(rows):
    cut = without_repeats(rows, "observation_id", "statement")
    assert whole(cut.select("row.*"), rows.columns) == [1, 2, 3, 4, None]


def test_curriculum(rows):
    assert set(whole(curriculum(rows, F.col("words"), "observation_id"), rows.columns)) <= {1, 2, 3, None}


def test_href_verdicts(rows):
    links = rows.withColumn("href", F.lit("http://a.example.net/x"))
    got = href_verdicts(links)
    assert whole(got.drop("href", "link_host", "link_path", "rule", "verdict"), rows.columns) == [1, 2, 3, 4, None]
    assert {(r["rule"], r["verdict"]) for r in got.collect()} == {("net/", "block")}
