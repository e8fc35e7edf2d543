import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sightline.operators.components import connected_components
from sightline.operators.ranking import exact_percentiles, last_per_key, preceding, ranked


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key."""
    return spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 101).alias("k"), F.xxhash64("id").alias("o")
    )


def test_ranked_equals_pandas(skewed):
    got = ranked(skewed, ["k"], ["o"]).toPandas()
    assert len(got) == 20000
    assert (got["rank"] == got.groupby("k")["o"].rank(method="first").astype(int)).all()


def test_ranked_without_keys_and_with_null_keys(spark):
    df = spark.createDataFrame([(None, 3), ("a", 1), (None, 2), ("a", 5)], "k string, o int")
    assert sorted((r["o"], r["r"]) for r in ranked(df, [], ["o"], "r").collect()) == [(1, 1), (2, 2), (3, 3), (5, 4)]
    assert sorted((r["o"], r["r"]) for r in ranked(df, ["k"], ["o"], "r").collect()) == [(1, 1), (2, 1), (3, 2), (5, 2)]


@pytest.mark.parametrize("small,accuracy", [(100000, 10000), (1, 100)])
def test_percentiles_are_exact(skewed, small, accuracy):
    values = skewed.select("k", (F.col("o") / 1e15).alias("v"))
    got = exact_percentiles(values, ["k"], "v", {"a": 0.02, "b": 0.5, "c": 0.98}, accuracy, small).toPandas().set_index("k").sort_index()
    want = values.toPandas().groupby("k")["v"].quantile([0.02, 0.5, 0.98]).unstack()
    assert np.allclose(got.to_numpy(), want.to_numpy(), rtol=0, atol=1e-9)


@pytest.mark.parametrize("accuracy", [10000, 100])
def test_percentiles_of_repeated_values(spark, accuracy):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 1.0).otherwise(F.col("id") / 7.0).alias("v"))
    got = exact_percentiles(df, [], "v", {"lo": 0.0, "p": 0.81, "hi": 1.0}, accuracy, 1).first()
    v = df.toPandas()["v"].to_numpy()
    assert tuple(got) == pytest.approx(tuple(np.percentile(v, [0, 81, 100])))


def test_last_per_key(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "k string, seq int, v string")
    assert sorted((r["k"], r["seq"], r["v"]) for r in last_per_key(df, ["k"], "seq").collect()) == [("a", 3, "z"), ("b", 1, None)]


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(5)
    edges = pd.DataFrame({"run_id": rng.choice(["x", "y"], 600), "u": rng.integers(0, 500, 600), "v": rng.integers(0, 500, 600)})
    hub = pd.DataFrame({"run_id": "x", "u": 7, "v": range(1000, 1300)})
    chain = pd.DataFrame({"run_id": "y", "u": range(2000, 2200), "v": range(2001, 2201)})
    edges = pd.concat([edges, hub, chain])
    got = connected_components(spark.createDataFrame(edges)).toPandas()
    parent = {}

    def find(n):
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n

    for run, u, v in edges[edges.u != edges.v].itertuples(index=False):
        a, b = sorted((find((run, u)), find((run, v))))
        parent[b] = a
    assert not got.duplicated(["run_id", "node"]).any()
    assert {(r.run_id, r.node): (r.run_id, r.root) for r in got.itertuples()} == {n: find(n) for n in parent}


def test_preceding_over_partitions_and_missing_keys(spark):
    """A hot key over many partitions, keys of one row, missing keys and values."""
    rows = [("hot", i, None if i % 50 == 7 else f"v{i}") for i in range(3000)] + [(None, i, f"n{i}") for i in range(5)] + [(f"k{i}", 1, "x") for i in range(40)]
    frame = spark.createDataFrame(rows, "k string, at int, v string").repartition(5)
    got = {(r["k"], r["at"]): r["before"] for r in preceding(frame, ["k"], ["at"], "v", "before").collect()}
    values = {(k, at): v for k, at, v in rows}
    assert got == {(k, at): values.get((k, at - 1)) for k, at, _ in rows}
    assert preceding(frame.limit(0), ["k"], ["at"], "v", "before").count() == 0
