"""SimHash groups and repeated passages against brute force."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm.links import linked_components
from sightline.llm.repeats import repeated_windows, runs, without_repeats
from sightline.llm.simhash import close_pairs, fingerprint_links, one_per_group, simhash_groups

SCHEMA = "observation_id BIGINT, statement STRING, fp STRING, anchor STRING"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (0, 1, 2, 3, 30, 60, 90, 400, 5000)]
    out = [(i, t) for i, t in enumerate(base)]
    shared = prose(rng, 80)
    for i in range(40):
        words = base[5 + i % 3].split()
        if i % 2:
            words[rng.randrange(len(words))] = "changed"
        out.append((100 + i, " ".join(words)))
        out.append((200 + i, prose(rng, 20) + "\n" + shared[i : i + 350] + "\n" + prose(rng, 10)))
    out += [(300, None), (301, ""), (302, " \t\n"), (303, "é" * 3000), (304, "ab" * 1200), (None, base[5]), (None, "alone here"), (105, base[5]), (105, base[5])]
    return out


def test_simhash_groups_match_brute_force(spark, rows):
    got = sorted(map(tuple, simhash_groups(table(spark, rows)).collect()), key=str)
    assert got == sorted(brute.simhash_groups(rows), key=str)


def test_simhash_of_an_empty_table(spark):
    assert simhash_groups(table(spark, [])).count() == 0


def test_one_row_stays_of_each_group(spark, rows):
    groups = brute.simhash_groups(rows)
    kept = one_per_group(table(spark, rows))
    assert kept.columns == ["observation_id", "statement", "fp", "anchor"]
    ids = [r[0] for r in kept.collect()]
    fps = {i: f for i, f, _ in groups}
    named = {c for i, f, c in groups}
    assert sorted(i for i in ids if i is not None) == sorted(c for c in named if c is not None)
    assert ids.count(None) == 1 and fps[100]


def test_close_pairs_agree_with_counting_bits():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(5)])
    ends = np.repeat([70, 130, 200], [70, 60, 70])
    got = {(int(a), int(b)) for left, right in close_pairs(fps, ends) for a, b in zip(left, right, strict=True)}
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1)
    want = {(i, j) for i in range(200) for j in range(i + 1, ends[i]) if (bits[i] != bits[j]).sum() <= 3}
    assert got == want and want


def test_large_keys_are_split_without_losing_links(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fps = {int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 60, (150, 2))}
    frame = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp BIGINT")
    whole, parts = (
        {tuple(r) for r in linked_components(fingerprint_links(frame, block=b)).collect()} for b in (4096, 16)
    )
    assert whole == parts


def test_components_of_a_long_chain(spark):
    links = spark.range(500).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r["root"] for r in linked_components(links).collect()} == {0}
    assert linked_components(links.limit(0)).count() == 0


@pytest.mark.parametrize("most", [4096, 2])
def test_repeats_match_brute_force(spark, rows, most):
    got = without_repeats(table(spark, rows), runs_per_task=most)
    got = got.select("row.observation_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute.without_repeats(rows), key=str)


def test_repeats_with_a_small_window_and_coarse_bit_maps(spark):
    rng = random.Random(2)
    few = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    got = without_repeats(table(spark, few), threshold=12, anchor=5, bits=10)
    got = got.select("row.observation_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.without_repeats(few, 12))


def test_repeats_of_an_empty_table(spark):
    assert without_repeats(table(spark, [])).count() == 0
    assert repeated_windows(table(spark, [(1, None), (2, "")])).count() == 0


def test_runs_cover_every_window_once(monkeypatch):
    from sightline.llm import repeats

    monkeypatch.setattr(repeats, "CHUNK", 500)
    data = bytes(random.Random(1).choices(b"abc", k=2100))
    seen = [w for first, last, _, _ in runs(data) for a, b in zip(first, last, strict=True) for w in range(a, b + 1)]
    assert seen == list(range(len(data) - 199))
