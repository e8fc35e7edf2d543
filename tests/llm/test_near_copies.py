"""Near copies against plain Jaccard similarities and plain bit counts."""

import random

import brute
import numpy as np
import pytest

from sightline.llm.nearcopies import BITS, limit_bits, near_copy_rows, tables_needed, wide_fingerprint, wide_pairs, without_near_copies

WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]


def edited(rng, words, share):
    """The words with a share of them replaced in a few places."""
    out = list(words)
    for _ in range(max(1, round(share * len(out)))):
        out[rng.randrange(len(out))] = rng.choice(WORDS)
    return out


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(9), []
    for i in range(260):
        words = rng.choices(WORDS, k=rng.randint(60, 400))
        out.append((1000 * i, " ".join(words)))
        if i % 2:
            out += [(1000 * i + k, " ".join(edited(rng, words, rng.choice([0.004, 0.01, 0.02])))) for k in range(1, 3)]
    return out


@pytest.mark.parametrize("limit", [0, 1, 5, 44, 47, 255])
def test_bit_sliced_pairs(limit):
    rng = np.random.default_rng(limit)
    base = rng.integers(0, 256, (40, BITS // 8), dtype=np.uint8)
    near = base[rng.integers(0, 40, 150)].copy()
    for r in near:
        for b in rng.integers(0, BITS, rng.integers(0, 60)):
            r[b // 8] ^= 1 << (b % 8)
    fps = np.r_[base, near]
    sizes = [1, 70, 2, 117]
    ends = np.repeat(np.cumsum(sizes), sizes)
    bits = np.unpackbits(fps, axis=1)
    want = {(i, j) for i in range(190) for j in range(i + 1, ends[i]) if (bits[i] != bits[j]).sum() <= limit}
    got = [(int(a), int(b)) for left, right in wide_pairs(fps, ends, limit) for a, b in zip(left, right, strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_links_have_the_recall_of_brute_similarities(spark, rows):
    frame = spark.createDataFrame(rows, "observation_id BIGINT, statement STRING").repartition(6)
    root = {r["_id"]: r["root"] for r in near_copy_rows(frame).collect()}
    sets = [(i, brute.shingles(t)) for i, t in rows]
    near = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if len(a & b) >= 0.8 * len(a | b)]
    apart = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if i // 1000 != j // 1000]
    assert len(near) > 100 and sum(root[i] == root[j] for i, j in near) >= 0.9 * len(near)
    assert not any(root[i] == root[j] for i, j in apart)


def test_parts_of_a_large_key_lose_no_link(spark, rows):
    frame = spark.createDataFrame(rows[:200], "observation_id BIGINT, statement STRING")
    whole, parts = (
        {frozenset(r["_id"] for r in same) for same in _groups(near_copy_rows(frame, block=block).collect())} for block in (4096, 2)
    )
    assert whole == parts


def _groups(found):
    groups = {}
    for r in found:
        groups.setdefault(r["root"], []).append(r)
    return groups.values()


def test_one_of_each_group_stays(spark):
    text = " ".join(WORDS[:90])
    rows = [(5, text), (3, text + " more"), (3, text + " more"), (None, text), (8, None), (7, ""), (9, " \n"), (11, "few words"), (12, "few words"), (13, "other words")]
    rows.append((20, "long " * 400_000))
    odd = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "observation_id BIGINT, statement STRING, _id INT, _text_hash INT, `a.b` INT")
    kept = without_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r["observation_id"] for r in kept.collect()) == [3, 7, 11, 13, 20]
    assert without_near_copies(odd.limit(0)).count() == 0


def test_planned_numbers():
    assert tables_needed(1)[0] == 10 and tables_needed(10**9)[0] > tables_needed(10**6)[0] and 30 < limit_bits(0.8) < 60
    assert not wide_fingerprint(None).any() and wide_fingerprint(b"A b").tolist() == wide_fingerprint(b"a  B").tolist()
