"""Mixing targets, passes and positions; packing plans and slots."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from sightline.llm.mixing import MOST, curriculum, mixing_plan, source_targets
from sightline.llm.packing import packed, plan_counts, token_pieces

ITEMS = "item_id BIGINT, provider STRING, words BIGINT, size STRING, positions INT"


def targets(sizes, weights, most=3):
    total, open_ = sum(sizes.values()), {s for s in sizes if sizes[s]}
    out = {s: 0.0 for s in sizes}
    left = float(total)
    while open_:
        share = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if share * weights[s] > most * sizes[s]}
        if not full:
            return out | {s: share * weights[s] for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


@pytest.fixture(scope="module")
def items():
    rng = random.Random(3)
    sources = ["hot"] * 300 + ["a", "b", "z", None, "Ä", "empty"] * 12
    rows = [(i, s, 0 if s == "empty" else rng.choice([0, 1, 7, 300, None]), "s", 1) for i, s in enumerate(sources)]
    return rows + [(5, "hot", 40, "s", 1)] * 3 + [(None, "a", 9, "s", 1)]


def test_mixing_meets_its_targets(spark, items):
    frame = spark.createDataFrame(items, ITEMS)
    got = mixing_plan(frame, F.col("words")).collect()
    assert len(got) == len(items)
    sizes = {}
    for _, s, n, *_ in items:
        sizes[s] = sizes.get(s, 0) + (n or 0)
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    for s in sizes:
        mine = [r for r in got if r["provider"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]}
        assert mine[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 300
    assert all(0 <= r["taken"] <= MOST * r["size"] and r["taken"] == r["passes"] * r["size"] for r in got)
    assert all(len(r["positions"]) == r["passes"] and r["positions"] == sorted(r["positions"]) for r in got)
    again = mixing_plan(frame.repartition(5), F.col("words")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_targets_of_equal_sources(spark):
    sizes = {"a": 10, "b": 10, "c": 10, "d": 10, "e": 10, "f": 10, "g": 500, "h": 10}
    rows = spark.createDataFrame(list(sizes.items()), "provider STRING, source_size BIGINT")
    got = {r["provider"]: r["target"] for r in source_targets(rows).collect()}
    want = targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))})
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(570)


def test_positions_follow_the_schedules(spark, items):
    got = mixing_plan(spark.createDataFrame(items, ITEMS), F.col("words")).collect()
    early = [p for r in got if r["provider"] == "a" for p in r["positions"]]
    late = [p for r in got if r["provider"] == "empty" for p in r["positions"]]
    assert all(0 <= p <= 1 for p in early) and not late


def test_curriculum_repeats_whole_rows_in_order(spark, items):
    frame = spark.createDataFrame(items, ITEMS)
    plan = {}
    for r in mixing_plan(frame, F.col("words")).collect():
        key = (r["item_id"], r["provider"], r["size"])
        plan[key] = plan.get(key, 0) + r["passes"]
    got = curriculum(frame, F.col("words"))
    assert got.columns == frame.columns
    seen = {}
    for r in got.collect():
        key = (r["item_id"], r["provider"], r["words"] or 0)
        seen[key] = seen.get(key, 0) + 1
    assert seen == {k: n for k, n in plan.items() if n}


def test_mixing_of_nothing(spark):
    empty = spark.createDataFrame([], ITEMS)
    assert mixing_plan(empty, F.col("words")).count() == 0 and curriculum(empty, F.col("words")).count() == 0
    assert source_targets(spark.createDataFrame([("a", 0)], "provider STRING, source_size BIGINT")).first()["target"] == 0


def test_plans_fill_sequences_without_gaps():
    rng = random.Random(1)
    for _ in range(100):
        size = rng.choice([5, 16, 64])
        counts = {n: rng.randint(1, 30) for n in rng.sample(range(1, size + 1), rng.randint(1, size))}
        ranks, filled = {n: set() for n in counts}, {}
        for length, rank, n, first, per, offset in plan_counts(counts, size):
            for i in range(n):
                ranks[length].add(rank + i)
                filled.setdefault(first + i // per, []).append((offset + i % per * length, length))
        assert {n: len(r) for n, r in ranks.items()} == counts
        assert sorted(filled) == list(range(len(filled)))
        for parts in filled.values():
            end = 0
            for at, length in sorted(parts):
                assert at == end
                end += length
            assert end <= size
        assert len(filled) >= -(-sum(n * c for n, c in counts.items()) // size)
    assert plan_counts({}) == []


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


TEXTS = [
    (1, "It's a TEST, isn't it? <|endoftext|>x 12345"), (2, None), (3, ""), (4, " \t\r\n"), (5, "a b c\x1cd\x85e　f"),
    (6, "é ́a İstanbul ΣΣ ﬁ"), (7, "word " * 5000), (8, "x" * 30000), (1, "again"), (None, "no id"), (9, "\U0001f600!!! ###"),
]


def test_pieces_are_those_of_whole_texts(spark, tokenizer):
    path, encoder = tokenizer
    frame = spark.createDataFrame([(i, t, 0) for i, t in TEXTS], "observation_id BIGINT, statement STRING, piece INT")
    got = [tuple(r) for r in token_pieces(frame, path).collect()]
    assert sorted(got, key=str) == sorted(brute.pieces(TEXTS, lambda t: encoder.encode(t, add_special_tokens=False).ids), key=str)
    ids = token_pieces(frame, path, with_ids=True).select("length", F.length("ids").alias("n")).collect()
    assert all(r["n"] == 4 * r["length"] for r in ids)


def test_packed_pieces_leave_no_gap(spark, tokenizer):
    frame = spark.createDataFrame(TEXTS * 3, "observation_id BIGINT, statement STRING")
    pieces = token_pieces(frame, tokenizer[0], size=64)
    got = packed(pieces, 64).collect()
    assert len(got) == pieces.count()
    filled = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end <= 64
    assert packed(pieces.limit(0), 64).count() == 0
