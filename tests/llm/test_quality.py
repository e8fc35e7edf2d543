"""Base statistics against plain counting; robust outliers on planted data."""

import random
from collections import Counter

import brute
import numpy as np
import pytest

from sightline.llm.quality import LEAST, base_statistics, chi_square_below, chi_square_limit, covariance_estimates, quality_verdicts

SCHEMA = "observation_id BIGINT, statement STRING, lang STRING, provider STRING, n_words STRING, kept STRING"


def counted(text):
    words = brute.WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if brute.WORD.search(x)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(400)]
    out = []
    for i in range(900):
        words = rng.choices(vocabulary, k=rng.randint(60, 300))
        bad = i % 9 == 0
        if bad:
            words = [w + rng.choice(["###", "$$$", "|", "&&"]) for w in words]
        for at in range(9, len(words), 10):
            words[at] += "\n"
        out.append((i, " ".join(words), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "a", "b", None]), "x", "y"))
    odd = [None, "", " \n\t", "a", "a b c", "a b c a b c", "x\x1cy\x85z\xa0w", "é ü 😀 #", "same line\nsame line\n\nsame line", "word " * 30_000, "a b\n" * 40]
    return out + [(2000 + i, t, None if i % 2 else "en", "hot", None, None) for i, t in enumerate(odd)] + [(1, "a b c", "en", "a", "x", "y")] * 2


def test_base_statistics(spark, rows):
    got = base_statistics(spark.createDataFrame(rows, SCHEMA).drop("n_words", "kept"))
    got = got.select("observation_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got)) == sorted((r[0], *counted(r[1])) for r in rows)


def test_verdicts_reject_planted_outliers_only(spark, rows):
    got = quality_verdicts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed
        if failed:
            assert not r["kept"] and r["distance"] is None
        elif r["observation_id"] < 900:
            assert r["kept"] == (r["observation_id"] % 9 != 0)


def test_few_rows_have_no_estimate_and_are_kept(spark, rows):
    few = quality_verdicts(spark.createDataFrame(rows[: LEAST // 3], SCHEMA)).collect()
    assert all(r["kept"] and r["distance"] is None for r in few)
    assert quality_verdicts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_estimates_resist_a_quarter_of_outliers(spark):
    rng = np.random.default_rng(0)
    scatter = np.array([[1, 0.6, 0.2, 0], [0.6, 2, 0, 0.3], [0.2, 0, 1.5, 0], [0, 0.3, 0, 1]])
    sound = rng.multivariate_normal([1, 2, 3, 4], scatter, 3000)
    wrong = rng.multivariate_normal([30, -20, 9, 9], np.eye(4), 700)
    frame = spark.createDataFrame([("g", [float(v) for v in x]) for x in np.r_[sound, wrong]], "_group STRING, _x ARRAY<DOUBLE>")
    row = covariance_estimates(frame).first()
    factor = np.array([[row[f"l{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
    assert np.allclose([row[f"m{i}"] for i in range(4)], [1, 2, 3, 4], atol=0.15)
    # The consistency factor supposes clean data, so the scatter comes out somewhat large; its shape holds.
    found = factor @ factor.T
    assert 1 < np.trace(found) / np.trace(scatter) < 1.6
    assert np.allclose(found / np.trace(found), scatter / np.trace(scatter), atol=0.04)


def test_chi_square():
    assert chi_square_below(9.488, 4) == pytest.approx(0.95, abs=1e-4)
    assert chi_square_limit(0.975, 6) == pytest.approx(14.449, abs=1e-2)
