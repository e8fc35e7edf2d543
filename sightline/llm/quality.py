"""Quality rules for observation statements: robust multivariate outliers per language and provider.

Each statement gets five base statistics and a vector of four transformed ones.  For every language and
provider the location and scatter of ordinary vectors come from a minimum-covariance-determinant estimate:
from medians and quartile ranges on, each concentration step takes the ``COVERAGE`` share of the vectors
nearest to the present centre and estimates anew from them, which never makes the determinant larger.  A
vector is an outlier when its squared Mahalanobis distance passes a chi-square limit.

Everything is DataFrame functions.  Text is read once; the steps run over a written table of numbers.
Each step is two grouped aggregations that combine map-side, so a group may hold any share of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.session import reliable_checkpoint

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Share of a group's vectors that an estimate rests on.
COVERAGE = 0.75
#: Concentration steps at most; they end when no estimate moves by more than a thousandth.
STEPS = 10
#: Groups with fewer vectors are estimated together, first with others of their language.
LEAST = 60
#: Share of ordinary vectors that the limit lets pass, were they normal.
PASSED = 0.99999
#: Resolution of each vector part: log word length, log symbols per 100 characters, share of repeated
#: lines, share of repeated words.  Added to every scatter, so that parts that hardly vary in a group
#: (most texts have no symbol at all) do not make trifles outliers.
FLOOR = (0.08, 0.25, 0.2, 0.15)
PARTS = len(FLOOR)


def chi_square_below(x: float, freedom: int) -> float:
    """Chi-square distribution function for an even number of degrees of freedom."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**i / math.factorial(i) for i in range(freedom // 2))


def chi_square_limit(share: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_below(middle, freedom) < share else (low, middle)
    return high


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def base_statistics(observations: DataFrame, text: str = "statement") -> DataFrame:
    """``observations`` without the text, plus ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``.

    Words are runs of anything but ASCII white space.  ``n_dup_lines`` counts lines with a word that equal
    an earlier line; ``n_repeat_words`` the words inside three-word windows that occur twice or more in the
    text, told apart by 64-bit hashes.  A null text has no words.
    """
    rest = [c for c in observations.columns if c != text]
    words = (
        observations.select(*rest, F.coalesce(F.col(text), F.lit("")).alias("_text"))
        .withColumn("_words", F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
        .withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: _without(x, SPACE) != ""))
    )
    counted = words.select(
        *rest, "_words", F.size("_words").cast("bigint").alias("n_words"),
        F.char_length(_without(F.col("_text"), SPACE)).cast("bigint").alias("word_chars"),
        (F.char_length("_text") - F.char_length(_without(F.col("_text"), SYMBOLS))).cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
    )
    starts = F.when(F.col("n_words") >= 3, F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    window = F.transform(
        starts, lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i"))
    )
    placed = counted.withColumn("_windows", F.array_sort(window))
    twice = F.filter(
        F.transform(
            "_windows",
            lambda x, k: F.when((x["h"] == F.get("_windows", k - 1)["h"]) | (x["h"] == F.get("_windows", k + 1)["h"]), x["i"]),
        ),
        lambda i: i.isNotNull(),
    )
    covered = F.aggregate(
        F.transform("_starts", lambda s, k: F.least(F.lit(3), F.coalesce(F.get("_starts", k + 1) - s, F.lit(3)))),
        F.lit(0), lambda total, n: total + n,
    )
    kept = [c for c in counted.columns if c != "_words"]
    return placed.select(*kept, F.sort_array(twice).alias("_starts")).select(*kept, covered.cast("bigint").alias("n_repeat_words"))


def _vector() -> list[Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log(chars / words), F.log1p(100 * F.col("n_symbols") / chars),
        F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), F.col("n_repeat_words") / words,
    ]


def _groups(rows: DataFrame, lang: str, provider: str) -> DataFrame:
    """``_group``: language and provider; small groups join their language's rest, small rests join each other."""
    name = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("?")) for c in (lang, provider)]
    rows = rows.withColumn("_lang", name[0]).withColumn("_pair", F.concat_ws("\x01", *name))
    fitted = F.col("_x").isNotNull()
    pairs = rows.where(fitted).groupBy("_lang", "_pair").agg(F.count(F.lit(1)).alias("_n"))
    small = pairs.where(F.col("_n") < LEAST)
    rests = small.groupBy("_lang").agg(F.sum("_n").alias("_rest"))
    named = pairs.join(rests, "_lang", "left").select(
        "_pair", F.when(F.col("_n") >= LEAST, F.col("_pair")).when(F.col("_rest") >= LEAST, F.col("_lang")).otherwise(F.lit("")).alias("_group")
    )
    return rows.join(reliable_checkpoint(named), "_pair", "left").drop("_lang", "_pair")


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(PARTS) for j in range(i + 1)]


def _factors(scatter: DataFrame) -> DataFrame:
    """Cholesky factors ``l_ij`` of the scatters ``s_ij``, column by column."""
    out = scatter
    for j in range(PARTS):
        for i in range(j, PARTS):
            value = F.col(f"s{i}{j}")
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(value) if i == j else value / F.col(f"l{j}{j}"))
    return out.select("_group", "n", *[f"m{i}" for i in range(PARTS)], *[f"l{i}{j}" for i, j in _pairs()])


def _distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """``rows`` with ``_d2``, the squared Mahalanobis distance to their group's estimate (null without one)."""
    named = [c for c in estimates.columns if c != "_group"]
    out = rows.join(estimates, "_group", "left")
    for i in range(PARTS):
        value = F.col("_x")[i] - F.col(f"m{i}")
        for k in range(i):
            value = value - F.col(f"l{i}{k}") * F.col(f"_z{k}")
        out = out.withColumn(f"_z{i}", value / F.col(f"l{i}{i}"))
    total = sum((F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(1, PARTS)), F.col("_z0") * F.col("_z0"))
    return out.withColumn("_d2", total).drop(*named, *[f"_z{i}" for i in range(PARTS)])


def _estimate(rows: DataFrame, widen: float) -> DataFrame:
    """Mean and scatter of each group; floors keep every factor real."""
    x = [F.col("_x")[i] for i in range(PARTS)]
    sums = rows.groupBy("_group").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(x[i]).alias(f"m{i}") for i in range(PARTS)],
        *[F.covar_pop(x[i], x[j]).alias(f"c{i}{j}") for i, j in _pairs()],
    )
    scatter = [
        (F.greatest(F.col(f"c{i}{j}"), F.lit(0.0)) * widen + F.lit(FLOOR[i] ** 2) if i == j else F.col(f"c{i}{j}") * widen).alias(f"s{i}{j}")
        for i, j in _pairs()
    ]
    return _factors(sums.select("_group", "n", *[f"m{i}" for i in range(PARTS)], *scatter))


def covariance_estimates(rows: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates of the vectors ``_x`` of each ``_group``."""
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    start = rows.groupBy("_group").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.percentile_approx(F.col("_x")[i], quarters, F.lit(2000)).alias(f"q{i}") for i in range(PARTS)],
    )
    spread = [((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349) for i in range(PARTS)]
    estimates = reliable_checkpoint(_factors(start.select(
        "_group", "n", *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(PARTS)],
        *[(spread[i] * spread[i] + F.lit(FLOOR[i] ** 2) if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i, j in _pairs()],
    )))
    nearest = chi_square_limit(COVERAGE, PARTS)
    widen = COVERAGE / chi_square_below(nearest, PARTS + 2)
    for _ in range(STEPS):
        far = _distance(rows, estimates).withColumn("_bin", F.floor(F.log2(F.col("_d2") + 1e-12) * 64).cast("int"))
        bins = far.groupBy("_group", "_bin").agg(F.count(F.lit(1)).alias("_n"))
        upto = Window.partitionBy("_group").orderBy("_bin")
        cut = (
            bins.withColumn("_sum", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(Window.partitionBy("_group")))
            .where(F.col("_sum") >= F.ceil(F.col("_all") * COVERAGE)).groupBy("_group").agg(F.min("_bin").alias("_cut"))
        )
        core = far.join(reliable_checkpoint(cut), "_group").where(F.col("_bin") <= F.col("_cut"))
        now = reliable_checkpoint(_estimate(core, widen))
        moved = [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) / F.lit(FLOOR[int(c[1])]) for c in now.columns if c[0] in "ml"]
        shift = now.alias("a").join(estimates.alias("b"), "_group").agg(F.max(F.greatest(*moved))).first()[0]
        estimates = now
        if shift is None or shift < 1e-3:
            break
    return estimates


def quality_verdicts(
    observations: DataFrame, id_col: str = "observation_id", text: str = "statement", lang: str = "lang", provider: str = "provider",
    least_words: int = 50, most_repeated: int = 50,
) -> DataFrame:
    """``(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance)`` per row.

    ``base_failed``: fewer than ``least_words`` words, or over ``most_repeated`` percent of them repeated.
    ``kept`` is false for these and for outliers (``distance``, squared, past the limit).  Estimates rest on
    the rows that pass the base rules.  A missing language or provider is a value of its own.  When fewer
    than ``LEAST`` rows are left for the last group, it has no estimate and its rows are kept.
    """
    rows = base_statistics(
        observations.select(F.col(id_col).alias("_id"), F.col(lang).alias("_l"), F.col(provider).alias("_p"), F.col(text).alias("_t")), "_t"
    ).withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")))
    rows = reliable_checkpoint(rows.withColumn("_x", F.when(~F.col("base_failed"), F.array(*_vector()))))
    grouped = reliable_checkpoint(_groups(rows, "_l", "_p").drop("_l", "_p", "n_lines"))
    estimates = covariance_estimates(grouped.where("_x IS NOT NULL").select("_group", "_x"))
    judged = _distance(grouped, estimates.where(F.col("n") >= COVERAGE * LEAST))
    near = F.coalesce(F.col("_d2") <= chi_square_limit(PASSED, PARTS), F.lit(True))
    return judged.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & near).alias("kept"), F.col("_d2").alias("distance"),
    )
