"""Languages of observation statements as mixtures, inferred by expectation-maximisation.

Every learned language is a distribution over letter trigrams.  A statement is taken as draws from a
mixture of them: each trigram is shared out among the languages by their present proportions times its
likelihoods, the proportions become the mean shares, and so on until they rest.  The set of languages is
chosen by penalised likelihood: starting from all, the language that matters least goes for as long as the
Bayesian information criterion does not get worse.

Trigrams are counted over all rows to learn from and fall into ``2**SLOTS`` slots, so the model's size is
the number of languages times a constant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import by_value, map_arrow, worker_store

SLOTS = 16
#: Added to every slot's count.
PRIOR = 0.5
#: Rounds of one fit at most; it ends when no proportion moves by more than RESTED.
ROUNDS, RESTED = 50, 1e-4
#: Times the usual penalty of half a log count per language: neighbouring trigrams are not independent.
PENALTY = 10.0
#: Characters that are turned into trigrams at once.
CHARS = 1 << 20
UNKNOWN = "und"


def _letters() -> np.ndarray:
    store = worker_store("language letters")
    if "table" not in store:
        store["table"] = np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32)
    return store["table"]


def trigram_slots(text: str | None) -> Iterator[np.ndarray]:
    """Slots of the letter trigrams of a text; everything but letters is one space between words."""
    tail = np.array([32], np.uint32)
    data = (text or "").lower().encode("utf-32-le", "replace")
    for start in range(0, len(data), 4 * CHARS):
        part = _letters()[np.frombuffer(data[start : start + 4 * CHARS], "<u4")]
        if start + 4 * CHARS >= len(data):
            part = np.r_[part, np.uint32(32)]
        before = np.r_[tail[-1], part[:-1]]
        part = np.r_[tail, part[(part != 32) | (before != 32)]].astype(np.uint64)
        mixed = part[:-2] * np.uint64(0x9E3779B97F4A7C15) + part[1:-1] * np.uint64(0xBF58476D1CE4E5B9) + part[2:] * np.uint64(0x94D049BB133111EB)
        tail = part[-2:].astype(np.uint32)
        yield ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - SLOTS)).astype(np.int64)


class LanguageModel:
    """Log-probabilities of the slots in each learned language."""

    def __init__(self, names: list[str], counts: np.ndarray) -> None:
        self.names = names
        smooth = counts + PRIOR
        self.chances = (smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float64).copy()

    def mixture(self, text: str | None) -> dict[str, float]:
        """Proportions of the chosen languages; empty without letters or without learned languages."""
        if not self.names:
            return {}
        parts = [np.unique(s, return_counts=True) for s in trigram_slots(text)]
        if not parts or not sum(len(p[0]) for p in parts):
            return {}
        if len(parts) == 1:
            slots, counts = parts[0]
        else:
            total = np.zeros(1 << SLOTS, np.int64)
            for s, n in parts:
                total[s] += n
            slots = np.flatnonzero(total)
            counts = total[slots]
        chosen, shares = self._chosen(self.chances[slots], counts.astype(float))
        return {self.names[i]: float(s) for i, s in zip(chosen, shares, strict=True)}

    def _chosen(self, chances: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chosen = np.arange(chances.shape[1])
        shares, fit = _fit(chances, counts)
        penalty = PENALTY * np.log(counts.sum() + 1) / 2
        while len(chosen) > 1:
            stay = shares > shares.min()
            if not stay.any():
                stay = np.arange(len(chosen)) > 0
            fewer, worse = _fit(chances[:, stay], counts, shares[stay])
            if fit - worse > penalty * (len(chosen) - stay.sum()):
                break
            chosen, chances, shares, fit = chosen[stay], chances[:, stay], fewer, worse
        return chosen, shares


def _fit(chances: np.ndarray, counts: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation, and the log-likelihood they reach."""
    n = counts.sum()
    shares = np.full(chances.shape[1], 1 / chances.shape[1]) if start is None or not start.sum() else start / start.sum()
    if len(shares) > 1:
        for _ in range(ROUNDS):
            now = shares * ((counts / (chances @ shares)) @ chances) / n
            moved = abs(now - shares).max()
            shares = now
            if moved < RESTED:
                break
    return shares, float(counts @ np.log(chances @ shares))


def fit_languages(labelled: DataFrame, text: str = "statement", lang: str = "lang") -> LanguageModel:
    """Learn from every row with a language; counts are summed per language and slot before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column("_lang").to_pylist(), batch.column("_text"), strict=True):
                if name not in totals:
                    totals[name] = np.zeros(1 << SLOTS, np.int64)
                for slots in trigram_slots(value.as_py()):
                    np.add.at(totals[name], slots, 1)
        for name, counts in totals.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen), pa.array(counts[seen])], names=["lang", "slot", "n"])

    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"))
    fields = [T.StructField("lang", T.StringType()), T.StructField("slot", T.LongType()), T.StructField("n", T.LongType())]
    found = map_arrow(rows, run, fields).groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()  # languages x 2**SLOTS rows at most
    langs = np.array(found.column("lang").to_pylist(), dtype=object)
    names = sorted(set(langs))
    counts = np.zeros((len(names), 1 << SLOTS))
    place = {name: i for i, name in enumerate(names)}
    row = np.array([place[x] for x in langs], np.int64)
    counts[row, found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return LanguageModel(names, counts)


def language_mixtures(observations: DataFrame, model: LanguageModel, id_col: str = "observation_id", text: str = "statement") -> DataFrame:
    """``(id_col, lang_pred, score, mixture)`` per row; no shuffle.

    ``lang_pred`` is the language with the largest proportion (the first by name of equals), ``score`` that
    proportion, ``mixture`` all chosen languages with theirs.  Null texts, texts without letters and models
    without languages give ``und``, score 0 and no mixture.
    """
    shared = observations.sparkSession.sparkContext.broadcast(model)
    kinds = observations.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    fields = [
        kinds.schema["_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("mixture", T.MapType(T.StringType(), T.DoubleType())),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.mixture(x.as_py()) for x in batch.column(1)]
            best = [max(m.items(), key=lambda x: (x[1], [-ord(c) for c in x[0]]), default=(UNKNOWN, 0.0)) for m in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([b[0] for b in best], pa.string()), pa.array([min(b[1], 1.0) for b in best], pa.float64()),
                    pa.array([list(m.items()) for m in found], pa.map_(pa.string(), pa.float64())),
                ],
                names=[f.name for f in fields],
            )

    return map_arrow(kinds, run, fields).withColumnRenamed("_id", id_col)


by_value(__name__)
