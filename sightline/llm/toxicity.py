"""Toxic assessment notes by two character models, one of toxic and one of ordinary notes.

Both are interpolated n-gram models over the characters of words, with the words' ends as characters and
orders from 4 to 8.  As in Kneser-Ney smoothing, counts are numbers of contexts, not of occurrences: an
n-gram counts once for every different word of every note, so one repeated line adds nothing; an absolute
discount is taken off each count, and what is left stands on top of the n-gram one character shorter:

    P_c(g) = max(n_c(g) - D_c(g), 0) / N_c + B_c(g),    B_c(g) = P(g) * P_c(g') / P(g')

``P`` comes from the counts that both classes share, ``g'`` is ``g`` without its first character, and below
order 4 both classes are ``P``.  The discount is what backoff explains already: ``D = (1 + EXTRA) * E + MARGIN
* sqrt(E + 1)`` for ``E = N_c * B_c(g)``.  So a rare n-gram, and a common one that both classes use alike, has
the same probability in both and cancels out.  The n-grams of both classes are counted, whichever is the rarer.

A note's score is the sum of log P_toxic / P_ordinary over its characters, each by the longest n-gram that
ends there, over its length to the power ``POWER``, put on a logistic curve.  The curve is fitted on every
labelled note with models that leave out the note's own quarter of the notes.

N-grams, words and sums are Spark tables that grow with the notes.  Bit maps only keep rows that no join
would find out of shuffles; the joins decide.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import MIX, by_value, field, int64, map_arrow, member, membership, numbers, worker_store
from sightline.session import reliable_checkpoint

#: Orders of the n-grams that may differ between the classes.
ORDERS = (4, 8)
#: Standard deviations, and share of the expected count, that a count must be above what backoff predicts.
MARGIN, EXTRA = 3.0, 0.5
#: The least count that can be above its discount, which is more than ``MARGIN``.
LEAST = math.floor(MARGIN) + 1
POWER = 0.8
#: Parts of the labelled notes; each is scored by models without it when the curve is fitted.
FOLDS = 4
#: Steps of the sum, and its limit, in the histogram that the curve is fitted on.
STEP, LIMIT = 1e-3, 50.0
#: Characters that are read at once.
CHARS = 1 << 19
#: Logarithm of the bits that mark texts to be dropped; 4 MB, whatever the notes.
MARKED = 24
#: Rows that a task gathers before it adds them up.
HELD = 1 << 19
#: Words whose n-grams a task counts, and n-grams that it gathers before it adds them up.
COUNTED = 1 << 16
GATHERED = 1 << 17
#: Rows that may wait besides those already added up.
WAITING = 1 << 17
#: Words that a task remembers to have looked at, in 16 MB; a power of two.
REMEMBERED = 1 << 21


def _letters() -> np.ndarray:
    """The letter without case of every code point; 0 for all that parts words."""
    store = worker_store("toxicity letters")
    if "table" not in store:
        table = np.zeros(0x110000, np.uint32)
        for code in range(0x110000):
            letter = chr(code)
            if letter.isalpha() or unicodedata.category(letter)[0] == "M":
                table[code] = ord(letter.lower()[0])
        store["table"] = table
    return store["table"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _codes(letters: np.ndarray) -> np.ndarray:
    return _mixed((letters.astype(np.uint64) + np.uint64(1)) * MIX)


class Words:
    """The words of some notes: letters with a 0 before and after each, where words start, their notes and hashes."""

    def __init__(self, letters: np.ndarray, note: np.ndarray) -> None:
        """``letters`` of the notes one after another, each note followed by a 0."""
        letters = np.r_[np.uint32(0), letters]
        note = np.r_[note[:1], note]
        kept = (letters != 0) | (np.r_[np.uint32(1), letters[:-1]] != 0)
        self.letters, note = letters[kept], note[kept]
        gaps = np.flatnonzero(self.letters == 0)
        self.starts, self.ends = gaps[:-1] + 1, gaps[1:]
        self.note = note[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        lengths = self.ends - self.starts
        place = np.arange(len(self.letters)) - np.repeat(np.r_[0, self.starts], np.diff(np.r_[0, self.starts, len(self.letters)]))
        power = np.cumprod(np.full(int(place.max(initial=0)) + 1, MIX))
        values = np.where(self.letters == 0, np.uint64(0), _codes(self.letters) * power[place])
        self.hash = _mixed(np.add.reduceat(values, self.starts)) if len(self.starts) else np.zeros(0, np.uint64)
        #: Characters of a note's words, each word's end included.
        self.lengths = lengths + 1

    def word(self, i: int) -> str:
        return self.letters[self.starts[i] : self.ends[i]].astype("<u4").tobytes().decode("utf-32-le", "replace")


def words_of(texts: list[str | None]) -> Iterator[Words]:
    """The words of texts, some texts or a part of a long one at a time, cut between words.

    A word of more than ``CHARS`` letters is read as several.
    """
    held, notes, size = [], [], 0

    def done():
        return Words(np.concatenate(held), np.concatenate(notes))

    for i, text in enumerate(texts):
        data, at = (text or "").encode("utf-32-le", "replace"), 0
        while at < len(data):
            part = _letters()[np.frombuffer(data[at : at + 4 * CHARS], "<u4")]
            gaps = np.flatnonzero(part == 0)
            if at + 4 * CHARS < len(data) and len(gaps):
                part = part[: gaps[-1] + 1]
            at += 4 * len(part)
            held.append(np.r_[part, np.uint32(0)])
            notes.append(np.full(len(part) + 1, i))
            size += len(part)
            if size >= CHARS:
                yield done()
                held, notes, size = [], [], 0
    if held:
        yield done()


def grams(letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(order, end, gram, shorter)`` for every n-gram inside a word, its ends included, orders ascending.

    ``end`` is its last character's place in ``letters``, where a 0 stands before and after each word;
    ``shorter`` is the hash of the n-gram without its first character.
    """
    codes, inner = _codes(letters), np.cumsum(letters == 0)
    h = codes
    for n in range(2, ORDERS[1] + 1):
        if n > len(letters):
            return
        before, h = h, h[:-1] * MIX + codes[n - 1 :]
        if n >= ORDERS[0]:
            inside = np.flatnonzero(inner[n - 2 : len(letters) - 1] == inner[: len(h)])
            yield n, inside + n - 1, _mixed(h[inside] + np.uint64(n)), _mixed(before[inside + 1] + np.uint64(n - 1))


def _first_of(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_index=True)[1]


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows with one key added up, a column at a time so that no second copy of the counts is held."""
    key, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    added = np.empty((len(key), parts[0][1].shape[1]), np.int64)
    for j in range(added.shape[1]):
        added[:, j] = np.bincount(back, np.concatenate([c[:, j] for _, c in parts]), len(key))
    return key, added


#: Counts of toxic and ordinary contexts in every fold, as columns.
SLOTS = [f"n{c}_{f}" for c in (0, 1) for f in range(FOLDS)]


def _word_counts(labelled: DataFrame) -> DataFrame:
    """``(word, *SLOTS)``: in how many labelled notes of each class and fold a word is, from ``(packed, label, fold)``."""
    fields = [T.StructField("word", T.StringType()), *[T.StructField(s, T.LongType()) for s in SLOTS]]

    def rows(parts: list, known: list[np.ndarray], names: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        key, counts = _added(parts)
        parts.clear()
        place = np.argsort(np.concatenate(known))  # each word is named once; sorted like ``key``
        words = pa.chunked_array(names)
        for at in range(0, len(key), 50_000):
            to = slice(at, at + 50_000)
            some = words.take(pa.array(place[to])).combine_chunks()
            yield pa.RecordBatch.from_arrays([some, *map(pa.array, np.ascontiguousarray(counts[to].T))], names=[f.name for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, known, names, unpack = [], [], [], zstandard.ZstdDecompressor()
        told = np.zeros(0, np.uint64)  # the words that ``names`` holds, sorted
        held = size = 0  # rows in ``parts``, and those left when they were last added up
        for batch in batches:
            again, of = np.zeros(0, np.uint64), -1  # words already met in the note that the last part ended in
            texts = [unpack.decompress(p).decode() for p in batch.column("packed").to_pylist()]
            slot = (batch.column("label").to_numpy() * FOLDS + batch.column("fold").to_numpy()).astype(np.int64)
            for found in words_of(texts):
                key = _mixed(found.hash ^ _codes(found.note))
                first = _first_of(key)
                first = first[~np.isin(key[first], again)]
                if not len(first):
                    continue
                last = found.note[-1]
                again, of = np.r_[again if of == last else again[:0], key[first[found.note[first] == last]]], last
                counts = np.zeros((len(first), len(SLOTS)), np.int64)
                counts[np.arange(len(first)), slot[found.note[first]]] = 1
                parts.append(_added([(found.hash[first], counts)]))
                held += len(parts[-1][0])
                if held > WAITING + 2 * size:
                    # Words that come again in every part must not pile up.
                    parts = [_added(parts)]
                    held = size = len(parts[0][0])
                fresh = first[_first_of(found.hash[first])]
                place = np.searchsorted(told, found.hash[fresh])
                new = (place == len(told)) | (np.r_[told, np.uint64(0)][place] != found.hash[fresh])
                if new.any():
                    known.append(found.hash[fresh[new]])
                    names.append(pa.array([found.word(i) for i in fresh[new].tolist()], pa.string()))
                    told = np.insert(told, place[new], known[-1])
                if len(told) > HELD:
                    yield from rows(parts, known, names)
                    parts, known, names, told, held, size = [], [], [], told[:0], 0, 0
        if parts:
            yield from rows(parts, known, names)

    counted = map_arrow(labelled.select("packed", "label", "fold"), run, fields)
    return counted.groupBy("word").agg(*[F.sum(s).alias(s) for s in SLOTS])


def _gram_counts(words: DataFrame, slots: list[str]) -> DataFrame:
    """``(gram, shorter, n, *slots)``: the words' counts added up over the words that hold each n-gram."""
    fields = [T.StructField("gram", T.LongType()), T.StructField("shorter", T.LongType()), T.StructField("n", T.IntegerType()), *[T.StructField(s, T.LongType()) for s in slots]]

    def rows(parts: list, told: list) -> Iterator[pa.RecordBatch]:
        key, counts = _added(parts)
        parts.clear()
        known = np.concatenate([t[0] for t in told])
        first = _first_of(known)  # sorted like ``key``
        shorter, n = [np.concatenate([t[j] for t in told])[first] for j in (1, 2)]
        told.clear()
        for at in range(0, len(key), 100_000):
            to = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays(
                [int64(key[to]), int64(shorter[to]), pa.array(n[to], pa.int32()), *map(pa.array, np.ascontiguousarray(counts[to].T))], names=[f.name for f in fields]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, told, held = [], [], 0
        for batch in batches:
            counts = np.stack([batch.column(1 + j).to_numpy() for j in range(len(slots))], axis=1)
            for found in words_of(batch.column(0).to_pylist()):
                word = np.zeros(len(found.letters), np.int64)
                word[found.starts[0] - 1 :] = np.repeat(np.arange(len(found.starts)), np.diff(np.r_[found.starts, len(found.letters) + 1]))
                for n, end, gram, shorter in grams(found.letters):
                    owner = word[end - 1]
                    use = _first_of(_mixed(gram ^ _codes(owner)))
                    gram, shorter, owner = gram[use], shorter[use], owner[use]
                    parts.append(_added([(gram, counts[found.note[owner]])]))
                    first = _first_of(gram)
                    told.append((gram[first], shorter[first], np.full(len(first), n)))
                    held += len(first)
            if held > GATHERED:
                yield from rows(parts, told)
                parts, told, held = [], [], 0
        if held:
            yield from rows(parts, told)

    counted = map_arrow(words.select("word", *slots), run, fields)
    return counted.groupBy("gram", "shorter", "n").agg(*[F.sum(s).alias(s) for s in slots])


def _total(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns])


def _variants() -> list[list[int]]:
    """Which folds each model counts: all for the first, all but one for the others."""
    return [list(range(FOLDS)), *[[f for f in range(FOLDS) if f != out] for out in range(FOLDS)]]


def class_ratio(n: Column, both: Column, total: float, every: float, before: Column) -> Column:
    """``P_c(g) / P(g)`` from the class's count, both classes' count, their totals and the shorter n-gram's ratio."""
    share = both / F.lit(float(max(every, 1.0)))
    expected = F.lit(float(total)) * share * before
    left = n - F.lit(1 + EXTRA) * expected - F.lit(MARGIN) * F.sqrt(expected + 1)
    grown = F.greatest(left, F.lit(0.0)) / F.lit(float(max(total, 1.0))) / F.greatest(share, F.lit(1e-300)) + before
    return F.when(both > 0, grown).otherwise(before)


def gram_ratios(words: DataFrame) -> DataFrame:
    """``(gram, n, r0..rV)`` from ``(word, *SLOTS)``: log P_toxic / P_ordinary of the n-grams with counts above their discount.

    One column per model: ``r0`` of all folds, ``r1`` on without one each.  Order by order, since each stands
    on the n-grams one shorter.  Every n-gram of both classes is counted.  One with fewer than ``LEAST`` contexts in
    each class is backoff by the formula, in all models, and so are the longer ones that end with it.
    """
    sums = words.agg(F.count(F.lit(1)).alias("words"), *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in SLOTS]).first()
    words = words.repartition(sums["words"] // COUNTED + 1, "word")
    sides = [[s for s in SLOTS if s.startswith(f"n{c}")] for c in (0, 1)]
    counted = reliable_checkpoint(_gram_counts(words, SLOTS).where(F.greatest(*map(_total, sides)) >= LEAST))
    found, before = None, None
    for order in range(ORDERS[0], ORDERS[1] + 1):
        here = counted.where(F.col("n") == order)
        names = [f"p{c}_{v}" for v in range(FOLDS + 1) for c in (0, 1)]
        if before is None:
            here = here.select("*", *[F.lit(1.0).alias(p) for p in names])
        else:
            here = here.join(before.select(F.col("gram").alias("shorter"), *names), "shorter", "left")
        columns, own = [], F.lit(False)
        for v, folds in enumerate(_variants()):
            n = [_total([f"n{c}_{f}" for f in folds]).cast("double") for c in (0, 1)]
            totals = [float(sum(sums[f"n{c}_{f}"] for f in folds)) for c in (0, 1)]
            for c in (0, 1):
                low = F.coalesce(f"p{c}_{v}", F.lit(1.0))
                columns.append(class_ratio(n[c], n[0] + n[1], totals[c], sum(totals), low).alias(f"q{c}_{v}"))
                own = own | (F.col(f"q{c}_{v}") != F.coalesce(f"p{c}_{v}", F.lit(1.0)))
        level = here.select("gram", "n", *names, *columns).withColumn("own", own)
        # The join gives 1 to those without a row.
        moved = reduce(lambda a, b: a | b, [F.col(p.replace("p", "q")) != 1.0 for p in names])
        level = reliable_checkpoint(level.where(moved).select("gram", "n", "own", *[F.col(p.replace("p", "q")).alias(p) for p in names]))
        before = level
        kept = level.where("own").select("gram", "n", *[F.log(F.col(f"p1_{v}") / F.col(f"p0_{v}")).alias(f"r{v}") for v in range(FOLDS + 1)])
        found = kept if found is None else found.unionAll(kept)
    return found


def sized_membership(rows: DataFrame, column: str) -> np.ndarray:
    """A bit map of about 16 bits per row, from 2**20 to 2**28 bits; with more rows it lets more through."""
    n = max(rows.count(), 1)
    return membership(rows, [column], min(max(math.ceil(math.log2(16 * n)), 20), 28))[0]


RATIOS = [f"r{v}" for v in range(FOLDS + 1)]


def _words_with(texts: DataFrame, kept: np.ndarray, packed: bool) -> DataFrame:
    """``(word)``: different words of the column that may hold an n-gram of the bit map."""
    shared = texts.sparkSession.sparkContext.broadcast(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Each word's place holds the last one looked at there; a word met again goes to the ``distinct`` below.
        unpack, seen = zstandard.ZstdDecompressor(), np.zeros(REMEMBERED, np.uint64)
        seen[0] = 1  # 0 has not been met either
        for batch in batches:
            column = batch.column(0).to_pylist()
            out = []
            for found in words_of([unpack.decompress(p).decode() for p in column] if packed else column):
                known, first = np.unique(found.hash, return_index=True)
                place = (known & np.uint64(REMEMBERED - 1)).astype(np.int64)
                first = first[seen[place] != known]
                seen[place] = known
                if not len(first):
                    continue
                at = np.concatenate([np.r_[0, np.arange(found.starts[i], found.ends[i])] for i in first.tolist()])
                letters = np.r_[found.letters[at], np.uint32(0)]
                word = np.repeat(np.arange(len(first)), found.lengths[first])
                hit = np.zeros(len(first), bool)
                for _, end, gram, _ in grams(letters):
                    hit[word[end[member(shared.value, gram)] - 1]] = True
                out += [found.word(i) for i in first[hit].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["word"])

    return map_arrow(texts, run, [T.StructField("word", T.StringType())]).distinct()


def word_ratios(words: DataFrame, ratios: DataFrame, kept: np.ndarray) -> DataFrame:
    """``(hash, *RATIOS)``: the sums over each word's characters, by the longest n-gram that ends at each.

    ``kept`` is the bit map of the ratios' n-grams.
    """
    shared = words.sparkSession.sparkContext.broadcast(kept)
    fields = [T.StructField("hash", T.LongType()), T.StructField("end", T.IntegerType()), T.StructField("gram", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in words_of(batch.column(0).to_pylist()):
                word = np.zeros(len(found.letters), np.int64)
                word[found.starts[0] - 1 :] = np.repeat(np.arange(len(found.starts)), np.diff(np.r_[found.starts, len(found.letters) + 1]))
                for _, end, gram, _ in grams(found.letters):
                    use = member(shared.value, gram)
                    end, gram = end[use], gram[use]
                    owner = word[end - 1]
                    yield pa.RecordBatch.from_arrays(
                        [int64(found.hash[owner]), pa.array((end - found.starts[owner]).astype(np.int32)), int64(gram)], names=[f.name for f in fields]
                    )

    spelled = map_arrow(words.select("word"), run, fields).join(ratios, "gram")
    longest = spelled.groupBy("hash", "end").agg(*[F.max_by(r, "n").alias(r) for r in RATIOS])
    return longest.groupBy("hash").agg(*[F.sum(r).alias(r) for r in RATIOS])


class ToxicityModel:
    """N-gram ratios as a Spark table with its bit map, the curve, and the share of toxic labels."""

    def __init__(self, ratios: DataFrame | None, kept: np.ndarray | None, slope: float, intercept: float, prior: float) -> None:
        self.ratios, self.kept, self.slope, self.intercept, self.prior = ratios, kept, slope, intercept, prior


def _sums(rows: DataFrame, text: str, keys: list[str], model: ToxicityModel, ratio: Column, packed: bool = False) -> DataFrame:
    """``(*keys, x)``: the normalised sum of every note with a word that weighs; rows with equal keys are one note."""
    context = rows.sparkSession.sparkContext
    words = reliable_checkpoint(_words_with(rows.select(text), model.kept, packed))
    weighed = reliable_checkpoint(word_ratios(words, model.ratios, model.kept))
    shared = context.broadcast(sized_membership(weighed, "hash"))
    fields = [*[field(rows, k, k) for k in keys], *[T.StructField(n, T.LongType()) for n in ("hash", "times", "length")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            column = batch.column(len(keys)).to_pylist()
            length, at, word = np.zeros(len(column), np.int64), [], []
            for found in words_of([unpack.decompress(p).decode() for p in column] if packed else column):
                length += np.bincount(found.note, found.lengths, len(column)).astype(np.int64)
                use = np.flatnonzero(member(shared.value, found.hash))
                at.append(found.note[use])
                word.append(found.hash[use])
            if at:
                at, word = np.concatenate(at).astype(np.int64), np.concatenate(word)
                _, first, times = np.unique(_mixed(word ^ _codes(at)), return_index=True, return_counts=True)
                at = at[first]
                columns = [batch.column(i).take(pa.array(at)) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*columns, int64(word[first]), pa.array(times.astype(np.int64)), pa.array(length[at])], names=[f.name for f in fields])

    # Copies of a note give the same rows.
    known = map_arrow(rows.select(*keys, text), run, fields).distinct().join(weighed, "hash")
    return known.groupBy(*keys).agg((F.sum(ratio * F.col("times")) / F.pow(F.max("length").cast("double"), F.lit(POWER))).alias("x"))


def has_letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_hash"), F.xxhash64(F.lit(1), text).alias("_other")]


def labelled_texts(notes: DataFrame, marks: DataFrame, id_col: str, text: str, label: str) -> DataFrame:
    """``(_hash, _other, packed, letters, label, fold)``: texts, compressed, of the notes that ``marks (id_col, label)`` covers.

    Marks other than 0 and 1 are left out; several marks of an id count as the highest.  Texts whose id may be
    marked, by a bit map, are sent to a merge join; other columns and texts stay where they are.
    """
    marked = reliable_checkpoint(
        marks.where(F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    kept = notes.sparkSession.sparkContext.broadcast(sized_membership(marked.select(F.xxhash64("_id").alias("h")), "h"))
    given = notes.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    given = given.select("_id", F.xxhash64("_id").alias("h"), *_keys(F.col("text")), has_letters(F.col("text")).alias("letters"), F.col("text").cast("binary").alias("packed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            few = batch.filter(pa.array(member(kept.value, numbers(batch, "h"))))
            packed = pa.array([pack.compress(t) for t in few.column("packed").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*few.columns[:-1], packed], names=few.schema.names)

    joined = map_arrow(given, run, given.schema).join(marked.hint("merge"), "_id")
    return joined.select("_hash", "_other", "packed", "letters", "label", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"))


def _curve(steps: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through a histogram, by Newton's method with a small ridge."""
    x = np.stack([steps, np.ones_like(steps)], axis=1)
    weights = np.zeros(2)
    scale = np.array([1e-4, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -50, 50)))
        gradient = x.T @ (n1 - (n0 + n1) * p) - scale * weights
        step = np.linalg.solve((x.T * ((n0 + n1) * p * (1 - p))) @ x + np.diag(scale), gradient)
        step *= min(1.0, 50 / max(abs(step).max(), 1e-9))
        weights += step
        if abs(step).max() < 1e-8:
            break
    return float(max(weights[0], 0.0)), float(weights[1])


def fit_toxicity(notes: DataFrame, marks: DataFrame, id_col: str = "event_id", text: str = "note", label: str = "toxic") -> ToxicityModel:
    """Learn from every note whose id ``marks`` labels 0 or 1; other columns of both are not read and may have any name.

    Null texts are empty; notes with null ids and marks of absent notes do nothing; copies of a note count
    each.  Without labels of both classes, or where no n-gram passes its discount, the model gives every note
    the share of toxic labels (0 without any).
    """
    rows = reliable_checkpoint(labelled_texts(notes, marks, id_col, text, label))
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = ToxicityModel(None, None, 0.0, 0.0, n.get(1, 0) / sum(n.values()) if n else 0.0)
    if len(n) < 2:
        return model
    model.ratios = reliable_checkpoint(gram_ratios(reliable_checkpoint(_word_counts(rows))))
    model.kept = sized_membership(model.ratios, "gram")
    ratio = F.element_at(F.array(*RATIOS[1:]), F.col("fold") + 1)
    keys = ["_hash", "_other", "label", "fold"]
    sums = _sums(rows, "packed", keys, model, ratio, packed=True)
    place = F.round(F.greatest(F.least(F.coalesce("x", F.lit(0.0)), F.lit(LIMIT)), F.lit(-LIMIT)) / STEP).cast("int").alias("step")
    histogram = (
        rows.where("letters").select(*keys).join(sums, keys, "left").groupBy(place)
        .agg(F.sum(1 - F.col("label")).alias("n0"), F.sum("label").alias("n1")).orderBy("step").toArrow()
    )
    steps, n0, n1 = (histogram.column(c).to_numpy().astype(float) for c in ("step", "n0", "n1"))
    if n0.sum() and n1.sum():
        model.slope, model.intercept = _curve(steps * STEP, n0, n1)
    return model


def toxicity_scores(notes: DataFrame, model: ToxicityModel, text: str = "note", keep: list[str] | None = None) -> DataFrame:
    """``score`` from 0 to 1 of every note, with the columns ``keep`` as given (all without ``keep``) in a struct ``row``.

    Notes without letters get the share of toxic labels.  Notes are joined to their sums by two hashes of
    their text; only ``keep`` moves, so leave the text out of it at scale.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in (notes.columns if keep is None else keep)]).alias("row")
    rows = notes.select(row, has_letters(F.col(text)).alias("_letters"), *_keys(F.coalesce(F.col(text), F.lit(""))))
    if not model.slope:
        return rows.select("row", F.lit(model.prior).alias("score"))
    sums = reliable_checkpoint(text_sums(notes, model, text))
    return rows.join(sums, ["_hash", "_other"], "left").select("row", _score(F.col("x"), F.col("_letters"), model).alias("score"))


def text_sums(notes: DataFrame, model: ToxicityModel, text: str) -> DataFrame:
    """``(_hash, _other, x)`` of the different texts that hold a word that weighs."""
    given = notes.select(F.coalesce(F.col(text), F.lit("")).alias("_text")).select("_text", *_keys(F.col("_text")))
    return _sums(given, "_text", ["_hash", "_other"], model, F.col("r0"))


def _score(x: Column, letters: Column, model: ToxicityModel) -> Column:
    place = F.lit(model.slope) * F.coalesce(x, F.lit(0.0)) + F.lit(model.intercept)
    return F.when(letters, 1 / (1 + F.exp(-F.greatest(F.least(place, F.lit(50.0)), F.lit(-50.0))))).otherwise(model.prior)


def without_toxic(notes: DataFrame, model: ToxicityModel, text: str = "note", limit: float = 0.5) -> DataFrame:
    """The notes scored below ``limit``, their columns unchanged; notes without letters stay, and all without a fitted model.

    A note that scores at least ``limit`` by the curve's intercept alone goes too.  Only notes whose text may
    have a high sum, by a bit map, are sent to the join that decides; all others stay where they are.
    """
    if not model.slope:
        return notes
    letters = F.when(F.lit(True), has_letters(F.col(text)))
    scored = reliable_checkpoint(text_sums(notes, model, text).withColumn("score", _score(F.col("x"), F.lit(True), model)))
    plain = 1 / (1 + math.exp(-max(min(model.intercept, 50.0), -50.0)))
    # Texts whose verdict differs from that of texts without a sum.
    other = scored.where((F.col("score") >= limit) if plain < limit else (F.col("score") < limit)).select("_hash", "_other")
    low = (1 << (MARKED - 6)) - 1
    block = F.col("_hash").bitwiseAND(F.lit(low))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned("_hash", MARKED - 6).bitwiseAND(F.lit(63)).cast("int"))
    marked = reliable_checkpoint(other.groupBy(block.alias("_block")).agg(F.bit_or(bit).alias("_word")))
    rows = notes.select(F.struct("*").alias("row"), letters.alias("_letters"), *_keys(F.coalesce(F.col(text), F.lit(""))))
    maybe = F.coalesce(F.col("_word").bitwiseAND(bit) != 0, F.lit(False)).alias("_maybe")
    # At most 2 ** (MARKED - 6) rows of two numbers are broadcast.
    told = rows.withColumn("_block", block).join(F.broadcast(marked), "_block", "left").select("row", "_letters", "_hash", "_other", maybe)
    calm = told.where(F.lit(plain < limit) | ~F.col("_letters")).where(~F.col("_maybe") | ~F.col("_letters"))
    unsure = told.where("_maybe AND _letters").join(other, ["_hash", "_other"], "left_anti" if plain < limit else "left_semi")
    return calm.select("row").unionAll(unsure.select("row")).select("row.*")


by_value(__name__)
