"""Toxicity and language models: held-out accuracy, smoothing, and defined answers for odd rows."""

import os
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard

from sightline.llm.languages import SLOTS, LanguageModel, fit_languages, language_mixtures, trigram_slots
from sightline.llm import toxicity
from sightline.llm.toxicity import fit_toxicity, toxicity_scores, without_toxic

BAD = ["wretch", "vermin", "dolt"]
WORDS = {
    "en": ["the", "radar", "image", "shows", "a", "wide", "field", "with", "river", "change", "near", "bridge"],
    "de": ["der", "schatten", "zeigt", "einen", "weiten", "acker", "mit", "fluss", "und", "brücke", "nahe", "über"],
    "fr": ["la", "rivière", "montre", "un", "champ", "près", "du", "pont", "avec", "une", "forêt", "été"],
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def notes():
    rng = random.Random(4)
    rows = []
    for i in range(600):
        words = sentence(rng, rng.choice(list(WORDS)), rng.randint(5, 60)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(1 + len(words) // 15):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), int(toxic), i))
    return rows


def test_toxic_notes_are_told_apart(spark, notes):
    frame = spark.createDataFrame(notes, "event_id BIGINT, note STRING, toxic INT, score INT")
    model = fit_toxicity(frame.where("event_id % 5 <> 0"), frame)
    scored = toxicity_scores(frame, model)
    assert scored.columns == ["row", "score"]
    held = [(r["row"]["toxic"], r["score"] >= 0.5) for r in scored.collect() if r["row"]["event_id"] % 5 == 0]
    assert sum(t == p for t, p in held) >= 0.97 * len(held) and len(held) == 120
    assert all(p for t, p in held if t)


def test_odd_notes_have_defined_scores(spark, notes):
    schema = "event_id BIGINT, note STRING, toxic INT"
    rows = [r[:3] for r in notes] + [(1007, None, None), (1008, None, 1), (1009, "", 0), (1010, "x", 5), (None, "wretch", 1)]
    frame = spark.createDataFrame(rows, schema)
    model = fit_toxicity(frame, frame.unionAll(spark.createDataFrame([(1008, None, 0), (2000, None, 1)], schema)))
    odd = [(1, None), (2, ""), (3, "... 12 !"), (4, "a " * 700_000), (1, None), (None, "wretch vermin"), (5, "the field"), (5, "the field")]
    odd = spark.createDataFrame([(*r, 1, 2, 3) for r in odd], "event_id BIGINT, note STRING, _hash INT, x INT, `a.b` INT")
    got = [(r["row"]["event_id"], r["score"]) for r in toxicity_scores(odd, model).collect()]
    assert len(got) == 8 and all(0 <= s <= 1 for _, s in got)
    prior = {s for i, s in got if i in (1, 2, 3)}
    assert len(prior) == 1 and 0.1 < prior.pop() < 0.25
    assert dict(got)[None] > 0.5 > dict(got)[5]
    assert toxicity_scores(odd.limit(0), model).count() == 0
    calm = without_toxic(odd, model)
    assert calm.columns == odd.columns
    assert sorted(str(r["event_id"]) for r in calm.collect()) == sorted(str(i) for i, s in got if s < 0.5 or i in (1, 2, 3))


def test_models_without_labels_of_both_classes(spark):
    schema = "event_id BIGINT, note STRING, toxic INT"
    for rows, want in (([], 0.0), ([(1, "calm", 0)], 0.0), ([(1, "bad", 1)], 1.0)):
        frame = spark.createDataFrame(rows, schema)
        scored = toxicity_scores(spark.createDataFrame([(5, "any words")], "event_id BIGINT, note STRING"), fit_toxicity(frame, frame))
        assert [r["score"] for r in scored.collect()] == [want]
    frame = spark.createDataFrame([(i, "same words", i % 2) for i in range(9)], schema)
    assert {r["score"] for r in toxicity_scores(frame, fit_toxicity(frame, frame)).collect()} == {4 / 9}


def plain_ratios(rows, folds):
    """{n-gram: log-ratio} of those above their discount, from (note, label, fold), counting the given folds."""
    counts, totals = Counter(), [0, 0]
    for note, label, fold in rows:
        for word in set(plain_words(note)) if fold in folds else ():
            totals[label] += 1
            counts.update((g, label) for g in {f" {word} "[i : i + n] for n in range(4, 9) for i in range(len(word) + 3 - n)})
    known, out = {}, {}
    for g in sorted({g for g, _ in counts}, key=len):
        n, both = [counts[g, c] for c in (0, 1)], counts[g, 0] + counts[g, 1]
        before = known.get(g[1:], (1.0, 1.0))
        share = both / sum(totals)
        left = [n[c] - 1.5 * totals[c] * share * before[c] - 3 * (totals[c] * share * before[c] + 1) ** 0.5 for c in (0, 1)]
        known[g] = tuple(max(left[c], 0) / totals[c] / share + before[c] for c in (0, 1))
        if known[g] != before:
            out[g] = np.log(known[g][1] / known[g][0])
    return out


def plain_words(note):
    return re.findall(r"[^\W\d_]+", (note or "").lower())


def test_scores_against_a_plain_model(spark, notes, monkeypatch):
    """Ratios of n-grams, the sums of all notes and the order of scores, all of one and of several words."""
    monkeypatch.setattr(toxicity, "LEAST", 1)
    rows = notes[:300] + [(900 + i, f"{w} {w} field", 1, 0) for i, w in enumerate(["dolts", "vermin", "wretchedly"] * 3)]
    frame = spark.createDataFrame(rows, "event_id BIGINT, note STRING, toxic INT, score INT")
    labelled = toxicity.labelled_texts(frame, frame, "event_id", "note", "toxic")
    told = [(zstandard.ZstdDecompressor().decompress(r["packed"]).decode(), r["label"], r["fold"]) for r in labelled.collect()]
    assert sorted(t[:2] for t in told) == sorted((r[1], r[2]) for r in rows)
    words = toxicity._word_counts(labelled)
    kept = Counter({r["word"]: sum(r[s] for s in toxicity.SLOTS) for r in words.collect()})
    assert kept == Counter(w for _, n, *_ in rows for w in set(plain_words(n)))
    found = toxicity.gram_ratios(words).collect()
    for v, folds in enumerate([{0, 1, 2, 3}, {1, 2, 3}]):
        want = plain_ratios(told, folds)
        nonzero = sorted(x for x in want.values() if abs(x) > 1e-12)
        # n-grams without toxic contexts are backoff, by rule
        assert sorted(r[f"r{v}"] for r in found if r[f"r{v}"] > 1e-12) == pytest.approx([x for x in nonzero if x > 0], rel=1e-9)
    want = plain_ratios(told, {0, 1, 2, 3})
    model = fit_toxicity(frame, frame)
    got = {r["_hash"]: r["x"] for r in toxicity.text_sums(frame, model, "note").collect()}
    keys = {r["event_id"]: r["h"] for r in frame.selectExpr("event_id", "xxhash64(note) h").collect()}
    for i, note, *_ in rows:
        total = 0.0
        for word in plain_words(note):
            word = f" {word} "
            for end in range(4, len(word) + 1):
                longest = [n for n in range(4, 9) if n <= end and want.get(word[end - n : end], 0) > 0]
                total += want[word[end - max(longest) : end]] if longest else 0.0
        length = sum(len(w) + 1 for w in plain_words(note))
        assert got.get(keys[i], 0.0) == pytest.approx(total / length**0.8, abs=1e-9)


def test_words_do_not_depend_on_how_a_text_is_cut(monkeypatch):
    from sightline.llm import languages

    texts = ["Über,  den -- Fluß: 12 x größer\n" * 40, None, "", "one two", "12", "three"]
    whole = [(w.note[i], w.word(i), w.hash[i], w.lengths[i]) for w in toxicity.words_of(texts) for i in range(len(w.hash))]
    slots = np.concatenate(list(trigram_slots(texts[0])))
    assert [(n, t) for n, t, _, _ in whole] == [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\W\d_]+", (t or "").lower())]
    monkeypatch.setattr(toxicity, "CHARS", 11)
    monkeypatch.setattr(languages, "CHARS", 7)
    assert whole == [(w.note[i], w.word(i), w.hash[i], w.lengths[i]) for w in toxicity.words_of(texts) for i in range(len(w.hash))]
    assert (slots == np.concatenate(list(trigram_slots(texts[0])))).all()


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(8)
    return [(i, sentence(rng, lang, rng.randint(3, 50)), lang, 0.5) for i, lang in enumerate(list(WORDS) * 80)]


def test_languages_of_held_out_statements(spark, spoken):
    frame = spark.createDataFrame(spoken, "observation_id BIGINT, statement STRING, lang STRING, score DOUBLE")
    model = fit_languages(frame.where("observation_id % 4 <> 2"))
    got = {r["observation_id"]: r for r in language_mixtures(frame, model).collect()}
    held = [got[i]["lang_pred"] == lang for i, _, lang, _ in spoken if i % 4 == 2]
    assert sum(held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_mixtures_have_both_languages(spark, spoken):
    rng = random.Random(1)
    model = fit_languages(spark.createDataFrame(spoken, "observation_id BIGINT, statement STRING, lang STRING, score DOUBLE"))
    two = model.mixture(sentence(rng, "en", 300) + " " + sentence(rng, "de", 100))
    assert set(two) == {"en", "de"} and 0.6 < two["en"] < 0.9
    assert set(model.mixture(sentence(rng, "fr", 100))) == {"fr"}


def test_odd_statements_are_undetermined(spark, spoken):
    model = fit_languages(spark.createDataFrame([*spoken, (1, None, "en", 0.1), (2, "x", None, 0.1)], "observation_id BIGINT, statement STRING, lang STRING, score DOUBLE"))
    odd = [(1, None), (2, ""), (3, "12 ... !"), (None, "der fluss"), (4, "the radar " * 200_000), (1, None)]
    frame = spark.createDataFrame(odd, "observation_id BIGINT, statement STRING")
    got = Counter((r["observation_id"], r["lang_pred"]) for r in language_mixtures(frame, model).collect())
    assert got == {(1, "und"): 2, (2, "und"): 1, (3, "und"): 1, (None, "de"): 1, (4, "en"): 1}
    nothing = fit_languages(frame.limit(0).selectExpr("*", "'en' AS lang"))
    assert nothing.mixture("der fluss") == {} and language_mixtures(frame.limit(0), model).count() == 0


def test_expectation_maximisation_never_lowers_the_likelihood():
    from sightline.llm import languages

    rng = np.random.default_rng(2)
    model = LanguageModel(["a", "b", "c"], rng.poisson(3, (3, 1 << SLOTS)))
    chances, counts = model.chances[:500], rng.poisson(2, 500) + 1.0
    fits = []
    for rounds in (0, 1, 2, 5, 30):
        languages.ROUNDS, kept = rounds, languages.ROUNDS
        try:
            fits.append(languages._fit(chances, counts)[1])
        finally:
            languages.ROUNDS = kept
    assert fits == sorted(fits)


def test_toxic_compounds_are_found_in_each_language(spark):
    """Toxic notes hold words that begin with one compound of the syllables that all words are made of."""
    rng = random.Random(12)
    syllables = {"it": ["ba", "co", "di", "fu"], "fr": ["bé", "çà", "dê", "fô"], "ru": ["ба", "ко", "ди", "фу"]}
    rows = []
    for i in range(900):
        lang = list(syllables)[i % 3]
        bad = "".join(syllables[lang])
        words = ["".join(rng.choices(syllables[lang], k=rng.randint(2, 6))) for _ in range(rng.randint(20, 90))]
        words = [w for w in words if bad not in w]
        toxic = i // 3 % 5 == 0
        if toxic:
            for _ in range(1 + len(words) // 15):
                words.insert(rng.randrange(len(words)), bad + "".join(rng.choices(syllables[lang], k=2)))
        rows.append((i, " ".join(words), int(toxic), lang))
    frame = spark.createDataFrame(rows, "event_id BIGINT, note STRING, toxic INT, lang STRING")
    scored = toxicity_scores(frame, fit_toxicity(frame.where("event_id % 4 <> 0"), frame)).collect()
    for lang in syllables:
        held = [(r["row"]["toxic"], r["score"] >= 0.5) for r in scored if r["row"]["lang"] == lang and r["row"]["event_id"] % 4 == 0]
        assert sum(t for t, _ in held) >= 10
        assert sum(p for t, p in held if t) >= 0.9 * sum(t for t, _ in held) and sum(p for t, p in held if not t) <= 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver tables")
def test_held_out_toxic_documents(spark):
    from pyspark.sql import functions as F

    from sightline.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic IS NOT NULL")
    rows = QUERIES["op10_toxicity"](spark, folder).where("held_out").join(labels, "doc_id").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    assert len(toxic) >= 5 and sum(toxic) >= 0.6 * len(toxic)
    assert sum(r["predicted"] for r in rows if not r["toxic"]) <= 0.02 * len(rows)


def test_counts_are_added_without_copies():
    """A task that adds up n-gram counts holds them and their sums, not several copies of either."""
    import tracemalloc

    import numpy as np

    from sightline.llm.toxicity import _added

    keys = np.arange(200_000, dtype=np.uint64) % np.uint64(150_000)
    parts = [(keys, np.ones((len(keys), 8), np.int64)) for _ in range(2)]
    tracemalloc.start()
    key, counts = _added(parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(key) == 150_000 and counts.sum() == 8 * 400_000 and counts[0].tolist() == [4] * 8 and counts[-1].tolist() == [2] * 8
    assert peak < 1.5 * sum(c.nbytes for _, c in parts)


def test_tasks_get_long_texts_in_small_batches(spark):
    """By rows alone a batch would hold all 60 texts, 24 MB, in the executor and in its Python worker at once."""
    import pyarrow as pa

    from sightline.session import tune

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    texts = tune(spark).range(0, 60, 1, 1).selectExpr("repeat(concat(id, ' '), 400000 div length(concat(id, ' '))) t")
    got = texts.mapInArrow(sizes, "rows BIGINT, bytes BIGINT").collect()
    assert sum(r["rows"] for r in got) == 60 and max(r["bytes"] for r in got) <= 5_000_000


def test_words_are_counted_whole_when_little_is_held(spark, notes, monkeypatch):
    """Words added up, named and looked at in many small parts are the same words and counts."""
    for name, value in (("HELD", 12), ("WAITING", 3), ("CHARS", 64), ("REMEMBERED", 4)):
        monkeypatch.setattr(toxicity, name, value)
    frame = spark.createDataFrame(notes, "event_id BIGINT, note STRING, toxic INT, score INT")
    counted = toxicity._word_counts(toxicity.labelled_texts(frame, frame, "event_id", "note", "toxic")).collect()
    got = {r["word"]: (sum(r[f"n0_{f}"] for f in range(4)), sum(r[f"n1_{f}"] for f in range(4))) for r in counted}
    want = {}
    for _, note, label, _ in notes:
        for word in set(plain_words(note)):
            want.setdefault(word, [0, 0])[label] += 1
    assert got == {w: tuple(n) for w, n in want.items()}
    every = np.full(1 << 14, np.uint64(2**64 - 1))
    told = [r["word"] for r in toxicity._words_with(frame.select("note"), every, False).collect()]
    assert sorted(told) == sorted(w for w in want if len(w) > 1)


def test_ngrams_of_either_class_weigh(spark):
    """With classes about as large as each other, n-grams that only ordinary notes have are above their discount too."""
    rng = random.Random(9)
    rows = []
    for i in range(1600):
        some = [rng.choice(WORDS["en"]) for _ in range(2)]
        rows.append((i, " ".join([*some, "dolts" if i % 2 else "harvest"]), i % 2))
    frame = spark.createDataFrame(rows, "event_id BIGINT, note STRING, toxic INT")
    labelled = toxicity.labelled_texts(frame, frame, "event_id", "note", "toxic")
    told = [(zstandard.ZstdDecompressor().decompress(r["packed"]).decode(), r["label"], r["fold"]) for r in labelled.collect()]
    found = toxicity.gram_ratios(toxicity._word_counts(labelled)).collect()
    for v, folds in enumerate([{0, 1, 2, 3}, {1, 2, 3}]):
        want = sorted(plain_ratios(told, folds).values())
        assert want[0] < -0.1 and want[-1] > 0.1
        assert sorted(r[f"r{v}"] for r in found if abs(r[f"r{v}"]) > 1e-12) == pytest.approx([x for x in want if abs(x) > 1e-12], rel=1e-9)


def test_counts_too_small_for_any_discount_change_no_ratio(spark, notes, monkeypatch):
    """Leaving such n-grams out of the joins gives the very ratios of all n-grams."""
    frame = spark.createDataFrame(notes, "event_id BIGINT, note STRING, toxic INT, score INT")
    words = toxicity._word_counts(toxicity.labelled_texts(frame, frame, "event_id", "note", "toxic"))
    few = sorted(map(tuple, toxicity.gram_ratios(words).collect()))
    monkeypatch.setattr(toxicity, "LEAST", 0)
    assert few and few == sorted(map(tuple, toxicity.gram_ratios(words).collect()))
