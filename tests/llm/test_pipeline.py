"""The corpus pipeline stage by stage against plain versions, and odd tables."""

import random

import brute
import pytest

import corpus_pipeline
from sightline.session import discard_tables, reliable_checkpoint, tables_written

DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
WORDS = ["radar", "image", "field", "river", "change", "bridge", "shadow", "wide", "near", "north", "slope", "water"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(7)
    passage = " ".join(rng.choices(WORDS, k=60))
    rows, labels = [], []
    for i in range(240):
        words = [w + str(rng.randrange(40)) for w in rng.choices(WORDS, k=rng.randint(20, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(["wretch", "vermin", "dolt"]))
        text = " ".join(words) + (("\n" + passage) if i % 10 == 3 else "")
        rows.append((i, text, "en", rng.choice(["hot", "hot", "a", None]), len(text)))
        labels.append((i, 1, int(toxic)))
    for i in range(20):
        rows.append((500 + i, rows[7][1] + (" x" if i % 2 else ""), "en", "hot", 1))
    rows += [(600, None, None, None, None), (601, "", "", "", 0), (None, "no id here at all", "en", "a", 3), (602, "word " * 30_000, "en", "a", 1), (1, *rows[1][1:])]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages_do_their_work(spark, folder, tmp_path):
    docs, states = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, work) in enumerate(corpus_pipeline.STAGES):
        states.append(docs.collect())
        out = work(spark, docs, folder)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    raw, calm, single, cut, mixed = states
    left = {r["doc_id"] for r in calm}
    toxic = {i for i in range(0, 240, 6)}
    assert len(toxic & left) <= 2 and len(({r["doc_id"] for r in raw} - toxic) - left) <= 4
    rows, least = [(r["doc_id"], r["text"]) for r in calm], {}
    for (i, _), root in zip(rows, brute.near_groups(rows), strict=True):
        if i is not None:
            least[root] = min(i, least.get(root, i))
    assert sorted(r["doc_id"] for r in single if r["doc_id"] is not None) == sorted(least.values())
    kept = {r[0]: r for r in brute.without_repeats([(r["doc_id"], r["text"]) for r in single])}
    for r in cut:
        assert len((r["text"] or "").encode()) == kept[r["doc_id"]][1] - kept[r["doc_id"]][2]
    assert {r["doc_id"] for r in cut} == {r["doc_id"] for r in single}
    times = [(r["doc_id"], r["text"]) for r in mixed]
    assert set(times) <= {(r["doc_id"], r["text"]) for r in cut} and max(map(times.count, times)) <= 3
    from tokenizers import Tokenizer

    import public_tokenizers

    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = brute.pieces(times, lambda t: encoder.encode(t, add_special_tokens=False).ids)
    got = [tuple(r)[:5] for r in docs.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_run_gives_packed_pieces_and_reruns(spark, folder):
    first = corpus_pipeline.run(spark, folder).drop("sequence_id", "offset").collect()
    again = corpus_pipeline.run(spark, folder).drop("sequence_id", "offset").collect()
    assert first and sorted(map(str, first)) == sorted(map(str, again))


def test_an_empty_corpus(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_working_tables_can_be_deleted(spark):
    with tables_written() as paths:
        assert reliable_checkpoint(spark.range(5)).count() == 5
    assert len(paths) == 1 and discard_tables(spark, paths) == 1 and discard_tables(spark, paths) == 0


def test_queries_import_without_the_subpackage():
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("toxic", [1, None])
def test_documents_without_letters_stay_when_most_labels_are_toxic(spark, tmp_path, toxic):
    """Three in four labels are toxic, or all are and no model can be fitted."""
    rows = [(i, "wretch vermin dolt" if i % 4 else "wide radar field", "en", "a", 1) for i in range(80)]
    rows += [(100, None, "en", "a", 0), (101, "", "en", "a", 0), (102, "12 ... 7", "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    labels = [(i, 1, int(i % 4 > 0) if toxic else 1) for i in range(80)]
    spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT").write.parquet(str(tmp_path / "labels.parquet"))
    left = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert left >= {100, 101, 102} and left >= {i for i in range(80) if i % 4 == 0}
    assert len(left) == (83 if not toxic else 23)
