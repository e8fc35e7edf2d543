"""A training corpus from raw documents: toxic and repeated texts go, sources are mixed, sequences packed.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.mixing import curriculum
from sightline.llm.nearcopies import without_near_copies
from sightline.llm.packing import packed, token_pieces
from sightline.llm.queries import WORDS
from sightline.llm.repeats import without_repeats
from sightline.llm.toxicity import fit_toxicity, without_toxic
from sightline.session import checkpoint_folder, discard_tables, tables_written, tune

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Tables in the shared folder that the stage before wrote while it was put together.
_LEFT: list[str] = []


def stage(work):
    """A stage that first deletes the working tables of the one before, whose result has been written by then."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tune(spark)
        discard_tables(spark, _LEFT)
        _LEFT.clear()
        with tables_written() as written:
            kept = work(spark, docs, sf_dir.rstrip("/"))
        _LEFT.extend(written)
        return kept

    return run_stage


#: No SQL twin: trained scores, fingerprint links, tokens and packing are beyond SQL; see tests/llm.
ORACLE_SQL = None


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model trained on ``labels`` calls toxic go; those without letters stay, and all without a fitted model."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return without_toxic(docs.select(*COLUMNS), fit_toxicity(docs, labels, "doc_id", "text"), "text")


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays, that with the least ``doc_id``."""
    return without_near_copies(docs.select(*COLUMNS), "doc_id", "text")


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under repeated 200-byte strings go from the texts; a character that loses a byte goes whole."""
    cut = without_repeats(docs, "doc_id", "text")
    text = F.when(F.col("n_removed") > 0, F.col("text")).otherwise(F.col("row.text"))
    kept = cut.withColumn("text", valid_text(F.col("kept"))).withColumn("text", text)
    return kept.select(
        "row.doc_id", "text", "row.lang", "row.source",
        F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("row.n_chars")).alias("n_chars"),
    )


def valid_text(data):
    """UTF-8 bytes as a string without the bytes that a cut left incomplete."""
    return F.regexp_replace(F.make_valid_utf8(data.cast("string")), "�", "")


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole passes over documents so that sources meet their targets, in the order of the curriculum."""
    return curriculum(docs, F.regexp_count("text", F.lit(WORDS)), "doc_id", "source").select(*COLUMNS)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packed(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), "doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mixing_to_target_weights", mix_sources),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder, before = f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4().hex}", None
    for name, work in STAGES[:-1]:
        work(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            discard_tables(spark, [before])
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
