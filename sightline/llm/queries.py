"""The operators of this subpackage over the driver tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.session import tune, working_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(tune(spark), folder.rstrip("/"))

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def statements(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as observation statements."""
    return table(spark, folder, "documents").select(F.col("doc_id").alias("observation_id"), F.col("text").alias("statement"), "lang", F.col("source").alias("provider"))


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from sightline.llm.simhash import simhash_groups

    groups = simhash_groups(statements(spark, folder))
    return groups.select(F.col("observation_id").alias("doc_id"), "fingerprint", "component_id")


@query
def op5_repeats(spark: SparkSession, folder: str) -> DataFrame:
    from sightline.llm.repeats import without_repeats

    cut = without_repeats(statements(spark, folder).select("observation_id", "statement"))
    return cut.select(
        F.col("row.observation_id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


WORDS = r"[^\x20\x09-\x0D]+"


@query
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from sightline.llm.mixing import mixing_plan

    plan = mixing_plan(statements(spark, folder), F.regexp_count("statement", F.lit(WORDS)), "observation_id")
    first, last = F.get("positions", F.lit(0)), F.get("positions", F.size("positions") - 1)
    placed = plan.select(
        F.col("observation_id").alias("doc_id"), "size", "source_size", "target", "taken",
        F.bround(first, 6).alias("first_position"), F.bround(last, 6).alias("last_position"),
    )
    # Documents that are not taken share an empty position; the id spreads them.
    return placed.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


ORACLES["op6_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(CAST(doc_id AS VARCHAR)) AS place FROM documents
), totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM totals
), placed AS (SELECT *, row_number() OVER (ORDER BY source_size * 3e0 / weight, source NULLS LAST) AS spot FROM weighed
), shared AS (
  SELECT *, source_size * 3e0 / weight AS ratio,
    CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / CAST(sum(weight) OVER (ORDER BY spot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS share
  FROM placed
), aimed AS (
  SELECT source, source_size, weight, CASE WHEN source_size > 0 THEN
    least(source_size * 3e0, (SELECT arg_min(share, spot) FROM shared WHERE ratio >= share) * weight) ELSE 0e0 END AS target
  FROM shared
), ordered AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place NULLS FIRST, doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized
)
SELECT doc_id, size, source_size, target, passes * size AS taken,
  CASE WHEN passes > 0 THEN round_even(least(greatest(CASE
    WHEN weight = 5 THEN 1.5e0 - sqrt(greatest(2.25e0 - 2e0 * start, 0e0)) WHEN weight = 2 THEN start
    WHEN start <= 0.375e0 THEN sqrt(0.25e0 + 2e0 * start) - 0.5e0 ELSE sqrt(1e0 + 2e0 * (start - 0.375e0)) - 0.5e0 END, 0e0), 1e0), 6) END AS first_position,
  CASE WHEN passes > 0 THEN round_even(least(greatest(CASE
    WHEN weight = 5 THEN 1.5e0 - sqrt(greatest(2.25e0 - 2e0 * final, 0e0)) WHEN weight = 2 THEN final
    WHEN final <= 0.375e0 THEN sqrt(0.25e0 + 2e0 * final) - 0.5e0 ELSE sqrt(1e0 + 2e0 * (final - 0.375e0)) - 0.5e0 END, 0e0), 1e0), 6) END AS last_position
FROM (SELECT *, CASE WHEN passes > 0 THEN before / target END AS start,
    CASE WHEN passes > 0 THEN ((passes - 1) * source_size + before) / target END AS final FROM (
  SELECT doc_id, size, source_size, target, weight, CAST(before AS DOUBLE) AS before, CASE WHEN size = 0 THEN 0 ELSE
    CAST(greatest(least(floor((2 * target - CAST(2 * before + size AS DOUBLE)) / CAST(2 * source_size AS DOUBLE)) + 1, 3), 0) AS BIGINT) END AS passes
  FROM ordered o JOIN aimed a ON o.source IS NOT DISTINCT FROM a.source) p) q
"""


@query
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from sightline.llm.packing import packed, token_pieces

    pieces = token_pieces(statements(spark, folder), public_tokenizers.path("word_bpe_49k.json"))
    return packed(pieces).select(
        F.col("observation_id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from sightline.llm.toxicity import fit_toxicity, toxicity_scores

    notes = table(spark, folder, "documents").select(F.col("doc_id").alias("event_id"), F.col("text").alias("note"))
    fold = F.coalesce(F.crc32(F.col("event_id").cast("string").cast("binary")) % 5, F.lit(1))
    marks = table(spark, folder, "labels").select(F.col("doc_id").alias("event_id"), "toxic")
    model = fit_toxicity(notes.where(fold != 0), marks)
    scored = toxicity_scores(notes.withColumn("held_out", fold == 0), model, keep=["event_id", "held_out"])
    return scored.select(
        F.col("row.event_id").alias("doc_id"), "row.held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    from sightline.llm.quality import quality_verdicts

    return quality_verdicts(statements(spark, folder)).drop("distance").withColumnRenamed("observation_id", "doc_id")


@query
def op7_vectors(spark: SparkSession, folder: str) -> DataFrame:
    from sightline.llm.vectors import vector_links

    found = vector_links(
        table(spark, folder, "embeddings").select(F.col("vec_id").alias("candidate_id"), F.col("embedding").alias("score_components"))
    )
    return found.select(F.col("candidate_id").alias("vec_id"), "n_links", "component_id", "kept")


@query
def op8_links(spark: SparkSession, folder: str) -> DataFrame:
    from sightline.llm.hrefs import LABELS, href_verdicts

    pages = table(spark, folder, "pages").select("page_id", F.col("url").alias("href"))
    judged = href_verdicts(pages)
    # ``rule`` names the fixed rules only; what the label patterns decide shows in ``verdict`` and ``pattern``.
    by_label = F.col("rule").isin(*LABELS)
    return judged.select(
        "page_id", F.col("link_host").alias("host"), F.col("link_path").alias("path"),
        F.when(~by_label, F.col("rule")).alias("rule"), "verdict", F.when(by_label, F.col("rule")).alias("pattern"),
    )


ORACLES["op8_links"] = """
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(host_end, path_start, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT page_id, host, path, max_by(host_end || path_start, length(host_end) + length(path_start)) AS rule,
    max_by(verdict, length(host_end) + length(path_start)) AS verdict
  FROM parts JOIN rules ON (host = host_end OR ends_with(host, '.' || host_end)) AND starts_with(path, path_start)
  GROUP BY ALL
), labels(label) AS (VALUES ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm'), ('ads-track')
), labelled AS (
  SELECT page_id, host, path, arg_min(label, (-length(label), label)) AS label
  FROM parts JOIN labels ON contains('.' || host || '.', '.' || label || '.')
  GROUP BY ALL
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN l.label IS NOT NULL THEN 'block' END, 'allow') AS verdict,
  CASE WHEN f.rule IS NULL THEN l.label END AS pattern
FROM parts p
LEFT JOIN fits f ON p.page_id = f.page_id AND p.host = f.host AND p.path = f.path
LEFT JOIN labelled l ON p.page_id = l.page_id AND p.host = l.host AND p.path = l.path
"""


@query
def op1_dialogues(spark: SparkSession, folder: str) -> DataFrame:
    from sightline.llm.dialogues import dialogue_digests, format_turns, read_turns, text_part

    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    turns = turns.select(F.col("conv_id").alias("candidate_id"), F.col("turn").alias("seq"), "role", text_part(F.col("text")).alias("parts"))
    return dialogue_digests(read_turns(format_turns(turns))).withColumnRenamed("candidate_id", "conv_id")


@query
def op4_languages(spark: SparkSession, folder: str) -> DataFrame:
    from sightline.llm.languages import fit_languages, language_mixtures

    rows = statements(spark, folder)
    held_out = F.coalesce(F.crc32(F.col("observation_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit_languages(rows.where(~held_out))
    return language_mixtures(rows, model).select(
        F.col("observation_id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score"
    )


@query
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    from sightline.llm.whitening import whitened_vectors

    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("candidate_id"), F.col("embedding").alias("score_components"))
    return whitened_vectors(vectors).select(
        F.col("candidate_id").alias("vec_id"), "component", "n", F.col("deviation").try_cast("bigint").alias("deviation"),
        "whitened", "explained", "identity_error",
    )


@query
def op12_infill(spark: SparkSession, folder: str) -> DataFrame:
    from sightline.llm.infill import infill_digests, infill_pieces

    pieces = infill_pieces(statements(spark, folder).select("observation_id", "statement"))
    return infill_digests(pieces).withColumnRenamed("observation_id", "doc_id")


@query
def op13_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from sightline.llm.tokens import read_token_files, write_token_files

    files = working_folder(spark, "token-files")
    write_token_files(statements(spark, folder).select("observation_id", "statement"), files, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, files).withColumnRenamed("id", "doc_id")
