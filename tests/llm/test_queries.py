"""The registered queries over the driver tables: contract columns, SQL twins, plain counts."""

import hashlib
import os
import zlib
from collections import defaultdict

import brute
import duckdb
import pytest

from sightline.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_dialogues": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op2_simhash": "doc_id fingerprint component_id",
    "op3_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4_languages": "doc_id held_out lang_pred score",
    "op5_repeats": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op6_mixing": "doc_id size source_size target taken first_position last_position",
    "op7_vectors": "vec_id n_links component_id kept",
    "op8_links": "page_id host path rule verdict",
    "op9_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op10_toxicity": "doc_id held_out score predicted",
    "op11_whitening": "vec_id component n deviation whitened explained identity_error",
    "op12_infill": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
    "op13_token_files": "doc_id start n_tokens ids_crc32",
}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver tables")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in ("documents", "pages", "conversations", "embeddings", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def results(spark):
    found = {}

    def get(name):
        if name not in found:
            found[name] = QUERIES[name](spark, FOLDER).collect()
        return found[name]

    return get


def test_every_operator_is_registered():
    assert sorted(QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(results, name):
    rows = results(name)
    assert rows and list(rows[0].asDict())[: len(COLUMNS[name].split())] == COLUMNS[name].split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(results, tables, name):
    answer = tables.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    want = sorted(tuple(str(v) for v in r) for r in answer.fetchall())
    assert sorted(tuple(str(r[n]) for n in names) for r in results(name)) == want


def test_documents_against_plain_versions(results, tables):
    rows = tables.execute("SELECT doc_id, text FROM documents").fetchall()
    assert sorted(map(tuple, results("op2_simhash"))) == sorted(brute.simhash_groups(rows))
    assert sorted(map(tuple, results("op5_repeats"))) == sorted(brute.without_repeats(rows))


def test_dialogues_against_plain_versions(results, tables):
    said = "</s>[INST] ok [/INST]"
    turns = defaultdict(list)
    for conv, turn, role, text in [*tables.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall(), (-7, 0, "user", said), (-7, 1, "assistant", said)]:
        turns[conv].append((turn, role or "", text or ""))
    got = {r["conv_id"]: r for r in results("op1_dialogues")}
    assert set(got) == set(turns)
    for conv, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, r, t in rows if r == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in rows).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_held_out_rows_are_marked(results):
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in results("op4_languages"))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in results("op10_toxicity"))
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in results("op10_toxicity"))


def test_held_out_languages(results, tables):
    lang = dict(tables.execute("SELECT doc_id, lang FROM documents").fetchall())
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in results("op4_languages") if r["held_out"]]
    assert sum(held) >= 0.95 * len(held)
