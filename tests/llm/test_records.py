"""Whitening, fill-in-the-middle forms and token files against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

import public_tokenizers
from sightline.llm.infill import MARKS, infill_digests, infill_pieces, infill_texts
from sightline.llm.queries import QUERIES
from sightline.llm.tokens import PlaneReader, PlaneWriter, from_planes, read_token_files, to_planes, token_manifest, write_token_files
from sightline.llm.whitening import jacobi_components, pivoted_cholesky, whitened_vectors
from sightline.session import working_folder

FOLDER = "/root/testdata/sf0.001"
VECTORS = "candidate_id BIGINT, score_components ARRAY<DOUBLE>"
STATEMENTS = "observation_id BIGINT, statement STRING"
BPE = public_tokenizers.path("word_bpe_49k.json")


def plain_whitening(rows, components=8, scale=1024, shift=100_000):
    """{(id, component): (n, deviation, whitened without sign, explained)} by numpy's eigenvalues."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(scale * c) + shift for c in v] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    z = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in x])
    values, units = np.linalg.eigh(z.T @ z / n)
    values, units = values[::-1], units[:, ::-1]
    out = {}
    for k in range(components):
        for (i, _), v, row in zip(good, x, z, strict=True):
            deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
            out[i, k + 1] = (n, deviation, abs(row @ units[:, k]) / math.sqrt(values[k]), values[k] / values.sum())
    return out


def same_whitening(got, want):
    assert {(r[0], r[1]) for r in got} == set(want)
    for r in got:
        n, deviation, whitened, explained = want[r[0], r[1]]
        assert (r[2], int(r[3])) == (n, deviation)
        assert abs(r[4]) == pytest.approx(whitened, abs=1e-7) and r[5] == pytest.approx(explained, rel=1e-9)
        assert 0 <= r[6] <= 1e-6


def test_factor_and_components():
    rng = np.random.default_rng(3)
    for width, rank in ((1, 1), (5, 5), (9, 4), (40, 40), (33, 7)):
        a = rng.standard_normal((width, rank)) * 10.0 ** rng.integers(-2, 3, rank)
        scatter = a @ a.T
        factor = pivoted_cholesky(scatter)
        assert factor.shape == (width, rank) and np.allclose(factor @ factor.T, scatter, atol=1e-13 * scatter.max())
        values, units = jacobi_components(factor)
        assert np.allclose(units.T @ units, np.eye(rank), atol=1e-12) and (np.diff(values) <= 0).all()
        assert np.allclose((units * values) @ units.T, scatter, atol=1e-13 * scatter.max())
    assert pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0) and jacobi_components(np.zeros((3, 0)))[1].shape == (3, 0)


def test_whitening_of_odd_tables(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.standard_normal(12) @ np.diag(range(1, 13))]) for i in range(300)]
    rows += [(400, rows[0][1]), (401, None), (402, []), (403, [1.0] * 11 + [None]), (404, [1.0] * 11 + [float("nan")])]
    rows += [(405, [float("inf")] + [0.0] * 11), (406, [1e300] + [0.0] * 11), (407, [0.5] * 3), (None, rows[1][1])]
    odd = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS + ", _id STRING, `a.b` INT").repartition(5)
    want = plain_whitening([r for r in rows if r[0] is None or r[0] < 401])
    same_whitening(whitened_vectors(odd).collect(), want)
    assert whitened_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitened_vectors(spark.createDataFrame([(1, [1.0, 2.0])] * 3, VECTORS)).count() == 0
    flat = whitened_vectors(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(4)], VECTORS)).collect()
    assert len(flat) == 4 and {r["component"] for r in flat} == {1} and flat[0]["explained"] == pytest.approx(1)
    large = spark.createDataFrame([(i, [i * 1e11, 1.0]) for i in range(40)], VECTORS)
    for r in whitened_vectors(large, components=1).collect():
        n, s = 40, sum(math.floor(1024 * i * 1e11) for i in range(40))
        assert int(r["deviation"]) == (n * math.floor(1024 * r["candidate_id"] * 1e11) - s) ** 2


def test_whitening_query(spark):
    found = QUERIES["op11_whitening"](spark, FOLDER)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert found.schema["deviation"].dataType.simpleString() == "bigint"
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()
    same_whitening(found.collect(), plain_whitening([tuple(r) for r in rows]))


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    form = "spm" if h[3] % 100 < 20 else "psm"
    if not text or h[2] % 100 >= 90 or any(m in text for m in MARKS.values()):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("units", [3, 2048])
def test_infill_forms(spark, units):
    rng = random.Random(11)
    kinds = ["a", "Zz", "é", "漢", "\n", " ", "<", "P>", "<P", "M", ">", "😀", "0", "[", "`", "{", "@"]
    rows = [(i, "".join(rng.choices(kinds, k=rng.randrange(60)))) for i in range(300)]
    rows += [(500, None), (501, ""), (502, "with <S> inside"), (None, "no id " * 9), (3, rows[3][1]), (504, "long words " * 40_000), (505, "x" * 300_000)]
    odd = spark.createDataFrame([(*r, 1, "n") for r in rows], STATEMENTS + ", row INT, `a.b` STRING").repartition(5)
    pieces = infill_pieces(odd, units=units)
    want = sorted(((i, *plain_infill(i, t)[:4], sha(plain_infill(i, t)[4]), sha(t)) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in infill_digests(pieces).collect()), key=str) == want
    texts = sorted(((r["observation_id"], r["form"], r["output"]) for r in infill_texts(pieces).collect()), key=str)
    assert texts == sorted(((i, plain_infill(i, t)[1], plain_infill(i, t)[4]) for i, t in rows), key=str)
    assert {f for _, f, _ in texts} == {"plain", "psm", "spm"}
    assert infill_digests(infill_pieces(odd.limit(0))).count() == 0


def test_infill_query(spark):
    found = QUERIES["op12_infill"](spark, FOLDER)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((i, *plain_infill(i, t)[:4], sha(plain_infill(i, t)[4]), sha(t)) for i, t in docs)
    assert sorted(tuple(r) for r in found.collect()) == want


@pytest.mark.parametrize("bits", [False, True])
def test_planes_and_back(bits):
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (7, 50_000), (4096, 2**32), (100, 1), (1000, 2**17)):
        ids = rng.integers(0, top, n, dtype=np.uint32)
        assert (from_planes(to_planes(ids, bits), n, bits) == ids).all()


def test_a_file_and_any_chunk_of_it(tmp_path):
    import pyarrow as pa
    from pyarrow import fs

    rng = np.random.default_rng(2)
    ids = np.r_[rng.integers(0, 50_000, 700), np.full(300, 9), rng.integers(0, 4, 333)].astype("<u4")
    with open(tmp_path / "x", "wb") as sink:
        writer = PlaneWriter(sink, block=256, planes="least")
        for part in np.array_split(ids, 11):
            writer.add(part)
        writer.close(pa.table({"id": [1], "start": [0], "n": [len(ids)]}))
    reader = PlaneReader(fs.LocalFileSystem().open_input_file(str(tmp_path / "x")))
    assert [c["n"] for c in reader.chunks] == [256] * 5 + [53] and {c["bits"] for c in reader.chunks} == {True, False}
    for k in (5, 0, 3):
        assert (reader.chunk(k) == ids[256 * k : 256 * k + 256]).all()
    (tmp_path / "y").write_bytes((tmp_path / "x").read_bytes()[:-1])
    with pytest.raises(ValueError):
        PlaneReader(fs.LocalFileSystem().open_input_file(str(tmp_path / "y")))


def plain_tokens(rows):
    from tokenizers import Tokenizer

    encoder, out, start = Tokenizer.from_file(BPE), [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark):
    rng = random.Random(4)
    rows = [(i * 7 % 1009, " ".join(rng.choices(["Radar", "image,", "été", "x", "shadow", "漢字", "12"], k=rng.randrange(40)))) for i in range(400)]
    rows += [(2000, None), (2001, ""), (None, "no id"), (2002, "very long " * 60_000), (2003, "end")]
    odd = spark.createDataFrame([(*r, 1, "n") for r in rows], STATEMENTS + ", ids INT, `a.b` STRING").repartition(5)
    folder = working_folder(spark, "tokens")
    manifest = write_token_files(odd, folder, BPE, block=1024).collect()
    want = plain_tokens(rows)
    assert sum(r["n_ids"] for r in manifest) == want[-1][1] + want[-1][2] and sum(r["n_statements"] for r in manifest) == len(rows)
    got = read_token_files(spark, folder, with_ids=True).collect()
    assert sorted(got, key=lambda r: r["start"]) and sorted((tuple(r)[:4] for r in got), key=lambda r: r[1]) == want
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
    same = spark.createDataFrame([(5, "one"), (5, "one"), (5, "other text")], STATEMENTS)
    folder = working_folder(spark, "tokens")
    write_token_files(same, folder, BPE)
    assert sorted(r["start"] for r in read_token_files(spark, folder).collect()) == [0, 2, 4]
    folder = working_folder(spark, "tokens")
    assert write_token_files(odd.limit(0), folder, BPE).count() == 0
    assert token_manifest(spark, folder).count() == 0 and read_token_files(spark, folder).count() == 0


def test_files_of_lost_attempts_are_not_read(spark):
    import os

    folder = working_folder(spark, "tokens")
    write_token_files(spark.createDataFrame([(1, "a b")], STATEMENTS), folder, BPE)
    path = folder.removeprefix("file:")
    with open(os.path.join(path, "000000-lost.planes"), "wb") as lost:
        lost.write(b"half a file")
    assert [tuple(r) for r in read_token_files(spark, folder).collect()] == plain_tokens([(1, "a b")])


def test_token_files_query(spark):
    found = QUERIES["op13_token_files"](spark, FOLDER)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[1]) == plain_tokens([tuple(r) for r in docs])
