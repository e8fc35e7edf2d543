"""Token ids of observation statements in files of bit planes, and their reader.

A file is a run of chunks and a tail.  A chunk holds ``BLOCK`` ids, the last one fewer, whatever statements
they belong to: the ids are transposed, either into 4 planes of bytes or into as many planes of bits as the
largest id has, and every plane is a zstandard frame of its own.  High planes are nearly constant and cost a
few bytes.  Which way a chunk went stands in its entry, so that ``planes="least"`` can take the smaller one
chunk by chunk; ids of prose are smaller as bytes.  The tail is an Arrow table of the
statements (id, ids before in the file, number of ids), an Arrow table of the chunks (their place, number of
ids, kind and bytes of each plane) and a footer with both places, so that a reader can fetch any chunk alone.

Files are written by Spark tasks, one per sorted partition, under names never used again.  What a task wrote
is told by a row of the manifest, a Parquet table that Spark commits; files of lost or repeated attempts have
no row and are never read.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import by_value, map_arrow
from sightline.llm.packing import _word_ids

MAGIC = b"SLPLANE1"
FOOTER = "<QQQ8s"
#: Ids of a chunk; a multiple of 8.
BLOCK = 1 << 16
LEVEL = 3
CHUNKS = pa.schema([("at", pa.uint64()), ("n", pa.uint32()), ("bits", pa.bool_()), ("sizes", pa.list_(pa.uint32()))])


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Byte planes, or as many bit planes as the largest id needs, lowest first."""
    ids = np.ascontiguousarray(ids, "<u4")
    if not bits:
        return [p.tobytes() for p in ids.view(np.uint8).reshape(-1, 4).T]
    spread = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return [np.packbits(spread[:, i]).tobytes() for i in range(int(ids.max(initial=0)).bit_length())]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The ids again."""
    if not bits:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").ravel()
    ids = np.zeros(n, np.uint32)
    for i, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype(np.uint32) << np.uint32(i)
    return ids.astype("<u4")


class PlaneWriter:
    """Writes one file; ids may come in any portions."""

    def __init__(self, sink, block: int = BLOCK, level: int = LEVEL, planes: str = "bytes") -> None:
        self.sink, self.block, self.frame = sink, block, zstandard.ZstdCompressor(level=level)
        self.ways = {"bytes": [False], "bits": [True], "least": [False, True]}[planes]
        self.at, self.n, self.held, self.pending = 0, 0, 0, []
        self.chunks: list[dict] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.held += len(ids)
        self.n += len(ids)
        if self.held >= self.block:
            whole = np.concatenate(self.pending)
            full = len(whole) // self.block * self.block
            for start in range(0, full, self.block):
                self._chunk(whole[start : start + self.block])
            self.pending, self.held = [whole[full:]], len(whole) - full

    def _chunk(self, ids: np.ndarray) -> None:
        ways = {bits: [self.frame.compress(p) for p in to_planes(ids, bits)] for bits in self.ways}
        bits = min(ways, key=lambda way: sum(map(len, ways[way])))
        self.chunks.append({"at": self.at, "n": len(ids), "bits": bits, "sizes": [len(p) for p in ways[bits]]})
        for plane in ways[bits]:
            self._put(plane)

    def close(self, statements: pa.Table) -> None:
        if self.held:
            self._chunk(np.concatenate(self.pending))
        places = []
        for table in (statements, pa.Table.from_pylist(self.chunks, CHUNKS)):
            places.append(self.at)
            data = io.BytesIO()
            with pa.ipc.new_stream(data, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            self._put(data.getvalue())
        self._put(struct.pack(FOOTER, *places, self.at, MAGIC))


class PlaneReader:
    """Reads one file: its statements, and any chunk by its number."""

    def __init__(self, source) -> None:
        self.source, self.frame = source, zstandard.ZstdDecompressor()
        size = source.size()
        statements, chunks, end, magic = struct.unpack(FOOTER, self._get(size - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        if magic != MAGIC or self._get(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a whole file of token planes")
        self.statements = pa.ipc.open_stream(self._get(statements, chunks - statements)).read_all()
        self.chunks = pa.ipc.open_stream(self._get(chunks, end - chunks)).read_all().to_pylist()

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def chunk(self, number: int) -> np.ndarray:
        entry = self.chunks[number]
        data, planes, at = self._get(entry["at"], sum(entry["sizes"])), [], 0
        for size in entry["sizes"]:
            planes.append(self.frame.decompress(data[at : at + size]))
            at += size
        return from_planes(planes, entry["n"], entry["bits"])


def _filesystem(path: str):
    """The file system and path for a local path or a URL that Arrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def write_token_files(
    observations: DataFrame, folder: str, tokenizer: str, id_col: str = "observation_id", text: str = "statement",
    end_id: int = 2, block: int = BLOCK, level: int = LEVEL, planes: str = "bytes",
) -> DataFrame:
    """Write the statements' ids in ascending order of ``id_col`` to files in ``folder``; returns the manifest.

    The manifest, also kept as ``folder/manifest``, has ``(part, file, n_statements, n_ids, n_bytes, first)``:
    parts in the order of their statements, and the ids before each.  Null statements have ``end_id`` only;
    null ids come first; rows with one id are ordered by their place in the input, and each keeps its own
    entry.  An empty table gives an empty manifest.  ``folder`` must be shared by all executors.  Other columns
    are not read and may have any name.  ``tokenizer`` is the path of a lower-casing byte-level ``tokenizers``
    file, as described at ``packing.WordIds``.

    Texts are shuffled, not ids: they take no more room, and the sort's sample does not tokenize.
    """
    rows = observations.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text).cast("binary").alias("_text"))
    order = ["_id", "_row"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    names = ["part", "file", "n_statements", "n_ids", "n_bytes"]
    fields = [T.StructField(n, T.StringType() if n == "file" else T.LongType()) for n in names]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        known, end = _word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        writer, ids, lengths = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                part, files = batch.column("_part")[0].as_py(), _filesystem(folder)
                name = f"{part:06d}-{uuid.uuid4().hex}.planes"
                files[0].create_dir(files[1], recursive=True)
                sink = files[0].open_output_stream(f"{files[1]}/{name}")
                writer = PlaneWriter(sink, block, level, planes)
            for value in batch.column("_text"):
                data = value.as_py() or b""
                # Special tokens are told by their case, so a text that may hold one keeps it.
                words = (data if b"<|" in data else data.lower()).split()
                found = np.frombuffer(b"".join(map(known.__getitem__, words)) + end, "<u4")
                writer.add(found)
                lengths.append(len(found))
            ids.append(batch.column("_id"))
        if writer:
            n = np.array(lengths, np.int64)
            writer.close(pa.table({"id": pa.chunked_array(ids), "start": pa.array(np.cumsum(n) - n), "n": pa.array(n)}))
            sink.close()
            told = (part, name, len(n), writer.n, writer.at)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], pa.string() if n == "file" else pa.int64()) for n, v in zip(names, told, strict=True)], names=names
            )

    map_arrow(sorted_, write, fields).write.parquet(f"{folder}/manifest")
    return token_manifest(observations.sparkSession, folder)


def token_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files of ``folder`` that count, with the number ``first`` of ids before each; one row per file."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    schema = "part BIGINT, file STRING, n_statements BIGINT, n_ids BIGINT, n_bytes BIGINT"
    return spark.read.schema(schema).parquet(f"{folder}/manifest").withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, folder: str, id_type: T.DataType = T.LongType(), with_ids: bool = False) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32[, ids])`` per statement, from the files alone.

    ``start`` counts the ids of all statements before; ``ids`` are little-endian unsigned 32-bit numbers.
    One task reads one file chunk by chunk.
    """
    names = ["id", "start", "n_tokens", "ids_crc32", "ids"]
    types = [id_type, T.LongType(), T.LongType(), T.LongType(), T.BinaryType()]
    fields = [T.StructField(n, t) for n, t in zip(names, types, strict=True)][: 5 if with_ids else 4]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
                files = _filesystem(folder)
                with files[0].open_input_file(f"{files[1]}/{file}") as source:
                    yield from one(PlaneReader(source), first)

    def one(reader: PlaneReader, first: int) -> Iterator[pa.RecordBatch]:
        told, held, number = reader.statements, np.zeros(0, "<u4"), 0
        for at in range(0, told.num_rows, 4096):
            part = told.slice(at, 4096)
            crcs, ids = [], []
            for n in part.column("n").to_pylist():
                crc, kept = 0, []
                while n:
                    if not len(held):
                        held, number = reader.chunk(number), number + 1
                    take, held = held[:n], held[n:]
                    n -= len(take)
                    crc = zlib.crc32(take.tobytes(), crc)
                    if with_ids:
                        kept.append(take.tobytes())
                crcs.append(crc)
                ids.append(b"".join(kept))
            columns = [
                part.column("id").combine_chunks(), pa.array(part.column("start").to_numpy() + first), part.column("n").combine_chunks(),
                pa.array(crcs, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary())] if with_ids else []), names=[f.name for f in fields])

    files = token_manifest(spark, folder).repartition("part")
    return map_arrow(files, read, fields)


by_value(__name__)
