"""Artifact files as rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.session import ship_by_value

ship_by_value(__name__)

#: Files up to this size are hashed as one value, larger ones piece by piece.
WHOLE_BYTES = 256 << 20
PIECE_BYTES = 1 << 20


def scan_files(spark: SparkSession, root: str, pattern: str = "*", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """``path, length, sha256, magic`` of every file below ``root``.

    Sizes come from the listing and cost no read.  Files up to ``whole_bytes`` are read by Spark's own
    reader.  A larger one is opened through Arrow's file systems in the task it falls to and hashed in
    pieces of 1 MiB, so that neither a row nor a task holds it, whatever its size; the result is the same.
    Empty files are not listed: Spark's readers skip them.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    listed = reader.load(root)
    small = listed.where(F.col("length") <= whole_bytes).select(
        "path", "length", F.sha2("content", 256).alias("sha256"), F.substring("content", 1, 8).alias("magic")
    )
    large = listed.where(F.col("length") > whole_bytes).select("path", "length").repartition("path")
    return small.unionByName(large.mapInArrow(_digest_files, small.schema))


def _opened(path: str) -> pa.NativeFile:
    """A stream over a file that Spark listed; its names are not percent-encoded."""
    scheme = urlsplit(path).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_stream(path.removeprefix("file:"), buffer_size=0)
    system, place = fs.FileSystem.from_uri(quote(path, safe="/:@"))
    return system.open_input_stream(place)


def _digest_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
            digest, magic, read = hashlib.sha256(), b"", 0
            with _opened(path) as stream:
                while piece := stream.read(PIECE_BYTES):
                    digest.update(piece)
                    magic = magic or piece[:8]
                    read += len(piece)
            if read != length:
                raise OSError(f"{path} changed while it was read: {read} of {length} bytes")
            yield pa.RecordBatch.from_pylist([{"path": path, "length": length, "sha256": digest.hexdigest(), "magic": magic}])


def relative_to(files: DataFrame, root: str) -> DataFrame:
    """Strip the scheme and root folder from ``path``."""
    clean = root.rstrip("/") + "/"
    return files.withColumn("path", F.substring_index("path", clean, -1))
