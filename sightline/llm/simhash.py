"""Near-duplicate observation statements by SimHash, compared in bit-sliced blocks.

A fingerprint bit is set when over half of the statement's word-shingle hashes have it.  Two
fingerprints within ``radius`` bits agree on at least ``bands - radius`` of ``bands`` bit ranges, so
they meet in one of the tables keyed by that many ranges.  Inside a key the fingerprints stand as bit
planes, 64 rows to a machine word: a shift of the planes sets every row against the row ``d`` places
on, carry-save counters add up the differing planes of a whole word at a time, and words in which no
pair can still be within the radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import by_value, field, grouped, id_key, int64, map_arrow, numbers
from sightline.llm.links import linked_components, spanning_forest
from sightline.session import reliable_checkpoint

SEED = 42
#: Distinct fingerprints of one key that are compared in one task; larger keys go to pairs of parts.
BLOCK = 4096


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of the words of a UTF-8 text; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = iter([xxhash.xxh64_intdigest(b" ".join(words), SEED)])
        n = 1
    else:
        n = len(words) - shingle + 1
        windows = zip(*[words[i:] for i in range(shingle)], strict=False)
        hashes = map(xxhash.xxh64_intdigest, map(b" ".join, windows), repeat(SEED))
    counts = np.zeros(64, np.int64)
    done = 0
    while done < n:
        size = min(n - done, 1 << 16)
        part = np.fromiter(hashes, np.uint64, size).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        done += size
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(observations: DataFrame, id_col: str = "observation_id", text: str = "statement", shingle: int = 3) -> DataFrame:
    """``(id_col, _text_hash, fp BIGINT)`` for every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py(), shingle) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), int64(fps)], names=["_id", "_text_hash", "fp"])

    rows = observations.select(
        F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text_hash"), F.col(text).cast("binary").alias("_text")
    )
    out = map_arrow(rows, run, [field(observations, id_col, "_id"), *_bigint("_text_hash", "fp")])
    return out.select(F.col("_id").alias(id_col), "_text_hash", "fp")


def _bigint(*names: str) -> list:
    return [T.StructField(n, T.LongType()) for n in names]


def close_pairs(fps: np.ndarray, ends: np.ndarray, radius: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius; row ``r`` is compared with the rows up to ``ends[r]`` (exclusive).

    One yield per distance ``d`` between the rows of a pair.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the counters hold distances up to 3")
    n = len(fps)
    words = (n + 63) // 64
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    columns = np.zeros((64, (words + 1) * 64), np.uint8)
    columns[:, :n] = bits.T
    planes = np.packbits(columns, axis=1, bitorder="little").view(np.uint64).reshape(64, words + 1)
    room = ends - np.arange(n)
    rows = np.flatnonzero(room > 1)
    d = 1
    while len(rows):
        valid = np.zeros(words, np.uint64)
        np.bitwise_or.at(valid, rows >> 6, np.uint64(1) << (rows & 63).astype(np.uint64))
        live = np.flatnonzero(valid)
        keep, hop, turn = valid[live], d >> 6, np.uint64(d & 63)
        ones, twos, over = (np.zeros(len(live), np.uint64) for _ in range(3))
        for p in range(0, 64, 2):
            two = []
            for plane in planes[p : p + 2]:
                there = np.minimum(live + hop, words)
                moved = plane[there]
                if turn:
                    moved = (moved >> turn) | (plane[np.minimum(there + 1, words)] << (np.uint64(64) - turn))
                two.append(plane[live] ^ moved)
            a, b = two
            half = ones ^ a
            carry = (ones & a) | (half & b)
            ones = half ^ b
            over |= twos & carry
            twos ^= carry
            if radius < 3:
                over |= twos & ones if radius == 2 else twos
            if p % 8 == 6:
                keep &= ~over
                going = keep != 0
                if not going.all():
                    live, keep, ones, twos, over = (x[going] for x in (live, keep, ones, twos, over))
                if not len(live):
                    break
        if len(live):
            keep &= ~over
            if radius == 0:
                keep &= ~ones
            hit = np.unpackbits(keep.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            word, bit = np.nonzero(hit)
            left = live[word] * 64 + bit
            if len(left):
                yield left, left + d
        d += 1
        rows = rows[room[rows] > d]


def _keys(bands: int, radius: int) -> list[list[tuple[int, int]]]:
    edges = [round(i * 64 / bands) for i in range(bands + 1)]
    ranges = [(edges[i], edges[i + 1] - edges[i]) for i in range(bands)]
    return [list(c) for c in combinations(ranges, bands - radius)]


def fingerprint_links(fps: DataFrame, radius: int = 3, bands: int = 5, block: int = BLOCK) -> DataFrame:
    """Links ``(u, v)`` that connect all distinct fingerprints ``fp`` within ``radius`` bits of each other.

    ``bands=5`` makes 10 tables with keys of about 26 bits; ``bands=6`` makes 20 with keys of 32 bits,
    for corpora of over 10**9 different texts.  A key with more than ``block`` fingerprints is dealt to
    every pair of its parts, so no task holds more than two parts.  A task returns a spanning forest.
    """
    tables = _keys(bands, radius)
    keys = []
    for number, ranges in enumerate(tables):
        key = F.lit(number).cast("bigint")
        for start, width in ranges:
            key = F.shiftleft(key, width).bitwiseOR(
                F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
            )
        keys.append(key)
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = reliable_checkpoint(rows.groupBy("key").count().where(F.col("count") > block))
    parts = F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
    spread = (
        rows.join(large, "key", "left")
        .select("fp", "key", parts.alias("_parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("_own"))
        .select("fp", "key", "_own", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other"))
        .select("fp", "key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["key", "i", "j"]):
            fp = table.column("fp").to_numpy().view(np.uint64)
            change = np.zeros(len(fp), bool)
            for name in ("key", "i", "j"):
                values = table.column(name).to_numpy()
                change[1:] |= values[1:] != values[:-1]
            group = np.cumsum(change)
            sizes = np.bincount(group)
            several = sizes[group] > 1
            fp, sizes = fp[several], sizes[sizes > 1]
            if len(fp):
                ends = np.repeat(np.cumsum(sizes), sizes)
                pairs = spanning_forest(len(fp), close_pairs(fp, ends, radius))
                if pairs:
                    left, right = np.array(pairs).T
                    yield pa.RecordBatch.from_arrays([int64(fp[left]), int64(fp[right])], names=["u", "v"])

    dealt = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return map_arrow(dealt, run, _bigint("u", "v"))


def _grouped_rows(observations: DataFrame, id_col: str, text: str, shingle: int, radius: int, bands: int) -> DataFrame:
    """``(id_col, _text_hash, fp, root, component_id)`` for every row."""
    rows = reliable_checkpoint(fingerprints(observations, id_col, text, shingle))
    distinct = reliable_checkpoint(rows.groupBy("fp").agg(F.min(id_col).alias("_least")))
    roots = linked_components(fingerprint_links(distinct.select("fp"), radius, bands))
    named = reliable_checkpoint(
        distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "_least", F.coalesce("root", "fp").alias("root"))
    )
    least = reliable_checkpoint(named.groupBy("root").agg(F.min("_least").alias("component_id")))
    of_fp = reliable_checkpoint(named.join(least, "root").select("fp", "root", "component_id"))
    return rows.join(of_fp, "fp").select(id_col, "_text_hash", "fp", "root", "component_id")


def simhash_groups(
    observations: DataFrame, id_col: str = "observation_id", text: str = "statement",
    shingle: int = 3, radius: int = 3, bands: int = 5,
) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` for every observation.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` is the least id that can be reached
    over links of ``radius`` (0 to 3) or fewer differing bits, the row's own included.  Null and empty
    statements have fingerprint 0 and link like any other.  Repeated rows come back repeated; rows
    without an id belong to groups but never name one.
    """
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return _grouped_rows(observations, id_col, text, shingle, radius, bands).select(id_col, hexed, "component_id")


def one_per_group(
    observations: DataFrame, id_col: str = "observation_id", text: str = "statement",
    shingle: int = 3, radius: int = 3, bands: int = 5,
) -> DataFrame:
    """The observations without near copies: one row of each group, that with the least id.

    Rows without an id come after all others of their group; among equal ids the text hash decides, and of
    rows that repeat one stays.  Columns may have any name.
    """
    carried = observations.select(F.struct("*").alias("row"), F.col(id_col).alias("_key"), F.col(text).alias("_content"))
    rows = _grouped_rows(carried.drop("row"), "_key", "_content", shingle, radius, bands)
    first = rows.select("root", F.struct(*reversed(id_key("_key")), F.col("_key").alias("id"), F.col("_text_hash")).alias("k"))
    order = F.struct("k._no_id", "k.id", "k._text_hash", "k._id")
    chosen = reliable_checkpoint(
        first.groupBy("root").agg(F.min(order).alias("k")).select("k._id", "k._no_id", "k._text_hash").distinct()
    )
    keys = ["_id", "_no_id", "_text_hash"]
    one = Window.partitionBy(*keys).orderBy(F.lit(1))
    return (
        carried.select("row", *id_key("_key"), F.xxhash64("_content").alias("_text_hash"))
        .join(chosen, keys, "left_semi")
        .withColumn("_copy", F.row_number().over(one)).where("_copy = 1")
        .select("row.*")
    )


by_value(__name__)
