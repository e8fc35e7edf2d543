"""Near copies of observation statements at a shingle similarity, by wide SimHash fingerprints compared bit-sliced.

A short fingerprint within a few bits finds copies with a changed word.  Two texts that share four fifths of
their shingles differ in about 15 % of their bits, so here a fingerprint has 256 bits, and how many differ is
an estimate of the similarity itself: ``limit_bits`` is what is expected at the limit plus one and a
half standard deviations.  Fingerprints meet in tables keyed by random bits; the number of bits grows with the logarithm of
the number of different fingerprints and the number of tables follows from the wanted recall.  Inside a key
they stand as bit planes, as in ``simhash``; counters of as many planes as the limit needs are added up
carry by carry, and words whose pairs are all over the limit are abandoned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import MIX, by_value, field, grouped, id_key, int64, map_arrow
from sightline.llm.links import linked_components, spanning_forest
from sightline.session import reliable_checkpoint

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.97
BITS = 256
SEED = 20021
#: Fingerprints that a key holds on average if all were independent.
FILL = 16
BLOCK = 4096


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of two texts of one length with that Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def limit_bits(similarity: float = SIMILARITY) -> int:
    p = differing_share(similarity)
    return round(BITS * p + 1.5 * math.sqrt(BITS * p * (1 - p)))


def tables_needed(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a key and number of tables for ``n`` different fingerprints."""
    bits = min(max(10, math.ceil(math.log2(max(n, 1) / FILL))), 40)
    agree = (1 - differing_share(similarity)) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def wide_fingerprint(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """256 bits, as bytes: a bit is set when over half of the different shingles' hashes have it; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(BITS // 8, np.uint8)
    windows = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)) if len(words) >= shingle else iter([b" ".join(words)])
    n = max(len(words) - shingle + 1, 1)
    hashes = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, windows, repeat(SEED)), np.uint64, n))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        wide = np.empty((len(part), BITS // 64), np.uint64)
        for j in range(BITS // 64):
            x = (part + np.uint64(j)) * MIX
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            wide[:, j] = x ^ (x >> np.uint64(31))
        counts += np.unpackbits(wide.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes))


def wide_pairs(fps: np.ndarray, ends: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows (of bytes) that differ in at most ``limit`` bits; row ``r`` meets those up to ``ends[r]``."""
    n = len(fps)
    words = (n + 63) // 64
    bits = np.unpackbits(fps, axis=1)
    columns = np.zeros((bits.shape[1], (words + 1) * 64), np.uint8)
    columns[:, :n] = bits.T
    planes = np.packbits(columns, axis=1, bitorder="little").view(np.uint64).reshape(-1, words + 1)
    depth = limit.bit_length() + 1
    room = ends - np.arange(n)
    rows = np.flatnonzero(room > 1)
    d = 1
    while len(rows):
        valid = np.zeros(words, np.uint64)
        np.bitwise_or.at(valid, rows >> 6, np.uint64(1) << (rows & 63).astype(np.uint64))
        live = np.flatnonzero(valid)
        keep, hop, turn = valid[live], d >> 6, np.uint64(d & 63)
        counter = [np.zeros(len(live), np.uint64) for _ in range(depth)]
        full = np.zeros(len(live), np.uint64)
        for p in range(0, len(planes), 4):
            there = np.minimum(live + hop, words)
            moved = planes[p : p + 4, there]
            if turn:
                moved = (moved >> turn) | (planes[p : p + 4][:, np.minimum(there + 1, words)] << (np.uint64(64) - turn))
            a, b, c, e = planes[p : p + 4][:, live] ^ moved
            # Four planes become ones, twos and fours before they reach the counters.
            ab, ce = a ^ b, c ^ e
            ones, twos, more = ab ^ ce, (a & b) ^ (c & e) ^ (ab & ce), (a & b) & (c & e)
            for start, carry in ((0, ones), (1, twos), (2, more)):
                for level in range(start, depth):
                    counter[level], carry = counter[level] ^ carry, counter[level] & carry
                    if not carry.any():
                        break
                else:
                    full |= carry
            if p % 32 == 28:
                keep &= ~(full | _above(counter, limit))
                going = keep != 0
                if not going.all():
                    live, keep, full = live[going], keep[going], full[going]
                    counter = [x[going] for x in counter]
                if not len(live):
                    break
        if len(live):
            hit = np.unpackbits(keep.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            word, bit = np.nonzero(hit)
            left = live[word] * 64 + bit
            if len(left):
                yield left, left + d
        d += 1
        rows = rows[room[rows] > d]


def _above(counter: list[np.ndarray], limit: int) -> np.ndarray:
    """Where the bit-sliced number is over the limit."""
    above, equal = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for level in reversed(range(len(counter))):
        if limit >> level & 1:
            equal = equal & counter[level]
        else:
            above |= equal & counter[level]
            equal = equal & ~counter[level]
    return above


def near_copy_rows(
    observations: DataFrame, id_col: str = "observation_id", text: str = "statement",
    shingle: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK,
) -> DataFrame:
    """``(_id, _text_hash, node, root)`` for every row; rows with one ``root`` are linked through near copies.

    ``node`` stands for a fingerprint.  Null, empty and wordless texts have one fingerprint and are copies of
    each other.  A key with more than ``block`` fingerprints is dealt to every pair of its parts, and a task
    returns a spanning forest of the links it found.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [wide_fingerprint(t, shingle).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary())], names=["_id", "_text_hash", "fp"])

    given = observations.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text_hash"), F.col(text).cast("binary").alias("_text"))
    kinds = [field(given, "_id", "_id"), T.StructField("_text_hash", T.LongType()), T.StructField("fp", T.BinaryType())]
    rows = reliable_checkpoint(map_arrow(given, run, kinds).select("_id", "_text_hash", "fp", F.xxhash64("fp").alias("node")))
    distinct = reliable_checkpoint(rows.select("fp", "node").distinct())
    bits, tables = tables_needed(distinct.count(), similarity, recall)
    places = [np.random.default_rng([SEED, t]).choice(BITS, bits, replace=False) for t in range(tables)]
    limit = limit_bits(similarity)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, BITS // 8)
            spread = np.unpackbits(wide, axis=1)
            for t, place in enumerate(places):
                key = (spread[:, place] @ (1 << np.arange(bits, dtype=np.int64))) | (t << 41)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key)], names=["fp", "node", "key"])

    dealt = map_arrow(distinct, deal, [T.StructField("fp", T.BinaryType()), T.StructField("node", T.LongType()), T.StructField("key", T.LongType())])
    large = reliable_checkpoint(dealt.groupBy("key").count().where(F.col("count") > block))
    parts = F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
    spread = (
        dealt.join(large, "key", "left").select("fp", "node", "key", parts.alias("_parts"), F.pmod(F.xxhash64("node", F.lit(1)), parts).cast("int").alias("_own"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other"))
        .select("fp", "node", "key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["key", "i", "j"]):
            change = np.zeros(table.num_rows, bool)
            for name in ("key", "i", "j"):
                values = table.column(name).to_numpy()
                change[1:] |= values[1:] != values[:-1]
            sizes = np.bincount(np.cumsum(change))
            several = np.repeat(sizes, sizes) > 1
            node, sizes = table.column("node").to_numpy()[several], sizes[sizes > 1]
            if len(node):
                fps = np.frombuffer(b"".join(table.column("fp").filter(pa.array(several)).to_pylist()), np.uint8).reshape(-1, BITS // 8)
                found = spanning_forest(len(node), wide_pairs(fps, np.repeat(np.cumsum(sizes), sizes), limit))
                if found:
                    left, right = np.array(found).T
                    yield pa.RecordBatch.from_arrays([int64(node[left].view(np.uint64)), int64(node[right].view(np.uint64))], names=["u", "v"])

    met = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    links = map_arrow(met, compare, [T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
    roots = linked_components(links).withColumnRenamed("node", "_node")
    named = rows.join(roots, rows["node"] == roots["_node"], "left")
    return named.select("_id", "_text_hash", "node", F.coalesce("root", "node").alias("root"))


def without_near_copies(observations: DataFrame, id_col: str = "observation_id", text: str = "statement", **options) -> DataFrame:
    """One observation of each group of near copies, that with the least id, its columns unchanged.

    Rows without an id come after all others of their group; among equal ids the text's hash decides, and of
    rows that repeat one stays.  Columns may have any name.
    """
    rows = near_copy_rows(observations, id_col, text, **options)
    first = rows.select("root", F.struct(*reversed(id_key("_id")), F.col("_id").alias("id"), F.col("_text_hash")).alias("k"))
    order = F.struct("k._no_id", "k.id", "k._text_hash", "k._id")
    chosen = reliable_checkpoint(
        first.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k._id").alias("_key"), "k._no_id", "k._text_hash").distinct()
    )
    keys = ["_key", "_no_id", "_text_hash"]
    ident = F.col(id_col)
    carried = observations.select(
        F.struct("*").alias("row"), F.coalesce(ident.cast("string"), F.lit("")).alias("_key"), ident.isNull().alias("_no_id"), F.xxhash64(text).alias("_text_hash")
    )
    one = Window.partitionBy(*keys).orderBy(F.lit(1))
    kept = carried.join(chosen, keys, "left_semi").withColumn("_copy", F.row_number().over(one)).where("_copy = 1")
    return kept.select("row.*")


by_value(__name__)
