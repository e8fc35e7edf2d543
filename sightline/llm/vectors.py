"""Near-duplicate candidate vectors by random-hyperplane sign hashing, exact cosines and components.

Each table cuts the space with ``bits`` random hyperplanes; vectors with the same signs meet.  ``bits``
grows with the logarithm of the number of different vectors, so keys hold a few dozen; the number of
tables follows from the chance that two vectors at the limit agree in one.  Equal vectors are one class
and are never paired.  A pair that meets in several tables counts in the first of them, which both
signatures tell without looking elsewhere; so links are counted per vector and never listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import by_value, grouped, map_arrow
from sightline.llm.links import linked_components, spanning_forest
from sightline.session import reliable_checkpoint

LIMIT = 0.95
#: Chance that a pair exactly at the limit meets in some table; closer pairs meet more often.
RECALL = 0.995
#: Vectors a key holds on average if all were independent.
FILL = 32
#: Vectors of one key that are compared in one task; larger keys go to pairs of parts.
BLOCK = 2048
SEED = 20011


def tables_needed(n: int, limit: float = LIMIT, recall: float = RECALL) -> tuple[int, int]:
    """Bits per table and number of tables for ``n`` different vectors."""
    bits = min(max(8, math.ceil(math.log2(max(n, 1) / FILL))), 40)
    agree = (1 - math.acos(limit) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def planes(width: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, width]).standard_normal((width, tables * bits))


def signatures(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One BIGINT per vector and table."""
    signs = vectors @ planes(vectors.shape[1], bits, tables) > 0
    return signs.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _close(unit: np.ndarray, keys: np.ndarray, table: int, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one key with at least the limit that meet in no table before, rows in slices."""
    for start in range(0, len(unit), 256):
        part = unit[start : start + 256]
        rows, others = np.nonzero(part @ unit.T >= limit)
        rows += start
        rows, others = rows[rows != others], others[rows != others]
        if table and len(rows):
            first = np.ones(len(rows), bool)
            for t in range(table):
                first &= keys[rows, t] != keys[others, t]
            rows, others = rows[first], others[first]
        yield rows, others


def vector_links(
    candidates: DataFrame, id_col: str = "candidate_id", vector: str = "score_components", limit: float = LIMIT, recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """``(id_col, n_links, component_id, kept)``: one row per candidate.

    Two candidates are linked when the cosine of their vectors, in doubles, is at least ``limit`` and some
    table finds them.  ``n_links`` counts the other candidates linked directly, equal vectors included;
    ``component_id`` is the least id reachable; ``kept`` marks the row that names its component.  Vectors
    that are null, empty, zero or hold a null or a non-finite number link with nothing, and vectors of
    different lengths never link.  A repeated row is another candidate.
    """
    number = F.col("_v").cast("array<double>")
    whole = F.col("_v").isNotNull() & (F.size("_v") > 0) & F.forall(number, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists(number, lambda x: x != 0)
    given = candidates.select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"))
    given = reliable_checkpoint(given.select("_id", F.when(F.coalesce(whole, F.lit(False)), F.transform(number, lambda x: x + F.lit(0.0))).alias("_v")))
    classes = reliable_checkpoint(
        given.where("_v IS NOT NULL").groupBy("_v").agg(F.count(F.lit(1)).alias("members"), F.min("_id").alias("least"))
        .select("_v", "members", "least", F.xxhash64("_v").alias("class"))
    )
    bits, tables = tables_needed(classes.count(), limit, recall)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(x) for x in batch.column("_v")])
            for length in np.unique(lengths):
                part = batch.filter(pa.array(lengths == length))
                v = part.column("_v").flatten().to_numpy().reshape(-1, length)
                v = v / abs(v).max(axis=1, keepdims=True)
                v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
                keys = signatures(v, bits, tables)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("class"), part.column("members"), pa.array(np.full(len(v), t, np.int32)), pa.array(np.full(len(v), length, np.int32)),
                            pa.array(keys[:, t]), _lists(keys[:, : t]), _lists(v),
                        ],
                        names=names,
                    )

    names = ["class", "members", "table", "width", "key", "before", "unit"]
    fields = [
        T.StructField("class", T.LongType()), T.StructField("members", T.LongType()), T.StructField("table", T.IntegerType()),
        T.StructField("width", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("before", T.ArrayType(T.LongType())),
        T.StructField("unit", T.ArrayType(T.DoubleType())),
    ]
    bucket = ["table", "width", "key"]
    dealt = map_arrow(classes.select("class", "members", "_v"), deal, fields)
    large = reliable_checkpoint(dealt.groupBy(*bucket).count().where(F.col("count") > block))
    parts = F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("class"), parts).cast("int")
    spread = (
        dealt.join(large, bucket, "left").select(*names, parts.alias("_parts"), own.alias("own"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other"))
        .select(*names, "own", F.least("own", "_other").alias("i"), F.greatest("own", "_other").alias("j"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in grouped(batches, [*bucket, "i", "j"]):
            columns = [found.column(c).to_numpy() for c in [*bucket, "i", "j"]]
            change = np.zeros(found.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            edges = np.flatnonzero(np.r_[True, change[1:], True])
            ids, members, own_part = (found.column(c).to_numpy() for c in ("class", "members", "own"))
            out = [[], [], []]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                slab = found.slice(a, b - a).combine_chunks()
                unit = slab.column("unit").combine_chunks().flatten().to_numpy().reshape(b - a, -1)
                table = int(columns[0][a])
                keys = slab.column("before").combine_chunks().flatten().to_numpy().reshape(b - a, table) if table else None
                across = columns[3][a] != columns[4][a]
                own_here = own_part[a:b]
                here = ids[a:b]
                count = np.zeros(b - a)

                def pairs(unit=unit, keys=keys, table=table, across=across, own_here=own_here, weight=members[a:b], count=count):
                    for rows, others in _close(unit, keys, table, limit):
                        if across:
                            apart = own_here[rows] != own_here[others]
                            rows, others = rows[apart], others[apart]
                        count += np.bincount(rows, weight[others], len(count))
                        yield rows[rows < others], others[rows < others]

                joins = np.array(spanning_forest(b - a, pairs()), np.int64).reshape(-1, 2)
                hit = np.flatnonzero(count)
                for column, values in zip(
                    out, (np.r_[here[hit], here[joins[:, 0]]], np.r_[count[hit].astype(np.int64), 0 * joins[:, 0]], np.r_[here[hit], here[joins[:, 1]]]), strict=True
                ):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["class", "links", "u"])

    met = map_arrow(
        spread.repartition(*bucket, "i", "j").sortWithinPartitions(*bucket, "i", "j"), compare,
        [T.StructField(n, T.LongType()) for n in ("class", "links", "u")],
    )
    met = reliable_checkpoint(met)
    roots = linked_components(met.select(F.col("class").alias("u"), F.col("u").alias("v")))
    links = met.groupBy("class").agg(F.sum("links").alias("links"))
    named = reliable_checkpoint(
        classes.select("class", "members", "least").join(roots.withColumnRenamed("node", "class"), "class", "left")
        .join(links, "class", "left")
        .select("class", "members", "least", F.coalesce("root", "class").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    least = reliable_checkpoint(named.groupBy("root").agg(F.min("least").alias("component_id")))
    known = reliable_checkpoint(named.join(least, "root").select("class", "members", "links", "component_id"))
    rows = given.select("_id", F.when(F.col("_v").isNotNull(), F.xxhash64("_v")).alias("class")).join(known, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return rows.select(
        F.col("_id").alias(id_col), F.coalesce(F.col("members") - 1 + F.col("links"), F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"),
    )


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, width = rows.shape
    ends = np.arange(n + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).ravel()))


by_value(__name__)
