"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word everywhere in this subpackage: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def by_value(module_name: str) -> None:
    """Send a module's task functions to executors whole, this module's too."""
    for name in (module_name, __name__):
        cloudpickle.register_pickle_by_value(sys.modules[name])


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker, so that tasks share what they learn."""
    holder = sys.modules.setdefault("_sightline_worker", types.ModuleType("_sightline_worker"))
    return vars(holder).setdefault(name, {})


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` that also takes a list of fields as its schema; workers give Arrow's free memory back after each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, T.StructType(schema) if isinstance(schema, list) else schema)


def field(df: DataFrame, source: str, name: str) -> T.StructField:
    """The type of a column under another name."""
    return T.StructField(name, df.schema[source].dataType)


def int64(values) -> pa.Array:
    """Unsigned 64-bit patterns as Spark's BIGINT."""
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A BIGINT column without nulls as unsigned patterns."""
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


MIX = np.uint64(0x9E3779B97F4A7C15)


def membership(hashes: DataFrame, columns: list[str], bits: int = 26) -> list[np.ndarray]:
    """A bit map of ``2**bits`` bits over the 64-bit values of each column (nulls leave no mark).

    Its size does not depend on the rows: 8 MB a column by default, built with a map-side ``bit_or``
    over at most ``2**(bits - 6)`` groups.  A value that is in the table is always found in the map;
    others may be, so every use must stay right when too many rows pass.
    """
    low = (1 << (bits - 6)) - 1
    parts = []
    for i, name in enumerate(columns):
        word = [F.lit(None).cast("bigint")] * len(columns)
        word[i] = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(name, bits - 6).bitwiseAND(F.lit(63)).cast("int"))
        parts.append(F.struct(
            F.col(name).bitwiseAND(F.lit(low)).alias("block"), *[w.alias(f"w{j}") for j, w in enumerate(word)]
        ))
    rows = (
        hashes.select(F.explode(F.array(*parts)).alias("p")).select("p.*").where(F.col("block").isNotNull())
        .groupBy("block").agg(*[F.coalesce(F.bit_or(f"w{j}"), F.lit(0)).alias(f"w{j}") for j in range(len(columns))])
        .toArrow()
    )
    block = rows.column("block").to_numpy()
    maps = []
    for j in range(len(columns)):
        words = np.zeros(low + 1, np.uint64)
        words[block] = rows.column(f"w{j}").to_numpy().view(np.uint64)
        maps.append(words)
    return maps


def member(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each 64-bit pattern may be in the bit map."""
    low = np.uint64(len(words) - 1)
    shift = np.uint64(len(words).bit_length() - 1)
    return (words[hashes & low] >> ((hashes >> shift) & np.uint64(63))) & np.uint64(1) == 1


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows as tables that hold whole groups only; a group that spans batches is joined."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        if kept and any(kept[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(kept)
            kept = []
        starts = np.flatnonzero(change)
        if len(starts):
            yield pa.Table.from_batches([*kept, batch.slice(0, starts[-1])])
            kept = [batch.slice(starts[-1])]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)


def id_key(column: str) -> list[Column]:
    """Two join columns that tell a missing id from any present one."""
    return [F.coalesce(F.col(column).cast("string"), F.lit("")).alias("_id"), F.col(column).isNull().alias("_no_id")]
