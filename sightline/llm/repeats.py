"""Repeated passages of observation statements by a depth-limited radix sort of their windows.

A window is a suffix of a statement's UTF-8 bytes cut off after ``threshold`` bytes.  Windows are
ordered by most-significant-digit passes, and a group with a single member leaves before the next
pass.  Sending every byte position through every pass would move many times the corpus, so the first
digit is the window's *anchor*: of all its 64-byte strings the one with the least hash (the first of
equals).  Equal windows have equal anchors at equal distances, and neighbouring windows share one, so
the passes handle runs of windows with one anchor:

1. anchor: runs whose anchor occurs once hold no repeated window;
2. whole run: equal runs are equal windows throughout;
3. window: the different runs of one anchor are compared window by window.

What remains in a group after the last pass are exactly the repeated windows.  Digits are compared as
64-bit hashes inside a group of the pass before, so a false match takes equal 64-byte strings, or their
equal hashes, and a second equal hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import by_value, grouped, id_key, int64, map_arrow, member, membership, numbers
from sightline.session import reliable_checkpoint

THRESHOLD = 200
ANCHOR = 64
#: Bytes of a statement that are worked on at once, and the bits that hold a position among them.
CHUNK, PLACE = 1 << 23, 24
#: Different runs of one anchor that are compared in one task; anchors with more go through joins.
RUNS = 4096
ODD = [np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 % 2**64) for i in range(1, 16)]


def _rolled(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes from each position, by joining hashes of halves."""
    hashes, size, whole, done = data.astype(np.uint64), 1, None, 0
    step = 0
    while True:
        if width & size:
            if whole is None:
                whole = hashes
            else:
                n = len(data) - done - size + 1
                mixed = whole[:n] * ODD[step]
                mixed ^= mixed >> np.uint64(29)
                whole = mixed + hashes[done : done + n]
            done += size
        size *= 2
        if size > width:
            break
        step += 1
        mixed = hashes[: -(size // 2)] * ODD[step]
        mixed ^= mixed >> np.uint64(31)
        hashes = mixed + hashes[size // 2 :]
    whole = whole * ODD[-1]
    return whole ^ (whole >> np.uint64(32))


def runs(data: bytes, threshold: int = THRESHOLD, anchor: int = ANCHOR) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First and last window of each run with one anchor, the anchor's hash and the run's hash."""
    for begin in range(0, max(len(data) - threshold + 1, 0), CHUNK):
        part = data[begin : begin + CHUNK + threshold - 1]
        hashes = _rolled(np.frombuffer(part, np.uint8), anchor)
        low = np.uint64((1 << PLACE) - 1)
        least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        reach, size = threshold - anchor + 1, 1
        while size * 2 <= reach:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < reach:
            least = np.minimum(least[: len(least) - (reach - size)], least[reach - size :])
        at = (least & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        digests = np.fromiter(
            (xxhash.xxh64_intdigest(part[a : b + threshold]) for a, b in zip(first.tolist(), last.tolist(), strict=True)),
            np.uint64, len(first),
        )
        yield first + begin, last + begin, hashes[at[first]], digests


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def _keyed(observations: DataFrame, id_col: str, text: str) -> DataFrame:
    """Statements as bytes; equal statements have equal spans, so the id's and text's hash is their key."""
    return observations.select(
        F.xxhash64(*id_key(id_col), F.lit(1)).alias("doc"), F.xxhash64(text).alias("body"), F.col(text).cast("binary").alias("_text")
    ).where(F.col("_text").isNotNull())


RUN = ["doc", "body", "first", "last", "anchor", "run"]


def _own_repeats(first: np.ndarray, last: np.ndarray, anchors: np.ndarray, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the runs of one statement: which are the first of their kind, how many of each such kind there
    are, and the stretches (first, last) of all runs that occur in it more than once."""
    order = np.lexsort((first, digests, anchors))
    a, d = anchors[order], digests[order]
    heads = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])])
    copies = np.diff(np.r_[heads, len(order)])
    twice = np.zeros(len(first), bool)
    twice[order] = np.repeat(copies > 1, copies)
    begin, end = first[twice], last[twice]
    cut = np.flatnonzero(np.r_[True, begin[1:] != end[:-1] + 1]) if len(begin) else np.zeros(0, np.int64)
    return order[heads], copies, begin[cut], end[np.r_[cut[1:], len(end)].astype(np.int64) - 1] if len(begin) else end


def _runs_table(keyed: DataFrame, threshold: int, width: int) -> DataFrame:
    """One row for each different run of a statement, with its ``copies`` there; stretches that a statement
    repeats within itself need no partner and come as rows without an anchor."""
    names = [*RUN, "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in names]
            settled = [[] for _ in range(4)]
            doc, body = numbers(batch, "doc"), numbers(batch, "body")
            for i, value in enumerate(batch.column("_text")):
                parts = list(runs(value.as_py(), threshold, width))
                if not parts:
                    continue
                first, last, anchors, digests = (np.concatenate(c) for c in zip(*parts, strict=True))
                kept, copies, begin, end = _own_repeats(first, last, anchors, digests)
                n = len(kept)
                for column, part in zip(
                    out, (np.full(n, doc[i]), np.full(n, body[i]), first[kept], last[kept], anchors[kept], digests[kept], copies), strict=True
                ):
                    column.append(part.astype(np.uint64))
                for column, part in zip(settled, (np.full(len(begin), doc[i]), np.full(len(begin), body[i]), begin, end), strict=True):
                    column.append(part.astype(np.uint64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([int64(np.concatenate(c)) for c in out], names=names)
                spans = [int64(np.concatenate(c)) for c in settled]
                if len(spans[0]):
                    yield pa.RecordBatch.from_arrays([*spans, *[pa.nulls(len(spans[0]), pa.int64())] * 3], names=names)

    return map_arrow(keyed, run, _longs(*names))


def _pruned(table: DataFrame, shared: np.ndarray, mixed: np.ndarray) -> DataFrame:
    """Runs whose anchor may occur again, marked where its runs may differ."""
    context = table.sparkSession.sparkContext
    maps = context.broadcast((shared, mixed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors = numbers(batch, "anchor")
            keep = member(maps.value[0], anchors)
            marked = batch.append_column("mixed", pa.array(member(maps.value[1], anchors)))
            yield marked.filter(pa.array(keep))

    return map_arrow(table, run, [*table.schema.fields, T.StructField("mixed", T.BooleanType())])


def _with_bytes(keyed: DataFrame, places: DataFrame, threshold: int, width: int) -> DataFrame:
    """The bytes of the runs that begin at ``places(doc, body, first)``, read from the statements again.

    The places of a statement, at most one for each of its bytes, meet it in a join, so exactly their runs
    are read and statements without any are not.
    """
    wanted = places.groupBy("doc", "body").agg(F.collect_set("first").alias("_wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, bodies = numbers(batch, "doc"), numbers(batch, "body")
            out, held = [[] for _ in RUN], []
            for i, (value, asked) in enumerate(zip(batch.column("_text"), batch.column("_wanted"), strict=True)):
                data, asked = value.as_py(), asked.values.to_numpy()
                for first, last, anchors, digests in runs(data, threshold, width):
                    keep = np.isin(first, asked)
                    n = int(keep.sum())
                    for column, part in zip(
                        out, (np.full(n, docs[i]), np.full(n, bodies[i]), first[keep].astype(np.uint64), last[keep].astype(np.uint64), anchors[keep], digests[keep]), strict=True
                    ):
                        column.append(part)
                    held.extend(data[a : b + threshold] for a, b in zip(first[keep].tolist(), last[keep].tolist(), strict=True))
            if held:
                arrays = [int64(np.concatenate(c)) for c in out]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(held, pa.binary())], names=[*RUN, "bytes"])

    met = keyed.join(wanted, ["doc", "body"])
    return map_arrow(met, run, [*_longs(*RUN), T.StructField("bytes", T.BinaryType())])


def _windows(data: bytes, threshold: int) -> np.ndarray:
    return _rolled(np.frombuffer(data, np.uint8), threshold)


def _window_spans(payload: DataFrame, threshold: int) -> DataFrame:
    """Repeated windows among the different runs of one anchor, as ``(doc, body, first, last)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["anchor"]):
            anchors, digests = (table.column(c).to_numpy() for c in ("anchor", "run"))
            doc, body, first = (table.column(c).to_numpy() for c in ("doc", "body", "first"))
            edges = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1], True])
            out = [[], [], [], []]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a < 2 or (digests[a:b] == digests[a]).all():
                    continue
                each = [_windows(table.column("bytes")[i].as_py(), threshold) for i in range(a, b)]
                owner = np.repeat(np.arange(a, b), [len(x) for x in each])
                content = np.concatenate(each)
                at = np.concatenate([np.arange(len(x)) for x in each])
                order = np.lexsort((digests[owner], content))
                new = np.r_[True, content[order][1:] != content[order][:-1]]
                group = np.cumsum(new) - 1
                kinds = digests[owner][order]
                heads = np.flatnonzero(new)
                several = np.minimum.reduceat(kinds, heads) != np.maximum.reduceat(kinds, heads)
                hit = np.zeros(len(content), bool)
                hit[order] = several[group]
                rows = np.flatnonzero(hit)
                if not len(rows):
                    continue
                cut = np.r_[True, (owner[rows][1:] != owner[rows][:-1]) | (at[rows][1:] != at[rows][:-1] + 1)]
                begin = rows[cut]
                end = rows[np.r_[np.flatnonzero(cut)[1:], len(rows)] - 1]
                for column, values in zip(out, (doc[owner[begin]], body[owner[begin]], first[owner[begin]] + at[begin], first[owner[begin]] + at[end]), strict=True):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["doc", "body", "first", "last"])

    dealt = payload.repartition("anchor").sortWithinPartitions("anchor", "run")
    return map_arrow(dealt, run, _longs("doc", "body", "first", "last"))


def _joined_window_spans(payload: DataFrame, threshold: int) -> DataFrame:
    """The same for anchors with any number of different runs: a row per window, counted and joined back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "body", "first", "anchor", "run", "content"]
        for batch in batches:
            for i, value in enumerate(batch.column("bytes")):
                content = _windows(value.as_py(), threshold)
                fixed = [np.full(len(content), batch.column(c)[i].as_py(), np.int64) for c in names[:2]]
                at = batch.column("first")[i].as_py() + np.arange(len(content))
                kind = [np.full(len(content), batch.column(c)[i].as_py(), np.int64) for c in ("anchor", "run")]
                yield pa.RecordBatch.from_arrays([*map(pa.array, [*fixed, at, *kind]), int64(content)], names=names)

    windows = reliable_checkpoint(map_arrow(payload, run, _longs("doc", "body", "first", "anchor", "run", "content")))
    repeated = reliable_checkpoint(
        windows.groupBy("anchor", "content").agg(F.min("run").alias("a"), F.max("run").alias("b")).where("a <> b").select("anchor", "content")
    )
    return windows.join(repeated, ["anchor", "content"]).select("doc", "body", "first", F.col("first").alias("last"))


def repeated_windows(
    observations: DataFrame, id_col: str = "observation_id", text: str = "statement",
    threshold: int = THRESHOLD, anchor: int = ANCHOR, bits: int = 26, runs_per_task: int = RUNS,
) -> DataFrame:
    """``(doc, body, first, last)``: stretches of window starts that occur anywhere else.

    ``doc`` and ``body`` are the hashes of id and statement.  The bit maps (``2**bits`` bits each) only
    keep rows from being shuffled; rows they let through in vain change nothing.
    """
    keyed = _keyed(observations, id_col, text)
    written = reliable_checkpoint(_runs_table(keyed, threshold, anchor))
    own = written.where("anchor IS NULL").select("doc", "body", "first", "last")
    table = written.where("anchor IS NOT NULL")
    anchors = table.groupBy("anchor").agg(F.sum("copies").alias("n"), F.min("run").alias("a"), F.max("run").alias("b"))
    again = anchors.where("n > 1").select(F.col("anchor").alias("shared"), F.when(F.col("a") != F.col("b"), F.col("anchor")).alias("mixed"))
    shared, mixed = membership(again, ["shared", "mixed"], bits)
    members = reliable_checkpoint(_pruned(table, shared, mixed))
    kinds = reliable_checkpoint(
        members.groupBy("anchor", "run").agg(
            F.sum("copies").alias("n"), F.max("mixed").alias("mixed"), F.min(F.struct("doc", "body", "first")).alias("rep")
        )
    )
    whole = members.join(kinds.where("n > 1").select("anchor", "run"), ["anchor", "run"]).select("doc", "body", "first", "last")
    places = kinds.where("mixed").select("rep.doc", "rep.body", "rep.first")
    payload = _with_bytes(keyed, places, threshold, anchor)
    crowded = reliable_checkpoint(
        kinds.where("mixed").groupBy("anchor").count().where(F.col("count") > runs_per_task).select("anchor", F.lit(True).alias("crowded"))
    )
    payload = reliable_checkpoint(payload.join(crowded, "anchor", "left"))
    single = _window_spans(payload.where("crowded IS NULL").drop("crowded"), threshold)
    many = _joined_window_spans(payload.where("crowded").drop("crowded"), threshold)
    return own.unionAll(whole).unionAll(single).unionAll(many)


def _merged(spans: list[dict], threshold: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["first"], s["last"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + threshold)
        else:
            out.append([a, b + threshold])
    return [(a, b) for a, b in out]


def without_repeats(
    observations: DataFrame, id_col: str = "observation_id", text: str = "statement",
    threshold: int = THRESHOLD, **options,
) -> DataFrame:
    """Every observation with the bytes of its statement that repeated passages do not cover.

    Returns a struct ``row`` with all columns as given, and ``kept`` (BINARY), ``n_bytes``, ``n_removed``
    and ``spans`` (the removed runs as begin and end bytes).  A byte goes when a string of ``threshold``
    bytes that covers it starts anywhere else too, in another statement or in the same one; matches never
    cross statements.  Null statements are empty.  Copies of a row lose their bytes alike.
    """
    spans = (
        repeated_windows(observations, id_col, text, threshold, **options)
        .groupBy("doc", "body").agg(F.collect_set(F.struct("first", "last")).alias("_spans"))
    )
    rows = observations.select(
        F.struct("*").alias("row"), F.xxhash64(*id_key(id_col), F.lit(1)).alias("doc"),
        F.xxhash64(text).alias("body"),
    ).join(reliable_checkpoint(spans), ["doc", "body"], "left")
    # The statement travels inside its row only.
    rows = rows.select("row", F.coalesce(F.col("row").getField(text).cast("binary"), F.lit(b"")).alias("_text"), "_spans")
    fields = [
        rows.schema["row"], T.StructField("kept", T.BinaryType()), *_longs("n_bytes", "n_removed"),
        T.StructField("spans", T.ArrayType(T.StructType(_longs("begin", "end")))),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, removed, cuts = [], [], [], []
            for value, found in zip(batch.column("_text"), batch.column("_spans"), strict=True):
                data = value.as_py()
                merged = _merged(found.as_py() or [], threshold)
                edges = [0, *(x for span in merged for x in span), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                sizes.append(len(data))
                removed.append(len(data) - len(kept[-1]))
                cuts.append([{"begin": a, "end": b} for a, b in merged])
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(cuts, span)],
                names=[f.name for f in fields],
            )

    return map_arrow(rows, run, fields)


by_value(__name__)
