"""Fill-in-the-middle forms of observation statements, put together by a secondary sort.

A statement is cut into units (runs of ASCII letters, and all other characters one by one) and two cuts
among them make a prefix, a middle and a suffix.  Every part leaves as pieces of a fixed number of units,
keyed by statement and place in the output, and the marks between the parts are pieces too.  One shuffle
by statement with a sort by place inside its partitions brings each output together as a stream; nothing
holds a whole output again.  Restoring reads that stream, tells the parts by the marks, and sorts the same
partitions by place in the text, without another shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sightline.llm.common import by_value, field, map_arrow

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units of a piece.
UNITS = 2048
#: Characters that one output batch gathers, at least.
BATCH = 1 << 22
#: Parts in the order of the text; a mark has no place in it.
PARTS = ("plain", "prefix", "middle", "suffix", "mark")
#: Which parts a form writes, each with its mark before it.
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
MARKS = {"prefix": PREFIX, "suffix": SUFFIX, "middle": MIDDLE}


def draws(id_col: Column, salt: int = 1) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of ``salt:id``; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def unit_starts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where units and where characters start in UTF-8 bytes, as marks."""
    b = np.frombuffer(data, np.uint8)
    low = b | 0x20
    letter = (low >= 97) & (low <= 122)  # bytes of other characters are above 127
    character = (b & 0xC0) != 0x80
    start = character.copy()
    start[1:] &= ~(letter[1:] & letter[:-1])
    return start, character


def infill_pieces(
    observations: DataFrame, id_col: str = "observation_id", text: str = "statement", salt: int = 1,
    plain_from: int = 90, spm_below: int = 20, units: int = UNITS,
) -> DataFrame:
    """``(id_col, row, place, part, seq, piece, plan)``: the output's pieces, in no order.

    ``row`` numbers the input's rows; ``place`` is the piece's place in its row's output from 0, ``part`` is
    plain, prefix, middle, suffix or mark and ``seq`` the piece's place inside its part.  ``plan``, on the
    piece at place 0 only, has ``n`` (units), ``form`` and, unless the form is plain, ``prefix_chars`` and
    ``middle_chars``.

    With ``h1`` to ``h4`` from ``draws``, the prefix ends after the smaller and the middle after the larger of
    ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units.  The form is plain for an empty text, one that holds a mark,
    and where ``h3 % 100 >= plain_from``; else spm where ``h4 % 100 < spm_below``, else psm.  Null texts are
    empty.  Repeated rows and null ids are rows of their own.  Other columns are not read.
    """
    h = [f"_h{i}" for i in range(4)]
    rows = observations.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"))
    rows = rows.select("_id", F.monotonically_increasing_id().alias("row"), "_text", *[d.alias(n) for d, n in zip(draws(F.col("_id"), salt), h, strict=True)])
    plan = T.StructType([
        T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
    ])
    fields = [
        field(rows, "_id", "_id"), T.StructField("row", T.LongType()), T.StructField("place", T.IntegerType()),
        T.StructField("part", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("piece", T.BinaryType()), T.StructField("plan", plan),
    ]
    marks = [m.encode() for m in MARKS.values()]

    def parts(data: bytes, draw: list[int]) -> tuple[dict, list[tuple[str, int, bytes]]]:
        start, character = unit_starts(data)
        at = np.r_[np.flatnonzero(start), len(data)]
        n = len(at) - 1
        form = "spm" if draw[3] % 100 < spm_below else "psm"
        if not data or draw[2] % 100 >= plain_from or any(m in data for m in marks):
            form = "plain"
        said = {"n": n, "form": form, "prefix_chars": None, "middle_chars": None}

        def cut(part: str, a: int, b: int) -> Iterator[tuple[str, int, bytes]]:
            for seq, u in enumerate(range(a, b, units)):
                yield part, seq, data[at[u] : at[min(u + units, b)]]

        if form == "plain":
            return said, [*cut("plain", 0, n)] or [("plain", 0, b"")]
        a, b = sorted((draw[0] % (n + 1), draw[1] % (n + 1)))
        said["prefix_chars"], said["middle_chars"] = int(character[: at[a]].sum()), int(character[at[a] : at[b]].sum())
        ends = {"prefix": (0, a), "middle": (a, b), "suffix": (b, n)}
        out: list[tuple[str, int, bytes]] = []
        for part in ORDERS[form]:
            out.append(("mark", 0, MARKS[part].encode()))
            out += cut(part, *ends[part])
        return said, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draw = list(zip(*[batch.column(n).to_pylist() for n in h], strict=True))
            number = batch.column(1)
            at, place, kind, seq, piece, said, held = [], [], [], [], [], [], 0

            def gathered(batch=batch, number=number):
                rows_ = pa.array(at, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows_), number.take(rows_), pa.array(place, pa.int32()), pa.array(kind, pa.string()),
                        pa.array(seq, pa.int32()), pa.array(piece, pa.binary()), pa.array(said, arrow_plan),
                    ],
                    names=[f.name for f in fields],
                )

            for i, value in enumerate(batch.column(2)):
                data = value.as_py()
                plan_, cut = parts(data, draw[i])
                for p, (k, s, d) in enumerate(cut):
                    at.append(i)
                    place.append(p)
                    kind.append(k)
                    seq.append(s)
                    piece.append(d)
                    said.append(None if p else plan_)
                held += len(data)
                if held >= BATCH:
                    yield gathered()
                    at, place, kind, seq, piece, said, held = [], [], [], [], [], [], 0
            if at:
                yield gathered()

    arrow_plan = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])
    return map_arrow(rows, run, fields).withColumnRenamed("_id", id_col)


def in_output_order(pieces: DataFrame) -> DataFrame:
    """The pieces with each row's in one partition, in the order of the output: its text is their ``piece`` in turn."""
    return pieces.repartition("row").sortWithinPartitions("row", "place")


def infill_texts(pieces: DataFrame) -> DataFrame:
    """``(*id, row, form, output)``: the outputs as text, one row per statement."""
    id_col = pieces.columns[0]
    fields = [pieces.schema[id_col], pieces.schema["row"], T.StructField("form", T.StringType()), T.StructField("output", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def text():
            ids, row, form, parts = held[0]
            return pa.RecordBatch.from_arrays([ids, pa.array([row]), pa.array([form]), pa.array([b"".join(parts).decode()])], names=[f.name for f in fields])

        for batch in batches:
            for i, (row, piece, plan) in enumerate(zip(*_columns(batch, "row", "piece", "plan"), strict=True)):
                if plan is not None:
                    if held:
                        yield text()
                    held[:] = [(batch.column(0).slice(i, 1), row, plan["form"], [])]
                held[0][3].append(piece)
        if held:
            yield text()

    return map_arrow(in_output_order(pieces), run, fields)


def _columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def infill_digests(pieces: DataFrame) -> DataFrame:
    """``(*id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)``, one row per statement.

    The first stream reads pieces in output order, adds them to the output's digest and tells from the form
    and the marks alone to which part of the text a piece belongs and where in it; ``part`` and ``seq`` are
    not read.  The second reads the same partitions sorted that way and adds up the restored text's digest.
    One statement's digest is one stream, however many pieces it has.
    """
    id_col = pieces.columns[0]
    told = {m.encode(): PARTS.index(p) for p, m in MARKS.items()}
    known = [pieces.schema[id_col], *pieces.schema["plan"].dataType.fields, T.StructField("output_sha256", T.StringType())]
    middle = [
        T.StructField("row", T.LongType()), T.StructField("of", T.IntegerType()), T.StructField("turn", T.IntegerType()),
        T.StructField("piece", T.BinaryType()), T.StructField("whole", T.StructType(known)),
    ]

    def end(now: dict) -> tuple:
        return now["row"], len(PARTS), 0, None, now["whole"] | {"output_sha256": now["digest"].hexdigest()}

    def output(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for row, id_, piece, plan in zip(batch.column("row").to_pylist(), batch.column(0).to_pylist(), *_columns(batch, "piece", "plan"), strict=True):
                if plan is not None:
                    if now:
                        out.append(end(now))
                    now = {"row": row, "of": 0, "turn": 0, "digest": hashlib.sha256(), "whole": {id_col: id_, **plan}, "plain": plan["form"] == "plain"}
                now["digest"].update(piece)
                # Texts that hold a mark are plain, and a mark is always a piece of its own.
                if not now["plain"] and piece in told:
                    now["of"], now["turn"] = told[piece], 0
                else:
                    now["turn"] += 1
                    out.append((row, now["of"], now["turn"], piece, None))
            yield _batch(middle, out)
        if now:
            yield _batch(middle, [end(now)])

    last = [T.StructField("whole", T.StructType([*known, T.StructField("restored_sha256", T.StringType())]))]

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256()
        for batch in batches:
            done = []
            for piece, whole in zip(*_columns(batch, "piece", "whole"), strict=True):
                if whole is None:
                    digest.update(piece)
                else:
                    done.append(whole | {"restored_sha256": digest.hexdigest()})
                    digest = hashlib.sha256()
            yield _batch(last, [(d,) for d in done])

    told_order = map_arrow(in_output_order(pieces), output, middle).sortWithinPartitions("row", "of", "turn")
    return map_arrow(told_order, restored, last).select("whole.*")


def _batch(fields: list[T.StructField], rows: list[tuple]) -> pa.RecordBatch:
    schema = to_arrow_schema(T.StructType(fields))
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


by_value(__name__)
