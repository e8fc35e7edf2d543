"""Best-fit packing of tokenized observation statements, planned over a histogram of lengths.

The plan never sees a document.  It works on how many pieces have each length (at most ``size`` counts),
places all pieces of one length at a time, longest first, into the fullest sequences that still have
room, and writes down ranges: ranks ``a`` to ``b`` of length ``n`` go to sequences from ``s`` on.  The
pieces then take their slots by joining on their rank within their length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import by_value, field, map_arrow, worker_store
from sightline.operators.ranking import ranked
from sightline.session import reliable_checkpoint

SIZE = 2048
#: Slots of one plan row that one task spells out.
SLOTS = 1 << 16
#: Words whose ids a worker remembers; the memory starts anew beyond.
REMEMBERED = 1_000_000
#: Letters that lower-casing and Unicode normalisation leave letters, one for one.
PLAIN = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
WORD_AND_MARKS = re.compile(rf"({PLAIN.pattern})([,.;:!?]+)")


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordIds(dict):
    """Ids of white-space separated words as little-endian unsigned 32-bit numbers, found when first asked for.

    The tokenizer drops white space, ignores case and merges inside runs of letters or of marks only, so a
    text's ids are its words' ids.  Plain words go to its merges directly, and a plain word with marks behind
    it is two known parts; all others go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.encoder = Tokenizer.from_file(path)
        self.merges = self.encoder.model
        self.letters = _byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        text = word.decode()
        marked = WORD_AND_MARKS.fullmatch(text)
        if marked:
            ids = self[marked[1].lower().encode()] + self[marked[2].encode()]
        elif PLAIN.fullmatch(text):
            low = text.lower()
            if not low.isascii():
                low = "".join(map(self.letters.__getitem__, low.encode()))
            ids = array("I", [t.id for t in self.merges.tokenize(low)]).tobytes()
        else:
            ids = array("I", self.encoder.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids


def _word_ids(tokenizer: str) -> WordIds:
    """This worker's ids; one set for all tasks of a tokenizer that treats words as ``WordIds`` does."""
    store = worker_store("token ids")
    if tokenizer not in store:
        store[tokenizer] = WordIds(tokenizer)
    return store[tokenizer]


def token_pieces(
    observations: DataFrame, tokenizer: str, id_col: str = "observation_id", text: str = "statement",
    size: int = SIZE, end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """``(id_col, piece, start, length, ids_crc32[, ids])`` for every piece of every statement.

    A statement's ids are those of its whole text followed by ``end_id``; null and empty statements have
    only ``end_id``.  Statements of more than ``size`` ids are cut into pieces of ``size``, the last may be
    shorter.  ``tokenizer`` is the path of a lower-casing byte-level ``tokenizers`` file, as described at
    ``WordIds``.
    """
    fields = [
        field(observations, id_col, "_id"), T.StructField("piece", T.IntegerType()),
        *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")],
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        end = np.array([end_id], "<u4").tobytes()
        known = _word_ids(tokenizer)
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                data = value.as_py() or b""
                # Special tokens are told by their case, so a text that may hold one keeps it.
                words = (data if b"<|" in data else data.lower()).split()
                whole = b"".join(map(known.__getitem__, words)) + end
                for p, a in enumerate(range(0, len(whole), 4 * size)):
                    part = whole[a : a + 4 * size]
                    row.append(i)
                    piece.append(p)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            arrays = [
                batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                *[pa.array(x, pa.int64()) for x in (start, length, crc)],
            ]
            if with_ids:
                arrays.append(pa.array(ids, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    rows = observations.select(F.col(id_col).alias("_id"), F.col(text).cast("binary").alias("_text"))
    out = map_arrow(rows, run, fields)
    return out.select(F.col("_id").alias(id_col), *[f.name for f in fields[1:]])


def plan_counts(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows ``(length, first_rank, n, first_sequence, per_sequence, offset)``.

    Sequences alike in room form ranges.  All pieces of one length go at once: the range with the least
    room that fits takes as many a sequence as it can hold, then the next; what is left opens new
    sequences.  A step splits at most one range, so the plan has few rows whatever the counts.
    """
    rooms: list[int] = []  # sorted; the ranges below have that room left
    ranges: dict[int, list[tuple[int, int]]] = {}

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in ranges:
                bisect.insort(rooms, room)
                ranges[room] = []
            ranges[room].append((first, n))

    plan, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        changed = []
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
            else:
                room, first, n = size, opened, -(-left // (size // length))
                opened += n
            per = room // length
            full = min(n, left // per)
            if full:
                plan.append((length, rank, full * per, first, per, size - room))
                changed.append((room - per * length, first, full))
                rank += full * per
                left -= full * per
            if left and full < n:
                plan.append((length, rank, left, first + full, left, size - room))
                changed.append((room - left * length, first + full, 1))
                rank += left
                left = 0
                full += 1
            add(room, first + full, n - full)
        for part in changed:
            add(*part)
    return plan


def packed(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences of at most ``size``, filled from 0 without gaps.

    Needs a column ``length`` from 1 to ``size``; rows may repeat.  Ties in length take slots in any order.
    """
    pieces = reliable_checkpoint(pieces)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    names = ["_length", "_from", "_n", "_sequence", "_per", "_at"]
    plan = pieces.sparkSession.createDataFrame(
        plan_counts(counts, size), T.StructType([T.StructField(n, T.LongType()) for n in names])
    )
    parts = plan.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / SLOTS))).alias("_part"))
    parts = parts.repartition("_length", "_from", "_part")
    low = F.col("_part") * SLOTS
    slots = parts.select(
        "*", F.explode(F.sequence(low, F.least(low + SLOTS, F.col("_n")) - 1)).alias("_i")
    ).select(
        "_length", (F.col("_from") + F.col("_i") + 1).alias("_rank"),
        (F.col("_sequence") + F.floor(F.col("_i") / F.col("_per"))).alias("sequence_id"),
        (F.col("_at") + (F.col("_i") % F.col("_per")) * F.col("_length")).alias("offset"),
    )
    order = [c for c in pieces.columns if c in ("ids_crc32", "start")] + [pieces.columns[0]]
    placed = ranked(pieces, ["length"], order, "_rank")
    return (
        placed.join(slots, (placed["length"] == slots["_length"]) & (placed["_rank"] == slots["_rank"]))
        .select(*[placed[c] for c in pieces.columns], "sequence_id", "offset")
    )


by_value(__name__)
