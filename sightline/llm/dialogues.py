r"""Review dialogues as training text: turns of typed parts, control marks, loss masks, and the way back.

A turn of a review (an analyst's question, an assistant's answer) is a list of parts: text, or an image,
audio clip or document among the case's artifacts.  A visitor goes over a turn's parts in order: text is
escaped and written, any other part becomes a numbered placeholder, its artifact is recorded as a
reference, and its placeholder counts for as many tokens as the model will put in its place.

The template writes ``<|turn|>role\n``, the parts, ``<|end|>\n``.  Inside roles and texts a backslash is
doubled and every control string gets one after its first character, so no text can open or close a turn
and nothing is lost; removing single backslashes gives the text back.

Formatting works on one turn at a time.  Only digests over whole dialogues need the turns in order: they
run over rows sorted by dialogue and turn and carry a hash, not the turns, so a dialogue of any length
takes constant memory.  Its own turns still pass through one task, because SHA-256 is sequential.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import by_value, field, map_arrow

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Strings that templates of this and other kinds give a meaning; escaped in roles and texts.
CONTROLS = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Roles whose text is trained on.
TRAINED = ("assistant",)
#: Tokens that stand for one part of each kind; a document has that many per page.
EXPANDED = {"image": 576, "audio": 750, "document": 1024}

PART = "kind STRING, text STRING, artifact_id STRING, media_type STRING, pages INT"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """One text part, for turns that have nothing else."""
    null = F.lit(None)
    return F.array(F.struct(
        F.lit("text").alias("kind"), text.alias("text"), null.cast("string").alias("artifact_id"), null.cast("string").alias("media_type"),
        null.cast("int").alias("pages"),
    ))


def visit(parts: Column, expanded: dict[str, int] = EXPANDED) -> tuple[Column, Column, Column]:
    """The flat text of a turn's parts, the references in order, and the tokens placeholders stand for.

    Kinds other than ``text`` and those of ``expanded`` are kept as placeholders of no tokens.
    """
    parts = F.coalesce(parts, F.array().cast(f"array<struct<{PART.replace(' STRING', ':string').replace(' INT', ':int')}>>"))
    attached = F.filter(parts, lambda p: ~p["kind"].eqNullSafe("text"))
    kind = lambda p: F.coalesce(F.regexp_replace(p["kind"], "[^a-z]", ""), F.lit(""))

    def written(p: Column, i: Column) -> Column:
        number = F.size(F.filter(F.slice(parts, F.lit(1), i), lambda q: ~q["kind"].eqNullSafe("text")))
        return F.when(p["kind"].eqNullSafe("text"), escaped(F.coalesce(p["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<|"), kind(p), F.lit(":"), number.cast("string"), F.lit("|>"))
        )

    def needed(name: str, each: int) -> Column:
        units = F.transform(attached, lambda p: F.when(p["kind"] == name, F.coalesce(p["pages"], F.lit(1)) if name == "document" else F.lit(1)))
        return each * F.aggregate(units, F.lit(0).cast("bigint"), lambda total, n: total + F.coalesce(n, F.lit(0)))

    tokens = sum((needed(name, each) for name, each in expanded.items()), F.lit(0).cast("bigint"))
    references = F.transform(
        attached, lambda p, i: F.struct(i.alias("number"), kind(p).alias("kind"), p["artifact_id"].alias("artifact_id"), p["media_type"].alias("media_type"))
    )
    return F.concat_ws("", F.transform(parts, written)), references, tokens


def format_turns(
    turns: DataFrame, dialogue: str = "candidate_id", turn: str = "seq", role: str = "role", parts: str = "parts", trained: Sequence[str] = TRAINED,
) -> DataFrame:
    """``(dialogue, turn, segment, loss_from, loss_to, attachments, expanded_tokens)``, one row per turn.

    A dialogue's formatted text is its segments in turn order.  ``loss_from`` and ``loss_to`` are code
    points of the segment: the escaped parts of a trained role, empty otherwise.  Null roles, parts and
    texts count as empty.  Repeated rows are turns of their own.
    """
    flat, references, tokens = visit(F.col(parts))
    name = F.coalesce(F.col(role), F.lit(""))
    head = F.concat(F.lit(OPEN), F.replace(escaped(name), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    body = turns.select(
        F.col(dialogue).alias("_d"), F.col(turn).alias("_t"), head.alias("head"), flat.alias("flat"), references.alias("attachments"),
        tokens.alias("expanded_tokens"), name.isin(*trained).alias("trained"),
    )
    start = F.char_length("head").cast("bigint")
    end = start + F.when(F.col("trained"), F.char_length("flat")).otherwise(F.lit(0))
    return body.select(
        F.col("_d").alias(dialogue), F.col("_t").alias(turn), F.concat("head", "flat", F.lit(CLOSE)).alias("segment"),
        start.alias("loss_from"), end.cast("bigint").alias("loss_to"), "attachments", "expanded_tokens",
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``role``, ``text`` and ``loss_text`` read back from its segments.

    Only the segment and its mask are used: the role ends at the first line end without a backslash.
    Placeholders stay as they are written; texts and roles are as they were before escaping.
    """
    inner = F.col("segment").substr(F.lit(len(OPEN) + 1), F.char_length("segment") - F.lit(len(OPEN) + len(CLOSE)))
    role = F.regexp_extract(inner, r"(?s)^((?:[^\\\n]++|\\.)*+)\n", 1)
    masked = F.col("segment").substr((F.col("loss_from") + 1).cast("int"), (F.col("loss_to") - F.col("loss_from")).cast("int"))
    return formatted.select(
        "*", unescaped(role).alias("role"),
        unescaped(inner.substr(F.char_length(role) + 2, F.char_length("segment"))).alias("text"), unescaped(masked).alias("loss_text"),
    )


def dialogue_digests(read: DataFrame, dialogue: str = "candidate_id", turn: str = "seq") -> DataFrame:
    """``(dialogue, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` per dialogue.

    ``turns_sha256`` runs over role, line end, text, line end of each turn; ``loss_sha256`` over all loss
    texts with nothing between.  Turns of equal number follow each other by role and text.
    """
    names = [dialogue, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    fields = [field(read, dialogue, dialogue)] + [
        T.StructField(n, T.StringType() if n.endswith("256") else T.LongType()) for n in names[1:]
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, begun, done = None, False, []
        state = None

        def close():
            n, turns, chars, loss, size = state
            done.append((current, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            keys = batch.column("_d").to_pylist()
            columns = zip(*[batch.column(c) for c in ("role", "text", "loss_text", "_size")], strict=True)
            for key, (role, text, loss, size) in zip(keys, columns, strict=True):
                if not begun or key != current:
                    if begun:
                        close()
                    current, begun, state = key, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                masked = loss.as_py()
                state[0] += 1
                state[1].update(f"{role.as_py()}\n{text.as_py()}\n".encode())
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += size.as_py()
            if len(done) > 1000:
                yield _batch(done, fields)
                done.clear()
        if begun:
            close()
            yield _batch(done, fields)

    rows = read.select(F.col(dialogue).alias("_d"), F.col(turn).alias("_t"), "role", "text", "loss_text", F.char_length("segment").cast("bigint").alias("_size"))
    return map_arrow(rows.repartition("_d").sortWithinPartitions("_d", "_t", "role", "text"), run, fields)


def _batch(rows: list[tuple], fields: list[T.StructField]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.RecordBatch.from_arrays(
        [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], names=[f.name for f in fields]
    )


by_value(__name__)
