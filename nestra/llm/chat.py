"""Chat formatting by prefix-target expansion.

A turn is formatted as ``<|turn|>role<|text|>text<|end|>``. Control strings inside roles and texts, those of this
template and the common others, get one backslash after their first character, one more if some stand there
already; taking one away again is exact, so formatting is reversible.

``expand`` gives one row per turn, in order within its conversation, with the offset of its segment in the
conversation's formatted text. An assistant turn's row is an example of its own: its context is everything
before its offset (all preceding turns), its target is its own segment, and only the reply between ``loss_from``
and ``loss_to`` is trainable. Contexts are shared prefixes, not copies: a conversation of n turns takes n rows,
not n * n / 2 texts, and may hold a third of all rows. ``examples`` writes all of them out, ``render`` chosen ones,
and ``digest`` reads the written examples back.

A conversation's rows meet in one sorted stream that is read row by row; a task that writes examples holds the text
of one conversation.

Cases: null texts and roles are empty. Turns are ordered by number, nulls first, then by role and text, so
repeated turns are kept in a defined order. A null conv_id is a conversation. Conversations without an
assistant turn have no example but keep their rows. Extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TRAINED = "assistant"
# The control strings that are escaped begin with < or [ and go on with one of these.
_AFTER = r"(\||/?INST\]|/?s>|</?SYS>>)"
_ESCAPE, _UNESCAPE = rf"([<\[])(\\*){_AFTER}", rf"([<\[])\\(\\*){_AFTER}"
_UNESCAPER = re.compile(_UNESCAPE)


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPE, r"$1\\$2$3")


def unescape(text: str) -> str:
    return _UNESCAPER.sub(r"\1\2\3", text)


def segments(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, segment, loss_from, loss_to): each turn formatted; loss offsets in the segment, else null."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head, body = F.concat(F.lit(TURN), escape(role), F.lit(TEXT)), escape(text)
    trained = role == TRAINED
    start = F.char_length(head).cast("long")
    return conversations.select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.concat(head, body, F.lit(END)).alias("segment"),
        F.when(trained, start).alias("loss_from"),
        F.when(trained, start + F.char_length(body)).alias("loss_to"),
    )


_EXPANDED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("segment", T.StringType()),
        T.StructField("place", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("example", T.LongType()),
        T.StructField("loss_from", T.LongType()),
        T.StructField("loss_to", T.LongType()),
    ]
)


def expand(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation stand together and in order: conv_id, turn, segment, place (from 0), offset (code
    points of context before it), example (number of the example whose target it is, from 0, else null),
    loss_from and loss_to (trainable code points, counted from the start of the conversation)."""
    plain = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))  # the order is that of the texts, not of their escaped forms
    turns = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", *plain)
    turns = segments(turns).withColumn("n", F.char_length("segment").cast("long"))
    turns = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "segment", "loss_from", "loss_to", "n")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, place, offset, example = object(), 0, 0, 0
        for batch in batches:
            rows = [batch.column(i).to_pylist() for i in (0, 3, 4, 5)]
            out: list[list] = [[], [], [], [], []]
            for conv, start, end, n in zip(*rows):
                if conv != here:
                    here, place, offset, example = conv, 0, 0, 0
                trained = start is not None
                for column, value in zip(out, (place, offset, example if trained else None, offset + start if trained else None, offset + end if trained else None)):
                    column.append(value)
                place, offset, example = place + 1, offset + n, example + trained
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.int64()) for c in out)], names=_EXPANDED.names)

    return turns.mapInArrow(number, _EXPANDED)


_EXAMPLE = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("example", T.LongType()), T.StructField("text", T.StringType()), T.StructField("loss_from", T.LongType()), T.StructField("loss_to", T.LongType())])


def examples(expanded: DataFrame, most_chars: int | None = None, rest: bool = False) -> DataFrame:
    """Every example written out: conv_id, example, text (all preceding turns, then the reply), loss_from, loss_to.

    A conversation's rows come in order, so a task holds the text of one conversation so far and writes an example
    at each assistant turn, one at a time. The text repeats its context, so its size grows with the square of a
    conversation's length. With ``most_chars`` a longer context loses its oldest whole turns (the target stays).
    With ``rest`` a conversation that ends on other turns has a last row, a context without target: example, loss_from
    and loss_to are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: object = object()
        turns: deque[str] = deque()
        size = dropped = open_ = 0
        for batch in batches:
            for conv, segment, example, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 5, 6, 7))):
                if conv != here:
                    if open_ and rest:
                        yield _example(here, None, "".join(turns), None, None)
                    here, size, dropped = conv, 0, 0
                    turns.clear()
                turns.append(segment)
                size += len(segment)
                while most_chars is not None and size > most_chars and len(turns) > 1:
                    size -= len(turns[0])
                    dropped += len(turns.popleft())
                open_ = example is None
                if not open_:
                    yield _example(conv, example, "".join(turns), start - dropped, end - dropped)
        if open_ and rest:
            yield _example(here, None, "".join(turns), None, None)

    return expanded.mapInArrow(run, _EXAMPLE)


def _example(*row) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], pa.string() if i == 2 else pa.int64()) for i, v in enumerate(row)], names=_EXAMPLE.names)


def render(expanded: DataFrame, chosen: DataFrame) -> DataFrame:
    """:func:`examples` of those in ``chosen`` (conv_id, example)."""
    convs = chosen.select("conv_id").distinct()
    rows = expanded.join(F.broadcast(convs), expanded["conv_id"].eqNullSafe(convs["conv_id"]), "left_semi") if convs.limit(100_001).count() <= 100_000 else expanded
    wanted = chosen.select(F.col("conv_id").alias("c"), F.col("example").alias("e"))
    out = examples(rows)
    return out.join(wanted, out["conv_id"].eqNullSafe(wanted["c"]) & (out["example"] == wanted["e"]), "left_semi")


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn, unescaped."""
    if not (segment.startswith(TURN) and segment.endswith(END)):
        raise ValueError(f"not a turn: {segment[:40]!r}")
    role, mark, text = segment[len(TURN) : -len(END)].partition(TEXT)
    if not mark:
        raise ValueError(f"no text mark: {segment[:40]!r}")
    return unescape(role), unescape(text)


_DIGEST = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
        T.StructField("n_examples", T.LongType()),
    ]
)


def digest(expanded: DataFrame) -> DataFrame:
    """Per conversation, read back from its written examples: turns, trained text and sizes.

    An example's context has to be the whole text of the example before, and what follows that is parsed; the trained
    text is what its loss mask shows."""

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list | None = None
        before = ""
        for batch in batches:
            done = []
            for row in range(batch.num_rows):  # one text at a time, as texts are long
                conv, text, start, end = (batch.column(i)[row].as_py() for i in (0, 2, 3, 4))
                if open_ is None or open_[0] != conv:
                    if open_ is not None:
                        done.append(open_)
                    open_, before = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0], ""
                if not (text.startswith(before) and text.endswith(END)):
                    raise ValueError(f"conversation {conv}: a context is not the text before it")
                for segment in text[len(before) : -len(END)].split(END):
                    role, said = parse(segment + END)
                    open_[1] += 1
                    open_[2].update(f"{role}\n{said}\n".encode())
                if start is not None:
                    trained = unescape(text[start:end])
                    open_[3] += len(trained)
                    open_[4].update(trained.encode())
                    open_[6] += 1
                open_[5], before = len(text), text
            if done:
                yield _rows(done)
        if open_ is not None:
            yield _rows([open_])

    return examples(expanded, rest=True).mapInArrow(read_back, _DIGEST)


def _rows(done: list[list]) -> pa.RecordBatch:
    flat = [[x.hexdigest() if hasattr(x, "hexdigest") else x for x in row] for row in done]
    kinds = [pa.string() if f.dataType == T.StringType() else pa.int64() for f in _DIGEST]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*flat), kinds)], names=_DIGEST.names)
