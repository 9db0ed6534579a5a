r"""Chat formatting with a grammar round trip.

A turn is rendered as ``### Role: text</turn>`` and a newline. ``parse`` reads such text
deterministically: a backslash makes the next character plain, an unescaped ``: `` ends a
role and an unescaped ``</turn>`` ends a text. Each turn is first rendered as it is and read
back; where the turn that comes back differs, its conflicting content is escaped further
until it is identical. The whole conversation is parsed again once it is put together.

Rows are rendered where they lie; only rendered turns are shuffled, sorted by conversation
and turn, and put together as a stream, so memory holds one conversation at a time (which is
one value of the result). Null texts and roles are empty; a null ``conv_id`` is a
conversation of its own; null turns come first; rows of one turn follow by role and text;
repeated rows are repeated turns; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import partitions

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>"
LOSS_ROLE = "assistant"
_STOP = re.compile(r"\\|" + re.escape(CLOSE))
_STOP_ROLE = re.compile(r"\\|" + re.escape(MIDDLE))


def _read(text: str, at: int, stop: re.Pattern) -> tuple[str, int, int]:
    """Unescaped content from ``at`` to the stop string; its end and the place after the stop."""
    parts = []
    while True:
        m = stop.search(text, at)
        if m is None:
            raise ValueError("unfinished turn")
        parts.append(text[at : m.start()])
        if m.group() != "\\":
            return "".join(parts), m.start(), m.end()
        if m.end() == len(text):
            raise ValueError("escape without a character")
        parts.append(text[m.end()])
        at = m.end() + 1


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start..end is the place of its escaped text."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise ValueError("no turn starts here")
        role, _, start = _read(text, at + len(OPEN), _STOP_ROLE)
        body, end, at = _read(text, start, _STOP)
        if text[at : at + 1] != "\n":
            raise ValueError("no newline after a turn")
        turns.append((role, body, start, end))
        at += 1
    return turns


#: Escapes in order of strength; the last one covers all that the grammar reads.
_ESCAPES = (
    lambda s, mark: s,
    lambda s, mark: s.replace("\\", "\\\\").replace(mark, "\\" + mark),
    lambda s, mark: re.sub(r"([^\w\s])", r"\\\1", s),
)


def render(role: str, text: str) -> str:
    """The weakest rendering of a turn that reads back as the same turn."""
    for escape in _ESCAPES:
        out = f"{OPEN}{escape(role, MIDDLE)}{MIDDLE}{escape(text, CLOSE)}{CLOSE}\n"
        try:
            back = parse(out)
        except ValueError:
            continue
        if [t[:2] for t in back] == [(role, text)]:
            return out
    raise AssertionError("no escape reads back")  # the last one always does


def _render_rows(batches):
    for b in batches:
        out = [render(r, t) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("turn"), b.column("role"), b.column("text"), pa.array(out, pa.string())], names=["conv", "turn", "role", "text", "rendered"])


_OUT = "conv long, formatted string, n_turns long, loss array<struct<start: long, end: long>>"


def _together(batches):
    """Joins the sorted rendered turns of each conversation and reads the result back."""
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    conv, pieces, source, any_row = None, [], [], False

    def done():
        text = "".join(pieces)
        turns = parse(text)
        if [t[:2] for t in turns] != source:
            raise AssertionError(f"conversation {conv} does not read back")
        return conv, text, len(turns), [{"start": s, "end": e} for r, _, s, e in turns if r == LOSS_ROLE]

    for b in batches:
        found = []
        for c, role, text, piece in zip(*(b.column(k).to_pylist() for k in ("conv", "role", "text", "rendered")), strict=True):
            if any_row and c != conv:
                found.append(done())
                pieces, source = [], []
            conv, any_row = c, True
            pieces.append(piece)
            source.append((role, text))
        if found:
            yield _batch(found, spans)
    if any_row:
        yield _batch([done()], spans)


def _batch(rows, spans):
    c, t, n, s = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(t, pa.string()), pa.array(n, pa.int64()), pa.array(s, spans)], names=["conv", "formatted", "n_turns", "loss"])


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: id, ``formatted``, ``n_turns`` and ``loss`` (spans of the assistant's escaped texts)."""
    rows = df.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rendered = rows.mapInArrow(_render_rows, "conv long, turn long, role string, text string, rendered string")
    dealt = rendered.repartition(partitions(df.sparkSession), "conv").sortWithinPartitions("conv", "turn", "role", "text")
    return dealt.mapInArrow(_together, _OUT).withColumnRenamed("conv", conv_col)
