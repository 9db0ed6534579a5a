"""Conversation structure repair by a backward cost-to-go table and a greedy forward walk.

A conversation should read as the grammar ``(system? (user assistant)+)?`` by the initials of
its roles. Edits make it so: Keep (0), Rerole to user or assistant (2), Delete (3; required for
blank and duplicate turns), Insert an empty user or assistant turn anywhere (2); an undeleted
truncated turn adds 1. The state of the grammar is what was said last (nothing, system, user,
assistant), and in each state a letter of D, I, K, R leads to one state only.

1. Rows without their texts (turn, role, fault) are dealt and sorted by conversation. The least
   cost from each turn and state to the end is tabled backwards, and a walk from the start
   takes the least letter among the transitions that the table shows to be on a cheapest path.
   The letters are the ``audit``.
2. Rows with their texts are dealt and sorted the same way, behind their audit, and rebuilt as a
   stream.

So the first pass holds one byte a turn of one conversation (its audit, one value of the result,
is as long; the table is kept at every 4096th turn and made again between them), and the second
the audit and a batch of rows. A conversation is one task, in order, because its audit and any
hash of its turns are.

Null roles and texts are one space. Null turns come first; rows of one turn follow by role and
by the MD5 of their text; repeated rows are turns that repeat, all but the first of them duplicates.
A null conversation id is a conversation of its own. Very long texts are only streamed. Other
columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import partitions

BLANKS = " \t\n\x0b\x0c\r"
#: States: nothing, system, user, assistant said last. A user turn may follow all but a user turn.
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
#: Faults, the higher bits of a turn's kind; the lower ones tell the initial: s, u, a or another.
_BLANK, _DUPLICATE, _TRUNCATED = 1, 2, 3
_DELETE, _INSERT, _REROLE, _CUT = 3, 2, 2, 1
_FAR = 1 << 60
_BLOCK = 4096
_OTHER = 3
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_FOUND = "struct<" + ", ".join(f"{c}: long" for c in STATS) + ", audit: string>"


def _next(state: int) -> int:
    """The state after the only user or assistant turn that may follow."""
    return _ASSISTANT if state == _USER else _USER


def _kept(state: int, initial: int) -> int | None:
    """The state after a turn with this initial, if it may follow."""
    if initial == 0:
        return _SYSTEM if state == _NOTHING else None
    return initial + 1 if initial != _OTHER and initial + 1 == _next(state) else None


def _inserted(b: list[int]) -> list[int]:
    """Least costs where turns may also be inserted here."""
    user, assistant = min(b[_USER], _INSERT + b[_ASSISTANT]), min(b[_ASSISTANT], _INSERT + b[_USER])
    return [min(b[_NOTHING], _INSERT + user), min(b[_SYSTEM], _INSERT + user), user, assistant]


def _before(kind: int, after: list[int]) -> list[int]:
    """Least costs to the end from before a turn, by state, given those from behind it."""
    fault, initial = divmod(kind, 4)
    costs = []
    for state in range(4):
        least = _DELETE + after[state]
        if fault not in (_BLANK, _DUPLICATE):
            cut = _CUT * (fault == _TRUNCATED)
            to = _kept(state, initial)
            if to is not None:
                least = min(least, cut + after[to])
            least = min(least, cut + _REROLE + after[_next(state)])
        costs.append(least)
    return _inserted(costs)


def cheapest(kinds: bytes) -> tuple[int, str]:
    """Least cost, and the ASCII-least letters of the edits that have it."""
    end = _inserted([0, _FAR, _FAR, 0])
    marks = [end]  # costs at the ends of the blocks, from the last one
    starts = range(0, len(kinds), _BLOCK)
    for start in reversed(starts):
        f = marks[-1]
        for kind in reversed(kinds[start : start + _BLOCK]):
            f = _before(kind, f)
        marks.append(f)
    cost, state, audit = marks[-1][_NOTHING], _NOTHING, bytearray()
    for start, end_costs in zip(starts, reversed(marks[:-1]), strict=True):
        block = kinds[start : start + _BLOCK]
        table = [end_costs]
        for kind in reversed(block):
            table.append(_before(kind, table[-1]))
        for i, kind in enumerate(block):
            here, after = table[len(block) - i], table[len(block) - i - 1]
            state = _step(kind, state, here, after, audit)
    while end[state]:  # only insertions are left
        audit += b"I"
        state = _next(state)
    return cost, audit.decode()


def _step(kind: int, state: int, here: list[int], after: list[int], audit: bytearray) -> int:
    """Appends the least cost-tight letters up to and with the turn's own; the state behind it."""
    fault, initial = divmod(kind, 4)
    while True:
        if here[state] == _DELETE + after[state]:
            audit += b"D"
            return state
        if here[state] == _INSERT + here[_next(state)]:
            audit += b"I"
            state = _next(state)
            continue
        to = _kept(state, initial)
        if to is not None and here[state] == _CUT * (fault == _TRUNCATED) + after[to]:
            audit += b"K"
            return to
        audit += b"R"
        return _next(state)


def _illegal(kinds: bytes) -> int:
    initials = bytes(k % 4 for k in kinds)
    return max(0, len(kinds) - 1) - sum((a, b) in ((0, 1), (1, 2), (2, 1)) for a, b in zip(initials, initials[1:], strict=False))


def _found(kinds: bytes, gaps: int, known: dict) -> dict:
    """``known`` keeps the edits of short conversations, of which many are alike."""
    if kinds not in known:
        if len(kinds) > 32 or len(known) >= 1 << 16:
            known.clear()
        known[kinds] = cheapest(kinds)
    cost, audit = known[kinds]
    faults = [k // 4 for k in kinds]
    return {"gaps": gaps, "blank": faults.count(_BLANK), "duplicate": faults.count(_DUPLICATE), "truncated": faults.count(_TRUNCATED), "illegal": _illegal(kinds), "cost": cost, "audit": audit}


def _audits(batches):
    """Sorted rows (conv, turn, kind; null kind: not present) -> a row for each conversation."""
    kind_of = pa.struct([*((c, pa.int64()) for c in STATS), ("audit", pa.string())])
    conv, begun, kinds = None, False, bytearray()
    first = last = None
    distinct, known = 0, {}

    def batch(done):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], kind_of)], names=["conv", "found"])

    def done_one():
        return conv, _found(bytes(kinds), last - first + 1 - distinct if distinct else 0, known)

    for b in batches:
        done = []
        for c, turn, kind in zip(*(b.column(k).to_pylist() for k in ("conv", "turn", "kind")), strict=True):
            if begun and c != conv:
                done.append(done_one())
                kinds, first, last, distinct = bytearray(), None, None, 0
            conv, begun = c, True
            if kind is None:
                continue
            kinds.append(kind)
            if turn is not None and (not distinct or turn != last):
                first, last, distinct = (turn if not distinct else first), turn, distinct + 1
        if done:
            yield batch(done)
    if begun:
        yield batch([done_one()])


def _rows(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column) -> DataFrame:
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), present.alias("present"))
    return rows.withColumn("tie", F.md5(F.col("text").cast("binary")))


def _stats(rows: DataFrame) -> DataFrame:
    """``conv``, ``found``: counts and audit of each conversation."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.left("role", F.lit(1))), F.lit(0)), F.lit(_OTHER + 1)) - 1
    initial = F.when(F.col("role") == "", _OTHER).otherwise(initial)  # instr finds nothing in front of everything
    narrow = rows.select("conv", "turn", "role", "tie", "present", (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"), initial.alias("initial"))
    narrow = narrow.repartition(partitions(rows.sparkSession), "conv")
    again = F.row_number().over(Window.partitionBy("conv", "role", "tie", "present").orderBy("turn")) > 1
    fault = F.when(F.col("blank"), _BLANK).when(F.col("again"), _DUPLICATE).when(F.col("cut"), _TRUNCATED).otherwise(0)
    narrow = narrow.withColumn("again", again)
    judged = narrow.withColumn("kind", F.when(F.col("present"), fault * 4 + F.col("initial")))
    # a window by more columns than the rows are dealt by, and a sort: no other shuffle
    in_order = judged.sortWithinPartitions("conv", "turn", "role", "tie", "again").select("conv", "turn", "kind")
    return in_order.mapInArrow(_audits, f"conv long, found {_FOUND}")


def _rebuilt(batches):
    """Sorted rows, each conversation's audit first -> the same audit rows (place 0), each followed by its repaired turns."""
    names = ("user", "assistant")
    conv, audit, at, place, state = None, "", 0, 0, _NOTHING

    for b in batches:
        out = []

        def say(role, text):
            nonlocal place, state
            place += 1
            state = _SYSTEM if role[:1] == "s" else _USER if role[:1] == "u" else _ASSISTANT
            out.append((conv, place, role, text, None))  # noqa: B023

        def inserted():
            nonlocal at
            while audit[at : at + 1] == "I":
                say(names[_next(state) - _USER], "")
                at += 1

        for c, head, role, text in zip(*(b.column(k).to_pylist() for k in ("conv", "found", "role", "text")), strict=True):
            if head is not None:
                inserted()
                conv, audit, at, place, state = c, head["audit"], 0, 0, _NOTHING
                out.append((conv, 0, None, None, head))
                continue
            inserted()
            letter, at = audit[at], at + 1
            if letter == "K":
                say(role, text)
            elif letter == "R":
                say(names[_next(state) - _USER], text)
        if out:
            yield _batch(out)
    out = []
    while audit[at : at + 1] == "I":
        place, at = place + 1, at + 1
        state = _next(state)
        out.append((conv, place, names[state - _USER], "", None))
    if out:
        yield _batch(out)


def _batch(rows):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.struct([*((c, pa.int64()) for c in STATS), ("audit", pa.string())]))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv", "place", "role", "text", "found"])


def repair(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None,
) -> DataFrame:
    """Repaired turns: id, ``place`` (from 1), ``role``, ``text``; and for each conversation a row of place 0 with ``found``.

    ``found`` has the counts ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, the ``cost`` and the ``audit``.
    A conversation's rows stand together in their order in a partition. Rows where ``present``
    is false are no turns; they only name their conversation.
    """
    rows = _rows(df, conv_col, turn_col, role_col, text_col, F.lit(True) if present is None else F.coalesce(present, F.lit(False)))
    heads = _stats(rows).select("conv", "found", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("tie"))
    turns = rows.where("present").select("conv", F.lit(None).cast(_FOUND).alias("found"), "turn", "role", "text", "tie")
    dealt = heads.unionByName(turns).repartition(partitions(df.sparkSession), "conv")
    in_order = dealt.sortWithinPartitions("conv", F.col("found").isNull(), "turn", "role", "tie").select("conv", "found", "role", "text")
    return in_order.mapInArrow(_rebuilt, f"conv long, place long, role string, text string, found {_FOUND}").withColumnRenamed("conv", conv_col)


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Plants faults by a hash of (conversation, turn): of 20 turns, one is dropped (``present`` false), emptied, cut, repeated or given to the user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col)).cast("binary")) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.translate(said(text_col), ".!?", "")).otherwise(said(text_col))
    role = F.when(draw == 4, "user").otherwise(said(role_col))
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), (draw != 0).alias("present"), F.when(draw == 3, 2).otherwise(1).alias("_copies"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copy", "_copies")
