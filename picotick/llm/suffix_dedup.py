"""Suffix-array dedup of repeated byte passages by deep-shallow sorting.

A byte is removed if a ``width``-byte string that starts at or before it and covers it also
starts earlier: in a document with a smaller id, or earlier in the same one. Strings are
judged on the input and never cross documents.

Shipping every suffix with its first ``width`` bytes would move a corpus a hundred times. So
suffixes travel in *runs* (``_windows``): neighbours whose strings share an anchor, about 40
suffixes in 140 bytes. Equal strings have equal anchors, which gives

1. a filter: suffixes whose 24-byte anchor occurs once in the corpus repeat nothing. That is
   all that a fingerprint decides;
2. a partitioning: runs of one anchor meet in one task, as bytes, and are sorted there by
   deep-shallow sorting, which alone decides what repeats. A leaf of the sort with several
   runs is one byte string: all but its first are repeated. Where runs of an anchor differ,
   their suffixes are regrouped by an anchor of 88 bytes and sorted again, and those that
   differ still by all ``width`` bytes, one suffix a run; all in the same task.

``deep_shallow`` is multikey quicksort on eight-byte characters down to a shallow depth; what
is still equal there goes, group by group, into a blind trie (``BlindTrie``).

Tasks sort their own runs before the shuffle too, so a passage that very many documents share
arrives once a batch. An anchor with many different runs in one batch is *hot*: it is regrouped
there by the longer anchor, and two of its runs tell the others of that anchor to be regrouped
and shuffled again as well, so no anchor, however common, gathers its runs in one task. Memory
is bounded by ``SORTED_AT_ONCE`` runs and one text (about 30 bytes for each of its bytes).

Null texts are empty; null ids come before all others; rows that repeat id and text are one
document (each gets its result), rows that repeat only the id are ordered by a hash of the
text; extra columns are carried if ``keep`` names them; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._hashing import BYTES, U, chunks, concatenated_ranges, covered, mix, segments
from ._spark import id_back, partitions, stored
from ._windows import MOST_CONTENTS, batch, compressed, edges, flagged_texts, open_ranges, packed_flags, signed, tagged, without

WIDTH = 100
ANCHOR = 24
#: Levels of regrouping: by ANCHOR bytes, by all but FINER of the width, by the whole string.
FINER, LAST = 12, 2
DONE = LAST + 1
SHALLOW = 16
#: Runs sorted at once in a task, and regrouped at once.
SORTED_AT_ONCE, REGROUPED_AT_ONCE = 100_000, 5_000


def _characters(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, in the order of the bytes."""
    eights = np.lib.stride_tricks.sliding_window_view(text, 8)
    return np.ascontiguousarray(eights[at]).view(">u8").ravel().astype(U)


def multikey_quicksort(characters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts rows of characters: their order, and where a row differs from the one before.

    Each round splits every unsettled range into rows whose current character is below, at or
    above the range's pivot (a median of three); the middle part goes on to its next character.
    """
    n, most = characters.shape
    order, fresh = np.arange(n), np.zeros(n, dtype=bool)
    fresh[:1] = True
    start, size, depth = (np.array([x], dtype=np.int64) for x in (0, n, 0))
    while True:
        go = (size > 1) & (depth < most)
        start, size, depth = start[go], size[go], depth[go]
        if not len(start):
            return order, fresh
        slots = concatenated_ranges(start, size)
        owner = np.repeat(np.arange(len(start)), size)
        rows = order[slots]
        key = characters[rows, depth[owner]]
        head = np.cumsum(size) - size
        three = np.stack([key[head], key[head + size // 2], key[head + size - 1]])
        pivot = np.sort(three, axis=0)[1]
        side = (key >= pivot[owner]).astype(np.int8) + (key > pivot[owner])
        count = np.bincount(owner * 3 + side, minlength=3 * len(start)).reshape(-1, 3)
        first = start[:, None] + np.cumsum(count, axis=1) - count
        for c in range(3):
            order[concatenated_ranges(first[:, c], count[:, c])] = rows[side == c]
        fresh[first[count > 0]] = True
        start, size, depth = first.ravel(), count.ravel(), (depth[:, None] + np.array([0, 1, 0])).ravel()


class BlindTrie:
    """Orders strings of one length: inner nodes hold only where their strings first differ.

    A string goes down by the bytes at those places alone, meets one leaf, and is compared
    with that leaf's string once; the first byte in which they differ is its place in the trie.
    """

    def __init__(self):
        self.root = None

    def add(self, text: bytes, member: int) -> None:
        if self.root is None:
            self.root = (text, [member])
            return
        node = self.root
        while isinstance(node[1], dict):
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        if node[0] == text:
            node[1].append(member)
            return
        place = _first_difference(node[0], text)
        above, node_here = None, self.root
        while isinstance(node_here[1], dict) and node_here[0] < place:
            above, node_here = node_here, node_here[1][text[node_here[0]]]
        if isinstance(node_here[1], dict) and node_here[0] == place:
            node_here[1][text[place]] = (text, [member])
            return
        branch = (place, {node[0][place]: node_here, text[place]: (text, [member])})
        if above is None:
            self.root = branch
        else:
            above[1][text[above[0]]] = branch

    def leaves(self) -> list[list[int]]:
        """The members of each leaf, in the order of their strings."""
        out, open_ = [], [self.root] if self.root else []
        while open_:
            node = open_.pop()
            if isinstance(node[1], dict):
                open_ += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out.append(node[1])
        return out


def _first_difference(a: bytes, b: bytes) -> int:
    low, high = 0, len(a)  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def deep_shallow(text: np.ndarray, suffixes: np.ndarray, depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorts suffixes by their first ``depth`` bytes (at least ``shallow``, a multiple of 8).

    Returns their order and a mask that is True where a suffix differs from the one before.
    """
    n = len(suffixes)
    if not n:
        return np.arange(0), np.zeros(0, dtype=bool)
    order, fresh = multikey_quicksort(np.stack([_characters(text, suffixes + d) for d in range(0, shallow, 8)], axis=1))
    if depth == shallow:
        return order, fresh
    whole = text.tobytes()
    start = np.flatnonzero(fresh)
    size = np.diff(np.append(start, n))
    for at, m in zip(start[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        rows = order[at : at + m].tolist()
        trie = BlindTrie()
        for row, s in zip(rows, suffixes[order[at : at + m]].tolist(), strict=True):
            trie.add(whole[s + shallow : s + depth], row)
        for members in trie.leaves():
            order[at : at + len(members)] = members
            fresh[at] = True
            at += len(members)
    return order, fresh


# what travels -------------------------------------------------------------------------------

#: A run's bytes are ``run``; level DONE marks settled repeats (windows lo..lo+len-1), without
#: bytes; a level plus HOT is a run that stands for many of its anchor.
HOT = 8
RUN = "key long, doc long, tag int, lo int, len int, level byte, run binary"


class Runs:
    """Runs of one batch: a row of columns for each, and its bytes data[start:end]."""

    def __init__(self, key, doc, tag, lo, size, data: bytes, start, end):
        self.key, self.doc, self.tag, self.lo, self.size, self.data, self.start, self.end = key, doc, tag, lo, size, data, start, end

    def take(self, rows) -> Runs:
        return Runs(*(x[rows] for x in (self.key, self.doc, self.tag, self.lo, self.size)), self.data, self.start[rows], self.end[rows])

    def bytes(self) -> bytes:
        return b"".join([self.data[s:e] for s, e in zip(self.start.tolist(), self.end.tolist(), strict=True)])

    def rows(self, level: int) -> pa.RecordBatch:
        n = len(self.key)
        if level == DONE:  # settled rows travel under keys of their own, so they spread over all tasks
            key, run = mix(self.doc.astype(U) * U(7919) + self.lo.astype(U)), pa.nulls(n, pa.binary())
        else:
            offsets = np.concatenate(([0], np.cumsum(self.end - self.start))).astype(np.int32)
            key, run = self.key, pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.bytes())])
        return batch(
            key=signed(key), doc=self.doc, tag=self.tag.astype(np.int32), lo=self.lo.astype(np.int32), len=self.size.astype(np.int32),
            level=np.full(n, level, np.int8), run=run)

    def regrouped(self, level: int, width: int) -> Runs:
        """The same windows in runs of that level's anchor."""
        return joined([self.take(slice(at, at + REGROUPED_AT_ONCE))._regrouped(level, width) for at in range(0, len(self.key), REGROUPED_AT_ONCE)])

    def _regrouped(self, level: int, width: int) -> Runs:
        data = self.bytes()
        last = np.cumsum(self.end - self.start)
        first = last - (self.end - self.start)
        sums = BYTES.sums(np.frombuffer(data, dtype=np.uint8))
        i, key, lo, hi = segments(BYTES, sums, first, last, width, (ANCHOR, width - FINER, width)[level])
        return Runs(key, self.doc[i], self.tag[i], lo - first[i] + self.lo[i], hi - lo + 1, data, lo, hi + width)

    def sorted(self) -> tuple[Runs, np.ndarray, np.ndarray]:
        """In the order of bytes and then of places; where a new string begins; which rows repeat its first one's place."""
        size = self.end - self.start
        most = int(-(-size.max() // 8) * 8)
        eights = np.lib.stride_tricks.sliding_window_view(np.frombuffer(self.data + b"\0" * (most + 8), dtype=np.uint8), 8)
        table = np.zeros((len(size), most // 8 + 1), dtype="<u8")
        for at in range(0, most, 8):
            rest = np.clip(size - at, 0, 8)
            block = np.ascontiguousarray(eights[self.start + at]).view("<u8").ravel()
            table[:, at // 8] = np.where(rest > 0, block & (U(0xFFFFFFFFFFFFFFFF) >> (64 - 8 * np.maximum(rest, 1)).astype(U)), U(0))
        table[:, -1] = size  # a string and its longer self differ
        order, fresh = deep_shallow(table.view(np.uint8).ravel(), np.arange(len(size)) * (most + 8), most + 8)
        order = order[np.lexsort((self.lo[order], self.tag[order], self.doc[order], np.cumsum(fresh)))]
        found = self.take(order)
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        again = ~fresh & (found.doc == found.doc[head]) & (found.tag == found.tag[head]) & (found.lo == found.lo[head])
        return found, fresh, again


def joined(parts: list[Runs]) -> Runs:
    if len(parts) == 1:
        return parts[0]
    columns = [np.concatenate([getattr(p, c) for p in parts]) for c in ("key", "doc", "tag", "lo", "size")]
    ahead = np.cumsum([0, *(len(p.data) for p in parts)])
    start, end = (np.concatenate([getattr(p, c) + a for p, a in zip(parts, ahead, strict=False)]) for c in ("start", "end"))
    return Runs(*columns, b"".join([p.data for p in parts]), start, end)


def _before_shuffle(runs: Runs, level: int, width: int):
    """RUN rows of a task's own runs: the first of each string, and ranges settled as repeated."""
    for at in range(0, len(runs.key), SORTED_AT_ONCE):
        found, fresh, again = runs.take(slice(at, at + SORTED_AT_ONCE)).sorted()
        gone = np.flatnonzero(~fresh & ~again)
        if len(gone):
            yield found.take(gone).rows(DONE)
        heads = np.flatnonzero(fresh)
        if level < LAST:
            _, group, count = np.unique(found.key[heads], return_inverse=True, return_counts=True)
            many = count[group] > MOST_CONTENTS
            if many.any():
                by_key = np.argsort(group, kind="stable")
                nth = np.empty(len(heads), dtype=np.int64)
                nth[by_key] = np.arange(len(heads)) - np.repeat(np.cumsum(count) - count, count)
                yield from _before_shuffle(found.take(heads[many]).regrouped(level + 1, width), level + 1, width)
                yield found.take(heads[many & (nth < 2)]).rows(level + HOT)
                heads = heads[~many]
        if len(heads):
            yield found.take(heads).rows(level)


def _shared(runs: Runs, rows: np.ndarray) -> list[np.ndarray]:
    """Those of the rows whose anchor is in several, in parts that hold whole anchors."""
    _, group, count = np.unique(runs.key[rows], return_inverse=True, return_counts=True)
    several = count[group] > 1
    rows, group = rows[several], group[several]
    order = np.argsort(group, kind="stable")
    rows, group = rows[order], group[order]
    cuts, at = [], np.flatnonzero(np.diff(group)) + 1
    for c in at.tolist():
        if c - (cuts[-1] if cuts else 0) >= SORTED_AT_ONCE // 4:
            cuts.append(c)
    return np.split(rows, cuts) if len(rows) else []


def _settled_here(runs: Runs, level: int, width: int):
    """RUN rows of what repeats among runs of which all with their anchors are at hand."""
    runs = runs.regrouped(level, width)
    for part in _shared(runs, np.arange(len(runs.key))):
        found, fresh, again = runs.take(part).sorted()
        gone = np.flatnonzero(~fresh & ~again)
        if len(gone):
            yield found.take(gone).rows(DONE)
        if level < LAST:
            for heads in _shared(found, np.flatnonzero(fresh)):
                yield from _settled_here(found.take(heads), level + 1, width)


class Settler:
    """Sorts a task's runs anchor by anchor, in parts of about SORTED_AT_ONCE rows.

    An anchor that does not fit in a part goes on to the next level whole; on the last level,
    where its runs are one string, that string's first place is carried to the next part.
    """

    def __init__(self, level: int, width: int):
        self.level, self.width = level, width
        self.held: list[pa.RecordBatch] = []
        self.n = 0
        self.goes_on = False
        self.carry: list[Runs] = []

    def add(self, b: pa.RecordBatch):
        self.held.append(b)
        self.n += b.num_rows
        if self.n < SORTED_AT_ONCE:
            return
        whole = pa.Table.from_batches(self.held).combine_chunks().to_batches()[0]
        key = whole.column("key").to_numpy()
        cut = int(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[-1])
        self.held = [whole.slice(cut)] if cut else []
        self.n = whole.num_rows - cut if cut else 0
        yield from self._part(whole.slice(0, cut) if cut else whole, more=not cut)

    def finish(self):
        if self.n:
            yield from self._part(pa.Table.from_batches(self.held).combine_chunks().to_batches()[0], more=False)

    def _part(self, b: pa.RecordBatch, more: bool):
        key, doc, tag, lo, size, code = (b.column(c).to_numpy() for c in ("key", "doc", "tag", "lo", "len", "level"))
        length = pc.binary_length(b.column("run")).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(length)
        runs = Runs(key.view(U), doc, tag, lo, size, b"".join(b.column("run").to_pylist()), end - length, end)
        first, last = runs.key[0], runs.key[-1]
        hot = np.unique(runs.key[code >= HOT])
        found, fresh, again = (joined([*self.carry, runs]) if self.carry else runs).sorted()
        self.carry = []
        gone = np.flatnonzero(~fresh & ~again)
        if len(gone):
            yield found.take(gone).rows(DONE)
        heads = np.flatnonzero(fresh)
        keys = found.key[heads]
        if self.level == LAST:
            if more:
                self.carry = [found.take(heads[keys == last])]
            return
        on = np.isin(keys, hot) | ((keys == last) & more) | ((keys == first) & self.goes_on)
        self.goes_on = more
        if on.any():
            yield from _before_shuffle(found.take(heads[on]).regrouped(self.level + 1, self.width), self.level + 1, self.width)
        for several in _shared(found, heads[~on]):
            yield from _settled_here(found.take(several), self.level + 1, self.width)


def settle(rows: DataFrame, level: int, width: int) -> DataFrame:
    """Sorts the runs of every anchor of that level: RUN rows of what repeats, and of the next level."""

    def run(batches):
        settler = Settler(level, width)
        for b in batches:
            mine = b.column("level").to_numpy() % HOT == level
            if not mine.all():
                others = b.filter(pa.array(~mine))
                yield batch(**dict(zip(others.schema.names, others.columns, strict=True)))
            if mine.any():
                yield from settler.add(b.filter(pa.array(mine)))
        yield from settler.finish()

    dealt = rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "doc", "tag", "lo")
    return dealt.mapInArrow(run, RUN)


# the two passes over the texts ----------------------------------------------------------------

_PLACE = "key long, doc long, tag int, lo int, len int, several boolean"


def _anchors(docs: DataFrame, width: int, anchor: int) -> DataFrame:
    """A row for every run; an anchor that a task has several times is sent on once, marked, and settled otherwise."""

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            ids, tags = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag"))
            held, size = [], 0
            for part, chunk in chunks(texts, texts):
                doc, key, lo, hi = segments(BYTES, BYTES.sums(chunk.data), chunk.start, chunk.end, width, anchor)
                held.append((key, ids[part][doc], tags[part][doc], (lo - chunk.start[doc]).astype(np.int32), (hi - lo + 1).astype(np.int32)))
                size += len(key)
                if size > 500_000:
                    yield places(held)
                    held, size = [], 0
            if size:
                yield places(held)

    def places(held):
        key, doc, tag, lo, size = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(key, kind="stable")
        key, doc, tag, lo, size = (x[order] for x in (key, doc, tag, lo, size))
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        several = ~(fresh & np.concatenate((fresh[1:], [True])))
        key = np.where(fresh, key, mix(doc.astype(U) * U(7919) + lo.astype(U)))
        return batch(key=signed(key), doc=doc, tag=tag, lo=lo, len=size, several=several)

    return docs.mapInArrow(run, _PLACE)


def repeated_anchors(docs: DataFrame, width: int, anchor: int) -> DataFrame:
    """Flags of the windows whose anchor occurs more than once in all texts."""
    in_key = Window.partitionBy("key").orderBy("doc", "tag", "lo")
    other = F.lag("lo").over(in_key).isNotNull() | F.lead("lo").over(in_key).isNotNull()
    dealt = _anchors(docs, width, anchor).repartition(partitions(docs.sparkSession), "key")
    return dealt.withColumn("several", F.col("several") | other).where("several").select("doc", "tag", "lo", "len")


def opened_runs(open_texts: DataFrame, width: int) -> DataFrame:
    """RUN rows of the flagged windows of each text."""

    def run(batches):
        for b in batches:
            held, size = [], 0
            for at in range(0, b.num_rows, 100):
                part = flagged_texts(b.slice(at, 100))
                owner, start, end = open_ranges(part, width)
                if not len(owner):
                    continue
                ids, tags, texts = part[:3]
                data = b"".join([texts[i][s:e] for i, s, e in zip(owner.tolist(), start.tolist(), end.tolist(), strict=True)])
                last = np.cumsum(end - start)
                held.append(Runs(owner, ids[owner], tags[owner], start, end - start, data, last - (end - start), last).regrouped(0, width))
                size += len(held[-1].key)
                if size > SORTED_AT_ONCE:
                    yield from _before_shuffle(joined(held), 0, width)
                    held, size = [], 0
            if size:
                yield from _before_shuffle(joined(held), 0, width)

    return open_texts.mapInArrow(run, RUN)


def _cut(width: int):
    def cut(texts, owner, lo, size):
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        for i, text in enumerate(texts):
            at = slice(bounds[i], bounds[i + 1])
            if at.start == at.stop:
                yield text, [], len(text)
                continue
            gone = covered(len(text), lo[at], lo[at] + size[at] - 1 + width)
            yield np.frombuffer(text, dtype=np.uint8)[~gone].tobytes(), edges(gone), len(text)

    return lambda *a: list(cut(*a))


def repeated_windows(docs: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc``, ``tag``, ``lo``, ``len``: windows lo..lo+len-1 of a document start earlier too, as the sort found."""
    # stored: the anchors' shuffle need not be kept while the runs travel
    flags = stored(repeated_anchors(docs, width, ANCHOR))
    rows, found = opened_runs(texts.join(packed_flags(flags), ["doc", "tag"]), width), []
    for level in range(DONE):
        # stored: only what is unsettled is shuffled again
        rows = stored(settle(rows, level, width))
        found.append(rows.where(F.col("level") == DONE).select("doc", "tag", "lo", "len"))
        rows = rows.where(F.col("level") != DONE)
    return reduce(DataFrame.unionAll, found)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, ``n_bytes``, ``kept`` (remaining bytes), ``removed`` ([start, end) spans), ``carried``; the width is at least 40."""
    docs = tagged(df, id_col, text_col, keep)
    texts = compressed(docs)
    found = without(texts, repeated_windows(docs.select("doc", "tag", "text"), texts, width), _cut(width))
    return found.select(id_back(id_col), F.col("n_tokens").alias("n_bytes"), "kept", "removed", "carried")
