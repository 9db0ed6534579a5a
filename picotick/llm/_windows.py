"""Shared steps of the two repeated-window operators (20-word and 100-byte windows).

A document's windows fall into *runs* that share a content-defined anchor (see
``_hashing.segments``): about one run for every 40 bytes or 8 words, so what is shuffled is a
small part of the text. A run whose anchor occurs nowhere else has no repeated window. A run
whose whole content started earlier is repeated as a whole. Only runs that share an anchor
but not their content are *opened*: their windows are compared one by one in a further step.

Flags are rows (doc, tag, lo, len, kind): windows lo..lo+len-1 of a document are repeated
(DUP) or have to be opened (OPEN). ``tag`` tells rows of one doc_id apart when ids repeat;
rows that repeat both id and text are one document, and each gets that document's result.
A single text is handled whole in one task, whatever its length: some 30 bytes of memory
for each of its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._hashing import U, chunks, mix, runs
from ._spark import NO_ID, partitions

RAW, DUP, OPEN = 0, 1, 2
#: Distinct contents of one anchor that a task passes on from a batch; with more, it opens them all itself.
MOST_CONTENTS = 16
FLAG = "doc long, tag int, lo int, len int, kind byte"


def tagged(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc``, ``tag``, ``text``, ``carried`` (the columns of ``keep``).

    tag is 0 unless some id repeats (one look at the ids alone).
    """
    carried = F.struct(*keep) if keep else F.lit(None).cast("int")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), text.alias("text"), carried.alias("carried"))
    repeats = rows.groupBy("doc").count().where("count > 1").limit(1).count() > 0
    tag = F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int") if repeats else F.lit(0)
    return rows.select("doc", tag.alias("tag"), "text", "carried")


def signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(U).view(np.int64))


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def _reduced(key, content, check, doc, tag, lo, size):
    """Pre-aggregates a batch's runs: of equal runs the first is passed on, the rest are DUP;
    an anchor with many contents is opened here, with two of them passed on as witnesses."""
    order = np.lexsort((lo, tag, doc, check, content, key))
    key, content, check, doc, tag, lo, size = (x[order] for x in (key, content, check, doc, tag, lo, size))
    new_key = np.concatenate(([True], key[1:] != key[:-1]))
    head = new_key | np.concatenate(([True], (content[1:] != content[:-1]) | (check[1:] != check[:-1])))
    at = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
    kind = np.where(head, RAW, DUP).astype(np.int8)
    again = ~head & (doc == doc[at]) & (tag == tag[at]) & (lo == lo[at])  # the same document once more
    group = np.cumsum(new_key) - 1
    heads = np.bincount(group, weights=head).astype(np.int64)
    nth = np.cumsum(head) - np.repeat(np.cumsum(heads) - heads, np.bincount(group))
    many = head & (heads[group] > MOST_CONTENTS)
    kind[many] = OPEN
    witness = many & (nth <= 2)
    take = np.concatenate((np.flatnonzero(~again), np.flatnonzero(witness)))
    kind = np.concatenate((kind[~again], np.full(int(witness.sum()), RAW, np.int8)))
    return key[take], content[take], check[take], doc[take], tag[take], lo[take], size[take], kind


#: content and check are the halves of a BLAKE2b digest of the run's own words.
RUN = "key long, content long, check long, doc long, tag int, lo int, len int, kind byte"


def find_runs(docs: DataFrame, runs_of) -> DataFrame:
    """Rows of RUN: ``runs_of(chunk)`` gives (document, anchor, content, check, first, last) per
    chunk, with places counted from the start of the chunk's document."""

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            ids, tags = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag"))
            held, size = [], 0
            for part, chunk in chunks(texts, texts):
                doc, key, content, check, lo, hi = runs_of(chunk)
                held.append((key, content, check, ids[part][doc], tags[part][doc], lo.astype(np.int32), (hi - lo + 1).astype(np.int32)))
                size += len(key)
                if size > 500_000:
                    yield batch_of(held)
                    held, size = [], 0
            if size:
                yield batch_of(held)

    return docs.mapInArrow(run, RUN)


def batch_of(held):
    key, content, check, doc, tag, lo, size, kind = _reduced(*(np.concatenate(c) for c in zip(*held, strict=True)))
    # settled rows travel under a key of their own, so they spread over all tasks
    key = np.where(kind == RAW, key, content ^ doc.astype(U))
    return batch(key=signed(key), content=signed(content), check=signed(check), doc=doc, tag=tag, lo=lo, len=size, kind=kind)


def open_ranges(part, width: int):
    """(text number, first window, end of its last window) of the maximal opened ranges of a batch."""
    _, _, texts, owner, lo, size = part
    order = np.lexsort((lo, owner))
    owner, lo, hi = owner[order], lo[order], (lo + size)[order]
    if not len(owner):
        return owner, lo, hi
    reach = np.maximum.accumulate(hi + owner * (1 << 40))
    fresh = np.concatenate(([True], (lo + owner * (1 << 40))[1:] > reach[:-1]))
    at = np.flatnonzero(fresh)
    end = reach[np.concatenate((at[1:] - 1, [len(owner) - 1]))] - owner[at] * (1 << 40)
    return owner[at], lo[at], end - 1 + width


def packed_flags(flags: DataFrame) -> DataFrame:
    """One row per document: its flags as an array (no longer than the document)."""
    return flags.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "len")).alias("flags"))


def compressed(docs: DataFrame) -> DataFrame:
    """Texts compressed for the shuffle to their flags."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            z = pa.array([press.compress(t) for t in b.column("text").to_pylist()], pa.binary())
            yield batch(doc=b.column("doc"), tag=b.column("tag"), z=z, carried=b.column("carried"))

    return docs.mapInArrow(run, T.StructType([docs.schema["doc"], docs.schema["tag"], T.StructField("z", T.BinaryType()), docs.schema["carried"]]))


def flagged_texts(b: pa.RecordBatch):
    """(ids, tags, texts, flag owner, flag lo, flag len) of a batch of texts joined with flags."""
    unpress = zstandard.ZstdDecompressor()
    texts = [unpress.decompress(z) for z in b.column("z").to_pylist()]
    ids, tags = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tag"))
    lists = b.column("flags")
    sizes = np.array([len(x) if x.is_valid else 0 for x in lists], dtype=np.int64)
    flat = lists.flatten()
    lo, size = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    return ids, tags, texts, np.repeat(np.arange(len(texts)), sizes), lo, size


POINT = "key long, content long, doc long, tag int, lo int, len int, kind byte"


def points(key, content, doc, tag, place, repeats, which, docs, tags, places) -> pa.RecordBatch:
    """POINT rows: one for each distinct window of a task, and ranges of those that it settled.

    ``repeats`` are numbers of settled windows, in ``which`` text, at ``places``.
    """
    r = repeats[np.lexsort((places[repeats], which[repeats]))]
    _, lo, count = runs(which[r], places[r])
    first = r[np.cumsum(count) - count]
    n, m = len(key), len(lo)
    spread = mix((docs[first] * 7919 + lo).astype(U))
    return batch(
        key=signed(np.concatenate((key, spread))), content=signed(np.concatenate((content, np.zeros(m, U)))),
        doc=np.concatenate((doc, docs[first])), tag=np.concatenate((tag, tags[first])).astype(np.int32), lo=np.concatenate((place, lo)).astype(np.int32),
        len=np.concatenate((np.ones(n, np.int64), count)).astype(np.int32), kind=np.concatenate((np.full(n, RAW), np.full(m, DUP))).astype(np.int8),
    )


def first_of_each(rows: DataFrame) -> DataFrame:
    """Settles POINT rows by (key, content): the first keeps its place, later ones are DUP.

    One shuffle by key; each task streams its sorted rows and remembers only the current
    window, however common it is.
    """

    def run(batches):
        carry = None  # (key, content, doc, tag, lo) of the latest row's first
        for b in batches:
            settled = b.column("kind").to_numpy() != RAW
            if settled.any():
                yield b.filter(pa.array(settled)).select(["doc", "tag", "lo", "len", "kind"])
            b = b.filter(pa.array(~settled))
            if not b.num_rows:
                continue
            key, content, doc, tag, lo, size = (b.column(c).to_numpy() for c in ("key", "content", "doc", "tag", "lo", "len"))
            head = np.concatenate(([carry is None or (key[0], content[0]) != carry[:2]], (key[1:] != key[:-1]) | (content[1:] != content[:-1])))
            at = np.maximum.accumulate(np.where(head, np.arange(len(key)), -1))
            same = lambda mine, i: np.where(at >= 0, mine == mine[np.maximum(at, 0)], mine == (carry[i] if carry else 0))  # noqa: E731, B023
            keep = ~head & ~(same(doc, 2) & same(tag, 3) & same(lo, 4))
            i = at[-1]
            carry = (key[-1], content[-1], *((doc[i], tag[i], lo[i]) if i >= 0 else carry[2:]))
            if keep.any():
                yield batch(doc=doc[keep], tag=tag[keep], lo=lo[keep], len=size[keep], kind=np.full(int(keep.sum()), DUP, np.int8))

    dealt = rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "content", "doc", "tag", "lo")
    return dealt.mapInArrow(run, FLAG)


def without(texts: DataFrame, flags: DataFrame, cut) -> DataFrame:
    """Every text without its repeated windows.

    ``cut(texts, owner, lo, len)`` gives, per text of a batch, the kept bytes, the removed
    [start, end) ranges, and the number of tokens. Columns: doc, n_tokens, kept, removed, carried.
    """
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = T.StructType([
        T.StructField("doc", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("kept", T.BinaryType()),
        T.StructField("removed", spans), texts.schema["carried"],
    ])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                _, _, data, owner, lo, size = flagged_texts(b)
                rows = cut(data, owner, lo, size)
                kept, removed, n = zip(*rows, strict=True)
                ranges = [[{"start": int(x), "end": int(y)} for x, y in r] for r in removed]
                yield batch(doc=b.column("doc"), n_tokens=pa.array(n, pa.int64()), kept=pa.array(kept, pa.binary()), removed=pa.array(ranges, arrow), carried=b.column("carried"))

    joined = texts.join(packed_flags(flags), ["doc", "tag"], "left").select("doc", "tag", "z", "flags", "carried")
    return joined.mapInArrow(run, schema)


def edges(mask: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the runs of a mask."""
    change = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(change[::2].tolist(), change[1::2].tolist(), strict=True))
