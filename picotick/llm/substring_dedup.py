"""Incremental dedup of repeated word passages over a log-structured fingerprint index.

A word is removed if a ``width``-word window that covers it also starts earlier: in a document
with a smaller id, or earlier in the same one. Windows are judged on the input.

``FingerprintIndex`` keeps *runs*: immutable tables of the window fingerprints of the
documents so far, bucketed and sorted by fingerprint. A new batch is fingerprinted, dealt to
the same buckets once, and merge-joined with every run, so history is never shuffled. What
the batch adds is its own run; once there are ``MAX_RUNS``, the two youngest are compacted
by a merge join into one before the next batch. Fingerprints are taken per content-defined group of
windows (``_windows``): its anchor's hash finds it in the runs, and a match is verified by the
128-bit BLAKE2b digest of the group's very words, joined by one space. Where the anchor matches
but the digest differs, the windows are verified one by one by digests of their 20 words.

Null texts have no words; null ids come before all others; rows that repeat id and text are
one document (each gets its result), rows that repeat only the id are ordered by a hash of
the text; extra columns are carried if ``keep`` names them; an empty table gives no rows. Words
may have any length; one text is handled whole by one task.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._hashing import SHINGLES, Chunk, chunks, concatenated_ranges, covered, digests, segments
from ._spark import id_back, partitions, stored
from ._windows import DUP, MOST_CONTENTS, OPEN, POINT, RAW, compressed, edges, find_runs, first_of_each, flagged_texts, packed_flags, points, tagged, without

WIDTH = 20
ANCHOR = 6
MAX_RUNS = 2
#: Opened windows compared at once in a task.
COMPARED_AT_ONCE = 1_000_000
#: Batches that one whole table is taken in.
BATCHES = 3


def _groups(width: int, anchor: int):
    def of(chunk: Chunk):
        chunk.words()
        doc, key, lo, hi = segments(SHINGLES, SHINGLES.sums(chunk.word_hashes()), chunk.first, chunk.last, width, anchor)
        joined, start, end = chunk.joined()
        return doc, key, *digests(joined, start[lo], end[hi + width - 1]), lo - chunk.first[doc], hi - chunk.first[doc]

    return of


class FingerprintIndex:
    """Sorted immutable runs of fingerprints: key (anchor), digest of the words, and where they occurred first."""

    def __init__(self, spark: SparkSession, width: int = WIDTH, anchor: int = ANCHOR, max_runs: int = MAX_RUNS):
        self.spark, self.width, self.anchor, self.max_runs = spark, width, anchor, max_runs
        self.buckets = partitions(spark)
        self.runs: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"picotick_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "key").sortBy("key").option("compression", "zstd").saveAsTable(name)
        return name

    def _run(self, name: str) -> DataFrame:
        """The rows of a run that are looked up; the others are flags of its batch."""
        return self.spark.table(name).where("indexed")

    def add(self, docs: DataFrame) -> DataFrame:
        """Indexes a batch of later documents (doc, tag, text); returns the flags that it brings.

        Flags may also open groups of earlier batches, whose anchors now have two contents.
        """
        while len(self.runs) >= self.max_runs:
            self._compact()
        found = find_runs(docs, _groups(self.width, self.anchor)).repartition(self.buckets, "key")
        fresh = F.col("kind") == RAW
        digest = F.struct("content", "check")
        in_order = Window.partitionBy("key").orderBy("kind", "content", "check", "doc", "tag", "lo")
        raw_content = F.when(fresh, digest)
        one_key = Window.partitionBy("key")
        judged = found.withColumn("head", fresh & (F.coalesce(F.lag(digest).over(in_order) != digest, F.lit(True))))
        judged = judged.withColumn("several", F.min(raw_content).over(one_key) != F.max(raw_content).over(one_key))
        judged = judged.withColumn("content_no", F.sum(F.col("head").cast("int")).over(in_order))
        seen, known, old = F.lit(False), F.lit(False), []
        for i, name in enumerate(self.runs):
            # a run holds at most MOST_CONTENTS contents of a key, so these arrays are short
            run = self._run(name).groupBy("key").agg(F.collect_list(digest).alias(f"c{i}"), F.first(F.struct("doc", "tag", "lo", "len")).alias(f"o{i}"))
            judged = judged.join(run, "key", "left")
            seen = seen | F.coalesce(F.array_contains(f"c{i}", digest), F.lit(False))
            known = known | F.col(f"c{i}").isNotNull()
            old.append(F.when(F.size(f"c{i}") == 1, F.col(f"o{i}")))
        kind = F.when(~fresh, F.col("kind")).when(seen | ~F.col("head"), F.lit(DUP)).when(F.col("several") | known, F.lit(OPEN)).otherwise(F.lit(RAW))
        opens = F.when(F.col("head") & ~seen, F.coalesce(*old)) if old else F.lit(None).cast("struct<doc: long, tag: int, lo: int, len: int>")
        name = self._write(judged.select(
            "key", "content", "check", "doc", "tag", "lo", "len", kind.cast("byte").alias("kind"),
            (F.col("head") & ~seen & (F.col("content_no") <= MOST_CONTENTS)).alias("indexed"), opens.alias("opens")))
        self.runs.append(name)
        table = self.spark.table(name)
        earlier = table.where("opens is not null").select("opens.*", F.lit(OPEN).cast("byte").alias("kind"))
        return stored(table.where(F.col("kind") != RAW).select("doc", "tag", "lo", "len", "kind").unionAll(earlier))

    def _compact(self) -> None:
        """Merge-joins the two youngest runs into one."""
        rows = [
            self._run(name).groupBy("key").agg(F.collect_list(F.struct("content", "check", "doc", "tag", "lo", "len", "indexed")).alias(f"rows{i}"))
            for i, name in enumerate(self.runs[-2:])
        ]
        # by key alone, as the runs are bucketed: neither is shuffled, and each bucket is written by one task
        both = rows[0].join(rows[1], "key", "full_outer")
        none = F.array().cast(both.schema["rows0"].dataType)
        found = F.slice(F.concat(F.coalesce("rows0", none), F.coalesce("rows1", none)), 1, MOST_CONTENTS)
        merged = self._write(both.select("key", F.explode(found).alias("r")).select("key", "r.*"))
        for name in self.runs[-2:]:
            self.spark.sql(f"DROP TABLE {name}")
        self.runs[-2:] = [merged]

    def drop(self) -> None:
        for name in self.runs:
            self.spark.sql(f"DROP TABLE {name}")
        self.runs = []


def verified_windows(open_texts: DataFrame, width: int) -> DataFrame:
    """POINT rows of opened windows: settled repeats, and the first of each window in a task."""

    def run(batches):
        for b in batches:
            held, size = [], 0
            for at in range(0, b.num_rows, 100):
                for piece in _opened(flagged_texts(b.slice(at, 100)), width, at):
                    held.append(piece)
                    size += len(piece[0])
                    if size > COMPARED_AT_ONCE:
                        yield _points(held)
                        held, size = [], 0
            if size:
                yield _points(held)

    return open_texts.mapInArrow(run, POINT)


def _opened(part, width: int, base: int):
    """(key, content, doc, tag, place, text number) of the opened windows, chunk by chunk."""
    ids, tags, texts, owner, lo, size = part
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for at, chunk in chunks(texts, texts):
        chunk.words()
        mine = slice(bounds[at.start], bounds[at.stop])
        start = np.unique(concatenated_ranges(chunk.first[owner[mine] - at.start] + lo[mine], size[mine]))
        which = np.searchsorted(chunk.last, start, side="right")
        joined, first, end = chunk.joined()
        text = which + at.start
        yield *digests(joined, first[start], end[start + width - 1]), ids[text], tags[text], start - chunk.first[which], text + base


def _points(held) -> pa.RecordBatch:
    key, content, doc, tag, place, which = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((which, place, tag, doc, content, key))
    key, content = key[order], content[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
    d, t, p = doc[order], tag[order], place[order]
    again = (d == d[head]) & (t == t[head]) & (p == p[head])
    first = order[fresh]
    return points(key[fresh], content[fresh], doc[first], tag[first], place[first], order[~fresh & ~again], which, doc, tag, place)


def _cut(width: int):
    def cut(texts, owner, lo, size):
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        for i, text in enumerate(texts):
            words = text.split()
            at = slice(bounds[i], bounds[i + 1])
            if at.start == at.stop:
                yield b" ".join(words), [], len(words)
                continue
            gone = covered(len(words), lo[at], lo[at] + size[at] - 1 + width)
            yield b" ".join(compress(words, (~gone).tolist())), edges(gone), len(words)

    return lambda *a: list(cut(*a))


def dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, anchor: int = ANCHOR, batches: int = BATCHES, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: id, ``n_words``, ``kept`` (remaining words as text), ``removed`` ([start, end) word spans), ``carried``."""
    spark = df.sparkSession
    docs = tagged(df, id_col, text_col, keep)
    # batches are id ranges in rising order: each meets the runs of the ones before
    cuts = sorted(set(docs.approxQuantile("doc", [i / batches for i in range(1, batches)], 0.01)))
    limits = [None, *(int(c) for c in cuts), None]
    index, flags = FingerprintIndex(spark, width, anchor), []
    try:
        for low, high in zip(limits, limits[1:], strict=False):
            part = docs.select("doc", "tag", "text")
            part = part if low is None else part.where(F.col("doc") > low)
            flags.append(index.add(part if high is None else part.where(F.col("doc") <= high)))
    finally:
        index.drop()
    flags = reduce(DataFrame.unionAll, flags)
    texts = compressed(docs)
    opened = texts.join(packed_flags(flags.where(F.col("kind") == OPEN)), ["doc", "tag"])  # all columns of the texts, as in the last join, so that they are shuffled once
    second = first_of_each(verified_windows(opened, width))
    repeats = flags.where(F.col("kind") == DUP).unionByName(second.where(F.col("kind") == DUP))
    found = without(texts, repeats, _cut(width))
    return found.select(id_back(id_col), F.col("n_tokens").alias("n_words"), F.col("kept").cast("string").alias("kept"), "removed", "carried")
