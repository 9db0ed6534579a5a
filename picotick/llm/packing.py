"""Best-fit packing with Martello-Toth dominance reduction.

Texts are tokenised once, in tasks, and cut into pieces of at most ``capacity`` tokens. How
many pieces there are of each length (at most ``capacity`` numbers, whatever the corpus) is
all that the packing depends on, so that histogram is solved on the driver:

* ``reduce_dominated`` fixes sets that provably dominate every other choice for their largest
  piece: a piece that nothing fits beside, a pair that fills a sequence exactly, and the pair
  of a piece with the largest that fits when no two pieces that fit together exceed it;
* ``best_fit`` packs the rest in decreasing length, each piece into the fullest sequence that
  still has room.

The result is a list of (lengths in a sequence, number of such sequences). Pieces of a length
get numbers from a hash bucket's offset and their row number inside the bucket, so no length
is ordered in one task, and an equi-join on (length, number range) hands out the places.

Null texts are empty documents with the end token only; null ids stay null; repeated rows
are packed one by one; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import NO_ID, id_back, stored

CAPACITY = 1024
END = 2
#: Hash buckets per length: at least BUCKETS, and so many that one holds about BUCKET_ROWS of all pieces.
BUCKETS, BUCKET_ROWS = 256, 200_000
#: The packing plan is broadcast up to so many slots (5 MB), and joined otherwise.
MOST_BROADCAST = 100_000
SPECIAL = "<|endoftext|>"
#: Text on which the two tokenizer libraries split words alike beyond doubt; other text takes the reference path.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*")


class Encoder:
    """Token ids of the public byte-level BPE.

    ``tokenizers`` defines the ids. Plain text goes through ``tiktoken`` with the same
    vocabulary, which gives the same ids several times faster (tests hold them together).
    """

    def __init__(self, name: str = "byte_bpe_50k"):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.reference = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if SPECIAL not in text and _PLAIN.fullmatch(text):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.reference.encode(text, add_special_tokens=False).ids
        return np.array([*ids, END], dtype="<u4")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes what full pieces leave."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


_PIECES = "doc long, piece int, start long, length int, ids_crc32 long"


def pieces(df: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer: str) -> DataFrame:
    """One row per piece, without its ids (their CRC-32 stands for them)."""

    def run(batches):
        encode = Encoder(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = encode(text.as_py())
                    rows += [(doc, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(ids), capacity))]
                columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["doc", "piece", "start", "length", "ids_crc32"])

    given = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return given.mapInArrow(run, _PIECES)


def reduce_dominated(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes dominating sets, longest piece first, and takes them out of ``count``.

    For the longest piece a, with b the longest other piece that fits beside it:
    nothing fits -> {a}; a + b full -> {a, b}; no two others fit beside a -> {a, b}; the
    fullest two that fit sum to at most b, and no three fit -> {a, b}. Otherwise a stays.
    """
    fixed, left = [], sorted(k for k, c in count.items() if c)
    undecided: list[int] = []
    while left:
        a = left[-1]
        room = capacity - a
        # the piece itself may be its own partner if there are two of it
        pool = [*sorted({*left[:-1], *undecided}), *([a] if count[a] > 1 and a not in undecided else [])]
        pool = sorted(pool)
        at = bisect_left(pool, room + 1)
        if at == 0:
            fixed.append(((a,), count[a]))
            count[a] = 0
        else:
            b = pool[at - 1]
            small = [x for k in pool[:3] for x in [k] * min(3, count[k] - (k == a))][:3]
            dominated = b == room or len(small) < 2 or small[0] + small[1] > room
            if not dominated and (len(small) < 3 or sum(small) > room):
                dominated = _best_pair(pool[:at], count, a, room) <= b
            if not dominated:
                undecided.append(left.pop())
                continue
            n = count[a] // 2 if a == b else min(count[a], count[b])
            fixed.append(((a, b), n))
            count[a] -= n
            count[b] -= n
        left = [k for k in left if count[k]]
        undecided = [k for k in undecided if count[k]]
    for k in [k for k, c in count.items() if not c]:
        del count[k]
    return fixed


def _best_pair(pool: list[int], count: dict[int, int], a: int, room: int) -> int:
    """Largest sum of two pieces from the sorted pool that fits in ``room``, 0 without one."""
    best, i, j = 0, 0, len(pool) - 1
    while i <= j:
        if pool[i] + pool[j] > room or (i == j and count[pool[i]] - (pool[i] == a) < 2):
            j -= 1
        else:
            best = max(best, pool[i] + pool[j])
            i += 1
    return best


def best_fit(count: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: equal open sequences are handled as one group."""
    open_: dict[int, Counter] = {}  # room left -> contents -> number of sequences
    rooms: list[int] = []

    def put(contents: tuple[int, ...], n: int) -> None:
        room = capacity - sum(contents)
        if room not in open_:
            open_[room] = Counter()
            insort(rooms, room)
        open_[room][contents] += n

    for size in sorted(count, reverse=True):
        left = count[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                full, rest = divmod(left, each)
                if full:
                    put((size,) * each, full)
                if rest:
                    put((size,) * rest, 1)
                break
            room = rooms[at]
            contents, n = next(iter(open_[room].items()))
            used = min(n, left)
            open_[room][contents] -= used
            if open_[room][contents] == 0:
                del open_[room][contents]
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            put((*contents, size), used)
            left -= used
    return [(contents, n) for group in open_.values() for contents, n in group.items()]


def solve(count: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence, how many sequences) that use every piece once."""
    left = dict(count)
    return reduce_dominated(left, capacity) + best_fit(left, capacity)


def _slots(patterns: list[tuple[tuple[int, ...], int]]):
    """Per pattern and length: numbers of that length it takes, and where they go.

    The j-th piece of a slot lies in sequence ``base + j``; numbers of a length are handed
    out slot by slot, so each slot is one range [number, number + n).
    """
    base, taken, out = 0, Counter(), []
    for contents, n in patterns:
        offset = 0
        for size in contents:
            out.append((size, taken[size], n, base, offset))
            taken[size] += n
            offset += size
        base += n
    return out


def _last_at_most(slots: Column, number: Column, steps: int) -> Column:
    """Binary search: the place of the last slot that starts at or before ``number``."""

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        right = F.get(slots, middle)["number"] <= number
        return F.when(at["hi"] - at["lo"] <= 1, at).otherwise(F.struct(F.when(right, middle).otherwise(at["lo"]).alias("lo"), F.when(right, at["hi"]).otherwise(middle).alias("hi")))

    whole = F.struct(F.lit(0).alias("lo"), F.size(slots).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), whole, halve, lambda at: at["lo"])


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """Per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``."""
    spark = df.sparkSession
    cut_up = stored(pieces(df, id_col, text_col, capacity, tokenizer))
    buckets = max(BUCKETS, cut_up.count() // BUCKET_ROWS)
    # the CRC spreads the pieces of rows that repeat or lack an id
    bucketed = cut_up.withColumn("bucket", F.pmod(F.xxhash64("doc", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    per = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = _slots(solve(histogram, capacity))
    placed = spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], "length int, number long, n long, base long, offset long")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    in_bucket = Window.partitionBy("length", "bucket").orderBy("doc", "piece", "ids_crc32")
    numbered = bucketed.withColumn("k", F.row_number().over(in_bucket) - 1).join(ahead, ["length", "bucket"]).withColumn("number", F.col("ahead") + F.col("k"))
    # slots of a length cover its numbers without gaps: the right one is found by binary search in one array per length
    by_length = placed.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("number", "n", "base", "offset"))).alias("slots"))
    if len(slots) <= MOST_BROADCAST:
        by_length = F.broadcast(by_length)
    steps = max(1, max(Counter(size for size, *_ in slots).values(), default=1).bit_length())
    found = numbered.join(by_length, "length").withColumn("slot", F.get("slots", _last_at_most(F.col("slots"), F.col("number"), steps)))
    return found.select(
        id_back(id_col), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("slot.base") + F.col("number") - F.col("slot.number")).alias("sequence_id"), F.col("slot.offset").alias("offset"),
    )
