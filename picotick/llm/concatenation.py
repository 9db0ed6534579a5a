"""Concatenate-and-cut packing.

All documents' tokens, end tokens included, form one stream; sequences are fixed windows of it.

1. One pass tokenises each text where it lies and writes its ids with the number of tokens that
   come before it in its partition (two bytes an id while the vocabulary allows).
2. The totals of the partitions (a row each) are summed up in their order; that gives every
   partition, and so every document, its global offset.
3. A second pass over the ids cuts each document at the windows' borders. A document that a
   border crosses leaves a record on either side, and so do documents of two partitions that
   share a window; nothing but the table of totals moves between tasks.

Full windows hold ``capacity`` tokens. What is left behind the last one is cut in powers of two,
longest first, so a sequence is full or has a length that needs no padding.

Null texts are empty documents with the end token only; null ids stay null; repeated rows are
placed one by one; rows of equal id come in the order of the table; a very long text is cut
like any other, and is only ever held as one value; other columns are ignored but for those
that ``keep`` names; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import stored

CAPACITY = 4096
END = 2
#: The table of partition offsets is broadcast up to so many rows (16 MB), and joined otherwise.
MOST_BROADCAST = 1_000_000
#: Pre-tokens of which a task keeps the ids; beyond that it begins anew.
MOST_KNOWN = 400_000
#: Text that normalisation leaves alone but for lower case; other text goes through ``tokenizers`` whole.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-įı-ſ]*")


def _split() -> re.Pattern:
    """The vocabulary's split pattern ('s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+) over plain text."""
    of = lambda kind: "".join(chr(c) for c in range(0x21, 0x180) if unicodedata.category(chr(c))[0] == kind)
    letters, digits = of("L"), of("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\s{letters}{digits}]+")


class WordEncoder:
    """Ids of the public lower-casing BPE, as little-endian bytes of ``width`` each.

    ``tokenizers`` defines the ids. Its model never joins pre-tokens, so plain text is lower-cased
    and split here, and the model sees each distinct pre-token once, new ones of a text together
    (tests hold both ways together).
    """

    def __init__(self, name: str, width: int):
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.reference = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.kind, self.width = f"<u{width}", width
        self.known: dict[str, bytes] = {}
        self.split = _split()
        self.special = [t.content for t in self.reference.get_added_tokens_decoder().values()]
        # the same model behind white space alone, for pre-tokens that are made already
        self.words = Tokenizer(self.reference.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ending, vocabulary = self.reference.model.end_of_word_suffix, self.reference.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(ending)]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.reference.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, new: list[str]) -> None:
        ids = np.array(self.words.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, self.kind)
        ends = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
        if len(ends) != len(new):
            raise AssertionError("a pre-token has no last id")
        raw = ids.tobytes()
        for w, a, z in zip(new, [0, *ends[:-1]], ends, strict=True):
            self.known[w] = raw[a:z]

    def __call__(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self.whole(text)
        words, known = self.split.findall(text.lower()), self.known
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > MOST_KNOWN:
                known.clear()
                new = set(words)
            self._learn(list(new))
        return b"".join([known[w] for w in words])


def _id_width(name: str) -> int:
    import public_tokenizers
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(public_tokenizers.path(f"{name}.json")).get_vocab_size() <= 1 << 16 else 4


def _tokenised(df: DataFrame, text_col: str, names: list[str], tokenizer: str, width: int, end: int) -> DataFrame:
    """Row's columns ``names``, ``part``, ``before`` (tokens before it in its partition), ``n`` and ``ids``."""

    def run(batches):
        encode = WordEncoder(tokenizer, width)
        stop = end.to_bytes(width, "little")
        part, before = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                ids, starts, sizes = [], [], []
                for text in b.column("text"):
                    ids.append(encode(text.as_py()) + stop)
                    starts.append(before)
                    sizes.append(len(ids[-1]) // width)
                    before += sizes[-1]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in names), pa.array([part] * b.num_rows, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                    names=[*names, "part", "before", "n", "ids"])

    given = df.select(*names, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields if f.name != "text")
    return given.mapInArrow(run, f"{schema}, part long, before long, n long, ids binary")


def borders(begin: int, n: int, total: int, capacity: int) -> list[tuple[int, int, int, int]]:
    """(start in the document, length, sequence, offset) of the pieces of n tokens from place ``begin`` of ``total``.

    Sequence k < total // capacity is the k-th full window; behind them the binary digits of the
    rest are sequences, largest first.
    """
    out, at, full = [], begin, total - total % capacity
    while at < begin + n:
        if at < full:
            k, first, size = at // capacity, at - at % capacity, capacity
        else:
            k, first, rest = full // capacity, full, total - full
            size = 1 << (rest.bit_length() - 1)
            while at >= first + size:
                first, rest, k = first + size, rest - size, k + 1
                size = 1 << (rest.bit_length() - 1)
        length = min(begin + n, first + size) - at
        out.append((at - begin, length, k, at - first))
        at += length
    return out


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, tokenizer: str = "word_bpe_49k", end: int = END,
    keep: tuple[str, ...] = (), with_ids: bool = False,
) -> DataFrame:
    """Per piece: id, ``keep``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (and ``ids``)."""
    width, names = _id_width(tokenizer), [id_col, *(k for k in keep if k != id_col)]
    inner = [f"_c{i}" for i in range(len(names))]  # what is kept may be named like the operator's own columns
    given = df.select(*[F.col(c).alias(i) for c, i in zip(names, inner, strict=True)], F.col(text_col).cast("string").alias("_text"))
    told = stored(_tokenised(given, "_text", inner, tokenizer, width, end))
    totals = stored(told.groupBy("part").agg(F.sum("n").alias("tokens")))
    parts, total = totals.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    # a row a partition of the input: a window over all of them is short
    upto = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("part", F.coalesce(upto, F.lit(0)).alias("ahead"))
    if parts <= MOST_BROADCAST:
        offsets = F.broadcast(offsets)
    placed = told.join(offsets, "part").select(*inner, (F.col("ahead") + F.col("before")).alias("begin"), "n", "ids")
    kinds = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])]

    def cut(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                source, rows = [], []
                for i, (begin, n, raw) in enumerate(zip(b.column("begin").to_pylist(), b.column("n").to_pylist(), b.column("ids"), strict=True)):
                    ids = np.frombuffer(raw.as_buffer(), f"<u{width}").astype("<u4")
                    for start, length, k, offset in borders(begin, n, total, capacity):
                        piece = ids[start : start + length]
                        source.append(i)
                        rows.append((start, length, zlib.crc32(piece.tobytes()), n, k, offset, *([piece.astype("<i4")] if with_ids else [])))
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(source, pa.int32())) for c in inner), *columns], names=[*inner, *(k for k, _ in kinds)])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields if f.name in inner)
    found = placed.mapInArrow(cut, f"{schema}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
    clash = {k for k, _ in kinds} & set(names[1:])
    if clash:
        raise ValueError(f"keep names columns of the result: {sorted(clash)}")
    return found.withColumnsRenamed(dict(zip(inner, names, strict=True)))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``tokens``: the windows themselves, from ``pack(..., with_ids=True)``; a window has at most ``capacity`` pieces."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(pieces, lambda p: p["ids"])).alias("tokens"))
