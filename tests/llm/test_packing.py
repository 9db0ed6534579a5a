import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from picotick.llm import packing

SF = "/root/testdata/sf0.001"


def reference(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, texts, capacity=1024):
    """Gapless places, whole documents, right ids."""
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for group in by_seq.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for doc, text in texts:
        ids = reference(text)
        got = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got)))
        assert sum(r.length for r in got) == len(ids)
        at = 0
        for r in got:
            assert r.start == at
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert all(r.length == capacity for r in got[1:])
    return len(by_seq)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs).collect()
    n = check(rows, [(d.doc_id, d.text) for d in docs.collect()])
    assert n <= -(-sum(r.length for r in rows) // 1024) + 3


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "a<|endoftext|>b"), (4, "x " * 5000), (5, "tab\x1f  ​日本 é"), (6, "it's 12\n\n  ok")]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    check(rows, texts)


def test_repeated_null_and_empty(spark):
    d = spark.createDataFrame([(None, "a b", 1), (7, "a b", 2), (7, "a b", 3)], "doc_id long, text string, length int")
    rows = packing.pack(d).collect()
    assert sorted((r.doc_id is None, r.length) for r in rows) == [(False, 3), (False, 3), (True, 3)]
    assert sorted(r.offset for r in rows) == [0, 3, 6] and len({r.sequence_id for r in rows}) == 1
    assert packing.pack(d.limit(0)).count() == 0


def optimum(sizes, capacity):
    """Fewest bins by exhaustive search."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + sizes[i] <= capacity:
                bins[j] += sizes[i]
                go(i + 1, bins)
                bins[j] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_the_optimum(seed):
    """Sets fixed by dominance never cost a sequence: fixed + optimum of the rest = optimum."""
    r = random.Random(seed)
    capacity = r.choice([10, 20, 30])
    sizes = [r.randint(1, capacity) for _ in range(9)]
    left = dict(Counter(sizes))
    fixed = packing.reduce_dominated(left, capacity)
    rest = [k for k, c in left.items() for _ in range(c)]
    assert sum(n for _, n in fixed) + optimum(rest, capacity) == optimum(sizes, capacity)
    used = Counter()
    for contents, n in packing.solve(Counter(sizes), capacity):
        assert sum(contents) <= capacity
        for x in contents:
            used[x] += n
    assert used == Counter(sizes)
