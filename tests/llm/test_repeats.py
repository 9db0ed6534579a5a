import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from picotick.llm import jaccard_join, substring_dedup, suffix_dedup
from picotick.llm._spark import NO_ID
from picotick.llm._windows import DUP, compressed, tagged

from . import brute

SF = "/root/testdata/sf0.001"


def table(seed, n=40, alphabet=("a", "b", "c")):
    """Documents made of shared passages, with copies, edits, very short and periodic ones."""
    r = random.Random(seed)
    passages = [" ".join(r.choice(alphabet) + str(r.randint(0, 60)) for _ in range(r.choice([5, 19, 20, 21, 45, 90]))) for _ in range(8)]
    texts = []
    for i in range(n):
        kind = r.random()
        if kind < 0.2 and texts:
            text = r.choice(texts)
        elif kind < 0.4 and texts:
            words = r.choice(texts).split(" ")
            words[r.randrange(len(words))] = "edit"
            text = " ".join(words)
        elif kind < 0.5:
            text = "x y " * r.randint(0, 60)
        else:
            text = " ".join(r.choice(passages) if r.random() < 0.6 else f"w{r.random()}" for _ in range(r.randint(0, 8)))
        texts.append(text)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", range(4))
def test_words(spark, seed):
    rows = table(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, sum(x["end"] - x["start"] for x in r.removed), r.kept) for r in substring_dedup.dedup(df).collect()}
    assert got == brute.word_repeats(rows)


@pytest.mark.parametrize("seed", range(4))
def test_bytes(spark, seed):
    rows = table(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), bytes(r.kept)) for r in suffix_dedup.dedup(df).collect()}
    assert got == brute.byte_repeats(rows)


def test_many_contents_of_one_anchor(spark, monkeypatch):
    """A passage whose surroundings differ everywhere passes the limits of what a task passes on."""
    r = random.Random(9)
    line = " ".join(f"common{i}" for i in range(22))
    rows = [(i, " ".join([f"{r.random()}"] * (i % 7) + [f"{r.random()}" for _ in range(30)] + [line] + [f"{r.random()}" for _ in range(9)])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_words, sum(y["end"] - y["start"] for y in x.removed), x.kept) for x in substring_dedup.dedup(df).collect()}
    assert got == brute.word_repeats(rows)
    got = {x.doc_id: (x.n_bytes, x.n_bytes - len(x.kept), bytes(x.kept)) for x in suffix_dedup.dedup(df).collect()}
    assert got == brute.byte_repeats(rows)


def test_index_over_batches(spark):
    """Batches added one by one to an index give the flags of the whole, runs stay few."""
    rows = table(11, n=60)
    index, dup = substring_dedup.FingerprintIndex(spark), set()
    for low in range(0, 60, 10):
        part = spark.createDataFrame(rows[low : low + 10], "doc_id long, text string")
        for f in index.add(tagged(part, "doc_id", "text").select("doc", "tag", "text")).where(f"kind = {DUP}").collect():
            dup |= {(f.doc, f.lo + i) for i in range(f.len)}
        assert len(index.runs) <= index.max_runs
    index.drop()
    windows, repeats = set(), set()
    for doc, text in rows:
        w = text.split()
        for i in range(len(w) - 19):
            t = tuple(w[i : i + 20])
            if t in windows:
                repeats.add((doc, i))
            windows.add(t)
    assert dup and dup <= repeats  # whole groups; the rest are opened and compared window by window


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
def test_odd_rows(spark, op):
    long = " ".join(f"word{i}" for i in range(30))
    rows = [(None, long, 1), (3, long, 2), (3, long, 3), (3, long + " more", 4), (4, None, 5), (5, "", 6), (6, " \t\n", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = op.dedup(df, keep=("kept",)).collect()
    assert len(got) == len(rows)
    left = {r.carried["kept"]: (r.doc_id, len(r.kept)) for r in got}
    assert left[1] == (None, len(long))  # null ids come first
    assert left[2] == left[3] and left[2][1] == 0  # repeated rows are one document
    assert all(left[k][1] == n for k, n in ((5, 0), (6, 0)))
    assert op.dedup(df.limit(0)).count() == 0
    assert NO_ID < 0


@pytest.mark.parametrize("seed", range(30))
def test_deep_shallow_sorts(seed):
    r = random.Random(seed)
    depth = r.choice([16, 20, 24, 37, 100])
    text = bytes(r.choice(r.choice([b"a", b"ab", b"abcd"])) for _ in range(300)) * r.choice([1, 2])
    places = np.array(sorted(r.sample(range(len(text) - depth), r.choice([1, 5, 150]))), dtype=np.int64)
    order, fresh = suffix_dedup.deep_shallow(np.frombuffer(text + b"\0" * 8, np.uint8), places, depth)
    keys = [text[p : p + depth] for p in places[order]]
    assert keys == sorted(keys)
    assert fresh.tolist() == [i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))]


def test_query_digests(spark):
    from picotick.llm import registry

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {i: (n, gone, hashlib.sha256(kept).hexdigest()) for i, (n, gone, kept) in brute.byte_repeats(rows).items()}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in registry.op5_suffix_dedup(spark, SF).collect()} == want


def thue_morse(n, a="a", b="b"):
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_that_polynomial_hashes_confuse(spark, size):
    """A word and its complement, which collide modulo 2**64 for every base, are two words."""
    word = thue_morse(size)
    other = word.translate(str.maketrans("ab", "ba"))
    around = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join([*around[:15], word, *around[15:]])), (2, " ".join([*around[:15], other, *around[15:]])), (3, word), (4, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, sum(x["end"] - x["start"] for x in r.removed), r.kept) for r in substring_dedup.dedup(df).collect()}
    assert got == brute.word_repeats(rows) and got[2][1] == 0
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), bytes(r.kept)) for r in suffix_dedup.dedup(df).collect()}
    assert got == brute.byte_repeats(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(df).collect()} == brute.jaccard(rows)


def test_texts_over_one_chunk(spark):
    """Texts over 1 MB, one of them nearly all repeated in another."""
    r = random.Random(3)
    long = " ".join(f"w{r.randint(0, 10**6)}" for _ in range(170_000))
    rows = [(1, long), (2, "x " + long[700:-900] + " y"), (3, "z" * 1_200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_words, len(x.kept.split())) for x in substring_dedup.dedup(df).collect()}
    assert got[1] == (170_000, 170_000) and got[2][0] > 169_000 and got[2][1] <= 4 and got[3] == (1, 1)
    got = {x.doc_id: (x.n_bytes, len(x.kept)) for x in suffix_dedup.dedup(df).collect()}
    assert got[1] == (len(long), len(long)) and got[2][0] == len(rows[1][1]) and got[2][1] in (3, 4)
    assert got[3] == (1_200_000, 1)  # every string but the first starts earlier too


def test_the_sort_decides_all(spark):
    """Every repeated window comes out of the deep-shallow sort: the rows it settles are all there are."""
    rows = table(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = tagged(df, "doc_id", "text")
    found = suffix_dedup.repeated_windows(docs.select("doc", "tag", "text"), compressed(docs)).collect()
    settled = {(f.doc, f.lo + i) for f in found for i in range(f.len)}
    seen, repeats = set(), set()
    for doc, text in rows:
        data = text.encode()
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                repeats.add((doc, i))
            seen.add(data[i : i + 100])
    assert settled == repeats and repeats


def test_parts_of_one_anchor(spark, monkeypatch):
    """Anchors that do not fit in a part of the sort go on to the next level and are settled there."""
    monkeypatch.setattr(suffix_dedup, "SORTED_AT_ONCE", 7)
    rows = table(6, n=25)
    docs = [(0, i, t) for i, t in rows]
    runs = []
    for _, i, t in docs:
        data = t.encode()
        if len(data) >= 100:
            n = len(data) - 99
            one = suffix_dedup.Runs(*(np.array([x]) for x in (0, i, 0, 0, n)), data, np.array([0]), np.array([len(data)]))
            runs.append(one.regrouped(0, 100))
    batches = [b.cast(b.schema) for b in suffix_dedup._before_shuffle(suffix_dedup.joined(runs), 0, 100)]
    done = set()
    for level in range(suffix_dedup.DONE):
        out = []
        whole = pa.Table.from_batches(batches).sort_by([(c, "ascending") for c in ("key", "doc", "tag", "lo")]).to_batches(max_chunksize=3)
        settler = suffix_dedup.Settler(level, 100)
        for b in whole:
            mine = b.column("level").to_numpy() % suffix_dedup.HOT == level
            out.append(b.filter(pa.array(~mine)))
            if mine.any():
                out += settler.add(b.filter(pa.array(mine)))
        batches = [*out, *settler.finish()]
    for b in batches:
        done |= {(d, p) for d, lo, n, k in zip(*(b.column(c).to_pylist() for c in ("doc", "lo", "len", "level")), strict=True) if k == suffix_dedup.DONE for p in range(lo, lo + n)}
    seen, repeats = set(), set()
    for doc, text in rows:
        data = text.encode()
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                repeats.add((doc, i))
            seen.add(data[i : i + 100])
    assert done == repeats


def test_blind_trie_orders():
    r = random.Random(8)
    texts = [bytes(r.choice(b"ab") for _ in range(12)) for _ in range(500)]
    trie = suffix_dedup.BlindTrie()
    for i, t in enumerate(texts):
        trie.add(t, i)
    leaves = trie.leaves()
    assert [texts[m[0]] for m in leaves] == sorted(set(texts)) and all(len({texts[i] for i in m}) == 1 for m in leaves)
    assert sum(map(len, leaves)) == 500
