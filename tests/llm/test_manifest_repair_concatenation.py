"""Merkle manifest, conversation repair and concatenation against plain Python, and on odd rows."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from picotick.llm import concatenation, conversation_repair, merkle_manifest, registry

SF = "/root/testdata/sf0.001"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


# manifest -----------------------------------------------------------------------------------


def preimage(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(hashes, fanout):
    """Root, and each leaf's proof as (left, right) texts."""
    proofs, members = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        up, groups = [], []
        for a in range(0, len(hashes), fanout):
            run = hashes[a : a + fanout]
            for j in range(len(run)):
                for leaf in members[a + j]:
                    proofs[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(sha("".join(run)))
            groups.append([x for m in members[a : a + fanout] for x in m])
        hashes, members = up, groups
    return hashes[0], proofs


def manifest_of(rows, fanout=16):
    """Counter of (id, leaf, subroot, root, proof) for rows of the fields, the source second."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0], sha(preimage(*r))))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree([h for _, h in by[s]], fanout)
    root, above = tree([trees[s][0] for s in order], fanout)
    return Counter((i, h, trees[s][0], root, tuple(trees[s][1][k] + above[n])) for n, s in enumerate(order) for k, (i, h) in enumerate(by[s]))


@pytest.mark.parametrize(("fanout", "n"), [(16, 300), (2, 40), (3, 82), (16, 1), (16, 16), (16, 17)])
def test_manifest(spark, fanout, n):
    r = random.Random(n)
    rows = [(r.choice([None, i, i // 2]), r.choice([None, "", "hot", "hot", "hot", "é", "z", "-", ":"]), r.choice([None, "en"]), r.choice([None, 3]), r.choice([None, "", "ABC é", "x" * 70])) for i in range(n)]
    rows += rows[: n // 10]
    df = spark.createDataFrame([(*x, "other", 5) for x in rows], "doc_id long, source string, lang string, n_chars long, text string, proof string, grp int").repartition(5)
    found = merkle_manifest.manifest(df, fanout=fanout, keep={"h": F.col("text")})
    found = found.withColumn("again", merkle_manifest.fold(F.col("leaf"), F.col("proof"))).withColumn("other", merkle_manifest.fold(merkle_manifest.digest(F.lit("x")), F.col("proof"))).collect()
    assert Counter((x.doc_id, x.leaf, x.subroot, x.root, tuple((s.left, s.right) for s in x.proof)) for x in found) == manifest_of(rows, fanout)
    assert all(x.again == x.root and x.other != x.root for x in found)
    leaf_texts = {sha(preimage(*x)): x[4] for x in rows}
    assert all(leaf_texts[x.leaf] == x.h for x in found)


def test_manifest_of_one_source_and_of_nothing(spark):
    rows = [(i, "s", None, 1, "t" * (1_500_000 if i == 3 else i)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle_manifest.manifest(df).collect()
    assert Counter((x.doc_id, x.leaf, x.subroot, x.root, tuple((s.left, s.right) for s in x.proof)) for x in found) == manifest_of(rows)
    assert merkle_manifest.manifest(df.limit(0)).count() == 0


def test_tampering_is_found(spark):
    found = registry.op11_merkle_manifest(spark, SF).collect()
    texts = {d.doc_id: d.text for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for x in found:
        changed = zlib.crc32(str(x.doc_id).encode()) % 5 == 0 and texts[x.doc_id] is not None and any("A" <= c <= "Z" for c in texts[x.doc_id])
        assert x.verified == (not changed) and (x.folded_root == x.root) == x.verified


# repair -------------------------------------------------------------------------------------


def ways(rows):
    """(cost, audit, turns) of the cheapest, ASCII-least edits; rows of (role, text, fault). All edits with few insertions are tried."""
    best = None
    slots = [["", "I", "II"]] * (len(rows) + 1)
    for letters in itertools.product("DKR", repeat=len(rows)):
        for gaps in itertools.product(*slots):
            audit = "".join(g + c for g, c in zip(gaps, letters, strict=False)) + gaps[-1]
            cost, turns, at, ok = 0, [], 0, True
            for c in audit:
                role, text, fault = rows[at] if c != "I" else ("", "", "")
                at += c != "I"
                if c == "D":
                    cost += 3
                    continue
                said = turns[-1][0][:1] if turns else ""
                due = "assistant" if said == "u" else "user"
                cost += {"I": 2, "R": 2, "K": 0}[c] + (fault == "truncated")
                if fault in ("blank", "duplicate") or (c == "K" and role[:1] != due[0] and not (role[:1] == "s" and not turns)):
                    ok = False
                    break
                turns.append((role if c == "K" else due, text))
            if ok and (not turns or turns[-1][0][:1] == "a") and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, turns
    return best


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", "uuu", None]
TEXTS = ["a.", "b!", "c? \n", "cut", "", " \t", "\x1f", "é…", None, "a."]


@pytest.mark.parametrize("seed", range(3))
def test_repair_is_cheapest_and_least(spark, seed):
    r = random.Random(seed)
    rows = [(c, r.choice([None, t, t, t + 5]), r.choice(ROLES), r.choice(TEXTS)) for c in [None, *range(1, 26)] for t in range(r.randint(1, 4))]
    rows += [rows[0], rows[3]]
    df = spark.createDataFrame([(*x, "x", 1, True) for x in rows], "conv_id long, turn long, role string, text string, place string, kind int, again boolean").repartition(4)
    got = defaultdict(list)
    for x in conversation_repair.repair(df).collect():
        got[x.conv_id].append(x)
    assert set(got) == {x[0] for x in rows}
    for c, found in got.items():
        mine = [(t, role if role is not None else " ", text if text is not None else " ") for k, t, role, text in rows if k == c]
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.md5(x[2].encode()).hexdigest()))
        judged = faults([x[1:] for x in mine])
        cost, audit, turns = ways(judged)
        head = next(x for x in found if x.place == 0).found
        assert (head.cost, head.audit) == (cost, audit), (c, judged)
        assert [(x.role, x.text) for x in sorted(found, key=lambda x: x.place) if x.place] == turns
        told = [t for t, *_ in mine if t is not None]
        assert head.gaps == (max(told) - min(told) + 1 - len(set(told)) if told else 0)
        assert (head.blank, head.duplicate, head.truncated) == tuple(sum(x[2] == k for x in judged) for k in ("blank", "duplicate", "truncated"))
        assert head.illegal == sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
    assert conversation_repair.repair(df.limit(0)).count() == 0


def test_blocks_of_a_long_conversation(monkeypatch):
    r = random.Random(5)
    for n in (0, 1, 7, 8, 9, 30):
        kinds = bytes(r.choice([0, 1, 2, 3, 5, 9, 13, 14]) for _ in range(n))
        monkeypatch.setattr(conversation_repair, "_BLOCK", 4096)
        whole = conversation_repair.cheapest(kinds)
        monkeypatch.setattr(conversation_repair, "_BLOCK", 8)
        assert conversation_repair.cheapest(kinds) == whole


def test_one_conversation_with_most_rows(spark):
    n = 30_000
    long = "long " * 300_000 + "."
    rows = [(1, t, "assistant" if t % 2 else "user", long if t == 5 else f"{t}." if t % 1000 else "cut") for t in range(n)] + [(2, 0, "user", "a.")]
    found = conversation_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    head = {x.conv_id: x.found for x in found.where("place = 0").collect()}
    assert head[1].truncated == 1 and head[1].duplicate == 29 and set(head[1].audit) <= set("KDI") and head[2].audit == "KI"
    assert found.where("conv_id = 1 and place > 0").count() == sum(c != "D" for c in head[1].audit)


def test_dropped_rows_name_their_conversation(spark):
    df = spark.createDataFrame([(1, 0, "user", "a.", False), (2, 0, "user", "a.", None), (3, 0, "user", "a.", True)], "conv_id long, turn long, role string, text string, there boolean")
    heads = {x.conv_id: x.found for x in conversation_repair.repair(df, present=F.col("there")).where("place = 0").collect()}
    assert heads[1] == heads[2] and heads[1].audit == "" and heads[1].cost == 0 and heads[3].audit == "KI"


# concatenation ------------------------------------------------------------------------------


WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def word_ids(text):
    return [*WORDS.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, texts, capacity=4096):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for x in rows:
        by_seq[x.sequence_id].append(x)
        by_doc[x.doc_id].append(x)
    for group in by_seq.values():
        at = 0
        for x in sorted(group, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at == capacity or at & (at - 1) == 0, "a sequence is full or a power of two"
    for doc, text in texts:
        ids, at = word_ids(text), 0
        for x in sorted(by_doc[doc], key=lambda x: x.start):
            assert x.start == at and x.doc_tokens == len(ids)
            assert x.ids_crc32 == zlib.crc32(np.array(ids[at : at + x.length], dtype="<u4").tobytes())
            at += x.length
        assert at == len(ids)
    assert sum(x.length for x in rows) == sum(len(word_ids(t)) for _, t in texts)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_concatenation(spark, capacity):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    check(concatenation.pack(docs, capacity=capacity).collect(), [(d.doc_id, d.text) for d in docs.collect()], capacity)


def test_concatenation_of_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "a<|endoftext|>b <|startoftext|>"), (4, "x " * 700_000), (5, "tab\x1f  ​日本 é é \x85\xa0"), (6, "It's 12\n\n  OK''s !'LL İI ß"), (7, "  "), (8, "".join(map(chr, range(9, 0x250))))]
    df = spark.createDataFrame([(*x, 1, "k") for x in texts], "doc_id long, text string, n int, ids string").repartition(3)
    check(concatenation.pack(df).collect(), texts)
    kept = concatenation.pack(df, keep=("n",), with_ids=True, capacity=128)
    assert {x.n for x in kept.collect()} == {1}
    whole = concatenation.sequences(kept).collect()
    assert Counter(i for x in whole for i in x.tokens) == Counter(i for _, t in texts for i in word_ids(t))
    again = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b")], "doc_id long, text string")
    found = concatenation.pack(again, capacity=4).collect()
    assert sum(x.length for x in found) == 9 and sum(x.length for x in found if x.doc_id is None) == 3
    assert concatenation.pack(again.limit(0)).count() == 0
    with pytest.raises(ValueError):
        concatenation.pack(df.withColumn("length", F.lit(1)), keep=("length",))


def test_plain_text_takes_the_same_ids():
    fast = concatenation.WordEncoder("word_bpe_49k", 2)
    r = random.Random(3)
    plain = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x250)]]
    for _ in range(300):
        text = "".join(r.choice([*plain, "'s", "'LL", " ", "the "]) for _ in range(r.randint(0, 60)))
        assert fast(text) == fast.whole(text), text


def test_borders():
    for total in (0, 1, 5, 16, 23, 40):
        assert [x for at in range(total) for x in concatenation.borders(at, 1, total, 16)] == [(0, 1, k, o) for k, o in places(total, 16)]


def places(total, capacity):
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if total % capacity >> b & 1]
    return [(k, o) for k, n in enumerate(sizes) for o in range(n)]
