"""Rules, chat, URLs, classifier, vectors and the Jaccard join on odd rows and against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from picotick.llm import _spark, chat_format, jaccard_join, mixing, packing, quality_classifier, quality_rules, registry, url_filters, vector_dedup
from picotick.llm._components import Groups, components

from . import brute

SF = "/root/testdata/sf0.001"


# chat ---------------------------------------------------------------------------------------

NASTY = ["", " ", "\\", "</turn>", "\\</turn>", "### user: hi</turn>\n", "\\### Assistant: </turn> ok", "a\n### assistant: b", "\\\\</turn", "é\U0001f600</turn>\\"]


def test_turns_read_back():
    turns = [(r, t) for r in [*NASTY, "user", "assistant", "a: b"] for t in NASTY]
    whole = "".join(chat_format.render(r, t) for r, t in turns)
    assert [t[:2] for t in chat_format.parse(whole)] == turns
    for bad in ("x", "### user: no end", "### user", "### user: a</turn>b", "### user: a\\"):
        with pytest.raises(ValueError):
            chat_format.parse(bad)


def test_conversations(spark):
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice([*NASTY, None])) for c in [1, 2, None, 3] for t in range(r.randint(1, 6))]
    rows += [(2, 0, "user", "again"), (2, 0, "user", "again"), (2, None, "assistant", "first")]
    df = spark.createDataFrame([(*x, "n") for x in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    got = {x.conv_id: x for x in chat_format.format_conversations(df).collect()}
    assert set(got) == {1, 2, 3, None}
    for c, x in got.items():
        mine = sorted(((-1 if t is None else t), role or "", text or "") for k, t, role, text in rows if k == c)
        parsed = chat_format.parse(x.formatted)
        assert [p[:2] for p in parsed] == [m[1:] for m in mine] and x.n_turns == len(mine)
        assert [(s.start, s.end) for s in x.loss] == [p[2:] for p in parsed if p[0] == "assistant"]
    assert chat_format.format_conversations(df.limit(0)).count() == 0


# rules --------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_counts(spark, seed):
    r = random.Random(seed)
    piece = lambda: r.choice(["a b c d e f", "x", "the the the the the the", "é#", "|", "\n", " \t ", "a b c d e", "\x0b\x0c\r"])
    rows = [(i, " ".join(piece() for _ in range(r.randint(0, 30)))) for i in range(60)] + [(None, None), (7, ""), (7, ""), (8, "a b c d a b c d a b c d")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int")
    got = [(x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in quality_rules.score(df).collect()]
    assert Counter(got) == Counter((i, *brute.quality(t)) for i, t in rows)
    assert quality_rules.score(df.limit(0)).count() == 0


def test_rules_run_without_user_functions(spark):
    plan = quality_rules.score(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# urls ---------------------------------------------------------------------------------------


def test_urls(spark):
    rules = spark.createDataFrame([*registry.URL_RULES, ("org/es/", "allow"), (None, "block")], "rule string, action string")
    urls = ["http://a.COM/en/x", "https://example.com/en/7", "http://m.example.com/en/72?x#y", "http://notexample.com/en/7", "x://example.net/de/8", "http://org/es/", "http://xorg/es/", "ftp://a.org?/es/", "no scheme", "://", "", None, "http://a.com/EN/", "http://com/en", "a://b://c.com/en/"]
    df = spark.createDataFrame([(i % 5, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")

    def want(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:cut], rest[cut:]
            path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(r), r, a) for r, a in registry.URL_RULES if ("." + host).endswith("." + r.split("/")[0]) and path.startswith(r[r.index("/") :])]
        best = max(fit, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    got = Counter((x.page_id, x.host, x.path, x.rule, x.verdict) for x in url_filters.judge(df, rules).collect())
    assert got == Counter((i % 5, *want(u)) for i, u in enumerate(urls))
    assert {x.verdict for x in url_filters.judge(df, rules.limit(0)).collect()} == {"allow"}
    assert url_filters.judge(df.limit(0), rules).count() == 0


def test_a_long_list(spark):
    """More keys than one block holds, and none lost."""
    rules = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".com/p/")).alias("rule"), F.lit("block").alias("action"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), "id", F.lit(".com/p/x")).alias("url"))
    got = {x.page_id for x in url_filters.judge(pages, rules).where("verdict = 'block'").collect()}
    assert got == set(range(3000))


# classifier ---------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {x.doc_id: x for x in registry.op7_quality_classifier(spark, sf).collect()}
    assert len(got) == 1000
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in labels if got[i].held_out]
    assert len(held) > 50 and sum(got[i].predicted == labels[i] for i in held) >= 0.97 * len(held)


def test_scores_are_dot_products(spark):
    weights = np.random.default_rng(0).normal(size=(1 << quality_classifier.BITS) + 1)
    texts = ["", None, "a", "a a a b", "The | table | 12 %%%", "x " * 3000]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = {x.doc_id: x.score for x in quality_classifier.score(df, weights).collect()}
    for i, t in enumerate(texts):
        chunk = quality_classifier.Chunk([(t or "").encode()])
        _, slots, words = quality_classifier.features(chunk)
        counts = Counter(slots.tolist())
        z = weights[-1] + sum(weights[s] * c for s, c in counts.items()) * quality_classifier.SCALE / max(1, int(words[0]))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -35, 35))))
    none = quality_classifier.train(df, df.select("doc_id", F.lit(None).cast("int").alias("quality")))
    assert not none.any()


# vectors ------------------------------------------------------------------------------------


def vectors(seed, n=400, d=24):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n // 4, d))
    x = np.concatenate([base, base[: n // 4] + 0.25 * r.normal(size=(n // 4, d)), np.repeat(base[:2], n // 8, axis=0) + 0.1 * r.normal(size=(2 * (n // 8), d)), np.repeat(base[2:3], n // 4, axis=0)])
    return x.astype(np.float32)


@pytest.mark.parametrize("seed", range(3))
def test_links(spark, seed, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 40)
    x = vectors(seed)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, n_links int").repartition(3)
    got = {q.vec_id: q for q in vector_dedup.dedup(df).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (y @ y.T >= 0.9) & ~np.eye(len(y), dtype=bool)
    total = near.sum()
    found = sum(q.n_links for q in got.values())
    assert 0.99 * total <= found <= total
    assert all(got[i].n_links <= near[i].sum() for i in range(len(y)))
    groups = brute.Groups(range(len(y)))
    for i, j in zip(*np.nonzero(near), strict=True):
        groups.join(int(i), int(j))
    same = sum(got[i].component_id == groups.find(i) for i in range(len(y)))
    assert same >= 0.99 * len(y) and all(q.kept == (q.vec_id == q.component_id) for q in got.values())


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (None, [2.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, None]), (8, [1.0, 0.0, 0.0]), (1, [1.0, 0.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vector_dedup.dedup(df).collect()
    assert len(got) == len(rows)
    links = Counter((q.vec_id, q.n_links, q.component_id) for q in got)
    assert links[1, 2, None] == 2 and links[None, 2, None] == 1
    assert all(links[i, 0, i] == 1 for i in (2, 3, 4, 5, 6, 7, 8, 9))
    assert vector_dedup.dedup(df.limit(0)).count() == 0


def test_very_small_and_very_large_vectors(spark):
    rows = [(1, [1e-200, 0.0]), (2, [3e-200, 1e-201]), (3, [1e200, 0.0]), (4, [2e200, 1e199]), (5, [5e-324, 0.0]), (6, [0.0, 1.7e308]), (7, [1e-320, 1.7e308])]
    got = {q.vec_id: (q.n_links, q.component_id) for q in vector_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (4, 1) for i in range(1, 6)} | {6: (1, 6), 7: (1, 6)}


# classifier training ------------------------------------------------------------------------


def test_training_is_the_plain_rule():
    """Follow-the-regularised-leader, number by number, against dictionaries."""
    from math import copysign, exp, sqrt

    c = quality_classifier
    r = random.Random(4)
    model, z, n = c.Ftrl(50), Counter(), Counter()
    for _ in range(200):
        slots = sorted(r.sample(range(50), 6))
        values, label = [r.random() * 3 for _ in slots], float(r.random() < 0.4)
        w = {s: 0.0 if abs(z[s]) <= c.L1 else -(z[s] - copysign(c.L1, z[s])) / ((c.BETA + sqrt(n[s])) / c.ALPHA + c.L2) for s in slots}
        p = 1 / (1 + exp(-sum(w[s] * v for s, v in zip(slots, values, strict=True))))
        for s, v in zip(slots, values, strict=True):
            g = (p - label) * v
            z[s] += g - (sqrt(n[s] + g * g) - sqrt(n[s])) / c.ALPHA * w[s]
            n[s] += g * g
        model.learn(np.array(slots), np.array(values), label)
    assert np.allclose(model.z, [z[i] for i in range(50)]) and np.allclose(model.n, [n[i] for i in range(50)])


def test_features_of_a_text():
    """Words, pairs and shapes of a text, each as often as it comes."""
    from picotick.llm._hashing import Chunk

    doc, slot, words = quality_classifier.features(Chunk([b"the cat the dog", b"", b"the"]))
    assert words.tolist() == [4, 0, 1] and Counter(doc.tolist())[1] == 0
    # four words and shapes, three pairs of each, two threes, and 3 + 2 + 1 looks back
    assert Counter(doc.tolist()) == {0: 4 + 4 + 3 + 3 + 2 + 3 + 2 + 1, 2: 2}
    first = slot[doc == 0]
    assert set(slot[doc == 2]) <= set(first) and Counter(first.tolist())[int(slot[doc == 2][0])] == 2


# very long texts ----------------------------------------------------------------------------


def test_texts_of_over_a_megabyte(spark):
    """Every operator on texts takes one text whole, whatever its length."""
    long = " ".join(f"word{i % 7919}" for i in range(150_000))
    assert len(long) > 1_200_000
    docs = spark.createDataFrame([(1, long, "s"), (2, long + " end", "s"), (3, "short text of some words", "t")], "doc_id long, text string, source string")
    rules = {q.doc_id: q for q in quality_rules.score(docs).collect()}
    assert rules[1].n_words == 150_000 and rules[2].n_repeat_words > 100_000
    near = {q.doc_id: q for q in jaccard_join.join(docs).collect()}
    assert (near[1].component_id, near[2].component_id, near[1].n_links) == (1, 1, 1) and near[1].n_shingles == 7919
    taken = {q.doc_id: q for q in mixing.mix(docs).collect()}
    assert taken[1].size == 150_000 and taken[3].size == 5
    pieces = packing.pack(docs.select("doc_id", F.substring("text", 1, 300_000).alias("text")).unionByName(docs.select("doc_id", "text").where("doc_id = 3"))).collect()
    assert sum(q.length for q in pieces if q.doc_id == 1) > 60_000 and max(q.offset + q.length for q in pieces) <= 1024
    scores = {q.doc_id: q.score for q in quality_classifier.score(docs, np.zeros((1 << quality_classifier.BITS) + 1)).collect()}
    assert scores == {1: 0.5, 2: 0.5, 3: 0.5}
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), "text")
    formatted = {q.conv_id: q.formatted for q in chat_format.format_conversations(turns).collect()}
    assert chat_format.parse(formatted[2])[0][1] == long + " end"
    pages = spark.createDataFrame([(1, "http://example.com/" + "a/" * 600_000), (2, "x" * 1_300_000)], "page_id long, url string")
    judged = {q.page_id: q for q in url_filters.judge(pages, spark.createDataFrame([("com/a/", "block")], "rule string, action string")).collect()}
    assert (judged[1].verdict, len(judged[1].path), judged[2].host) == ("block", 1_200_001, "")


# Jaccard ------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_jaccard(spark, seed, monkeypatch):
    """Families of edited copies around the threshold, split into tiny blocks."""
    monkeypatch.setattr(jaccard_join, "SMALL_BLOCK", 4 if seed else 100)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 400_000 if seed == 1 else 150)
    monkeypatch.setattr(jaccard_join, "SKETCH_BLOCK", 5 if seed else 20_000)
    monkeypatch.setattr(_spark, "SHORT", 200_000 if seed else 0)
    r = random.Random(seed)
    rows = []
    for f in range(8):
        base = [f"W{f}x{i}" for i in range(r.choice([3, 4, 12, 60, 200]))]
        for _ in range(r.randint(1, 14)):
            words = list(base)
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = r.choice(["edit", "EDIT", "other"])
            rows.append(" ".join(words))
    rows += ["", None, "a", "A", "a b c", "one two three four"] * 2
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component_id int").repartition(3)
    got = jaccard_join.join(df).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute.jaccard(rows)
    assert {x.doc_id: x.n_links for x in got} == brute.jaccard_links(rows)


def test_shared_passages_chain_no_clusters(spark, monkeypatch):
    """Each text shares a passage with the next one: no two link, and none may be compared in a block."""
    r, dealt, plain = random.Random(5), [], jaccard_join._dealt
    passages = [[f"p{r.random()}" for _ in range(30)] for _ in range(301)]
    rows = [(i, " ".join(passages[i] + [f"w{r.random()}" for _ in range(40)] + passages[i + 1])) for i in range(300)]
    rows += [(i + 1000, rows[i][1] + " end") for i in range(0, 300, 50)]

    def counted(placed, *carried):
        dealt.append(placed.agg(F.sum("blocks")).first()[0] or 0)
        return plain(placed, *carried)

    monkeypatch.setattr(jaccard_join, "_dealt", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.join(df, width=5, percent=80).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute.jaccard(rows, 5, 80)
    assert dealt == [0, 12]


@pytest.mark.parametrize("few", [1, 3, 32])
def test_meetings_of_a_token(spark, few, monkeypatch):
    """Batches may end inside the sets of a token: all pairs of fitting sizes stay, alone or in one star."""
    monkeypatch.setattr(jaccard_join, "FEW", few)
    r = random.Random(few)
    size = {node: r.choice([10, 11, 12, 20, 21, 40]) for node in range(1, 60)}
    rows = [(t, size[node], node) for t in range(9) for node in r.choices(list(size), k=2 + 5 * t)]
    df = spark.createDataFrame(rows, "token long, n int, node long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = jaccard_join._meetings(df, 85).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pairs = {frozenset((x.a, x.b)) for x in got if not x.star}
    groups = Groups(60)
    for x in got:
        if x.star:
            groups.join(x.a, x.b)
    want = {frozenset((a[2], b[2])) for a in rows for b in rows if a[0] == b[0] and a[2] != b[2] and 100 * min(a[1], b[1]) >= 85 * max(a[1], b[1])}
    assert pairs <= want
    assert all(p in pairs or len({groups.find(i) for i in p}) == 1 for p in want)


def test_odd_documents(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (6, None)], "doc_id long, text string")
    assert Counter((x.doc_id, x.n_shingles, x.n_links, x.component_id) for x in jaccard_join.join(df).collect()) == Counter({(None, 1, 2, None): 1, (5, 1, 2, None): 2, (6, 0, 0, 6): 1})
    assert jaccard_join.join(df.limit(0)).count() == 0


def test_texts_that_share_an_id(spark):
    """Rows of one null or repeated id: each is linked by its own text, and no row is multiplied."""
    words = lambda f: [f"w{f}x{i}" for i in range(60)]
    edited = lambda f: " ".join([*words(f)[:-1], "edit"])
    rows = [(None, " ".join(words(f))) for f in range(6)] + [(7, " ".join(words(f))) for f in range(6, 12)]
    rows += [(100 + f, edited(f)) for f in range(12)] + rows[:2] + rows[6:8]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.join(df).collect())
    want = {i: c for i, (_, c) in brute.jaccard(list(enumerate(t for _, t in rows))).items()}
    least = {c: min((rows[i][0] for i in want if want[i] == c), key=lambda d: (d is not None, d or 0)) for c in set(want.values())}
    assert got == Counter((d, 57, least[want[i]]) for i, (d, _) in enumerate(rows))
    assert Counter(c for (_, _, c) in got.elements()) == {None: 14, 7: 14}


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(r.randint(0, 80), r.randint(0, 80)) for _ in range(50)] + [(7, 7)]
    groups = brute.Groups(range(200))
    for a, b in links:
        groups.join(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(i, i) == groups.find(i) for i in range(200))
