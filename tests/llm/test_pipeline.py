import random
from collections import Counter, defaultdict

import corpus_pipeline as P
from picotick.llm import jaccard_join, mixing

from . import brute
from .test_packing import check

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    kept = P.drop_rejected(spark, docs, SF)
    assert kept.columns == docs.columns
    got = {r.doc_id: r.text for r in kept.collect()}
    for i, r in rows.items():
        n, chars, symbols, lines, repeats = brute.quality(r.text)
        if n < 10 or 100 * repeats > 20 * n or symbols > 0.1 * n:
            assert i not in got
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(i in got for i, q in labels.items() if q == 0) <= 1
    clean = [i for i, q in labels.items() if q == 1 and brute.quality(rows[i].text)[0] >= 10]
    assert sum(i in got for i in clean) >= 0.97 * len(clean)

    single = P.drop_near_duplicates(spark, kept, SF)
    assert single.columns == docs.columns
    want = {i for i, (_, c) in brute.jaccard(got.items(), 5, 80).items() if i == c}
    texts = {r.doc_id: r.text for r in single.collect()}
    assert set(texts) == want and all(texts[i] == got[i] for i in want)

    cut = P.drop_repeated_passages(spark, single, SF)
    assert cut.columns == docs.columns
    want = {i: k.decode("utf-8", "replace") for i, (_, _, k) in brute.byte_repeats(texts.items()).items()}
    left = {r.doc_id: r for r in cut.collect()}
    assert {i: r.text for i, r in left.items()} == want
    assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (rows[i].lang, rows[i].source) for i, r in left.items())

    mixed = P.mix_sources(spark, cut, SF).collect()
    times = {r.doc_id: r.times for r in mixing.mix(cut).collect()}
    copies = defaultdict(int)
    for r in mixed:
        copies[r.doc_id] += 1
        assert r.text == want[r.doc_id]
    assert dict(copies) == {i: n for i, n in times.items() if n}

    placed = P.pack_sequences(spark, spark.createDataFrame(mixed[:50]).dropDuplicates(["doc_id"]), SF)
    few = {r.doc_id: r.text for r in mixed[:50]}
    check(placed.collect(), few.items())


def test_near_duplicates_by_five_words_and_80_percent(spark):
    """Two edits in 100 words: 86 of 106 shingles of five words are shared (81 %), 84 % of those of four."""
    words = [f"w{i}" for i in range(100)]
    near = [*words[:30], "x", *words[31:60], "y", *words[61:]]
    far = [*words[:30], "x", *words[31:60], "y", *words[61:90], "z", *words[91:]]
    rows = [(1, " ".join(words), "en", "a", 0), (2, " ".join(near), "en", "a", 0), (3, " ".join(f"v{w}" for w in words), "en", "a", 0), (4, " ".join(f"v{w}" for w in far), "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    single = P.drop_near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in single.collect()) == [1, 3, 4]
    assert {i for i, (_, c) in brute.jaccard([r[:2] for r in rows], 5, 80).items() if i == c} == {1, 3, 4}
    assert {i for i, (_, c) in brute.jaccard([r[:2] for r in rows]).items() if i == c} == {1, 2, 3, 4}


def test_near_duplicates_among_chained_passages(spark, monkeypatch):
    """Texts that share a passage with the next one all stay, and only near copies travel to blocks."""
    r, placed, plain = random.Random(6), [], jaccard_join._dealt
    passages = [[f"p{r.random()}" for _ in range(30)] for _ in range(121)]
    rows = [(i, " ".join(passages[i] + [f"w{r.random()}" for _ in range(40)] + passages[i + 1])) for i in range(120)]
    rows.append((500, rows[7][1] + " end"))

    def counted(members, *carried):
        placed.append(sorted(x.node for x in members.select("node").collect()))
        return plain(members, *carried)

    monkeypatch.setattr(jaccard_join, "_dealt", counted)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted(x.doc_id for x in P.drop_near_duplicates(spark, df, SF).collect()) == list(range(120))
    assert [len(p) for p in placed] == [0, 2]


def test_near_duplicates_with_null_and_repeated_ids(spark):
    """Every group leaves one row, also where its least id is null or its rows repeat; groups of one id stay apart."""
    text = lambda f: " ".join(f"w{f}x{i}" for i in range(100))
    edited = lambda f: text(f).replace(f"w{f}x50", "edit")
    rows = [(None, text(0)), (1, text(0)), (2, edited(0)), (None, text(0))]  # a null id in a group
    rows += [(None, text(1)), (3, edited(1))]  # another group with a null id
    rows += [(4, text(2))] * 3 + [(5, text(2))]  # repeated rows
    rows += [(6, text(3)), (6, text(4)), (7, edited(4))]  # one id, two groups
    rows += [(8, ""), (9, ""), (9, ""), (None, None), (10, None)]  # no words: no group
    docs = spark.createDataFrame([(*r, "en", "a", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = Counter((r.doc_id, r.text) for r in P.drop_near_duplicates(spark, docs, SF).collect())
    assert got == Counter([(None, text(0)), (None, text(1)), (4, text(2)), (6, text(3)), (6, text(4)), (8, ""), (9, ""), (None, None), (10, None)])


def test_run(spark):
    whole = P.run(spark, SF)
    assert whole.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(whole.columns)


def test_stages_on_nothing(spark):
    """Each stage of an empty table gives an empty one, with the columns it always has."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == list(P.COLUMNS) and docs.count() == 0, name
    assert P.pack_sequences(spark, docs, SF).count() == 0


def test_stages_on_odd_rows(spark):
    """Null ids, texts, sources and languages, empty texts, repeated rows."""
    prose = lambda k: " ".join(f"The word{k}x{i} of a{k}y{i} and the b{k}z{i}." for i in range(12))
    rows = [(None, prose(0), None, None, None), (1, prose(1), "en", None, 5), (1, prose(1), "en", None, 5), (2, None, "en", "a", 0), (3, "", "en", "a", 0), (4, prose(2), "en", "a", 1), (5, prose(2), "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = P.drop_rejected(spark, docs, SF)
    assert Counter(r.doc_id for r in kept.collect()) == {None: 1, 1: 2, 4: 1, 5: 1}
    single = P.drop_near_duplicates(spark, kept, SF)
    assert Counter(r.doc_id for r in single.collect()) == {None: 1, 1: 1, 4: 1}
    cut = {r.doc_id: r for r in P.drop_repeated_passages(spark, single, SF).collect()}
    assert {i: r.text for i, r in cut.items()} == {None: prose(0), 1: prose(1), 4: prose(2)} and cut[1].n_chars == len(prose(1)) and cut[None].source is None
    mixed = P.mix_sources(spark, spark.createDataFrame(list(cut.values()), single.schema), SF).collect()
    assert set(Counter(r.doc_id for r in mixed)) <= {None, 1, 4} and max(Counter(r.doc_id for r in mixed).values()) <= 3
    check(P.pack_sequences(spark, docs.where("doc_id > 1"), SF).collect(), [(r[0], r[1]) for r in rows if r[0] and r[0] > 1])
    # a bare document passes the middle stages whatever it lacks
    bare = spark.createDataFrame([(None, None, None, None, None)], docs.schema)
    for stage in (P.drop_near_duplicates, P.drop_repeated_passages):
        assert [r.doc_id for r in stage(spark, bare, SF).collect()] == [None]
    assert P.mix_sources(spark, bare, SF).collect() == []
