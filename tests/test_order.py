"""Exact order statistics, places and resampling against NumPy and plain Python."""

import math
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from picotick.operators import order, ranking, resampling, robust


def test_image_is_the_bits_of_a_double(spark):
    r = random.Random(1)
    xs = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.7976931348623157e308, -1.7976931348623157e308]
    xs += [x for e in range(-1074, 1024, 7) for p in [2.0**e] for x in (p, -p, np.nextafter(p, math.inf).item(), np.nextafter(p, 0).item())]
    xs += [x for x in (struct.unpack("<d", struct.pack("<Q", r.getrandbits(64)))[0] for _ in range(3000)) if math.isfinite(x)]
    for x in spark.createDataFrame([(x,) for x in xs], "x double").select("x", order.image(F.col("x")).alias("i")).collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(x.x)))[0]
        assert x.i == (-bits if x.x < 0 else bits), x.x


def groups(seed):
    r = random.Random(seed)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), r.choice([r.gauss(0, 1), r.gauss(0, 1e-300), float(round(r.gauss(0, 2))), 1e300 * r.random(), -(10.0 ** r.randint(-300, 300)), None]), r.gauss(5, 2)) for _ in range(400)]
    return [*rows, ("none", None, 1.0), ("one", 7.0, None)]


PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]


@pytest.mark.parametrize(("few", "digit"), [(10**6, 12), (20, 3), (3, 5), (1, 12)])
def test_quantiles(spark, monkeypatch, few, digit):
    """Sorted at once, by rounds of a few bits, and down to single values."""
    monkeypatch.setattr(order, "FEW", few)
    monkeypatch.setattr(order, "DIGIT", digit)
    rows = groups(few)
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    found = order.quantiles(df, {"qx": (F.col("x"), PROBABILITIES), "qy": (F.abs("y"), [0.5])}, ["g"], (F.count("*").alias("n"),)).collect()
    assert len(found) == 5
    for f in found:
        xs, ys = [x for g, x, _ in rows if g == f.g and x is not None], [abs(y) for g, _, y in rows if g == f.g and y is not None]
        assert f.n == sum(g == f.g for g, *_ in rows)
        assert f.qx == ([pytest.approx(v, rel=1e-12) for v in np.quantile(xs, PROBABILITIES)] if xs else [None] * 6), f.g
        assert f.qy == ([pytest.approx(np.median(ys), rel=1e-12)] if ys else [None])


@pytest.mark.parametrize("few", [10**6, 4])
def test_quantiles_without_keys_and_of_nothing(spark, monkeypatch, few):
    monkeypatch.setattr(order, "FEW", few)
    df = spark.createDataFrame([(float(i % 7),) for i in range(50)], "x double")
    assert order.quantiles(df, {"q": (F.col("x"), [0.5, 0.9])}, []).first().q == list(np.quantile([i % 7 for i in range(50)], [0.5, 0.9]))
    assert order.quantiles(df.limit(0), {"q": (F.col("x"), [0.5])}, ["x"]).count() == 0


def test_robust_filter_by_rounds(spark, monkeypatch):
    r = random.Random(9)
    rows = [(r.choice(["a", None]), r.gauss(0, 1) if r.random() < 0.9 else r.gauss(0, 40), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, x double, i int")
    want = sorted(x.i for x in robust.mad_filter(df, "x", ["g"], 3.0).collect())
    monkeypatch.setattr(order, "FEW", 16)
    assert sorted(x.i for x in robust.mad_filter(df, "x", ["g"], 3.0).collect()) == want and len(want) < 600


def test_places_and_ranks(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "a", None, "b"]), r.choice([None, *range(6)]), i) for i in range(300)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "g string, v int, i int, _r int").repartition(6)
    by = defaultdict(list)
    for g, v, i in rows:
        by[g].append((v is not None, v or 0, i))
    want = {(g, x[2]): k for g, xs in by.items() for k, x in enumerate(sorted(xs))}
    assert {(x.g, x.i): x.p for x in ranking.ordinal_rank(df, "v", "i", ["g"], "p").collect()} == want
    means = defaultdict(list)
    for (g, i), k in want.items():
        means[g, rows[i][1]].append(k + 1)
    assert {(x.g, x.i): x.p for x in ranking.average_rank(df, "v", ["g"], "p").collect()} == {(g, i): pytest.approx(np.mean(means[g, rows[i][1]])) for g, i in want}
    kept = ranking.lowest_percent(df, "v", "i", ["g"], 25)
    assert Counter(x.g for x in kept.collect()) == Counter({g: len(xs) // 4 for g, xs in by.items()})
    folds = ranking.folds(df, "i", 4, "s", ["g"]).groupBy("g").pivot("fold_id").count().collect()
    assert all(max(x[1:]) - min(x[1:]) <= 1 for x in folds)
    sums = {(x.g, x.i): x.s for x in order.running(df, ["g"], ["i"], F.col("i").cast("long"), "s").collect()}
    assert sums == {(g, i): sum(j for h, _, j in rows if h == g and j <= i) for g, _, i in rows}
    assert order.placed(df.limit(0), [], ["i"], "p").count() == 0


def test_largest_are_never_null(spark):
    df = spark.createDataFrame([(i, float(i - 10) if i % 3 else None) for i in range(20)], "i int, a double")
    got = {x.i for x in ranking.extreme_flags(df, ["a"], "i", [], 0.1).where("top_a").collect()}
    assert got == {1, 19}


# resampling ---------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 7, 8, 9, 100, 1000])
def test_blocks_share_all_picks(n):
    size, draws = 8, 200
    each = np.array([resampling.picks_in_block(n, b, draws, 5, size) for b in range(-(-n // size))])
    assert (each.sum(axis=0) == n).all() and (each >= 0).all()
    if n == 1000:  # a block of 8 of 1000 rows is picked binomially
        assert abs(each.mean() - 8) < 0.1 and abs(each.var() - 8 * 0.992) < 0.4
    again = {}
    assert [resampling.picks_in_block(n, b, draws, 5, size, again) for b in range(-(-n // size))] == each.tolist()


def test_hashes_agree(spark):
    got = resampling.mixed(spark.range(500), "h", 7, [F.col("id"), F.col("id") * 9_000_000_000]).collect()
    assert [x.h for x in got] == resampling.mix(7, np.arange(500), np.arange(500) * 9_000_000_000).tolist()
    spread = resampling.mix(3, np.arange(100_000)) % np.uint64(10)
    assert np.bincount(spread.astype(int)).min() > 9_700


@pytest.mark.parametrize("block", [1 << 16, 8])
def test_bootstrap(spark, monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    rows = [(g, 100 * j + i, float(i)) for j, (g, n) in enumerate([("a", 50), (None, 21), ("b", 1)]) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id int, x double").repartition(3)
    draws = 12
    got = Counter((x.g, x.draw, x.id, x.x) for x in resampling.bootstrap(df, ["g"], "id", draws, 3).collect())
    want = Counter()
    for g in ("a", None, "b"):
        mine = sorted((i, x) for h, i, x in rows if h == g)
        for b in range(-(-len(mine) // block)):
            part = mine[b * block : (b + 1) * block]
            for d, picks in enumerate(resampling.picks_in_block(len(mine), b, draws, 3, block)):
                for h in resampling.mix(3, np.full(picks, d), np.full(picks, b), np.arange(picks)):
                    want[(g, d, *part[int(h) % len(part)])] += 1
    assert got == want
    assert resampling.bootstrap(df.limit(0), ["g"], "id", draws, 3).count() == 0


@pytest.mark.parametrize(("block", "piece", "stretch"), [(1 << 16, 1 << 14, 1 << 20), (8, 4, 16)])
def test_resample_draws_as_sql_at_any_size(spark, monkeypatch, block, piece, stretch):
    for name, value in (("BLOCK", block), ("PIECE", piece), ("STRETCH", stretch)):
        monkeypatch.setattr(resampling, name, value)
    rows = [(g, 100 * j + i, float(i)) for j, (g, n) in enumerate([("a", 50), (None, 21), ("b", 1), ("c", 8)]) for i in range(n)]
    df, draws = spark.createDataFrame(rows, "g string, id int, x double").repartition(3), 12
    want = Counter()
    for g in {g for g, *_ in rows}:
        mine = sorted((i, x) for h, i, x in rows if h == g)
        for d in range(draws):
            for h in resampling.mix(3, d, 0, np.arange(len(mine))):
                want[(g, d, *mine[int(h) % len(mine)])] += 1
    assert Counter((x.g, x.draw, x.id, x.x) for x in resampling.resample(df, ["g"], "id", draws, 3).collect()) == want
    whole = Counter(x.id for x in resampling.resample(df.drop("g"), [], "id", 1, 3).collect())
    ids = sorted(i for _, i, _ in rows)
    assert whole == Counter(ids[int(h) % len(ids)] for h in resampling.mix(3, 0, 0, np.arange(len(ids))))
    assert resampling.resample(df.limit(0), ["g"], "id", draws, 3).count() == 0


def test_poisson_weights_hash_once(spark):
    import hashlib
    import math

    found = resampling.poisson_weights(spark.range(400), "id", 3, "p")
    cuts = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]
    u = lambda d, i: (int(hashlib.md5(f"{d}:{i}:p".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
    want = {(i, d): w for i in range(400) for d in range(3) if (w := sum(u(d, i) >= c for c in cuts))}
    assert {(x.id, x.draw): x.weight for x in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1


def test_bootstrap_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), ("a", 3, 3.0), ("a", 4, 4.0)], "g string, id int, x double")
    assert {x.g: x["count"] for x in resampling.bootstrap(df, ["g"], "id", 10, 1).groupBy("g").count().collect()} == {None: 20, "a": 20}


@pytest.mark.parametrize(("n", "k"), [(300, 40), (300, 299), (40, 1), (5, 0), (5, 5)])
def test_thresholds(spark, monkeypatch, n, k):
    monkeypatch.setattr(resampling, "BLOCK", 64)
    for d, (t, at) in enumerate(resampling.thresholds(spark, n, k, 6, 77), 1):
        h = resampling._place_hash(77, d, np.arange(n)).tolist()
        assert {i for i in range(n) if h[i] < t or (h[i] == t and i <= at)} == set(sorted(range(n), key=lambda i: (h[i], i))[:k])


@pytest.mark.parametrize("size", [1 << 16, 32])
def test_permutations(spark, monkeypatch, size):
    monkeypatch.setattr(resampling, "BLOCK", size)
    n, draws, block, seed = 203, 40, 16, 5
    r = random.Random(8)
    flags = [r.random() < (0.6 if 60 < i < 110 else 0.1) for i in range(n)]
    k = sum(flags)

    def statistics(chosen):
        at = [i for i in range(n) if chosen[i]]
        ks = max(max(abs((u + 1) / k - (i + 1) / n), abs(u / k - i / n)) for u, i in enumerate(at))
        share = k / n
        chi2 = sum((sum(chosen[a : a + block]) - m * share) ** 2 / (m * share * (1 - share)) for a in range(0, n, block) for m in [min(block, n - a)])
        return {"ks": ks, "chi2": chi2, "adjacent": float(sum(chosen[i] and chosen[i + 1] for i in range(n - 1)))}

    seen = statistics(flags)
    more = Counter()
    for d in range(1, draws + 1):
        h = resampling._place_hash(seed, d, np.arange(n)).tolist()
        first = set(sorted(range(n), key=lambda i: (h[i], i))[:k])
        for t, v in statistics([i in first for i in range(n)]).items():
            more[t] += v >= seen[t] - 1e-9 * abs(seen[t])
    df = spark.createDataFrame([(1000 - i, i, f if f or i % 2 else None) for i, f in enumerate(flags)], "id int, at int, f boolean").repartition(3)
    got = {x.test: x for x in resampling.permutation_tests(df, F.col("f"), "at", "id", draws, seed, block).collect()}
    assert set(got) == set(seen)
    for t, x in got.items():
        assert (x.n, x.k, x.statistic, x.p) == (n, k, pytest.approx(seen[t]), pytest.approx((more[t] + 1) / (draws + 1))), t
    none = resampling.permutation_tests(df.where("not f"), F.col("f"), "at", "id", draws, seed, block).collect()
    assert [x.p for x in none] == [None] * 3


def test_average_ranks_put_distinct_values_in_order_only(spark):
    from picotick.operators import ranking

    rows = [(g, x) for g in ("a", None) for x in [2.0, None, 2.0, -0.0, 0.0, 7.0, 2.0]]
    df = spark.createDataFrame(rows, "g string, x double")
    found = ranking.average_rank(df, "x", ["g"], "r")
    assert Counter((q.g, q.x, q.r) for q in found.collect()) == Counter((g, x, {None: 1.0, 0.0: 2.5, 2.0: 5.0, 7.0: 7.0}[x]) for g, x in rows)
    # the rows themselves are neither put in order nor dealt to windows
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert not [f for f in found.inputFiles() if "_place" in str(spark.read.parquet(f).columns)]


def test_rank_correlations_shuffle_values_not_rows(spark, monkeypatch):
    """Several sides against one: nulls and groups of one value included, and the other side is ranked once."""
    from picotick.operators import ranking

    r = np.random.default_rng(5)
    rows = [(int(g), float(a), float(c), float(b)) for g, a, c, b in zip(r.integers(0, 3, 600), r.integers(0, 9, 600), r.normal(size=600), r.integers(0, 200, 600), strict=True)]
    rows += [(None, 1.0, 2.0, float(i)) for i in range(5)] + [(9, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, a double, c double, b double")
    ranked = []
    plain = ranking._average_ranks
    monkeypatch.setattr(ranking, "_average_ranks", lambda d, v, k, n: (ranked.append(v), plain(d, v, k, n))[1])
    got = {q.g: q for q in ranking.spearmans(df, ["a", "c"], "b", ["g"]).collect()}
    assert ranked == ["a", "c"]
    place = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    for g in range(3):
        own = np.array([q[1:] for q in rows if q[0] == g])
        for i, name in enumerate(("spearman_a", "spearman_c")):
            assert abs(got[g][name] - np.corrcoef(place(own[:, i]), place(own[:, 2]))[0, 1]) < 1e-12
    assert got[None].spearman_a is got[None].spearman_c is got[9].spearman_a is None and len(got) == 5
