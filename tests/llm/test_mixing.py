import random
from collections import defaultdict

import pytest

from picotick.llm import mixing

SF = "/root/testdata/sf0.001"


def reshared(sizes, weights=(5.0, 2.0, 1.0), most=3):
    """Targets by the rule as stated: share by weight, stop at the cap, reshare until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        open_ = [s for s in order if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > most * sizes[s]]
        if not above:
            return {**share, **capped}
        capped |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i}": r.choice([0, 1, 5, 50, 1000]) for i in range(r.randint(1, 9))} | ({None: 7} if seed % 2 else {})
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = reshared(sizes)
    assert {x.source: x.target for x in got} == pytest.approx(want, abs=1e-4)


def check(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    want = reshared({s: sum(r.size for r in g) for s, g in by.items()})
    for s, g in by.items():
        assert all(r.target == pytest.approx(want[s], abs=1e-4) for r in g)
        assert all(0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0) for r in g)
        times = {r.times for r in g if r.size}
        assert not times or max(times) - min(times) <= 1  # whole epochs come first
        # what is missing is less than the smallest document that was left out
        gap = g[0].target - sum(r.taken for r in g)
        assert gap >= -1e-6
        left_out = [r.size for r in g if r.size and r.times == min(times)] if len(times) == 2 else []
        assert not left_out or gap < max(left_out) or gap < 0.02 * g[0].target


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix(docs).collect()
    check(rows)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_weighted_draw(spark):
    """Short documents weigh less, so they are drawn less often."""
    d = spark.range(4000).selectExpr("id AS doc_id", "if(id % 2 = 0, 'x x x x x', repeat('y ', 250)) AS text", "if(id < 3000, 'a', 'b') AS source")
    rows = [r for r in mixing.mix(d).collect() if r.source == "a"]
    drawn = {n: sum(r.times - min(x.times for x in rows) for r in rows if r.size == n) for n in (5, 250)}
    assert drawn[5] < drawn[250]


def test_odd_rows(spark):
    d = spark.createDataFrame([(None, "a b", None, 1), (1, None, "x", 2), (1, "", "x", 3), (2, "c", "x", 4), (2, "c", "x", 5)], "doc_id long, text string, source string, target int")
    rows = mixing.mix(d).collect()
    assert len(rows) == 5 and all(r.taken == 0 for r in rows if not r.size)
    check(rows)
    assert mixing.mix(d.limit(0)).count() == 0


def test_repeats_do_not_overshoot(spark):
    """Of 200 repeats of one row only as many are taken as the target allows; with and without the fill."""
    d = spark.range(600).selectExpr("if(id < 200, -1, id) AS doc_id", "if(id < 200, 'a b c d e', repeat('y ', cast(id % 37 + 1 AS int))) AS text", "if(id < 500, 'a', 'b') AS source")
    d = d.unionByName(d.where("doc_id = -1").selectExpr("CAST(NULL AS bigint) AS doc_id", "text || ' f' AS text", "'b' AS source")).repartition(5)
    rows = mixing.mix(d).collect()
    assert len(rows) == 800
    check(rows)
    for s, g in by_source(rows).items():
        assert sum(r.taken for r in g) >= 0.98 * g[0].target, s
    assert sorted((r.doc_id or 0, r.size, r.taken) for r in rows) == sorted((r.doc_id or 0, r.size, r.taken) for r in mixing.mix(d.repartition(2)).collect())
    plain = mixing.mix(d, fill=False).collect()
    check(plain)
    assert all(sum(r.taken for r in g) <= sum(r.taken for r in by_source(rows)[s]) for s, g in by_source(plain).items())


def by_source(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    return by
