import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from picotick.operators import matching, walks

KIND = "kind"


def hits(spark, seed, n=120, span=400):
    r = random.Random(seed)
    rows = [(r.randint(0, 2), r.randint(0, span), r.choice([0, 1])) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "board int, t long, kind int").repartition(3)


def by_board(rows):
    out = {}
    for b, t, k in sorted(rows):
        out.setdefault(b, []).append((t, k))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_window_and_asof(spark, seed):
    rows, df = hits(spark, seed)
    a = df.where("kind = 0").select("board", F.col("t").alias("e")).withColumn("id", F.monotonically_increasing_id())
    b = df.where("kind = 1").select("board", F.col("t").alias("p"))
    got = sorted((r.board, r.e, r.p) for r in matching.window_join(a, b, ["board"], "e", "p", 30).collect())
    want = sorted((x, t, u) for x, t, k in rows if k == 0 for y, u, m in rows if m == 1 and x == y and t - 30 < u < t)
    assert got == want
    latest = sorted((r.board, r.e, -1 if r.p is None else r.p) for r in matching.latest_before(a, b, ["board"], "e", "p", 30, "id").collect())
    assert latest == sorted((x, t, max([u for y, u, m in rows if m == 1 and x == y and t - 30 < u < t], default=-1)) for x, t, k in rows if k == 0)


@pytest.mark.parametrize("bucket", [3, 50])
def test_overlaps(spark, bucket):
    r = random.Random(bucket)
    make = lambda: [(r.randint(0, 1), i, s := r.randint(0, 200), s + r.randint(0, 30)) for i in range(60)]
    x, y = make(), make()
    a = spark.createDataFrame(x, "k int, a long, alo long, ahi long")
    b = spark.createDataFrame(y, "k int, b long, blo long, bhi long")
    got = sorted((q.a, q.b) for q in matching.overlap_join(a, b, ["k"], ("alo", "ahi"), ("blo", "bhi"), bucket).collect())
    assert got == sorted((p[1], q[1]) for p in x for q in y if p[0] == q[0] and p[2] <= q[3] and q[2] <= p[3])


@pytest.mark.parametrize("seed", range(3))
def test_pairs(spark, seed):
    rows, df = hits(spark, seed)
    got = sorted((r.board, r.lead, r.trail) for r in matching.pair_edges(df, ["board"], F.col(KIND) == 0, F.col(KIND) == 1, "t").collect())
    want = []
    for b, seq in by_board(rows).items():
        waiting = []
        for t, lead in sorted((t, k == 0) for t, k in seq):
            if lead:
                waiting.append(t)
            elif waiting and waiting[0] < t:
                want.append((b, waiting.pop(0), t))
    assert got == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_longest_valid_does_not_depend_on_segments(spark, seed):
    rows, df = hits(spark, seed, n=60, span=2000)
    got = sorted((r.board, r.lead, r.trail) for r in matching.longest_valid_pulses(df, ["board"], F.col(KIND), "t", 3, 40).collect())
    want = []
    for b, seq in by_board(rows).items():
        waiting = []
        for t, k in seq:
            if k == 0:
                waiting.append(t)
                continue
            waiting = [x for x in waiting if t - x <= 40]
            if waiting and t - waiting[0] >= 3:
                want.append((b, waiting.pop(0), t))
    assert got == sorted(want)
    assert all(3 <= t - x <= 40 for _, x, t in got)


def test_nearest_is_one_to_one(spark):
    rows, df = hits(spark, 5, n=200, span=900)
    got = [(r.board, r.a, r.b) for r in matching.monotonic_nearest(df, ["board"], F.col(KIND), "t", 6).collect()]
    assert got and all(abs(a - b) <= 6 for _, a, b in got)
    count = lambda k: {(b, t): sum(1 for y in rows if y == (b, t, k)) for b, t, kk in rows if kk == k}
    for side, k in ((1, 0), (2, 1)):
        used = {}
        for g in got:
            used[g[0], g[side]] = used.get((g[0], g[side]), 0) + 1
        assert all(n <= count(k)[key] for key, n in used.items())


def test_repeated_ids_raise(spark):
    with pytest.raises(Exception, match="repeated"):
        matching.unique_ids(spark.createDataFrame([(1,), (1,)], "k int"), ["k"]).collect()


def test_edges_pair_like_a_queue(spark):
    """Against a plain queue: equal times, cells shorter than a pulse, a null board, repeated edges."""
    import random
    from collections import defaultdict, deque

    from pyspark.sql import functions as F

    from picotick.operators import matching

    r = random.Random(3)
    rows = [(r.choice([1, 2, None]), r.randint(0, 300), r.random() < 0.55) for _ in range(400)]
    df = spark.createDataFrame(rows, "board int, t long, lead boolean").repartition(3)
    got = sorted((x.board or 0, x.lead, x.trail) for x in matching.pair_edges(df, ["board"], F.col("lead"), ~F.col("lead"), "t", span=7).collect())
    open_, want = defaultdict(deque), []
    for board, t, lead in sorted(((b or 0, t, lead) for b, t, lead in rows)):
        if lead:
            open_[board].append(t)
        elif open_[board]:
            want.append((board, open_[board].popleft(), t))
    assert got == sorted(want)
    assert matching.pair_edges(df.limit(0), ["board"], F.col("lead"), ~F.col("lead"), "t").count() == 0
    cut = {(x.board, x.t): x.segment for x in matching.segments(df.select("board", "t"), ["board"], "t", 2).collect()}
    for board in (1, 2, None):
        times, start, before = sorted({t for b, t, _ in rows if b == board}), None, None
        for t in times:
            start = t if before is None or t - before > 2 else start
            assert cut[board, t] == start
            before = t


# walks over cells ---------------------------------------------------------------------------


def fifo(leads, trails, low, high):
    """Pairs and counts by the plain rule: each trail scans all leads."""
    used, pairs, nested = set(), [], 0
    leads, trails = sorted(leads), sorted(trails)
    dead = 0
    for t in trails:
        while dead < len(leads) and leads[dead] < t - high:
            dead += 1
        free = [i for i in range(dead, len(leads)) if i not in used and leads[i] <= t - low]
        if free:
            i = free[0]
            nested += sum(k not in used and leads[k] < t for k in range(i + 1, len(leads)))
            used.add(i)
            pairs.append((leads[i], t))
    late = [x for i, x in enumerate(leads) if i not in used and trails and x < trails[-1] - high]
    rest = list(trails)
    for _, t in pairs:
        rest.remove(t)
    return pairs, {"paired": len(pairs), "unmatched_leads": len(leads) - len(pairs), "unmatched_trails": len(rest), "too_short": sum(bool(leads) and t > leads[0] for t in rest), "too_long": len(late), "nested": nested}


def near(a, b, window, later):
    """(index, index) pairs"""
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        gap = abs(a[i] - b[j])
        if gap > window:
            i, j = (i + 1, j) if a[i] < b[j] else (i, j + 1)
        elif i + 1 < len(a) and (abs(a[i + 1] - b[j]) < gap or later and abs(a[i + 1] - b[j]) == gap):
            i += 1
        elif j + 1 < len(b) and abs(a[i] - b[j + 1]) < gap:
            j += 1
        else:
            out.append((i, j))
            i, j = i + 1, j + 1
    return out


def of(rows, board, kind):
    return sorted(t for b, t, k in rows if b == board and k == kind)


#: hits, span of times: from sparse to several a tick without a pause
DENSITIES = [(120, 4000), (200, 700), (300, 120)]


@pytest.fixture
def narrow(monkeypatch):
    """Cells of a few elements, whatever reach needs."""
    monkeypatch.setattr(walks, "CELL_ROWS", 3)
    monkeypatch.setattr(walks, "width", lambda elements, keys, least: 1)


@pytest.mark.parametrize(("n", "span"), DENSITIES)
def test_first_in_range_over_cells(spark, narrow, n, span):
    r = random.Random(n)
    rows = [(r.choice([0, 1, None]), r.randint(-span, span), r.choice([0, 0, 1])) for _ in range(n)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "board int, t long, kind int, outs int").repartition(3)
    for low, high in ((3, 40), (0, 9), (1, 200)):
        got = sorted((str(x.board), x.lead, x.trail) for x in matching.longest_valid_pulses(df, ["board"], F.col("kind"), "t", low, high).collect())
        want = {b: fifo(of(rows, b, 0), of(rows, b, 1), low, high) for b in (0, 1, None)}
        assert got == sorted((str(b), *p) for b, (pairs, _) in want.items() for p in pairs)
        counts = {x.board: x.asDict() for x in matching.longest_valid_statistics(df, ["board"], F.col("kind"), "t", low, high).collect()}
        assert counts == {b: {"board": b, **c} for b, (_, c) in want.items()}


@pytest.mark.parametrize(("n", "span"), DENSITIES)
@pytest.mark.parametrize("later", [False, True])
def test_nearest_over_cells(spark, narrow, n, span, later):
    r = random.Random(n + 1)
    rows = [(r.randint(0, 1), r.randint(-span, span), r.choice([0, 1])) for _ in range(n)]
    df = spark.createDataFrame(rows, "board int, t long, kind int").repartition(3)
    got = sorted((x.board, x.a, x.b) for x in matching.monotonic_nearest(df, ["board"], F.col("kind"), "t", 11, later_on_tie=later).collect())
    want = []
    for board in (0, 1):
        a, b = of(rows, board, 0), of(rows, board, 1)
        want += [(board, a[i], b[j]) for i, j in near(a, b, 11, later)]
    assert got == sorted(want)


@pytest.mark.parametrize(("n", "span"), DENSITIES)
def test_overlaps_over_cells(spark, narrow, n, span):
    r = random.Random(n + 2)
    make = lambda: [(r.randint(0, 1), s := r.randint(-span, span), s + r.randint(0, 30)) for _ in range(n)]
    x, y = make(), make()
    schema = "board int, lead long, trail long"
    got = sorted(tuple(q) for q in matching.one_to_one_overlaps(spark.createDataFrame(x, schema), spark.createDataFrame(y, schema), ["board"]).collect())
    want = []
    for board in (0, 1):
        a, b = (sorted(q[1:] for q in z if q[0] == board) for z in (x, y))
        i = j = 0
        while i < len(a) and j < len(b):
            if a[i][0] <= b[j][1] and b[j][0] <= a[i][1]:
                want.append((board, *a[i], *b[j]))
                i, j = i + 1, j + 1
            elif a[i][1] < b[j][0]:
                i += 1
            else:
                j += 1
    assert got == sorted(want)


@pytest.mark.parametrize(("n", "span"), DENSITIES)
@pytest.mark.parametrize("fallback", [(True, True), (True, False), (False, True), (False, False)])
def test_recorded_durations(spark, narrow, n, span, fallback):
    r = random.Random(n + 3)
    rows = [(t := r.randint(0, span), k := r.choice([0, 1]), r.choice([None, 0.0, -1.0, 2.5, 3.5, *([float(r.randint(1, 60))] * 4)]) if k or r.random() < 0.1 else None) for _ in range(n)]
    rows += rows[:9]
    df = spark.createDataFrame(rows, "t long, kind int, d double").repartition(3)
    low, high, tolerance = 3, 40, 4
    found = matching.recorded_duration_pulses(df, [], F.col("kind"), "t", F.col("d"), tolerance, low, high, if_missing=fallback[0], if_inconsistent=fallback[1])
    got = sorted(tuple(x) for x in found.collect())
    leads = sorted(t for t, k, _ in rows if k == 0)
    trails = [(t, d if d and d > 0 else None) for t, k, d in rows if k == 1]
    usable = sorted((t - round(d), t) for t, d in trails if d and low <= d <= high and round(d) <= t)
    direct = [(leads[i], usable[j][1], usable[j][0]) for i, j in near(leads, [e for e, _ in usable], tolerance, True)]
    direct = [(a, t, t - e) for a, t, e in direct if a < t and low <= t - a <= high]
    rest = list(leads)
    for a, _, _ in direct:
        rest.remove(a)
    left = [(t, round(d) if d else None) for t, d in trails]
    for _, t, d in direct:
        left.remove((t, d))
    late = [t for t, d in left if (fallback[0] if d is None else fallback[1])]
    assert got == sorted([(a, t, True) for a, t, _ in direct] + [(a, t, False) for a, t in fifo(rest, late, low, high)[0]])


def test_a_key_that_never_pauses_is_many_tasks(spark, monkeypatch):
    """Backlog that never empties: no cell forgets what came before it, and each still is a group of its own."""
    monkeypatch.setattr(walks, "CELL_ROWS", 200)
    leads = spark.range(20_000).select(F.lit(1).alias("board"), F.col("id").alias("t"), F.lit(0).alias("kind"))
    trails = spark.range(20_000).select(F.lit(1).alias("board"), (F.col("id") + 7).alias("t"), F.lit(1).alias("kind"))
    both = leads.unionByName(trails)
    found = matching.longest_valid_pulses(both, ["board"], F.col("kind"), "t", 3, 9)
    assert found.count() == 20_000 and found.where("trail - lead <> 7").count() == 0
    cell = walks.width(walks.elements(both, ["board"], F.col("t"), F.col("kind")), ["board"], 1)
    assert cell < 220


def test_walks_of_nothing(spark):
    empty = spark.createDataFrame([], "board int, t long, kind int")
    assert matching.longest_valid_pulses(empty, ["board"], F.col("kind"), "t", 3, 40).count() == 0
    assert matching.longest_valid_statistics(empty, ["board"], F.col("kind"), "t", 3, 40).count() == 0
    some = spark.createDataFrame([(1, None, 0), (1, 5, None), (1, 7, 0), (2, 3, 1)], "board int, t long, kind int")
    assert matching.monotonic_nearest(some, ["board"], F.col("kind"), "t", 4).count() == 0


def test_plan_modules_import_in_any_order():
    import subprocess
    import sys

    for module in ("matches", "scans", "training"):
        subprocess.run([sys.executable, "-c", f"import picotick.plans.{module}; from picotick.plans import registry; assert len(registry.queries()) > 150"], check=True)


def test_ticks_beyond_doubles(spark, narrow):
    """Neighbouring ticks near 2**62 are told apart, also at the borders of cells."""
    r = random.Random(12)
    rows = [(2**62 + r.randint(0, 400), r.choice([0, 1])) for _ in range(200)]
    df = spark.createDataFrame(rows, "t long, kind int").repartition(3)
    got = sorted((x.lead, x.trail) for x in matching.longest_valid_pulses(df, [], F.col("kind"), "t", 2, 9).collect())
    assert got == sorted(fifo([t for t, k in rows if k == 0], [t for t, k in rows if k == 1], 2, 9)[0])


@pytest.mark.parametrize("delay", [None, 37.5, 20.0])
def test_windows_without_their_pairs(spark, delay):
    """Counts and nearest ones are those of the joined pairs; equal times and null keys included."""
    r = np.random.default_rng(11)
    side = lambda n: [(int(k) if k else None, int(t)) for k, t in zip(r.integers(0, 4, n), r.integers(-900, 900, n), strict=True)]
    left, right = spark.createDataFrame(side(300), "k int, a long"), spark.createDataFrame(side(500), "k int, b long")
    pairs = matching.window_join(left, right, ["k"], "a", "b", 100)
    counted = {(q.k, q.a): (q.pairs, q.latest) for q in matching.window_counts(left, right, ["k"], "a", "b", 100).collect()}
    assert counted == {(q.k, q.a): (q.n, q.m) for q in pairs.groupBy("k", "a").agg(F.count("*").alias("n"), F.max("b").alias("m")).collect()} and len(counted) > 100
    d = F.lit(delay).cast("double")
    got = {(q.k, q.a): q.b for q in matching.nearest_in_window(left, right, ["k"], "a", "b", 100, d).collect()}
    assert got == {(q.k, q.a): q.b for q in matching.nearest_candidate(pairs, ["k", "a"], "b", F.col("a") - F.col("b") - d).collect()}
