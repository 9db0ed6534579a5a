import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from picotick.operators import features as X


def waves(spark, n=40, samples=24, seed=5):
    rows = np.random.default_rng(seed).normal(size=(n, samples))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + [(999, None)], "id long, x array<double>")
    return rows, df.repartition(3)


def test_shapelets(spark):
    rows, df = waves(spark)
    found = X.fit_shapelets(df, "id", "x", 12, length=5)
    again = X.fit_shapelets(df.repartition(2), "id", "x", 12, length=5)
    assert all((a.values == b.values).all() and a.near == b.near for a, b in zip(found, again, strict=True))
    assert len({s.step for s in found}) > 1 and len({s.standard for s in found}) == 2
    got = {r.id: r.features for r in X.shapelet_features(df, "id", "x", found).collect()}
    assert sorted(got) == list(range(40))
    for i in (0, 17, 39):
        for k, s in enumerate(found):
            d = []
            for start in range(24 - 4 * s.step):
                w = rows[i][start : start + 4 * s.step + 1 : s.step]
                d.append(np.abs(((w - w.mean()) / w.std() if s.standard else w) - s.values).sum())
            assert np.allclose(got[i][3 * k : 3 * k + 3], [min(d), int(np.argmin(d)), sum(v <= s.near for v in d)])
    with pytest.raises(ValueError):
        X.fit_shapelets(df, "id", "x", 1, length=25)
    with pytest.raises(ValueError):
        X.fit_shapelets(df.limit(0), "id", "x", 1)


def test_competing_kernels(spark):
    rows, df = waves(spark)
    got = {r.id: np.array(r.features) for r in X.competing_kernel_features(df, "id", "x", groups=4, kernels=3).collect()}
    assert sorted(got) == list(range(40)) and len(got[0]) == 2 * 2 * (2 * 4 // 2 * 3)
    w = np.random.default_rng(7).normal(size=(2, 6, 9))
    w -= w.mean(axis=2, keepdims=True)
    w /= np.abs(w).sum(axis=2, keepdims=True)
    for i in (0, 39):
        want = []
        for view in (0, 1):
            v = np.diff(rows[i]) if view else rows[i]
            for step in (1, 2):
                first, second = np.zeros((2, 3)), np.zeros((2, 3))
                for g in range(2):
                    for t in range(len(v)):
                        c = [sum(w[view, 3 * g + k, j] * v[t + (j - 4) * step] for j in range(9) if 0 <= t + (j - 4) * step < len(v)) for k in range(3)]
                        first[g, int(np.argmax(c))] += max(c)
                        second[g, int(np.argmin(c))] += 1
                want += [*first.ravel(), *second.ravel()]
        assert np.allclose(got[i], want)


def test_unit_phases(spark):
    wave = lambda phase: [math.cos(2 * math.pi * 0.25 * t + phase) for t in range(32)]
    df = spark.createDataFrame([(1, wave(0.3), wave(-0.5)), (2, [1.0] * 32, wave(0.1))], "id long, a array<double>, b array<double>")
    got = {r.id: r.p for r in df.select("id", X.unit_phases(F.col("a"), F.col("b"), [0.25], 32, True).alias("p")).collect()}
    assert np.allclose(got[1], [math.cos(0.8), math.sin(0.8)], atol=0.02)
    each = df.select("id", X.unit_phases(F.col("a"), F.col("b"), [0.25], 32, False).alias("p")).where("id = 1").first().p
    assert np.allclose(each, [math.cos(0.3), math.sin(0.3), math.cos(-0.5), math.sin(-0.5)], atol=0.02)


def test_draws_follow_the_conditional_law(spark):
    r = np.random.default_rng(2)
    mean, w = r.normal(size=5), r.normal(size=(5, 2))
    model, gone = (mean, w, 0.3), [1, 3]
    v = r.normal(size=5)
    df = spark.createDataFrame([(i, v.tolist()) for i in range(300)] + [(999, None)], "id long, x array<double>")
    rows = X.ppca_draws(df.repartition(3), "id", "x", model, gone, 20).collect()
    got = np.array([x.filled for x in rows])
    kept = [0, 2, 4]
    c = w @ w.T + 0.3 * np.eye(5)
    back = np.linalg.solve(c[np.ix_(kept, kept)], c[np.ix_(kept, gone)])
    assert got.shape == (6000, 5) and (got[:, kept] == v[kept]).all()
    assert np.allclose(got[:, gone].mean(axis=0), mean[gone] + (v[kept] - mean[kept]) @ back, atol=0.08)
    assert np.allclose(np.cov(got[:, gone].T), c[np.ix_(gone, gone)] - c[np.ix_(gone, kept)] @ back, atol=0.1)
    again = {(x.id, x.draw): x.filled for x in X.ppca_draws(df.repartition(2), "id", "x", model, gone, 20).collect()}
    assert all(again[x.id, x.draw] == x.filled for x in rows)


def test_pairs(spark):
    """Shared forms change sign with a swap and are scaled by both detectors; sides by side each by its own."""
    from picotick.operators import training as T

    r = np.random.default_rng(8)
    v = r.normal(size=(2, 30, 24))
    df = spark.createDataFrame([(i, v[0, i].tolist(), v[1, i].tolist(), float(i)) for i in range(30)] + [(99, None, [1.0] * 24, 0.0), (98, [], [1.0] * 24, 0.0)], "id long, s1 array<double>, s2 array<double>, y double").repartition(3)
    biases = T.fit_kernel_biases(df.where("id < 30"), "id", ["s1", "s2"], each=3)
    assert biases.shape == (2 * 84 * 2, 3) and len(np.unique(biases[0])) == 3
    for sparse, values in ((False, lambda x: T.pooled_responses(x, biases)[:, :40]), (True, lambda x: X.competing_values(x, X.competing_kernels(4, 3)))):
        f = X.paired(df, "id", "s1", "s2", values, keep=("y",))
        a, b = values(v[0]), values(v[1])
        got = {q.id: q for q in T.scaled_pair(f, f, "a", "b", "x", shared=True, sparse=sparse).collect()}
        assert set(got) == set(range(30)) and got[5].y == 5.0
        both = np.concatenate([a, b])
        if sparse:
            root = np.sqrt(np.maximum(both, 0))
            sd = root.std(axis=0, ddof=1) + (both <= 0).mean(axis=0) ** 4 + 1e-8
            scaled = np.where(both <= 0, 0, (root - root.mean(axis=0)) / sd)
        else:
            sd = both.std(axis=0)
            scaled = both / np.where(sd > 0, sd, 1)
        assert np.allclose([got[i].x for i in range(30)], scaled[:30] - scaled[30:])
        swapped = {q.id: q.x for q in T.scaled_pair(f, f.select("id", f.b.alias("a"), f.a.alias("b")), "a", "b", "x", shared=True, sparse=sparse).collect()}
        assert np.allclose(swapped[7], -np.array(got[7].x))
        side = T.scaled_pair(f, f, "a", "b", "x", shared=False, sparse=sparse).where("id = 3").first().x
        assert len(side) == 2 * a.shape[1]
    with pytest.raises(ValueError, match="two control rows"):
        T.scaled_pair(f.limit(1), f, "a", "b", "x", shared=False)
