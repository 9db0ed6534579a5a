import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from picotick.functions import arrays as A
from picotick.operators import histogram, models, ranking, resampling, robust


def table(spark, n=109, d=6, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    y = x @ r.normal(size=d) + 2 + r.normal(size=n) * 0.1
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), int(i % 4) + 1) for i in range(n)], "id long, x array<double>, y double, fold int").repartition(3)
    return x, y, df


def test_ridge_is_the_dense_solution(spark):
    x, y, df = table(spark)
    penalty = np.array([4.0] * 2 + [17.0] * 4)
    z = np.column_stack([np.ones(len(x)), x])
    want = np.linalg.solve(z.T @ z + np.diag(np.append(0, penalty)), z.T @ y)
    assert np.allclose(models.fit_ridge(df, "x", "y", 0, blocks=(2, 4), alphas=(4.0, 17.0)), want, atol=1e-8)
    no = np.linalg.solve(x.T @ x + 4 * np.eye(6), x.T @ y)
    assert np.allclose(models.fit_ridge(df, "x", "y", 4.0, intercept=False), np.append(0, no), atol=1e-8)
    w = models.fit_ridge(df, "x", "y", 1.0)
    got = {r.id: r.p for r in df.select("id", models.linear(F.col("x"), w).alias("p")).collect()}
    assert np.allclose([got[i] for i in range(len(x))], z @ w)


def test_cross_validation_is_refitting(spark):
    x, y, df = table(spark)
    got = {(r.candidate_id, r.fold_id): r.rmse for r in models.cross_validate(df, "x", "y", "fold", [0.5, 5.0]).collect()}
    fold = np.arange(len(x)) % 4 + 1
    for a in (0.5, 5.0):
        for k in range(1, 5):
            z = np.column_stack([np.ones(len(x)), x])
            t = z[fold != k]
            w = np.linalg.solve(t.T @ t + np.diag([0] + [a] * 6), t.T @ y[fold != k])
            assert got[f"alpha={a:g}", k] == pytest.approx(math.sqrt(np.mean((z[fold == k] @ w - y[fold == k]) ** 2)))


def test_a_difference_of_exactly_the_tolerance_stays(spark):
    folds = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.5), ("c", 1, 1.75)], "candidate_id string, fold_id int, m double")
    assert {r.candidate_id: r.pruned for r in models.pruned(folds, "m", "a", 0.5).collect()} == {"b": False, "c": True}


@pytest.mark.parametrize("block", [4, 1000])
def test_nearest_is_brute_force(spark, block):
    x, _, df = table(spark, n=31)
    got = {(r.id, r["rank"]): r.ref_id for r in models.nearest(df, df, "id", "x", 5, block).collect()}
    for i in range(31):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        assert [got[i, k] for k in range(1, 6)] == np.argsort(d, kind="stable")[:5].tolist()


def test_ppca_recovers_a_latent(spark):
    r = np.random.default_rng(1)
    load = r.normal(size=16)
    x = np.outer(r.normal(size=300), load) + r.normal(size=(300, 16)) * 0.04 + 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    model = models.fit_ppca(df, "x", 1)
    filled = {q.id: q.filled for q in models.ppca_fill(df, "id", "x", model, [3, 4]).collect()}
    got = np.array([filled[i] for i in range(300)])
    assert np.sqrt(np.mean((got[:, 3:5] - x[:, 3:5]) ** 2)) < 0.1
    assert np.allclose(np.delete(got, [3, 4], axis=1), np.delete(x, [3, 4], axis=1))


def test_shapley_of_a_linear_model(spark):
    _, _, df = table(spark, n=10, d=8)
    w = np.arange(8.0)
    got = models.window_shapley(df, "id", "x", [[0.0] * 8], 2, 2, lambda v: v @ w).collect()
    x = {r.id: np.array(r.x) for r in df.collect()}
    assert len(got) == 40
    for r in got:
        assert r.phi == pytest.approx(x[r.id][r.start : r.start + 2] @ w[r.start : r.start + 2])


def test_lowpass_keeps_slow_and_removes_fast(spark):
    t = np.arange(200)
    x = np.sin(2 * np.pi * 0.01 * t) + np.sin(2 * np.pi * 0.4 * t)
    df = spark.createDataFrame([(1, x.tolist())], "id long, x array<double>")
    y = np.array(models.spectral_lowpass(df, "id", "x", 0.1).collect()[0].filtered)
    assert np.abs(y[20:-20] - np.sin(2 * np.pi * 0.01 * t)[20:-20]).max() < 0.05


def test_crossings(spark):
    def at(expr, x):
        df = spark.createDataFrame([(x,)], "x array<double>")
        return df.select(expr(F.col("x"))).collect()[0][0]

    last = lambda level, a=0, b=99: lambda x: A.last_crossing(x, F.lit(level), F.lit(a), F.lit(b))
    assert at(last(1.0), [0.0, 2.0, 0.0, 4.0]) == 2.25
    assert at(last(2.0), [2.0, 1.0, 0.5]) == 0.0  # equality only
    assert at(last(2.0), [0.0, 2.0, 2.0]) == 1.0  # strict beats a later equality
    assert at(last(9.0), [0.0, 1.0]) is None and at(last(1.0), []) is None
    assert at(last(1.0, 0, 1), [0.0, 2.0, 0.0, 4.0]) == 0.5
    assert at(lambda x: A.first_crossing(x, F.lit(1.0)), [0.0, 2.0, 0.0, 4.0]) == 0.5
    rising = lambda level: lambda x: A.rising_crossing(x, F.lit(level))
    assert at(rising(1.0), [0.0, 2.0, 0.0, 4.0, 0.0, 3.0]) == 2.25  # the last one before the highest sample
    assert at(rising(1.0), [0.0, 1.0, 0.5, 1.0, 4.0]) == 3.0 and at(rising(2.0), [3.0, 2.0, 2.5]) is None and at(rising(1.0), [1.0, 1.0, 2.0]) == 1.0
    assert at(rising(9.0), [0.0, 1.0]) is None and at(rising(1.0), []) is None
    p = at(lambda x: A.pickoff_line(x, [1.0, 2.0, 3.0]), [-1.0, 0.5, 2.0, 3.5, 5.0, 0.0])
    assert (p.t0, p.slope) == pytest.approx((2 / 3, 2 / 3))
    assert at(lambda x: A.pickoff_line(x, [1.0, 9.0]), [0.0, 2.0, 4.0]) is None


def test_width_at_half_maximum(spark):
    """A triangle: 1 2 3 2 1 around zero, half at 1.5, crossings between the bins of 1 and 2."""
    values = [b * 1.0 for b, n in zip(range(-2, 3), [1, 2, 3, 2, 1], strict=True) for _ in range(n)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)] * 9, "g string, x double")
    got = {r.g: r for r in histogram.fwhm(df, "x", ["g"], 1.0).collect()}
    assert (got["a"].fwhm, got["a"].peak, got["a"].success) == (3.0, 0.0, True)
    assert got["b"].fwhm is None and not got["b"].success


def test_folds(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    rows = ranking.folds(df, "k", 5, "1001").collect()
    sizes = sorted(sum(r.fold_id == f for r in rows) for f in range(1, 6))
    assert sizes == [20, 20, 21, 21, 21]
    again = ranking.folds(df.repartition(7), "k", 5, "1001").collect()
    assert {r.k: r.fold_id for r in rows} == {r.k: r.fold_id for r in again}


def test_non_finite_values_are_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r.x for r in robust.mad_filter(df, "x", []).collect()] == [1.0, 2.0, 3.0]
    with pytest.raises(Exception, match="too few"):
        robust.mad_filter(df.where("x < 3"), "x", []).collect()


def test_sign_test():
    got = resampling.sign_test(8, 10)
    assert got["p"] == pytest.approx(0.109375)
    assert (got["low"], got["high"]) == pytest.approx((0.4439, 0.9748), abs=1e-4)
    r = random.Random(1)
    n = 30
    k = sum(r.random() < 0.5 for _ in range(n))
    assert 0 < resampling.sign_test(k, n)["p"] <= 1


def test_permutation(spark):
    even = spark.range(200).select("id", (F.col("id") % 10 == 0).alias("f"))
    late = spark.range(200).select("id", (F.col("id") >= 180).alias("f"))
    p = lambda d: {x.test: x for x in resampling.permutation_tests(d, F.col("f"), "id", "id", 30, 1, 20).collect()}
    assert p(even)["ks"].p > 0.5 and p(late)["ks"].p < 0.05 and p(late)["ks"].k == 20
    assert p(late)["adjacent"].statistic == 19 and p(late)["adjacent"].p < 0.05 and p(late)["chi2"].p < 0.05
