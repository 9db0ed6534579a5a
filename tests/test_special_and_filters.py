import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from picotick.functions import special as S
from picotick.operators import filters as X
from picotick.operators import resampling




def binomial(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_beta_and_gamma(spark):
    rows = [(a, b, x) for a in (1, 3, 40, 700) for b in (1, 2, 55, 300) for x in (0.0, 0.01, 0.3, 0.5, 0.72, 0.99, 1.0)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double, x double").withColumn("i", S.beta_share(F.col("a"), F.col("b"), F.col("x")))
    for r in df.collect():
        a, b = int(r.a), int(r.b)  # I_x(a, b) = P(at least a of a + b - 1)
        assert r.i == pytest.approx(1 - binomial(a - 1, a + b - 1, r.x) if r.x < 0.9 else sum(math.comb(a + b - 1, i) * r.x**i * (1 - r.x) ** (a + b - 1 - i) for i in range(a, a + b)), rel=1e-7, abs=1e-12)
    df = spark.createDataFrame([(float(a), x) for a in (1, 2, 30, 400) for x in (0.0, 0.1, 1.0, 25.0, 420.0)], "a double, x double").withColumn("p", S.gamma_share(F.col("a"), F.col("x")))
    for r in df.collect():
        want = 1 - math.fsum(math.exp(-r.x + i * math.log(r.x) - math.lgamma(i + 1)) if r.x else float(i == 0) for i in range(int(r.a)))
        assert r.p == pytest.approx(want, rel=1e-7, abs=1e-12)


def test_intervals(spark):
    rows = [(0, 10), (8, 10), (10, 10), (1, 500), (250, 500), (0, 0), (3, 7)]
    df = spark.createDataFrame(rows, "k int, n int")
    low, high = S.binomial_interval(F.col("k"), F.col("n"))
    found = df.select("k", "n", low.alias("low"), high.alias("high"), S.sign_p(F.col("k"), F.col("n")).alias("p")).collect()
    for r in found:
        if r.n == 0:
            assert (r.low, r.high, r.p) == (None, None, None)
            continue
        want = resampling.sign_test(r.k, r.n)
        assert (r.low, r.high) == (pytest.approx(want["low"], abs=1e-9), pytest.approx(want["high"], abs=1e-9)) and r.p == pytest.approx(want["p"], rel=1e-9)
    low, high = S.poisson_interval(F.col("k"))
    for r in spark.createDataFrame([(0,), (1,), (7,), (300,)], "k int").select("k", low.alias("low"), high.alias("high")).collect():
        cdf = lambda k, m: math.fsum(math.exp(-m + i * math.log(m) - math.lgamma(i + 1)) for i in range(k + 1))
        assert cdf(r.k, r.high) == pytest.approx(0.025, rel=1e-6) and (r.k == 0 or 1 - cdf(r.k - 1, r.low) == pytest.approx(0.025, rel=1e-6)) and (r.k or r.low == 0)


def test_p_values(spark):
    one = spark.range(1)
    p = lambda c: one.select(c.alias("p")).first().p
    assert p(S.chi2_p(F.lit(15.507313), 8)) == pytest.approx(0.05, rel=1e-6) and p(S.chi2_p(F.lit(0.0), 3)) == 1
    assert p(S.kolmogorov_p(F.lit(1.3581 / math.sqrt(1e8)), F.lit(1e8))) == pytest.approx(0.05, rel=1e-2) and p(S.kolmogorov_p(F.lit(0.0), F.lit(9.0))) == 1


def plain(section, x):
    """Direct form, sample by sample, after a long run at the first sample."""
    b0, b1, b2, _, a1, a2 = section
    given = [x[0]] * 4000 + list(x)
    y = []
    for i, v in enumerate(given):
        back = lambda s, k, i=i: s[i - k] if i >= k else 0.0
        y.append(b0 * v + b1 * back(given, 1) + b2 * back(given, 2) - a1 * back(y, 1) - a2 * back(y, 2))
    return y[4000:]


@pytest.mark.parametrize(("order", "cutoff"), [(1, 0.2), (2, 0.1), (4, 0.15), (5, 0.31)])
def test_lowpass_is_the_plain_recursion(spark, order, cutoff):
    sections = X.butterworth(order, cutoff)
    at_ = lambda f: np.prod([(s[0] + s[1] * z + s[2] * z * z) / (1 + s[4] * z + s[5] * z * z) for z in [np.exp(-2j * np.pi * f)] for s in sections])
    assert abs(at_(0)) == pytest.approx(1) and abs(at_(cutoff)) == pytest.approx(math.sqrt(0.5)) and abs(at_(0.5)) < 1e-12
    rng = np.random.default_rng(order)
    v = rng.normal(size=60)
    taps = 2 * len(sections) + 1 - (order % 2)
    pad = 3 * taps
    w = [*(2 * v[0] - v[pad:0:-1]), *v, *(2 * v[-1] - v[-2 : -pad - 2 : -1])]
    for _ in range(2):
        for s in sections:
            w = plain(s, w)
        w = w[::-1]
    df = spark.createDataFrame([(1, v.tolist())], "id int, x array<double>")
    assert np.allclose(X.lowpass(df, "id", "x", cutoff, order).first().filtered, w[pad : pad + 60], atol=1e-9)


def test_regions_and_odd_rows(spark):
    t = np.arange(90)
    v = np.sin(2 * np.pi * 0.1 * t) + 0.02 * t
    df = spark.createDataFrame([(1, v.tolist()), (2, None), (3, []), (4, [1.0]), (5, [1.0, float("nan")]), (6, [1.0, None, 2.0])], "id int, x array<double>")
    region = X.Region(40, 60, 5)
    got = {r.id: r.filtered for r in X.lowpass(df, "id", "x", 0.05, 4, region).collect()}
    assert got[1][40:60] == v[40:60].tolist() and abs(np.array(got[1][:30]) - 0.02 * t[:30])[5:].max() < 0.2
    assert got[2] is None and got[3] == [] and got[4] == [1.0] and got[5] is None and got[6] is None
    turned = np.array(X.rotated(df.where("id = 1"), "id", "x", 0.1, 90.0, region).first().rotated)
    assert turned[40:60].tolist() == v[40:60].tolist()
    assert np.allclose(turned[:35], np.cos(2 * np.pi * 0.1 * t[:35]) + 0.02 * t[:35], atol=1e-6)
    assert X.rotated(df.where("id = 1"), "id", "x", 0.1, 0.0, region).first().rotated == pytest.approx(v.tolist(), abs=1e-15)
    with pytest.raises(Exception, match="too few"):
        X.rotated(df.where("id = 4"), "id", "x", 0.1, 90.0, region).collect()
    with pytest.raises(ValueError):
        X.butterworth(2, 0.5)
