"""Incomplete beta and gamma functions, and exact intervals of counts, as columns.

Continued fractions and series are folds over a sequence as long as the arguments ask for, and
inverses are bisections, so an interval of every group is part of the plan. Meant for a row a
group: a value takes some thousand steps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

#: The Lanczos coefficients for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
_TINY = 1e-300
#: Halvings of a bisection.
HALVINGS = 60


def log_gamma(x: Column) -> Column:
    """Of numbers above 0.5."""
    z = x - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + c / (z + i)
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.ln(t) - t + F.ln(series)


def _safe(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def _steps(size: Column) -> Column:
    return F.sequence(F.lit(1), (F.lit(60) + 6 * F.sqrt(size)).cast("int"))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Lentz's continued fraction of the incomplete beta function."""

    def half(s: Column, factor: Column) -> Column:
        return let(F.struct((1 / _safe(1 + factor * s["d"])).alias("d"), _safe(1 + factor / s["c"]).alias("c"), s["h"].alias("h")), lambda n: F.struct(n["d"].alias("d"), n["c"].alias("c"), (n["h"] * n["d"] * n["c"]).alias("h")))

    def step(s: Column, i: Column) -> Column:
        m = i.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return half(half(s, even), odd)

    d = 1 / _safe(1 - (a + b) * x / (a + 1))
    return F.aggregate(_steps(F.greatest(a, b)), F.struct(d.alias("d"), F.lit(1.0).alias("c"), d.alias("h")), step, lambda s: s["h"])


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b)."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    low = x < (a + 1) / (a + b + 2)
    part = let(F.struct(F.when(low, a).otherwise(b).alias("a"), F.when(low, b).otherwise(a).alias("b"), F.when(low, x).otherwise(1 - x).alias("x")), lambda z: _beta_fraction(z["a"], z["b"], z["x"]) / z["a"])
    whole = F.when(low, front * part).otherwise(1 - front * part)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(whole)


def gamma_share(a: Column, x: Column) -> Column:
    """Regularised lower incomplete gamma function P(a, x)."""
    front = F.exp(a * F.ln(x) - x - log_gamma(a + 1))  # x^a e^-x / (a Gamma(a))

    def term(s: Column, i: Column) -> Column:
        return let(s["t"] * x / (a + i), lambda t: F.struct(t.alias("t"), (s["sum"] + t).alias("sum")))

    series = F.aggregate(_steps(a + x), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("sum")), term, lambda s: s["sum"])

    def fraction(s: Column, i: Column) -> Column:
        an = -i * (i - a)
        base = x + 2 * i + 1 - a
        return let(F.struct((1 / _safe(an * s["d"] + base)).alias("d"), _safe(base + an / s["c"]).alias("c")), lambda n: F.struct(n["d"].alias("d"), n["c"].alias("c"), (s["h"] * n["d"] * n["c"]).alias("h")))

    d = 1 / _safe(x + 1 - a)
    upper = F.aggregate(_steps(a + x), F.struct(d.alias("d"), F.lit(1 / _TINY).alias("c"), d.alias("h")), fraction, lambda s: s["h"])
    return F.when(x <= 0, F.lit(0.0)).when(x < a + 1, front * series).otherwise(1 - front * a * upper)


def _solved(low: Column, high: Column, below) -> Column:
    """Where a rising function of a number reaches its goal: halves the interval while ``below(middle)`` says which way."""

    def halve(s: Column, _: Column) -> Column:
        middle = (s["low"] + s["high"]) / 2
        return let(middle, lambda m: let(below(m), lambda right: F.struct(F.when(right, m).otherwise(s["low"]).alias("low"), F.when(right, s["high"]).otherwise(m).alias("high"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(low.cast("double").alias("low"), high.cast("double").alias("high")), halve, lambda s: (s["low"] + s["high"]) / 2)


def binomial_interval(k: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Exact (Clopper-Pearson) limits of a share; null without trials."""
    tail = (1 - level) / 2
    k, n = k.cast("double"), n.cast("double")
    low = F.when(k == 0, F.lit(0.0)).otherwise(_solved(F.lit(0.0), F.lit(1.0), lambda p: beta_share(k, n - k + 1, p) < tail))
    high = F.when(k == n, F.lit(1.0)).otherwise(_solved(F.lit(0.0), F.lit(1.0), lambda p: beta_share(k + 1, n - k, p) < 1 - tail))
    return F.when(n > 0, low), F.when(n > 0, high)


def sign_p(k: Column, n: Column) -> Column:
    """Two-sided binomial test of one half; null without trials."""
    k, n = k.cast("double"), n.cast("double")
    less = F.least(k, n - k)  # P(X <= less) = I_half(n - less, less + 1)
    return F.when(n > 0, F.least(F.lit(1.0), 2 * beta_share(n - less, less + 1, F.lit(0.5))))


def poisson_interval(k: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Exact limits of the mean of a Poisson count."""
    tail, k = (1 - level) / 2, k.cast("double")
    most = k + 10 * F.sqrt(k + 1) + 20
    low = F.when(k == 0, F.lit(0.0)).otherwise(_solved(F.lit(0.0), most, lambda m: gamma_share(k, m) < tail))
    return low, _solved(F.lit(0.0), most, lambda m: gamma_share(k + 1, m) < 1 - tail)


def chi2_p(statistic: Column, freedom: int) -> Column:
    """Probability of a chi-squared value at least as large."""
    return 1 - gamma_share(F.lit(freedom / 2), statistic.cast("double") / 2)


def kolmogorov_p(distance: Column, n: Column) -> Column:
    """Limiting p value of the largest distance between two distribution functions, with the usual correction for small n."""
    z = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * distance
    series = sum((F.lit(2.0 * (-1) ** (j - 1)) * F.exp(-2.0 * j * j * z * z) for j in range(1, 101)), F.lit(0.0))
    return F.when(n > 0, F.when(z < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))))
