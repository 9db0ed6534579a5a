"""Robust location and scale, outlier filters and group statistics.

Grouped operators take ``keys``; statistics of a group are one row, joined back by key, so a
filter costs aggregations and one join that Spark broadcasts while the statistics are small.
Medians and percentiles are exact and never gather a large group (``order.quantiles``). NaN and infinite values are missing: they are never in a
statistic and never pass a filter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import median, quantiles
from .scratch import stored

#: Makes the MAD of a normal distribution its standard deviation.
MAD_TO_SIGMA = 1.4826


def finite(x: Column | str) -> Column:
    """The value as a double, or null if it is NaN or infinite."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def _back(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Joins one-row-per-group statistics back, null keys included."""
    if not keys:
        return df.join(F.broadcast(stats), how="left")  # one row
    named = stats.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in stats.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(named[f"_k_{k}"]) for k in keys])
    return df.join(named, same, "left").drop(*[f"_k_{k}" for k in keys])


def robust_scale(df: DataFrame, value: str, keys: list[str], fallback: str = "none", floor: float = 1.0) -> DataFrame:
    """Per group: ``n``, ``center`` (median) and ``scale`` (scaled MAD).

    A zero MAD falls back by policy: ``none`` keeps 0; ``std_one`` takes the sample standard
    deviation and then 1; ``std_floor`` takes it and then ``floor``.
    """
    given = df.select(*keys, finite(value).alias("_x")).where("_x is not null")
    center = quantiles(given, {"_m": (F.col("_x"), [0.5])}, keys, (F.stddev_samp("_x").alias("_std"), F.count("*").alias("n")))
    center = center.withColumn("center", median("_m")).drop("_m")
    # a row a group: written, as it is met by every row of the next pass
    center = stored(center)
    off = F.abs(F.col("_x") - F.col("center"))
    spread = quantiles(_back(given, center, keys), {"_s": (off, [0.5])}, [*keys, "center", "_std", "n"])
    out = spread.withColumn("scale", MAD_TO_SIGMA * median("_s"))
    if fallback != "none":
        last = 1.0 if fallback == "std_one" else floor
        out = out.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).when(F.col("_std") > 0, F.col("_std")).otherwise(F.lit(last)))
    return out.select(*keys, "n", "center", "scale")


def mad_filter(df: DataFrame, value: str, keys: list[str], zlimit: float = 4.0, least: int = 3) -> DataFrame:
    """Rows within ``zlimit`` robust deviations of their group's median.

    Groups with fewer than ``least`` finite values raise, because no scale can be told.
    """
    stats = robust_scale(df, value, keys, "std_one")
    checked = stats.withColumn("scale", F.when(F.col("n") >= least, F.col("scale")).otherwise(
        F.raise_error(F.concat(F.lit("too few finite values for a robust filter: "), F.col("n").cast("string")))))
    joined = _back(df, checked, keys)
    return joined.where(F.abs(finite(value) - F.col("center")) <= zlimit * F.col("scale")).select(*df.columns)


def zscore_filter(df: DataFrame, value: str, keys: list[str], zlimit: float, method: str = "robust_mad", least: int = 3) -> DataFrame:
    """Like ``mad_filter``, but a group that is too small or has no spread keeps all its rows."""
    if method == "robust_mad":
        stats = robust_scale(df, value, keys)
    else:
        stats = df.select(*keys, finite(value).alias("_x")).groupBy(*keys).agg(F.count("_x").alias("n"), F.avg("_x").alias("center"), F.stddev_samp("_x").alias("scale"))
    joined = _back(df, stats, keys)
    usable = (F.col("n") >= least) & (F.col("scale") > 0)
    return joined.where(F.when(usable, F.abs(finite(value) - F.col("center")) <= zlimit * F.col("scale")).otherwise(F.lit(True))).select(*df.columns)


def tukey_flags(df: DataFrame, values: list[str], keys: list[str], factor: float = 3.0) -> DataFrame:
    """Adds ``outlier``: any value outside its group's quartiles by more than ``factor`` IQR."""
    quartiles = quantiles(df, {f"_q_{v}": (finite(v), [0.25, 0.75]) for v in values}, keys)

    def outside(v: str) -> Column:
        q1, q3 = F.get(f"_q_{v}", F.lit(0)), F.get(f"_q_{v}", F.lit(1))
        reach = factor * F.when(q3 > q1, q3 - q1).otherwise(F.raise_error(F.lit(f"{v} has no interquartile range")))
        return (finite(v) < q1 - reach) | (finite(v) > q3 + reach)

    flags = [outside(v) for v in values]
    return _back(df, quartiles, keys).withColumn("outlier", F.coalesce(reduce(lambda a, b: a | b, flags), F.lit(False))).drop(*[f"_q_{v}" for v in values])


def summary(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """n, mean, sample std, quartiles and outer percentiles per group (finite values only)."""
    x = finite(value)
    found = quantiles(df, {"_q": (x, [0.5, 0.25, 0.75, 0.01, 0.99])}, keys, (F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")))
    return _named(found, "_q", ["median", "q1", "q3", "p01", "p99"])


def _named(df: DataFrame, array: str, names: list[str]) -> DataFrame:
    """The array's elements as columns."""
    return df.withColumns({name: F.get(array, F.lit(i)) for i, name in enumerate(names)}).drop(array)


def residual_summary(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Total and finite counts, RMSE, mean, population std, extremes and outer percentiles."""
    x = finite(value)
    found = quantiles(df, {"_q": (x, [0.01, 0.99])}, keys, (
        F.count("*").alias("n_total"), F.count(x).alias("n_finite"), F.sqrt(F.avg(x * x)).alias("rmse"), F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")))
    return _named(found, "_q", ["q01", "q99"])


def moments(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Mean, median, variance, MAE, MAD, IQR, skew and excess kurtosis of sample-sd z-scores, tail fractions."""
    given = df.select(*keys, finite(value).alias("x")).where("x is not null")
    first = quantiles(given, {"_q": (F.col("x"), [0.5, 0.25, 0.75])}, keys, (F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("variance"), F.avg(F.abs("x")).alias("mae")))
    first = stored(_named(first, "_q", ["median", "_q1", "_q3"]).withColumn("iqr", F.col("_q3") - F.col("_q1")).drop("_q1", "_q3"))
    z = (F.col("x") - F.col("mean")) / F.nullif(F.sqrt("variance"), F.lit(0.0))
    found = quantiles(_back(given, first, keys), {"_q": (F.abs(F.col("x") - F.col("median")), [0.5])}, [*keys, "n", "mean", "median", "variance", "mae", "iqr"], (
        F.avg(z * z * z).alias("skew"), (F.avg(z * z * z * z) - 3).alias("kurtosis"), F.avg((F.abs(z) > 2).cast("double")).alias("beyond_2"), F.avg((F.abs(z) > 3).cast("double")).alias("beyond_3")))
    return found.withColumn("mad", median("_q")).drop("_q")


def clipped_mean(df: DataFrame, value: str, keys: list[str], zlimit: float = 4.0, rounds: int = 8, least: int = 10) -> DataFrame:
    """Mean and std after repeated robust clipping, the model of a constant delay.

    Each round keeps what lies within ``zlimit`` robust deviations (MAD, then sample std, then
    1); a group stops when nothing more is cut or fewer than ``least`` would remain. The
    rounds are plain aggregations: a later round finds nothing to cut in a finished group.
    """
    given = df.select(*keys, finite(value).alias("x")).where("x is not null")
    # what has passed so far is an interval per group: only these few rows go from round to round
    limits = given.groupBy(*keys).agg(F.min("x").alias("_low"), F.max("x").alias("_high"))
    inside = F.col("x").between(F.col("_low"), F.col("_high"))
    for _ in range(rounds):
        kept = _back(given, limits, keys).where(inside)
        scale = robust_scale(kept.select(*keys, "x"), "x", keys, "std_one")
        low = F.greatest("_low", F.col("center") - zlimit * F.col("scale"))
        high = F.least("_high", F.col("center") + zlimit * F.col("scale"))
        judged = _back(kept, scale, keys).groupBy(*keys, "_low", "_high", low.alias("low"), high.alias("high")).agg(F.count_if(F.col("x").between(low, high)).alias("n"))
        limits = stored(judged.select(*keys, F.when(F.col("n") >= least, F.col("low")).otherwise(F.col("_low")).alias("_low"), F.when(F.col("n") >= least, F.col("high")).otherwise(F.col("_high")).alias("_high")))
    return _back(given, limits, keys).where(inside).groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
