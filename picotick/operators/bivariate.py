"""Statistics of two columns per group, grids over them, and tail dependence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import by_keys, quantiles
from .ranking import guarded_corr, spearmans
from .robust import _back, finite


def both_finite(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(finite(a).isNotNull() & finite(b).isNotNull())


def statistics(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Correlation, covariance, variances, line, R2, equal signs, and the variance they share."""
    g = both_finite(df, a, b).groupBy(*keys).agg(
        F.count("*").alias("n"), guarded_corr(a, b).alias("pearson"), F.covar_samp(a, b).alias("covariance"), F.var_samp(a).alias("var_a"), F.var_samp(b).alias("var_b"),
        F.var_samp(F.col(a) - F.col(b)).alias("var_difference"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"),
        F.avg((F.signum(a) == F.signum(b)).cast("double")).alias("same_sign"),
    )
    return g.withColumn("shared_variance", F.greatest(F.lit(0.0), F.col("covariance"))).withColumn("shared_fraction", F.try_divide("shared_variance", F.sqrt(F.col("var_a") * F.col("var_b"))))


def tail_dependence(df: DataFrame, a: str, b: str, keys: list[str], percents: list[float]) -> DataFrame:
    """Per percentile of the absolute values: joint and conditional fractions, independence, equal signs."""
    given = both_finite(df, a, b).select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b"))
    shares = [p / 100 for p in percents]
    cuts = quantiles(given, {"_qa": (F.abs("_a"), shares), "_qb": (F.abs("_b"), shares)}, keys)
    cuts = cuts.select(*keys, F.explode(F.arrays_zip(F.array(*[F.lit(float(p)) for p in percents]).alias("p"), F.col("_qa").alias("qa"), F.col("_qb").alias("qb"))).alias("_c")).select(
        *keys, F.col("_c.p").alias("percent"), F.col("_c.qa").alias("_cut_a"), F.col("_c.qb").alias("_cut_b"))
    joined = _back(given, cuts, keys)
    in_a, in_b = F.abs("_a") >= F.col("_cut_a"), F.abs("_b") >= F.col("_cut_b")
    out = joined.groupBy(*keys, "percent").agg(
        F.count("*").alias("n"), F.count_if(in_a).alias("n_a"), F.count_if(in_b).alias("n_b"), F.count_if(in_a & in_b).alias("n_both"),
        F.avg(F.when(in_a & in_b, (F.signum("_a") == F.signum("_b")).cast("double"))).alias("same_sign"))
    return out.select(
        "*", (F.col("n_both") / F.col("n")).alias("joint"), F.try_divide("n_both", "n_a").alias("b_given_a"), F.try_divide("n_both", "n_b").alias("a_given_b"),
        (F.col("n_a") / F.col("n") * F.col("n_b") / F.col("n")).alias("independent"))


def grid(df: DataFrame, x_bin: Column, x_bins: int, y_bin: Column, y_bins: int, value: str) -> DataFrame:
    """Every cell of a grid: n, mean, deviation from the overall mean, std and its error; empty cells too."""
    spark = df.sparkSession
    cells = df.select(x_bin.alias("x_bin"), y_bin.alias("y_bin"), finite(value).alias("_v")).where("_v is not null")
    overall = cells.agg(F.avg("_v")).scalar()
    found = cells.groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"))
    every = spark.range(x_bins * y_bins).select((F.col("id") % x_bins).cast("int").alias("x_bin"), F.floor(F.col("id") / x_bins).cast("int").alias("y_bin"))
    return every.join(found, ["x_bin", "y_bin"], "left").select(
        "x_bin", "y_bin", F.coalesce("n", F.lit(0)).alias("n"), "mean", (F.col("mean") - overall).alias("deviation"), "std", (F.col("std") / F.sqrt("n")).alias("error"))


def agreement(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Bias, RMSE, MAE and percentiles of the absolute difference of two models."""
    d = finite(a) - finite(b)
    found = quantiles(both_finite(df, a, b), {"_q": (F.abs(d), [0.5, 0.95])}, keys, (F.count("*").alias("n"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae")))
    return found.withColumns({"p50": F.get("_q", F.lit(0)), "p95": F.get("_q", F.lit(1))}).drop("_q")


def efficiency(n_valid: Column, n_total: Column) -> tuple[Column, Column]:
    """Share and its binomial error; a share over one raises."""
    p = F.when(n_valid > n_total, F.raise_error(F.lit("more valid than selected events")).cast("double")).otherwise(F.try_divide(n_valid.cast("double"), n_total))
    return p, F.sqrt(p * (1 - p) / F.nullif(n_total, F.lit(0)))


def outlier_contribution(df: DataFrame, value: str, flag: Column, keys: list[str]) -> DataFrame:
    """How common a flagged population is per group, against all, and its part of the squared sum."""
    v = finite(value)
    overall = df.agg(F.avg(flag.cast("double"))).scalar()
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(flag).alias("n_flagged"), F.avg(flag.cast("double")).alias("prevalence"),
        F.try_divide(F.sum(F.when(flag, v * v)), F.sum(v * v)).alias("sse_share"))
    return out.withColumn("enrichment", F.try_divide("prevalence", overall))


def line_fit(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    return both_finite(df, x, y).groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def plane_fit(df: DataFrame, x: str, z: str, y: str, keys: list[str]) -> DataFrame:
    """y = c + a x + b z by centred normal equations, and how much it lowers the std of y (percent)."""
    g = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.covar_samp(x, x).alias("xx"), F.covar_samp(z, z).alias("zz"), F.covar_samp(x, z).alias("xz"), F.covar_samp(x, y).alias("xy"), F.covar_samp(z, y).alias("zy"),
        F.covar_samp(y, y).alias("yy"), F.avg(x).alias("mx"), F.avg(z).alias("mz"), F.avg(y).alias("my"))
    d = F.nullif(F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz"), F.lit(0.0))
    a, b = (F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz")) / d, (F.col("zy") * F.col("xx") - F.col("xy") * F.col("xz")) / d
    g = g.withColumn("a", a).withColumn("b", b)
    left = F.col("yy") - F.col("a") * F.col("xy") - F.col("b") * F.col("zy")
    return g.select(*keys, "n", "a", "b", (F.col("my") - F.col("a") * F.col("mx") - F.col("b") * F.col("mz")).alias("c"), (100 * (1 - F.sqrt(F.greatest(F.lit(0.0), left) / F.nullif("yy", F.lit(0.0))))).alias("improvement"))


def duration_timing(df: DataFrame, key: str, first: str, second: str, timing: str, selected: Column, least: int = 10) -> DataFrame:
    """How a time difference depends on two durations and on their difference: a row a run, nineteen figures.

    Correlations (Pearson and Spearman) and slopes on either duration and on second - first, the plane
    over both, and the deviation of the timing before and after the plane is taken off. Runs with
    fewer than ``least`` selected events have no row.
    """
    given = df.select(key, finite(first).alias("d1"), finite(second).alias("d2"), finite(timing).alias("t"), F.coalesce(selected, F.lit(False)).alias("_sel"))
    total = given.groupBy(key).agg(F.count("*").alias("events_total"))
    rows = given.where("_sel and d1 is not null and d2 is not null and t is not null").withColumn("d", F.col("d2") - F.col("d1")).drop("_sel")
    sides = {"first": "d1", "second": "d2", "difference": "d"}
    plain = rows.groupBy(key).agg(
        F.count("*").alias("events_selected"), F.avg("t").alias("mean"), F.stddev_samp("t").alias("sigma"),
        *[guarded_corr(c, "t").alias(f"pearson_{n}") for n, c in sides.items()], *[F.regr_slope("t", c).alias(f"slope_{n}") for n, c in sides.items()]).where(F.col("events_selected") >= least)
    out = by_keys(total, plain, [key])
    ranked = spearmans(rows, list(sides.values()), "t", [key]).withColumnsRenamed({f"spearman_{c}": f"spearman_{n}" for n, c in sides.items()})
    out = by_keys(out, ranked, [key], "left")
    plane = plane_fit(rows, "d1", "d2", "t", [key]).select(key, F.col("c").alias("plane_intercept"), F.col("a").alias("plane_first"), F.col("b").alias("plane_second"), F.col("improvement").alias("improvement_percent"))
    out = by_keys(out, plane, [key], "left").withColumn("selection_fraction", F.col("events_selected") / F.col("events_total"))
    return out.withColumn("sigma_corrected", F.col("sigma") * (1 - F.col("improvement_percent") / 100))
