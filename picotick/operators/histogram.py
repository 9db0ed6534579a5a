"""Histograms with a bin centred on zero, and the full width at half maximum of their peak."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import median, quantiles
from .robust import _back, finite
from .scratch import stored


def binned(df: DataFrame, value: str, keys: list[str], width: float) -> DataFrame:
    """Dense counts: ``bin`` (0 is centred on zero), ``left`` edge and ``n``, per group.

    The last bin is closed on the right, so a maximum on an edge is counted below it.
    """
    x = finite(value)
    given = df.select(*keys, x.alias("x")).where("x is not null")
    number = F.floor(F.col("x") / width + 0.5).cast("long")
    # rows are read once: what is stored is a row a bin
    raw = stored(given.groupBy(*keys, number.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("_lo"), F.max("x").alias("_hi")))
    top = raw.groupBy(*keys).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    first, last = F.floor(F.col("_lo") / width + 0.5), F.ceil(F.col("_hi") / width - 0.5)
    limits = top.select(*keys, first.cast("long").alias("_first"), F.greatest(first, last).cast("long").alias("_last"))
    counts = _back(raw, limits, keys).select(*keys, F.least("bin", "_last").alias("bin"), "n").groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    grid = limits.select(*keys, F.explode(F.sequence("_first", "_last")).alias("bin"))
    return _back(grid, counts, [*keys, "bin"]).select(*keys, "bin", ((F.col("bin") - 0.5) * width).alias("left"), F.coalesce("n", F.lit(0)).alias("n"))


def half_maximum_width(hist: DataFrame, keys: list[str], width: float, least: int = 5) -> DataFrame:
    """Per group of a dense histogram: ``fwhm``, its crossings, the peak, and ``success``.

    The peak is the middle one of the highest bins. On each side the bin nearest to it below
    half the peak gives the crossing, interpolated between bin centres. Groups without a
    crossing on either side, with fewer than ``least`` values or three bins, or with the peak in
    the first or last bin have ``success`` false and a null width.
    """
    by = Window.partitionBy(*keys)
    ordered = by.orderBy("bin")
    h = hist.withColumn("_top", F.max("n").over(by)).withColumn("_is_top", F.col("n") == F.col("_top"))
    h = h.withColumn("_nth", F.sum(F.col("_is_top").cast("int")).over(ordered)).withColumn("_tops", F.sum(F.col("_is_top").cast("int")).over(by))
    h = h.withColumn("_peak", F.max(F.when(F.col("_is_top") & (F.col("_nth") == F.floor(F.col("_tops") / 2) + 1), F.col("bin"))).over(by))
    h = h.withColumn("_next", F.lead("n").over(ordered)).withColumn("_prev", F.lag("n").over(ordered)).withColumn("_half", F.col("_top") / 2)

    def crossing(side: Column, inner: Column, step: int) -> Column:
        """(bin, place) of a bin below half whose inner neighbour is not."""
        below = side & (F.col("n") < F.col("_half"))
        place = (F.col("bin") + step * (F.col("_half") - F.col("n")) / F.nullif(inner - F.col("n"), F.lit(0))) * width
        return F.when(below, F.struct(F.col("bin").alias("bin"), place.alias("place")))

    out = h.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.count("*").alias("bins"), F.max("_top").alias("peak_n"), F.max("_peak").alias("_peak"), F.min("bin").alias("_first"), F.max("bin").alias("_last"),
        F.max(crossing(F.col("bin") < F.col("_peak"), F.col("_next"), 1)).alias("_l"), F.min(crossing(F.col("bin") > F.col("_peak"), F.col("_prev"), -1)).alias("_r"),
    )
    good = (F.col("n") >= least) & (F.col("bins") >= 3) & (F.col("_peak") > F.col("_first")) & (F.col("_peak") < F.col("_last")) & F.col("_l").isNotNull() & F.col("_r").isNotNull()
    show = lambda c: F.when(good, c)
    return out.select(
        *keys, "n", "bins", "peak_n", (F.col("_peak") * width).alias("peak"), show(F.col("_l.place")).alias("left_half"), show(F.col("_r.place")).alias("right_half"),
        show(F.col("_r.place") - F.col("_l.place")).alias("fwhm"), good.alias("success"))


def fwhm(df: DataFrame, value: str, keys: list[str], width: float) -> DataFrame:
    return half_maximum_width(binned(df, value, keys, width), keys, width)


def without_pedestal(hist: DataFrame, keys: list[str], density: float, width: float) -> DataFrame:
    """Histogram minus a uniform background of ``density`` per unit, never below zero."""
    return hist.withColumn("n", F.greatest(F.lit(0.0), F.col("n") - F.lit(density * width)))


def clipped_bins(x: Column, low: float, high: float, bins: int) -> Column:
    """Bin 0..bins-1 of equal steps; values outside go to the nearest bin."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((x - low) / ((high - low) / bins)))).cast("int")


def uniform_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """Bin 0..bins-1 of equal steps, the last one closed on the right; null outside."""
    inside = F.least(F.lit(bins - 1), F.floor((x - low) / ((high - low) / bins))).cast("int")
    return F.when((x >= low) & (x <= high), inside)


def circular_bin(angle: Column, bins: int) -> Column:
    """Bin 0..bins-1 of an angle in radians, whatever turns it has made."""
    import math

    turn = 2 * math.pi
    return (F.floor((angle - turn * F.floor(angle / turn)) / turn * bins) % bins).cast("int")


def profile(df: DataFrame, x: str, y: str, keys: list[str], least: int = 20) -> DataFrame:
    """Binned profile: median x, median y and std of y in min(40, max(10, sqrt n)) bins over x's range."""
    given = df.select(*keys, finite(x).alias("x"), finite(y).alias("y")).where("x is not null and y is not null")
    span = given.groupBy(*keys).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"), F.least(F.lit(40), F.greatest(F.lit(10), F.floor(F.sqrt(F.count("*"))))).cast("int").alias("_bins"))
    step = F.nullif((F.col("_hi") - F.col("_lo")) / F.col("_bins"), F.lit(0.0))
    bin_ = F.coalesce(F.least(F.col("_bins") - 1, F.floor((F.col("x") - F.col("_lo")) / step)), F.lit(0)).cast("int")
    rows = _back(given, span, keys).select(*keys, bin_.alias("bin"), "x", "y")
    found = quantiles(rows, {"x_median": (F.col("x"), [0.5]), "y_median": (F.col("y"), [0.5])}, [*keys, "bin"], (F.count("*").alias("n"), F.stddev_samp("y").alias("y_std")))
    return found.where(F.col("n") >= least).withColumns({c: median(c) for c in ("x_median", "y_median")})
