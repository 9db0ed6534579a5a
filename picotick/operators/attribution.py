"""Deletion curves, representative events, spectra per event and tree models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .models import _matrix


def coalition_starts(n: int, width: int, stride: int, left: int = 0, right: int | None = None) -> list[int]:
    """Starts of the windows that lie wholly inside [left, right)."""
    return list(range(left, (n if right is None else right) - width + 1, stride))


def deletion_curve(df: DataFrame, id_col: str, x: str, attributions: DataFrame, width: int, reference: list[float], predict: Callable[[np.ndarray], np.ndarray], largest_first: bool = True) -> DataFrame:
    """Prediction as windows are removed in order of attribution: ``id``, ``step``, ``prediction``.

    Step 0 is the whole waveform, the last has every window at the reference. Ties remove the
    earlier window first. Samples always come from the original, not from an earlier step.
    """
    sign = -1.0 if largest_first else 1.0
    order = attributions.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct((sign * F.col("phi")).alias("k"), F.col("start").alias("s")))), lambda e: e["s"]).alias("starts"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(x).cast("array<double>").alias("x")).join(order, "id")
    ref = np.array(reference, dtype=float)

    def run(batches):
        for b in batches:
            ids, steps, out = [], [], []
            for i, v, starts in zip(b.column("id").to_pylist(), _matrix(b.column("x")), b.column("starts").to_pylist(), strict=True):
                all_ = np.tile(v, (len(starts) + 1, 1))
                for step, s in enumerate(starts, 1):
                    all_[step:, s : s + width] = ref[s : s + width]
                ids += [i] * len(all_)
                steps += range(len(all_))
                out += predict(all_).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(steps, pa.int32()), pa.array(out, pa.float64())], names=["id", "step", "prediction"])

    return rows.mapInArrow(run, "id long, step int, prediction double")


def representatives(df: DataFrame, id_col: str, truth: str, prediction: str, quantiles: list[float]) -> DataFrame:
    """Events nearest to quantiles of each sign x outcome group's improvement, by rank; ties take the lower rank.

    Improvement is |y| - |y - p|; an event is better or worse by its sign.
    """
    gain = F.abs(truth) - F.abs(F.col(truth) - F.col(prediction))
    g = df.select(F.col(id_col).alias("id"), gain.alias("gain"), (F.col(truth) >= 0).alias("positive"), (gain >= 0).alias("better"))
    w = Window.partitionBy("positive", "better")
    ranked = g.withColumn("rank", F.row_number().over(w.orderBy("gain", "id")) - 1).withColumn("n", F.count("*").over(w))
    asked = ranked.select("*", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("quantile"))
    near = Window.partitionBy("positive", "better", "quantile").orderBy(F.abs(F.col("rank") - F.col("quantile") * (F.col("n") - 1)), "rank")
    return asked.withColumn("_r", F.row_number().over(near)).where("_r = 1").select("positive", "better", "quantile", "id", "rank", "gain")


def peak_frequency(df: DataFrame, id_col: str, x: str, low: float, high: float, pad: int = 4) -> DataFrame:
    """Frequency (cycles per sample) of the largest zero-padded spectrum in a band, its phase and amplitude."""

    def run(batches):
        for b in batches:
            v = _matrix(b.column("x"))
            n = v.shape[1]
            w = np.hanning(n)
            t = np.linspace(-1, 1, n)
            d = v - v.mean(axis=1, keepdims=True)
            d = d - (d @ t / (t @ t))[:, None] * t
            s = np.fft.rfft(d * w, n * pad, axis=1)
            f = np.fft.rfftfreq(n * pad)
            band = np.flatnonzero((f >= low) & (f <= high))
            best = f[band[np.abs(s[:, band]).argmax(axis=1)]]
            c = 2 / w.sum() * (d * w * np.exp(-2j * np.pi * best[:, None] * np.arange(n))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(best), pa.array(np.angle(c)), pa.array(np.abs(c))], names=["id", "frequency", "phase", "amplitude"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(x).cast("array<double>").alias("x")).mapInArrow(run, "id long, frequency double, phase double, amplitude double")


def circular_regression(df: DataFrame, angle: str, y: str) -> DataFrame:
    """y on 1, sin and cos of an angle by normal equations of sums: coefficients and in-sample R2."""
    s, c = F.sin(angle), F.cos(angle)
    m = df.agg(
        F.covar_pop(s, s).alias("ss"), F.covar_pop(c, c).alias("cc"), F.covar_pop(s, c).alias("sc"), F.covar_pop(s, y).alias("sy"), F.covar_pop(c, y).alias("cy"), F.covar_pop(y, y).alias("yy"),
        F.avg(s).alias("ms"), F.avg(c).alias("mc"), F.avg(y).alias("my"))
    d = F.nullif(F.col("ss") * F.col("cc") - F.col("sc") * F.col("sc"), F.lit(0.0))
    m = m.withColumn("sin", (F.col("sy") * F.col("cc") - F.col("cy") * F.col("sc")) / d).withColumn("cos", (F.col("cy") * F.col("ss") - F.col("sy") * F.col("sc")) / d)
    return m.select("sin", "cos", (F.col("my") - F.col("sin") * F.col("ms") - F.col("cos") * F.col("mc")).alias("intercept"), F.try_divide(F.col("sin") * F.col("sy") + F.col("cos") * F.col("cy"), "yy").alias("r2"))


def regression_tree(train: DataFrame, test: DataFrame, x: str, y: str, id_col: str, depth: int = 4, least: int = 5) -> DataFrame:
    """A regression tree by Spark ML (binned splits): ``id``, ``prediction``."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import DecisionTreeRegressor

    ready = lambda d: d.select(F.col(id_col).alias("id"), array_to_vector(F.col(x).cast("array<double>")).alias("v"), F.col(y).cast("double").alias("t"))
    tree = DecisionTreeRegressor(featuresCol="v", labelCol="t", maxDepth=depth, minInstancesPerNode=least, seed=1).fit(ready(train))
    return tree.transform(ready(test)).select("id", "prediction")


def latex_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as a line of a LaTeX table; order the rows before."""
    from ..functions.scalars import latex

    return df.select(F.concat(F.concat_ws(" & ", *[F.coalesce(latex(F.col(c).cast("string")), F.lit("n/a")) for c in columns]), F.lit(r" \\")).alias("line"))
