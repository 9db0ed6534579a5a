"""Candidates over growing windows, iterative ridge, kept models, scaled feature blocks.

Every fit here is a distributed sum: the driver sees one number a feature, or one Gram matrix
(at most ``models.MOST_FEATURES`` features), whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .matching import all_of
from .models import _matrix, gram, solve_ridge, squares
from .scratch import stored


def grid(space: dict[str, list]) -> list[dict]:
    """All combinations of the values, the last name fastest. A name needs values, all different and of one kind."""
    for name, values in space.items():
        if not values or len(set(values)) < len(values) or len({type(v) for v in values}) > 1:
            raise ValueError(f"{name}: values must be given, differ and be of one kind")
    return [dict(zip(space, v, strict=True)) for v in product(*space.values())]


def window_cross_validation(df: DataFrame, x: str, y: str, fold: str, space: dict[str, list]) -> DataFrame:
    """RMSE of ridge per (n_features, candidate_id, fold_id) for a grid of ``n_features`` and ``alpha``.

    A window is the first ``n_features`` features. One pass over the data sums the Gram matrix of
    each fold; what a window or a training part needs is a part or a difference of these.
    Rows without a target are left out; a fold without rows does not appear.
    """
    by = {k: z for (k,), z in squares(gram(df.where(F.col(fold).isNotNull()), x, y, [fold]), [fold]).items()}
    out = []
    for c in grid(space):
        n, alpha = c["n_features"], c["alpha"]
        for k, z in by.items():
            if not 0 < n <= len(z) - 2:
                raise ValueError(f"a window of {n} of {len(z) - 2} features")
            part = np.r_[0 : n + 1, len(z) - 1]
            train, held = (sum(by.values()) - z)[np.ix_(part, part)], z[np.ix_(part, part)]
            if train[0, 0] < 1:
                raise ValueError("a fold holds every row")
            w = np.append(solve_ridge(train, alpha), -1)
            out.append((n, f"alpha={alpha:g}", int(k), float(np.sqrt(max(0.0, w @ held @ w) / held[0, 0]))))
    return df.sparkSession.createDataFrame(out, "n_features int, candidate_id string, fold_id int, rmse double")


def refitted_windows(df: DataFrame, id_col: str, s1: str, s2: str, y: str, fold: str, windows: list[int], fit: Callable[[DataFrame], Callable[[np.ndarray], np.ndarray]], alphas: list[float]) -> DataFrame:
    """RMSE of ridge on phi(s1) - phi(s2) per (n_features, candidate_id, fold_id), phi made anew for every prefix.

    A window is the first samples of both waveforms. ``fit`` gets the rows with their waveforms cut to it and
    gives the function that turns waveforms into features, without looking at targets; features are
    scaled by both detectors' together. ``n_features`` is the window's length in samples. A pass
    over the data for the features and one for the sums, for each window.
    """
    from .features import paired

    out = []
    for n in windows:
        cut = df.withColumn(s1, F.slice(s1, 1, n)).withColumn(s2, F.slice(s2, 1, n)).where(F.col(fold).isNotNull() & F.col(y).isNotNull())
        made = stored(paired(cut, id_col, s1, s2, fit(cut), keep=tuple(dict.fromkeys((y, fold)))))
        x = scaled_pair(made, made, "a", "b", "x", shared=True)
        by = {k: z for (k,), z in squares(gram(x, "x", y, [fold]), [fold]).items()}
        whole = sum(by.values())
        for k, z in by.items():
            for alpha in alphas:
                w = np.append(-solve_ridge(whole - z, alpha, intercept=False), 1.0)
                out.append((n, f"alpha={alpha:g}", int(k), float(np.sqrt(max(0.0, w[1:] @ z[1:, 1:] @ w[1:]) / z[0, 0]))))
    return df.sparkSession.createDataFrame(out, "n_features int, candidate_id string, fold_id int, rmse double")


def frozen_over_windows(folds: DataFrame) -> DataFrame:
    """Mean and std over folds of each window and candidate; ``frozen`` marks the candidate that is best at the widest window."""
    s = folds.groupBy("n_features", "candidate_id").agg(F.avg("rmse").alias("mean"), F.stddev_samp("rmse").alias("std"))
    best = s.orderBy(F.desc("n_features"), "mean", "candidate_id").limit(1).select("candidate_id")
    return s.withColumn("frozen", F.col("candidate_id") == best.scalar())


def _summed(rows: DataFrame, run) -> np.ndarray:
    """Sums of the arrays that tasks yield, entry by entry."""
    found = rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(len(found))
    out[found.column("i").to_numpy()] = found.column("v").to_numpy()
    return out


def _entries(v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=["i", "v"])


def fit_ridge_iteratively(df: DataFrame, x: str, y: str, alpha: float, *, tolerance: float = 1e-10, most: int = 200) -> np.ndarray:
    """[intercept, weights] of ridge for many features, by conjugate gradients on centred data.

    No feature matrix is squared: a task holds a batch and a few vectors of one number a feature,
    and a step is one pass over the data (store ``df`` before if it is dear to compute). Means
    are taken off within tasks. Steps end when the residual, scaled by the features' variances,
    fell to ``tolerance`` of its start; not getting there within ``most`` steps raises, as does
    a table without rows. Rows without a target are left out.
    """
    rows = df.where(F.col(y).isNotNull()).select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"))

    def first(batches):
        total = None
        for b in batches:
            z = np.column_stack([np.ones(b.num_rows), _matrix(b.column("x")), b.column("y").to_numpy(zero_copy_only=False)]) if b.num_rows else None
            if z is not None:
                total = z.sum(axis=0) if total is None else total + z.sum(axis=0)
        if total is not None:
            yield _entries(total)

    sums = _summed(rows, first)
    if not len(sums):
        raise ValueError("no rows with a target")
    mean, y_mean = sums[1:-1] / sums[0], sums[-1] / sums[0]

    def moments(batches):
        right, square = np.zeros(len(mean)), np.zeros(len(mean))
        for b in batches:
            if b.num_rows:
                z = _matrix(b.column("x")) - mean
                right += z.T @ (b.column("y").to_numpy(zero_copy_only=False) - y_mean)
                square += (z * z).sum(axis=0)
        yield _entries(np.concatenate([right, square]))

    both = _summed(rows, moments)
    right, scale = both[: len(mean)], both[len(mean) :] + alpha
    scale[scale <= 0] = 1.0

    def applied(direction):
        def run(batches):
            out = np.zeros(len(mean))
            for b in batches:
                if b.num_rows:
                    z = _matrix(b.column("x")) - mean
                    out += z.T @ (z @ direction)
            yield _entries(out)

        return _summed(rows, run) + alpha * direction

    w, residual = np.zeros(len(mean)), right.copy()
    toward = residual / scale
    direction, size = toward, residual @ toward
    start = size
    for _ in range(most):
        if size <= start * tolerance**2:
            return np.append(y_mean - w @ mean, w)
        image = applied(direction)
        step = size / (direction @ image)
        w, residual = w + step * direction, residual - step * image
        toward = residual / scale
        size, before = residual @ toward, size
        direction = toward + size / before * direction
    if size <= start * tolerance**2:
        return np.append(y_mean - w @ mean, w)
    raise ValueError(f"residual is {np.sqrt(size / start):.1e} of its start after {most} steps")


def save_model(spark: SparkSession, path: str, parts: dict[str, np.ndarray]) -> None:
    """A model's arrays (weights, sample mask, scales of a transform) as one table; an existing path raises."""
    names = [name for name, v in parts.items() for _ in range(len(v))]
    columns = {
        "part": pa.array(names, pa.string()), "size": pa.array([len(parts[n]) for n in names], pa.int64()),
        "i": pa.array([i for v in parts.values() for i in range(len(v))], pa.int64()),
        "value": pa.array([float(x) for v in parts.values() for x in v], pa.float64()),
    }
    spark.createDataFrame(pa.table(columns)).write.parquet(path)


def load_model(spark: SparkSession, path: str, needed: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The arrays of ``save_model``; a part that is missing or not whole raises."""
    found = spark.read.parquet(path).orderBy("part", "i").toPandas()
    out = {name: g["value"].to_numpy() for name, g in found.groupby("part")}
    for name in needed:
        if name not in out:
            raise ValueError(f"the model at {path} has no {name}")
    for name, g in found.groupby("part"):
        if len(g) != g["size"].iloc[0] or g["i"].tolist() != list(range(len(g))):
            raise ValueError(f"{name} of the model at {path} is not whole")
    return out


def _per_feature(df: DataFrame, x: Column, *sums: Column) -> np.ndarray:
    """One row of statistics for each feature; ``sums`` are aggregates of ``v``."""
    found = df.select(F.posexplode(x).alias("i", "v")).groupBy("i").agg(*sums).orderBy("i").toArrow()
    return np.column_stack([found.column(c).to_numpy() for c in range(1, found.num_columns)])


def _constants(v: np.ndarray) -> Column:
    return F.lit(np.asarray(v, dtype=np.float64))


def sparse_scaled(control: DataFrame, df: DataFrame, x: str) -> DataFrame:
    """``x`` of ``df`` as roots of its counts, centred and scaled as ``control`` is; zeros stay zeros.

    The scale of a feature is its sample deviation plus the fourth power of its share of zeros
    plus 1e-8. Negative values count as zero. A control of fewer than two rows raises.
    """
    root = lambda c: F.transform(c, lambda v: F.sqrt(F.greatest(v, F.lit(0.0))))
    zero = F.avg(F.when(F.col("v") == 0, 1.0).otherwise(0.0))
    found = _per_feature(control, root(F.col(x)), F.avg("v"), F.stddev_samp("v"), zero, F.count("v"))
    if not len(found) or found[:, 3].min() < 2:
        raise ValueError("a scale takes two control rows at least")
    spread = found[:, 1] + found[:, 2] ** 4 + 1e-8
    both = F.arrays_zip(root(F.col(x)).alias("v"), _constants(found[:, 0]).alias("m"), _constants(spread).alias("s"))
    return df.withColumn(x, F.transform(both, lambda z: F.when(z["v"] == 0, 0.0).otherwise((z["v"] - z["m"]) / z["s"])))


def feature_blocks(control: DataFrame, df: DataFrame, blocks: list[str], out: str) -> DataFrame:
    """Blocks of features side by side, each feature divided by its deviation in ``control`` (as it is, where that is 0)."""
    parts = []
    for b in blocks:
        sd = np.nan_to_num(_per_feature(control, F.col(b), F.stddev_samp("v")).astype(float)[:, 0])
        parts.append(F.zip_with(F.col(b), _constants(np.where(sd > 0, sd, 1.0)), lambda v, s: v / s))
    return df.withColumn(out, F.concat(*parts))


def pooled(c: np.ndarray) -> np.ndarray:
    """Four poolings of each row: share of positive values, their mean, their mean place, their longest run.

    A row without positive values has 0, 0, -1, 0.
    """
    up = c > 0
    n = up.sum(axis=1)
    at = np.arange(c.shape[1])
    run, longest = np.zeros(len(c)), np.zeros(len(c))
    for j in at:
        run = (run + 1) * up[:, j]
        longest = np.maximum(longest, run)
    some = np.maximum(n, 1)
    return np.stack([n / c.shape[1], np.where(up, c, 0).sum(axis=1) / some, np.where(n > 0, (up * at).sum(axis=1) / some, -1.0), longest], axis=1)


def _responses(v: np.ndarray):
    """Responses of rows to kernels of nine taps, three of them 2 and the others -1, for dilations in powers of two."""
    n = v.shape[1]
    step = 1
    while step == 1 or 8 * step < n:
        pad = np.pad(v, ((0, 0), (4 * step, 4 * step)))
        taps = [pad[:, k * step : k * step + n] for k in range(9)]
        base = -sum(taps)
        for three in combinations(range(9), 3):
            yield base + 3 * sum(taps[k] for k in three)
        step *= 2


def _views(v: np.ndarray) -> list[np.ndarray]:
    return [v, np.diff(v, axis=1)]


def fit_kernel_biases(control: DataFrame, id_col: str, xs: str | list[str], *, examples: int = 84, each: int = 1) -> np.ndarray:
    """``each`` biases for every kernel, dilation and view: quantiles of its response to a control example.

    ``examples`` rows with the least hashes of their ids are taken in turn (of several columns the
    waveforms of the first come first); quantiles follow the golden ratio, so that neighbouring
    kernels, and biases of one kernel, get distant ones. An empty control raises.
    """
    names = [xs] if isinstance(xs, str) else xs
    some = control.where(all_of([F.col(x).isNotNull() for x in names])).orderBy(F.xxhash64(id_col), id_col).limit(examples)
    found = some.select(*[F.col(x).cast("array<double>").alias(f"x{i}") for i, x in enumerate(names)]).toArrow()
    if not len(found):
        raise ValueError("biases take a control example")
    v = np.concatenate([_matrix(found.column(c).combine_chunks()) for c in found.column_names])
    share = (1 + 5**0.5) / 2
    out = [[np.quantile(c[k % len(v)], (k * each + m + 1) * share % 1) for m in range(each)] for view in _views(v) for k, c in enumerate(_responses(view))]
    return np.array(out)


def pooled_responses(v: np.ndarray, biases: np.ndarray) -> np.ndarray:
    """Four poolings of each response less each of its biases, of rows and of their first differences."""
    responses = (c for view in _views(v) for c in _responses(view))
    return np.concatenate([pooled(c - bias) for c, own in zip(responses, biases, strict=True) for bias in own], axis=1)


def kernel_features(df: DataFrame, id_col: str, x: str, biases: np.ndarray) -> DataFrame:
    """``id`` and ``features``: four poolings of each response less its bias, of a waveform and of its first difference.

    Waveforms must be of one length; null ones are left out.
    """

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            f = pooled_responses(_matrix(b.column("x")), biases)
            offsets = pa.array(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(offsets, pa.array(f.ravel()))], names=["id", "features"])

    rows = df.where(F.col(x).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(x).cast("array<double>").alias("x"))
    return rows.mapInArrow(run, "id long, features array<double>")


def scaled_pair(control: DataFrame, df: DataFrame, a: str, b: str, out: str, *, shared: bool, sparse: bool = False) -> DataFrame:
    """Features of two detectors as one array ``out``: phi(s1) - phi(s2) if ``shared``, else side by side.

    A shared form is scaled by both detectors' control features together, so a swap only changes
    the sign of the result; side by side each detector has its own scale. Scales are population
    deviations (1 where that is 0), or those of ``sparse_scaled``.
    """
    def scales(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        value = F.sqrt(F.greatest(F.col("v"), F.lit(0.0))) if sparse else F.col("v")
        found = _per_feature(rows, F.col("x"), F.avg(value), F.stddev_samp(value) if sparse else F.stddev_pop(value), F.avg((F.col("v") <= 0).cast("double")), F.count("v"))
        if not len(found) or found[:, 3].min() < 2:
            raise ValueError("a scale takes two control rows at least")
        return (found[:, 0], found[:, 1] + found[:, 2] ** 4 + 1e-8) if sparse else (np.zeros(len(found)), np.where(found[:, 1] > 0, found[:, 1], 1.0))

    def scaled(c: str, scale: tuple[np.ndarray, np.ndarray]) -> Column:
        both = F.arrays_zip(F.col(c).alias("v"), _constants(scale[0]).alias("m"), _constants(scale[1]).alias("s"))
        root = lambda v: F.sqrt(F.greatest(v, F.lit(0.0))) if sparse else v
        return F.transform(both, lambda z: F.when(F.lit(sparse) & (z["v"] <= 0), 0.0).otherwise((root(z["v"]) - z["m"]) / z["s"]))

    one = lambda c: control.select(F.col(c).alias("x"))
    if shared:
        scale = scales(one(a).unionAll(one(b)))
        return df.withColumn(out, F.zip_with(scaled(a, scale), scaled(b, scale), lambda u, v: u - v))
    return df.withColumn(out, F.concat(scaled(a, scales(one(a))), scaled(b, scales(one(b)))))
