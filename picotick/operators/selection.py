"""Energy peaks, control rules and window selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .robust import finite, robust_scale

#: Bins of a group's histogram, which one task holds.
MOST_BINS = 100_000


def histograms(df: DataFrame, value: str, keys: list[str], step: float) -> DataFrame:
    """Per group and bin (``x``, its centre): ``w``, the number of finite values. Counted before rows move."""
    bins = df.select(*keys, (F.floor(finite(value) / step + 0.5) * step).alias("x")).where("x is not null")
    return bins.groupBy(*keys, "x").agg(F.count("*").cast("double").alias("w"))


def _of_groups(df: DataFrame, value: str, keys: list[str], step: float, columns: dict[str, str], measure) -> DataFrame:
    """Runs ``measure(centres, counts) -> values of the columns`` for each group's histogram, all groups in one pass.

    A task holds one group's bins, at most MOST_BINS; more raise.
    """
    bins = histograms(df, value, keys, step)
    types = dict(bins.dtypes)

    def run(group: tuple, table: pa.Table) -> pa.Table:
        if len(table) > MOST_BINS:
            raise ValueError(f"more than {MOST_BINS} bins; take a larger step than {step}")
        table = table.sort_by("x")
        found = measure(table.column("x").to_numpy(), table.column("w").to_numpy())
        kinds = {"double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}
        return pa.Table.from_arrays([*(pa.array([k.as_py()], k.type) for k in group[: len(keys)]), *(pa.array([v], kinds[columns[c]]) for c, v in zip(columns, found, strict=True))], names=[*keys, *columns])

    return bins.withColumn("_all", F.lit(0)).groupBy(*(keys or ["_all"])).applyInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in keys), *(f"{c} {t}" for c, t in columns.items())]))


def _weighted_median(x: np.ndarray, w: np.ndarray) -> float:
    """Median of sorted values that come ``w`` times each."""
    ends, n = np.cumsum(w), w.sum()
    at = lambda r: x[min(len(x) - 1, int(np.searchsorted(ends, r, side="right")))]
    return float((at((n - 1) // 2) + at(n // 2)) / 2)


def peak_intervals(df: DataFrame, value: str, keys: list[str], step: float, left: float, right: float, bandwidth: float = 1.0, least_height: float = 0.3, rightmost: bool = True) -> DataFrame:
    """Per group: ``n``, ``centre``, ``sigma`` and [``low``, ``high``] = [centre - left sigma, centre + right sigma] of a peak.

    The density is a Gaussian kernel's over the histogram, with Scott's bandwidth times
    ``bandwidth``. Of peaks over ``least_height`` of the highest, the right-most (or the highest)
    counts; its core above half its height gives a robust centre and width. A group without a
    peak has nulls; a group without finite values has no row.
    """

    def measure(x: np.ndarray, w: np.ndarray) -> tuple:
        n, mean = w.sum(), np.average(x, weights=w)
        sd = np.sqrt(np.average((x - mean) ** 2, weights=w)) or step
        h = bandwidth * sd * n ** (-1 / 5)
        grid = np.linspace(x[0] - 3 * h, x[-1] + 3 * h, 1024)
        density = np.concatenate([(np.exp(-0.5 * ((g[:, None] - x) / h) ** 2) * w).sum(axis=1) for g in np.array_split(grid, 16)])
        inner = np.flatnonzero((density[1:-1] > density[:-2]) & (density[1:-1] >= density[2:])) + 1
        high = inner[density[inner] >= least_height * density.max()]
        if not len(high):
            return int(n), None, None, None, None
        top = high[-1] if rightmost else high[np.argmax(density[high])]
        lower = np.flatnonzero(density < density[top] / 2)
        lo, hi = max(lower[lower < top], default=-1) + 1, min(lower[lower > top], default=len(grid)) - 1
        core = (x >= grid[lo]) & (x <= grid[hi])
        if not core.any():
            return int(n), None, None, None, None
        centre = _weighted_median(x[core], w[core])
        off = np.abs(x[core] - centre)
        by = np.argsort(off, kind="stable")
        sigma = 1.4826 * _weighted_median(off[by], w[core][by]) or (grid[hi] - grid[lo]) / 2.355
        return int(n), centre, sigma, centre - left * sigma, centre + right * sigma

    return _of_groups(df, value, keys, step, {"n": "long", "centre": "double", "sigma": "double", "low": "double", "high": "double"}, measure)


def peak_interval(df: DataFrame, value: str, step: float, left: float, right: float, bandwidth: float = 1.0, least_height: float = 0.3, rightmost: bool = True) -> tuple[float, float]:
    """The interval of a table of one group."""
    found = peak_intervals(df, value, [], step, left, right, bandwidth, least_height, rightmost).first()
    if found is None or found.low is None:
        raise ValueError("no peak of finite values")
    return found.low, found.high


def gaussian_peaks(df: DataFrame, value: str, keys: list[str], step: float, reach: float = 1.5, rounds: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """Per group: ``amplitude``, ``centre``, ``sigma``, their errors, ``chi2``, ``n_bins`` and ``success`` of a fitted peak.

    The highest bin of the smoothed histogram starts it; fits of the bins within ``reach`` sigma
    of the last one are repeated until centre and width stand still. Errors follow from the
    curvature of chi-squared. With fewer than four bins in reach there is no fit.
    """

    def measure(x: np.ndarray, w: np.ndarray) -> tuple:
        # bins without values belong to the curve too
        i = np.rint((x - x[0]) / step).astype(int)
        if i[-1] >= MOST_BINS:
            raise ValueError(f"more than {MOST_BINS} bins; take a larger step than {step}")
        full = np.zeros(i[-1] + 1)
        full[i] = w
        x, w = x[0] + step * np.arange(len(full)), full
        smooth = np.convolve(np.pad(w, 2), np.ones(5) / 5, mode="valid")
        top = int(np.argmax(smooth))
        half = np.abs(x - x[top])[smooth < smooth[top] / 2]
        p, fitted = np.array([smooth[top], x[top], max(step, float(half.min()) / 1.18) if len(half) else step]), False
        for _ in range(rounds):
            m = np.abs(x - p[1]) <= reach * p[2]
            if m.sum() < 4:
                break
            q = _damped_fit(x[m], w[m], p)
            done, p, fitted = np.abs(q - p)[1:].max() <= tolerance * q[2], q, True
            if done:
                break
        z = (x - p[1]) / p[2]
        inside = np.abs(z) <= reach
        g = p[0] * np.exp(-0.5 * z * z)
        chi2 = float((((w - g) ** 2 / np.maximum(w, 1))[inside]).sum())
        j = np.stack([g / p[0], g * z / p[2], g * z * z / p[2]], axis=1)[inside]
        curvature = j.T @ (j / np.maximum(w[inside], 1)[:, None])
        errors = [float(e) for e in np.sqrt(np.diag(np.linalg.inv(curvature)))] if fitted and np.linalg.cond(curvature) < 1e12 else [None] * 3
        return float(p[0]), float(p[1]), float(p[2]), *errors, chi2, int(inside.sum()), fitted

    columns = {c: "double" for c in ("amplitude", "centre", "sigma", "amplitude_error", "centre_error", "sigma_error", "chi2")}
    return _of_groups(df, value, keys, step, columns | {"n_bins": "long", "success": "boolean"}, measure)


def gaussian_peak(df: DataFrame, value: str, step: float, reach: float = 1.5, rounds: int = 20, tolerance: float = 1e-4) -> dict[str, float]:
    """The fit of a table of one group."""
    found = gaussian_peaks(df, value, [], step, reach, rounds, tolerance).first()
    if found is None:
        raise ValueError("no finite values")
    return found.asDict()


def _damped_fit(x: np.ndarray, y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Least squares of a Gaussian with Poisson weights; steps that do not help are damped more."""
    weight, damp = 1 / np.maximum(y, 1), 1e-3
    curve = lambda q: q[0] * np.exp(-0.5 * ((x - q[1]) / q[2]) ** 2)
    cost = lambda q: float((weight * (y - curve(q)) ** 2).sum())
    for _ in range(60):
        z = (x - p[1]) / p[2]
        g = curve(p)
        j = np.stack([g / p[0], g * z / p[2], g * z * z / p[2]], axis=1)
        a = j.T @ (j * weight[:, None])
        q = p + np.linalg.solve(a + damp * np.diag(np.diag(a)) + 1e-12 * np.eye(3), j.T @ (weight * (y - g)))
        if q[0] > 0 and q[2] > 0 and cost(q) <= cost(p):
            small = np.abs(q - p).max() < 1e-9 * np.abs(p).max()
            p, damp = q, damp / 3
            if small:
                break
        else:
            damp *= 4
            if damp > 1e9:
                break
    return p


def inside(columns: dict[str, tuple[float, float]]) -> Column:
    """True if every column is finite and within its closed interval."""
    out = F.lit(True)
    for c, (low, high) in columns.items():
        out = out & F.coalesce(finite(c).between(low, high), F.lit(False))
    return out


def noise_limits(df: DataFrame, rms: str, clipped: Column, keys: list[str], factor: float) -> DataFrame:
    """Upper noise limit per group: median plus ``factor`` robust deviations of rows that are not clipped."""
    s = robust_scale(df.where(~clipped), rms, keys, "std_one")
    return s.select(*keys, (F.col("center") + factor * F.col("scale")).alias("limit"))


def best_threshold(scan: DataFrame, least_efficiency: float, keys: list[str] | None = None) -> DataFrame:
    """The scan's row of smallest (ctr, threshold) among efficient ones, for each group of ``keys``; none gives no row."""
    good = scan.where((F.col("efficiency") >= least_efficiency) & F.col("ctr").isNotNull())
    if not keys:
        return good.orderBy("ctr", "threshold").limit(1)
    others = [c for c in scan.columns if c not in keys]
    best = good.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct("ctr", "threshold")).alias("_b"))
    return best.select(*keys, "_b.*").select(*scan.columns)


def nearest_duration(hits: Column, centre: float, low: float, high: float) -> Column:
    """Of an array of hits with ``duration``: the one nearest to the centre within limits, the earlier of ties."""
    good = F.filter(F.transform(hits, lambda h, i: F.struct(F.abs(h["duration"] - centre).alias("d"), i.alias("i"), h.alias("h"))), lambda x: (x["h"]["duration"] >= low) & (x["h"]["duration"] <= high))
    return F.array_min(good)["h"]


def sample_mask(df: DataFrame, a: str, b: str, share: float = 0.99) -> list[bool]:
    """Which time samples to keep: not those where both detectors are exactly 0 or 1 in ``share`` of events or more.

    The mask has one entry per sample; if all would go, all stay.
    """
    edge = lambda c: (F.col(c) == 0) | (F.col(c) == 1)
    rows = df.select(F.posexplode(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))).alias("pos", "z")).select("pos", F.col("z.a").alias("a"), F.col("z.b").alias("b"))
    found = rows.groupBy("pos").agg(F.avg((edge("a") & edge("b")).cast("double")).alias("f")).orderBy("pos").collect()
    mask = [r.f < share for r in found]
    return mask if any(mask) else [True] * len(mask)


def clipped_prediction(prediction: Column, most: float) -> Column:
    """A prediction held to [-most, most]; null and NaN stay missing."""
    x = finite(prediction)
    return F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), x))


def outlier_sets(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """Adds ``either``, ``both``, ``only_first``, ``only_second`` and ``core`` (neither) from two flags; null flags are false."""
    a, b = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    return df.select("*", (a | b).alias("either"), (a & b).alias("both"), (a & ~b).alias("only_first"), (b & ~a).alias("only_second"), (~a & ~b).alias("core"))


def side_counts(df: DataFrame, value: str, centre: Column, populations: dict[str, Column]) -> DataFrame:
    """How many rows of each population lie below, above or on a centre: ``population``, ``side``, ``n``, ``share``."""
    x = finite(value)
    side = F.when(x < centre, "below").when(x > centre, "above").otherwise("equal")
    which = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in populations.items()]))).alias("population")
    n = df.where(x.isNotNull()).select(side.alias("side"), which).groupBy("population", "side").agg(F.count("*").alias("n"))
    total = n.groupBy("population").agg(F.sum("n").alias("_all"))
    return n.join(total, "population").select("population", "side", "n", (F.col("n") / F.col("_all")).alias("share"))


def corrected_count(df: DataFrame, selected: tuple[str, str], baseline: tuple[str, str], choice: tuple[str, str], limit: float) -> DataFrame:
    """Events whose selected candidate passes both z limits while the baseline does not, with another choice: one row."""
    good = lambda z: F.coalesce((F.abs(finite(z[0])) <= limit) & (F.abs(finite(z[1])) <= limit), F.lit(False))
    changed = ~F.col(choice[0]).eqNullSafe(F.col(choice[1]))
    return df.agg(F.count("*").alias("n"), F.count_if(good(selected)).alias("selected_ok"), F.count_if(good(baseline)).alias("baseline_ok"), F.count_if(good(selected) & ~good(baseline) & changed).alias("corrected"))


def interval_grid(df: DataFrame, detectors: dict[str, tuple[float, float]], fractions: list[float], metric: str) -> DataFrame:
    """Photopeak scan: for every detector, side and fraction, the metric of rows inside the reduced interval.

    An interval [low, high] is cut from the left, the right or both ends by a fraction of its
    width. One aggregation with a filter for each cut (a few dozen): rows are neither copied nor
    shuffled, and its one row is then laid out by cut.
    """
    cuts = []
    for name, (low, high) in detectors.items():
        for f in fractions:
            w = (high - low) * f
            cuts += [(name, side, f, lo, hi) for side, lo, hi in (("left", low + w, high), ("right", low, high - w), ("both", low + w / 2, high - w / 2))]
    rows = df.select(*[finite(d).alias(f"_d{i}") for i, d in enumerate(detectors)], finite(metric).alias("_m")).where("_m is not null")
    at = {d: f"_d{i}" for i, d in enumerate(detectors)}
    sums = []
    for i, (d, _, _, lo, hi) in enumerate(cuts):
        m = F.when(F.col(at[d]).between(lo, hi), F.col("_m"))
        sums += [F.count(m).alias(f"n{i}"), F.avg(m).alias(f"m{i}"), F.var_pop(m).alias(f"v{i}")]
    each = F.array(*[F.struct(F.lit(d).alias("detector"), F.lit(s).alias("side"), F.lit(float(f)).alias("fraction"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("v")) for i, (d, s, f, _, _) in enumerate(cuts)])
    found = rows.agg(*sums).select(F.inline(each)).where("n > 0")
    std = F.sqrt(F.col("v") * F.col("n") / F.nullif(F.col("n") - 1, F.lit(0)))
    return found.select("detector", "side", "fraction", "n", "mean", std.alias("std"), F.sqrt(F.col("mean") * F.col("mean") + F.col("v")).alias("rmse"))


def threshold_scan(df: DataFrame, residuals: dict[float, str]) -> DataFrame:
    """Per threshold (a column of residuals each, null where it has no crossing): n, efficiency, mean and std."""
    each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), finite(c).alias("x")) for t, c in residuals.items()])).alias("s")
    s = df.select(each).groupBy("s.threshold").agg(F.count("s.x").alias("n"), (F.count("s.x") / F.count("*")).alias("efficiency"), F.avg("s.x").alias("mean"), F.stddev_samp("s.x").alias("ctr"))
    return s


def frozen_calibration(control: DataFrame, residuals: dict[float, str], least_efficiency: float) -> DataFrame:
    """What the control data fix for good: the best threshold and the mean residual there, one row."""
    return best_threshold(threshold_scan(control, residuals), least_efficiency).select("threshold", F.col("mean").alias("control_mean"), "efficiency", "ctr")


def control_rules(df: DataFrame, energy: str, low: float, high: float, rms: str, clipped: Column, factor: float, residual: str, window: float) -> DataFrame:
    """Rows after each control rule in turn: energy interval, noise limit of unclipped rows, coincidence. One row of counts and limits."""
    at_peak = df.where(inside({energy: (low, high)}))
    limit = noise_limits(at_peak, rms, clipped, [], factor).select("limit").scalar()
    quiet = F.coalesce((finite(rms) <= limit) & ~clipped, F.lit(False))
    met = quiet & F.coalesce(F.abs(finite(residual)) <= window, F.lit(False))
    counts = at_peak.agg(F.count("*").alias("n_energy"), F.count_if(quiet).alias("n_quiet"), F.count_if(met).alias("n_coincident"))
    return counts.select(df.agg(F.count("*")).scalar().alias("n_read"), "*", limit.alias("noise_limit"))
