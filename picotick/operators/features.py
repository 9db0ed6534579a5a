"""Shapelet, competing-kernel and phase features of waveforms, and draws of hidden samples.

Features are made row by row in tasks, from parameters that are fitted on a bounded number of
control examples or drawn from a seed; they do not depend on how rows are dealt out.
Waveforms of a column must be of one length; null ones are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from .matching import all_of
from .models import _matrix

#: Rows that a task turns into features at once.
ROWS = 256


def examples(control: DataFrame, id_col: str, xs: str | list[str], n: int) -> np.ndarray:
    """The ``n`` control waveforms with the least hashes of their ids, of several columns one after the other; none at all raises."""
    names = [xs] if isinstance(xs, str) else xs
    some = control.where(all_of([F.col(x).isNotNull() for x in names])).orderBy(F.xxhash64(id_col), id_col).limit(-(-n // len(names)))
    found = some.select(*[F.col(x).cast("array<double>").alias(f"x{i}") for i, x in enumerate(names)]).toArrow()
    if not len(found):
        raise ValueError("a fit takes a control example")
    return np.concatenate([_matrix(found.column(c).combine_chunks()) for c in found.column_names])


def _mapped(df: DataFrame, id_col: str, x: str, name: str, function) -> DataFrame:
    """``id`` and an array ``name`` of each row's ``function(ids, waveforms)``."""

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                b = whole.slice(first, ROWS)
                f = function(b.column("id").fill_null(-1).to_numpy(zero_copy_only=False), _matrix(b.column("x")))
                offsets = pa.array(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(offsets, pa.array(f.ravel()))], names=["id", name])

    rows = df.where(F.col(x).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(x).cast("array<double>").alias("x"))
    return rows.mapInArrow(run, f"id long, {name} array<double>")


def paired(df: DataFrame, id_col: str, s1: str, s2: str, function, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id``, ``keep`` and ``a``, ``b``: the features of both detectors' waveforms, in one pass. Rows that lack one are left out."""

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                part = whole.slice(first, ROWS)
                out = []
                for c in ("_s1", "_s2"):
                    f = np.ascontiguousarray(function(_matrix(part.column(c))), dtype=np.float64)
                    out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32)), pa.array(f.ravel())))
                yield pa.RecordBatch.from_arrays([part.column("id"), *(part.column(k) for k in keep), *out], names=["id", *keep, "a", "b"])

    rows = df.where((F.size(s1) > 0) & (F.size(s2) > 0)).select(F.col(id_col).alias("id"), *keep, F.col(s1).cast("array<double>").alias("_s1"), F.col(s2).cast("array<double>").alias("_s2"))
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c not in ("_s1", "_s2"))
    return rows.mapInArrow(run, f"{schema}, a array<double>, b array<double>")


def _windows(v: np.ndarray, length: int, step: int) -> np.ndarray:
    """Of each row, all stretches of ``length`` samples that lie ``step`` apart."""
    return np.stack([v[:, k * step : v.shape[1] - (length - 1 - k) * step] for k in range(length)], axis=2)


def _standard(w: np.ndarray) -> np.ndarray:
    sd = w.std(axis=-1, keepdims=True)
    return (w - w.mean(axis=-1, keepdims=True)) / np.where(sd > 0, sd, 1)


@dataclass(frozen=True)
class Shapelet:
    values: np.ndarray
    step: int
    standard: bool
    near: float

    def distances(self, v: np.ndarray) -> np.ndarray:
        """Sum of absolute differences to each stretch of each row."""
        w = _windows(v, len(self.values), self.step)
        return np.abs((_standard(w) if self.standard else w) - self.values).sum(axis=2)


def fit_shapelets(control: DataFrame, id_col: str, x: str | list[str], count: int, *, length: int = 11, standard: float = 0.8, seed: int = 7, most: int = 256) -> list[Shapelet]:
    """``count`` random dilated stretches of at most ``most`` control examples.

    A shapelet is standardised with the probability ``standard``; it occurs where the distance is at
    most a random quantile between 5 and 10 % of its distances to another example.
    """
    v = examples(control, id_col, x, most)
    if v.shape[1] < length:
        raise ValueError(f"waveforms of {v.shape[1]} samples have no stretch of {length}")
    r, out = np.random.default_rng(seed), []
    powers = int(np.log2((v.shape[1] - 1) / max(1, length - 1))) + 1 if length > 1 else 1
    for _ in range(count):
        step, a, b = 1 << int(r.integers(powers)), int(r.integers(len(v))), int(r.integers(len(v)))
        start, flat, share = int(r.integers(v.shape[1] - (length - 1) * step)), bool(r.random() < standard), r.uniform(0.05, 0.1)
        values = v[a, start : start + (length - 1) * step + 1 : step]
        s = Shapelet(_standard(values) if flat else values, step, flat, 0.0)
        out.append(Shapelet(s.values, step, flat, float(np.quantile(s.distances(v[b : b + 1]), share))))
    return out


def shapelet_values(v: np.ndarray, shapelets: list[Shapelet]) -> np.ndarray:
    out = []
    for s in shapelets:
        d = s.distances(v)
        out += [d.min(axis=1), d.argmin(axis=1), (d <= s.near).sum(axis=1)]
    return np.stack(out, axis=1).astype(float)


def shapelet_features(df: DataFrame, id_col: str, x: str, shapelets: list[Shapelet]) -> DataFrame:
    """Per shapelet: least distance, its first place, and the number of places where the shapelet occurs."""
    return _mapped(df, id_col, x, "features", lambda _, v: shapelet_values(v, shapelets))


def competing_kernel_features(df: DataFrame, id_col: str, x: str, *, groups: int = 16, kernels: int = 8, seed: int = 7) -> DataFrame:
    """In each group, kernels compete for every sample: the largest response is added to its kernel's
    first count, the smallest adds one to its kernel's second.

    Kernels are nine normal draws, centred and of absolute sum one. Half of the groups see the waveform,
    half its first difference, each under dilations in powers of two; ``groups`` is even. Features come by
    view, dilation, group and kernel, first counts before second ones.
    """
    weights = competing_kernels(groups, kernels, seed)
    return _mapped(df, id_col, x, "features", lambda _, v: competing_values(v, weights))


def competing_kernels(groups: int = 16, kernels: int = 8, seed: int = 7) -> np.ndarray:
    """[view, group, kernel, tap]"""
    if groups < 2 or groups % 2:
        raise ValueError("groups must be even")
    weights = np.random.default_rng(seed).normal(size=(2, groups // 2 * kernels, 9))
    weights -= weights.mean(axis=2, keepdims=True)
    weights /= np.abs(weights).sum(axis=2, keepdims=True)
    return weights.reshape(2, groups // 2, kernels, 9)


def competing_values(v: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out, kernels = [], weights.shape[2]
    for view, weight in zip((v, np.diff(v, axis=1)), weights, strict=True):
        step = 1
        while step == 1 or 8 * step < view.shape[1]:
            padded = np.pad(view, ((0, 0), (4 * step, 4 * step)))
            c = (_windows(padded, 9, step) @ weight.reshape(-1, 9).T).reshape(*view.shape, len(weight), kernels)
            best, least = c.argmax(axis=3)[..., None], c.argmin(axis=3)[..., None]
            each = np.arange(kernels)
            out.append(np.where(best == each, c, 0).sum(axis=1).reshape(len(v), -1))
            out.append((least == each).sum(axis=1).reshape(len(v), -1))
            step *= 2
    return np.concatenate(out, axis=1).astype(float)


def unit_phases(s1: Column, s2: Column, cycles: list[float], n: int, relative: bool) -> Column:
    """Phases of some frequencies as (cos, sin): of both detectors, or of the first against the second.

    A frequency without amplitude has (0, 0).
    """

    def unit(x: Column, f: float):
        return A.let(A.projection(x, f, n), lambda p: A.let(F.hypot(p["re"], p["im"]), lambda r: F.struct(
            F.when(r > 0, p["re"] / r).otherwise(0.0).alias("c"), F.when(r > 0, p["im"] / r).otherwise(0.0).alias("s"))))

    out = []
    for f in cycles:
        a, b = unit(s1, f), unit(s2, f)
        out += [a["c"] * b["c"] + a["s"] * b["s"], a["s"] * b["c"] - a["c"] * b["s"]] if relative else [a["c"], a["s"], b["c"], b["s"]]
    return F.array(*out)


def ppca_draws(df: DataFrame, id_col: str, x: str, model: tuple[np.ndarray, np.ndarray, float], missing: list[int], draws: int, seed: int = 7) -> DataFrame:
    """``draws`` samples of the missing places given the others: ``id``, ``draw``, ``filled`` (all places).

    A row's draws follow from its id and the seed, so reruns agree; rows that share an id share their noise, and
    a null id draws as -1.
    """
    mean, w, noise = model
    gone = np.zeros(len(mean), dtype=bool)
    gone[missing] = True
    c = w @ w.T + noise * np.eye(len(mean))
    back = np.linalg.solve(c[np.ix_(~gone, ~gone)], c[np.ix_(~gone, gone)])
    rest = c[np.ix_(gone, gone)] - c[np.ix_(gone, ~gone)] @ back
    root = np.linalg.cholesky((rest + rest.T) / 2)

    def fill(ids, v):
        z = np.stack([np.random.default_rng([seed, int(i) % (1 << 64)]).normal(size=(draws, gone.sum())) for i in ids])
        out = np.repeat(v[:, None, :], draws, axis=1)
        out[:, :, gone] = (mean[gone] + (v[:, ~gone] - mean[~gone]) @ back)[:, None, :] + z @ root.T
        return out.reshape(len(v), -1)

    n = len(mean)
    flat = _mapped(df, id_col, x, "f", fill)
    return flat.select("id", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"), "f").select("id", "draw", F.slice("f", F.col("draw") * n + 1, n).alias("filled"))
