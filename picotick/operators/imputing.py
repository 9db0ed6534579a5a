"""A frozen bank of imputers, and local attributions that draw on it.

Windows divide a waveform; a *pattern* is a set of them that is hidden, written as bits. For every
pattern several imputers are compared: the mean, a line or a cubic through the neighbours, and the
conditional mean of component models of some sizes. Each is an affine map from the visible samples
to the hidden ones, so all of them, and their errors on rows kept apart, follow from two Gram
matrices that one pass over the data sums up. The winners are rows of a table; reconstructing looks
up a row's pattern and fits nothing again.

At most ``MOST_WINDOWS`` windows (a bank has a row for each of their sets), so the bank is small
enough for every task. With nothing visible the reference is explicit: the mean waveform.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import _matrix, gram, squares

MOST_WINDOWS = 10
SCHEMA = "pattern long, method string, rmse double, windows array<int>, offset array<double>, weights array<double>"


@dataclass(frozen=True)
class Imputer:
    """hidden = offset + weights @ visible"""

    hidden: np.ndarray
    offset: np.ndarray
    weights: np.ndarray

    def fill(self, v: np.ndarray) -> np.ndarray:
        out = v.copy()
        out[:, self.hidden] = self.offset + v[:, ~self.hidden] @ self.weights.T
        return out


def hidden_samples(pattern: int, windows: list[tuple[int, int]], n: int) -> np.ndarray:
    out = np.zeros(n, dtype=bool)
    for w, (start, width) in enumerate(windows):
        if pattern >> w & 1:
            out[start : start + width] = True
    return out


def _line(hidden: np.ndarray) -> np.ndarray:
    """Weights of the visible samples: between the nearest of them, and constant beyond the outer ones."""
    n, seen = len(hidden), np.flatnonzero(~hidden)
    at = np.flatnonzero(hidden)
    out = np.zeros((len(at), len(seen)))
    for r, i in enumerate(at):
        k = int(np.searchsorted(seen, i))
        if k in (0, len(seen)):
            out[r, min(k, len(seen) - 1)] = 1
        else:
            share = (i - seen[k - 1]) / (seen[k] - seen[k - 1])
            out[r, k - 1], out[r, k] = 1 - share, share
    assert n == len(at) + len(seen)
    return out


def _cubic(hidden: np.ndarray) -> np.ndarray:
    """Like a line, with the slopes of the two visible samples on either side where there are two."""
    seen, at = np.flatnonzero(~hidden), np.flatnonzero(hidden)
    out = _line(hidden)
    for r, i in enumerate(at):
        k = int(np.searchsorted(seen, i))
        if k < 2 or k > len(seen) - 2 or seen[k - 1] - seen[k - 2] != 1 or seen[k + 1] - seen[k] != 1:
            continue
        span = seen[k] - seen[k - 1]
        t = (i - seen[k - 1]) / span
        out[r] = 0
        for j, c in ((k - 1, 2 * t**3 - 3 * t**2 + 1), (k, 3 * t**2 - 2 * t**3)):
            out[r, j] += c
        for lo, hi, c in ((k - 2, k - 1, (t**3 - 2 * t**2 + t) * span), (k, k + 1, (t**3 - t**2) * span)):
            out[r, hi] += c
            out[r, lo] -= c
    return out


def _component_map(cov: np.ndarray, hidden: np.ndarray, components: int) -> np.ndarray:
    """Conditional mean of a model of some components and even noise."""
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector[:, ::-1]
    noise = max(float(value[components:].mean()) if components < len(value) else 0.0, 1e-12 * max(float(value[0]), 1e-300))
    w = vector[:, :components] * np.sqrt(np.maximum(value[:components] - noise, 0))
    c = w @ w.T + noise * np.eye(len(cov))
    return np.linalg.solve(c[np.ix_(~hidden, ~hidden)], c[np.ix_(~hidden, hidden)]).T


def _error(z: np.ndarray, hidden: np.ndarray, offset: np.ndarray, weights: np.ndarray) -> float:
    """RMSE of an affine map over the rows whose sums of products (of 1 and the samples) are ``z``."""
    # hidden - offset - weights @ visible is linear in (1, samples)
    a = np.zeros((int(hidden.sum()), len(z)))
    a[:, 0] = -offset
    at = np.flatnonzero(hidden) + 1
    a[np.arange(len(at)), at] = 1
    a[:, np.flatnonzero(~hidden) + 1] -= weights
    return float(np.sqrt(max(0.0, np.einsum("ij,jk,ik->", a, z, a)) / (len(at) * z[0, 0])))


def fit_bank(df: DataFrame, x: str, kept_apart: str, windows: list[tuple[int, int]], components: tuple[int, ...] = (2, 4, 8)) -> DataFrame:
    """The winner of every pattern, a row each of SCHEMA, from rows whose flag ``kept_apart`` is false, judged on the others.

    Windows must not overlap. Of equal errors the earlier method in the order mean, line, cubic,
    components wins. Rows without a flag, null waveforms and non-finite samples are left out.
    """
    if not 0 < len(windows) <= MOST_WINDOWS:
        raise ValueError(f"1 to {MOST_WINDOWS} windows")
    finite = F.forall(F.col(x), lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = df.where(F.col(kept_apart).isNotNull() & finite).select(F.col(x).cast("array<double>").alias("x"), F.col(kept_apart).cast("boolean").alias("apart"), F.lit(0.0).alias("_zero"))
    by = {k: z[:-1, :-1] for (k,), z in squares(gram(rows, "x", "_zero", ["apart"]), ["apart"]).items()}
    if set(by) != {True, False}:
        raise ValueError("a bank takes rows to fit and rows to judge by")
    fitted, judged = by[False], by[True]
    n = len(fitted) - 1
    mean = fitted[0, 1:] / fitted[0, 0]
    cov = fitted[1:, 1:] / fitted[0, 0] - np.outer(mean, mean)
    covered = sum(hidden_samples(1 << w, windows, n).astype(int) for w in range(len(windows)))
    if covered.max() > 1 or sum(width for _, width in windows) != covered.sum():
        raise ValueError("windows overlap or reach beyond the waveform")
    out = []
    for pattern in range(1, 1 << len(windows)):
        hidden = hidden_samples(pattern, windows, n)
        tried = [("mean", np.zeros((int(hidden.sum()), int((~hidden).sum()))), mean[hidden])]
        if not hidden.all():
            tried += [(name, w, np.zeros(len(w))) for name, w in (("line", _line(hidden)), ("cubic", _cubic(hidden)))]
            for c in components:
                w = _component_map(cov, hidden, c)
                tried.append((f"components={c}", w, mean[hidden] - w @ mean[~hidden]))
        errors = [_error(judged, hidden, offset, w) for _, w, offset in tried]
        best = int(np.argmin(errors))
        name, w, offset = tried[best]
        out.append((pattern, name, errors[best], [i for s in windows for i in s], offset.tolist(), w.ravel().tolist()))
    return df.sparkSession.createDataFrame(out, SCHEMA)


def load_bank(bank: DataFrame, samples: int) -> tuple[list[tuple[int, int]], dict[int, Imputer]]:
    """Windows and imputers of a bank's table."""
    rows = bank.collect()  # a row a pattern
    if not rows:
        raise ValueError("an empty bank")
    flat = rows[0]["windows"]
    windows = [(a, b) for a, b in zip(flat[::2], flat[1::2], strict=True)]
    out = {}
    for r in rows:
        hidden = hidden_samples(r["pattern"], windows, samples)
        out[r["pattern"]] = Imputer(hidden, np.array(r["offset"]), np.array(r["weights"]).reshape(int(hidden.sum()), int((~hidden).sum())))
    return windows, out


def reconstruct(df: DataFrame, id_col: str, x: str, bank: DataFrame, samples: int) -> DataFrame:
    """Every pattern of every waveform, filled from the bank: ``id``, ``pattern``, ``filled``. Null waveforms are left out."""
    _, imputers = load_bank(bank, samples)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                v = _matrix(b.column("x"))
                for pattern, imputer in sorted(imputers.items()):
                    f = imputer.fill(v)
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.full(len(v), pattern)), pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, samples, dtype=np.int32)), pa.array(f.ravel()))], names=["id", "pattern", "filled"])

    rows = df.where(F.size(x) == samples).select(F.col(id_col).cast("long").alias("id"), F.col(x).cast("array<double>").alias("x"))
    return rows.mapInArrow(run, "id long, pattern long, filled array<double>")


def local_attribution(df: DataFrame, id_col: str, x: str, bank: DataFrame, samples: int, predict: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Attribution and deletion of a cohort: ``id``, ``step``, ``window``, ``phi``, ``prediction``.

    phi(W) = [(v(W) - v(none)) + (v(all) - v(all but W))] / 2 with hidden samples from the bank. Step 0 is
    the whole waveform; step s hides the s windows of largest phi (of equal ones the earlier first),
    again from the bank and from the original samples, and carries the window it adds.
    """
    windows, imputers = load_bank(bank, samples)
    every = (1 << len(windows)) - 1

    def value(v: np.ndarray, hidden: int) -> np.ndarray:
        return predict(imputers[hidden].fill(v) if hidden else v)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                v, k = _matrix(b.column("x")), len(windows)
                full, none = value(v, 0), value(v, every)
                phi = np.stack([(value(v, every ^ (1 << w)) - none + full - value(v, 1 << w)) / 2 for w in range(k)], axis=1)
                order = np.argsort(-phi, axis=1, kind="stable")
                gone = np.cumsum(1 << order, axis=1)
                steps = np.empty((len(v), k + 1))
                steps[:, 0] = full
                for s in range(k):
                    for pattern in np.unique(gone[:, s]):
                        rows = gone[:, s] == pattern
                        steps[rows, s + 1] = value(v[rows], int(pattern))
                ranked = np.take_along_axis(phi, order, 1)
                first = np.tile(np.arange(k + 1) == 0, len(v))
                pad = lambda a: np.concatenate([np.zeros((len(v), 1), a.dtype), a], axis=1).ravel()
                yield pa.RecordBatch.from_arrays([
                    b.column("id").take(pa.array(np.repeat(np.arange(len(v)), k + 1))), pa.array(np.tile(np.arange(k + 1, dtype=np.int32), len(v))),
                    pa.array(pad(order.astype(np.int32)), mask=first), pa.array(pad(ranked), mask=first), pa.array(steps.ravel())], names=["id", "step", "window", "phi", "prediction"])

    rows = df.where(F.size(x) == samples).select(F.col(id_col).cast("long").alias("id"), F.col(x).cast("array<double>").alias("x"))
    return rows.mapInArrow(run, "id long, step int, window int, phi double, prediction double")
