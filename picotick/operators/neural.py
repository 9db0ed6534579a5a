"""Small neural scorers of waveforms, trained by distributed gradient sums.

A step sends the weights to the tasks; each runs forward and backward over its rows in NumPy and
gives one gradient, and gradients are added entry by entry in an aggregation. What reaches the
driver is one number a weight (at most ``MOST_WEIGHTS``), whatever the number of rows, so a fit
does not depend on how the rows are dealt but for the order of its sums. Mini-batches are folds
of a hash of the id, written once as partitions of a table, so a step reads its own rows only; one
more fold is held out and stops the fit early.

A scorer is a chain of layers over the samples of a detector:

* ``dense``: every sample to every unit;
* ``conv``: kernels shared over time, a matrix product over sliding windows;
* ``local``: kernels of their own for every place;
* ``tanh``, ``relu``, ``bounded`` (tanh times a limit).

``shape`` says what it sees: ``direct`` both detectors side by side, ``fused`` both as channels of
one signal, ``antisymmetric`` each on its own, g(s1) - g(s2), so a swap only changes the sign.
Rows without a target or with an empty waveform are not used in a fit; predictions of such
waveforms are null. Waveforms of unequal length raise.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import folder
from .training import _entries, _summed

MOST_WEIGHTS = 1 << 20
#: Rows that a task takes through the network at a time.
ROWS = 2048


@dataclass(frozen=True)
class Layer:
    """``kind`` and its size: units or kernels, taps and stride, or the limit of ``bounded``."""

    kind: str
    size: float = 0
    taps: int = 0
    stride: int = 1


def dense(units: int) -> Layer:
    return Layer("dense", units)


def conv(kernels: int, taps: int, stride: int = 1) -> Layer:
    return Layer("conv", kernels, taps, stride)


def local(kernels: int, taps: int, stride: int = 1) -> Layer:
    return Layer("local", kernels, taps, stride)


TANH, RELU = Layer("tanh"), Layer("relu")


def bounded(limit: float) -> Layer:
    return Layer("bounded", limit)


def _windows(x: np.ndarray, taps: int, stride: int) -> np.ndarray:
    """[rows, channels, time] -> [rows, places, channels * taps]."""
    w = np.lib.stride_tricks.sliding_window_view(x, taps, axis=2)[:, :, ::stride]
    return w.transpose(0, 2, 1, 3).reshape(len(x), w.shape[2], -1)


def _unwindowed(g: np.ndarray, shape: tuple, taps: int, stride: int) -> np.ndarray:
    """Adds the gradients of windows up over the samples they share."""
    out = np.zeros(shape)
    each = g.reshape(g.shape[0], g.shape[1], shape[1], taps)
    for k in range(taps):
        out[:, :, k : k + stride * g.shape[1] : stride][:, :, : g.shape[1]] += each[:, :, :, k].transpose(0, 2, 1)
    return out


class Scorer:
    """The chain of layers over inputs of a fixed shape (channels, samples); weights are one flat vector."""

    def __init__(self, layers: tuple[Layer, ...], shape: tuple[int, int]):
        self.layers, self.shape, self.sizes = layers, shape, []
        channels, time = shape
        for layer in layers:
            if layer.kind == "dense":
                self.sizes.append(((channels * time, int(layer.size)), (int(layer.size),)))
                channels, time = int(layer.size), 1
            elif layer.kind in ("conv", "local"):
                places = (time - layer.taps) // layer.stride + 1
                if places < 1:
                    raise ValueError(f"{layer.taps} taps over {time} samples")
                own = (places,) if layer.kind == "local" else ()
                self.sizes.append(((*own, channels * layer.taps, int(layer.size)), (*own, int(layer.size))))
                channels, time = int(layer.size), places
            else:
                self.sizes.append(())
        if (channels, time) != (1, 1):
            raise ValueError("the last layer has to give one number")
        self.count = sum(int(np.prod(s)) for pair in self.sizes for s in pair)
        if self.count > MOST_WEIGHTS:
            raise ValueError(f"{self.count} weights; at most {MOST_WEIGHTS}")

    def start(self, seed: int) -> np.ndarray:
        """Weights with variance 2 / (inputs + outputs), biases 0."""
        rng, out = np.random.default_rng(seed), []
        for pair in self.sizes:
            if pair:
                fan = sum(pair[0][-2:])
                out += [rng.normal(0, np.sqrt(2 / fan), pair[0]).ravel(), np.zeros(int(np.prod(pair[1])))]
        return np.concatenate(out)

    def _parts(self, weights: np.ndarray) -> list:
        at, out = 0, []
        for pair in self.sizes:
            arrays = []
            for s in pair:
                n = int(np.prod(s))
                arrays.append(weights[at : at + n].reshape(s))
                at += n
            out.append(arrays)
        return out

    def forward(self, weights: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Scores of [rows, channels, samples], and what ``backward`` needs."""
        kept = []
        for layer, own in zip(self.layers, self._parts(weights), strict=True):
            if layer.kind == "dense":
                z = x.reshape(len(x), -1)
                kept.append((z, x.shape))
                x = (z @ own[0] + own[1])[:, :, None]
            elif layer.kind in ("conv", "local"):
                z = _windows(x, layer.taps, layer.stride)
                kept.append((z, x.shape))
                x = (z @ own[0] if layer.kind == "conv" else np.einsum("npf,pfo->npo", z, own[0])) + own[1]
                x = x.transpose(0, 2, 1)
            elif layer.kind == "relu":
                kept.append(x > 0)
                x = np.maximum(x, 0)
            else:
                scale = layer.size if layer.kind == "bounded" else 1.0
                x = np.tanh(x / scale)
                kept.append(x)
                x = scale * x
        return x.reshape(len(x)), kept

    def backward(self, weights: np.ndarray, kept: list, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of sum(g * score) by the weights and by each input."""
        g, grads = g[:, None, None], []
        for layer, own, seen in zip(reversed(self.layers), reversed(self._parts(weights)), reversed(kept), strict=True):
            if layer.kind == "dense":
                z, shape = seen
                g = g.reshape(len(g), -1)
                grads += [g.sum(axis=0), z.T @ g]
                g = (g @ own[0].T).reshape(shape)
            elif layer.kind in ("conv", "local"):
                z, shape = seen
                g = g.transpose(0, 2, 1)
                if layer.kind == "conv":
                    grads += [g.sum(axis=(0, 1)), z.reshape(-1, z.shape[2]).T @ g.reshape(-1, g.shape[2])]
                    g = g @ own[0].T
                else:
                    grads += [g.sum(axis=0), np.einsum("npf,npo->pfo", z, g)]
                    g = np.einsum("npo,pfo->npf", g, own[0])
                g = _unwindowed(g, shape, layer.taps, layer.stride)
            elif layer.kind == "relu":
                g = g * seen
            else:
                g = g * (1 - seen**2)
        flat = [a.ravel() for a in reversed(grads)]
        return np.concatenate(flat), g


@dataclass
class Model:
    layers: tuple[Layer, ...]
    shape: str
    samples: int
    weights: np.ndarray
    centre: float
    scale: float
    history: list = field(default_factory=list)  # (epoch, held-out RMSE)

    def scorer(self) -> Scorer:
        n = self.samples
        return Scorer(self.layers, {"direct": (1, 2 * n), "fused": (2, n), "antisymmetric": (1, n)}[self.shape])


def _inputs(shape: str, a: np.ndarray, b: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """(sign, input) of each pass through the scorer."""
    if shape == "antisymmetric":
        return [(1.0, a[:, None, :]), (-1.0, b[:, None, :])]
    if shape == "fused":
        return [(1.0, np.stack([a, b], axis=1))]
    return [(1.0, np.concatenate([a, b], axis=1)[:, None, :])]


def _waves(b: pa.RecordBatch, samples: int, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    found = []
    for c in ("a", "b"):
        column = b.column(c).slice(start, stop - start)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if len(flat) != samples * len(column):
            raise ValueError("waveforms are of unequal length")
        found.append(np.asarray(flat, np.float64).reshape(-1, samples))
    return found[0], found[1]


def _slices(batches):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b, at, min(b.num_rows, at + ROWS)


def loss_sums(model: Model, weights: np.ndarray, rows: DataFrame) -> tuple[float, float, np.ndarray]:
    """Rows, sum of squared errors, and its gradient, over ``a``, ``b``, ``y`` (scaled)."""

    def run(batches):
        scorer, total = model.scorer(), np.zeros(2 + len(weights))
        for b, start, stop in _slices(batches):
            waves = _waves(b, model.samples, start, stop)
            y = b.column("y").slice(start, stop - start).to_numpy(zero_copy_only=False)
            passes = [(sign, *scorer.forward(weights, x)) for sign, x in _inputs(model.shape, *waves)]
            error = sum(sign * score for sign, score, _ in passes) - y
            total[0] += len(y)
            total[1] += float(error @ error)
            for sign, _, kept in passes:
                total[2:] += scorer.backward(weights, kept, 2 * sign * error)[0]
        yield _entries(total)

    sums = _summed(rows.select("a", "b", "y"), run)
    if not len(sums):
        return 0.0, 0.0, np.zeros(len(weights))
    return sums[0], sums[1], sums[2:]


def fit(
    df: DataFrame, id_col: str, s1: str, s2: str, y: str, layers: tuple[Layer, ...], shape: str = "antisymmetric", *,
    epochs: int = 20, batches: int = 4, rate: float = 0.01, clip: float = 10.0, patience: int = 5, seed: int = 1,
) -> Model:
    """Trains by Adam on the RMSE of mini-batches; the weights of the best epoch on the held-out fold are kept.

    Gradients longer than ``clip`` are shortened; the fit ends after ``patience`` epochs without
    a better held-out RMSE, or where a gradient is not finite. The target is centred (not for an
    antisymmetric scorer, which cannot shift) and scaled by its own mean and deviation.
    """
    spark = df.sparkSession
    usable = df.where(F.col(y).isNotNull() & (F.size(s1) > 0) & (F.size(s2) > 0))
    about = usable.agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.max(F.size(s1)).alias("n")).first()
    if about.n is None:
        raise ValueError("no row to train on")
    centre = 0.0 if shape == "antisymmetric" else float(about["mean"])
    scale = float(about["std"] or 1.0)
    # the last fold is held out
    fold = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(batches + 1)).cast("int")
    path = folder(spark)
    wave = lambda c: F.col(c).cast("array<double>")
    usable.select(wave(s1).alias("a"), wave(s2).alias("b"), ((F.col(y).cast("double") - centre) / scale).alias("y"), fold.alias("fold")).write.partitionBy("fold").parquet(path)
    rows = spark.read.schema("a array<double>, b array<double>, y double, fold int").parquet(path)
    model = Model(tuple(layers), shape, int(about.n), np.zeros(0), centre, scale)
    w = model.scorer().start(seed)
    best, m, v, step = (np.inf, w), np.zeros(len(w)), np.zeros(len(w)), 0
    for epoch in range(epochs):
        for b in range(batches):
            n, sse, g = loss_sums(model, w, rows.where(F.col("fold") == b))
            if not n or not sse:
                continue
            g = g / (2 * n * np.sqrt(sse / n))  # of the RMSE
            if not np.isfinite(g).all():
                break
            g *= min(1.0, clip / max(float(np.linalg.norm(g)), 1e-300))
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        n, sse, _ = loss_sums(model, w, rows.where(F.col("fold") == batches))
        held = float(np.sqrt(sse / n)) if n else 0.0
        model.history.append((epoch, held * scale))
        if held < best[0]:
            best = (held, w)
        if len(model.history) - 1 - int(np.argmin([h for _, h in model.history])) >= patience or not n:
            break
    model.weights = best[1]
    return model


def predict(df: DataFrame, model: Model, id_col: str, s1: str, s2: str) -> DataFrame:
    """``id``, ``prediction``; null where a waveform is missing or empty."""

    def run(batches):
        scorer = model.scorer()
        for b, start, stop in _slices(batches):
            ids, some = b.column("id").slice(start, stop - start), b.column("some").slice(start, stop - start).to_numpy(zero_copy_only=False).astype(bool)
            out = np.full(len(some), np.nan)
            if some.any():
                kept = b.slice(start, stop - start).filter(pa.array(some))
                out[some] = model.centre + model.scale * sum(sign * scorer.forward(model.weights, x)[0] for sign, x in _inputs(model.shape, *_waves(kept, model.samples, 0, kept.num_rows)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, mask=~some)], names=["id", "prediction"])

    wave = lambda c: F.col(c).cast("array<double>")
    some = F.coalesce((F.size(s1) > 0) & (F.size(s2) > 0), F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), wave(s1).alias("a"), wave(s2).alias("b"), some.alias("some"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, prediction double")


def importance(df: DataFrame, model: Model, s1: str, s2: str) -> DataFrame:
    """Mean absolute gradient of the prediction by each sample, over events and detectors: ``sample``, ``importance``."""

    def run(batches):
        scorer, total = model.scorer(), np.zeros(1 + model.samples)
        for b, start, stop in _slices(batches):
            waves = _waves(b, model.samples, start, stop)
            total[0] += 2 * len(waves[0])
            for _, x in _inputs(model.shape, *waves):
                _, kept = scorer.forward(model.weights, x)
                _, g = scorer.backward(model.weights, kept, np.full(len(x), model.scale))
                total[1:] += np.abs(g).reshape(-1, model.samples).sum(axis=0)
        yield _entries(total)

    wave = lambda c: F.col(c).cast("array<double>")
    sums = _summed(df.where((F.size(s1) > 0) & (F.size(s2) > 0)).select(wave(s1).alias("a"), wave(s2).alias("b")), run)
    found = [(i, float(x / sums[0])) for i, x in enumerate(sums[1:])] if len(sums) else []
    return df.sparkSession.createDataFrame(found, "sample int, importance double")
