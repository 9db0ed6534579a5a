"""Zero-phase recursive filters and phase rotation of waveforms.

A low-pass is a cascade of second-order Butterworth sections, run forwards and backwards over
the waveform extended by odd reflection, each section started in the steady state of its first
sample. Filtered or rotated samples can be limited to a region: changes fade out along a raised
cosine, and samples outside come back as they were, to the last bit.

Rows are filtered where they lie, waveforms of one length together; null and empty waveforms
come back as they are, and non-finite samples make the waveform's result null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def butterworth(order: int, cutoff: float) -> np.ndarray:
    """Sections [b0, b1, b2, 1, a1, a2] of a low-pass; ``cutoff`` in cycles per sample, below one half."""
    if order < 1 or not 0 < cutoff < 0.5:
        raise ValueError(f"order {order}, cutoff {cutoff}")
    warped = 2 * np.tan(np.pi * cutoff)  # of the bilinear transform with unit sampling rate
    out = []
    for k in range((order + 1) // 2):
        angle = np.pi * (2 * k + 1 + order) / (2 * order)
        if order % 2 and k == order // 2:
            pole = (2 - warped) / (2 + warped)
            gain = (1 - pole) / 2
            out.append([gain, gain, 0, 1, -pole, 0])
        else:
            s = warped * np.exp(1j * angle)
            pole = (2 + s) / (2 - s)
            a1, a2 = -2 * pole.real, abs(pole) ** 2
            gain = (1 + a1 + a2) / 4
            out.append([gain, 2 * gain, gain, 1, a1, a2])
    return np.array(out)


def _run(section: np.ndarray, v: np.ndarray) -> np.ndarray:
    """One section over each row, from the steady state of the row's first sample."""
    b0, b1, b2, _, a1, a2 = section
    gain = (b0 + b1 + b2) / (1 + a1 + a2)
    z2 = (b2 - a2 * gain) * v[:, 0]
    z1 = (b1 - a1 * gain) * v[:, 0] + z2
    out = np.empty_like(v)
    for t in range(v.shape[1]):
        x = v[:, t]
        y = b0 * x + z1
        z1, z2 = b1 * x - a1 * y + z2, b2 * x - a2 * y
        out[:, t] = y
    return out


def zero_phase(v: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """Rows filtered forwards and backwards."""
    taps = 2 * len(sections) + 1 - int(min((sections[:, 2] == 0).sum(), (sections[:, 5] == 0).sum()))
    pad = min(3 * taps, v.shape[1] - 1)
    w = np.concatenate([2 * v[:, :1] - v[:, pad:0:-1], v, 2 * v[:, -1:] - v[:, -2 : -pad - 2 : -1]], axis=1) if pad else v.copy()
    for _ in range(2):
        for s in sections:
            w = _run(s, w)
        w = w[:, ::-1]
    return np.ascontiguousarray(w[:, pad : pad + v.shape[1]])


@dataclass(frozen=True)
class Region:
    """Samples before ``baseline_end`` and from ``tail_start`` on, each faded in over ``fade`` samples; None leaves a part out."""

    baseline_end: int | None = None
    tail_start: int | None = None
    fade: int = 0

    def parts(self, n: int) -> list[np.ndarray]:
        """Weights of each part: 1 away from the edge, 0 from the edge on."""
        i, out = np.arange(n), []
        for inside in ([] if self.baseline_end is None else [self.baseline_end - i], [] if self.tail_start is None else [i - self.tail_start + 1]):
            for d in inside:
                out.append(np.where(d <= 0, 0.0, np.where(d > self.fade, 1.0, 0.5 - 0.5 * np.cos(np.pi * d / (self.fade + 1)))))
        return out


def _each(df: DataFrame, id_col: str, x: str, change: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """``id`` and the changed waveforms; rows of one length go through ``change`` together."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                rows = b.column("x").to_pylist()
                out: list = [None if r is None else r for r in rows]
                lengths: dict[int, list[int]] = {}
                for i, r in enumerate(rows):
                    if r:
                        lengths.setdefault(len(r), []).append(i)
                for places in lengths.values():
                    v = np.array([rows[i] for i in places], dtype=np.float64)  # a null sample is not a number
                    good = np.isfinite(v).all(axis=1)
                    changed = np.empty_like(v)
                    if good.any():
                        changed[good] = change(v[good])
                    for i, ok, w in zip(places, good, changed, strict=True):
                        out[i] = w if ok else None
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.float64()))], names=["id", name])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(x).cast("array<double>").alias("x"))
    return rows.mapInArrow(run, f"id long, {name} array<double>")


def _blended(v: np.ndarray, new: np.ndarray, region: Region | None) -> np.ndarray:
    if region is None:
        return new
    weight = sum(region.parts(v.shape[1]), np.zeros(v.shape[1]))
    return np.where(weight > 0, v + weight * (new - v), v)


def lowpass(df: DataFrame, id_col: str, x: str, cutoff: float, order: int = 4, region: Region | None = None) -> DataFrame:
    """``id``, ``filtered``: zero-phase Butterworth low-pass of each waveform, ``cutoff`` in cycles per sample."""
    sections = butterworth(order, cutoff)
    return _each(df, id_col, x, lambda v: _blended(v, zero_phase(v, sections), region), "filtered")


def rotated(df: DataFrame, id_col: str, x: str, frequency: float, degrees: float, region: Region) -> DataFrame:
    """``id``, ``rotated``: the oscillation of one frequency (cycles per sample) turned in phase, in each part of the region on its own.

    A part's amplitude and phase are those of a least-squares sinusoid with a line; the line stays.
    Parts of fewer than 16 samples or 1.5 periods raise.
    """
    if not 0 < frequency < 0.5:
        raise ValueError(f"frequency {frequency}")
    turn = np.deg2rad(degrees)

    def change(v: np.ndarray) -> np.ndarray:
        t, out = np.arange(v.shape[1], dtype=np.float64), v.copy()
        for weight in region.parts(v.shape[1]):
            own = weight > 0
            if own.sum() < 16 or np.ptp(t[own]) * frequency < 1.5:
                raise ValueError(f"{own.sum()} samples are too few for a phase")
            angle = 2 * np.pi * frequency * t
            a = np.column_stack([np.ones(own.sum()), t[own] - t[own].mean(), np.cos(angle[own]), np.sin(angle[own])])
            _, _, c, s = np.linalg.lstsq(a, v[:, own].T, rcond=None)[0]
            size, phase = np.hypot(c, s)[:, None], np.arctan2(-s, c)[:, None]
            new = v + weight * size * (np.cos(angle + phase + turn) - np.cos(angle + phase))
            out = np.where(own, new, out)
        return out

    return _each(df, id_col, x, change, "rotated")
