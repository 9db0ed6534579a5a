"""Waveform kernels over array columns, with built-in higher-order functions only.

Samples are arrays of doubles; places in them count from 0. Null in, null out. What a waveform
does not have (a crossing, a peak, enough samples) is null, not an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def mean(x: Column) -> Column:
    return F.try_divide(total(x), F.size(x))


def calibrate(raw: Column, gain: Column, offset: Column, polarity: Column | int = 1) -> Column:
    """ADC counts to millivolts: polarity * ((raw * gain - offset) * 1000)."""
    p = F.lit(polarity) if isinstance(polarity, int) else polarity
    return F.transform(raw, lambda v: p * ((v * gain - offset) * 1000.0))


def window(x: Column, start: Column, stop: Column) -> Column:
    """Samples start..stop (both included), cut at the ends of the array."""
    lo = F.greatest(F.lit(0), start)
    return F.slice(x, lo + 1, F.greatest(F.lit(0), F.least(stop, F.size(x) - 1) - lo + 1))


def finite_mean(x: Column) -> Column:
    return let(F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), mean)


def rms(x: Column) -> Column:
    """Root mean square about the mean; null for fewer than two samples."""
    return F.when(F.size(x) >= 2, let(mean(x), lambda m: F.sqrt(mean(F.transform(x, lambda v: (v - m) * (v - m))))))


def clipped(x: Column, low: Column, high: Column, margin: float) -> Column:
    """True if a sample comes within ``margin`` of a limit; the smallest clearance decides."""
    return F.least(F.array_min(x) - low, high - F.array_max(x)) <= margin


def peak_index(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.array_position(x, F.array_max(x)).cast("int") - 1)


def first_position(x: Column, holds) -> Column:
    """Place of the first sample for which ``holds`` is true, null if there is none."""
    return F.array_min(F.filter(F.transform(x, lambda v, i: F.when(holds(v), i)), lambda i: i.isNotNull()))


def last_position(x: Column, holds) -> Column:
    return F.array_max(F.filter(F.transform(x, lambda v, i: F.when(holds(v), i)), lambda i: i.isNotNull()))


def baseline_quality(x: Column, low: Column, high: Column, margin: float) -> Column:
    """Struct (rms, clipped, clearance): the least distance to a limit, and whether it is within the margin.

    Fewer than two samples have neither rms nor clearance and are not clipped.
    """
    clearance = F.when(F.size(x) >= 2, F.least(F.array_min(x) - low, high - F.array_max(x)))
    return F.struct(rms(x).alias("rms"), F.coalesce(clearance <= margin, F.lit(False)).alias("clipped"), clearance.alias("clearance"))


def _between(level: Column, y0: Column, y1: Column) -> Column:
    return F.try_divide(level - y0, y1 - y0)


def last_crossing(x: Column, level: Column, start: Column, stop: Column) -> Column:
    """Place of the last strict upward crossing in [start, stop], interpolated.

    Without a strict crossing (y[i] < level <= y[i+1] with y[i+1] > y[i]) the last sample that
    equals the level counts.
    """
    lo, hi = F.greatest(F.lit(0), start), F.least(stop, F.size(x) - 1)
    steps = F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))
    strict = F.filter(steps, lambda i: (F.get(x, i) < level) & (F.get(x, i + 1) >= level))
    equal = F.filter(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>")), lambda i: F.get(x, i) == level)
    return F.coalesce(
        let(F.element_at(strict, F.when(F.size(strict) > 0, F.lit(-1))), lambda i: i + _between(level, F.get(x, i), F.get(x, i + 1))),
        F.element_at(equal, F.when(F.size(equal) > 0, F.lit(-1))).cast("double"),
    )


def first_crossing(x: Column, level: Column) -> Column:
    """Place of the first upward crossing, interpolated."""
    steps = F.when(F.size(x) > 1, F.sequence(F.lit(0), F.size(x) - 2)).otherwise(F.array().cast("array<int>"))
    up = F.filter(steps, lambda i: (F.get(x, i) < level) & (F.get(x, i + 1) >= level))
    return let(F.get(up, F.lit(0)), lambda i: i + _between(level, F.get(x, i), F.get(x, i + 1)))


def fraction_crossing(x: Column, fraction: Column, start: Column) -> Column:
    """Constant-fraction time: the crossing of ``fraction`` of the peak between start and the peak."""
    return F.when((fraction > 0) & (fraction <= 1), last_crossing(x, fraction * F.array_max(x), start, peak_index(x)))


def pulses(x: Column, level: Column) -> Column:
    """Structs (rise, fall) of the pulses over a level: each rise with the next fall before the next rise."""
    steps = F.when(F.size(x) > 1, F.sequence(F.lit(0), F.size(x) - 2)).otherwise(F.array().cast("array<int>"))
    up = F.filter(steps, lambda i: (F.get(x, i) < level) & (F.get(x, i + 1) >= level))
    down = F.filter(steps, lambda i: (F.get(x, i) >= level) & (F.get(x, i + 1) < level))
    at = lambda i: i + _between(level, F.get(x, i), F.get(x, i + 1))
    return F.transform(up, lambda i: F.struct(at(i).alias("rise"), let(F.get(F.filter(down, lambda j: j > i), F.lit(0)), at).alias("fall")))


def first_difference(x: Column) -> Column:
    return F.transform(x, lambda v, i: F.when(i == 0, F.lit(0.0)).otherwise(v - F.get(x, i - 1)))


def detrended(x: Column) -> Column:
    """x minus its least-squares line over an even grid on [-1, 1]."""
    n = F.size(x)
    at = lambda i: F.when(n > 1, -1 + 2.0 * i / (n - 1)).otherwise(F.lit(0.0))
    slope = F.try_divide(total(F.transform(x, lambda v, i: v * at(i))), total(F.transform(x, lambda v, i: at(i) * at(i))))
    return let(F.struct(mean(x).alias("m"), F.coalesce(slope, F.lit(0.0)).alias("s")), lambda c: F.transform(x, lambda v, i: v - c["m"] - c["s"] * at(i)))


def hann(n: int) -> list[float]:
    import math

    return [0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1)) for i in range(n)]


def projection(x: Column, cycles_per_sample: float, n: int) -> Column:
    """Amplitude (re, im) of one frequency: 2 / sum(w) * sum of Hann-weighted, detrended samples times e^-iwt."""
    import math

    w = hann(n)
    scale = 2 / sum(w)
    turn = [2 * math.pi * cycles_per_sample * i for i in range(n)]
    kernel = lambda f, s: F.array(*[F.lit(s * scale * wi * f(t)) for wi, t in zip(w, turn, strict=True)])
    return let(detrended(x), lambda d: F.struct(
        total(F.zip_with(d, kernel(math.cos, 1), lambda a, b: a * b)).alias("re"), total(F.zip_with(d, kernel(math.sin, -1), lambda a, b: a * b)).alias("im")))


def normalised(x: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low), clipped to [0, 1]."""
    return F.transform(x, lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(v - low, high - low))))


def denormalised(x: Column, low: Column, high: Column) -> Column:
    return F.transform(x, lambda v: v * (high - low) + low)


def peak_normalised(x: Column) -> Column:
    """x over its peak; a peak that is not positive raises."""
    top = F.when(F.array_max(x) > 0, F.array_max(x)).otherwise(F.raise_error(F.lit("the peak is not positive")).cast("double"))
    return let(top, lambda p: F.transform(x, lambda v: v / p))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda u, v: u - v)


def edges_of(centres: Column) -> Column:
    """Cell edges: midpoints, the outer ones extrapolated by half a step (two centres at least)."""
    n = F.size(centres)
    mids = F.zip_with(F.slice(centres, 1, n - 1), F.slice(centres, 2, n - 1), lambda a, b: (a + b) / 2)
    first = F.get(centres, F.lit(0)) - (F.get(centres, F.lit(1)) - F.get(centres, F.lit(0))) / 2
    last = F.element_at(centres, -1) + (F.element_at(centres, -1) - F.element_at(centres, -2)) / 2
    return F.concat(F.array(first), mids, F.array(last))


def cosine_fade(n: int) -> Column:
    """Weights from 0 to 1 along a raised cosine."""
    import math

    return F.array(*[F.lit(0.5 - 0.5 * math.cos(math.pi * i / max(1, n - 1))) for i in range(n)])


def quartic_bump(n: int) -> Column:
    """Weights 16 u^2 (1 - u)^2 over n samples."""
    us = [i / max(1, n - 1) for i in range(n)]
    return F.array(*[F.lit(16 * u * u * (1 - u) ** 2) for u in us])


def rising_crossing(x: Column, level: Column) -> Column:
    """Place of the last strict upward crossing before the first highest sample, interpolated.

    Without one, the last sample there that equals the level and is followed by a higher one.
    """
    steps = let(peak_index(x), lambda top: F.when(top > 0, F.sequence(F.lit(0), top - 1)).otherwise(F.array().cast("array<int>")))
    strict = F.filter(steps, lambda i: (F.get(x, i) < level) & (F.get(x, i + 1) >= level))
    equal = F.filter(steps, lambda i: (F.get(x, i) == level) & (F.get(x, i + 1) > level))
    return F.coalesce(let(F.array_max(strict), lambda i: i + _between(level, F.get(x, i), F.get(x, i + 1))), F.array_max(equal).cast("double"))


def pickoff_line(x: Column, levels: list[float]) -> Column:
    """Multi-threshold pickoff: least-squares t(V) through the last upward crossings before the peak.

    Struct (t0, slope), null if a crossing is missing, times do not rise, the slope is not
    positive, or the line at zero is not before the first crossing.
    """
    times = F.array(*[rising_crossing(x, F.lit(v)) for v in levels])
    n, sv, svv = len(levels), sum(levels), sum(v * v for v in levels)

    def line(t: Column) -> Column:
        st, svt = total(t), total(F.zip_with(t, F.array(*[F.lit(v) for v in levels]), lambda a, b: a * b))
        slope = (n * svt - sv * st) / (n * svv - sv * sv)
        start = (st - slope * sv) / n
        rises = F.forall(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.get(t, i) > F.get(t, i - 1))
        return F.when(rises & (slope > 0) & (start < F.get(t, F.lit(0))), F.struct(start.alias("t0"), slope.alias("slope")))

    return let(times, lambda t: F.when(~F.exists(t, lambda v: v.isNull()), line(t)))


def interpolated(x: Column, gap_start: Column, gap_stop: Column) -> Column:
    """Samples gap_start..gap_stop (included) drawn as a line between their neighbours; at an edge, constant."""
    left = F.coalesce(F.get(x, F.when(gap_start > 0, gap_start - 1)), F.get(x, gap_stop + 1))
    right = F.coalesce(F.get(x, gap_stop + 1), left)
    span = gap_stop - gap_start + 2
    return let(F.struct(left.alias("l"), right.alias("r")), lambda e: F.transform(
        x, lambda v, i: F.when((i >= gap_start) & (i <= gap_stop), e["l"] + (e["r"] - e["l"]) * (i - gap_start + 1) / span).otherwise(v)))


def hermite(x: Column, gap_start: Column, gap_stop: Column) -> Column:
    """Like ``interpolated`` with a cubic that keeps the slopes of the two samples on each side."""
    a, b = gap_start - 1, gap_stop + 1
    p0, p1 = F.get(x, a), F.get(x, b)
    span = (b - a).cast("double")
    m0, m1 = (p0 - F.get(x, a - 1)) * span, (F.get(x, b + 1) - p1) * span
    ends = F.struct(p0.alias("p0"), p1.alias("p1"), m0.alias("m0"), m1.alias("m1"))

    def value(e: Column, i: Column) -> Column:
        t = (i - a) / span
        return (2 * t * t * t - 3 * t * t + 1) * e["p0"] + (t * t * t - 2 * t * t + t) * e["m0"] + (3 * t * t - 2 * t * t * t) * e["p1"] + (t * t * t - t * t) * e["m1"]

    inside = (a >= 1) & (b + 1 < F.size(x))
    return F.when(inside, let(ends, lambda e: F.transform(x, lambda v, i: F.when((i > a) & (i < b), value(e, i)).otherwise(v)))).otherwise(interpolated(x, gap_start, gap_stop))


def anchor_sample(x: Column, crossing: Column, start: Column, stop: Column) -> Column:
    """The sample next to a crossing, within [start, stop]: of its two neighbours the nearer one, the earlier of ties."""
    low = F.floor(crossing).cast("int")
    near = F.when(crossing - low <= low + 1 - crossing, low).otherwise(low + 1)
    return F.when(F.size(x) > 0, F.greatest(start, F.least(stop, near)))


def materialised(x: Column, trigger: Column, before: float, after: float, dt: float) -> Column:
    """Samples from ``before`` to ``after`` time units around a trigger sample, null where they are not all there.

    Struct (start, samples, peak): the place of the first sample, the samples, and the highest one among them.
    """
    import math

    lo, hi = trigger - math.ceil(before / dt), trigger + math.ceil(after / dt)
    cut = F.slice(x, F.greatest(lo, F.lit(0)) + 1, F.greatest(hi - lo + 1, F.lit(0)))
    return F.when((lo >= 0) & (hi < F.size(x)), let(cut, lambda c: F.struct(lo.alias("start"), c.alias("samples"), peak_index(c).alias("peak"))))


def masked(mask: Column, value: Column) -> Column:
    """``value``, worked out only where the mask holds, else null."""
    return F.when(mask, value)


def faded_region(x: Column, y: Column, start: int, stop: int, fade: int) -> Column:
    """x with samples start..stop of y, faded in and out over ``fade`` samples; outside, x to the last bit."""
    import math

    def weight(i: Column) -> Column:
        edge = F.least(i - start + 1, F.lit(stop + 1) - i)
        return F.when(edge > fade, F.lit(1.0)).otherwise(0.5 - 0.5 * F.cos(edge / F.lit(fade + 1.0) * math.pi))

    return F.zip_with(F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), y, lambda a, b: F.when(
        (a["i"] < start) | (a["i"] > stop), a["v"]).otherwise(a["v"] + weight(a["i"]) * (b - a["v"])))


def time_slice(x: Column, first_time: float, step: float, low: float, high: float, tolerance: float = 1e-6) -> Column:
    """Samples whose time lies in [low, high], widened by a tolerance against rounding."""
    import math

    lo = max(0, math.ceil((low - tolerance - first_time) / step))
    hi = math.floor((high + tolerance - first_time) / step)
    return F.slice(x, lo + 1, max(0, hi - lo + 1))
