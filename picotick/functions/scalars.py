"""Scalar functions: units, names, numbers, hashes and angles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words read as true and as false.
TRUE_WORDS = ("true", "yes", "y", "1", "on")
FALSE_WORDS = ("false", "no", "n", "0", "off")
#: Words of selection columns beside or instead of the above.
SELECTED_WORDS = ("1", "true", "yes", "y", "pass", "passed", "selected", "keep", "accepted")
DROPPED_WORDS = ("0", "false", "no", "n", "fail", "failed", "rejected", "drop")
#: Characters with a meaning in LaTeX and what stands for them.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
SIDES = {"a": 0, "b": 1}
UNKNOWN = 255


def ns_to_ticks(ns: Column, tick_ps: Column) -> Column:
    """At least one tick, rounded up."""
    return F.greatest(F.lit(1), F.ceil(ns * 1000 / tick_ps)).cast("long")


def duration_limits(low_ns: Column, high_ns: Column, tick_ps: Column) -> tuple[Column, Column]:
    """Limits in ticks: the lower rounded up, the upper down."""
    return F.ceil(low_ns * 1000 / tick_ps).cast("long"), F.floor(high_ns * 1000 / tick_ps).cast("long")


def ticks_to_ps(ticks: Column, tick_ps: Column) -> Column:
    return ticks * tick_ps


def identifier(text: Column) -> Column:
    """Lower case, only letters and digits."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def path_part(text: Column) -> Column:
    """Safe as a folder name: other characters become one underscore."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")


def run_id(path: Column) -> Column:
    """Number of the run that a path names, without leading zeros."""
    return F.try_to_number(F.nullif(F.regexp_extract(path, r"(?i)run[_-]?0*(\d+)", 1), F.lit("")), F.lit("9" * 9)).cast("long")


def tri_state(text: Column, selection: bool = False) -> Column:
    """True, false or null, by word lists; with ``selection`` those of selection columns."""
    w = F.lower(F.trim(text))
    yes, no = (SELECTED_WORDS, DROPPED_WORDS) if selection else (TRUE_WORDS, FALSE_WORDS)
    return F.when(w.isin(*yes), True).when(w.isin(*no), False)


def number_token(x: Column) -> Column:
    """A number as part of a file name: shortest form, minus as m, point as p."""
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x.cast("double")), r"0+$", ""), r"\.$", "")
    return F.translate(plain, "-.", "mp")


def thousands(n: Column) -> Column:
    """Digits in threes, parted by thin spaces."""
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(r"\,"))


def plus_minus(x: Column, error: Column, digits: int) -> Column:
    return F.concat(F.format_number(x, digits), F.lit(r" $\pm$ "), F.format_number(error, digits))


def latex(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\x00"))
    for c, s in LATEX.items():
        if c != "\\":
            out = F.replace(out, F.lit(c), F.lit(s))
    return F.replace(out, F.lit("\x00"), F.lit(LATEX["\\"]))


def joined(values: Column) -> Column:
    """An aggregate: distinct values in order, parted by semicolons."""
    return F.concat_ws(";", F.array_sort(F.collect_set(values.cast("string"))))


def encode(name: Column, codes: dict[str, int] = SIDES) -> Column:
    out = F.lit(UNKNOWN)
    for k, v in codes.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out.cast("short")


def decode(code: Column, codes: dict[str, int] = SIDES) -> Column:
    out = F.lit("unknown")
    for k, v in codes.items():
        out = F.when(code == v, F.lit(k)).otherwise(out)
    return out


def canonical_hash(columns: list[str]) -> Column:
    """SHA-256 of the columns as JSON, keys in order; nulls stand as such."""
    parts = [F.concat(F.lit(f'"{c}":'), F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("null"))) for c in sorted(columns)]
    return F.sha2(F.concat_ws(",", *parts), 256)


def candidate_id(columns: list[str]) -> Column:
    return F.substring(canonical_hash(columns), 1, 12)


def file_signature(content: Column, ends: int = 65_536) -> Column:
    """Hash of a file's size and its first and last bytes."""
    n = F.octet_length(content)
    return F.sha2(F.concat(n.cast("string").cast("binary"), F.substring(content, 1, ends), F.substring(content, F.greatest(F.lit(1), n - ends + 1), ends)), 256)


def crossing(level: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Where the line through two points meets a level."""
    return x0 + F.try_divide(level - y0, y1 - y0) * (x1 - x0)


def gaussian(x: Column, a: Column, mu: Column, sigma: Column) -> Column:
    z = (x - mu) / sigma
    return a * F.exp(-0.5 * z * z)


def circular_mean(angle: Column) -> Column:
    """An aggregate: mean direction."""
    return F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle)))


def resultant(angle: Column) -> Column:
    """An aggregate: length of the mean direction, 1 if all agree."""
    return F.hypot(F.avg(F.sin(angle)), F.avg(F.cos(angle)))


def wrapped(angle: Column) -> Column:
    """The same direction in (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))
