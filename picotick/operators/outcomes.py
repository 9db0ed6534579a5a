"""Outcomes of matching: which side of an event failed, compact rows and back.

A match has two sides, ``a`` and ``b``. ``settled`` makes an event's outcome of its sides: one side
that lacks a candidate or lies too far off takes the other with it. ``compact`` is one narrow row
an event, statuses as codes; ``expanded`` gives the long rows back.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes of the statuses.
STATUSES = {
    "accepted": 0, "no_timing_candidate": 1, "no_overlapping_timing_pair": 2, "deviation_too_large": 3, "missing_energy_pulse": 4, "write_failed": 5,
    "other_side_missing_candidate": 6, "other_side_deviation_too_large": 7, "unknown": 255,
}
SIDES = ("a", "b")
#: What a side carries into the compact row, under its name with the side's.
FIELDS = ("duration", "average_delay", "selected_delay", "baseline_delay", "deviation")


def code_of(status: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for x in chain.from_iterable(STATUSES.items())])
    return F.coalesce(F.try_element_at(codes, status), F.lit(STATUSES["unknown"])).cast("short")


def status_of(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable((v, k) for k, v in STATUSES.items())])
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.lit("unknown"))


def settled(sides: DataFrame, event: str, most: float) -> DataFrame:
    """Rows (event, ``side``, ``deviation``, others) with ``status`` and ``accepted``, by both sides of the event.

    A side without a deviation has no candidate, one beyond ``most`` deviates too much; the other
    side, if it is good itself, is told so. An event of one side is not accepted: its other one is
    missing. Repeated sides raise.
    """
    own = F.when(F.col("deviation").isNull(), "no_timing_candidate").when(F.abs("deviation") > most, "deviation_too_large").otherwise("accepted")
    judged = sides.withColumn("_own", own)
    both = judged.groupBy(event).agg(*[F.max(F.when(F.col("side") == s, F.col("_own"))).alias(f"_{s}") for s in SIDES], F.count("*").alias("_n"), F.count_distinct("side").alias("_d"))
    both = both.where(F.when(F.col("_n") == F.col("_d"), True).otherwise(F.raise_error(F.lit("a side of an event comes twice")).cast("boolean")))
    other = F.when(F.col("side") == "a", F.col("_b")).otherwise(F.col("_a"))
    told = F.when(F.col("_own") != "accepted", F.col("_own")).when(other.isNull() | (other == "no_timing_candidate"), "other_side_missing_candidate").when(
        other == "deviation_too_large", "other_side_deviation_too_large").otherwise("accepted")
    met = judged.join(both.select(event, "_a", "_b"), event).withColumn("status", told)
    return met.withColumn("accepted", F.col("status") == "accepted").drop("_own", "_a", "_b")


def compact(rows: DataFrame, event: str) -> DataFrame:
    """One row an event: the FIELDS of both sides, ``candidate_count``, ``candidate_changed`` and ``status_code``.

    An event is accepted if both its sides are; otherwise the code is that of the first side (a
    before b) that is not, or unknown if only accepted sides are there.
    """
    of = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    failed = F.min_by(F.when(F.col("status") != "accepted", F.col("status")), F.when(F.col("status") != "accepted", F.col("side")))
    found = rows.groupBy(event).agg(
        *[of(f, s).cast("double").alias(f"{f}_{s}") for f in FIELDS for s in SIDES], F.max("candidate_count").cast("int").alias("candidate_count"),
        F.max(F.coalesce(F.col("candidate_changed"), F.lit(False))).alias("candidate_changed"),
        F.count_if(F.col("status") == "accepted").alias("_good"), F.count_distinct("side").alias("_sides"), failed.alias("_failed"))
    status = F.when((F.col("_good") == 2) & (F.col("_sides") == 2), "accepted").otherwise(F.coalesce("_failed", F.lit("unknown")))
    return found.withColumn("status_code", code_of(status)).drop("_good", "_sides", "_failed")


def expanded(rows: DataFrame, event: str) -> DataFrame:
    """Two rows an event from ``compact``: ``side``, FIELDS, counts, ``status`` and ``accepted``, which are the event's."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), *[F.col(f"{f}_{s}").alias(f) for f in FIELDS]) for s in SIDES])).alias("_s")
    long = rows.select(event, "candidate_count", "candidate_changed", "status_code", each).select(event, "_s.*", "candidate_count", "candidate_changed", "status_code")
    return long.withColumn("status", status_of(F.col("status_code"))).withColumn("accepted", F.col("status_code") == 0)


def summary(rows: DataFrame) -> DataFrame:
    """Of compact rows: events, accepted, rejected and changed ones, and mean deviations of the accepted."""
    good = F.col("status_code") == 0
    return rows.agg(
        F.count("*").alias("events"), F.count_if(good).alias("accepted_events"), F.count_if(~good).alias("rejected_events"), F.count_if(F.col("candidate_changed")).alias("changed_events"),
        *[F.avg(F.when(good, F.col(f"deviation_{s}"))).alias(f"mean_deviation_{s}") for s in SIDES])
