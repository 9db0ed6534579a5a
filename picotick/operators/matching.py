"""Matching of hits, pulses and intervals.

Range joins add equi-keys: time is cut into buckets as wide as the window, a probe looks into
its own bucket and the neighbour, and the range condition removes the rest, so no nested loop
and no cross join is planned. Greedy one-to-one matchers are walks over cells of time (``walks``), so a
busy key is never one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import walks
from .scratch import stored


def segments(df: DataFrame, keys: list[str], time: str, reach: int) -> DataFrame:
    """Adds ``segment``: the first time of a stretch without gaps over ``reach``.

    Times fall into buckets as wide as the reach, inside which no gap can be longer, so gaps
    are found on one row (first and last time) for each bucket: a busy key is never one task.
    """
    cells = df.withColumn("_cell", F.floor(F.col(time) / reach))
    spans = cells.groupBy(*keys, "_cell").agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
    w = Window.partitionBy(*keys).orderBy("_cell")
    fresh = F.coalesce(F.col("_first") - F.lag("_last").over(w) > reach, F.lit(True))
    named = spans.withColumn("_fresh", fresh).select(*keys, "_cell", F.max(F.when(F.col("_fresh"), F.col("_first"))).over(w).alias("segment"))
    return _by_keys(cells, named, [*keys, "_cell"]).drop("_cell")


def _by_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys, null keys included."""
    other = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(other, reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"_k_{k}"]) for k in keys])).drop(*[f"_k_{k}" for k in keys])


def window_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, window: int, low: int = 0) -> DataFrame:
    """Pairs with ``left - window < right < left - low`` (both open) and equal keys.

    Right columns must not clash with left ones apart from the keys.
    """
    span = max(1, window - low)
    start = F.floor((F.col(left_time) - window) / span).cast("long")
    probes = left.withColumn("_bucket", F.explode(F.array(start, start + 1, start + 2)))
    targets = right.withColumn("_bucket", F.floor(F.col(right_time) / span).cast("long"))
    met = probes.join(targets, [*keys, "_bucket"]).drop("_bucket")
    return met.where((F.col(right_time) > F.col(left_time) - window) & (F.col(right_time) < F.col(left_time) - low))


def _beside(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, window: int, marks: list[tuple[Column, int]]) -> tuple[DataFrame, Column, list[Column]]:
    """Right times and marks beside each distinct left time in cells of time, and the order in a cell.

    A mark is (time, 0 or 2: before or behind right times equal to it). Equal times are one row and their number, ``_c`` or ``_m``.
    """
    cell = lambda c: F.floor(F.col(c) / (8 * window)).cast("long") if isinstance(c, str) else F.floor(c / (8 * window)).cast("long")
    told = lambda df, time: df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, time]])).groupBy(*keys, F.col(time).cast("long").alias("_own"))
    times = told(right, right_time).agg(F.count("*").alias("_c")).withColumn("_cell", F.explode(F.sequence(cell("_own"), cell(F.col("_own") + window))))
    times = times.select(*keys, "_cell", F.col("_own").alias("_at"), F.lit(1).alias("_ord"), "_c", F.col("_own").alias("_t"), F.lit(None).cast("long").alias("_own"), F.lit(None).cast("long").alias("_m"))
    each = F.explode(F.array(*[F.struct(at.cast("long").alias("at"), F.lit(o).alias("o")) for at, o in marks])).alias("_k")
    own = told(left, left_time).agg(F.count("*").alias("_m")).select("*", cell("_own").alias("_cell"), each)
    own = own.select(*keys, "_cell", F.col("_k.at").alias("_at"), F.col("_k.o").alias("_ord"), F.lit(0).cast("long").alias("_c"), F.lit(None).cast("long").alias("_t"), "_own", "_m")
    return times.unionByName(own), Window.partitionBy(*keys, "_cell"), ["_at", "_ord"]


def window_counts(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, window: int) -> DataFrame:
    """What ``window_join`` pairs, counted and not made: a row for each left time that has any.

    Keys, the left time, ``pairs`` (rows of equal times each) and ``latest``, the last right time in the window. Work grows with the
    rows, however many pairs they have.
    """
    rows, by, order = _beside(left, right, keys, left_time, right_time, window, [(F.col("_own"), 0), (F.col("_own") - window, 2)])
    upto = by.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("_n", F.sum("_c").over(upto)).withColumn("_last", F.last("_t", ignorenulls=True).over(upto)).where("_own is not null")
    end, start = F.col("_ord") == 0, F.col("_ord") == 2
    found = seen.groupBy(*keys, "_cell", "_own").agg(F.max("_m").alias("_m"), (F.max(F.when(end, F.col("_n"))) - F.max(F.when(start, F.col("_n")))).alias("_n"), F.max(F.when(end, F.col("_last"))).alias("latest"))
    return found.where("_n > 0").select(*keys, F.col("_own").alias(left_time), (F.col("_m") * F.col("_n")).alias("pairs"), "latest")


def nearest_in_window(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, window: int, delay: Column) -> DataFrame:
    """For each left time the right time of its window whose distance is nearest to ``delay``, of equally near ones the latest (with a null delay: the latest).

    What ``nearest_candidate`` finds among the pairs of ``window_join``, without making them.
    """
    at = F.least(F.col("_own") - 1, F.coalesce(F.col("_own") - F.ceil(delay), F.col("_own") - 1))
    rows, by, order = _beside(left, right, keys, left_time, right_time, window, [(at, 2)])
    so_far = (Window.unboundedPreceding, Window.currentRow)
    before, after = by.orderBy(*order).rowsBetween(*so_far), by.orderBy(*[F.col(c).desc() for c in order]).rowsBetween(*so_far)
    seen = rows.withColumn("_lo", F.last("_t", ignorenulls=True).over(before)).withColumn("_hi", F.last("_t", ignorenulls=True).over(after)).where("_own is not null")
    lo, hi = F.when(F.col("_lo") > F.col("_own") - window, F.col("_lo")), F.when(F.col("_hi") < F.col("_own"), F.col("_hi"))
    off = lambda t: F.abs(F.col("_own") - t - delay)
    nearest = F.when(hi.isNull() | (off(lo) < off(hi)), lo).otherwise(hi)
    return seen.select(*keys, F.col("_own").alias(left_time), nearest.alias(right_time)).where(F.col(right_time).isNotNull())


def both_sides(energy: DataFrame, timing: DataFrame, keys: list[str], energies: tuple[str, str], timings: tuple[str, str], window: int) -> DataFrame:
    """Energy pairs with the timing pairs that precede them by less than ``window`` on both sides."""
    met = window_join(energy, timing, keys, energies[0], timings[0], window)
    delay = F.col(energies[1]) - F.col(timings[1])
    return met.where((delay > 0) & (delay < window))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], bucket: int) -> DataFrame:
    """Pairs of closed intervals that overlap, each once, by buckets of ``bucket`` time units."""
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))
    l = left.withColumn("_cell", F.explode(cells(*a)))  # noqa: E741
    r = right.withColumn("_cell", F.explode(cells(*b)))
    met = l.join(r, [*keys, "_cell"]).where((F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1])))
    # a pair meets in every common cell; it counts in the one where the later of the two begins
    return met.where(F.col("_cell") == F.floor(F.greatest(a[0], b[0]) / bucket)).drop("_cell")


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, window: int, left_id: str) -> DataFrame:
    """As-of join: the latest right row inside the preceding window, or nulls."""
    cols = [c for c in right.columns if c not in keys]
    best = window_join(left.select(left_id, *keys, left_time), right, keys, left_time, right_time, window).groupBy(left_id).agg(F.max_by(F.struct(*cols), F.struct(right_time)).alias("_r"))
    return left.join(best, left_id, "left").select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in cols])


def nearest_candidate(candidates: DataFrame, by: list[str], time: str, deviation: Column) -> DataFrame:
    """The candidate with the smallest deviation per event; of equal ones the latest."""
    order = Window.partitionBy(*by).orderBy(F.abs(deviation), F.col(time).desc())
    return candidates.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def one_lead_one_trail(hits: DataFrame, keys: list[str], is_lead: Column, is_trail: Column, time: str) -> DataFrame:
    """Pulses of events with exactly one lead and one trail, the trail later: ``lead``, ``trail``, ``duration``."""
    found = hits.groupBy(*keys).agg(
        F.count_if(is_lead).alias("_leads"), F.count_if(is_trail).alias("_trails"), F.min(F.when(is_lead, F.col(time))).alias("lead"), F.min(F.when(is_trail, F.col(time))).alias("trail"))
    return found.where("_leads = 1 and _trails = 1 and trail > lead").select(*keys, "lead", "trail", (F.col("trail") - F.col("lead")).alias("duration"))


def pair_edges(hits: DataFrame, keys: list[str], is_lead: Column, is_trail: Column, time: str, span: int = 86_400_000_000) -> DataFrame:
    """Each lead takes the next unused later trail, in time order: ``lead``, ``trail`` per pair.

    The open leads are a queue, so the m-th trail that finds one open closes the m-th lead. With
    +1 for a lead and -1 for a trail, a trail finds none open where the running sum falls to a
    new minimum below zero. Sums and minima are taken inside cells of ``span`` time units and
    carried over from cell to cell, one row each, so a busy key is never one task. Leads at the
    trail's own time are not before it.
    """
    cell = F.floor(F.col(time) / span)
    edges = hits.where(is_lead | is_trail).select(*keys, F.col(time).alias("_t"), is_lead.alias("_lead"), cell.alias("_cell"))
    here = Window.partitionBy(*keys, "_cell").orderBy("_t", "_lead").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = edges.withColumn("_s", F.sum(F.when(F.col("_lead"), 1).otherwise(-1)).over(here)).withColumn("_leads", F.sum(F.col("_lead").cast("long")).over(here))
    edges = edges.withColumn("_low", F.min("_s").over(here)).withColumn("_n", F.count("*").over(here))
    cells = edges.groupBy(*keys, "_cell").agg(F.max("_n").alias("n"), F.max("_leads").alias("leads"), F.min("_s").alias("low"))
    cells = cells.withColumn("sum", 2 * F.col("leads") - F.col("n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    cells = cells.withColumn("_s0", zero(F.sum("sum").over(before))).withColumn("_leads0", zero(F.sum("leads").over(before))).withColumn("_n0", zero(F.sum("n").over(before)))
    cells = cells.withColumn("_lowest", F.col("_s0") + F.col("low")).withColumn("_low0", F.least(F.lit(0), zero(F.min("_lowest").over(before))))
    e = _by_keys(edges, cells.select(*keys, "_cell", "_s0", "_leads0", "_n0", "_low0"), [*keys, "_cell"])
    low = F.least("_low0", F.col("_s0") + F.col("_low"))
    e = e.withColumn("_missed", -low).withColumn("_leads", F.col("_leads0") + F.col("_leads")).withColumn("_sum", F.col("_s0") + F.col("_s"))
    trails = F.col("_n0") + F.col("_n") - F.col("_leads")
    # a trail that lowers the minimum finds no lead: then the sum is the minimum, and was above it before
    earlier = F.lag("_missed").over(Window.partitionBy(*keys, "_cell").orderBy("_t", "_lead"))
    e = e.withColumn("_found", F.col("_missed") == F.coalesce(earlier, -F.col("_low0")))
    leads = e.where("_lead").select(*keys, F.col("_leads").alias("_m"), F.col("_t").alias("lead"))
    closing = e.where(~F.col("_lead") & F.col("_found")).select(*keys, (trails - F.col("_missed")).alias("_m"), F.col("_t").alias("trail"))
    return _by_keys(leads, closing, [*keys, "_m"]).select(*keys, "lead", "trail")


def longest_valid_pulses(hits: DataFrame, keys: list[str], kind: Column, time: str, low: int, high: int) -> DataFrame:
    """Pulses of ``low``..``high`` ticks: each trail takes the earliest unused lead in range.

    ``kind`` is 0 for a lead, 1 for a trail, null for neither. Leads that were too old for a
    trail are gone for later ones too.
    """
    found = walks.walked(walks.elements(hits, keys, F.col(time), kind), keys, walks.first_in_range(low, high), high)
    return found.select(*keys, F.col("a").alias("lead"), F.col("b").alias("trail"))


def longest_valid_statistics(hits: DataFrame, keys: list[str], kind: Column, time: str, low: int, high: int) -> DataFrame:
    """Per key: edges, pairs, and why others found none.

    ``too_long`` counts unused leads that were too old for some later trail, ``too_short`` unused
    trails behind any lead, ``nested`` the unused leads between the two of a pair, summed.
    """
    edges = walks.elements(hits, keys, F.col(time), kind)
    found = walks.walked(edges, keys, walks.first_in_range(low, high), high)
    lead, trail = F.col("_side") == 0, F.col("_side") == 1
    ends = edges.groupBy(*keys).agg(F.max(F.when(trail, F.col("_t"))).alias("_last"), F.min(F.when(lead, F.col("_t"))).alias("_first"))
    # an edge counts 1, and a pair takes back what its two edges count
    one = lambda side, t, n: F.struct(F.lit(side).alias("_side"), F.col(t).alias("_t"), F.lit(n).alias("_n"))
    used = found.select(*keys, "between", F.explode(F.array(one(0, "a", -1), one(1, "b", -1))).alias("_x")).select(*keys, F.when(F.col("_x._side") == 0, F.col("between")).alias("between"), "_x.*")
    both = edges.select(*keys, F.lit(None).cast("long").alias("between"), "_side", "_t", F.lit(1).alias("_n")).unionByName(used)
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0)).cast("long")
    return _by_keys(both, ends, keys).groupBy(*keys).agg(
        F.count(F.when(lead & (F.col("_n") < 0), 1)).alias("paired"), count(lead).alias("unmatched_leads"), count(trail).alias("unmatched_trails"),
        count(trail & (F.col("_t") > F.col("_first"))).alias("too_short"), count(lead & (F.col("_t") < F.col("_last") - high)).alias("too_long"),
        F.coalesce(F.sum("between"), F.lit(0)).cast("long").alias("nested"))


def recorded_duration_pulses(
    hits: DataFrame, keys: list[str], kind: Column, time: str, recorded: Column, tolerance: int, low: int, high: int, *, if_missing: bool = True, if_inconsistent: bool = True,
) -> DataFrame:
    """Pulses whose trail carries a recorded duration: ``lead``, ``trail``, ``direct``.

    The expected leads (trail less its duration, where that is ``low``..``high``) are matched in order
    with the nearest lead within the tolerance, the later one on a tie; a pair lasts ``low``..``high``
    as well. Trails without a duration (null or none above 0) or, with one, without a lead fall
    back, as asked, on the earliest lead in range that is still unused (``direct`` is false).
    """
    rows = hits.select(*keys, F.col(time).cast("long").alias("_t"), kind.cast("int").alias("_side"), F.when(recorded > 0, recorded).cast("double").alias("_d")).where("_side is not null and _t is not null")
    rows = rows.withColumn("_d", F.when(F.col("_side") == 1, F.col("_d")))
    whole = F.rint("_d").cast("long")
    usable = F.coalesce(F.col("_d").between(low, high) & (whole <= F.col("_t")), F.lit(False))
    expected = F.when(F.col("_side") == 0, F.col("_t")).otherwise(F.col("_t") - whole)
    met = walks.walked(walks.elements(rows, keys, expected, F.when((F.col("_side") == 0) | usable, F.col("_side")), F.col("_t")), keys, walks.nearest_in_order(tolerance, later_on_tie=True), tolerance, tolerance)
    direct = met.where((F.col("b_end") > F.col("a")) & (F.col("b_end") - F.col("a")).between(low, high))
    direct = stored(direct.select(*keys, F.col("a").alias("lead"), F.col("b_end").alias("trail"), (F.col("b_end") - F.col("b")).alias("_d"), F.lit(True).alias("direct")))
    if not (if_missing or if_inconsistent):
        return direct.drop("_d")
    # what is left: every edge counts 1, and a pair takes its two away
    counted = rows.select(*keys, "_side", "_t", whole.alias("_d"), F.lit(1).alias("_n"))
    taken = direct.select(*keys, F.lit(0).alias("_side"), F.col("lead").alias("_t"), F.lit(None).cast("long").alias("_d"), F.lit(-1).alias("_n")).unionByName(
        direct.select(*keys, F.lit(1).alias("_side"), F.col("trail").alias("_t"), "_d", F.lit(-1).alias("_n")))
    left = counted.unionByName(taken).groupBy(*keys, "_side", "_t", "_d").agg(F.sum("_n").alias("_n")).where("_n > 0")
    wanted = (F.col("_side") == 0) | (F.col("_d").isNull() & F.lit(if_missing)) | (F.col("_d").isNotNull() & F.lit(if_inconsistent))
    left = left.where(wanted).withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    late = walks.walked(walks.elements(left, keys, F.col("_t"), F.col("_side")), keys, walks.first_in_range(low, high), high)
    return direct.drop("_d").unionByName(late.select(*keys, F.col("a").alias("lead"), F.col("b").alias("trail"), F.lit(False).alias("direct")))


def monotonic_nearest(hits: DataFrame, keys: list[str], kind: Column, time: str, window: int, *, later_on_tie: bool = False) -> DataFrame:
    """One-to-one pairs of kind 0 (``a``) and kind 1 (``b``) in time order, each with the nearer of its choices.

    Walks both lists; a pair within the window is made unless the next entry on one side is
    nearer to the other's present entry (or, on side 0 and if asked, as near), in which case the
    present one is passed over.
    """
    met = walks.walked(walks.elements(hits, keys, F.col(time), kind), keys, walks.nearest_in_order(window, later_on_tie), window, window)
    return met.select(*keys, "a", "b")


def one_to_one_overlaps(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of overlapping closed intervals (``lead``, ``trail``), walked in order; on a miss the one that ends first is passed over."""
    both = walks.elements(left, keys, F.col("lead"), F.lit(0), F.col("trail")).unionByName(walks.elements(right, keys, F.col("lead"), F.lit(1), F.col("trail")))
    longest = both.agg(F.max(F.col("_e") - F.col("_t"))).first()[0] or 0
    met = walks.walked(both, keys, walks.overlapping(), longest)
    return met.select(*keys, F.col("a").alias("lead"), F.col("a_end").alias("trail"), F.col("b").alias("other_lead"), F.col("b_end").alias("other_trail"))


def unique_ids(df: DataFrame, ids: list[str]) -> DataFrame:
    """The table itself; reading it raises if an id repeats."""
    n = F.count("*").over(Window.partitionBy(*ids))
    ok = F.when(n == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"repeated {', '.join(ids)}")))
    return df.withColumn("_ok", ok).where("_ok").drop("_ok")


def agreeing_join(left: DataFrame, right: DataFrame, on: str, value: str, tolerance: float) -> DataFrame:
    """Overlap of two tables by id and how far their common values differ: one row."""
    both = left.select(on, F.col(value).alias("_a")).withColumn("_l", F.lit(1)).join(right.select(on, F.col(value).alias("_b")).withColumn("_r", F.lit(1)), on, "full_outer")
    common = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.agg(
        F.count("_l").alias("n_left"), F.count("_r").alias("n_right"), F.count_if(common).alias("n_common"),
        F.max(F.when(common, F.abs(F.col("_a") - F.col("_b")))).alias("max_difference"),
    ).withColumn("agrees", F.coalesce(F.col("max_difference") <= tolerance, F.lit(False)))


def bucket_of(columns: list[str], digits: int = 9) -> Column:
    """A key that makes values equal within rounding meet in an equi-join."""
    return F.concat_ws("|", *[F.round(c, digits).cast("string") for c in columns])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def preceding_candidates(energy: DataFrame, timing: DataFrame, keys: list[str], energy_time: str, timing_time: str, window: int, energy_id: str) -> DataFrame:
    """Every energy row with ``candidates``, the sorted timing leads inside its preceding window, and a ``status``."""
    met = window_join(energy, timing.select(*keys, timing_time), keys, energy_time, timing_time, window)
    lists = met.groupBy(energy_id).agg(F.sort_array(F.collect_list(timing_time)).alias("candidates"))
    none = F.array().cast(lists.schema["candidates"].dataType)
    out = energy.join(lists, energy_id, "left").withColumn("candidates", F.coalesce("candidates", none))
    return out.withColumn("status", F.when(F.size("candidates") > 0, "ok").otherwise("no_timing_candidate"))


def trigger_candidates(pulses: DataFrame, timing: DataFrame, event: list[str], lead: str, timing_time: str) -> DataFrame:
    """Per triggered event: its earliest pulse and all timing leads before it, sorted.

    ``status`` is ``ok``, ``no_energy_pulse`` (no pulse) or ``no_timing_candidate`` (no lead before it).
    """
    first = pulses.groupBy(*event).agg(F.min(lead).alias("energy"))
    leads = timing.groupBy(*event).agg(F.sort_array(F.collect_list(timing_time)).alias("_all"))
    met = first.join(leads, event, "full_outer")
    before = F.filter(F.col("_all"), lambda t: t < F.col("energy"))
    out = met.withColumn("candidates", F.coalesce(before, F.array().cast(leads.schema["_all"].dataType)))
    status = F.when(F.col("energy").isNull(), "no_energy_pulse").when(F.size("candidates") == 0, "no_timing_candidate").otherwise("ok")
    return out.select(*event, "energy", "candidates", status.alias("status"))


def dispatched(df: DataFrame, board: str, matchers: dict[object, object]) -> DataFrame:
    """Runs each board's own matcher (a function of its rows) and unions what they give; boards without one raise."""
    known = F.col(board).isin(*matchers)
    checked = df.where(F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no matcher for board "), F.col(board).cast("string"))).cast("boolean")))
    return reduce(DataFrame.unionByName, [match(checked.where(F.col(board) == b)) for b, match in matchers.items()])


def merged_statistics(stats: DataFrame, sums: list[str], maxima: list[str], means: list[str], weight: str) -> DataFrame:
    """One row from the boards' statistics: sums, maxima, and means weighted by ``weight``."""
    return stats.agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxima],
        *[F.try_divide(F.sum(F.col(c) * F.col(weight)), F.sum(F.when(F.col(c).isNotNull(), F.col(weight)))).alias(c) for c in means])
