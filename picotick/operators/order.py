"""Exact order statistics and places without gathering a group.

Quantiles are found by radix selection on the order-preserving 64-bit image of a double (its
IEEE bits, mirrored below zero). A round counts the rows of the wanted bucket by their next
``DIGIT`` bits, which is a partial aggregation, and goes on in the bucket that holds the rank;
once a bucket has at most ``FEW`` rows these are sorted and the rank is read off. Groups that
are small from the start are sorted at once. So no task holds more than ``FEW`` values, rows are
never shuffled but for those of small buckets, and the result is the same at every size.

Places (ranks) and running sums deal rows to ranges of the order; a row's place is its place in
its range plus the rows of its group in the ranges before.

Null keys are a group; null values are left out of quantiles and come first in an order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

#: Values of a group or bucket that one task may sort.
FEW = 200_000
#: Bits by which a round splits a bucket.
DIGIT = 12
#: Rows up to which a table of ranges or targets is broadcast.
SHORT = 100_000


def image(x: Column) -> Column:
    """The IEEE bits of a double as a long that sorts like the double; -0.0 is 0.0."""
    a = F.abs(x)
    exponent = F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2(F.when(a > 0, a).otherwise(1.0))).cast("int")))

    def bits(z: Column) -> Column:
        # the logarithm may be one off beside a power of two
        scaled = z["a"] * F.pow(F.lit(2.0), -z["e"])
        e = z["e"] + (scaled >= 2).cast("int") - ((scaled < 1) & (z["e"] > -1022)).cast("int")
        m = z["a"] * F.pow(F.lit(2.0), -e)
        normal = F.shiftleft((e + 1023).cast("long"), 52) + ((m - 1) * float(1 << 52)).cast("long")
        tiny = (z["a"] * float(1 << 52) * F.pow(F.lit(2.0), F.lit(1022))).cast("long")
        return F.when(z["a"] < 2.0**-1022, tiny).otherwise(normal)

    magnitude = F.get(F.transform(F.array(F.struct(a.alias("a"), exponent.alias("e"))), bits), F.lit(0))
    return F.when(x < 0, -magnitude).otherwise(magnitude)


def by_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", more: Column | None = None) -> DataFrame:
    """Join on keys, null keys included, and a further condition on the other columns."""
    other = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [left[k].eqNullSafe(other[f"_k_{k}"]) for k in keys] + ([] if more is None else [more])
    return left.join(other, reduce(lambda a, b: a & b, same), how).drop(*[f"_k_{k}" for k in keys])


def _short(table: DataFrame) -> DataFrame:
    """Broadcast behind a check of the stored table's size."""
    return F.broadcast(table) if table.count() <= SHORT else table


def _read_off(values: Column, n: Column, probability: float) -> Column:
    """Quantile of sorted values with linear interpolation."""
    place = (n - 1) * F.lit(float(probability))
    low, high = F.floor(place), F.ceil(place)
    a, b = F.get(values, low.cast("int")), F.get(values, high.cast("int"))
    return F.when(low == high, a).otherwise((high - place) * a + (place - low) * b)


def quantiles(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]], keys: list[str], also: tuple[Column, ...] = ()) -> DataFrame:
    """Per group: an array of quantiles for each name of ``wanted`` (value, probabilities), and the aggregates ``also``.

    Quantiles are linearly interpolated; a group without a value has null ones.
    """
    probabilities = {name: ps for name, (_, ps) in wanted.items()}
    # values first, under names of their own, so that aggregates may use any column of df
    given = df.withColumns({f"_v_{name}": x.cast("double") for name, (x, _) in wanted.items()})
    most = given.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).agg(F.max("_rows")).first()[0] or 0
    if most <= FEW:
        lists = given.groupBy(*keys).agg(*also, *[F.sort_array(F.collect_list(f"_v_{name}")).alias(f"_s_{name}") for name in wanted])
        read = [F.array(*[_read_off(F.col(f"_s_{name}"), F.size(f"_s_{name}"), p) for p in ps]).alias(name) for name, ps in probabilities.items()]
        return lists.select(*[c for c in lists.columns if not c.startswith("_s_")], *read)
    inner = keys or ["_all"]
    rows = given if keys else given.withColumn("_all", F.lit(0))
    out = given.groupBy(*keys).agg(*(also or (F.count(F.lit(1)).alias("_rows"),)))
    out = out if keys else out.withColumn("_all", F.lit(0))
    for name, ps in probabilities.items():
        found = _selected(rows.select(*inner, F.col(f"_v_{name}").alias("_x")).where("_x is not null"), inner, ps)
        out = by_keys(out, found.withColumnRenamed("_q", name), inner, "left")
    none = {name: F.coalesce(F.col(name), F.array(*[F.lit(None).cast("double")] * len(ps))) for name, ps in probabilities.items()}
    return out.withColumns(none).drop("_all", "_rows")


def _selected(given: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    """Keys and ``_q``, the quantiles of ``_x``, by radix selection."""
    rows = stored(given.withColumn("_i", image(F.col("_x"))))
    place = [(F.col("_n") - 1) * F.lit(float(p)) for p in probabilities]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in place])))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    # a target: the rank, the bucket that holds it (leading bits, how many), its place there and the bucket's rows
    targets = stored(sizes.select(*keys, "_n", F.explode(ranks).alias("_rank")).select(
        "*", F.lit(0).cast("long").alias("_lead"), F.lit(0).alias("_bits"), F.col("_rank").alias("_at"), F.col("_n").alias("_size")))
    leading = lambda bits: F.when(F.lit(bits) == 0, F.lit(0).cast("long")).otherwise(F.shiftright("_i", 64 - bits))
    for bits in range(0, 64, DIGIT):
        wide = targets.where((F.col("_size") > FEW) & (F.col("_bits") == bits))
        if not wide.limit(1).count():
            break
        then = min(64, bits + DIGIT)
        buckets = _short(stored(wide.select(*keys, "_lead").distinct()))
        inside = by_keys(rows.withColumn("_own", leading(bits)), buckets, keys, more=F.col("_own") == F.col("_lead"))
        counts = inside.groupBy(*keys, "_lead", F.shiftright("_i", 64 - then).alias("_next")).agg(F.count("*").alias("_c"))
        upto = Window.partitionBy(*keys, "_lead").orderBy("_next")  # at most 2 ** DIGIT rows
        counts = counts.withColumn("_upto", F.sum("_c").over(upto)).withColumnRenamed("_lead", "_of")
        met = by_keys(wide, counts, keys, more=(F.col("_lead") == F.col("_of")) & (F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_c")))
        closer = met.select(*keys, "_n", "_rank", F.col("_next").alias("_lead"), F.lit(then).alias("_bits"), (F.col("_at") - F.col("_upto") + F.col("_c")).alias("_at"), F.col("_c").alias("_size"))
        targets = stored(targets.where(~((F.col("_size") > FEW) & (F.col("_bits") == bits))).unionByName(closer))
    # rows of the small buckets are sorted; a bucket of all 64 bits is one value, however often it comes
    buckets = _short(stored(targets.select(*keys, "_lead", "_bits").distinct()))
    own = F.when(F.col("_bits") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", F.col("_i"), F.lit(64) - F.col("_bits")))
    inside = by_keys(rows, buckets, keys, more=own == F.col("_lead"))
    values = inside.groupBy(*keys, "_lead", "_bits").agg(F.sort_array(F.collect_list(F.when(F.col("_bits") < 64, F.col("_x")))).alias("_values"), F.min("_x").alias("_one"))
    values = values.select(*keys, F.col("_lead").alias("_of"), F.col("_bits").alias("_deep"), "_values", "_one")
    told = by_keys(targets, values, keys, more=(F.col("_lead") == F.col("_of")) & (F.col("_bits") == F.col("_deep")))
    told = told.withColumn("_x", F.when(F.col("_bits") == 64, F.col("_one")).otherwise(F.get("_values", F.col("_at").cast("int"))))
    by_rank = told.groupBy(*keys, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_m"))
    at = lambda r: F.element_at("_m", r)
    read = [F.when(F.floor(p) == F.ceil(p), at(F.floor(p))).otherwise((F.ceil(p) - p) * at(F.floor(p)) + (p - F.floor(p)) * at(F.ceil(p))) for p in place]
    return by_rank.select(*keys, F.array(*read).alias("_q"))


def quantile_groups(df: DataFrame, value: str, keys: list[str], bands: list[tuple[float, float]]) -> DataFrame:
    """Rows whose value lies in a band of percentiles of its group, [low, high) by value, with ``band``, its number."""
    edges = sorted({p for band in bands for p in band})
    cuts = stored(quantiles(df, {"_cuts": (F.col(value), [p / 100 for p in edges])}, keys))
    at = lambda p: F.get("_cuts", F.lit(edges.index(p)))
    told = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), at(a).alias("low"), at(b).alias("high")) for i, (a, b) in enumerate(bands)])).alias("_b")
    limits = cuts.select(*keys, told).select(*keys, F.col("_b.band").alias("band"), F.col("_b.low").alias("_low"), F.col("_b.high").alias("_high"))
    inside = (F.col(value) >= F.col("_low")) & (F.col(value) < F.col("_high"))
    met = by_keys(df, limits, keys, more=inside) if keys else df.join(F.broadcast(limits), inside)  # a row a band
    return met.drop("_low", "_high")


def median(values: str) -> Column:
    """The only quantile of an array that ``quantiles`` gave."""
    return F.get(values, F.lit(0))


def running(df: DataFrame, keys: list[str], order: list[str], weight: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``weight`` over the rows of the group up to and with this one, in order.

    The table of ranges has a row for each group and range, and is broadcast only while it is
    small. Rows equal in the whole order come in any order.
    """
    ranged = stored(df.withColumn("_run_weight", weight).repartitionByRange(*keys, *order).withColumn("_run_range", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_run_range").agg(F.sum("_run_weight").alias("_run_sum"))
    before = (Window.partitionBy(*keys) if keys else Window).orderBy("_run_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = stored(counts.select(*keys, F.col("_run_range").alias("_run_of"), F.coalesce(F.sum("_run_sum").over(before), F.lit(0)).alias("_run_ahead")))
    here = F.sum("_run_weight").over(Window.partitionBy(*keys, "_run_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = by_keys(ranged, _short(ahead), keys, more=F.col("_run_range") == F.col("_run_of"))
    return met.withColumn(name, here + F.col("_run_ahead")).drop("_run_range", "_run_of", "_run_ahead", "_run_weight")


def placed(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``, each row's place (from 0) in its group's order."""
    return running(df, keys, order, F.lit(1).cast("long"), name).withColumn(name, F.col(name) - 1)


def sized(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds ``name``, the rows of the row's group, by one aggregation and a join."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return by_keys(df, counts, keys) if keys else df.join(F.broadcast(counts), how="left")  # one row
