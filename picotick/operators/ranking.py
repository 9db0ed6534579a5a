"""Ranks, bands, top-k and deterministic samples. Ties are broken by an id, never left to chance.

Ranks of whole groups are places by ranges of the order (``order.placed``), so no group is one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import _short as brief
from .order import by_keys, placed, running, sized
from .scratch import stored


def _average_ranks(df: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """A row for each value of a group with ``name``, its 1-based rank; only distinct values are put in order."""
    counts = stored(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_rows")))  # the ranges' borders are looked for in it before it is dealt
    upto = running(counts, keys, [value], F.col("_rows"), "_upto")
    return brief(stored(upto.select(*keys, value, (F.col("_upto") - F.col("_rows") + (F.col("_rows") + 1) / 2).alias(name))))


def average_rank(df: DataFrame, value: str, keys: list[str], name: str) -> DataFrame:
    """Adds ``name``: the 1-based rank; equal values share the mean of their places."""
    return by_keys(df, _average_ranks(df, value, keys, name), [*keys, value])


def ordinal_rank(df: DataFrame, value: str, id_col: str, keys: list[str], name: str) -> DataFrame:
    """Adds ``name``: the 0-based place in order of value, then id."""
    return placed(df, keys, [value, id_col] if value != id_col else [value], name)


def spearman(df: DataFrame, a: str, b: str, keys: list[str], id_col: str | None = None) -> DataFrame:
    """Rank correlation per group: average ranks, or ordinal ones if ``id_col`` breaks ties."""
    if not id_col:
        return spearmans(df, [a], b, keys).withColumnRenamed(f"spearman_{a}", "spearman")
    given = df.select(*dict.fromkeys([*keys, a, b, id_col]))
    ranked = ordinal_rank(ordinal_rank(given, a, id_col, keys, "_ra"), b, id_col, keys, "_rb")
    return ranked.select(*keys, F.col("_ra").cast("double").alias("ra"), F.col("_rb").cast("double").alias("rb")).groupBy(*keys).agg(guarded_corr("ra", "rb").alias("spearman"))


def spearmans(df: DataFrame, sides: list[str], b: str, keys: list[str]) -> DataFrame:
    """``spearman_<side>`` of each side against ``b`` per group, by average ranks.

    Rows meet the ranks of the sides, and are then a row for each value of b: its own rank is the same for all of them.
    """
    given = df.select(*dict.fromkeys([*keys, *sides, b]))
    sizes = stored(given.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")))
    met = by_keys(given, brief(sizes), keys, more=F.lit(True))
    for c in sides:
        met = by_keys(met, _average_ranks(given, c, keys, f"_r_{c}"), [*keys, c])
    middle = (F.col("_size") + 1) / 2
    off = {c: F.col(f"_r_{c}") - middle for c in sides}
    sums = stored(met.groupBy(*keys, b, "_size").agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(x).alias(f"_s_{c}") for c, x in off.items()], *[F.sum(x * x).alias(f"_q_{c}") for c, x in off.items()]))
    own = F.col("_upto") - F.col("_rows") + (F.col("_rows") + 1) / 2 - middle
    out = running(sums, keys, [b], F.col("_rows"), "_upto").withColumn("_own", own).groupBy(*keys).agg(
        F.sum(F.col("_rows") * F.col("_own") * F.col("_own")).alias("_qb"), *[F.sum(F.col("_own") * F.col(f"_s_{c}")).alias(f"_c_{c}") for c in sides], *[F.sum(f"_q_{c}").alias(f"_q_{c}") for c in sides])
    share = lambda c: F.try_divide(F.col(f"_c_{c}"), F.sqrt(f"_q_{c}") * F.sqrt("_qb"))
    return out.select(*keys, *[F.when(share(c).isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), share(c)))).alias(f"spearman_{c}") for c in sides])


def guarded_corr(a: str, b: str) -> Column:
    """Pearson's r, null for fewer than two rows or a constant side."""
    # Spark's own corr divides by zero on a constant side, and would do so before any condition around it
    spread = F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))
    share = F.covar_pop(a, b) / F.when(spread > 0, spread)
    return F.when(spread > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), share)))


def percentile_bands(df: DataFrame, score: str, id_col: str, keys: list[str], edges: list[float]) -> DataFrame:
    """Adds ``percentile`` = 100 (rank + 0.5) / n and ``band``, the number of its [edge, edge) range (null outside)."""
    ranked = sized(ordinal_rank(df, score, id_col, keys, "_place"), keys, "_n")
    place = 100 * (F.col("_place") + 0.5) / F.col("_n")
    ranges = list(zip(edges, edges[1:], strict=False))
    cases = reduce(lambda c, i: c.when((F.col("percentile") >= ranges[i][0]) & (F.col("percentile") < ranges[i][1]), i), range(1, len(ranges)),
                   F.when((F.col("percentile") >= ranges[0][0]) & (F.col("percentile") < ranges[0][1]), 0))
    return ranked.withColumn("percentile", place).withColumn("band", cases).drop("_place", "_n")


def lowest_percent(df: DataFrame, score: str, id_col: str, keys: list[str], percent: float) -> DataFrame:
    """The floor(n percent / 100) rows of the smallest score per group."""
    ranked = sized(ordinal_rank(df, score, id_col, keys, "_r"), keys, "_n")
    return ranked.where(F.col("_r") < F.floor(F.col("_n") * percent / 100)).drop("_r", "_n")


def extreme_flags(df: DataFrame, values: list[str], id_col: str, keys: list[str], fraction: float) -> DataFrame:
    """Adds ``top_<value>``: among the ceil(n fraction) largest absolute values of its group."""
    out = sized(df, keys, "_n")
    for v in values:
        # nulls are never among the largest
        ranked = placed(out.withColumn("_big", -F.abs(v)).withColumn("_none", F.col(v).isNull()), keys, ["_none", "_big", id_col], "_place")
        out = ranked.withColumn(f"top_{v}", F.col("_place") < F.ceil(F.col("_n") * fraction)).drop("_big", "_none", "_place")
    return out.drop("_n")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def hash_share(id_col: str, seed: str) -> Column:
    """A number in [0, 2**32) from an id, equal in every engine: the first eight digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("long")


def sample(df: DataFrame, id_col: str, n: int, seed: str) -> DataFrame:
    """``n`` rows without replacement, the same for the same ids and seed."""
    return df.orderBy(hash_share(id_col, seed), id_col).limit(n)


def folds(df: DataFrame, id_col: str, k: int, seed: str, keys: list[str] | None = None) -> DataFrame:
    """Adds ``fold_id`` 1..k of sizes that differ by one at most, the first ones larger.

    Without ``keys`` ranks are found by range: ids hash uniformly, so each of the 1024 ranges
    of the hash is numbered on its own and shifted by the counts of the ranges below.
    """
    h = hash_share(id_col, seed)
    if keys:
        ranked = sized(placed(df.withColumn("_h", h), keys, ["_h", id_col], "_place"), keys, "_n").drop("_h")
    else:
        ranges = df.withColumn("_h", h).withColumn("_range", F.shiftright("_h", 22))
        sizes = ranges.groupBy("_range").agg(F.count("*").alias("_size"))
        below = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over at most 1024 rows
        sizes = sizes.select("_range", F.coalesce(F.sum("_size").over(below), F.lit(0)).alias("_below"), F.sum("_size").over(Window.partitionBy(F.lit(1))).alias("_n"))
        within = F.row_number().over(Window.partitionBy("_range").orderBy("_h", id_col)) - 1
        ranked = ranges.withColumn("_within", within).join(F.broadcast(sizes), "_range").withColumn("_place", F.col("_below") + F.col("_within")).drop("_h", "_range", "_within", "_below")
    small, more = F.floor(F.col("_n") / k), F.col("_n") % k
    cut = more * (small + 1)
    fold = F.when(F.col("_place") < cut, F.floor(F.col("_place") / (small + 1))).otherwise(more + F.floor((F.col("_place") - cut) / F.greatest(small, F.lit(1))))
    return ranked.withColumn("fold_id", (fold + 1).cast("int")).drop("_place", "_n")


def runs(df: DataFrame, keys: list[str], place: str, mask: Column) -> DataFrame:
    """Contiguous stretches of places where the mask holds: ``first``, ``last``."""
    w = Window.partitionBy(*keys).orderBy(place)
    return df.where(mask).withColumn("_island", F.col(place) - F.row_number().over(w)).groupBy(*keys, "_island").agg(F.min(place).alias("first"), F.max(place).alias("last")).drop("_island")


def balanced_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Adds ``bin``: about equal counts, equal values together, no bin empty while values last.

    Works on distinct values: a value belongs to the bin in which the middle of its rows falls.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c")).scalar()
    upto = running(counts, [], [value], F.col("_c"), "_upto")
    given = stored(upto.select(value, F.least(F.lit(bins - 1), F.floor((F.col("_upto") - F.col("_c") / 2) * bins / total)).cast("int").alias("_b")))
    used = given.select("_b").distinct().withColumn("bin", F.dense_rank().over(Window.orderBy("_b")) - 1)  # at most ``bins`` rows
    return df.join(given.join(F.broadcast(used), "_b").drop("_b"), value)
