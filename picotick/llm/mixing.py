"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a share of all words by its weight, but at most ``max_epochs`` times its own
size; what a capped source cannot take is shared out again by weight (water filling). A
source's target is met by complete epochs first. The fraction that remains is a weighted
sample without replacement: each document has the key ``-ln(u) / weight`` with u from a hash
of its id, and documents are taken in key order while their summed sizes stay within the
budget. With ``fill`` the largest document that still fits the gap is added out of key order,
which brings a source nearer to its target and favours long documents by that one draw a
source; without it the draw is the weighted sample alone.

The order is never sorted in one place: keys fall into ranges, the sums of which give each
source's last range, and only that range's documents (1 in 4096 and at most about
``RANGE_ROWS``) are ordered. All other decisions are row-local comparisons with a small
per-source table.

Null texts have size 0 and are never short of anything: they take 0 words. A null source is a
source (last in order). Null ids hash as the empty string. Rows of equal id (and so of nearly
equal keys) come in order of size and a hash of their text; of rows that repeat id and text as
many are taken as the budget allows, whichever they are, so repeats never overshoot a target.
Only where the budget ends among such repeats are they numbered, in one window over those
repeats. Very long texts are only counted. Other columns are carried only if ``keep`` names
them; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import SPACE, stored

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Key ranges: at least BUCKETS, and so many that one holds about RANGE_ROWS documents.
BUCKETS, RANGE_ROWS = 4096, 100_000
SEED = 17


def size_of(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")).cast("long")


def quality_weight(size: Column) -> Column:
    """Weight in [0.25, 1]: short documents are drawn less often."""
    return F.lit(0.25) + 0.75 * F.least(F.lit(1.0), size / F.lit(200.0))


def uniform(doc_id: Column, seed: int) -> Column:
    """In (0, 1), from 52 bits of an md5 (which SQL engines share)."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """``source``, ``source_size`` -> plus ``target``. One row per source: windows over a short table."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    cyclic = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights)))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    weighed = sizes.select("source", "source_size", cyclic.alias("w"), cap.alias("cap"))
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    whole = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(whole) * F.lit(share) - (F.sum("cap").over(by_fill) - F.col("cap"))) / (
        F.sum("w").over(whole) - F.sum("w").over(by_fill) + F.col("w"))
    levelled = weighed.withColumn("level", level)
    water = F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(whole)
    return levelled.select("source", "source_size", F.round(F.least("cap", F.coalesce(water, F.lit(float("inf"))) * F.col("w")), 6).alias("target"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["_source"].eqNullSafe(b["source"])


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[float, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS, share: float = 1.0, seed: int = SEED, fill: bool = True, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: id, ``source``, ``size``, ``source_size``, ``target``, ``times`` (copies) and ``taken`` (words)."""

    def sized(*carried: str) -> DataFrame:
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        first = df.select(
            F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), size_of(F.col(text_col)).alias("_size"),
            F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").alias("_tie"),
            *([F.struct(*carried).alias("_keep")] if carried else []),
        )
        return first.withColumn("_key", -F.ln(uniform(F.col("_id"), seed)) / quality_weight(F.col("_size")))

    narrow = stored(sized())
    buckets = max(BUCKETS, narrow.count() // RANGE_ROWS)
    placed = F.struct("_key", "_size", "_tie")  # a row's place in its source's order
    in_ranges = lambda rows: rows.withColumn("_bucket", F.floor((1 - F.exp(-F.col("_key"))) * buckets).cast("long")).withColumn("_place", placed)
    narrow = in_ranges(narrow)
    sums = narrow.groupBy("_source", "_bucket").agg(F.sum("_size").alias("n"))
    goal = targets(sums.groupBy(F.col("_source").alias("source")).agg(F.sum("n").alias("source_size")), weights, max_epochs, share)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    running = Window.partitionBy("_source").orderBy("_bucket")
    ranges = sums.withColumn("upto", F.sum("n").over(running))
    cut = (
        ranges.join(goal, _same(ranges, goal))
        .groupBy("source", "source_size", "target", "epochs", "budget")
        .agg(F.min(F.when(F.col("upto") > F.col("budget"), F.col("_bucket"))).alias("last"), F.max(F.when(F.col("upto") <= F.col("budget"), F.col("upto"))).alias("below"))
        .withColumn("last", F.coalesce("last", F.lit(buckets + 1))).withColumn("below", F.coalesce("below", F.lit(0)))
    )
    cut = stored(cut)
    edge = narrow.join(cut, _same(narrow, cut) & (narrow["_bucket"] == cut["last"]))
    in_order = Window.partitionBy("_source").orderBy("_key", "_size", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = edge.withColumn("upto", F.col("below") + F.sum("_size").over(in_order)).where("upto <= budget")
    # the last place that fits, how many of its rows do, and what is taken with them
    fits = fits.groupBy("source", "_place").agg(F.count("*").alias("m"), F.max("upto").alias("filled")).groupBy("source").agg(F.max(F.struct("_place", "m", "filled")).alias("f"))
    # stored, so that its size (a row per source) is known and large sources need not be shuffled to meet it
    cut = stored(cut.alias("c").join(fits.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")), "left").select(
        "c.*", "f._place", F.coalesce("f.m", F.lit(0)).alias("m"), (F.col("budget") - F.coalesce("f.filled", F.col("c.below"))).alias("gap"))
        .withColumnRenamed("_place", "stop"))
    chosen = F.coalesce((F.col("_bucket") < F.col("last")) | ((F.col("_bucket") == F.col("last")) & (F.col("_place") <= F.col("stop"))), F.lit(False))
    met = narrow.join(cut, _same(narrow, cut))
    fitting = ~chosen & (F.col("_size") > 0) & (F.col("_size") <= F.col("gap")) & F.lit(fill)
    found = met.groupBy("source").agg(
        F.max(F.when(fitting, F.struct(F.col("_size").alias("s"), (-F.col("_key")).alias("k"), (-F.col("_tie")).alias("t")))).alias("top"),
        F.count(F.when(F.col("_place") == F.col("stop"), 1)).alias("at_stop"))
    extra = F.when(F.col("top").isNotNull(), F.struct((-F.col("top.k")).alias("_key"), F.col("top.s").alias("_size"), (-F.col("top.t")).alias("_tie")))
    found = found.select(F.col("source").alias("_s"), extra.alias("extra"), "at_stop")
    plan = stored(cut.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"))
    rows = in_ranges(sized(*keep)) if keep else narrow
    decided = rows.join(plan, _same(rows, plan))
    at_extra = F.coalesce(F.col("_place") == F.col("extra"), F.lit(False))
    at_stop = F.coalesce((F.col("_place") == F.col("stop")) & (F.col("at_stop") > F.col("m")), F.lit(False))
    # repeats of one row at the end of a budget have to be numbered; else a place is one row, or taken whole
    several = met.join(plan.select(F.col("source").alias("_s"), "extra", "at_stop"), F.col("source").eqNullSafe(F.col("_s")))
    several = several.where(at_extra | at_stop).groupBy("source", "_place", "at_stop", "m").count().where((F.col("count") > 1) | (F.col("at_stop") > F.col("m")))
    if several.limit(1).count():
        ends = at_extra | at_stop
        one = Window.partitionBy("_source", "_place").orderBy(F.lit(0))
        nth = decided.where(ends).withColumn("_nth", F.row_number().over(one))
        decided = decided.where(~ends).withColumn("_nth", F.lit(1)).unionByName(nth)
    else:
        decided = decided.withColumn("_nth", F.lit(1))
    drawn = F.when(at_extra, F.col("_nth") == 1).when(at_stop, F.col("_nth") <= F.col("m")).otherwise(chosen)
    times = F.when(F.col("_size") > 0, F.col("epochs") + drawn.cast("long")).otherwise(F.lit(0)).cast("long")
    return decided.withColumn("times", times).select(
        F.col("_id").alias(id_col), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("source_size"), "target", "times",
        (F.col("times") * F.col("_size")).alias("taken"), *([F.col("_keep").alias("kept")] if keep else []),
    )
