"""Bootstrap, permutation and scans, deterministic in (id, draw, seed).

Rows are numbered once, by ranges of their order, and put into blocks of ``BLOCK`` consecutive
ones. How many of a draw's picks fall into each block is a multinomial number, which every block
finds by itself: a tree of binomial splits, each seeded by (seed, draw, part of the blocks). Picks
inside a block are hashes of (seed, draw, block, number), which other engines share. So no draw is
shuffled: rows move once, and statistics of draws are partial sums. ``resample`` draws from whole
groups instead, pick by pick, as SQL does: picks are made in stretches, sorted by place in the task
and sent, two bytes each, to the pieces of rows that they name.

Permutations need no rows at all but the observed ones: a random subset of k of n places is the k
smallest hashes, its threshold lies within a few standard deviations of k / n (checked, and looked
for further out if not), and what a statistic needs of a stretch of places is a row a draw.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, ShortType, StructField, StructType

from ..functions import special
from .order import by_keys, placed, sized
from .robust import finite
from .scratch import stored

#: Rows of a block. Groups of up to so many rows need no binomial split.
BLOCK = 1 << 16
#: Multipliers and mask of the 32-bit hash; each is below 2**31, so no engine overflows a signed long.
MULTIPLIERS, MASK = (0x7FEB352D, 0x31848BAB), 0xFFFFFFFF


def mixed(df: DataFrame, name: str, seed: int, parts: list[Column]) -> DataFrame:
    """Adds ``name``, a hash below 2**32 of a seed and whole numbers, by shifts and products alone."""
    df = df.withColumn(name, F.lit(seed).cast("long"))
    h = F.col(name)
    for part in parts:
        df = df.withColumn(name, h.bitwiseXOR(part.cast("long").bitwiseAND(F.lit(MASK))))
        for shift, by in zip((16, 15), MULTIPLIERS, strict=True):
            df = df.withColumn(name, (h.bitwiseXOR(F.shiftright(name, shift)) * F.lit(by).cast("long")).bitwiseAND(F.lit(MASK)))
        df = df.withColumn(name, h.bitwiseXOR(F.shiftright(name, 16)))
    return df


def mix(seed: int, *parts) -> np.ndarray:
    """The same hash of NumPy arrays."""
    h = np.uint64(seed)
    for part in parts:
        h = h ^ (np.asarray(part).astype(np.uint64) & np.uint64(MASK))
        for shift, by in zip((16, 15), MULTIPLIERS, strict=True):
            h = ((h ^ (h >> np.uint64(shift))) * np.uint64(by)) & np.uint64(MASK)
        h = h ^ (h >> np.uint64(16))
    return h


def mixed_sql(source: str, name: str, seed: int, parts: list[str]) -> str:
    """The same hash as a DuckDB subquery over ``source`` that adds ``name``."""
    sql = f"(SELECT *, {seed}::BIGINT AS {name} FROM {source})"
    for part in parts:
        for step in (f"xor({name}, ({part})::BIGINT & {MASK})", *(f"(xor({name}, {name} >> {n}) * {by}) & {MASK}" for n, by in zip((16, 15), MULTIPLIERS, strict=True)), f"xor({name}, {name} >> 16)"):
            sql = f"(SELECT * REPLACE ({step} AS {name}) FROM {sql})"
    return sql


def picks_in_block(n: int, block: int, draws: int, seed: int, size: int = BLOCK, known: dict | None = None) -> list[int]:
    """How many of n picks among n rows fall into a block of ``size`` rows, for each draw.

    The blocks are split in halves down to the one; each split of a draw is binomial, seeded by the
    half's first and last block, so blocks that share a split agree on it. ``known`` keeps splits.
    """
    known = {} if known is None else known
    first, last, picks = 0, -(-n // size), np.full(draws, n, np.int64)
    rows = lambda a, z: min(n, z * size) - a * size
    while last - first > 1:
        middle = (first + last) // 2
        if (n, first, last) not in known:
            rng = np.random.Generator(np.random.Philox(key=[seed, (n << 64 | first << 32 | last) % (1 << 64)]))
            known[n, first, last] = rng.binomial(picks, rows(first, middle) / rows(first, last))
        left = known[n, first, last]
        if block < middle:
            last, picks = middle, left
        else:
            first, picks = middle, picks - left
    return picks.tolist()


def bootstrap(df: DataFrame, keys: list[str], id_col: str, draws: int, seed: int) -> DataFrame:
    """The rows of ``draws`` resamples with replacement of each group, each of the group's own size.

    Adds ``draw``. Columns of one row stay together, so paired statistics share their picks. Null
    groups are groups; groups of one size share their picks.
    """
    others = [c for c in df.columns if c not in keys]
    return _drawn_in_blocks(sized(stored(placed(df, keys, [id_col], "_k")), keys, "_n"), keys, others, draws, seed)


def _drawn_in_blocks(placed_rows: DataFrame, keys: list[str], others: list[str], draws: int, seed: int) -> DataFrame:
    numbered = placed_rows.withColumn("_block", F.floor(F.col("_k") / BLOCK).cast("long"))
    dealt = numbered.repartition(int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_block")
    blocks = dealt.groupBy(*keys, "_n", "_block").agg(F.sort_array(F.collect_list(F.struct("_k", *others))).alias("_rows"))

    @F.pandas_udf("array<long>")
    def shares(n: pd.Series, block: pd.Series) -> pd.Series:
        known: dict = {}
        return pd.Series([picks_in_block(int(a), int(b), draws, seed, BLOCK, known) for a, b in zip(n, block, strict=True)])

    whole = F.array_repeat(F.col("_n"), draws)
    split = F.when(F.col("_n") <= BLOCK, whole).otherwise(shares("_n", "_block"))
    each = blocks.select(*keys, "_block", "_rows", F.posexplode(split).alias("draw", "_picks")).where("_picks > 0")
    each = each.withColumn("_pick", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_picks") - 1)))
    each = mixed(each, "_h", seed, [F.col("draw"), F.col("_block"), F.col("_pick")])
    chosen = F.get("_rows", (F.col("_h") % F.size("_rows")).cast("int"))
    # a generator, through which no filter is pushed into the hash, where it would be repeated over and over
    return each.select(*keys, "draw", F.inline(F.array(chosen))).select(*keys, "draw", *others)


#: Rows of a piece to which picks of larger groups are sent (below 2**15), and picks made at once.
PIECE, STRETCH = 1 << 14, 1 << 20


def resample(df: DataFrame, keys: list[str], id_col: str, draws: int, seed: int) -> DataFrame:
    """Like ``bootstrap``, with picks that do not depend on blocks: pick i of a draw is the row at place hash(seed, draw, 0, i) mod n.

    Groups of up to ``BLOCK`` rows are drawn as there, which gives the same picks. Groups of 2**32 rows raise.
    """
    others = [c for c in df.columns if c not in keys]
    rows = stored(placed(df, keys, [id_col], "_k"))
    sizes = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))) if keys else stored(rows.agg(F.count(F.lit(1)).alias("_n")))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    if most > MASK:
        raise ValueError("a group has more rows than a hash has values")
    numbered = by_keys(rows, sizes, keys) if keys else rows.join(F.broadcast(sizes), how="left")  # one row
    small = _drawn_in_blocks(numbered.where(F.col("_n") <= BLOCK), keys, others, draws, seed)
    if most <= BLOCK:
        return small
    units = sizes.where(F.col("_n") > BLOCK).select(*keys, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / STRETCH) - 1)).alias("_stretch")).select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    units = units.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_stretch", "draw")

    def picking(batches):
        for b in batches:
            for row, (n, stretch, draw) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_n", "_stretch", "draw")), strict=True)):
                slots = np.arange(stretch * STRETCH, min(n, (stretch + 1) * STRETCH), dtype=np.uint64)
                picks = np.sort((mix(seed, draw, 0, slots) % np.uint64(n)).astype(np.uint32))
                pieces = -(-n // PIECE)
                bounds = np.searchsorted(picks, (np.arange(pieces + 1) * PIECE).astype(np.uint64)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array((picks % PIECE).astype(np.int16)))
                at = pa.array(np.full(pieces, row))
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in keys), pa.array(np.full(pieces, draw, np.int32)), pa.array(np.arange(pieces)), lists], names=[*keys, "draw", "_piece", "_picks"])

    fields = {f.name: f for f in df.schema.fields}
    kind = StructType([*(fields[k] for k in keys), StructField("draw", IntegerType()), StructField("_piece", LongType()), StructField("_picks", ArrayType(ShortType()))])
    picks = units.mapInArrow(picking, kind).where(F.size("_picks") > 0)

    def met(_, left: pa.Table, right: pa.Table) -> pa.Table:
        left, lists = left.sort_by("_k"), right.column("_picks").combine_chunks()
        chosen = left.select([*keys, *others]).take(lists.flatten())
        return chosen.add_column(len(keys), "draw", pa.array(np.repeat(right.column("draw").to_numpy(), lists.value_lengths().to_numpy()).astype(np.int32), pa.int32()))

    pieces = numbered.where(F.col("_n") > BLOCK).select(*keys, "_k", F.floor(F.col("_k") / PIECE).alias("_piece"), *others)
    out = StructType([*(fields[k] for k in keys), StructField("draw", IntegerType()), *(fields[c] for c in others)])
    large = pieces.groupBy(*keys, "_piece").cogroup(picks.groupBy(*keys, "_piece")).applyInArrow(met, out)
    return small.unionByName(large)


def _hash(*parts: Column, seed: str) -> Column:
    text = F.concat_ws(":", *[p.cast("string") for p in parts], F.lit(seed))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def poisson_weights(df: DataFrame, id_col: str, draws: int, seed: str) -> DataFrame:
    """Adds ``draw`` and ``weight``: the approximate bootstrap, without a join. Rows of weight 0 are left out.

    The weight counts the cumulative probabilities up to u = (h + 0.5) / 2**32, h being the first eight digits of
    an md5. u >= c where h is at least a whole number, so the digits are compared as they are.
    """
    p, total, limits = 0.36787944117144233, 0.0, []
    for k in range(8):
        total += p
        least = math.ceil(Fraction(total) * (1 << 32) - Fraction(1, 2))
        limits += [f"{least:08x}"] if least < 1 << 32 else []
        p /= k + 1
    # rows are dealt out before they are multiplied
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)
    each = dealt.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    digits = F.substring(F.md5(F.concat_ws(":", F.col("draw").cast("string"), F.col(id_col).cast("string"), F.lit(seed)).cast("binary")), 1, 8)
    weight = lambda h: sum(((h >= c).cast("int") for c in limits), F.lit(0))
    # rows of weight 0 go at a generator, through which the hash is not pulled: it is made once a row and draw
    return each.withColumn("weight", F.explode(F.filter(F.transform(F.array(digits), weight), lambda w: w > 0)))


def percentile_interval(draws: DataFrame, keys: list[str], value: str, asked: int, level: float = 0.95) -> DataFrame:
    """Interval, std and count of a statistic's draws; too few successes (max(10, half)) give nulls."""
    tail = (1 - level) / 2
    ok = F.count(value) >= max(10, asked // 2)
    q = F.percentile(value, [tail, 1 - tail])
    return draws.groupBy(*keys).agg(F.count(value).alias("n_draws"), F.when(ok, F.get(q, F.lit(0))).alias("low"), F.when(ok, F.get(q, F.lit(1))).alias("high"), F.when(ok, F.stddev_samp(value)).alias("std"))


def _place_hash(seed: int, draw: int, places: np.ndarray) -> np.ndarray:
    """62 bits a place, the higher 32 from ``seed``, the others from the next one."""
    return mix(seed, draw, places) << np.uint64(30) | mix(seed + 1, draw, places) >> np.uint64(2)


def thresholds(spark: SparkSession, n: int, k: int, draws: int, seed: int) -> list[tuple[int, int]]:
    """For draws 1, 2, ...: hash and place of the k-th smallest (hash, place) of n places. One pair a draw."""
    if not 0 < k < n:
        return [((1 << 62) if k else -1, n)] * draws
    width, found = 8 * math.sqrt(k * (1 - k / n)) / n + 2 / n, {}
    while len(found) < draws:
        low, high = int(max(0.0, k / n - width) * (1 << 62)), int(min(1.0, k / n + width) * (1 << 62))
        asked = [d for d in range(1, draws + 1) if d not in found]

        def near(batches, low=low, high=high, asked=asked):
            for b in batches:
                for lo, hi, first, last in zip(*(b.column(c).to_pylist() for c in _UNIT), strict=True):
                    places = np.arange(lo, hi)
                    for d in asked[first:last]:
                        h = _place_hash(seed, d, places)
                        inside = (h >= low) & (h < high)
                        found = [pa.array([d], pa.int32()), pa.array([int((h < low).sum())], pa.int64()), pa.array([h[inside].astype(np.int64)], pa.list_(pa.int64())), pa.array([places[inside]], pa.list_(pa.int64()))]
                        yield pa.RecordBatch.from_arrays(found, names=["draw", "below", "hash", "place"])

        counted = _units(spark, n, BLOCK, len(asked)).mapInArrow(near, "draw int, below long, hash array<long>, place array<long>")
        # few rows a draw: those near its threshold
        ranked = counted.groupBy("draw").agg(F.sum("below").alias("below"), F.sort_array(F.flatten(F.collect_list(F.arrays_zip("hash", "place")))).alias("near"))
        at = (F.lit(k - 1) - F.col("below")).cast("int")
        met = ranked.where((F.col("below") < k) & (at < F.size("near"))).select("draw", F.get("near", at).alias("t")).collect()
        found |= {r.draw: (r.t["hash"], r.t["place"]) for r in met}
        width *= 4
    return [found[d] for d in range(1, draws + 1)]


#: Draws that a task works on at a time.
TOGETHER = 25
_UNIT = ("lo", "hi", "first", "last")


def _units(spark: SparkSession, n: int, size: int, draws: int) -> DataFrame:
    """``lo``, ``hi``: the places 0..n-1 in stretches of ``size``, each with ``first``..``last`` of the draws, TOGETHER at a time."""
    groups = -(-draws // TOGETHER)
    stretch, group = F.floor(F.col("id") / groups), F.col("id") % groups
    return spark.range(-(-n // size) * groups).select(
        (stretch * size).alias("lo"), F.least(F.lit(n), (stretch + 1) * size).alias("hi"), (group * TOGETHER).alias("first"), F.least(F.lit(draws), (group + 1) * TOGETHER).alias("last"))


def permutation_tests(df: DataFrame, flag: Column, order: str, id_col: str, draws: int, seed: int, block: int) -> DataFrame:
    """Does a flagged subset lie evenly along an order? A row a test: ``test``, ``n``, ``k``, ``statistic``, ``p``, ``draws``.

    ``ks``: the largest distance between the subset's share and its even growth. ``chi2``: squared
    deviations of the counts in blocks of ``block`` places, over their expected variance.
    ``adjacent``: how many flagged rows directly follow a flagged one. Each is held against the same
    random subsets of as many places; p counts draws at least as far off, plus one over plus one.
    """
    spark = df.sparkSession
    rows = placed(df.select(*dict.fromkeys([order, id_col]), flag.cast("int").alias("_flag")), [], list(dict.fromkeys([order, id_col])), "_place")
    flagged = stored(rows.select("_place", F.coalesce("_flag", F.lit(0)).alias("_flag")))
    n, k = flagged.agg(F.count("*"), F.coalesce(F.sum("_flag"), F.lit(0))).first()
    if not 0 < k < n:
        return spark.createDataFrame([(t, n, k, None, None, draws) for t in ("ks", "chi2", "adjacent")], "test string, n long, k long, statistic double, p double, draws int")
    size = block * max(1, BLOCK // block)
    limits = thresholds(spark, n, k, draws, seed)
    expected = k / n

    def summary(lo: int, chosen: np.ndarray) -> tuple:
        """What the three tests need of a stretch: count, extremes of the distance from even growth, chi-squared, adjacency, ends."""
        places = lo + np.flatnonzero(chosen)
        upto = np.arange(1, len(places) + 1)
        off = np.concatenate([upto / k - (places + 1) / n, (upto - 1) / k - places / n])
        starts = np.arange(0, len(chosen), block)
        counts, sizes = np.add.reduceat(chosen.astype(np.int64), starts), np.minimum(block, len(chosen) - starts)
        chi2 = float(((counts - sizes * expected) ** 2 / (sizes * expected * (1 - expected))).sum())
        return len(places), float(off.max()) if len(off) else None, float(off.min()) if len(off) else None, chi2, int((chosen[1:] & chosen[:-1]).sum()), bool(chosen[0]), bool(chosen[-1])

    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.bool_())
    names = ("draw", "lo", "count", "most", "least", "chi2", "pairs", "head", "tail")
    schema = "draw int, lo long, count long, most double, least double, chi2 double, pairs long, head boolean, tail boolean"

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    def drawn(batches):
        for b in batches:
            for lo, hi, first, last in zip(*(b.column(c).to_pylist() for c in _UNIT), strict=True):
                places = np.arange(lo, hi)
                found = []
                for d, (t, at) in enumerate(limits[first:last], first + 1):
                    h = _place_hash(seed, d, places)
                    found.append((d, lo, *summary(lo, (h < np.uint64(t)) | ((h == np.uint64(t)) & (places <= at)))))
                yield batch(found)

    def seen(key: tuple, table: pa.Table) -> pa.Table:
        lo = key[0].as_py() * size
        places = np.sort(table.column("_place").to_numpy()[table.column("_flag").to_numpy() == 1])
        chosen = np.zeros(min(n, lo + size) - lo, bool)
        chosen[places - lo] = True
        return pa.Table.from_batches([batch([(0, lo, *summary(lo, chosen))])])

    observed = flagged.withColumn("_stretch", F.floor(F.col("_place") / size)).groupBy("_stretch").applyInArrow(seen, schema)
    every = observed.unionByName(_units(spark, n, size, draws).mapInArrow(drawn, schema))
    by = Window.partitionBy("draw").orderBy("lo")  # a row a stretch
    before = F.coalesce(F.sum("count").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / k
    joined = F.coalesce((F.lag("tail").over(by) & F.col("head")).cast("long"), F.lit(0))
    each = every.withColumn("_far", F.greatest(F.abs(F.col("most") + before), F.abs(F.col("least") + before))).withColumn("_pairs", F.col("pairs") + joined)
    stats = each.groupBy("draw").agg(F.max("_far").alias("ks"), F.sum("chi2").alias("chi2"), F.sum("_pairs").cast("double").alias("adjacent"))
    long = stats.select("draw", F.explode(F.create_map(*[x for t in ("ks", "chi2", "adjacent") for x in (F.lit(t), F.col(t))])).alias("test", "_x"))
    told = stored(long)
    real = told.where("draw = 0").select("test", F.col("_x").alias("statistic"))
    # the distances of equal subsets may differ in their last digits
    as_far = told.where("draw > 0").join(F.broadcast(real), "test").groupBy("test", "statistic").agg(F.count_if(F.col("_x") >= F.col("statistic") - 1e-9 * F.abs("statistic")).alias("_more"))
    return as_far.select("test", F.lit(n).cast("long").alias("n"), F.lit(k).cast("long").alias("k"), "statistic", ((F.col("_more") + 1) / F.lit(draws + 1)).alias("p"), F.lit(draws).alias("draws"))


def block_chi2(df: DataFrame, flag: Column, place: str, size: int) -> DataFrame:
    """Evenness of a flag over blocks of a running index: one row with blocks, chi-squared and expected share."""
    blocks = df.groupBy(F.floor(F.col(place) / size).alias("block")).agg(F.count("*").alias("n"), F.count_if(flag).alias("k"))
    share = blocks.agg(F.sum("k") / F.sum("n")).scalar()
    expected = F.col("n") * share
    return blocks.agg(F.count("*").alias("blocks"), F.sum(F.pow(F.col("k") - expected, 2) / F.nullif(expected * (1 - share), F.lit(0.0))).alias("chi2"), F.first(share).alias("share"))


def uniformity(df: DataFrame, value: str, keys: list[str], inner: float, outer: float, bins: int, level: float = 0.95) -> DataFrame:
    """Is a background even over both sidebands inner <= |x| <= outer? A row a group.

    Counts, the density and its exact Poisson interval, and p values: equal sides (exact), counts in
    ``bins`` equal parts (chi-squared), and the largest distance from even growth (Kolmogorov's
    limit). Groups without a value in the sidebands have a density of 0 and null p values.
    """
    x, length = finite(value), 2 * (outer - inner)
    given = df.select(*keys, x.alias("_x")).where("_x is not null")
    place = F.when(F.col("_x") < 0, (F.col("_x") + outer) / length).otherwise(0.5 + (F.col("_x") - inner) / length)
    tail = given.where((F.abs("_x") >= inner) & (F.abs("_x") <= outer)).withColumn("_u", place)
    counts = given.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if((F.abs("_x") >= inner) & (F.abs("_x") <= outer)).alias("k"),
        F.count_if((F.col("_x") > 0) & (F.abs("_x") >= inner) & (F.abs("_x") <= outer)).alias("positive"))
    parts = tail.groupBy(*keys, F.least(F.lit(bins - 1), F.floor(F.col("_u") * bins)).alias("_part")).agg(F.count("*").alias("_c"))
    squares = parts.groupBy(*keys).agg(F.sum(F.col("_c") * F.col("_c")).alias("_squares"))
    ranked = sized(placed(tail, keys, ["_u"], "_place"), keys, "_k")
    far = F.greatest((F.col("_place") + 1) / F.col("_k") - F.col("_u"), F.col("_u") - F.col("_place") / F.col("_k"))
    distance = ranked.groupBy(*keys).agg(F.max(far).alias("ks"))
    met = by_keys(by_keys(counts, squares, keys, "left"), distance, keys, "left") if keys else counts.crossJoin(F.broadcast(squares)).crossJoin(F.broadcast(distance))  # one row each
    low, high = special.poisson_interval(F.col("k"), level)
    chi2 = F.col("_squares") * bins / F.col("k") - F.col("k")
    return met.withColumn("chi2", chi2).select(
        *keys, "n", "k", "positive", (F.col("k") / length).alias("density"), (low / length).alias("density_low"), (high / length).alias("density_high"),
        special.sign_p(F.col("positive"), F.col("k")).alias("side_p"), "chi2", special.chi2_p(F.col("chi2"), bins - 1).alias("chi2_p"), "ks", special.kolmogorov_p(F.col("ks"), F.col("k").cast("double")).alias("ks_p"))


def adjacent(df: DataFrame, flag: Column, place: str) -> DataFrame:
    """How many flagged rows directly follow a flagged one: an equi-join on the next place."""
    flagged = df.where(flag).select(F.col(place).alias("_p"))
    follows = flagged.join(flagged.select((F.col("_p") + 1).alias("_p")).distinct(), "_p", "left_semi")
    return follows.agg(F.count("*").alias("adjacent"))


def interval_scan(df: DataFrame, score: str, value: str, keeps: list[float]) -> DataFrame:
    """Metrics of the rows whose score is below each cut: one aggregation over (cut, row) pairs."""
    cut = F.explode(F.array(*[F.lit(float(k)) for k in keeps])).alias("cut")
    v = df.select(F.col(score).alias("_s"), F.col(value).alias("_v"), cut).where("_s <= cut")
    return v.groupBy("cut").agg(F.count("_v").alias("n"), F.sqrt(F.avg(F.col("_v") * F.col("_v"))).alias("rmse"), F.avg("_v").alias("mean"))


def log_choose(n: int, k: int) -> float:
    from math import lgamma

    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def binomial_cdf(k: int, n: int, p: float) -> float:
    from math import exp, fsum, log

    if p <= 0:
        return 1.0
    if p >= 1:
        return float(k >= n)
    return min(1.0, fsum(exp(log_choose(n, i) + i * log(p) + (n - i) * log(1 - p)) for i in range(k + 1)))


def sign_test(k: int, n: int, level: float = 0.95) -> dict[str, float]:
    """Two-sided binomial test of one half, and the exact interval of the share, from two counts."""

    def solve(f) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) else (lo, mid)
        return (lo + hi) / 2

    tail = (1 - level) / 2
    p = min(1.0, 2 * min(binomial_cdf(k, n, 0.5), 1 - (binomial_cdf(k - 1, n, 0.5) if k else 0.0)))
    low = 0.0 if k == 0 else solve(lambda q: 1 - binomial_cdf(k - 1, n, q) < tail)
    high = 1.0 if k == n else solve(lambda q: binomial_cdf(k, n, q) > tail)
    return {"p": p, "low": low, "high": high}
