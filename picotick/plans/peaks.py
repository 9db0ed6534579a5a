"""Queries over peaks of many groups, exact intervals of counts, recursive filters, and a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import special
from ..operators import filters, resampling, scratch
from ..operators import selection as S
from ..streaming import hits as streams
from .matches import DAY, LONGEST, SHORTEST, _edges, first_in_range_sql, walk_sql
from .registry import register
from .tables import HITS, RESIDUALS, hits, read, residuals, rounded, waves

STEP, LEFT, RIGHT, NARROW, HEIGHT = 2.0, 2.0, 3.0, 0.5, 0.2


@register("sel_peak_intervals", f"""WITH e AS (SELECT event_type AS mode, floor(value / {STEP} + 0.5) * {STEP} AS x FROM events WHERE value IS NOT NULL), b AS (SELECT mode, x, count(*)::DOUBLE AS w FROM e GROUP BY ALL),
  m AS (SELECT mode, sum(w) AS n, sum(w * x) / sum(w) AS mean, min(x) AS lo, max(x) AS hi FROM b GROUP BY mode),
  s AS (SELECT mode, any_value(n) AS n, any_value(lo) AS lo, any_value(hi) AS hi, sqrt(sum(w * (x - mean) ** 2) / any_value(n)) AS sd FROM b JOIN m USING (mode) GROUP BY mode),
  h AS (SELECT *, {NARROW} * CASE WHEN sd > 0 THEN sd ELSE {STEP} END * n ** (-0.2) AS wide FROM s), g AS (SELECT mode, i, lo - 3 * wide + i * (hi - lo + 6 * wide) / 1023 AS at_, wide FROM h, range(1024) t(i)),
  d AS (SELECT mode, i, at_, sum(w * exp(-0.5 * ((at_ - x) / wide) ** 2)) AS dens FROM g JOIN b USING (mode) GROUP BY mode, i, at_),
  k AS (SELECT *, lag(dens) OVER o AS before, lead(dens) OVER o AS after, max(dens) OVER (PARTITION BY mode) AS most FROM d WINDOW o AS (PARTITION BY mode ORDER BY i)),
  t AS (SELECT mode, max(i) AS top, arg_max(dens, i) AS dt FROM k WHERE dens > before AND dens >= after AND dens >= {HEIGHT} * most GROUP BY mode),
  r AS (SELECT mode, coalesce(max(i) FILTER (i < top AND dens < dt / 2) + 1, 0) AS a, coalesce(min(i) FILTER (i > top AND dens < dt / 2) - 1, 1023) AS z FROM d JOIN t USING (mode) GROUP BY mode),
  c AS (SELECT mode, min(at_) FILTER (i = a) AS g0, max(at_) FILTER (i = z) AS g1 FROM d JOIN r USING (mode) GROUP BY mode), q AS (SELECT e.mode, x, g1 - g0 AS span FROM e JOIN c ON e.mode = c.mode AND x BETWEEN g0 AND g1),
  p AS (SELECT mode, median(x) AS centre FROM q GROUP BY mode), v AS (SELECT mode, any_value(centre) AS centre, 1.4826 * median(abs(x - centre)) AS sigma, max(span) AS span FROM q JOIN p USING (mode) GROUP BY mode),
  f AS (SELECT mode, centre, CASE WHEN sigma > 0 THEN sigma ELSE span / 2.355 END AS sigma FROM v)
  SELECT mode, n::BIGINT AS n, round(centre, 6) + 0.0 AS centre, round(sigma, 6) + 0.0 AS sigma, round(centre - {LEFT} * sigma, 6) + 0.0 AS low, round(centre + {RIGHT} * sigma, 6) + 0.0 AS high FROM f JOIN m USING (mode)""")
def sel_peak_intervals(spark, sf_dir):
    """The right-most peak of every mode's values, all modes in one pass."""
    e = read(spark, sf_dir, "events").withColumnRenamed("event_type", "mode")
    return rounded(S.peak_intervals(e, "value", ["mode"], STEP, LEFT, RIGHT, NARROW, HEIGHT))


@register("sel_gaussian_peaks")
def sel_gaussian_peaks(spark, sf_dir):
    return rounded(S.gaussian_peaks(residuals(spark, sf_dir), "x", ["event_type"], 0.125))


@register("sel_frozen_per_mode", """WITH t AS (SELECT event_type AS mode, unnest([20, 60, 150]) AS threshold, unnest([CASE WHEN value > 20 THEN ln(value) END, CASE WHEN value > 60 THEN ln(value) - 1 END, CASE WHEN value > 150 THEN ln(value) - 2 END]) AS x FROM events),
  s AS (SELECT mode, threshold::DOUBLE AS threshold, count(x) / count(*) AS efficiency, avg(x) AS mean, stddev_samp(x) AS ctr FROM t GROUP BY ALL)
  SELECT mode, threshold, round(efficiency, 6) + 0.0 AS efficiency, round(mean, 6) + 0.0 AS control_mean, round(ctr, 6) + 0.0 AS ctr FROM s WHERE efficiency >= 0.02 QUALIFY row_number() OVER (PARTITION BY mode ORDER BY s.ctr, threshold) = 1""")
def sel_frozen_per_mode(spark, sf_dir):
    """The best threshold of each mode, and its control mean."""
    v, x = F.col("value"), F.ln("value")
    each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.when(v > t, x - i).alias("x")) for i, t in enumerate((20, 60, 150))])).alias("z")
    scan = read(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), each).groupBy("mode", F.col("z.threshold").alias("threshold")).agg(
        (F.count("z.x") / F.count("*")).alias("efficiency"), F.avg("z.x").alias("control_mean"), F.stddev_samp("z.x").alias("ctr"))
    return rounded(S.best_threshold(scan, 0.02, ["mode"]))


_BINOMIAL = "list_sum(list_transform(range({0}, {1} + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({2}) + (n - i) * ln(1 - {2}))))"


@register("stat_binomial_intervals", f"""WITH RECURSIVE c AS (SELECT event_type, count(*) FILTER (value > 100) AS k, count(*) AS n FROM events GROUP BY 1),
  b AS (SELECT event_type, k, n, 0 AS i, 0.0::DOUBLE AS l0, 1.0::DOUBLE AS l1, 0.0::DOUBLE AS h0, 1.0::DOUBLE AS h1 FROM c
  UNION ALL SELECT event_type, k, n, i + 1, CASE WHEN pl < 0.025 THEN (l0 + l1) / 2 ELSE l0 END, CASE WHEN pl < 0.025 THEN l1 ELSE (l0 + l1) / 2 END, CASE WHEN ph > 0.025 THEN (h0 + h1) / 2 ELSE h0 END, CASE WHEN ph > 0.025 THEN h1 ELSE (h0 + h1) / 2 END
  FROM (SELECT *, {_BINOMIAL.format("k", "n", "((l0 + l1) / 2)")} AS pl, {_BINOMIAL.format("0", "k", "((h0 + h1) / 2)")} AS ph FROM b WHERE i < 50))
  SELECT event_type, k, n, round((l0 + l1) / 2, 6) + 0.0 AS low, round((h0 + h1) / 2, 6) + 0.0 AS high, round(least(1.0::DOUBLE, 2 * {_BINOMIAL.format("0", "least(k, n - k)", "0.5::DOUBLE")}), 6) + 0.0 AS sign_p FROM b WHERE i = 50""")
def stat_binomial_intervals(spark, sf_dir):
    """Share of large events of each type with its exact interval, and the sign test."""
    c = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 100).alias("k"), F.count("*").alias("n"))
    low, high = special.binomial_interval(F.col("k"), F.col("n"))
    return rounded(c.select("event_type", "k", "n", low.alias("low"), high.alias("high"), special.sign_p(F.col("k"), F.col("n")).alias("sign_p")))


_POISSON = "list_sum(list_transform(range(0, {0} + 1), lambda i: exp(i * ln({1}) - {1} - lgamma(i + 1))))"


@register("stat_uniformity", f"""WITH RECURSIVE g AS (SELECT event_type, x - 4 AS x FROM ({RESIDUALS}) WHERE x IS NOT NULL), t AS (SELECT event_type, x, CASE WHEN x < 0 THEN (x + 3) / 5 ELSE 0.5 + (x - 0.5) / 5 END AS u FROM g WHERE abs(x) BETWEEN 0.5 AND 3),
  c AS (SELECT event_type, count(*) AS n, count(*) FILTER (abs(x) BETWEEN 0.5 AND 3) AS k, count(*) FILTER (x BETWEEN 0.5 AND 3) AS n_up FROM g GROUP BY 1),
  b AS (SELECT event_type, k, 0 AS i, 0.0::DOUBLE AS l0, k + 10 * sqrt(k + 1) + 20 AS l1, 0.0::DOUBLE AS h0, k + 10 * sqrt(k + 1) + 20 AS h1 FROM c
    UNION ALL SELECT event_type, k, i + 1, CASE WHEN pl > 0.975 THEN (l0 + l1) / 2 ELSE l0 END, CASE WHEN pl > 0.975 THEN l1 ELSE (l0 + l1) / 2 END, CASE WHEN ph > 0.025 THEN (h0 + h1) / 2 ELSE h0 END, CASE WHEN ph > 0.025 THEN h1 ELSE (h0 + h1) / 2 END
    FROM (SELECT *, {_POISSON.format("(k - 1)", "((l0 + l1) / 2)")} AS pl, {_POISSON.format("k", "((h0 + h1) / 2)")} AS ph FROM b WHERE i < 55)),
  p AS (SELECT event_type, least(8, floor(u * 9)) AS part, count(*) AS m FROM t GROUP BY ALL), s AS (SELECT event_type, sum(m * m) * 9 / sum(m) - sum(m) AS chi2 FROM p GROUP BY 1),
  r AS (SELECT event_type, u, row_number() OVER (PARTITION BY event_type ORDER BY u) AS r, count(*) OVER (PARTITION BY event_type) AS k FROM t), d AS (SELECT event_type, max(greatest(r / k - u, u - (r - 1) / k)) AS ks FROM r GROUP BY 1),
  o AS (SELECT *, (l0 + l1) / 2 AS lo, (h0 + h1) / 2 AS hi FROM b WHERE i = 55), z AS (SELECT *, (sqrt(k) + 0.12 + 0.11 / sqrt(k)) * ks AS z, n_up AS kk FROM c JOIN d USING (event_type) JOIN s USING (event_type) JOIN (SELECT event_type, lo, hi FROM o) USING (event_type))
  SELECT event_type, n, k, n_up AS positive, round(k / 5, 6) + 0.0 AS density, round(lo / 5, 6) + 0.0 AS density_low, round(hi / 5, 6) + 0.0 AS density_high,
    round(least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, least(n_up, k - n_up) + 1), lambda i: exp(lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1) + k * ln(0.5::DOUBLE))))), 6) + 0.0 AS side_p, round(chi2, 6) + 0.0 AS chi2,
    round(exp(-chi2 / 2) * (1 + chi2 / 2 + (chi2 / 2) ** 2 / 2 + (chi2 / 2) ** 3 / 6), 6) + 0.0 AS chi2_p, round(ks, 6) + 0.0 AS ks,
    round(CASE WHEN z < 0.2 THEN 1 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda j: 2 * (-1) ** (j - 1) * exp(-2 * j * j * z * z))))) END, 6) + 0.0 AS ks_p FROM z""")
def stat_uniformity(spark, sf_dir):
    """Evenness of each type's residuals over two sidebands."""
    centred = residuals(spark, sf_dir).withColumn("x", F.col("x") - 4)
    return rounded(resampling.uniformity(centred, "x", ["event_type"], 0.5, 3.0, 9))


@register("sig_lowpass")
def sig_lowpass(spark, sf_dir):
    return filters.lowpass(waves(spark, sf_dir), "event_id", "s1", 0.2)


@register("sig_region_lowpass", "SELECT vec_id AS id, array_to_string(list_transform(embedding[13:21]::DOUBLE[], lambda x: CAST(round(x * 1000000) AS BIGINT)), ',') AS kept FROM embeddings")
def sig_region_lowpass(spark, sf_dir):
    """Baseline and tail filtered; what lies between comes back as it was."""
    found = filters.lowpass(waves(spark, sf_dir), "event_id", "s1", 0.2, region=filters.Region(12, 21, 3))
    return found.select("id", F.array_join(F.transform(F.slice("filtered", 13, 9), lambda x: F.round(x * 1000000).cast("long").cast("string")), ",").alias("kept"))


@register("sig_phase_rotation")
def sig_phase_rotation(spark, sf_dir):
    return filters.rotated(waves(spark, sf_dir), "event_id", "s1", 0.2, 90.0, filters.Region(tail_start=14, fade=3))


#: Days by which hits of the streaming query may be late.
LATE = 2


@register("stream_longest_valid", f"""WITH RECURSIVE h AS ({HITS}), {walk_sql(_edges(), first_in_range_sql(SHORTEST, LONGEST))}
  SELECT board, p AS lead, q AS trail FROM w WHERE p IS NOT NULL AND q <= (SELECT (max(toa) // 1000 - {LATE * DAY // 1000}) * 1000 FROM h WHERE channel IN ('view', 'purchase'))""")
def stream_longest_valid(spark, sf_dir):
    """The hits as files of a stream, out of order by up to two days, and its pulses up to the last watermark."""
    h = hits(spark, sf_dir).where("channel in ('view', 'purchase')")
    rows = scratch.stored(h.select("board", F.timestamp_micros("toa").alias("ts"), "toa", (F.col("channel") == "purchase").cast("int").alias("kind"), (F.col("toa") + F.pmod(F.xxhash64("hit_id"), F.lit(LATE * DAY))).alias("_comes")))
    first, last = rows.agg(F.min("_comes"), F.max("_comes")).first()
    if first is None:
        return spark.createDataFrame([], "board long, lead long, trail long")
    path, out, parts = scratch.folder(spark), scratch.folder(spark), 4
    before = spark.conf.get(streams.STORE[0], None)
    streams.state_store(spark)
    try:
        for i in range(parts):  # one after the other; the stream takes a part whole, whatever its number of files: hits are late by parts only
            low, high = (first + (last + 1 - first) * k // parts for k in (i, i + 1))
            rows.where((F.col("_comes") >= low) & (F.col("_comes") < high)).drop("_comes").write.mode("append").parquet(path)
            stream = spark.readStream.schema("board long, ts timestamp, toa long, kind int").parquet(path)
            pulses = streams.longest_valid_pulses(stream, "board", "ts", "toa", "kind", SHORTEST, LONGEST, f"{LATE} days")
            pulses.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(streams.STORE[0], before) if before else spark.conf.unset(streams.STORE[0])
    return spark.read.schema("board long, lead long, trail long").parquet(out)
