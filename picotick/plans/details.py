"""Queries over bins, positions, representations, candidates on both sides and kept event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import histogram, matching, order
from ..operators import selection as S
from ..operators.scratch import folder
from ..sources import tables
from .matches import DAY
from .registry import register
from .tables import HITS, RESIDUALS, WAVES, hits, read, residuals, rounded, waves


@register("agg_uniform_bins", f"""WITH r AS ({RESIDUALS}), b AS (SELECT event_type, x, CASE WHEN x = 6 THEN 15 ELSE floor((x - 1) / (5 / 16.0::DOUBLE)) END AS raw FROM r WHERE x IS NOT NULL)
  SELECT event_type, greatest(0, least(15, raw))::INT AS bin, count(*) AS clipped, count(*) FILTER (x BETWEEN 1 AND 6) AS inside FROM b GROUP BY ALL""")
def agg_uniform_bins(spark, sf_dir):
    """Sixteen equal bins; values outside are clipped into the outer ones, or left out."""
    r = residuals(spark, sf_dir).where("x is not null")
    inside = histogram.uniform_bin(F.col("x"), 1.0, 6.0, 16)
    return r.groupBy("event_type", histogram.clipped_bins(F.col("x"), 1.0, 6.0, 16).alias("bin")).agg(F.count("*").alias("clipped"), F.count(inside).alias("inside"))


@register("agg_circular_bins", "SELECT (CAST(floor((value - 2 * pi() * floor(value / (2 * pi()))) / (2 * pi()) * 12) AS INT)) % 12 AS bin, count(*) AS n FROM events GROUP BY 1")
def agg_circular_bins(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(histogram.circular_bin(F.col("value"), 12).alias("bin")).agg(F.count("*").alias("n"))


@register("win_quantile_groups", f"""WITH r AS ({RESIDUALS}), g AS (SELECT * FROM r WHERE x IS NOT NULL), q AS (SELECT event_type, quantile_cont(x, 0.0) AS a, quantile_cont(x, 0.1) AS b, quantile_cont(x, 0.5) AS c, quantile_cont(x, 0.9) AS d, quantile_cont(x, 1.0) AS e FROM g GROUP BY 1),
  p AS (SELECT event_type, unnest([0, 1, 2]) AS band, unnest([a, b, d]) AS low, unnest([b, c, e]) AS high FROM q)
  SELECT event_id, band::INT AS band FROM g JOIN p USING (event_type) WHERE x >= low AND x < high""")
def win_quantile_groups(spark, sf_dir):
    """Events of percentile bands 0-10, 10-50 and 90-100 of their type, half open."""
    r = residuals(spark, sf_dir).where("x is not null")
    return order.quantile_groups(r, "x", ["event_type"], [(0, 10), (10, 50), (90, 100)]).select("event_id", "band")


@register("sig_positions", f"""WITH w AS ({WAVES}), p AS (SELECT event_id, unnest(range(32)) AS i, unnest(s1) AS v FROM w)
  SELECT event_id, CAST(min(i) FILTER (v > 0.1) AS INT) AS first, CAST(max(i) FILTER (v > 0.1) AS INT) AS last, CAST(arg_max(i, v) AS INT) AS peak FROM p GROUP BY event_id""")
def sig_positions(spark, sf_dir):
    high = lambda v: v > 0.1
    return waves(spark, sf_dir).select("event_id", A.first_position(F.col("s1"), high).alias("first"), A.last_position(F.col("s1"), high).alias("last"), A.peak_index(F.col("s1")).alias("peak"))


@register("sig_baseline_quality", f"""WITH w AS ({WAVES}), p AS (SELECT event_id, unnest(range(32)) AS i, unnest(s1) AS v FROM w), c AS (SELECT event_id, stddev_pop(v) AS rms, least(min(v) + 0.3, 0.3 - max(v)) AS clearance FROM p WHERE i BETWEEN 2 AND 1 + event_id % 12 GROUP BY 1 HAVING count(*) >= 2)
  SELECT w.event_id, round(rms, 6) + 0.0 AS rms, coalesce(clearance <= 0.05, false) AS clipped, round(clearance, 6) + 0.0 AS clearance FROM w LEFT JOIN c USING (event_id)""")
def sig_baseline_quality(spark, sf_dir):
    """Stretches of none to eleven samples; those of fewer than two have no quality."""
    part = F.slice("s1", F.lit(3), (F.col("event_id") % 12).cast("int"))
    return rounded(waves(spark, sf_dir).select("event_id", A.baseline_quality(part, F.lit(-0.3), F.lit(0.3), 0.05).alias("q")).select("event_id", "q.rms", "q.clipped", "q.clearance"))


@register("sig_representations", f"""WITH w AS ({WAVES}), p AS (SELECT event_id, unnest(range(32)) AS i, unnest(s1) AS v FROM w), b AS (SELECT event_id, avg(v) FILTER (i < 8) AS level, max(v) AS top FROM p GROUP BY 1)
  SELECT event_id, unnest(['original', 'baseline_subtracted', 'peak_normalised']) AS kind, unnest([round(s, 6) + 0.0, round(s - 32 * level, 6) + 0.0, round(s / top, 6) + 0.0]) AS total FROM (SELECT event_id, sum(v) AS s FROM p GROUP BY 1) JOIN b USING (event_id)""")
def sig_representations(spark, sf_dir):
    """A waveform as it is, without its baseline, and over its peak."""
    w = waves(spark, sf_dir)
    level = A.mean(F.slice("s1", 1, 8))
    each = {"original": F.col("s1"), "baseline_subtracted": F.transform("s1", lambda v: v - level), "peak_normalised": A.peak_normalised(F.col("s1"))}
    long = w.select("event_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), A.total(x).alias("total")) for k, x in each.items()])).alias("z"))
    return rounded(long.select("event_id", "z.kind", "z.total"))


@register("match_both_sides", f"""WITH h AS ({HITS}), e AS (SELECT board, hit_id AS event, toa AS ea, toa + CAST(value * 1000000 AS BIGINT) AS eb FROM h WHERE channel = 'purchase'), t AS (SELECT board, toa AS ta, toa + CAST(value * 500000 AS BIGINT) AS tb FROM h WHERE channel = 'click')
  SELECT event, count(*) AS n, max(ta) AS latest FROM e JOIN t USING (board) WHERE ea - ta > 0 AND ea - ta < {DAY} AND eb - tb > 0 AND eb - tb < {DAY} GROUP BY event""")
def match_both_sides(spark, sf_dir):
    """Timing pairs that precede an energy pair on both sides, within a day."""
    h = hits(spark, sf_dir)
    later = lambda scale: F.col("toa") + F.rint(F.col("value") * scale).cast("long")
    energy = h.where("channel = 'purchase'").select("board", F.col("hit_id").alias("event"), F.col("toa").alias("ea"), later(1_000_000).alias("eb"))
    timing = h.where("channel = 'click'").select("board", F.col("toa").alias("ta"), later(500_000).alias("tb"))
    met = matching.both_sides(energy, timing, ["board"], ("ea", "eb"), ("ta", "tb"), DAY)
    return met.groupBy("event").agg(F.count("*").alias("n"), F.max("ta").alias("latest"))


@register("rpt_group_summary", """SELECT l_returnflag AS mode, count(*) AS hits, count(*) FILTER (l_linenumber = 9) AS never, round(count(*) FILTER (l_linenumber = 1) / nullif(count(*), 0), 6) + 0.0 AS share, NULL::DOUBLE AS of_none, round(avg(l_quantity) * 3.125, 6) + 0.0 AS mean_ps FROM lineitem GROUP BY 1""")
def rpt_group_summary(spark, sf_dir):
    """Ratios are null where there is nothing to divide by; ticks become picoseconds."""
    one, none = F.count_if(F.col("l_linenumber") == 1), F.count_if(F.col("l_linenumber") == 9)
    return rounded(read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("mode")).agg(
        F.count("*").alias("hits"), none.alias("never"), F.try_divide(one, F.count("*")).alias("share"), F.try_divide(one, none).alias("of_none"), (F.avg("l_quantity") * 3.125).alias("mean_ps")))


@register("rpt_ranked_rows", "WITH m AS (SELECT l_suppkey % 7 AS model, round(avg(l_tax), 3) AS metric FROM lineitem GROUP BY 1) SELECT row_number() OVER (ORDER BY metric, model) AS place, model, metric FROM m")
def rpt_ranked_rows(spark, sf_dir):
    """Models by their metric, equal ones by name."""
    m = read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("model")).agg(F.round(F.avg("l_tax"), 3).alias("metric"))
    return order.placed(m, [], ["metric", "model"], "place").select((F.col("place") + 1).alias("place"), "model", "metric")


@register("src_event_table", """SELECT o_orderstatus AS run, count(*) AS events, max(o_totalprice) AS top, 0.0::DOUBLE AS offset_mv, 4::BIGINT AS channels FROM orders GROUP BY 1""")
def src_event_table(spark, sf_dir):
    """Events kept by run with a table of what holds for all; a column that older tables lack comes as its default."""
    path = folder(spark)
    tables.write_events(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("run")), path, "run", {"channels": 4, "gain": 0.25})
    events, about = tables.read_events(spark, path, ["run", "o_totalprice", ("offset_mv", 0.0)])
    whole = events.groupBy("run").agg(F.count("*").alias("events"), F.max("o_totalprice").alias("top"), F.max("offset_mv").alias("offset_mv"))
    return whole.join(F.broadcast(about.select(F.col("channels").cast("long").alias("channels"))))


@register("sel_frozen_applied", """WITH t AS (SELECT event_id, event_type AS mode, value, unnest([20, 60, 150]) AS threshold, unnest([CASE WHEN value > 20 THEN ln(value) END, CASE WHEN value > 60 THEN ln(value) - 1 END, CASE WHEN value > 150 THEN ln(value) - 2 END]) AS x FROM events),
  s AS (SELECT mode, threshold, count(x) / count(*) AS efficiency, avg(x) AS mean, stddev_samp(x) AS ctr FROM t GROUP BY ALL), b AS (SELECT mode, threshold, mean FROM s WHERE efficiency >= 0.02 QUALIFY row_number() OVER (PARTITION BY mode ORDER BY s.ctr, threshold) = 1)
  SELECT event_id, threshold::DOUBLE AS threshold, round(x - mean, 6) + 0.0 AS residual FROM t JOIN b USING (mode, threshold) WHERE x IS NOT NULL""")
def sel_frozen_applied(spark, sf_dir):
    """Each mode's frozen threshold and control mean, applied to all its events."""
    e = read(spark, sf_dir, "events").withColumnRenamed("event_type", "mode")
    v, x = F.col("value"), F.ln("value")
    each = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.when(v > t, x - i).alias("x")) for i, t in enumerate((20, 60, 150))])).alias("z")
    long = e.select("event_id", "mode", each).select("event_id", "mode", "z.*")
    scan = long.groupBy("mode", "threshold").agg((F.count("x") / F.count("*")).alias("efficiency"), F.avg("x").alias("control_mean"), F.stddev_samp("x").alias("ctr"))
    rules = S.best_threshold(scan, 0.02, ["mode"])
    return rounded(long.join(rules.select("mode", "threshold", "control_mean"), ["mode", "threshold"]).where("x is not null").select("event_id", "threshold", (F.col("x") - F.col("control_mean")).alias("residual")))

