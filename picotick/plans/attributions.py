"""Queries over attribution, spectra and match roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attribution as X
from ..operators import matching, ranking
from ..operators import models as M
from .matches import DAY, _leads
from .modelling import SHAPLEY, _linear_predict, predicted_sql, ridge_sql, xai_window_shapley
from .registry import register
from .tables import HITS, WAVES, read, rounded, waves


@register("xai_deletion_curve", f"""WITH RECURSIVE {SHAPLEY}, o AS (SELECT id, start, row_number() OVER (PARTITION BY id ORDER BY phi DESC, start) AS r FROM h),
  c AS (SELECT id, r, list_sum(list_transform(range(start + 1, start + 9), lambda i: ws[i] * s1[i])) AS part, w0 FROM o JOIN w ON event_id = id, b), t AS (SELECT unnest(range(5)) AS step)
  SELECT id, step::INT AS step, round(any_value(w0) + coalesce(sum(part) FILTER (r > step), 0), 6) + 0.0 AS prediction FROM c, t GROUP BY id, step""")
def xai_deletion_curve(spark, sf_dir):
    w = waves(spark, sf_dir)
    predict = _linear_predict(M.fit_ridge(w, "s1", "y", 4.0))
    return rounded(X.deletion_curve(w, "event_id", "s1", xai_window_shapley(spark, sf_dir), 8, [0.0] * 32, predict))


@register("xai_representatives", f"""WITH RECURSIVE w AS ({WAVES}), {ridge_sql("s1", 32, "4")}, p AS (SELECT event_id, y - 4.5::DOUBLE AS t, {predicted_sql("s1")} - 4.5::DOUBLE AS p FROM w),
  g AS (SELECT event_id AS id, abs(t) - abs(t - p) AS gain, t >= 0 AS positive FROM p), r AS (SELECT *, gain >= 0 AS better, row_number() OVER (PARTITION BY positive, gain >= 0 ORDER BY gain, id) - 1 AS rank, count(*) OVER (PARTITION BY positive, gain >= 0) AS n FROM g),
  a AS (SELECT *, abs(rank - quantile * (n - 1)) AS far FROM r, (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS quantile))
  SELECT positive, better, quantile, id, rank::INT AS rank, round(gain, 6) + 0.0 AS gain FROM a QUALIFY row_number() OVER (PARTITION BY positive, better, quantile ORDER BY far, a.rank) = 1""")
def xai_representatives(spark, sf_dir):
    w = waves(spark, sf_dir)
    p = w.select("event_id", (F.col("y") - 4.5).alias("t"), (M.linear(F.col("s1"), M.fit_ridge(w, "s1", "y", 4.0)) - 4.5).alias("p"))
    return rounded(X.representatives(p, "event_id", "t", "p", [0.1, 0.5, 0.9]))


@register("sig_peak_frequency", f"""WITH w AS ({WAVES}), v AS (SELECT event_id, i, -1 + 2 * i / 31 AS t, v - avg(v) OVER (PARTITION BY event_id) AS v, 0.5 - 0.5 * cos(2 * pi() * i / 31) AS h FROM (SELECT event_id, unnest(s1) AS v, unnest(range(32)) AS i FROM w)),
  l AS (SELECT event_id, i, h, h * (v - t * sum(v * t) OVER (PARTITION BY event_id) / sum(t * t) OVER (PARTITION BY event_id)) AS d FROM v),
  f AS (SELECT event_id, k, sum(d * cos(2 * pi() * k * i / 128)) AS re, -sum(d * sin(2 * pi() * k * i / 128)) AS im, 2 / sum(h) AS gain FROM l, range(7, 58) t(k) GROUP BY ALL)
  SELECT event_id AS id, round(k / 128, 6) + 0.0 AS frequency, round(atan2(im, re), 6) + 0.0 AS phase, round(gain * sqrt(re * re + im * im), 6) + 0.0 AS amplitude FROM f QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY re * re + im * im DESC, k) = 1""")
def sig_peak_frequency(spark, sf_dir):
    return rounded(X.peak_frequency(waves(spark, sf_dir), "event_id", "s1", 0.05, 0.45))


@register("sig_circular_regression", """WITH m AS (SELECT covar_pop(sin(value), sin(value)) AS ss, covar_pop(cos(value), cos(value)) AS cc, covar_pop(sin(value), cos(value)) AS sc, covar_pop(sin(value), user_id) AS sy, covar_pop(cos(value), user_id) AS cy,
  var_pop(user_id) AS yy, avg(sin(value)) AS ms, avg(cos(value)) AS mc, avg(user_id) AS my FROM events), f AS (SELECT *, (sy * cc - cy * sc) / (ss * cc - sc * sc) AS a, (cy * ss - sy * sc) / (ss * cc - sc * sc) AS b FROM m)
  SELECT round(a, 6) + 0.0 AS sin, round(b, 6) + 0.0 AS cos, round(my - a * ms - b * mc, 6) + 0.0 AS intercept, round((a * sy + b * cy) / yy, 6) + 0.0 AS r2 FROM f""")
def sig_circular_regression(spark, sf_dir):
    return rounded(X.circular_regression(read(spark, sf_dir, "events").withColumn("y", F.col("user_id").cast("double")), "value", "y"))


@register("ml_regression_tree")
def ml_regression_tree(spark, sf_dir):
    """Out-of-fold predictions: every event by the tree that was grown on the other folds."""
    w = ranking.folds(waves(spark, sf_dir), "event_id", 3, "tree")
    each = [X.regression_tree(w.where(F.col("fold_id") != k), w.where(F.col("fold_id") == k), "s1", "y", "event_id") for k in (1, 2, 3)]
    return rounded(reduce(DataFrame.unionByName, each))


@register("rpt_latex_rows", r"SELECT replace(n_name, '_', '\_') || ' & ' || n_regionkey || ' \\' AS line FROM nation")
def rpt_latex_rows(spark, sf_dir):
    return X.latex_rows(read(spark, sf_dir, "nation").orderBy("n_nationkey"), ["n_name", "n_regionkey"])


@register("match_rollup", f"""WITH h AS ({HITS}), c AS (SELECT e.hit_id AS energy_id, t.channel AS side, min(e.toa - t.toa) AS delay FROM h e JOIN h t ON e.board = t.board AND e.channel = 'purchase' AND t.channel IN ('click', 'view')
  AND t.toa > e.toa - {DAY} AND t.toa < e.toa GROUP BY ALL), p AS (SELECT energy_id, max(delay) FILTER (side = 'click') AS a, max(delay) FILTER (side = 'view') AS b FROM c GROUP BY 1)
  SELECT count(*) AS events, count(a) AS with_a, count(b) AS with_b, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both_sides, round(avg(b - a), 3) + 0.0 AS timing FROM p""")
def match_rollup(spark, sf_dir):
    """Long rows per side to one row per event, then to a summary."""
    sides = None
    for channel in ("click", "view"):
        c = matching.window_join(_leads(spark, sf_dir, "purchase", "energy"), _leads(spark, sf_dir, channel, "timing"), ["board"], "energy", "timing", DAY)
        c = c.groupBy("energy_id").agg(F.min(F.col("energy") - F.col("timing")).alias("delay")).withColumn("side", F.lit(channel))
        sides = c if sides is None else sides.unionByName(c)
    p = sides.groupBy("energy_id").pivot("side", ["click", "view"]).agg(F.max("delay"))
    return rounded(p.agg(F.count("*").alias("events"), F.count("click").alias("with_a"), F.count("view").alias("with_b"), F.count_if(F.col("click").isNotNull() & F.col("view").isNotNull()).alias("both_sides"), F.avg(F.col("view") - F.col("click")).alias("timing")), 3)
