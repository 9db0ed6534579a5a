"""Queries over robust statistics and histograms."""

from __future__ import annotations

from ..operators import histogram, robust
from .registry import register
from .tables import RESIDUALS, residuals, rounded

R = f"r AS ({RESIDUALS}), g AS (SELECT event_type, x FROM r WHERE x IS NOT NULL)"
STATS = """s AS (
  SELECT event_type, n, center, CASE WHEN mad > 0 THEN mad WHEN std > 0 THEN std ELSE 1 END AS scale, mad AS raw FROM (
    SELECT event_type, center, std, n, 1.4826::DOUBLE * median(abs(x - center)) AS mad
    FROM g JOIN (SELECT event_type, median(x) AS center, stddev_samp(x) AS std, count(*) AS n FROM g GROUP BY event_type) USING (event_type) GROUP BY ALL)
)"""


@register("filter_mad", f"WITH {R}, {STATS} SELECT event_id, r.event_type, round(x, 6) + 0.0 AS x FROM r JOIN s USING (event_type) WHERE abs(x - center) <= 2 * scale")
def filter_mad(spark, sf_dir):
    return rounded(robust.mad_filter(residuals(spark, sf_dir), "x", ["event_type"], zlimit=2.0).select("event_id", "event_type", "x"))


@register("filter_alignment_z", f"WITH {R}, {STATS} SELECT event_id FROM r JOIN s USING (event_type) WHERE abs(x - center) <= 1.5 * raw")
def filter_alignment_z(spark, sf_dir):
    return robust.zscore_filter(residuals(spark, sf_dir), "x", ["event_type"], zlimit=1.5).select("event_id")


@register("filter_alignment_standard", f"""WITH {R}, s AS (SELECT event_type, avg(x) AS c, stddev_samp(x) AS d FROM g GROUP BY event_type)
  SELECT event_id FROM r JOIN s USING (event_type) WHERE abs(x - c) <= 1.5 * d""")
def filter_alignment_standard(spark, sf_dir):
    return robust.zscore_filter(residuals(spark, sf_dir), "x", ["event_type"], zlimit=1.5, method="standard").select("event_id")


@register("filter_tukey", f"""WITH {R}, q AS (SELECT event_type, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM g GROUP BY event_type)
  SELECT event_id, coalesce(x < a - 0.5 * (b - a) OR x > b + 0.5 * (b - a), false) AS outlier FROM r JOIN q USING (event_type)""")
def filter_tukey(spark, sf_dir):
    return robust.tukey_flags(residuals(spark, sf_dir), ["x"], ["event_type"], factor=0.5).select("event_id", "outlier")


@register("agg_robust_scale", f"WITH {R}, {STATS} SELECT event_type, n, round(center, 6) + 0.0 AS center, round(scale, 6) + 0.0 AS scale FROM s")
def agg_robust_scale(spark, sf_dir):
    return rounded(robust.robust_scale(residuals(spark, sf_dir), "x", ["event_type"], "std_one"))


def _q(p: float, name: str) -> str:
    return f"round(quantile_cont(x, {p}), 6) + 0.0 AS {name}"


@register("agg_five_number", f"""WITH {R} SELECT event_type, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(stddev_samp(x), 6) + 0.0 AS std,
  {_q(.5, 'median')}, {_q(.25, 'q1')}, {_q(.75, 'q3')}, {_q(.01, 'p01')}, {_q(.99, 'p99')} FROM g GROUP BY event_type""")
def agg_five_number(spark, sf_dir):
    return rounded(robust.summary(residuals(spark, sf_dir), "x", ["event_type"]))


@register("agg_residual_summary", f"""WITH {R} SELECT event_type, count(*) AS n_total, count(x) AS n_finite, round(sqrt(avg(x * x)), 6) + 0.0 AS rmse, round(avg(x), 6) + 0.0 AS mean,
  round(stddev_pop(x), 6) + 0.0 AS std, round(min(x), 6) + 0.0 AS min, round(max(x), 6) + 0.0 AS max, {_q(.01, 'q01')}, {_q(.99, 'q99')} FROM r GROUP BY event_type""")
def agg_residual_summary(spark, sf_dir):
    return rounded(robust.residual_summary(residuals(spark, sf_dir), "x", ["event_type"]))


@register("agg_rmse", f"WITH {R} SELECT event_type, round(sqrt(avg(x * x)), 6) + 0.0 AS rmse FROM r GROUP BY event_type")
def agg_rmse(spark, sf_dir):
    return rounded(robust.residual_summary(residuals(spark, sf_dir), "x", ["event_type"]).select("event_type", "rmse"))


@register("agg_moments", f"""WITH {R}, m AS (SELECT event_type, count(*) AS n, avg(x) AS mean, median(x) AS median, var_samp(x) AS variance, avg(abs(x)) AS mae,
    quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM g GROUP BY event_type),
  z AS (SELECT *, (x - mean) / sqrt(variance) AS z FROM g JOIN m USING (event_type))
  SELECT event_type, n, round(mean, 6) + 0.0 AS mean, round(median, 6) + 0.0 AS median, round(variance, 6) + 0.0 AS variance, round(mae, 6) + 0.0 AS mae, round(iqr, 6) + 0.0 AS iqr,
    round(median(abs(x - median)), 6) + 0.0 AS mad, round(avg(z * z * z), 6) + 0.0 AS skew, round(avg(z * z * z * z) - 3, 6) + 0.0 AS kurtosis,
    round(avg(CASE WHEN abs(z) > 2 THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS beyond_2, round(avg(CASE WHEN abs(z) > 3 THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS beyond_3 FROM z GROUP BY ALL""")
def agg_moments(spark, sf_dir):
    return rounded(robust.moments(residuals(spark, sf_dir), "x", ["event_type"]))


def _clip_sql(rounds: int) -> str:
    parts = [f"k0 AS (SELECT event_type, x FROM ({RESIDUALS}) WHERE x IS NOT NULL)"]
    for i in range(rounds):
        parts.append(f"""c{i} AS (SELECT event_type, median(x) AS c, stddev_samp(x) AS d FROM k{i} GROUP BY event_type),
  m{i} AS (SELECT event_type, c, CASE WHEN m > 0 THEN m WHEN d > 0 THEN d ELSE 1 END AS s FROM (
    SELECT event_type, c, d, 1.4826::DOUBLE * median(abs(x - c)) AS m FROM k{i} JOIN c{i} USING (event_type) GROUP BY ALL)),
  e{i} AS (SELECT event_type, count(*) FILTER (abs(x - c) <= 1.5 * s) >= 10 AS go FROM k{i} JOIN m{i} USING (event_type) GROUP BY event_type),
  k{i + 1} AS (SELECT event_type, x FROM k{i} JOIN m{i} USING (event_type) JOIN e{i} USING (event_type) WHERE abs(x - c) <= 1.5 * s OR NOT go)""")
    return "WITH " + ",\n".join(parts) + f" SELECT event_type, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(stddev_samp(x), 6) + 0.0 AS std FROM k{rounds} GROUP BY event_type"


@register("agg_average_delay", _clip_sql(4))
def agg_average_delay(spark, sf_dir):
    return rounded(robust.clipped_mean(residuals(spark, sf_dir), "x", ["event_type"], zlimit=1.5, rounds=4))


WIDTH = 0.25
HIST = f"""l AS (SELECT event_type, CAST(floor(min(x) / {WIDTH} + 0.5) AS BIGINT) AS a, CAST(greatest(floor(min(x) / {WIDTH} + 0.5), ceil(max(x) / {WIDTH} - 0.5)) AS BIGINT) AS b FROM g GROUP BY event_type),
c AS (SELECT event_type, least(CAST(floor(x / {WIDTH} + 0.5) AS BIGINT), b) AS bin, count(*) AS n FROM g JOIN l USING (event_type) GROUP BY ALL),
h AS (SELECT event_type, bin, (bin - 0.5) * {WIDTH} AS "left", coalesce(n, 0) AS n FROM (SELECT event_type, unnest(range(a, b + 1)) AS bin FROM l) LEFT JOIN c USING (event_type, bin))"""


@register("agg_histogram", f'WITH {R}, {HIST} SELECT event_type, bin, round("left", 6) + 0.0 AS "left", n FROM h')
def agg_histogram(spark, sf_dir):
    return rounded(histogram.binned(residuals(spark, sf_dir), "x", ["event_type"], WIDTH))


def _fwhm_sql(source: str, pedestal: float = 0.0) -> str:
    n = f"greatest(0, n - {pedestal * WIDTH}::DOUBLE)" if pedestal else "n"
    return f"""WITH {source}, {HIST}, w AS (SELECT event_type, bin, {n} AS n FROM h),
t AS (SELECT *, max(n) OVER (PARTITION BY event_type) AS top FROM w),
i AS (SELECT *, sum((n = top)::INT) OVER (PARTITION BY event_type ORDER BY bin) AS nth, sum((n = top)::INT) OVER (PARTITION BY event_type) AS tops,
  lead(n) OVER (PARTITION BY event_type ORDER BY bin) AS nx, lag(n) OVER (PARTITION BY event_type ORDER BY bin) AS pv FROM t),
p AS (SELECT *, max(CASE WHEN n = top AND nth = tops // 2 + 1 THEN bin END) OVER (PARTITION BY event_type) AS pk FROM i),
f AS (SELECT event_type, sum(n) AS n, count(*) AS bins, max(top) AS peak_n, max(pk) AS pk, min(bin) AS b0, max(bin) AS b1,
  arg_max((bin + (top / 2 - n) / (nx - n)) * {WIDTH}, bin) FILTER (bin < pk AND n < top / 2) AS l, arg_min((bin - (top / 2 - n) / (pv - n)) * {WIDTH}, bin) FILTER (bin > pk AND n < top / 2) AS r FROM p GROUP BY event_type),
o AS (SELECT *, n >= 5 AND bins >= 3 AND pk > b0 AND pk < b1 AND l IS NOT NULL AND r IS NOT NULL AS success FROM f)
SELECT event_type, {'round(n, 6) + 0.0' if pedestal else 'CAST(n AS BIGINT)'} AS n, bins, {'round(peak_n, 6) + 0.0' if pedestal else 'peak_n'} AS peak_n, round(pk * {WIDTH}, 6) + 0.0 AS peak, round(CASE WHEN success THEN l END, 6) + 0.0 AS left_half,
  round(CASE WHEN success THEN r END, 6) + 0.0 AS right_half, round(CASE WHEN success THEN r - l END, 6) + 0.0 AS fwhm, success FROM o"""


@register("agg_f1_fwhm", _fwhm_sql(f"r AS ({RESIDUALS}), g0 AS (SELECT event_type, x FROM r WHERE x IS NOT NULL), {STATS.replace('FROM g ', 'FROM g0 ').replace('JOIN (SELECT event_type, median(x) AS center, stddev_samp(x) AS std, count(*) AS n FROM g ', 'JOIN (SELECT event_type, median(x) AS center, stddev_samp(x) AS std, count(*) AS n FROM g0 ')}, g AS (SELECT event_type, x FROM g0 JOIN s USING (event_type) WHERE abs(x - center) <= 4 * scale)"))
def agg_f1_fwhm(spark, sf_dir):
    """Outlier filter, fixed-phase histogram and direct width per group: the flagship query."""
    kept = robust.mad_filter(residuals(spark, sf_dir), "x", ["event_type"], zlimit=4.0)
    return rounded(histogram.fwhm(kept, "x", ["event_type"], WIDTH))


@register("agg_fwhm_without_pedestal", _fwhm_sql(R, 40.0))
def agg_fwhm_without_pedestal(spark, sf_dir):
    hist = histogram.binned(residuals(spark, sf_dir), "x", ["event_type"], WIDTH)
    return rounded(histogram.half_maximum_width(histogram.without_pedestal(hist, ["event_type"], 40.0, WIDTH), ["event_type"], WIDTH))


@register("agg_binned_profile", """WITH g AS (SELECT o_orderpriority AS grp, extract('epoch' FROM o_orderdate)::DOUBLE / 86400 AS x, o_totalprice AS y FROM orders),
  s AS (SELECT grp, min(x) AS a, max(x) AS b, least(40, greatest(10, floor(sqrt(count(*)))))::INT AS k FROM g GROUP BY grp)
  SELECT grp, coalesce(least(k - 1, floor((x - a) / nullif((b - a) / k, 0))), 0)::INT AS bin, count(*) AS n, round(median(x), 6) + 0.0 AS x_median, round(median(y), 6) + 0.0 AS y_median,
    round(stddev_samp(y), 6) + 0.0 AS y_std FROM g JOIN s USING (grp) GROUP BY ALL HAVING count(*) >= 20""")
def agg_binned_profile(spark, sf_dir):
    from pyspark.sql import functions as F

    from .tables import read

    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6 / 86400).alias("x"), F.col("o_totalprice").alias("y"))
    return rounded(histogram.profile(o, "x", "y", ["grp"]))
