"""Queries over waveform arrays and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import scalars as S
from .registry import register
from .tables import WAVES, read, rounded, waves

W = f"w AS ({WAVES}), p AS (SELECT event_id, unnest(range(32)) AS i, unnest(s1) AS v, unnest(s2) AS u FROM w)"
LEVEL = 0.05


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def _list(expr: str, name: str) -> str:
    """A list as text, rounded alike in both engines."""
    return f"array_to_string(list_transform({expr}, lambda x: CAST(round(x * 1000000) AS BIGINT)), ',') AS {name}"


def _longs(c):
    return F.array_join(F.transform(c, lambda x: F.round(x * 1000000).cast("long").cast("string")), ",")


@register("sig_calibrate", f"WITH {W} SELECT event_id, {_list('list_transform(s1, lambda v: -1 * ((v * 0.25 - 0.125) * 1000))', 'mv')} FROM w")
def sig_calibrate(spark, sf_dir):
    return waves(spark, sf_dir).select("event_id", _longs(A.calibrate(F.col("s1"), F.lit(0.25), F.lit(0.125), -1)).alias("mv"))


@register("sig_baseline", f"""WITH {W} SELECT event_id, {_r('avg(v) FILTER (i BETWEEN 2 AND 9)', 'level')}, {_r('stddev_pop(v) FILTER (i BETWEEN 2 AND 9)', 'rms')},
  least(min(v) + 0.3, 0.3 - max(v)) <= 0.02 AS clipped FROM p GROUP BY event_id""")
def sig_baseline(spark, sf_dir):
    part = A.window(F.col("s1"), F.lit(2), F.lit(9))
    return rounded(waves(spark, sf_dir).select("event_id", A.finite_mean(part).alias("level"), A.rms(part).alias("rms"), A.clipped(F.col("s1"), F.lit(-0.3), F.lit(0.3), 0.02).alias("clipped")))


@register("sig_amplitude", f"WITH {W} SELECT event_id, {_r('max(v)', 'amplitude')}, CAST(arg_max(i, v) AS INT) AS peak FROM p GROUP BY event_id")
def sig_amplitude(spark, sf_dir):
    return rounded(waves(spark, sf_dir).select("event_id", F.array_max("s1").alias("amplitude"), A.peak_index(F.col("s1")).alias("peak")))


STEPS = "q AS (SELECT event_id, i, v, lead(v) OVER (PARTITION BY event_id ORDER BY i) AS nx FROM p)"


@register("sig_led_crossing", f"""WITH {W}, {STEPS} SELECT w.event_id, {_r(f'arg_max(i + ({LEVEL} - v) / (nx - v), i)', 't')} FROM w LEFT JOIN (SELECT * FROM q WHERE i BETWEEN 4 AND 27 AND v < {LEVEL} AND nx >= {LEVEL}) USING (event_id) GROUP BY 1""")
def sig_led_crossing(spark, sf_dir):
    return rounded(waves(spark, sf_dir).select("event_id", A.last_crossing(F.col("s1"), F.lit(LEVEL), F.lit(4), F.lit(28)).alias("t")))


@register("sig_led_grid", f"""WITH {W}, {STEPS}, l AS (SELECT unnest([0.0, 0.05, 0.1])::DOUBLE AS level), c AS (SELECT event_id, level, {_r('arg_max(i + (level - v) / (nx - v), i)', 't')} FROM q, l WHERE v < level AND nx >= level GROUP BY ALL)
  SELECT level, count(*) AS n, {_r('avg(t)', 'mean_t')} FROM c GROUP BY level""")
def sig_led_grid(spark, sf_dir):
    grid = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.05, 0.1)])).alias("level")
    t = F.round(A.last_crossing(F.col("s1"), F.col("level"), F.lit(0), F.lit(31)), 6)
    return rounded(waves(spark, sf_dir).select("s1", grid).select("level", t.alias("t")).where("t is not null").groupBy("level").agg(F.count("*").alias("n"), F.avg("t").alias("mean_t")))


@register("sig_first_crossing", f"WITH {W}, {STEPS} SELECT event_id, {_r(f'arg_min(i + ({LEVEL} - v) / (nx - v), i)', 't')} FROM q WHERE v < {LEVEL} AND nx >= {LEVEL} GROUP BY 1")
def sig_first_crossing(spark, sf_dir):
    return rounded(waves(spark, sf_dir).select("event_id", A.first_crossing(F.col("s1"), F.lit(LEVEL)).alias("t")).where("t is not null"))


@register("sig_cfd", f"""WITH {W}, {STEPS}, m AS (SELECT event_id, 0.5 * max(v) AS level, arg_max(i, v) AS pk FROM p GROUP BY event_id)
  SELECT event_id, {_r('arg_max(i + (level - v) / (nx - v), i)', 't')} FROM q JOIN m USING (event_id) WHERE i < pk AND v < level AND nx >= level GROUP BY 1""")
def sig_cfd(spark, sf_dir):
    t = A.fraction_crossing(F.col("s1"), F.lit(0.5), F.lit(0))
    return rounded(waves(spark, sf_dir).select("event_id", t.alias("t"), F.array_max("s1").alias("m")).where("t is not null").select("event_id", "t"))


@register("sig_pulses", f"""WITH {W}, {STEPS}, u AS (SELECT event_id, i, i + ({LEVEL} - v) / (nx - v) AS rise FROM q WHERE v < {LEVEL} AND nx >= {LEVEL}), d AS (SELECT event_id, i, i + ({LEVEL} - v) / (nx - v) AS fall FROM q WHERE v >= {LEVEL} AND nx < {LEVEL})
  SELECT u.event_id, {_r('rise', 'rise')}, {_r('arg_min(fall, d.i)', 'fall')} FROM u LEFT JOIN d ON u.event_id = d.event_id AND d.i > u.i GROUP BY u.event_id, rise""")
def sig_pulses(spark, sf_dir):
    return rounded(waves(spark, sf_dir).select("event_id", F.explode(A.pulses(F.col("s1"), F.lit(LEVEL))).alias("p")).select("event_id", "p.rise", "p.fall"))


@register("sig_pair_delta", f"""WITH {W}, q AS (SELECT event_id, i, v, u, lead(v) OVER x AS nv, lead(u) OVER x AS nu FROM p WINDOW x AS (PARTITION BY event_id ORDER BY i)),
  t AS (SELECT event_id, arg_max(i + ({LEVEL} - v) / (nv - v), i) FILTER (v < {LEVEL} AND nv >= {LEVEL}) AS t1, arg_max(i + ({LEVEL} - u) / (nu - u), i) FILTER (u < {LEVEL} AND nu >= {LEVEL}) AS t2 FROM q GROUP BY event_id)
  SELECT event_id, {_r('(t1 - t2) * 50 - 12', 'residual', 4)} FROM t WHERE t1 IS NOT NULL AND t2 IS NOT NULL AND abs((t1 - t2) * 50 - 12) <= 800""")
def sig_pair_delta(spark, sf_dir):
    """LED pair difference in ps minus a known flight time, inside the coincidence window."""
    t = lambda c: A.last_crossing(F.col(c), F.lit(LEVEL), F.lit(0), F.lit(31))
    r = waves(spark, sf_dir).select("event_id", ((t("s1") - t("s2")) * 50 - 12).alias("residual"))
    return rounded(r.where(F.abs("residual") <= 800), 4)


@register("sig_detrend", f"""WITH {W}, f AS (SELECT event_id, avg(v) AS m, sum(v * (-1 + 2.0::DOUBLE * i / 31)) / sum((-1 + 2.0::DOUBLE * i / 31) ** 2) AS s FROM p GROUP BY event_id)
  SELECT event_id, {_r('max(abs(v - m - s * (-1 + 2.0::DOUBLE * i / 31)))', 'largest')}, {_r('sqrt(avg((v - m - s * (-1 + 2.0::DOUBLE * i / 31)) ** 2))', 'rms')} FROM p JOIN f USING (event_id) GROUP BY event_id""")
def sig_detrend(spark, sf_dir):
    d = waves(spark, sf_dir).select("event_id", A.detrended(F.col("s1")).alias("d"))
    return rounded(d.select("event_id", F.array_max(F.transform("d", lambda v: F.abs(v))).alias("largest"), F.sqrt(A.mean(F.transform("d", lambda v: v * v))).alias("rms")))


@register("sig_projection", f"""WITH {W}, f AS (SELECT event_id, avg(v) AS m, sum(v * (-1 + 2.0::DOUBLE * i / 31)) / sum((-1 + 2.0::DOUBLE * i / 31) ** 2) AS s FROM p GROUP BY event_id),
  d AS (SELECT event_id, i, v - m - s * (-1 + 2.0::DOUBLE * i / 31) AS v, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 31) AS h FROM p JOIN f USING (event_id))
  SELECT event_id, {_r('2 / sum(h) * sum(v * h * cos(2 * pi() * 0.125 * i))', 're')}, {_r('-2 / sum(h) * sum(v * h * sin(2 * pi() * 0.125 * i))', 'im')} FROM d GROUP BY event_id""")
def sig_projection(spark, sf_dir):
    p = waves(spark, sf_dir).select("event_id", A.projection(F.col("s1"), 0.125, 32).alias("p"))
    return rounded(p.select("event_id", "p.re", "p.im"))


@register("sig_normalise", f"WITH {W} SELECT event_id, {_list('list_transform(s1, lambda v: least(1, greatest(0, (v + 0.2) / 0.4)))', 'x')} FROM w")
def sig_normalise(spark, sf_dir):
    return waves(spark, sf_dir).select("event_id", _longs(A.normalised(F.col("s1"), F.lit(-0.2), F.lit(0.2))).alias("x"))


@register("sig_detector_difference", f"WITH {W} SELECT event_id, {_r('sum(v - u)', 'total')}, {_r('max(v - u)', 'largest')} FROM p GROUP BY event_id")
def sig_detector_difference(spark, sf_dir):
    d = waves(spark, sf_dir).select("event_id", A.difference(F.col("s1"), F.col("s2")).alias("d"))
    return rounded(d.select("event_id", A.total(F.col("d")).alias("total"), F.array_max("d").alias("largest")))


@register("sig_first_difference", f"WITH {W} SELECT event_id, {_r('sum(abs(coalesce(v - b, 0)))', 'variation')} FROM (SELECT event_id, v, lag(v) OVER (PARTITION BY event_id ORDER BY i) AS b FROM p) GROUP BY 1")
def sig_first_difference(spark, sf_dir):
    return rounded(waves(spark, sf_dir).select("event_id", A.total(F.transform(A.first_difference(F.col("s1")), lambda v: F.abs(v))).alias("variation")))


@register("sig_prefixes", f"WITH {W}, k AS (SELECT unnest([16, 20, 24, 28, 32]) AS k) SELECT event_id, k::INT AS k, {_r('avg(v)', 'mean')} FROM p, k WHERE i < k GROUP BY ALL")
def sig_prefixes(spark, sf_dir):
    """Growing windows of at least 16 samples."""
    w = waves(spark, sf_dir).select("event_id", "s1", F.explode(F.sequence(F.lit(16), F.lit(32), F.lit(4))).alias("k"))
    return rounded(w.select("event_id", "k", A.mean(F.slice("s1", F.lit(1), F.col("k"))).alias("mean")))


@register("sig_sample_moments", f"WITH {W} SELECT i::INT AS pos, {_r('avg(v)', 'mean')}, {_r('greatest(stddev_pop(v), 0.05 * (SELECT sqrt(avg(s * s)) FROM (SELECT stddev_pop(v) AS s FROM p GROUP BY i)))', 'std')} FROM p GROUP BY i")
def sig_sample_moments(spark, sf_dir):
    """Mean and std of each time sample, the std not below 5 % of the detector's typical one."""
    s = waves(spark, sf_dir).select(F.posexplode("s1").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    floor = s.agg(0.05 * F.sqrt(F.avg(F.col("std") * F.col("std")))).scalar()
    return rounded(s.select("pos", "mean", F.greatest("std", floor).alias("std")))


@register("sig_sample_mask", f"""WITH {W}, m AS (SELECT i, avg((v > 0.15 AND u > 0.15)::INT) AS f FROM p GROUP BY i) SELECT i::INT AS pos, f < 0.02 AS kept FROM m""")
def sig_sample_mask(spark, sf_dir):
    """Time samples that both detectors clip in 2 % of events or more are masked."""
    both = waves(spark, sf_dir).select(F.posexplode(F.arrays_zip("s1", "s2")).alias("pos", "x"))
    share = F.avg(((F.col("x.s1") > 0.15) & (F.col("x.s2") > 0.15)).cast("double"))
    return both.groupBy("pos").agg((share < 0.02).alias("kept"))


@register("sig_target_heatmap", f"""WITH {W} SELECT i::INT AS pos, floor((v + 0.5) * 10)::INT AS bin, count(*) AS n, {_r('sum(y)', 'total')} FROM p JOIN w USING (event_id) WHERE v BETWEEN -0.5 AND 0.5 GROUP BY ALL""")
def sig_target_heatmap(spark, sf_dir):
    s = waves(spark, sf_dir).select("y", F.posexplode("s1").alias("pos", "v")).where("v between -0.5 and 0.5")
    return rounded(s.groupBy("pos", F.least(F.lit(9), F.floor((F.col("v") + 0.5) * 10)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("total")))


@register("sig_group_waveforms", f"WITH {W} SELECT y AS band, i::INT AS pos, {_r('avg(v)', 'mean')}, {_r('stddev_pop(v)', 'std')} FROM p JOIN w USING (event_id) GROUP BY ALL")
def sig_group_waveforms(spark, sf_dir):
    s = waves(spark, sf_dir).select(F.col("y").alias("band"), F.posexplode("s1").alias("pos", "v"))
    return rounded(s.groupBy("band", "pos").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")))


@register("sig_interpolate", f"WITH {W} SELECT event_id, {_r('max(v) FILTER (i = 9) + (max(v) FILTER (i = 14) - max(v) FILTER (i = 9)) * 2 / 5', 'x11')} FROM p GROUP BY event_id")
def sig_interpolate(spark, sf_dir):
    return rounded(waves(spark, sf_dir).select("event_id", F.get(A.interpolated(F.col("s1"), F.lit(10), F.lit(13)), F.lit(11)).alias("x11")))


@register("sig_hermite", f"""WITH w AS ({WAVES}), v AS (SELECT event_id, unnest(range(32)) AS i, unnest(s1) AS v, s1[10] AS p0, s1[15] AS p1, (s1[10] - s1[9]) * 5 AS m0, (s1[16] - s1[15]) * 5 AS m1 FROM w), t AS (SELECT *, (i - 9) / 5 AS t FROM v)
  SELECT event_id, i::INT AS i, round(CASE WHEN i BETWEEN 10 AND 13 THEN (2 * t ** 3 - 3 * t ** 2 + 1) * p0 + (t ** 3 - 2 * t ** 2 + t) * m0 + (3 * t ** 2 - 2 * t ** 3) * p1 + (t ** 3 - t ** 2) * m1 ELSE v END, 6) + 0.0 AS x FROM t""")
def sig_hermite(spark, sf_dir):
    filled = A.hermite(F.col("s1"), F.lit(10), F.lit(13))
    return rounded(waves(spark, sf_dir).select("event_id", F.posexplode(filled).alias("i", "x")))


@register("sig_pickoff", f"""WITH {W}, {STEPS}, k AS (SELECT event_id, arg_max(i, v) AS top FROM p GROUP BY event_id), l AS (SELECT unnest([0.02, 0.04, 0.06, 0.08])::DOUBLE AS level),
  c AS (SELECT event_id, level, coalesce(arg_max(i + (level - v) / (nx - v), i) FILTER (v < level AND nx >= level), arg_max(i::DOUBLE, i) FILTER (v = level AND nx > level)) AS t FROM q JOIN k USING (event_id), l WHERE i < top GROUP BY ALL),
  r AS (SELECT event_id, t, level, t > lag(t) OVER (PARTITION BY event_id ORDER BY level) AS rises FROM c WHERE t IS NOT NULL),
  f AS (SELECT event_id, count(*) AS n, bool_and(coalesce(rises, true)) AS up, min(t) AS first, regr_slope(t, level) AS slope, regr_intercept(t, level) AS t0 FROM r GROUP BY event_id),
  g AS (SELECT event_id, t0, slope FROM f WHERE n = 4 AND up AND slope > 0 AND t0 < first)
  SELECT w.event_id, {_r('t0', 't0')}, {_r('slope', 'slope', 3)} FROM w LEFT JOIN g USING (event_id)""")
def sig_pickoff(spark, sf_dir):
    found = waves(spark, sf_dir).select("event_id", A.pickoff_line(F.col("s1"), [0.02, 0.04, 0.06, 0.08]).alias("p")).select("event_id", "p.t0", "p.slope")
    return found.select("event_id", (F.round("t0", 6) + 0.0).alias("t0"), (F.round("slope", 3) + 0.0).alias("slope"))


@register("fn_units", "SELECT o_orderkey, greatest(1, ceil(o_totalprice * 1000 / 3125.0::DOUBLE))::BIGINT AS ticks FROM orders")
def fn_units(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", S.ns_to_ticks(F.col("o_totalprice"), F.lit(3125.0)).alias("ticks"))


@register("fn_identifier", "SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS ident, regexp_replace(regexp_replace(s_name, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS part FROM supplier")
def fn_identifier(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", S.identifier(F.col("s_name")).alias("ident"), S.path_part(F.col("s_name")).alias("part"))


@register("fn_regex_extract", "SELECT page_id, regexp_extract(url, '(?i)/(en|fr|de|es)/0*([0-9]+)', 2) AS run FROM pages")
def fn_regex_extract(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "(?i)/(en|fr|de|es)/0*([0-9]+)", 2).alias("run"))


@register("fn_tri_state", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F') THEN true WHEN o_orderstatus IN ('O') THEN false END::VARCHAR AS flag FROM orders")
def fn_tri_state(spark, sf_dir):
    word = F.when(F.col("o_orderstatus") == "F", "Yes ").when(F.col("o_orderstatus") == "O", " off").otherwise("?")
    return read(spark, sf_dir, "orders").select("o_orderkey", S.tri_state(word).cast("string").alias("flag"))


@register("fn_number_format", r"SELECT n_nationkey, replace(format('{:,}', n_nationkey * 1234567), ',', '\,') AS t FROM nation")
def fn_number_format(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", S.thousands(F.col("n_nationkey") * 1234567).alias("t"))


@register("fn_latex", r"SELECT doc_id, replace(replace(replace(replace(text, '&', '\&'), '%', '\%'), '$', '\$'), '#', '\#') AS t FROM documents WHERE NOT regexp_matches(text, '[\\_{}~^]')")
def fn_latex(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(~F.col("text").rlike(r"[\\_{}~^]")).select("doc_id", S.latex(F.col("text")).alias("t"))


@register("fn_string_list", "SELECT n_regionkey, string_agg(DISTINCT n_nationkey::VARCHAR, ';' ORDER BY n_nationkey::VARCHAR) AS ids FROM nation GROUP BY 1")
def fn_string_list(spark, sf_dir):
    return read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(S.joined(F.col("n_nationkey")).alias("ids"))


@register("fn_enum", "SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 255 END::SMALLINT AS code FROM events")
def fn_enum(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", S.encode(F.col("event_type"), {"view": 0, "click": 1}).alias("code"))


@register("fn_candidate_id", """SELECT n_nationkey, substr(sha256('"n_nationkey":{"v":' || n_nationkey || '},"n_regionkey":{"v":' || n_regionkey || '}'), 1, 12) AS id FROM nation""")
def fn_candidate_id(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", S.candidate_id(["n_regionkey", "n_nationkey"]).alias("id"))


@register("fn_json", """SELECT event_id, json_extract_string(props, '$.k') AS k, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS doc FROM events""")
def fn_json(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("doc"))


@register("fn_circular", f"SELECT event_type, {_r('atan2(avg(sin(value)), avg(cos(value)))', 'mean')}, {_r('sqrt(avg(sin(value)) ** 2 + avg(cos(value)) ** 2)', 'length')} FROM events GROUP BY 1")
def fn_circular(spark, sf_dir):
    return rounded(read(spark, sf_dir, "events").groupBy("event_type").agg(S.circular_mean(F.col("value")).alias("mean"), S.resultant(F.col("value")).alias("length")))


@register("fn_gaussian", f"SELECT l_orderkey, l_linenumber, {_r('2 * exp(-0.5 * ((l_quantity - 25) / 7) ** 2)', 'g')} FROM lineitem")
def fn_gaussian(spark, sf_dir):
    return rounded(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.gaussian(F.col("l_quantity"), F.lit(2.0), F.lit(25.0), F.lit(7.0)).alias("g")))
