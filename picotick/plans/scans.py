"""Queries over scans, calibration, windows of samples and match builders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import matching, robust
from ..operators import selection as S
from .matches import DAY, _leads, nearest_sql, walk_sql
from .registry import register
from .tables import HITS, PAIRS, RESIDUALS, WAVES, hits, pairs, read, residuals, rounded, waves


@register("fn_prediction_clip", "SELECT event_id, round(greatest(-60, least(60, value - 100)), 6) + 0.0 AS clipped FROM events")
def fn_prediction_clip(spark, sf_dir):
    return rounded(read(spark, sf_dir, "events").select("event_id", S.clipped_prediction(F.col("value") - 100, 60).alias("clipped")))


FENCES = "q AS (SELECT quantile_cont(a, 0.25) AS a1, quantile_cont(a, 0.75) AS a3, quantile_cont(b, 0.25) AS b1, quantile_cont(b, 0.75) AS b3 FROM p)"


@register("set_outliers", f"""WITH p AS ({PAIRS}), {FENCES}, f AS (SELECT a < a1 - 0.5 * (a3 - a1) OR a > a3 + 0.5 * (a3 - a1) AS x, b < b1 - 0.5 * (b3 - b1) OR b > b3 + 0.5 * (b3 - b1) AS y FROM p, q)
  SELECT count(*) FILTER (x OR y) AS either, count(*) FILTER (x AND y) AS both, count(*) FILTER (x AND NOT y) AS only_first, count(*) FILTER (y AND NOT x) AS only_second, count(*) FILTER (NOT x AND NOT y) AS core FROM f""")
def set_outliers(spark, sf_dir):
    p = pairs(spark, sf_dir)
    a = robust.tukey_flags(p, ["a"], [], 0.5).withColumnRenamed("outlier", "x")
    f = robust.tukey_flags(a, ["b"], [], 0.5)
    sets = S.outlier_sets(f, F.col("x"), F.col("outlier"))
    return sets.agg(*[F.count_if(F.col(c)).alias(c) for c in ("either", "both", "only_first", "only_second", "core")])


@register("agg_side_distribution", """WITH m AS (SELECT median(value) AS m FROM events), s AS (SELECT CASE WHEN value < m THEN 'below' WHEN value > m THEN 'above' ELSE 'equal' END AS side, event_type FROM events, m WHERE value IS NOT NULL),
  p AS (SELECT 'all' AS population, side FROM s UNION ALL SELECT 'bought', side FROM s WHERE event_type = 'purchase'), n AS (SELECT population, side, count(*) AS n FROM p GROUP BY ALL)
  SELECT population, side, n, round(n / sum(n) OVER (PARTITION BY population), 6) + 0.0 AS share FROM n""")
def agg_side_distribution(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    centre = robust.robust_scale(e, "value", []).select("center").scalar()
    return rounded(S.side_counts(e, "value", centre, {"all": F.lit(True), "bought": F.col("event_type") == "purchase"}))


@register("agg_corrected_alignment", """WITH e AS (SELECT (l_quantity - 25) / 15 AS s1, (l_tax - 0.04) / 0.02 AS s2, (l_discount - 0.05) / 0.02 AS b1, (l_extendedprice - 30000) / 20000 AS b2, l_suppkey % 2 AS c1, l_partkey % 2 AS c2 FROM lineitem)
  SELECT count(*) AS n, count(*) FILTER (abs(s1) <= 1 AND abs(s2) <= 1) AS selected_ok, count(*) FILTER (abs(b1) <= 1 AND abs(b2) <= 1) AS baseline_ok,
  count(*) FILTER (abs(s1) <= 1 AND abs(s2) <= 1 AND NOT (abs(b1) <= 1 AND abs(b2) <= 1) AND c1 <> c2) AS corrected FROM e""")
def agg_corrected_alignment(spark, sf_dir):
    e = read(spark, sf_dir, "lineitem").select(
        ((F.col("l_quantity") - 25) / 15).alias("s1"), ((F.col("l_tax") - 0.04) / 0.02).alias("s2"), ((F.col("l_discount") - 0.05) / 0.02).alias("b1"), ((F.col("l_extendedprice") - 30000) / 20000).alias("b2"),
        (F.col("l_suppkey") % 2).alias("c1"), (F.col("l_partkey") % 2).alias("c2"))
    return S.corrected_count(e, ("s1", "s2"), ("b1", "b2"), ("c1", "c2"), 1.0)


@register("rpt_photopeak_scan", """WITH c AS (SELECT d AS detector, s AS side, f AS fraction, lo + (hi - lo) * CASE s WHEN 'left' THEN f WHEN 'both' THEN f / 2 ELSE 0 END AS lo, hi - (hi - lo) * CASE s WHEN 'right' THEN f WHEN 'both' THEN f / 2 ELSE 0 END AS hi
    FROM (VALUES ('l_quantity', 5::DOUBLE, 45::DOUBLE), ('l_extendedprice', 10000, 70000)) d(d, lo, hi), (VALUES ('left'), ('right'), ('both')) s(s), (VALUES (0::DOUBLE), (0.21), (0.43)) f(f)),
  v AS (SELECT c.*, l_tax AS m FROM c JOIN lineitem ON CASE detector WHEN 'l_quantity' THEN l_quantity ELSE l_extendedprice END BETWEEN lo AND hi)
  SELECT detector, side, fraction, count(*) AS n, round(avg(m), 6) + 0.0 AS mean, round(stddev_samp(m), 6) + 0.0 AS std, round(sqrt(avg(m * m)), 6) + 0.0 AS rmse FROM v GROUP BY ALL""")
def rpt_photopeak_scan(spark, sf_dir):
    return rounded(S.interval_grid(read(spark, sf_dir, "lineitem"), {"l_quantity": (5.0, 45.0), "l_extendedprice": (10000.0, 70000.0)}, [0.0, 0.21, 0.43], "l_tax"))


SCAN = "SELECT event_id, CASE WHEN value > 20 THEN ln(value) END AS t20, CASE WHEN value > 60 THEN ln(value) - 1 END AS t60, CASE WHEN value > 150 THEN ln(value) - 2 END AS t150 FROM events"
SCANNED = """s AS (SELECT threshold::DOUBLE AS threshold, count(x) AS n, count(x) / count(*) AS efficiency, avg(x) AS mean, stddev_samp(x) AS ctr
  FROM (SELECT 20 AS threshold, t20 AS x FROM t UNION ALL SELECT 60, t60 FROM t UNION ALL SELECT 150, t150 FROM t) GROUP BY ALL)"""


def _scanned(spark, sf_dir):
    v, x = F.col("value"), F.ln("value")
    return read(spark, sf_dir, "events").select("event_id", F.when(v > 20, x).alias("t20"), F.when(v > 60, x - 1).alias("t60"), F.when(v > 150, x - 2).alias("t150"))


@register("rpt_threshold_scan", f"WITH t AS ({SCAN}), {SCANNED} SELECT threshold, n, round(efficiency, 6) + 0.0 AS efficiency, round(mean, 6) + 0.0 AS mean, round(ctr, 6) + 0.0 AS ctr FROM s")
def rpt_threshold_scan(spark, sf_dir):
    return rounded(S.threshold_scan(_scanned(spark, sf_dir), {20: "t20", 60: "t60", 150: "t150"}))


@register("sel_frozen_calibration", f"WITH t AS ({SCAN}), {SCANNED} SELECT threshold, round(mean, 6) + 0.0 AS control_mean, round(efficiency, 6) + 0.0 AS efficiency, round(ctr, 6) + 0.0 AS ctr FROM s WHERE efficiency >= 0.3 ORDER BY s.ctr, threshold LIMIT 1")
def sel_frozen_calibration(spark, sf_dir):
    return rounded(S.frozen_calibration(_scanned(spark, sf_dir), {20: "t20", 60: "t60", 150: "t150"}, 0.3))


@register("sel_control_rules", """WITH e AS (SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 40), c AS (SELECT median(l_discount) AS c, stddev_samp(l_discount) AS sd FROM e WHERE l_linenumber <> 7),
  s AS (SELECT c, sd, 1.4826 * median(abs(l_discount - c)) AS m FROM e, c WHERE l_linenumber <> 7 GROUP BY ALL), l AS (SELECT c + 1.5 * CASE WHEN m > 0 THEN m WHEN sd > 0 THEN sd ELSE 1 END AS l FROM s)
  SELECT (SELECT count(*) FROM lineitem) AS n_read, count(*) AS n_energy, count(*) FILTER (l_discount <= l AND l_linenumber <> 7) AS n_quiet, count(*) FILTER (l_discount <= l AND l_linenumber <> 7 AND abs(l_tax - 0.04) <= 0.02) AS n_coincident, round(any_value(l), 6) + 0.0 AS noise_limit FROM e, l""")
def sel_control_rules(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").withColumn("residual", F.col("l_tax") - 0.04)
    return rounded(S.control_rules(d, "l_quantity", 10, 40, "l_discount", F.col("l_linenumber") == 7, 1.5, "residual", 0.02))


@register("sel_energy_window", "SELECT count(*) AS n, count(*) FILTER (l_quantity BETWEEN 10 AND 40) AS one, count(*) FILTER (l_quantity BETWEEN 10 AND 40 AND l_extendedprice BETWEEN 20000 AND 60000) AS both_sides FROM lineitem")
def sel_energy_window(spark, sf_dir):
    one, two = {"l_quantity": (10.0, 40.0)}, {"l_quantity": (10.0, 40.0), "l_extendedprice": (20000.0, 60000.0)}
    return read(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.count_if(S.inside(one)).alias("one"), F.count_if(S.inside(two)).alias("both_sides"))


@register("sel_noise_limits", """WITH r AS (SELECT l_returnflag AS mode, l_discount AS rms, l_linenumber = 7 AS clipped FROM lineitem), c AS (SELECT mode, median(rms) AS c, stddev_samp(rms) AS sd FROM r WHERE NOT clipped GROUP BY mode),
  s AS (SELECT mode, c, sd, 1.4826 * median(abs(rms - c)) AS m FROM r JOIN c USING (mode) WHERE NOT clipped GROUP BY ALL) SELECT mode, round(c + 3 * CASE WHEN m > 0 THEN m WHEN sd > 0 THEN sd ELSE 1 END, 6) + 0.0 AS "limit" FROM s""")
def sel_noise_limits(spark, sf_dir):
    r = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("mode"), F.col("l_discount").alias("rms"), (F.col("l_linenumber") == 7).alias("clipped"))
    return rounded(S.noise_limits(r, "rms", F.col("clipped"), ["mode"], 3.0))


@register("sel_nearest_duration", """WITH h AS (SELECT l_orderkey AS id, l_quantity AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem)
  SELECT id, arg_min(d, (abs(d - 25), i)) FILTER (d BETWEEN 10 AND 40) AS duration FROM h GROUP BY id""")
def sel_nearest_duration(spark, sf_dir):
    h = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("duration")))).alias("h"))
    return h.select("id", S.nearest_duration(F.col("h"), F.lit(25.0), F.lit(10.0), F.lit(40.0))["duration"].alias("duration"))


@register("sig_anchor_sample", f"""WITH w AS ({WAVES}), c AS (SELECT event_id, 10 + abs(s1[3]) * 9 AS x FROM w)
  SELECT event_id, greatest(11, least(15, CASE WHEN x - floor(x) <= floor(x) + 1 - x THEN floor(x) ELSE floor(x) + 1 END))::INT AS anchor FROM c""")
def sig_anchor_sample(spark, sf_dir):
    crossing = 10 + F.abs(F.get("s1", F.lit(2))) * 9
    return waves(spark, sf_dir).select("event_id", A.anchor_sample(F.col("s1"), crossing, F.lit(11), F.lit(15)).alias("anchor"))


@register("sig_window", f"""WITH w AS ({WAVES}), p AS (SELECT event_id, s1, list_position(s1, list_max(s1)) - 1 AS t FROM w), c AS (SELECT event_id, t - 3 AS start, s1[t - 2 : t + 5] AS s FROM p WHERE t - 3 >= 0 AND t + 4 < 32)
  SELECT event_id, start::INT AS start, len(s)::INT AS n, round(list_sum(s), 6) + 0.0 AS total, (list_position(s, list_max(s)) - 1)::INT AS peak FROM c""")
def sig_window(spark, sf_dir):
    cut = A.materialised(F.col("s1"), A.peak_index(F.col("s1")), 0.14, 0.2, 0.05)
    w = waves(spark, sf_dir).select("event_id", cut.alias("w")).where("w is not null")
    return rounded(w.select("event_id", "w.start", F.size("w.samples").alias("n"), A.total(F.col("w.samples")).alias("total"), "w.peak"))


@register("sig_masked_scan", f"WITH w AS ({WAVES}) SELECT event_id, CASE WHEN y > 4 THEN round(list_avg(s1[1:8]), 6) + 0.0 END AS level, CASE WHEN y > 4 THEN round(list_max(s1), 6) + 0.0 END AS top FROM w")
def sig_masked_scan(spark, sf_dir):
    hit = F.col("y") > 4
    w = waves(spark, sf_dir)
    return rounded(w.select("event_id", A.masked(hit, A.mean(F.slice("s1", 1, 8))).alias("level"), A.masked(hit, F.array_max("s1")).alias("top")))


@register("sig_faded_region", f"""WITH w AS ({WAVES}), v AS (SELECT event_id, unnest(range(32)) AS i, unnest(s1) AS x, unnest(s2) AS y FROM w), e AS (SELECT *, least(i - 7, 24 - i) AS e FROM v)
  SELECT event_id, i::INT AS i, round(CASE WHEN i < 8 OR i > 23 THEN x WHEN e > 3 THEN y ELSE x + (0.5 - 0.5 * cos(e / 4.0::DOUBLE * pi())) * (y - x) END, 6) + 0.0 AS v FROM e""")
def sig_faded_region(spark, sf_dir):
    w = waves(spark, sf_dir)
    return rounded(w.select("event_id", F.posexplode(A.faded_region(F.col("s1"), F.col("s2"), 8, 23, 3)).alias("i", "v")))


@register("sig_time_slice", f"WITH w AS ({WAVES}) SELECT event_id, round(list_sum(s1[5:13]), 6) + 0.0 AS total, 9 AS n FROM w")
def sig_time_slice(spark, sf_dir):
    cut = A.time_slice(F.col("s1"), -0.2, 0.05, 0.0, 0.4)
    return rounded(waves(spark, sf_dir).select("event_id", A.total(cut).alias("total"), F.size(cut).alias("n")))


@register("sig_peak_index", f"WITH w AS ({WAVES}) SELECT event_id, (list_position(s1, list_max(s1)) - 1)::INT AS peak FROM w")
def sig_peak_index(spark, sf_dir):
    return waves(spark, sf_dir).select("event_id", A.peak_index(F.col("s1")).alias("peak"))


@register("sig_blend_weights", f"""WITH w AS ({WAVES}), v AS (SELECT event_id, unnest(range(16)) AS i, unnest(s1[1:16]) AS v FROM w)
  SELECT event_id, round(sum(v * (0.5 - 0.5 * cos(pi() * i / 15))), 6) + 0.0 AS fade, round(sum(v * 16 * (i / 15) ** 2 * (1 - i / 15) ** 2), 6) + 0.0 AS bump FROM v GROUP BY event_id""")
def sig_blend_weights(spark, sf_dir):
    """Every waveform's first samples weighed by a cosine and by a quartic."""
    head = F.slice("s1", 1, 16)
    weighed = lambda w: A.total(F.zip_with(head, w, lambda a, b: a * b))
    return rounded(waves(spark, sf_dir).select("event_id", weighed(A.cosine_fade(16)).alias("fade"), weighed(A.quartic_bump(16)).alias("bump")))


@register("fn_cell_edges", """WITH c AS (SELECT l_returnflag AS mode, l_discount::DOUBLE AS c FROM lineitem GROUP BY ALL), n AS (SELECT mode, c, lag(c) OVER w AS before, lead(c) OVER w AS after, row_number() OVER w AS i FROM c WINDOW w AS (PARTITION BY mode ORDER BY c)),
  e AS (SELECT mode, i AS cell, round(coalesce((before + c) / 2, c - (after - c) / 2), 6) + 0.0 AS low, round(coalesce((c + after) / 2, c + (c - before) / 2), 6) + 0.0 AS high FROM n) SELECT mode, (cell - 1)::INT AS cell, low, high FROM e""")
def fn_cell_edges(spark, sf_dir):
    """Cells around each mode's discounts."""
    centres = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("mode")).agg(F.sort_array(F.collect_set(F.col("l_discount").cast("double"))).alias("c"))
    edges = centres.select("mode", A.edges_of(F.col("c")).alias("e"))
    cells = edges.select("mode", F.posexplode(F.arrays_zip(F.slice("e", F.lit(1), F.size("e") - 1).alias("low"), F.slice("e", F.lit(2), F.size("e") - 1).alias("high"))).alias("cell", "z"))
    return rounded(cells.select("mode", "cell", "z.low", "z.high"))


@register("match_trigger_candidates", f"""WITH h AS (SELECT *, toa // {7 * DAY} AS trigger FROM ({HITS})), e AS (SELECT board, trigger, min(toa) AS energy FROM h WHERE channel = 'purchase' GROUP BY ALL),
  c AS (SELECT board, trigger, list(toa ORDER BY toa) AS l FROM h WHERE channel = 'click' GROUP BY ALL), m AS (SELECT board, trigger, energy, coalesce(list_filter(l, lambda x: x < energy), []) AS c FROM e FULL JOIN c USING (board, trigger))
  SELECT board, trigger, energy, len(c)::INT AS n, list_min(c) AS first, list_max(c) AS last, CASE WHEN energy IS NULL THEN 'no_energy_pulse' WHEN len(c) = 0 THEN 'no_timing_candidate' ELSE 'ok' END AS status FROM m""")
def match_trigger_candidates(spark, sf_dir):
    h = hits(spark, sf_dir).withColumn("trigger", F.floor(F.col("toa") / (7 * DAY)))
    found = matching.trigger_candidates(h.where("channel = 'purchase'"), h.where("channel = 'click'"), ["board", "trigger"], "toa", "toa")
    return found.select("board", "trigger", "energy", F.size("candidates").alias("n"), F.array_min("candidates").alias("first"), F.array_max("candidates").alias("last"), "status")


@register("match_stream_candidates", f"""WITH h AS ({HITS}) SELECT e.hit_id AS energy_id, count(t.toa)::INT AS n, max(t.toa) AS last, CASE WHEN count(t.toa) > 0 THEN 'ok' ELSE 'no_timing_candidate' END AS status
  FROM h e LEFT JOIN h t ON e.board = t.board AND t.channel = 'click' AND t.toa > e.toa - {DAY} AND t.toa < e.toa WHERE e.channel = 'purchase' GROUP BY 1""")
def match_stream_candidates(spark, sf_dir):
    found = matching.preceding_candidates(_leads(spark, sf_dir, "purchase", "energy"), _leads(spark, sf_dir, "click", "timing"), ["board"], "energy", "timing", DAY, "energy_id")
    return found.select("energy_id", F.size("candidates").alias("n"), F.array_max("candidates").alias("last"), "status")


def stream_events(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Hits to events of two sides: edges without repeats, pulses, one-to-one coincidences with the other side's leads, and candidate lists.

    Returns the events and a row of counters; a coincidence without candidates on a side is dropped and counted.
    """
    h = hits(spark, sf_dir).dropDuplicates(["board", "channel", "toa"])
    pulses = matching.pair_edges(h, ["board"], F.col("channel") == "view", F.col("channel") == "purchase", "toa")
    other = h.where("channel = 'signup'").select("board", F.col("toa").alias("other"))
    leads = pulses.select("board", F.col("lead").alias("t"), F.lit(0).alias("side")).unionByName(other.select("board", F.col("other").alias("t"), F.lit(1).alias("side")))
    near = matching.monotonic_nearest(leads, ["board"], F.col("side"), "t", DAY)
    met = near.select("board", F.col("a").alias("lead"), F.col("b").alias("other")).withColumn("event", F.concat_ws(":", "board", "lead", "other"))
    timing = h.where("channel = 'click'").select("board", F.col("toa").alias("timing"))
    a = matching.preceding_candidates(met.select("event", "board", "lead"), timing, ["board"], "lead", "timing", 7 * DAY, "event")
    b = matching.preceding_candidates(met.select("event", "board", "other"), timing, ["board"], "other", "timing", 7 * DAY, "event")
    both = met.join(a.select("event", F.col("candidates").alias("a")), "event").join(b.select("event", F.col("candidates").alias("b")), "event")
    kept = both.where((F.size("a") > 0) & (F.size("b") > 0))
    counters = pulses.agg(F.count("*").alias("pulses")).crossJoin(F.broadcast(both.agg(F.count("*").alias("coincidences"), F.count_if((F.size("a") == 0) | (F.size("b") == 0)).alias("dropped"), F.count_if((F.size("a") > 0) & (F.size("b") > 0)).alias("events"))))
    return kept, counters


_PULSES = f"""h AS (SELECT DISTINCT board, channel, toa FROM ({HITS})), x AS (SELECT board, toa, channel = 'view' AS lead FROM h WHERE channel IN ('view', 'purchase')),
  s AS (SELECT *, sum(CASE WHEN lead THEN 1 ELSE -1 END) OVER w AS s, count(*) FILTER (lead) OVER w AS leads, count(*) FILTER (NOT lead) OVER w AS trails FROM x WINDOW w AS (PARTITION BY board ORDER BY toa, lead ROWS UNBOUNDED PRECEDING)),
  m AS (SELECT *, greatest(0, -min(s) OVER (PARTITION BY board ORDER BY toa, lead ROWS UNBOUNDED PRECEDING)) AS missed FROM s),
  f AS (SELECT *, missed = coalesce(lag(missed) OVER (PARTITION BY board ORDER BY toa, lead), 0) AS found FROM m),
  p AS (SELECT l.board, l.toa AS lead, t.toa AS trail FROM f l JOIN f t ON l.board = t.board AND l.lead AND NOT t.lead AND t.found AND l.leads = t.trails - t.missed),
  {walk_sql("SELECT board, a, b, a AS ae, b AS be FROM (SELECT board, list(lead ORDER BY lead) AS a FROM p GROUP BY board) JOIN (SELECT board, list(toa ORDER BY toa) AS b FROM h WHERE channel = 'signup' GROUP BY board) USING (board)", nearest_sql(DAY))},
  c AS (SELECT board, p AS lead, q AS other FROM w WHERE p IS NOT NULL),
  k AS (SELECT *, (SELECT count(*) FROM h t WHERE t.board = c.board AND t.channel = 'click' AND t.toa > lead - {7 * DAY} AND t.toa < lead) AS a, (SELECT count(*) FROM h t WHERE t.board = c.board AND t.channel = 'click' AND t.toa > other - {7 * DAY} AND t.toa < other) AS b FROM c)"""


@register("match_stream_events", f"WITH RECURSIVE {_PULSES} SELECT board, lead, other, a::INT AS a, b::INT AS b FROM k WHERE a > 0 AND b > 0")
def match_stream_events(spark, sf_dir):
    return stream_events(spark, sf_dir)[0].select("board", "lead", "other", F.size("a").alias("a"), F.size("b").alias("b"))


@register("match_stream_counters", f"WITH RECURSIVE {_PULSES} SELECT (SELECT count(*) FROM p) AS pulses, count(*) AS coincidences, count(*) FILTER (a = 0 OR b = 0) AS dropped, count(*) FILTER (a > 0 AND b > 0) AS events FROM k")
def match_stream_counters(spark, sf_dir):
    return stream_events(spark, sf_dir)[1]


@register("match_per_board", f"""WITH h AS (SELECT *, board % 2 AS side FROM ({HITS})), b AS (SELECT side, count(*) AS n, max(value) AS top, avg(value) AS mean FROM h WHERE (side = 0 AND channel = 'view') OR (side = 1 AND channel = 'click') GROUP BY side)
  SELECT sum(n)::BIGINT AS n, max(top) AS top, round(sum(mean * n) / sum(n), 6) + 0.0 AS mean FROM b""")
def match_per_board(spark, sf_dir):
    """Each side by a matcher of its own; statistics merged as sum, maximum and weighted mean."""
    h = hits(spark, sf_dir).withColumn("side", (F.col("board") % 2).cast("int"))
    of = lambda c: lambda rows: rows.where(F.col("channel") == c).groupBy("side").agg(F.count("*").alias("n"), F.max("value").alias("top"), F.avg("value").alias("mean"))
    return rounded(matching.merged_statistics(matching.dispatched(h, "side", {0: of("view"), 1: of("click")}), ["n"], ["top"], ["mean"], "n"))


@register("rpt_role_summaries", f"""WITH r AS (SELECT event_type AS model, CASE user_id % 3 WHEN 0 THEN 'control' WHEN 1 THEN 'development' ELSE 'blind' END AS role, x FROM ({RESIDUALS})), c AS (SELECT model, avg(x) AS m FROM r WHERE role = 'control' GROUP BY model)
  SELECT model, round(m, 6) + 0.0 AS control_mean, count(x) FILTER (role = 'development') AS n_development, round(sqrt(avg((x - m) ** 2) FILTER (role = 'development')), 6) + 0.0 AS rmse_development,
  count(x) FILTER (role = 'blind') AS n_blind, round(sqrt(avg((x - m) ** 2) FILTER (role = 'blind')), 6) + 0.0 AS rmse_blind FROM r JOIN c USING (model) GROUP BY model, m""")
def rpt_role_summaries(spark, sf_dir):
    """Control fits, development and blind are only judged: one row a model with what each role gives."""
    role = F.when(F.col("user_id") % 3 == 0, "control").when(F.col("user_id") % 3 == 1, "development").otherwise("blind")
    r = residuals(spark, sf_dir).select(F.col("event_type").alias("model"), role.alias("role"), "x")
    centre = r.where("role = 'control'").groupBy("model").agg(F.avg("x").alias("control_mean"))
    d = F.col("x") - F.col("control_mean")
    judged = [c for k in ("development", "blind") for c in (F.count(F.when(F.col("role") == k, F.col("x"))).alias(f"n_{k}"), F.sqrt(F.avg(F.when(F.col("role") == k, d * d))).alias(f"rmse_{k}"))]
    return rounded(r.join(centre, "model").groupBy("model", "control_mean").agg(*judged))


@register("rpt_validation_blind", """WITH v AS (SELECT l_returnflag AS mode, l_linenumber AS window_no, l_linestatus AS model, l_tax AS x, l_suppkey % 2 AS blind FROM lineitem), n AS (SELECT mode, window_no, model,
    avg(x) FILTER (blind = 0) AS validation, avg(x) FILTER (blind = 1) AS blind, stddev_samp(x) FILTER (blind = 1) AS blind_std FROM v GROUP BY ALL)
  SELECT mode, window_no, model, round(validation, 6) + 0.0 AS validation, round(blind, 6) + 0.0 AS blind, round(blind_std, 6) + 0.0 AS blind_std FROM n WHERE validation IS NOT NULL AND blind IS NOT NULL""")
def rpt_validation_blind(spark, sf_dir):
    keys = ["mode", "window_no", "model"]
    v = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("mode"), F.col("l_linenumber").alias("window_no"), F.col("l_linestatus").alias("model"), F.col("l_tax").alias("x"), (F.col("l_suppkey") % 2).alias("blind"))
    parts = [v.where("blind = 0").groupBy(*keys).agg(F.avg("x").alias("validation")), v.where("blind = 1").groupBy(*keys).agg(F.avg("x").alias("blind")), v.where("blind = 1").groupBy(*keys).agg(F.stddev_samp("x").alias("blind_std"))]
    return rounded(reduce(lambda a, b: a.join(b, keys), parts))
