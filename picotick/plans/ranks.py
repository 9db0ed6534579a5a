"""Queries over ranks, sets and two-column statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bivariate, ranking
from .registry import register
from .tables import PAIRS, RESIDUALS, pairs, read, residuals, rounded

P = f"p AS ({PAIRS})"
R = f"r AS ({RESIDUALS})"


def _h(id_: str, seed: str) -> str:
    return f"CAST('0x' || substr(md5(CAST({id_} AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT)"


@register("win_average_rank", "SELECT l_orderkey, l_linenumber, l_quantity, rank() OVER w + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS r FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)")
def win_average_rank(spark, sf_dir):
    ranked = ranking.average_rank(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), "l_quantity", ["l_returnflag"], "r")
    return ranked.drop("l_returnflag")


@register("win_ordinal_rank", f"WITH {R} SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY x NULLS FIRST, event_id) - 1 AS r FROM r")
def win_ordinal_rank(spark, sf_dir):
    return ranking.ordinal_rank(residuals(spark, sf_dir), "x", "event_id", ["event_type"], "r").select("event_id", "r")


@register("win_percentile_bands", f"""WITH {R}, k AS (SELECT event_id, event_type, 100 * (row_number() OVER (PARTITION BY event_type ORDER BY x NULLS FIRST, event_id) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY event_type) AS p FROM r)
  SELECT event_type, band, count(*) AS n FROM (SELECT *, CASE WHEN p >= 0 AND p < 10 THEN 0 WHEN p >= 10 AND p < 50 THEN 1 WHEN p >= 50 AND p < 90 THEN 2 END AS band FROM k) GROUP BY ALL""")
def win_percentile_bands(spark, sf_dir):
    return ranking.percentile_bands(residuals(spark, sf_dir), "x", "event_id", ["event_type"], [0, 10, 50, 90]).groupBy("event_type", "band").agg(F.count("*").alias("n"))


@register("win_keep_lowest_percent", f"WITH {R} SELECT event_id FROM r QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY x NULLS FIRST, event_id) <= floor(count(*) OVER (PARTITION BY event_type) * 12.5 / 100)")
def win_keep_lowest_percent(spark, sf_dir):
    return ranking.lowest_percent(residuals(spark, sf_dir), "x", "event_id", ["event_type"], 12.5).select("event_id")


@register("win_consecutive_runs", """WITH d AS (SELECT user_id, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day FROM events GROUP BY ALL), i AS (
  SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM d) SELECT user_id, min(day) AS first, max(day) AS last FROM i GROUP BY user_id, g""")
def win_consecutive_runs(spark, sf_dir):
    d = read(spark, sf_dir, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000).alias("day")).distinct()
    return ranking.runs(d, ["user_id"], "day", F.lit(True))


@register("win_balanced_bins", """WITH c AS (SELECT l_quantity AS q, count(*) AS c FROM lineitem GROUP BY 1), p AS (SELECT q, least(6, floor((sum(c) OVER (ORDER BY q) - c / 2.0::DOUBLE) * 7 / sum(c) OVER ())) AS b, c FROM c),
  d AS (SELECT *, dense_rank() OVER (ORDER BY b) - 1 AS bin FROM p) SELECT bin::INT AS bin, min(q) AS low, max(q) AS high, CAST(sum(c) AS BIGINT) AS n FROM d GROUP BY 1""")
def win_balanced_bins(spark, sf_dir):
    return ranking.balanced_bins(read(spark, sf_dir, "lineitem"), "l_quantity", 7).groupBy("bin").agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.count("*").alias("n"))


@register("top_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def top_per_key(spark, sf_dir):
    return ranking.top_per_key(read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@register("top_extreme_events", f"""WITH {P}, f AS (SELECT event_id, row_number() OVER (ORDER BY abs(a) DESC, event_id) <= ceil(count(*) OVER () * 0.01::DOUBLE) AS ta, row_number() OVER (ORDER BY abs(b) DESC, event_id) <= ceil(count(*) OVER () * 0.01::DOUBLE) AS tb FROM p)
  SELECT count(*) FILTER (ta AND tb) AS core, count(*) FILTER (ta AND NOT tb) AS only_a, count(*) FILTER (tb AND NOT ta) AS only_b, count(*) FILTER (ta OR tb) AS either_one FROM f""")
def top_extreme_events(spark, sf_dir):
    f = ranking.extreme_flags(pairs(spark, sf_dir), ["a", "b"], "event_id", [], 0.01)
    return f.agg(F.count_if(F.col("top_a") & F.col("top_b")).alias("core"), F.count_if(F.col("top_a") & ~F.col("top_b")).alias("only_a"),
                 F.count_if(F.col("top_b") & ~F.col("top_a")).alias("only_b"), F.count_if(F.col("top_a") | F.col("top_b")).alias("either_one"))


@register("top_best_candidate", """WITH c AS (SELECT l_suppkey AS candidate_id, l_returnflag AS fold_id, stddev_samp(l_extendedprice) AS metric, count(*) AS n FROM lineitem GROUP BY ALL),
  s AS (SELECT candidate_id, avg(metric) AS m, count(*) AS folds FROM c GROUP BY 1) SELECT candidate_id, round(m, 6) + 0.0 AS metric FROM s WHERE folds = 3 AND m IS NOT NULL ORDER BY m, candidate_id LIMIT 1""")
def top_best_candidate(spark, sf_dir):
    c = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("candidate_id"), "l_returnflag").agg(F.stddev_samp("l_extendedprice").alias("m"))
    s = c.groupBy("candidate_id").agg(F.avg("m").alias("metric"), F.count("*").alias("folds")).where("folds = 3 and metric is not null")
    return rounded(s.orderBy("metric", "candidate_id").limit(1).select("candidate_id", "metric"))


@register("top_sample", f"SELECT doc_id FROM documents ORDER BY {_h('doc_id', 's1')}, doc_id LIMIT 50")
def top_sample(spark, sf_dir):
    return ranking.sample(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, "s1")


@register("top_offset_limit", "SELECT event_id, event_type FROM events WHERE event_id BETWEEN 100 AND 299")
def top_offset_limit(spark, sf_dir):
    return read(spark, sf_dir, "events").where("event_id between 100 and 299").select("event_id", "event_type")


@register("stat_kfold", f"""WITH o AS (SELECT event_id, row_number() OVER (ORDER BY {_h('event_id', '1001')}, event_id) - 1 AS p, count(*) OVER () AS n FROM events)
  SELECT event_id, (1 + CASE WHEN p < (n % 7) * (n // 7 + 1) THEN p // (n // 7 + 1) ELSE n % 7 + (p - (n % 7) * (n // 7 + 1)) // (n // 7) END)::INT AS fold_id FROM o""")
def stat_kfold(spark, sf_dir):
    return ranking.folds(read(spark, sf_dir, "events").select("event_id"), "event_id", 7, "1001")


@register("agg_spearman", f"""WITH {P}, k AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY a) + (count(*) OVER (PARTITION BY grp, a) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY grp ORDER BY b) + (count(*) OVER (PARTITION BY grp, b) - 1) / 2.0::DOUBLE AS y FROM p)
  SELECT grp, round(corr(x, y), 6) + 0.0 AS spearman FROM k GROUP BY grp""")
def agg_spearman(spark, sf_dir):
    return rounded(ranking.spearman(pairs(spark, sf_dir), "a", "b", ["grp"]))


@register("agg_spearman_ordinal", f"""WITH {P}, k AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY a, event_id)::DOUBLE AS x, row_number() OVER (PARTITION BY grp ORDER BY b, event_id)::DOUBLE AS y FROM p)
  SELECT grp, round(corr(x, y), 6) + 0.0 AS spearman FROM k GROUP BY grp""")
def agg_spearman_ordinal(spark, sf_dir):
    return rounded(ranking.spearman(pairs(spark, sf_dir), "a", "b", ["grp"], "event_id"))


@register("agg_bivariate", f"""WITH {P}, s AS (SELECT grp, count(*) AS n, corr(a, b) AS pearson, covar_samp(a, b) AS covariance, var_samp(a) AS var_a, var_samp(b) AS var_b, var_samp(a - b) AS var_difference, regr_slope(b, a) AS slope,
  regr_intercept(b, a) AS intercept, regr_r2(b, a) AS r2, avg((sign(a) = sign(b))::INT) AS same_sign FROM p GROUP BY grp)
  SELECT grp, n, round(pearson, 6) + 0.0 AS pearson, round(covariance, 0) + 0.0 AS covariance, round(var_a, 0) + 0.0 AS var_a, round(slope, 6) + 0.0 AS slope, round(intercept, 2) + 0.0 AS intercept, round(r2, 6) + 0.0 AS r2,
  round(same_sign, 6) + 0.0 AS same_sign, round(greatest(0, covariance) / sqrt(var_a * var_b), 6) + 0.0 AS shared_fraction FROM s""")
def agg_bivariate(spark, sf_dir):
    s = bivariate.statistics(pairs(spark, sf_dir), "a", "b", ["grp"])
    big = s.select("grp", "n", "pearson", F.round("covariance", 0).alias("covariance"), F.round("var_a", 0).alias("var_a"), "slope", F.round("intercept", 2).alias("intercept"), "r2", "same_sign", "shared_fraction")
    return rounded(big)


@register("agg_tail_dependence", f"""WITH {P}, q AS (SELECT grp, u.p AS percent, quantile_cont(abs(a), 0.9) AS qa, quantile_cont(abs(b), 0.9) AS qb FROM p, (SELECT 90.0::DOUBLE AS p) u GROUP BY ALL),
  t AS (SELECT grp, percent, count(*) AS n, count(*) FILTER (abs(a) >= qa) AS n_a, count(*) FILTER (abs(b) >= qb) AS n_b, count(*) FILTER (abs(a) >= qa AND abs(b) >= qb) AS n_both FROM p JOIN q USING (grp) GROUP BY ALL)
  SELECT grp, percent, n, n_a, n_b, n_both, round(n_both / n, 6) + 0.0 AS joint, round(n_both / n_a, 6) + 0.0 AS b_given_a, round(n_a / n * n_b / n, 6) + 0.0 AS independent FROM t""")
def agg_tail_dependence(spark, sf_dir):
    return rounded(bivariate.tail_dependence(pairs(spark, sf_dir), "a", "b", ["grp"], [90.0]).select("grp", "percent", "n", "n_a", "n_b", "n_both", "joint", "b_given_a", "independent"))


@register("agg_grid", """WITH g AS (SELECT least(4, floor((l_quantity - 1) / (49.0::DOUBLE / 5)))::INT AS x_bin, least(2, floor(l_discount / (0.1::DOUBLE / 3)))::INT AS y_bin, l_tax AS v FROM lineitem),
  f AS (SELECT x_bin, y_bin, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std FROM g GROUP BY ALL), e AS (SELECT (i % 5)::INT AS x_bin, (i // 5)::INT AS y_bin FROM range(15) t(i))
  SELECT x_bin, y_bin, coalesce(n, 0) AS n, round(mean, 6) + 0.0 AS mean, round(mean - (SELECT avg(v) FROM g), 6) + 0.0 AS deviation, round(std, 6) + 0.0 AS std, round(std / sqrt(n), 6) + 0.0 AS error FROM e LEFT JOIN f USING (x_bin, y_bin)""")
def agg_grid(spark, sf_dir):
    from ..operators.histogram import clipped_bins

    return rounded(bivariate.grid(read(spark, sf_dir, "lineitem"), clipped_bins(F.col("l_quantity"), 1.0, 50.0, 5), 5, clipped_bins(F.col("l_discount"), 0.0, 0.1, 3), 3, "l_tax"))


@register("agg_model_agreement", f"WITH {P} SELECT grp, count(*) AS n, round(avg(a - b), 4) + 0.0 AS bias, round(sqrt(avg((a - b) ** 2)), 4) + 0.0 AS rmse, round(avg(abs(a - b)), 4) + 0.0 AS mae, round(quantile_cont(abs(a - b), 0.5), 4) + 0.0 AS p50, round(quantile_cont(abs(a - b), 0.95), 4) + 0.0 AS p95 FROM p GROUP BY grp")
def agg_model_agreement(spark, sf_dir):
    return rounded(bivariate.agreement(pairs(spark, sf_dir), "a", "b", ["grp"]), 4)


@register("agg_efficiency", "SELECT l_shipdate IS NOT NULL AS k, l_linestatus, round(count(*) FILTER (l_returnflag = 'R') / count(*), 6) + 0.0 AS p, round(sqrt(count(*) FILTER (l_returnflag = 'R') / count(*) * (1 - count(*) FILTER (l_returnflag = 'R') / count(*)) / count(*)), 6) + 0.0 AS e FROM lineitem GROUP BY ALL")
def agg_efficiency(spark, sf_dir):
    g = read(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").isNotNull().alias("k"), "l_linestatus").agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count("*").alias("b"))
    p, e = bivariate.efficiency(F.col("a"), F.col("b"))
    return rounded(g.select("k", "l_linestatus", p.alias("p"), e.alias("e")))


@register("agg_outlier_contribution", "SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_quantity > 45) AS n_flagged, round(avg((l_quantity > 45)::INT), 6) + 0.0 AS prevalence, round(sum(l_tax * l_tax) FILTER (l_quantity > 45) / sum(l_tax * l_tax), 6) + 0.0 AS sse_share, round(avg((l_quantity > 45)::INT) / (SELECT avg((l_quantity > 45)::INT) FROM lineitem), 6) + 0.0 AS enrichment FROM lineitem GROUP BY 1")
def agg_outlier_contribution(spark, sf_dir):
    return rounded(bivariate.outlier_contribution(read(spark, sf_dir, "lineitem"), "l_tax", F.col("l_quantity") > 45, ["l_returnflag"]))


@register("stat_line_fit", f"WITH {P} SELECT grp, count(*) AS n, round(regr_slope(b, a), 6) + 0.0 AS slope, round(regr_intercept(b, a), 3) + 0.0 AS intercept FROM p GROUP BY grp")
def stat_line_fit(spark, sf_dir):
    f = bivariate.line_fit(pairs(spark, sf_dir), "a", "b", ["grp"])
    return rounded(f.withColumn("intercept", F.round("intercept", 3)))


@register("stat_plane_fit", """WITH g AS (SELECT l_returnflag AS k, count(*) AS n, covar_samp(l_quantity, l_quantity) AS xx, covar_samp(l_tax, l_tax) AS zz, covar_samp(l_quantity, l_tax) AS xz, covar_samp(l_quantity, l_extendedprice) AS xy,
  covar_samp(l_tax, l_extendedprice) AS zy, covar_samp(l_extendedprice, l_extendedprice) AS yy, avg(l_quantity) AS mx, avg(l_tax) AS mz, avg(l_extendedprice) AS my FROM lineitem GROUP BY 1),
  f AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS a, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b FROM g)
  SELECT k, n, round(a, 4) + 0.0 AS a, round(b, 4) + 0.0 AS b, round(my - a * mx - b * mz, 4) + 0.0 AS c, round(100 * (1 - sqrt(greatest(0, yy - a * xy - b * zy) / yy)), 4) + 0.0 AS improvement FROM f""")
def stat_plane_fit(spark, sf_dir):
    d = read(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "k")
    return rounded(bivariate.plane_fit(d, "l_quantity", "l_tax", "l_extendedprice", ["k"]), 4)


@register("set_union_runs", "SELECT 'a' AS run_id, event_id, value FROM events WHERE event_type = 'view' UNION ALL SELECT 'b', event_id, value FROM events WHERE event_type = 'click'")
def set_union_runs(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    part = lambda c, r: e.where(F.col("event_type") == c).select(F.lit(r).alias("run_id"), "event_id", "value")
    return part("view", "a").unionByName(part("click", "b"))


@register("set_boards", """SELECT (SELECT count(*) FROM (SELECT user_id FROM events WHERE value > 300 UNION SELECT user_id FROM events WHERE value < 1)) AS either_one,
  (SELECT count(*) FROM (SELECT user_id FROM events WHERE value > 300 INTERSECT SELECT user_id FROM events WHERE value < 1)) AS both_sides, (SELECT count(*) FROM (SELECT user_id FROM events WHERE value > 300 EXCEPT SELECT user_id FROM events WHERE value < 1)) AS only_first""")
def set_boards(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    a, b = e.where("value > 300").select("user_id"), e.where("value < 1").select("user_id")
    count = lambda d: d.agg(F.count("*")).scalar()
    return spark.range(1).select(count(a.union(b).distinct()).alias("either_one"), count(a.intersect(b)).alias("both_sides"), count(a.distinct().join(b, "user_id", "left_anti")).alias("only_first"))


@register("set_upsert", """SELECT doc_id, 1 AS v FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def set_upsert(spark, sf_dir):
    old = read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("v"))
    new = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(1).alias("v"))
    return old.join(new, "doc_id", "left_anti").unionByName(new)


@register("set_exclude_rules", "SELECT o_orderkey FROM orders WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AND NOT (o_orderstatus = 'P')")
def set_exclude_rules(spark, sf_dir):
    """Rules with null wildcards: a row is excluded if a rule fits every column that it names."""
    rules = spark.sql("SELECT * FROM VALUES ('1-URGENT', 'F'), (NULL, 'P') AS t(p, s)")
    o = read(spark, sf_dir, "orders")
    fits = (F.col("p").isNull() | (F.col("p") == F.col("o_orderpriority"))) & (F.col("s") == F.col("o_orderstatus"))
    return o.join(rules, fits, "left_anti").select("o_orderkey")
