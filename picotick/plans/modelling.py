"""Queries over resampling, models and reports."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import ranking, resampling
from .registry import register
from .tables import PAIRS, RESIDUALS, WAVES, pairs, read, residuals, rounded, waves


#: Draws of the resampling queries.
DRAWS, PERMUTATIONS, WIDTH_DRAWS = 100, 1000, 100


def _md5(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


#: Seeds of the resampling queries; a seed and the next one may be used.
BOOT, CTR, INTERVAL, PAIR, PERMUTED = 11, 21, 31, 41, 51


def _picks(rows: str, keys: str, seed: int, draws: int = DRAWS) -> str:
    """DuckDB: ``p`` holds the rows of every draw, with ``draw``, as ``resample`` gives them."""
    part = f"PARTITION BY {keys} " if keys else ""
    on = f"p0.{keys} = k.{keys} AND " if keys else ""
    mixed = resampling.mixed_sql("s0", "h", seed, ["draw", "0", "slot"])
    return f"""k AS (SELECT *, row_number() OVER ({part}ORDER BY event_id) - 1 AS k, count(*) OVER ({part}) AS n FROM ({rows})),
      s0 AS (SELECT {keys + ", " if keys else ""}d AS draw, k AS slot, n FROM k, range({draws}) t(d)),
      p0 AS (SELECT {keys + ", " if keys else ""}draw, h % n AS pick FROM {mixed}), p AS (SELECT p0.draw, k.* FROM p0 JOIN k ON {on}p0.pick = k.k)"""


@register("stat_bootstrap", f"WITH {_picks(RESIDUALS, 'event_type', BOOT)} SELECT event_type, draw::INT AS draw, count(*) AS n, round(avg(x), 6) + 0.0 AS mean FROM p GROUP BY ALL")
def stat_bootstrap(spark, sf_dir):
    b = resampling.resample(residuals(spark, sf_dir).drop("user_id"), ["event_type"], "event_id", DRAWS, BOOT)
    return rounded(b.groupBy("event_type", "draw").agg(F.count("*").alias("n"), F.avg("x").alias("mean")))


@register("stat_bootstrap_ctr")
def stat_bootstrap_ctr(spark, sf_dir):
    """Width at half maximum per group with the std of its resamples; failed draws are skipped."""
    from ..operators import histogram

    r = residuals(spark, sf_dir).drop("user_id").where("x is not null")
    draws = histogram.fwhm(resampling.resample(r, ["event_type"], "event_id", WIDTH_DRAWS, CTR), "x", ["event_type", "draw"], 0.25)
    spread = draws.where("success").groupBy("event_type").agg(F.stddev_samp("fwhm").alias("fwhm_std"), F.count("*").alias("draws"))
    return rounded(histogram.fwhm(r, "x", ["event_type"], 0.25).select("event_type", "n", "fwhm", "success").join(spread, "event_type", "left"))


_INTERVAL = "count({0}) AS n_draws, round(quantile_cont({0}, 0.025), 6) + 0.0 AS low, round(quantile_cont({0}, 0.975), 6) + 0.0 AS high, round(stddev_samp({0}), 6) + 0.0 AS std"


@register("stat_percentile_interval", f"WITH {_picks(PAIRS, 'grp', INTERVAL)}, s AS (SELECT grp, draw, corr(a, b) AS r FROM p GROUP BY ALL) SELECT grp, {_INTERVAL.format('r')} FROM s GROUP BY grp")
def stat_percentile_interval(spark, sf_dir):
    b = resampling.resample(pairs(spark, sf_dir), ["grp"], "event_id", DRAWS, INTERVAL).groupBy("grp", "draw").agg(F.corr("a", "b").alias("r"))
    return rounded(resampling.percentile_interval(b, ["grp"], "r", DRAWS))


@register("stat_paired_bootstrap", f"WITH {_picks(PAIRS, '', PAIR)}, s AS (SELECT draw, sqrt(avg(a * a)) - sqrt(avg(b * b)) AS d FROM p GROUP BY draw) SELECT {_INTERVAL.format('d')} FROM s")
def stat_paired_bootstrap(spark, sf_dir):
    b = resampling.resample(pairs(spark, sf_dir).drop("grp"), [], "event_id", DRAWS, PAIR)
    d = b.groupBy("draw").agg((F.sqrt(F.avg(F.col("a") * F.col("a"))) - F.sqrt(F.avg(F.col("b") * F.col("b")))).alias("d"))
    return rounded(resampling.percentile_interval(d, [], "d", DRAWS))


#: Cumulative Poisson(1) probabilities, the cuts of a weight.
_CUTS = [sum(2.718281828459045 ** -1 / math.factorial(i) for i in range(k + 1)) for k in range(8)]


@register("stat_poisson_bootstrap", f"""WITH r AS ({RESIDUALS}), u AS (SELECT event_type, x, d::INT AS draw, ({_md5("d || ':' || event_id || ':p'")} + 0.5::DOUBLE) / 4294967296::DOUBLE AS u FROM r, range({DRAWS}) t(d) WHERE x IS NOT NULL),
  w AS (SELECT *, {" + ".join(f"(u >= {c!r}::DOUBLE)::BIGINT" for c in _CUTS)} AS weight FROM u)
  SELECT event_type, draw, sum(weight)::BIGINT AS n, round(sum(weight * x) / sum(weight), 6) + 0.0 AS mean FROM w WHERE weight > 0 GROUP BY ALL""")
def stat_poisson_bootstrap(spark, sf_dir):
    w = resampling.poisson_weights(residuals(spark, sf_dir).where("x is not null"), "event_id", DRAWS, "p")
    return rounded(w.groupBy("event_type", "draw").agg(F.sum("weight").cast("long").alias("n"), (F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("mean")))


_PLACE_HASH = resampling.mixed_sql(resampling.mixed_sql("g", "h1", PERMUTED, ["draw", "place"]), "h2", PERMUTED + 1, ["draw", "place"])


@register("stat_permutation", f"""WITH o AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS place, count(*) OVER () AS n, (value > 100)::INT AS f, count(*) FILTER (value > 100) OVER () AS k FROM events),
  g AS (SELECT d AS draw, place, n, k, f FROM o, range({PERMUTATIONS + 1}) t(d)),
  e AS (SELECT draw, place, n, k, CASE WHEN draw = 0 THEN f = 1 ELSE row_number() OVER (PARTITION BY draw ORDER BY h1, h2 >> 2, place) <= k END AS chosen FROM {_PLACE_HASH}),
  c AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY place) AS u, place - lag(place) OVER (PARTITION BY draw ORDER BY place) = 1 AS follows FROM e WHERE chosen),
  s AS (SELECT draw, n, k, max(greatest(abs(u / k - (place + 1) / n), abs((u - 1) / k - place / n))) AS ks, count(*) FILTER (follows) AS adjacent FROM c GROUP BY ALL),
  b AS (SELECT draw, place // 500 AS b, count(*) AS m, count(*) FILTER (chosen) AS kb, k / n AS q FROM e GROUP BY ALL), x AS (SELECT draw, sum((kb - m * q) ** 2 / (m * q * (1 - q))) AS chi2 FROM b GROUP BY draw),
  l AS (SELECT draw, n, k, 'ks' AS test, ks AS v FROM s UNION ALL SELECT draw, n, k, 'chi2', chi2 FROM s JOIN x USING (draw) UNION ALL SELECT draw, n, k, 'adjacent', adjacent::DOUBLE FROM s)
  SELECT r.test, r.n, r.k, round(r.v, 6) + 0.0 AS statistic, round(((SELECT count(*) FROM l WHERE l.test = r.test AND l.draw > 0 AND l.v >= r.v - 1e-9 * abs(r.v)) + 1) / {PERMUTATIONS + 1}, 6) + 0.0 AS p, {PERMUTATIONS} AS draws FROM l r WHERE r.draw = 0""")
def stat_permutation(spark, sf_dir):
    """Growth, blocks of 500 and adjacency of large events along the run, against random subsets."""
    return rounded(resampling.permutation_tests(read(spark, sf_dir, "events"), F.col("value") > 100, "event_id", "event_id", PERMUTATIONS, PERMUTED, 500))


@register("stat_block_chi2", """WITH b AS (SELECT event_id // 500 AS block, count(*) AS n, count(*) FILTER (value > 100) AS k FROM events GROUP BY 1), s AS (SELECT sum(k) / sum(n) AS p FROM b)
  SELECT count(*) AS blocks, round(sum((k - n * p) ** 2 / (n * p * (1 - p))), 6) + 0.0 AS chi2, round(max(p), 6) + 0.0 AS share FROM b, s""")
def stat_block_chi2(spark, sf_dir):
    return rounded(resampling.block_chi2(read(spark, sf_dir, "events"), F.col("value") > 100, "event_id", 500))


@register("stat_adjacency", "SELECT count(*) AS adjacent FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.value > 100 AND b.value > 100")
def stat_adjacency(spark, sf_dir):
    return resampling.adjacent(read(spark, sf_dir, "events"), F.col("value") > 100, "event_id")


@register("stat_interval_scan", "SELECT cut::DOUBLE AS cut, count(*) AS n, round(sqrt(avg(l_tax * l_tax)), 6) + 0.0 AS rmse, round(avg(l_tax), 6) + 0.0 AS mean FROM lineitem, (SELECT unnest([10, 20, 40]) AS cut) WHERE l_quantity <= cut GROUP BY cut")
def stat_interval_scan(spark, sf_dir):
    return rounded(resampling.interval_scan(read(spark, sf_dir, "lineitem"), "l_quantity", "l_tax", [10, 20, 40]))


def _features(spark, sf_dir, shared=False):
    w = waves(spark, sf_dir)
    return w.select("event_id", "y", "s1", "s2", M.pair_features(F.col("s1"), F.col("s2"), shared).alias("x"))


def solved_sql(sums: str, size: int, name: str) -> str:
    """CTEs that solve systems by elimination without pivoting, as their matrices are positive.

    ``sums`` gives grp, i, j, v for 0 <= i < size and 0 <= j <= size, the last column the right side;
    ``name`` then has grp, i and w.
    """
    return f"""{name}_e AS (SELECT 0 AS k, grp, i, j, v FROM ({sums})
    UNION ALL SELECT k + 1, grp, i, j, CASE WHEN i = k THEN v / p ELSE v - f * r / p END
    FROM (SELECT *, max(CASE WHEN i = k AND j = k THEN v END) OVER (PARTITION BY grp) AS p, max(CASE WHEN j = k THEN v END) OVER (PARTITION BY grp, i) AS f, max(CASE WHEN i = k THEN v END) OVER (PARTITION BY grp, j) AS r FROM {name}_e) WHERE k < {size}),
  {name} AS (SELECT grp, i, v AS w FROM {name}_e WHERE k = {size} AND j = {size})"""


def ridge_sql(x: str, size: int, alpha: str, intercept: bool = True, name: str = "m") -> str:
    """CTEs with the ridge weights ``{name}`` (grp 0, i, w) of y on the list ``x`` of the CTE w; i = 0 is the intercept, if there is one."""
    first = "[1.0::DOUBLE] || " if intercept else ""
    n = size + intercept
    free = "a.i > 0 AND " if intercept else ""
    return f"""{name}_z AS (SELECT event_id, unnest(range({n + 1})) AS i, unnest({first}{x} || [y]) AS v FROM w),
  {solved_sql(f"SELECT 0 AS grp, a.i, b.i AS j, sum(a.v * b.v) + CASE WHEN {free}a.i = b.i THEN {alpha} ELSE 0 END AS v FROM {name}_z a JOIN {name}_z b USING (event_id) WHERE a.i < {n} GROUP BY a.i, b.i", n, name)}"""


def predicted_sql(x: str, name: str = "m", intercept: bool = True) -> str:
    """A prediction of the list ``x`` by the weights ``name`` in scope."""
    weights = f"(SELECT list(w ORDER BY i) FROM {name} WHERE i >= {int(intercept)})"
    return (f"(SELECT w FROM {name} WHERE i = 0) + " if intercept else "") + f"list_dot_product({x}, {weights})"


_ALL = "s1 || s2"
_GAP = "list_transform(range(1, 33), lambda i: s1[i] - s2[i])"


@register("ml_ridge_direct", f"WITH RECURSIVE w AS ({WAVES}), {ridge_sql(_ALL, 64, '4')} SELECT event_id, round(y, 6) + 0.0 AS y, round({predicted_sql(_ALL)}, 6) + 0.0 AS prediction FROM w")
def ml_ridge_direct(spark, sf_dir):
    f = _features(spark, sf_dir)
    return rounded(f.select("event_id", "y", M.linear(F.col("x"), M.fit_ridge(f, "x", "y", 4.0)).alias("prediction")))


@register("ml_ridge_shared", f"WITH RECURSIVE w AS ({WAVES}), {ridge_sql(_GAP, 32, '4', False)} SELECT event_id, round({predicted_sql(_GAP, intercept=False)}, 6) + 0.0 AS prediction FROM w")
def ml_ridge_shared(spark, sf_dir):
    f = _features(spark, sf_dir, shared=True)
    return rounded(f.select("event_id", M.linear(F.col("x"), M.fit_ridge(f, "x", "y", 4.0, intercept=False)).alias("prediction")))


@register("ml_ridge_composite", f"WITH RECURSIVE w AS ({WAVES}), {ridge_sql(_ALL, 64, 'CASE WHEN a.i <= 32 THEN 4 ELSE 17 END')} SELECT event_id, round({predicted_sql(_ALL)}, 6) + 0.0 AS prediction FROM w")
def ml_ridge_composite(spark, sf_dir):
    f = _features(spark, sf_dir)
    return rounded(f.select("event_id", M.linear(F.col("x"), M.fit_ridge(f, "x", "y", 0.0, blocks=(32, 32), alphas=(4.0, 17.0))).alias("prediction")))


@register("ml_swap_diagnostic", f"WITH RECURSIVE w AS ({WAVES}), {ridge_sql(_GAP, 32, '4', False)}, r AS (SELECT {predicted_sql(_GAP, intercept=False)} AS there, {predicted_sql(_GAP.replace('s1[i] - s2[i]', 's2[i] - s1[i]'), intercept=False)} AS back FROM w) SELECT round(sqrt(avg((there + back) ** 2)), 6) + 0.0 AS swap_rmse FROM r")
def ml_swap_diagnostic(spark, sf_dir):
    f = _features(spark, sf_dir, shared=True)
    w = M.fit_ridge(f, "x", "y", 4.0, intercept=False)
    return rounded(M.swap_rmse(f, "s1", "s2", lambda a, b: M.linear(M.pair_features(a, b, True), w)))


def folded_sql(alphas: list[float]) -> str:
    """CTE ``e``: RMSE of every fold (fold_id) for every penalty (alpha), by ridge on the other folds."""
    return f"""w AS ({WAVES}), o AS (SELECT *, row_number() OVER (ORDER BY {_md5("event_id || ':cv'")}, event_id) - 1 AS p, count(*) OVER () AS n FROM w),
  f AS (SELECT event_id, s1 || s2 AS x, y, (1 + CASE WHEN p < (n % 5) * (n // 5 + 1) THEN p // (n // 5 + 1) ELSE n % 5 + (p - (n % 5) * (n // 5 + 1)) // (n // 5) END)::INT AS fold_id FROM o),
  z AS (SELECT event_id, fold_id, unnest(range(66)) AS i, unnest([1.0::DOUBLE] || x || [y]) AS v FROM f), g AS (SELECT a.fold_id, a.i, b.i AS j, sum(a.v * b.v) AS v FROM z a JOIN z b USING (event_id) WHERE a.i < 65 GROUP BY ALL),
  t AS (SELECT k.fold_id, i, j, sum(v) AS v FROM g JOIN (SELECT DISTINCT fold_id FROM f) k ON k.fold_id <> g.fold_id GROUP BY ALL), c AS (SELECT unnest({alphas})::DOUBLE AS alpha),
  {solved_sql("SELECT fold_id || ':' || alpha AS grp, i, j, v + CASE WHEN i = j AND i > 0 THEN alpha ELSE 0 END AS v FROM t, c", 65, "m")},
  v AS (SELECT grp, max(w) FILTER (i = 0) AS w0, list(w ORDER BY i) FILTER (i > 0) AS ws FROM m GROUP BY grp),
  e AS (SELECT alpha, fold_id, sqrt(avg((y - w0 - list_dot_product(x, ws)) ** 2)) AS rmse FROM f JOIN c ON true JOIN v ON grp = fold_id || ':' || alpha GROUP BY alpha, fold_id)"""


_NAMED = "'alpha=' || CASE WHEN alpha >= 1 THEN alpha::BIGINT::VARCHAR ELSE alpha::VARCHAR END"


@register("ml_cross_validation", f"""WITH RECURSIVE {folded_sql([0.1, 1.0, 10.0, 100.0])}, s AS (SELECT {_NAMED} AS candidate_id, avg(rmse) AS mean, stddev_samp(rmse) AS std, count(*) AS completed FROM e GROUP BY alpha)
  SELECT candidate_id, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, completed, false AS partial, row_number() OVER (ORDER BY s.mean, candidate_id) = 1 AS selected FROM s""")
def ml_cross_validation(spark, sf_dir):
    f = ranking.folds(_features(spark, sf_dir), "event_id", 5, "cv")
    return rounded(M.select_candidate(M.cross_validate(f, "x", "y", "fold_id", [0.1, 1.0, 10.0, 100.0]), "rmse", 5))


@register("ml_parzen_search")
def ml_parzen_search(spark, sf_dir):
    """Penalty and form of ridge by density ratios: the trials, each a cross-validation."""
    from ..operators import scratch, search

    folded = {k: ranking.folds(_features(spark, sf_dir, shared=k == "shared"), "event_id", 5, "cv") for k in ("direct", "shared")}
    sums = {k: {fold: z for (fold,), z in M.squares(M.gram(f, "x", "y", ["fold_id"]), ["fold_id"]).items()} for k, f in folded.items()}

    def error(p: dict) -> float:
        return float(np.mean([e for *_, e in M.fold_errors(sums[p["form"]], [p["alpha"]])]))

    space = {"alpha": search.Real(1e-3, 1e4, log=True), "form": search.Choice(("direct", "shared"))}
    study = search.Study(spark, scratch.folder(spark), "ridge", space, seed=5, startup=6)
    study.run(error, 16)
    return rounded(study.trials().select("trial", "parameters", "value"))


@register("ml_pruning", f"""WITH RECURSIVE {folded_sql([0.1, 10.0, 1000.0])}, x AS (SELECT {_NAMED} AS candidate_id, count(*) AS common_folds, avg(a.rmse - b.rmse) AS worse FROM e a JOIN (SELECT fold_id, rmse FROM e WHERE alpha = 10) b USING (fold_id) WHERE alpha <> 10 GROUP BY alpha)
  SELECT candidate_id, common_folds, round(worse, 6) + 0.0 AS excess, worse > 0.001 AS pruned FROM x""")
def ml_pruning(spark, sf_dir):
    f = ranking.folds(_features(spark, sf_dir), "event_id", 5, "cv")
    return rounded(M.pruned(M.cross_validate(f, "x", "y", "fold_id", [0.1, 10.0, 1000.0]), "rmse", "alpha=10", 0.001))


KNN = f"""w AS ({WAVES}), v AS (SELECT event_id, y, unnest(s1) AS v, unnest(range(32)) AS i FROM w), d AS (SELECT a.event_id AS id, b.event_id AS ref_id, sum((a.v - b.v) ** 2) AS distance2 FROM v a JOIN v b ON a.i = b.i AND a.event_id <> b.event_id GROUP BY ALL),
  n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance2, ref_id)::INT AS rank FROM d QUALIFY rank <= 5)"""


@register("join_knn", f"WITH {KNN} SELECT id, rank, ref_id, round(distance2, 6) + 0.0 AS distance2 FROM n")
def join_knn(spark, sf_dir):
    w = waves(spark, sf_dir)
    return rounded(M.nearest(w, w, "event_id", "s1", 5))


@register("imp_knn_expectation", f"WITH {KNN} SELECT id, rank AS k, round(avg(y) OVER (PARTITION BY id ORDER BY rank), 6) + 0.0 AS prediction FROM n JOIN w ON w.event_id = ref_id")
def imp_knn_expectation(spark, sf_dir):
    w = waves(spark, sf_dir)
    return rounded(M.neighbour_mean(M.nearest(w, w, "event_id", "s1", 5), w, "event_id", "y"))


@register("imp_knn_weighted", f"WITH {KNN} SELECT id, rank AS k, round(sum(y / sqrt(distance2)) OVER x / sum(1 / sqrt(distance2)) OVER x, 6) + 0.0 AS prediction FROM n JOIN w ON w.event_id = ref_id WINDOW x AS (PARTITION BY id ORDER BY rank)")
def imp_knn_weighted(spark, sf_dir):
    w = waves(spark, sf_dir)
    return rounded(M.neighbour_mean(M.nearest(w, w, "event_id", "s1", 5), w, "event_id", "y", by_distance=True))


@register("imp_knn_tuned", f"""WITH w AS ({WAVES}), v AS (SELECT event_id, unnest(s1) AS v, unnest(range(32)) AS i FROM w), h AS (SELECT * FROM v WHERE i BETWEEN 10 AND 13), o AS (SELECT * FROM v WHERE i NOT BETWEEN 10 AND 13),
  d AS (SELECT a.event_id AS id, b.event_id AS ref_id, sum((a.v - b.v) ** 2) AS d2 FROM o a JOIN o b ON a.i = b.i AND a.event_id <> b.event_id GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, ref_id) AS k FROM d QUALIFY k <= 8),
  p AS (SELECT id, i, k, avg(v) OVER x AS flat, sum(v / sqrt(d2)) OVER x / sum(1 / sqrt(d2)) OVER x AS near FROM n JOIN h ON h.event_id = ref_id WINDOW x AS (PARTITION BY id, i ORDER BY k)),
  e AS (SELECT k, sqrt(avg((flat - v) ** 2)) AS a, sqrt(avg((near - v) ** 2)) AS b FROM p JOIN h ON h.event_id = id AND h.i = p.i GROUP BY k), u AS (SELECT k, false AS by_distance, a AS rmse FROM e UNION ALL SELECT k, true, b FROM e)
  SELECT k::INT AS k, by_distance, round(rmse, 6) + 0.0 AS rmse, row_number() OVER (ORDER BY rmse, k, by_distance) = 1 AS selected FROM u""")
def imp_knn_tuned(spark, sf_dir):
    return rounded(M.tuned_neighbours(waves(spark, sf_dir), "event_id", "s1", [10, 11, 12, 13], 8))


@register("imp_ppca")
def imp_ppca(spark, sf_dir):
    w = waves(spark, sf_dir)
    return M.ppca_fill(w, "event_id", "s1", M.fit_ppca(w, "s1", 4), [10, 11, 12])


@register("imp_blend_weight", f"WITH w AS ({WAVES}), p AS (SELECT unnest(s1) AS a, unnest(s2) AS b FROM w) SELECT round(least(1, greatest(0, sum((0.1 - b) * (a - b)) / sum((a - b) ** 2))), 6) + 0.0 AS alpha FROM p")
def imp_blend_weight(spark, sf_dir):
    p = waves(spark, sf_dir).select(F.explode(F.arrays_zip("s1", "s2")).alias("z")).select(F.col("z.s1").alias("a"), F.col("z.s2").alias("b"), F.lit(0.1).alias("t"))
    return rounded(M.blend_weight(p, "a", "b", "t"))


@register("imp_benchmark", f"""WITH w AS ({WAVES}), v AS (SELECT event_id, unnest(s1) AS v, unnest(range(32)) AS i FROM w), m AS (SELECT i, avg(v) AS m FROM v GROUP BY i),
  g AS (SELECT event_id, max(v) FILTER (i = 9) AS l, max(v) FILTER (i = 14) AS r FROM v GROUP BY 1), e AS (SELECT i, v - m AS mean_error, v - (l + (r - l) * (i - 9) / 5) AS line_error FROM v JOIN m USING (i) JOIN g USING (event_id) WHERE i BETWEEN 10 AND 13)
  SELECT method, round(sqrt(avg(e * e)), 6) + 0.0 AS rmse FROM (SELECT 'mean' AS method, mean_error AS e FROM e UNION ALL SELECT 'line', line_error FROM e) GROUP BY method""")
def imp_benchmark(spark, sf_dir):
    """Pooled error of two imputers over hidden samples."""
    from ..functions import arrays as A

    w = waves(spark, sf_dir).select("event_id", "s1", A.interpolated(F.col("s1"), F.lit(10), F.lit(13)).alias("line"))
    v = w.select(F.posexplode(F.arrays_zip("s1", "line")).alias("i", "z")).select("i", F.col("z.s1").alias("v"), F.col("z.line").alias("line"))
    m = v.groupBy("i").agg(F.avg("v").alias("m"))
    e = v.where("i between 10 and 13").join(m, "i").select(F.explode(F.array(F.struct(F.lit("mean").alias("method"), (F.col("v") - F.col("m")).alias("e")), F.struct(F.lit("line").alias("method"), (F.col("v") - F.col("line")).alias("e")))).alias("x"))
    return rounded(e.groupBy("x.method").agg(F.sqrt(F.avg(F.col("x.e") * F.col("x.e"))).alias("rmse")))


def _linear_predict(weights: np.ndarray):
    return lambda v: weights[0] + v @ weights[1:]


#: The attributions of linear predictions: each window's weighted distance from the mean reference.
SHAPLEY = f"""w AS ({WAVES}), {ridge_sql("s1", 32, "4")}, b AS (SELECT list(w ORDER BY i) FILTER (i > 0) AS ws, max(w) FILTER (i = 0) AS w0 FROM m),
  h AS (SELECT event_id AS id, a::INT AS start, round(list_sum(list_transform(range(a + 1, a + 9), lambda i: ws[i] * (s1[i] - 0.025::DOUBLE))), 6) + 0.0 AS phi FROM w, b, (SELECT unnest([0, 8, 16, 24]) AS a))"""


@register("xai_window_shapley", f"WITH RECURSIVE {SHAPLEY} SELECT id, start, phi FROM h")
def xai_window_shapley(spark, sf_dir):
    w = waves(spark, sf_dir)
    weights = M.fit_ridge(w, "s1", "y", 4.0)
    return rounded(M.window_shapley(w, "event_id", "s1", [[0.0] * 32, [0.05] * 32], 8, 8, _linear_predict(weights)))


@register("xai_signed_summary", f"""WITH RECURSIVE {SHAPLEY} SELECT start, count(*) AS n, round(avg(phi), 6) + 0.0 AS mean, round(avg(greatest(phi, 0)), 6) + 0.0 AS positive, round(avg(least(phi, 0)), 6) + 0.0 AS negative, round(avg(abs(phi)), 6) + 0.0 AS absolute FROM h GROUP BY start""")
def xai_signed_summary(spark, sf_dir):
    return rounded(M.signed_summary(xai_window_shapley(spark, sf_dir)))


@register("sig_periodogram", f"""WITH w AS ({WAVES}), v AS (SELECT event_id, i, (v - avg(v) OVER (PARTITION BY event_id)) * (0.5 - 0.5 * cos(2 * pi() * i / 31)) AS v FROM (SELECT event_id, unnest(s1) AS v, unnest(range(32)) AS i FROM w)),
  f AS (SELECT event_id, bin, sum(v * cos(2 * pi() * bin * i / 32)) AS re, -sum(v * sin(2 * pi() * bin * i / 32)) AS im FROM v, range(17) t(bin) GROUP BY ALL),
  g AS (SELECT bin::INT AS bin, count(*) AS n, avg(re) AS re, avg(im) AS im, avg(re * re + im * im) AS total, sqrt(avg(re / sqrt(re * re + im * im)) ** 2 + avg(im / sqrt(re * re + im * im)) ** 2) AS consistency FROM f GROUP BY bin)
  SELECT bin, n, round(total, 8) + 0.0 AS total, round(re * re + im * im, 8) + 0.0 AS coherent, round(total - re * re - im * im, 8) + 0.0 AS variable, round(consistency, 8) + 0.0 AS consistency FROM g""")
def sig_periodogram(spark, sf_dir):
    return rounded(M.periodogram(waves(spark, sf_dir), "s1"), 8)


@register("ml_ensemble", """WITH b AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1) SELECT o_orderkey, round((o_totalprice + v) / 2, 4) + 0.0 AS p FROM orders JOIN b ON k = o_orderkey""")
def ml_ensemble(spark, sf_dir):
    return rounded(pairs(spark, sf_dir).select(F.col("event_id").alias("o_orderkey"), ((F.col("a") + F.col("b")) / 2).alias("p")), 4)


@register("rpt_alignment_study", """WITH l AS (SELECT l_returnflag AS mode, l_linestatus AS stage, l_quantity AS x FROM lineitem) SELECT mode, stage, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(stddev_samp(x), 6) + 0.0 AS std,
  round(median(x), 6) + 0.0 AS median, round(quantile_cont(x, 0.25), 6) + 0.0 AS q1, round(quantile_cont(x, 0.75), 6) + 0.0 AS q3, round(quantile_cont(x, 0.01), 6) + 0.0 AS p01, round(quantile_cont(x, 0.99), 6) + 0.0 AS p99 FROM l GROUP BY ALL""")
def rpt_alignment_study(spark, sf_dir):
    from ..operators import robust

    d = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("mode"), F.col("l_linestatus").alias("stage"), F.col("l_quantity").alias("x"))
    return rounded(robust.summary(d, "x", ["mode", "stage"]))


@register("rpt_threshold_trade_off", """WITH s AS (SELECT o_custkey % 7 AS threshold, o_orderstatus AS run, count(*) AS n_photopeak, count(*) FILTER (o_orderpriority <> '5-LOW') AS n_valid FROM orders GROUP BY ALL)
  SELECT threshold, run, n_photopeak, n_valid, round(n_valid / n_photopeak, 6) + 0.0 AS efficiency FROM s QUALIFY row_number() OVER (PARTITION BY threshold ORDER BY n_valid DESC, run) = 1""")
def rpt_threshold_trade_off(spark, sf_dir):
    s = read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 7).alias("threshold"), F.col("o_orderstatus").alias("run")).agg(F.count("*").alias("n_photopeak"), F.count_if(F.col("o_orderpriority") != "5-LOW").alias("n_valid"))
    return rounded(ranking.top_per_key(s, ["threshold"], [F.desc("n_valid"), F.asc("run")]).withColumn("efficiency", F.col("n_valid") / F.col("n_photopeak")))


@register("rpt_stage_counts", """SELECT stage, n, round(n / max(n) OVER (), 6) + 0.0 AS fraction FROM (SELECT unnest(['0 read', '1 energy', '2 coincidence']) AS stage, unnest([count(*), count(*) FILTER (value > 10), count(*) FILTER (value > 10 AND value < 100)]) AS n FROM events)""")
def rpt_stage_counts(spark, sf_dir):
    e = read(spark, sf_dir, "events").agg(F.count("*").alias("a"), F.count_if(F.col("value") > 10).alias("b"), F.count_if((F.col("value") > 10) & (F.col("value") < 100)).alias("c"))
    s = e.select(F.col("a"), F.stack(F.lit(3), F.lit("0 read"), F.col("a"), F.lit("1 energy"), F.col("b"), F.lit("2 coincidence"), F.col("c")).alias("stage", "n"))
    return rounded(s.select("stage", "n", F.try_divide("n", "a").alias("fraction")))


@register("rpt_model_matrix", """WITH m AS (SELECT l_orderkey AS e, l_returnflag AS m, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), c AS (SELECT a.m AS model, b.m AS other, round(corr(a.v, b.v), 6) + 0.0 AS r FROM m a JOIN m b USING (e) GROUP BY ALL)
  SELECT model, max(r) FILTER (other = 'A') AS "A", max(r) FILTER (other = 'N') AS "N", max(r) FILTER (other = 'R') AS "R" FROM c GROUP BY model""")
def rpt_model_matrix(spark, sf_dir):
    m = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("e"), F.col("l_returnflag").alias("model")).agg(F.sum("l_quantity").alias("v"))
    c = m.join(m.select("e", F.col("model").alias("other"), F.col("v").alias("w")), "e")
    return rounded(c.groupBy("model").pivot("other", ["A", "N", "R"]).agg(F.corr("v", "w")))


@register("rpt_window_comparison", """WITH s AS (SELECT l_returnflag AS w, l_suppkey % 10 AS model, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL) SELECT w, model, round(m, 4) + 0.0 AS metric FROM s QUALIFY row_number() OVER (PARTITION BY w ORDER BY m, model) = 1""")
def rpt_window_comparison(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("w"), (F.col("l_suppkey") % 10).alias("model")).agg(F.avg("l_extendedprice").alias("metric"))
    return rounded(ranking.top_per_key(s, ["w"], [F.asc("metric"), F.asc("model")]), 4)


@register("rpt_differing_fields", """WITH f AS (SELECT n_regionkey AS family, unnest(['nationkey_mod', 'region']) AS field, unnest([(n_nationkey % 2)::VARCHAR, n_regionkey::VARCHAR]) AS v FROM nation) SELECT family, field, count(DISTINCT v) AS n FROM f GROUP BY ALL HAVING count(DISTINCT v) > 1""")
def rpt_differing_fields(spark, sf_dir):
    """Configuration fields whose values differ inside a family."""
    m = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("family"), F.explode(F.create_map(F.lit("nationkey_mod"), (F.col("n_nationkey") % 2).cast("string"), F.lit("region"), F.col("n_regionkey").cast("string"))).alias("field", "v"))
    return m.groupBy("family", "field").agg(F.count_distinct("v").alias("n")).where("n > 1")


@register("rpt_consistent_metadata", "SELECT o_custkey, min(o_orderdate) AS first FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1")
def rpt_consistent_metadata(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"), F.count_distinct("o_orderstatus").alias("n")).where("n = 1").select("o_custkey", "first")


@register("rpt_reference_consistency", "SELECT l_linestatus, max(l_tax) - min(l_tax) <= 0.000001 AS consistent, count(*) AS n FROM lineitem GROUP BY 1")
def rpt_reference_consistency(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg((F.max("l_tax") - F.min("l_tax") <= 1e-6).alias("consistent"), F.count("*").alias("n"))


@register("rpt_result_groups", "SELECT c_nationkey, count(DISTINCT c_mktsegment) AS digests, count(*) AS n FROM customer GROUP BY 1")
def rpt_result_groups(spark, sf_dir):
    return read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count_distinct("c_mktsegment").alias("digests"), F.count("*").alias("n"))


@register("orc_sweep", """SELECT m.n_name AS mode, w.r_name AS win FROM nation m, region w WHERE NOT (m.n_nationkey = 1 AND w.r_regionkey = 2)""")
def orc_sweep(spark, sf_dir):
    """All combinations of small dimensions minus the excluded ones (a bounded product of configurations)."""
    modes = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("mode"))
    # the other dimension is one array on one row
    windows = read(spark, sf_dir, "region").agg(F.collect_list(F.struct(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))).alias("all"))
    each = modes.join(F.broadcast(windows)).select("k", "mode", F.explode("all").alias("w"))
    return each.where(~((F.col("k") == 1) & (F.col("w.k") == 2))).select("mode", F.col("w.name").alias("win"))


@register("win_previous_event", "SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events")
def win_previous_event(spark, sf_dir):
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return read(spark, sf_dir, "events").select("event_id", (t - F.lag(t).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("gap"))
