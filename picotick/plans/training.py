"""Queries over candidates, growing windows, iterative fits, kept models and feature blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import imputing as I
from ..operators import models as M
from ..operators import neural as N
from ..operators import ranking, scratch
from ..operators import training as T
from .modelling import _md5, solved_sql
from .registry import register
from .tables import WAVES, read, rounded, waves


def _prices(spark, sf_dir):
    """fold, x = [quantity, discount in percent], y = price in thousands."""
    return read(spark, sf_dir, "lineitem").select(
        "l_linenumber", (F.col("l_orderkey") % 4).cast("int").alias("fold"), F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double") * 100).alias("x"), (F.col("l_extendedprice").cast("double") / 1000).alias("y"))


PRICES = "r AS (SELECT l_linenumber, l_orderkey % 4 AS fold, l_quantity::DOUBLE AS a, l_discount::DOUBLE * 100 AS b, l_extendedprice::DOUBLE / 1000 AS y FROM lineitem)"
CENTRED = "avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS by_"
PLANE = "(ay * (bb + alpha) - by_ * ab) / ((aa + alpha) * (bb + alpha) - ab * ab) AS wa, (by_ * (aa + alpha) - ay * ab) / ((aa + alpha) * (bb + alpha) - ab * ab) AS wb"


@register("ml_progressive_windows", f"""WITH {PRICES}, t AS (SELECT k.fold AS held, {CENTRED} FROM r JOIN (SELECT DISTINCT fold FROM r) k ON k.fold <> r.fold GROUP BY k.fold),
  c AS (SELECT * FROM t, (SELECT unnest([1.0::DOUBLE, 100000.0::DOUBLE]) AS alpha)),
  w AS (SELECT held, alpha, ma, mb, my, 1 AS n_features, ay / (aa + alpha) AS wa, 0.0::DOUBLE AS wb FROM c UNION ALL SELECT held, alpha, ma, mb, my, 2, {PLANE} FROM c),
  e AS (SELECT n_features, alpha, fold, sqrt(avg((y - my - wa * (a - ma) - wb * (b - mb)) ** 2)) AS rmse FROM w JOIN r ON fold = held GROUP BY ALL),
  s AS (SELECT n_features, alpha, avg(rmse) AS mean, stddev_samp(rmse) AS std FROM e GROUP BY ALL)
  SELECT n_features, CASE WHEN alpha = 1 THEN 'alpha=1' ELSE 'alpha=100000' END AS candidate_id, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, alpha = (SELECT arg_min(alpha, mean) FROM s WHERE n_features = 2) AS frozen FROM s""")
def ml_progressive_windows(spark, sf_dir):
    return rounded(T.frozen_over_windows(T.window_cross_validation(_prices(spark, sf_dir), "x", "y", "fold", {"n_features": [1, 2], "alpha": [1.0, 1e5]})))


@register("ml_ridge_iterative", f"""WITH {PRICES}, w AS (SELECT ma, mb, my, {PLANE} FROM (SELECT *, 4.0::DOUBLE AS alpha FROM (SELECT {CENTRED} FROM r)))
  SELECT unnest([0, 1, 2])::INT AS i, unnest([round(my - wa * ma - wb * mb, 6) + 0.0, round(wa, 6) + 0.0, round(wb, 6) + 0.0]) AS weight FROM w""")
def ml_ridge_iterative(spark, sf_dir):
    w = T.fit_ridge_iteratively(_prices(spark, sf_dir), "x", "y", 4.0)
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "i int, weight double"))


@register("ml_saved_model", f"""WITH {PRICES}, w AS (SELECT ma, mb, my, {PLANE} FROM (SELECT *, 4.0::DOUBLE AS alpha FROM (SELECT {CENTRED} FROM r)))
  SELECT l_linenumber, round(sqrt(avg((y - my - wa * (a - ma) - wb * (b - mb)) ** 2)), 6) + 0.0 AS rmse FROM r, w GROUP BY 1""")
def ml_saved_model(spark, sf_dir):
    """Fits, saves, reads the saved model and applies that."""
    p, path = _prices(spark, sf_dir), scratch.folder(spark)
    T.save_model(spark, path, {"weights": M.fit_ridge(p, "x", "y", 4.0), "mask": [1, 1]})
    error = F.col("y") - M.linear(F.col("x"), T.load_model(spark, path, ("weights", "mask"))["weights"])
    return rounded(p.groupBy("l_linenumber").agg(F.sqrt(F.avg(error * error)).alias("rmse")))


VALUES = f"w AS ({WAVES}), u AS (SELECT event_id, unnest(range(32)) AS i, unnest(s1) AS a, unnest(s2) AS b FROM w)"


@register("ml_sparse_scale", f"""WITH {VALUES}, v AS (SELECT event_id, i, sqrt(greatest(a, 0)) AS x FROM u), p AS (SELECT i, avg(x) AS m, stddev_samp(x) + avg((x = 0)::INT) ** 4 + 0.00000001 AS sd FROM v GROUP BY i)
  SELECT event_id, round(sum(CASE WHEN x = 0 THEN 0 ELSE (x - m) / sd END), 6) + 0.0 AS total FROM v JOIN p USING (i) GROUP BY 1""")
def ml_sparse_scale(spark, sf_dir):
    w = waves(spark, sf_dir)
    return rounded(T.sparse_scaled(w, w, "s1").select("event_id", F.aggregate("s1", F.lit(0.0), lambda s, v: s + v).alias("total")))


@register("ml_feature_blocks", f"""WITH {VALUES}, p AS (SELECT i, stddev_samp(a) AS sa, stddev_samp(b) AS sb FROM u GROUP BY i)
  SELECT event_id, 64 AS n, round(sum(a / sa + b / sb), 6) + 0.0 AS total FROM u JOIN p USING (i) GROUP BY 1""")
def ml_feature_blocks(spark, sf_dir):
    w = waves(spark, sf_dir)
    return rounded(T.feature_blocks(w, w, ["s1", "s2"], "x").select("event_id", F.size("x").alias("n"), F.aggregate("x", F.lit(0.0), lambda s, v: s + v).alias("total")))


@register("ml_pooled_kernels")
def ml_pooled_kernels(spark, sf_dir):
    w = waves(spark, sf_dir)
    return rounded(T.kernel_features(w, "event_id", "s1", T.fit_kernel_biases(w, "event_id", "s1")))


@register("ml_shapelets")
def ml_shapelets(spark, sf_dir):
    w = waves(spark, sf_dir)
    return rounded(X.shapelet_features(w, "event_id", "s1", X.fit_shapelets(w, "event_id", "s1", 100)))


@register("ml_competing_kernels")
def ml_competing_kernels(spark, sf_dir):
    """Features scaled as sparse counts."""
    f = X.competing_kernel_features(waves(spark, sf_dir), "event_id", "s1")
    return T.sparse_scaled(f, f, "features")


def _pair_ridge(spark, sf_dir, values, *, sparse=False, alpha=50.0):
    """Ridge on phi(s1) - phi(s2): predictions, and what a swap of the detectors leaves of them."""
    w = waves(spark, sf_dir)
    f = scratch.stored(X.paired(w, "event_id", "s1", "s2", values, keep=("y",)))
    x = T.scaled_pair(f, f, "a", "b", "x", shared=True, sparse=sparse)
    weights = M.fit_ridge(x, "x", "y", alpha, intercept=False)
    swapped = T.scaled_pair(f, f.select("id", "y", F.col("b").alias("a"), F.col("a").alias("b")), "a", "b", "x", shared=True, sparse=sparse)
    both = x.select("id", M.linear(F.col("x"), weights).alias("prediction")).join(swapped.select("id", M.linear(F.col("x"), weights).alias("other")), "id")
    return rounded(both.select(F.col("id").alias("event_id"), "prediction", (F.abs(F.col("prediction") + F.col("other")) < 1e-9).alias("antisymmetric")))


@register("ml_pair_pooled_ridge")
def ml_pair_pooled_ridge(spark, sf_dir):
    """Pooled kernel responses with two biases each; every eighth kernel, to stay within one Gram matrix."""
    biases = T.fit_kernel_biases(waves(spark, sf_dir), "event_id", ["s1", "s2"], each=2)
    return _pair_ridge(spark, sf_dir, lambda v: T.pooled_responses(v, biases)[:, ::16])


@register("ml_pair_shapelet_ridge")
def ml_pair_shapelet_ridge(spark, sf_dir):
    shapelets = X.fit_shapelets(waves(spark, sf_dir), "event_id", ["s1", "s2"], 40)
    return _pair_ridge(spark, sf_dir, lambda v: X.shapelet_values(v, shapelets))


@register("ml_pair_competing_ridge")
def ml_pair_competing_ridge(spark, sf_dir):
    kernels = X.competing_kernels(4, 4)
    return _pair_ridge(spark, sf_dir, lambda v: X.competing_values(v, kernels), sparse=True)


@register("ml_tail_phase_ridge")
def ml_tail_phase_ridge(spark, sf_dir):
    """What a ridge on samples leaves, corrected by a ridge on relative phases."""
    w = waves(spark, sf_dir).select("event_id", "y", M.pair_features(F.col("s1"), F.col("s2"), False).alias("x"), X.unit_phases(F.col("s1"), F.col("s2"), [0.125, 0.25], 32, True).alias("phase"))
    left = w.withColumn("residual", F.col("y") - M.linear(F.col("x"), M.fit_ridge(w, "x", "y", 4.0)))
    return rounded(left.select("event_id", "residual", (F.col("residual") - M.linear(F.col("phase"), M.fit_ridge(left, "phase", "residual", 1.0))).alias("corrected")))


@register("imp_ppca_draws")
def imp_ppca_draws(spark, sf_dir):
    w = waves(spark, sf_dir)
    return X.ppca_draws(w, "event_id", "s1", M.fit_ppca(w, "s1", 4), [10, 11, 12], 5)


def _fitted(spark, sf_dir, layers, shape):
    w = waves(spark, sf_dir)
    return w, N.fit(w, "event_id", "s1", "s2", "y", layers, shape, epochs=3, batches=2, rate=0.02)


def _scored(spark, sf_dir, layers, shape):
    """Predictions of a scorer after three epochs."""
    w, model = _fitted(spark, sf_dir, layers, shape)
    return rounded(N.predict(w, model, "event_id", "s1", "s2").withColumnRenamed("id", "event_id"))


DENSE = (N.dense(16), N.TANH, N.dense(1))


@register("ml_neural_direct")
def ml_neural_direct(spark, sf_dir):
    return _scored(spark, sf_dir, DENSE, "direct")


@register("ml_neural_shared_conv")
def ml_neural_shared_conv(spark, sf_dir):
    return _scored(spark, sf_dir, (N.conv(4, 5, 2), N.RELU, N.conv(4, 3), N.RELU, N.dense(1)), "antisymmetric")


@register("ml_neural_fused_conv")
def ml_neural_fused_conv(spark, sf_dir):
    return _scored(spark, sf_dir, (N.conv(6, 5), N.RELU, N.dense(8), N.RELU, N.dense(1)), "fused")


@register("ml_neural_local")
def ml_neural_local(spark, sf_dir):
    return _scored(spark, sf_dir, (N.local(3, 5, 2), N.TANH, N.local(2, 3), N.TANH, N.dense(1), N.bounded(4.0)), "antisymmetric")


@register("ml_neural_swap", "SELECT count(*) AS n, 0.0::DOUBLE AS swap_rmse FROM embeddings")
def ml_neural_swap(spark, sf_dir):
    """An antisymmetric scorer of both orders of the detectors: the sum of the two predictions vanishes."""
    w, model = _fitted(spark, sf_dir, DENSE, "antisymmetric")
    there, back = N.predict(w, model, "event_id", "s1", "s2"), N.predict(w, model, "event_id", "s2", "s1").withColumnRenamed("prediction", "other")
    both = there.join(back, "id").agg(F.count("prediction").alias("n"), F.sqrt(F.avg((F.col("prediction") + F.col("other")) ** 2)).alias("swap_rmse"))
    return rounded(both)


@register("xai_input_gradient")
def xai_input_gradient(spark, sf_dir):
    w, model = _fitted(spark, sf_dir, DENSE, "antisymmetric")
    return rounded(N.importance(w, model, "s1", "s2"))


#: Windows of the imputer bank, which leave the samples between them always visible.
BANK_WINDOWS = [(2, 6), (10, 6), (18, 6), (25, 6)]


def _bank(spark, sf_dir):
    w = waves(spark, sf_dir).withColumn("apart", F.pmod(F.col("event_id"), F.lit(4)) == 0)
    return w, scratch.stored(I.fit_bank(w, "s1", "apart", BANK_WINDOWS))


@register("imp_bank")
def imp_bank(spark, sf_dir):
    """The winning imputer of every set of hidden windows."""
    return rounded(_bank(spark, sf_dir)[1].select("pattern", "method", "rmse"))


@register("imp_bank_visible", f"""WITH w AS ({WAVES}), p AS (SELECT unnest(range(1, 16)) AS pattern), v AS (SELECT event_id AS id, unnest(range(32)) AS i, unnest(s1) AS v FROM w)
  SELECT id, pattern, round(sum(v) FILTER (NOT ((i BETWEEN 2 AND 7 AND pattern & 1 > 0) OR (i BETWEEN 10 AND 15 AND pattern & 2 > 0) OR (i BETWEEN 18 AND 23 AND pattern & 4 > 0) OR (i BETWEEN 25 AND 30 AND pattern & 8 > 0))), 6) + 0.0 AS seen FROM v, p GROUP BY ALL""")
def imp_bank_visible(spark, sf_dir):
    """What reconstruction leaves as it was: the sum of every pattern's visible samples."""
    w, bank = _bank(spark, sf_dir)
    hidden = F.lit(False)
    for b, (start, width) in enumerate(BANK_WINDOWS):
        hidden = hidden | (F.col("i").between(start, start + width - 1) & (F.col("pattern").bitwiseAND(F.lit(1 << b)) > 0))
    filled = I.reconstruct(w, "event_id", "s1", bank, 32).select("id", "pattern", F.posexplode("filled").alias("i", "v"))
    return rounded(filled.groupBy("id", "pattern").agg(F.sum(F.when(~hidden, F.col("v"))).alias("seen")))


@register("xai_local_attribution")
def xai_local_attribution(spark, sf_dir):
    """Attribution and deletion of every event, with hidden windows from the bank."""
    w, bank = _bank(spark, sf_dir)
    weights = M.fit_ridge(w, "s1", "y", 4.0)
    return rounded(I.local_attribution(w, "event_id", "s1", bank, 32, lambda v: weights[0] + v @ weights[1:]))


def _windows(spark, sf_dir, fit, windows):
    w = ranking.folds(waves(spark, sf_dir), "event_id", 5, "cv")
    return rounded(T.frozen_over_windows(T.refitted_windows(w, "event_id", "s1", "s2", "y", "fold_id", windows, fit, [1.0, 100.0])))


@register("ml_refitted_windows", f"""WITH RECURSIVE w AS ({WAVES}), o AS (SELECT *, row_number() OVER (ORDER BY {_md5("event_id || ':cv'")}, event_id) - 1 AS p, count(*) OVER () AS n FROM w),
  f AS (SELECT event_id, s1, s2, y, (1 + CASE WHEN p < (n % 5) * (n // 5 + 1) THEN p // (n // 5 + 1) ELSE n % 5 + (p - (n % 5) * (n // 5 + 1)) // (n // 5) END)::INT AS fold_id FROM o),
  d AS (SELECT unnest(range(32)) AS i, unnest(s1) AS a, unnest(s2) AS b FROM w), g AS (SELECT i, stddev_pop(v) AS sd FROM (SELECT i, a AS v FROM d UNION ALL SELECT i, b FROM d) GROUP BY i), sds AS (SELECT list(sd ORDER BY i) AS sds FROM g),
  x AS (SELECT event_id, fold_id, y, list_transform(range(1, 33), lambda i: (s1[i] - s2[i]) / sds[i]) AS x FROM f, sds),
  z AS (SELECT event_id, fold_id, unnest(range(33)) AS i, unnest(x || [y]) AS v FROM x), m AS (SELECT a.fold_id, a.i, b.i AS j, sum(a.v * b.v) AS v FROM z a JOIN z b USING (event_id) WHERE a.i < 32 GROUP BY ALL),
  t AS (SELECT k.fold_id, i, j, sum(v) AS v FROM m JOIN (SELECT DISTINCT fold_id FROM f) k ON k.fold_id <> m.fold_id GROUP BY ALL), c AS (SELECT unnest([1.0, 100.0])::DOUBLE AS alpha),
  {solved_sql("SELECT fold_id || ':' || alpha AS grp, i, CASE WHEN j = 32 THEN 8 ELSE j END AS j, v + CASE WHEN i = j THEN alpha ELSE 0 END AS v FROM t, c WHERE i < 8 AND (j < 8 OR j = 32)", 8, "u")},
  {solved_sql("SELECT fold_id || ':' || alpha AS grp, i, j, v + CASE WHEN i = j THEN alpha ELSE 0 END AS v FROM t, c", 32, "q")},
  v AS (SELECT 8 AS n_features, grp, list(w ORDER BY i) AS ws FROM u GROUP BY grp UNION ALL SELECT 32, grp, list(w ORDER BY i) FROM q GROUP BY grp),
  e AS (SELECT n_features, alpha, fold_id, sqrt(avg((y - list_dot_product(x[1:n_features], ws)) ** 2)) AS rmse FROM x JOIN c ON true JOIN v ON grp = fold_id || ':' || alpha GROUP BY ALL),
  s AS (SELECT n_features, alpha, avg(rmse) AS mean, stddev_samp(rmse) AS std FROM e GROUP BY n_features, alpha)
  SELECT n_features::INT AS n_features, 'alpha=' || alpha::INT AS candidate_id, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, alpha = (SELECT arg_min(alpha, mean) FROM s WHERE n_features = 32) AS frozen FROM s""")
def ml_refitted_windows(spark, sf_dir):
    """Samples themselves as features, scaled anew for windows of 8 and 32; the penalty is frozen at the widest."""
    return _windows(spark, sf_dir, lambda cut: lambda v: v, [8, 32])


@register("ml_refitted_shapelets")
def ml_refitted_shapelets(spark, sf_dir):
    """Shapelets fitted anew on every prefix."""

    def fit(cut):
        shapelets = X.fit_shapelets(cut, "event_id", ["s1", "s2"], 12, length=7)
        return lambda v: X.shapelet_values(v, shapelets)

    return _windows(spark, sf_dir, fit, [16, 32])
