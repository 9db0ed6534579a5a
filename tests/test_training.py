import numpy as np
import pytest
from pyspark.sql import functions as F

from picotick.operators import training as T
from tests.test_models import table


def test_windows_are_refitting(spark):
    x, y, df = table(spark)
    got = {(r.n_features, r.candidate_id, r.fold_id): r.rmse for r in T.window_cross_validation(df, "x", "y", "fold", {"n_features": [2, 6], "alpha": [0.5, 5.0]}).collect()}
    fold = np.arange(len(x)) % 4 + 1
    assert len(got) == 16
    for (n, name, k), rmse in got.items():
        z = np.column_stack([np.ones(len(x)), x[:, :n]])
        t = z[fold != k]
        w = np.linalg.solve(t.T @ t + float(name[6:]) * np.diag([0] + [1] * n), t.T @ y[fold != k])
        assert rmse == pytest.approx(np.sqrt(np.mean((y - z @ w)[fold == k] ** 2)), abs=1e-8)
    with pytest.raises(ValueError):
        T.window_cross_validation(df, "x", "y", "fold", {"n_features": [7], "alpha": [0.5]})
    with pytest.raises(ValueError):
        T.grid({"alpha": [1.0, 1.0]})


def test_iterative_ridge_is_the_dense_solution(spark):
    x, y, df = table(spark)
    df = df.withColumn("x", F.transform("x", lambda v, i: v * F.pow(10.0, i - 3) + 100)).unionByName(df.limit(1).withColumn("y", F.lit(None).cast("double")))
    z = np.column_stack([np.ones(len(x)), x * 10.0 ** (np.arange(6) - 3) + 100])
    want = np.linalg.solve(z.T @ z + 2 * np.diag([0] + [1] * 6), z.T @ y)
    assert np.allclose(T.fit_ridge_iteratively(df, "x", "y", 2.0), want, rtol=1e-5, atol=1e-7)
    with pytest.raises(ValueError):
        T.fit_ridge_iteratively(df, "x", "y", 2.0, most=1)
    with pytest.raises(ValueError):
        T.fit_ridge_iteratively(df.limit(0), "x", "y", 2.0)


def test_saved_model(spark, tmp_path):
    path = str(tmp_path / "model")
    T.save_model(spark, path, {"weights": np.array([1.5, -2.0]), "mask": np.array([1, 0, 1])})
    got = T.load_model(spark, path, ("weights", "mask"))
    assert got["weights"].tolist() == [1.5, -2.0] and got["mask"].tolist() == [1, 0, 1]
    with pytest.raises(ValueError, match="has no scale"):
        T.load_model(spark, path, ("scale",))
    cut = str(tmp_path / "cut")
    spark.read.parquet(path).where("part = 'mask' or i = 0").write.parquet(cut)
    with pytest.raises(ValueError, match="not whole"):
        T.load_model(spark, cut, ("weights",))


def test_scaled_blocks(spark):
    rows = np.array([[4.0, 0, 9], [0, 0, 1], [1, 0, -5]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, x array<double>")
    root = np.sqrt(np.maximum(rows, 0))
    want = (root - root.mean(axis=0)) * (root != 0) / (root.std(axis=0, ddof=1) + (root == 0).mean(axis=0) ** 4 + 1e-8)
    assert np.allclose([r.x for r in T.sparse_scaled(df, df, "x").orderBy("id").collect()], want)
    with pytest.raises(ValueError):
        T.sparse_scaled(df.limit(1), df, "x")
    sd = np.where(rows.std(axis=0, ddof=1) > 0, rows.std(axis=0, ddof=1), 1)
    assert np.allclose([r.b for r in T.feature_blocks(df, df, ["x", "x"], "b").orderBy("id").collect()], np.hstack([rows / sd] * 2))


def test_pooled_kernels(spark):
    rows = np.random.default_rng(3).normal(size=(7, 20))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + [(9, None)], "id long, x array<double>").repartition(3)
    biases = T.fit_kernel_biases(df, "id", "x")
    assert len(biases) == 2 * 2 * 84 and (biases == T.fit_kernel_biases(df.repartition(2), "id", "x")).all()
    got = {r.id: np.array(r.features) for r in T.kernel_features(df, "id", "x", biases).collect()}
    assert sorted(got) == list(range(7))
    for which, (view, step, three) in {0: (0, 1, (0, 1, 2)), 84 + 83: (0, 2, (6, 7, 8)), 2 * 84: (1, 1, (0, 1, 2))}.items():
        for i, v in enumerate(rows):
            v = np.diff(v) if view else v
            c = []
            for t in range(len(v)):
                at = [t + (k - 4) * step for k in range(9)]
                c.append(sum((2 if k in three else -1) * v[a] for k, a in enumerate(at) if 0 <= a < len(v)) - biases[which])
            up = [t for t, value in enumerate(c) if value > 0]
            runs = "".join("x" if value > 0 else " " for value in c).split()
            want = [len(up) / len(c), np.mean([c[t] for t in up]) if up else 0, np.mean(up) if up else -1, max(map(len, runs), default=0)]
            assert np.allclose(got[i][4 * which : 4 * which + 4], want)


def test_refitted_windows(spark):
    """Transforms are fitted on the prefix alone, and errors are those of ridge on the other folds."""
    import numpy as np

    from picotick.operators import training as T

    r = np.random.default_rng(9)
    a, b = r.normal(size=(2, 60, 12))
    y = 2 * (a[:, 3] - b[:, 3]) + (a[:, 9] - b[:, 9]) + 0.1 * r.normal(size=60)
    df = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist(), float(y[i]), i % 3) for i in range(60)] + [(90, a[0].tolist(), b[0].tolist(), None, 1), (91, a[0].tolist(), b[0].tolist(), 1.0, None)], "id long, s1 array<double>, s2 array<double>, y double, fold int").repartition(3)
    seen = []

    def fit(cut):
        seen.append(len(cut.first().s1))
        return lambda v: v

    found = T.refitted_windows(df, "id", "s1", "s2", "y", "fold", [4, 12], fit, [0.5, 50.0])
    got = {(q.n_features, q.candidate_id, q.fold_id): q.rmse for q in found.collect()}
    assert seen == [4, 12] and len(got) == 12
    for n in (4, 12):
        both = np.concatenate([a[:, :n], b[:, :n]])
        x = (a[:, :n] - b[:, :n]) / both.std(axis=0)
        for alpha in (0.5, 50.0):
            for fold in range(3):
                out = np.arange(60) % 3 == fold
                w = np.linalg.solve(x[~out].T @ x[~out] + alpha * np.eye(n), x[~out].T @ y[~out])
                assert np.isclose(got[n, f"alpha={alpha:g}", fold], np.sqrt(((y[out] - x[out] @ w) ** 2).mean()), rtol=1e-6)
    best = T.frozen_over_windows(found).where("frozen").collect()
    assert {q.candidate_id for q in best} == {"alpha=0.5"} and len(best) == 2
