"""Gradients by differences, known filters learnt, swaps, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from picotick.operators import neural as N

CHAINS = [
    (N.dense(5), N.TANH, N.dense(1)), (N.conv(3, 4, 2), N.RELU, N.conv(2, 2), N.TANH, N.dense(1)),
    (N.local(3, 4, 2), N.TANH, N.local(2, 2), N.TANH, N.dense(1), N.bounded(2.5)), (N.dense(4), N.RELU, N.dense(1), N.bounded(0.5)),
]


@pytest.mark.parametrize("layers", CHAINS)
@pytest.mark.parametrize("shape", [(1, 12), (2, 12)])
def test_gradients(layers, shape):
    rng = np.random.default_rng(3)
    s = N.Scorer(layers, shape)
    w, x, g = s.start(1) + 0.1 * rng.normal(size=s.count), rng.normal(size=(5, *shape)), rng.normal(size=5)
    score, kept = s.forward(w, x)
    by_w, by_x = s.backward(w, kept, g)
    f = lambda w, x: float(g @ s.forward(w, x)[0])
    h = 1e-6
    for i in range(s.count):
        e = np.zeros(s.count)
        e[i] = h
        assert (f(w + e, x) - f(w - e, x)) / (2 * h) == pytest.approx(by_w[i], rel=1e-4, abs=1e-6)
    for at in [(0, 0, 0), (2, shape[0] - 1, 5), (4, 0, 11)]:
        e = np.zeros(x.shape)
        e[at] = h
        assert (f(w, x + e) - f(w, x - e)) / (2 * h) == pytest.approx(by_x[at], rel=1e-4, abs=1e-6)
    assert score.shape == (5,)


def table(spark, n=240, samples=8):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, n, samples))
    y = 3 * (a[:, 2] - b[:, 2]) + 0.01 * rng.normal(size=n)
    return spark.createDataFrame([(i, a[i].tolist(), b[i].tolist(), float(y[i])) for i in range(n)], "id int, s1 array<double>, s2 array<double>, y double").repartition(3)


@pytest.mark.parametrize(("shape", "layers"), [("antisymmetric", (N.dense(1),)), ("fused", (N.conv(2, 8), N.dense(1))), ("antisymmetric", (N.local(2, 3), N.dense(1))), ("direct", (N.dense(6), N.TANH, N.dense(1)))])
def test_a_difference_is_learnt(spark, shape, layers):
    df = table(spark)
    model = N.fit(df, "id", "s1", "s2", "y", layers, shape, epochs=10, batches=2, rate=0.1)
    found = df.join(N.predict(df, model, "id", "s1", "s2"), "id").select(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2)).alias("rmse"), F.stddev("y").alias("std")).first()
    assert found.rmse < 0.5 * found.std and model.history[-1][1] < model.history[0][1]
    weights = {r["sample"]: r.importance for r in N.importance(df, model, "s1", "s2").collect()}
    assert max(weights, key=weights.get) == 2
    swapped = N.predict(df, model, "id", "s2", "s1").withColumnRenamed("prediction", "other")
    both = N.predict(df, model, "id", "s1", "s2").join(swapped, "id").select(F.max(F.abs(F.col("prediction") + F.col("other"))).alias("m")).first().m
    assert (both < 1e-12) == (shape == "antisymmetric")


def test_sums_do_not_depend_on_partitions(spark):
    df = table(spark, 60).select(F.col("s1").alias("a"), F.col("s2").alias("b"), "y")
    model = N.Model((N.dense(3), N.TANH, N.dense(1)), "antisymmetric", 8, np.zeros(0), 0.0, 1.0)
    w = model.scorer().start(2)
    one, many = (N.loss_sums(model, w, df.repartition(k)) for k in (1, 7))
    assert one[0] == many[0] == 60 and one[1] == pytest.approx(many[1]) and np.allclose(one[2], many[2])


def test_odd_rows(spark):
    df = table(spark, 40)
    more = spark.createDataFrame([(100, None, [1.0] * 8, 1.0), (101, [], [], 1.0), (102, [0.0] * 8, [0.0] * 8, None)], df.schema)
    model = N.fit(df.unionByName(more), "id", "s1", "s2", "y", (N.dense(1),), epochs=1, batches=1)
    got = {r.id: r.prediction for r in N.predict(df.unionByName(more), model, "id", "s1", "s2").collect()}
    assert got[100] is None and got[101] is None and got[102] == 0.0 and len(got) == 43
    with pytest.raises(Exception, match="unequal length"):
        N.predict(spark.createDataFrame([(1, [1.0] * 8, [1.0] * 7)], "id int, s1 array<double>, s2 array<double>"), model, "id", "s1", "s2").collect()
    with pytest.raises(ValueError, match="no row"):
        N.fit(df.limit(0), "id", "s1", "s2", "y", (N.dense(1),))
    with pytest.raises(ValueError, match="one number"):
        N.Scorer((N.dense(2),), (1, 8))
    with pytest.raises(ValueError, match="taps"):
        N.Scorer((N.conv(2, 9), N.dense(1)), (1, 8))
