"""The bank against direct fits, and attributions event by event."""

import numpy as np
import pytest

from picotick.operators import imputing as I

WINDOWS = [(0, 3), (3, 4), (9, 3)]
N = 12


def table(spark, n=200, seed=1):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, 2)) @ r.normal(size=(2, N)) + 0.05 * r.normal(size=(n, N)) + np.linspace(0, 2, N)
    df = spark.createDataFrame([(i, v[i].tolist(), i % 3 == 0) for i in range(n)] + [(900, None, True), (901, [float("nan")] * N, False), (902, [1.0] * N, None)], "id long, x array<double>, apart boolean")
    return v, df.repartition(4)


def test_winners(spark):
    v, df = table(spark)
    bank = {r.pattern: r for r in I.fit_bank(df, "x", "apart", WINDOWS, (1, 2)).collect()}
    assert sorted(bank) == list(range(1, 8))
    fitted, judged = v[np.arange(200) % 3 != 0], v[np.arange(200) % 3 == 0]
    for pattern, r in bank.items():
        hidden = I.hidden_samples(pattern, WINDOWS, N)
        weights = np.array(r.weights).reshape(hidden.sum(), -1)
        off = judged[:, hidden] - np.array(r.offset) - judged[:, ~hidden] @ weights.T
        assert r.rmse == pytest.approx(np.sqrt((off**2).mean()), rel=1e-6)
        assert r.rmse <= np.sqrt(((judged[:, hidden] - fitted[:, hidden].mean(axis=0)) ** 2).mean()) + 1e-12
        assert r.method == "components=2"
    rough = spark.createDataFrame([(i, [float(i % 7)] * N, i % 2 == 0) for i in range(40)], "id long, x array<double>, apart boolean")
    assert {r.method for r in I.fit_bank(rough, "x", "apart", WINDOWS, (1,)).collect()} <= {"line", "cubic", "components=1"}


def test_all_hidden_is_the_mean(spark):
    v, df = table(spark)
    whole = [(0, 6), (6, 6)]
    bank = I.fit_bank(df, "x", "apart", whole)
    last = bank.where("pattern = 3").first()
    assert last.method == "mean" and last["weights"] == [] and np.allclose(last.offset, v[np.arange(200) % 3 != 0].mean(axis=0))
    filled = {(r.id, r.pattern): r.filled for r in I.reconstruct(df, "id", "x", bank, N).collect()}
    assert len(filled) == 202 * 3 and np.allclose(filled[5, 3], last.offset) and filled[5, 1][6:] == v[5, 6:].tolist()


def test_attribution_and_deletion(spark, tmp_path):
    v, df = table(spark)
    I.fit_bank(df, "x", "apart", WINDOWS).write.parquet(str(tmp_path / "bank"))
    bank = spark.read.parquet(str(tmp_path / "bank"))
    predict = lambda x: np.tanh(x[:, 1]) + x[:, 5] * x[:, 10]
    rows = I.local_attribution(df.where("id < 20"), "id", "x", bank, N, predict).collect()
    assert len(rows) == 20 * 4
    _, imputers = I.load_bank(bank, N)
    value = lambda i, hidden: float(predict(imputers[hidden].fill(v[i : i + 1]) if hidden else v[i : i + 1])[0])
    for i in range(20):
        mine = sorted((r for r in rows if r.id == i), key=lambda r: r.step)
        phi = [(value(i, 7 ^ (1 << w)) - value(i, 7) + value(i, 0) - value(i, 1 << w)) / 2 for w in range(3)]
        order = sorted(range(3), key=lambda w: (-phi[w], w))
        assert (mine[0].window, mine[0].phi) == (None, None) and [r.window for r in mine[1:]] == order
        assert [r.phi for r in mine[1:]] == pytest.approx([phi[w] for w in order])
        gone = [0, *np.cumsum([1 << w for w in order]).tolist()]
        assert [r.prediction for r in mine] == pytest.approx([value(i, g) for g in gone])


def test_bad_windows(spark):
    _, df = table(spark)
    for windows in ([], [(0, 3), (2, 3)], [(10, 5)], [(i, 1) for i in range(11)]):
        with pytest.raises(ValueError):
            I.fit_bank(df, "x", "apart", windows)
    with pytest.raises(ValueError, match="rows to judge"):
        I.fit_bank(df.where("apart"), "x", "apart", WINDOWS)
    with pytest.raises(ValueError, match="empty bank"):
        I.load_bank(spark.createDataFrame([], I.SCHEMA), N)


def test_lines_and_cubics():
    hidden = np.array([True, False, False, True, True, False, False, True])
    x = np.array([0.0, 1.0, 2.0, 0, 0, 5.0, 6.0, 0])
    assert np.allclose(I._line(hidden) @ x[~hidden], [1, 3, 4, 6])
    y = np.array([0.0, 1.0, 8.0, 0, 0, 125.0, 216.0, 0])
    slopes = [8 - 1, 216 - 125]
    t = np.array([1 / 3, 2 / 3])
    want = (2 * t**3 - 3 * t**2 + 1) * 8 + (t**3 - 2 * t**2 + t) * 3 * slopes[0] + (3 * t**2 - 2 * t**3) * 125 + (t**3 - t**2) * 3 * slopes[1]
    assert np.allclose((I._cubic(hidden) @ y[~hidden])[1:3], want)
