"""Mini-batch Adam training: gradients against differences, a round against plain sequential training, loss and rows on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalytics.operators import mlp
from helpers import rows

SMALL = mlp.Training(hidden=(7, 5), batch=8, max_passes=6, passes=2, patience=99)


def frame(spark, n=150, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 > 0.3).astype(int) + (x[:, 2] > 1)
    data = [(i, *map(float, a), int(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, y int").repartition(5), x, y


def test_gradient_equals_differences():
    rng, widths = np.random.default_rng(2), [3, 6, 4, 3]
    x, y = rng.normal(size=(9, 3)), rng.integers(0, 3, 9)
    w = mlp.first_weights(widths, 5)
    _, g = mlp.loss_and_gradient(x, y, w, widths, 0.3)
    for i in rng.choice(len(w), 40, replace=False):
        step = np.zeros_like(w)
        step[i] = 1e-6
        slope = (mlp.loss_and_gradient(x, y, w + step, widths, 0.3)[0] - mlp.loss_and_gradient(x, y, w - step, widths, 0.3)[0]) / 2e-6
        assert g[i] == pytest.approx(slope, abs=1e-6)


def plain_training(data, t, shares):
    """The same rounds in one process: every share from the same state, then the mean by rows."""
    widths = [3, *t.hidden, 3]
    flat = mlp.first_weights(widths, t.seed)
    state, step, passes_run = np.stack([flat, flat * 0, flat * 0]), 0, 0
    while passes_run < t.max_passes:
        out, most = [], 0
        for s in range(shares):
            w, m, v = (a.copy() for a in state)
            k, n = step, 0
            for p in range(passes_run, passes_run + t.passes):
                own = sorted((turn[p], order, x, y) for share, order, turn, x, y in data if share == s)
                for i in range(0, len(own), t.batch):
                    x, y = np.array([r[2] for r in own[i:i + t.batch]]), np.array([r[3] for r in own[i:i + t.batch]])
                    _, g = mlp.loss_and_gradient(x, y, w, widths, t.l2)
                    k, n = k + 1, n + len(x)
                    m, v = t.beta1 * m + (1 - t.beta1) * g, t.beta2 * v + (1 - t.beta2) * g * g
                    w = w - t.rate * (m / (1 - t.beta1 ** k)) / (np.sqrt(v / (1 - t.beta2 ** k)) + t.epsilon / np.sqrt(1 - t.beta2 ** k))
            out.append((n, np.stack([w, m, v])))
            most = max(most, k - step)
        state = sum(n * a for n, a in out) / sum(n for n, _ in out)
        step, passes_run = step + most, passes_run + t.passes
    return state[0]


@pytest.mark.parametrize("share_rows, shares", [(1000, 1), (60, 3)])
def test_rounds_equal_plain_training(spark, share_rows, shares):
    t = mlp.Training(**{**SMALL.__dict__, "share_rows": share_rows})
    df, x, y = frame(spark)
    got = mlp.train_network(df, ["a", "b", "c"], "y", "id", 3, t)
    keyed = df.select("id", F.xxhash64("id", F.lit(t.seed)).alias("order"))
    keyed = keyed.select("id", "order", F.pmod(F.xxhash64("order"), F.lit(shares)).alias("share"), F.array(*[F.xxhash64("order", F.lit(p)) for p in range(6)]).alias("turn"))
    data = [(r["share"], r["order"], r["turn"], x[r["id"]], y[r["id"]]) for r in rows(keyed)]
    assert np.allclose(got.flat(), plain_training(data, t, shares), atol=1e-9)
    assert got.passes_run == 6 and got.losses[-1] < got.losses[0]


def test_training_learns_stops_and_predicts(spark):
    df, x, y = frame(spark, 400)
    net = mlp.train_network(df, ["a", "b", "c"], "y", "id", 3, mlp.Training(hidden=(32, 16), rate=0.01, passes=10, max_passes=200))
    got = {r["id"]: r for r in rows(mlp.predict_network(df, net, ["a", "b", "c"]))}
    assert np.mean([got[i]["predicted"] == y[i] for i in range(400)]) > 0.95
    p = mlp.forward(x, net.layers)[-1]
    assert all(np.allclose(got[i]["probabilities"], p[i]) for i in range(400)) and net.passes_run <= 200
    flat = mlp.train_network(df, ["a", "b", "c"], "y", "id", 3, mlp.Training(hidden=(4,), rate=0.0, passes=5, patience=10, max_passes=100))
    assert flat.passes_run == 15                          # a loss that never falls: the first round, then ten passes without gain


def test_no_rows(spark):
    df, _, _ = frame(spark, 5)
    assert mlp.train_network(df.limit(0), ["a", "b", "c"], "y", "id", 3, SMALL).passes_run == 0


def test_no_row_reaches_the_driver(spark, monkeypatch):
    """Everything collected during training is bytes of networks: a row per square root of the shares."""
    from pyspark.sql.classic.dataframe import DataFrame
    seen, collect = [], DataFrame.collect

    def counted(self):
        out = collect(self)
        seen.append((len(out), self.columns))
        return out

    monkeypatch.setattr(DataFrame, "collect", counted)
    df, _, _ = frame(spark, 300)
    mlp.train_network(df, ["a", "b", "c"], "y", "id", 3, mlp.Training(**{**SMALL.__dict__, "share_rows": 30}))
    assert seen and all(n <= 3 and set(c) <= {"rows", "steps", "loss", "state"} for n, c in seen)
