"""Data-parallel training of the demand classifier with Adam, ReLU and L2 (M9).

``ml.train_demand_model`` fits Spark's own perceptron (sigmoid, L-BFGS).  This module trains the
network as the reference describes it: dense layers with ReLU and a softmax output, mini-batches,
Adam, an L2 penalty, and a stop when the loss has not fallen by ``tol`` for ``patience`` passes.

Rows are dealt once into ``shares`` by a hash of their key and written, sorted by a second hash.  A
round is one Spark job: each share makes ``passes`` passes of mini-batch Adam over its own rows,
streaming them batch by batch, and gives back its weights, moments and loss; they are averaged by
rows, in tasks first, and sent out again (local SGD with averaging).  One share is plain sequential
mini-batch training.  What reaches the driver is the square root of the number of shares times the
size of the network; no row does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalytics.session import scratch_path


@dataclass(frozen=True)
class Training:
    """Fixed values of the reference: layers, batch, learning rate, L2 and passes; Adam's are the usual ones."""
    hidden: tuple[int, ...] = (128, 64, 32)
    batch: int = 64
    rate: float = 0.001
    l2: float = 0.001
    max_passes: int = 300
    tol: float = 1e-4
    patience: int = 10
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8
    seed: int = 42
    share_rows: int = 200_000      # rows of a share: their number follows the rows
    passes: int = 5                # over a share in one round


@dataclass
class Network:
    """Weights of every layer, bias last in each matrix, and how the loss went."""
    layers: list[np.ndarray]
    losses: list[float] = field(default_factory=list)
    passes_run: int = 0

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.layers])


def shapes(widths: list[int]) -> list[tuple[int, int]]:
    return [(a + 1, b) for a, b in zip(widths, widths[1:])]


def unflat(flat: np.ndarray, widths: list[int]) -> list[np.ndarray]:
    out, at = [], 0
    for a, b in shapes(widths):
        out.append(flat[at:at + a * b].reshape(a, b))
        at += a * b
    return out


def first_weights(widths: list[int], seed: int) -> np.ndarray:
    """Glorot-uniform weights and biases."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-1, 1, (a, b)).ravel() * np.sqrt(6 / (a - 1 + b)) for a, b in shapes(widths)])


def forward(x: np.ndarray, layers: list[np.ndarray]) -> list[np.ndarray]:
    """Values of every layer; the last one holds class probabilities."""
    values = [x]
    for k, w in enumerate(layers):
        z = values[-1] @ w[:-1] + w[-1]
        if k < len(layers) - 1:
            values.append(np.maximum(z, 0))
        else:
            e = np.exp(z - z.max(axis=1, keepdims=True))
            values.append(e / e.sum(axis=1, keepdims=True))
    return values


def loss_and_gradient(x: np.ndarray, labels: np.ndarray, flat: np.ndarray, widths: list[int], l2: float) -> tuple[float, np.ndarray]:
    """Mean cross-entropy of a batch with l2 / 2 * |weights|^2 / rows (biases are free), and its gradient."""
    layers, n = unflat(flat, widths), len(x)
    values = forward(x, layers)
    p = values[-1][np.arange(n), labels]
    loss = float(-np.log(np.maximum(p, 1e-300)).mean() + 0.5 * l2 * sum((w[:-1] ** 2).sum() for w in layers) / n)
    delta = values[-1].copy()
    delta[np.arange(n), labels] -= 1
    delta /= n
    grads = []
    for k in range(len(layers) - 1, -1, -1):
        g = np.concatenate([values[k].T @ delta + l2 * layers[k][:-1] / n, delta.sum(axis=0, keepdims=True)])
        grads.append(g.ravel())
        if k:
            delta = (delta @ layers[k][:-1].T) * (values[k] > 0)
    return loss, np.concatenate(grads[::-1])


class Adam:
    def __init__(self, state: np.ndarray, step: int, t: Training):
        self.w, self.m, self.v = (x.copy() for x in state)
        self.step, self.t = step, t

    def update(self, g: np.ndarray) -> None:
        t = self.t
        self.step += 1
        self.m = t.beta1 * self.m + (1 - t.beta1) * g
        self.v = t.beta2 * self.v + (1 - t.beta2) * g * g
        rate = t.rate * np.sqrt(1 - t.beta2 ** self.step) / (1 - t.beta1 ** self.step)
        self.w = self.w - rate * self.m / (np.sqrt(self.v) + t.epsilon)


def _batches(parts: Iterator[pa.RecordBatch], n_features: int, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Mini-batches (share, features, labels) of rows that come sorted by share and pass; the last one of a pass may be short."""
    key, x, y = None, np.zeros((0, n_features)), np.zeros(0, np.int64)
    for part in parts:
        rows = np.stack([part.column(f"f{i}").to_numpy(zero_copy_only=False) for i in range(n_features)], 1) if len(part) else np.zeros((0, n_features))
        labels = part.column("label").to_numpy()
        keys = part.column("share").to_numpy().astype(np.int64) << 32 | part.column("pass").to_numpy()
        edges = np.append(np.flatnonzero(np.diff(keys, prepend=-1)), len(keys))
        for i, j in zip(edges[:-1], edges[1:]):
            if key is not None and keys[i] != key and len(x):
                yield key >> 32, x, y
                x, y = x[:0], y[:0]
            key = int(keys[i])
            x, y = np.concatenate([x, rows[i:j]]), np.concatenate([y, labels[i:j]])
            while len(x) >= size:
                yield key >> 32, x[:size], y[:size]
                x, y = x[size:], y[size:]
    if key is not None and len(x):
        yield key >> 32, x, y


def _round(state, step: int, widths: list[int], t: Training):
    """Train every share of a task from the same state; one row per share."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, adam, rows, total = None, None, 0, 0.0

        def done():
            out = np.concatenate([adam.w, adam.m, adam.v]).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([share], pa.int64()), pa.array([rows], pa.int64()), pa.array([adam.step - step], pa.int64()),
                                               pa.array([total], pa.float64()), pa.array([out], pa.binary())], ["share", "rows", "steps", "loss", "state"])

        for s, x, y in _batches(parts, widths[0], t.batch):
            if s != share:
                if share is not None:
                    yield done()
                share, adam, rows, total = s, Adam(np.frombuffer(state.value).reshape(3, -1), step, t), 0, 0.0
            loss, g = loss_and_gradient(x, y, adam.w, widths, t.l2)
            adam.update(g)
            rows, total = rows + len(x), total + loss * len(x)
        if share is not None:
            yield done()
    return run


def _summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the shares of a task: rows, loss, states weighted by rows; the most steps."""
    rows, steps, loss, state = 0, 0, 0.0, None
    for part in parts:
        for n, s, x, held in zip(*(part.column(c).to_pylist() for c in ("rows", "steps", "loss", "state"))):
            rows, steps, loss = rows + n, max(steps, s), loss + x
            state = np.frombuffer(held) * n if state is None else state + np.frombuffer(held) * n
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([steps], pa.int64()), pa.array([loss], pa.float64()),
                                          pa.array([state.tobytes()], pa.binary())], ["rows", "steps", "loss", "state"])


def dealt_rows(rows: DataFrame, features: list[str], label: str, key: str, t: Training) -> tuple[DataFrame, int]:
    """share, order, label, f0.. of every row, written once, and the number of shares."""
    out = rows.select(F.xxhash64(key, F.lit(t.seed)).alias("order"), F.col(label).cast("long").alias("label"),
                      *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    path, schema = scratch_path(rows.sparkSession, "training-rows"), out.schema
    out.write.parquet(path)
    dealt = rows.sparkSession.read.schema(schema).parquet(path)
    shares = max(1, -(-dealt.count() // t.share_rows))
    return dealt.withColumn("share", F.pmod(F.xxhash64("order"), F.lit(shares)).cast("int")), shares


def train_network(rows: DataFrame, features: list[str], label: str, key: str, classes: int, t: Training = Training()) -> Network:
    """Fit the network to rows with standardized features and labels 0 .. classes - 1.

    The order of a share's rows changes from pass to pass by a hash of (order, pass).  The result
    depends on the rows, the settings and the seed only, not on how the rows lie in files.
    """
    widths = [len(features), *t.hidden, classes]
    dealt, shares = dealt_rows(rows, features, label, key, t)
    dealt = dealt.persist()
    context = rows.sparkSession.sparkContext
    flat = first_weights(widths, t.seed)
    state, step, net, best, waited = np.stack([flat, np.zeros_like(flat), np.zeros_like(flat)]), 0, Network([]), np.inf, 0
    try:
        while net.passes_run < t.max_passes and waited < t.patience:
            passes = min(t.passes, t.max_passes - net.passes_run)
            numbers = F.sequence(F.lit(net.passes_run), F.lit(net.passes_run + passes - 1))
            turn = dealt.withColumn("pass", F.explode(numbers)).withColumn("turn", F.xxhash64("order", "pass"))
            sent = context.broadcast(state.tobytes())
            trained = turn.repartition("share").sortWithinPartitions("share", "pass", "turn", "order").drop("turn", "order").mapInArrow(
                _round(sent, step, widths, t), "share long, rows long, steps long, loss double, state binary")
            some = math.isqrt(shares)
            got = trained.repartition(some, "share").sortWithinPartitions("share").mapInArrow(
                _summed, "rows long, steps long, loss double, state binary").collect()
            sent.unpersist()
            if not got:
                break
            n = sum(r.rows for r in got)
            state = sum(np.frombuffer(r.state).reshape(3, -1) for r in got) / n
            step += max(r.steps for r in got)
            loss = sum(r.loss for r in got) / n
            waited = 0 if loss < best - t.tol else waited + passes
            best = min(best, loss)
            net.losses.append(loss)
            net.passes_run += passes
    finally:
        dealt.unpersist()
    net.layers = unflat(state[0], widths)
    return net


def predict_network(rows: DataFrame, net: Network, features: list[str]) -> DataFrame:
    """The rows with ``probabilities`` (array) and ``predicted`` (the likeliest class, the first on ties); the network is broadcast."""
    layers = rows.sparkSession.sparkContext.broadcast(net.layers)

    @F.pandas_udf("array<double>")
    def probabilities(*columns):
        import pandas as pd
        x = np.stack([c.to_numpy(float) for c in columns], 1)
        return pd.Series(list(forward(x, layers.value)[-1]))

    out = rows.withColumn("probabilities", probabilities(*[F.col(c) for c in features]))
    return out.withColumn("predicted", (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int"))
