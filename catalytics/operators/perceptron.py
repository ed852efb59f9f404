"""The fit of Spark's multilayer perceptron with its gradients computed in Arrow batches (M9).

``MultilayerPerceptronClassifier`` spends its time in one pass over the rows for each evaluation of the
loss.  This module does the same passes: rows are stacked into blocks of ``block_size`` where they lie,
the loss is the mean of the blocks' mean cross-entropies, sigmoid layers end in a softmax, and Breeze's
L-BFGS (ten corrections, strong Wolfe line search, the same stops) follows it from the weights that Spark
draws for the seed.  Blocks are written once, dealt evenly and kept; a task answers with one sum of
gradients, which tasks add up before the driver does when there are many.  No row reaches the driver.
Sums are taken in another order than Spark's, so that late digits differ.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalytics.operators.mlp import unflat
from catalytics.session import scratch_path

# Those of Spark's perceptron and of Breeze's minimizer and line search.
TOLERANCE = 1e-6
CORRECTIONS = 10
LOSS_MEMORY = 20
LINE_STEPS = 10
DECREASE, CURVATURE = 1e-4, 0.9
ROWS = 1024                    # rows multiplied at a time, so that a layer's values stay in a core's cache
LEAST = 16                     # blocks of a task, if that leaves fewer tasks than cores
FEW = 64                       # gradients that the driver adds up itself

Loss = Callable[[np.ndarray], tuple[float, np.ndarray]]


def loss_and_gradient(x: np.ndarray, labels: np.ndarray, share: np.ndarray, flat: np.ndarray, widths: list[int]) -> tuple[float, np.ndarray]:
    """Cross-entropy of the rows, each times its share, and its gradient."""
    layers, values = unflat(flat, widths), [x]
    for k, w in enumerate(layers):
        z = values[-1] @ w[:-1]
        z += w[-1]
        if k < len(layers) - 1:                           # sigmoid, in place
            np.negative(z, out=z)
            with np.errstate(over="ignore"):
                np.exp(z, out=z)
            z += 1
            values.append(np.reciprocal(z, out=z))
        else:
            z -= z.max(axis=1, keepdims=True)
            total = np.log(np.exp(z).sum(axis=1, keepdims=True))
            values.append(np.exp(z - total))
    at = np.arange(len(x)), labels
    # as Spark's loss, which has no value where a probability is too small for a double: the line search then halves its step
    loss = float(((total[:, 0] - z[at]) * share).sum()) if values[-1].all() else math.nan
    delta = values[-1]
    delta[at] -= 1
    delta *= share[:, None]
    grads = []
    for k in range(len(layers) - 1, -1, -1):
        grads.append(np.concatenate([values[k].T @ delta, delta.sum(axis=0, keepdims=True)]).ravel())
        if k:
            delta = delta @ layers[k][:-1].T
            slope = np.subtract(1, values[k])
            slope *= values[k]
            delta *= slope
    return loss, np.concatenate(grads[::-1])


def _stacked(features: int, size: int):
    """Blocks of ``size`` rows as they come; the last one of a task may be short."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = np.zeros((0, features)), np.zeros(0)
        for part in parts:
            if len(part):
                x = np.concatenate([x, np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(features)], 1)])
                y = np.concatenate([y, part.column(features).to_numpy(zero_copy_only=False)])
            if not np.isfinite(x).all():
                raise ValueError("a feature is null or not a finite number")      # as Spark's assembler, which ends the fit
            whole = len(x) // size * size
            if whole:
                yield _blocks(x[:whole], y[:whole], size)
                x, y = x[whole:], y[whole:]
        if len(x):
            yield _blocks(x, y, size)
    return run


def _blocks(x: np.ndarray, y: np.ndarray, size: int) -> pa.RecordBatch:
    cuts = range(0, len(x), size)
    return pa.RecordBatch.from_arrays([pa.array([x[i:i + size].tobytes() for i in cuts], pa.binary()),
                                       pa.array([y[i:i + size].astype(np.int64).tobytes() for i in cuts], pa.binary())], ["x", "y"])


def _gradients(weights, widths: list[int]):
    """One row for each task: its blocks, the sum of their losses and of their gradients."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, blocks, loss, gradient = np.frombuffer(weights.value), 0, 0.0, None
        for part in parts:
            xs, ys = part.column("x").to_pylist(), part.column("y").to_pylist()
            step = max(1, ROWS * 8 // max(map(len, ys), default=8))
            for i in range(0, len(xs), step):
                labels = np.frombuffer(b"".join(ys[i:i + step]), np.int64)
                sizes = np.array([len(y) // 8 for y in ys[i:i + step]])
                some, g = loss_and_gradient(np.frombuffer(b"".join(xs[i:i + step])).reshape(len(labels), -1), labels, np.repeat(1 / sizes, sizes), flat, widths)
                blocks, loss, gradient = blocks + len(sizes), loss + some, g if gradient is None else gradient + g
        if blocks:
            yield _answer(blocks, loss, gradient)
    return run


def _answer(blocks: int, loss: float, gradient: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([blocks], pa.int64()), pa.array([loss], pa.float64()), pa.array([gradient.tobytes()], pa.binary())],
                                      ["blocks", "loss", "gradient"])


def _added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks, loss, gradient = 0, 0.0, None
    for part in parts:
        for n, some, g in zip(*(part.column(c).to_pylist() for c in ("blocks", "loss", "gradient"))):
            blocks, loss, gradient = blocks + n, loss + some, np.frombuffer(g) if gradient is None else gradient + np.frombuffer(g)
    if blocks:
        yield _answer(blocks, loss, gradient)


def fit_weights(rows: DataFrame, features: list[str], label: str, widths: list[int], first: np.ndarray, max_iter: int, block_size: int) -> tuple[np.ndarray, list[float]]:
    """Weights in Spark's layout, and the loss of every iteration, the first weights' one included."""
    spark, schema = rows.sparkSession, "blocks long, loss double, gradient binary"
    path = scratch_path(spark, "training-blocks")
    rows.select(*[F.col(c).cast("double") for c in features], F.col(label).cast("double")).mapInArrow(
        _stacked(len(features), block_size), "x binary, y binary").write.parquet(path)
    # blocks are of one size, so that a round of dealing gives tasks of about one length
    blocks = spark.read.schema("x binary, y binary").parquet(path)
    tasks = max(1, min(spark.sparkContext.defaultParallelism, blocks.count() // LEAST))
    blocks = blocks.repartition(tasks).persist()

    def loss(flat: np.ndarray) -> tuple[float, np.ndarray]:
        sent = spark.sparkContext.broadcast(flat.tobytes())
        sums = blocks.mapInArrow(_gradients(sent, widths), schema)
        if tasks > FEW:
            sums = sums.repartition(math.isqrt(tasks)).mapInArrow(_added, schema)
        got = sums.collect()
        sent.destroy()
        n = sum(r.blocks for r in got)
        if not n:
            raise ValueError("no rows to train on")
        return sum(r.loss for r in got) / n, sum(np.frombuffer(r.gradient) for r in got) / n

    try:
        return lbfgs(loss, first, max_iter)
    finally:
        blocks.unpersist()


# ---------------------------------------------------------------- Breeze's L-BFGS
class SearchFailed(Exception):
    pass


def _direction(gradient: np.ndarray, steps: list[np.ndarray], turns: list[np.ndarray]) -> np.ndarray:
    """Minus the approximate inverse Hessian times the gradient; the newest correction comes first."""
    scale = 1.0
    if steps:
        sy = steps[0] @ turns[0]
        if not sy >= 0:
            raise SearchFailed("history")
        scale = sy / (turns[0] @ turns[0]) if sy else math.nan
    out, parts = gradient.copy(), []
    for s, y in zip(steps, turns):
        rho = s @ y
        a = (s @ out) / rho if rho else math.nan
        if math.isnan(a):
            raise SearchFailed("history")
        out -= a * y
        parts.append((a, rho))
    out *= scale
    for (a, rho), s, y in zip(parts[::-1], steps[::-1], turns[::-1]):
        out += (a - (y @ out) / rho) * s
    return -out


def _between(a: tuple, b: tuple) -> float:
    """Least point of the cubic through two places (t, slope, value), away from both ends."""
    (t0, d0, f0), (t1, d1, f1) = (a, b) if a[0] <= b[0] else (b, a)
    p = d0 + d1 - 3 * (f0 - f1) / (t0 - t1)
    square = p * p - d0 * d1
    if not square >= 0:
        raise SearchFailed("zoom")
    q = math.sqrt(square)
    below = d1 - d0 + 2 * q
    t = t1 - (t1 - t0) * (d1 + q - p) / below if below else math.nan
    if math.isnan(t):
        raise SearchFailed("zoom")
    return min(max(t, t0 + 0.1 * (t1 - t0)), t0 + 0.9 * (t1 - t0))


def _step(at: Callable[[float], tuple], start: tuple, t: float) -> float:
    """A step that meets the strong Wolfe conditions; ``at`` gives (t, slope, value)."""
    _, slope, value = start
    if slope > 0:
        raise SearchFailed("no descent")

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(LINE_STEPS):
            c = at(_between(low, high))
            if c[2] > value + DECREASE * c[0] * slope or c[2] >= low[2]:
                high = c
            else:
                if abs(c[1]) <= CURVATURE * abs(slope):
                    return c[0]
                if c[1] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise SearchFailed("zoom")

    low = start
    for i in range(LINE_STEPS):
        c = at(t)
        if not math.isfinite(c[2]):
            t /= 2
            continue
        if c[2] > value + DECREASE * t * slope or (c[2] >= low[2] and i > 0):
            return zoom(low, c)
        if abs(c[1]) <= CURVATURE * abs(slope):
            return c[0]
        if c[1] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise SearchFailed("line")


def lbfgs(loss: Loss, first: np.ndarray, max_iter: int) -> tuple[np.ndarray, list[float]]:
    """Breeze's iterations: point and losses.  A failed search forgets the history once; a second one in a row ends."""
    x = np.array(first, float)
    value, gradient = loss(x)
    losses, number, failed, begin = [value], 0, False, abs(value)
    steps: list[np.ndarray] = []
    turns: list[np.ndarray] = []
    recent = [math.inf]
    while True:
        flat = len(recent) >= 2 and abs(value - max(recent)) <= TOLERANCE * begin
        if number >= max_iter or flat or np.linalg.norm(gradient) <= max(TOLERANCE * abs(value), 1e-8):
            return x, losses
        seen: dict[float, tuple[float, np.ndarray]] = {}
        try:
            way = _direction(gradient, steps, turns)

            def at(t: float) -> tuple[float, float, float]:
                if t not in seen:
                    seen.clear()                          # the step that is taken is the last one asked for
                    seen[t] = loss(x + way * t)
                f, g = seen[t]
                return t, float(g @ way), f

            t = _step(at, (0.0, float(gradient @ way), value), 1.0 if number else 1 / np.linalg.norm(way))
            if t * np.linalg.norm(gradient) < 1e-10:
                raise SearchFailed("step")
        except SearchFailed:
            if failed:
                return x, [*losses, value]
            failed, steps, turns = True, [], []
            losses.append(value)                          # Breeze counts the turn in which it starts anew
            continue
        at(t)
        new_value, new_gradient = seen[t]
        new = x + way * t
        steps, turns = [new - x, *steps][:CORRECTIONS], [new_gradient - gradient, *turns][:CORRECTIONS]
        x, value, gradient, number, failed = new, new_value, new_gradient, number + 1, False
        recent = [*recent, value][-LOSS_MEMORY:]
        losses.append(value)
