"""A feed-forward regressor with log-cosh loss (M5): linear layers with GELU
between them, trained with Adam by data-parallel gradient steps.

A training round is one barrier job: every task keeps its share of the scaled
rows and takes ``local`` gradient steps on it, then all tasks exchange what they
have (``allGather``, in the order of the tasks) and go on from the same state:
with ``local=1`` the sum of all gradients makes one step, so the result does not
depend on how rows are spread, but for the order of additions; with more, weights
and moments are averaged by rows, which costs a tenth of the exchanges. The round
hands its weights back; dev Spearman decides after each round whether to go on,
and the best weights stay. A lost executor costs the round at most: it starts
again from the weights of the last one.

Rows are scaled by a fitted ``StandardScaler`` and written once, in shares of
which each fits a task's memory (the number of shares is the number of slots).
"""

from __future__ import annotations

import base64
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml.feature import StandardScaler, StandardScalerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnscore.operators.agreement import correlations
from turnscore.operators.identity import written

Params = list[tuple[np.ndarray, np.ndarray]]
_C = np.sqrt(2 / np.pi)


def init_params(n_inputs: int, hidden: Sequence[int], seed: int = 0) -> Params:
    r = np.random.RandomState(seed)
    sizes = [n_inputs, *hidden, 1]
    return [(r.randn(a, b) * np.sqrt((2.0 if i + 2 < len(sizes) else 1.0) / a), np.zeros(b)) for i, (a, b) in enumerate(zip(sizes, sizes[1:]))]


def _gelu(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """GELU (its tanh form) and its derivative."""
    t = np.tanh(_C * (z + 0.044715 * z**3))
    return 0.5 * z * (1 + t), 0.5 * (1 + t) + 0.5 * z * (1 - t * t) * _C * (1 + 3 * 0.044715 * z * z)


def forward(params: Params, x: np.ndarray) -> np.ndarray:
    for w, b in params[:-1]:
        x = _gelu(x @ w + b)[0]
    return (x @ params[-1][0] + params[-1][1])[:, 0]


def loss_and_gradient(params: Params, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of log-cosh errors of some rows and its gradient, flat."""
    inputs, slopes = [x], []
    for w, b in params[:-1]:
        a, s = _gelu(inputs[-1] @ w + b)
        inputs.append(a), slopes.append(s)
    d = (inputs[-1] @ params[-1][0] + params[-1][1])[:, 0] - y
    loss = float((np.abs(d) + np.log1p(np.exp(-2 * np.abs(d))) - np.log(2.0)).sum())
    back, out = np.tanh(d)[:, None], []
    for i in range(len(params) - 1, -1, -1):
        out.append((inputs[i].T @ back, back.sum(axis=0)))
        if i:
            back = (back @ params[i][0].T) * slopes[i - 1]
    return loss, flat(out[::-1])


def flat(params: Params) -> np.ndarray:
    return np.concatenate([v.ravel() for layer in params for v in layer])


def shaped(values: np.ndarray, like: Params) -> Params:
    out, at = [], 0
    for w, b in like:
        out.append((values[at : at + w.size].reshape(w.shape), values[at + w.size : at + w.size + b.size]))
        at += w.size + b.size
    return out


@dataclass
class State:
    """Weights and Adam's moments after ``step`` steps."""

    weights: np.ndarray
    m: np.ndarray
    v: np.ndarray
    step: int = 0

    def update(self, gradient: np.ndarray, rate: float, decay: float) -> None:
        gradient = gradient + decay * self.weights
        self.step += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.98 * self.v + 0.02 * gradient**2
        self.weights = self.weights - rate * (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.v / (1 - 0.98**self.step)) + 1e-8)


def _round(shared, like: Params, steps: int, batch: int | None, rate: float, decay: float, local: int):
    def run(batches):
        task = BarrierTaskContext.get()

        def together(values: np.ndarray) -> np.ndarray:
            """The sum of all tasks' values."""
            parts = task.allGather(base64.b64encode(values.tobytes()).decode())
            return np.sum([np.frombuffer(base64.b64decode(p), np.float64) for p in parts], axis=0)

        tables = [b for b in batches if b.num_rows]
        n_inputs = like[0][0].shape[0]
        x = np.concatenate([b.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_inputs) for b in tables]) if tables else np.zeros((0, n_inputs))
        y = np.concatenate([b.column("_label").to_numpy() for b in tables]) if tables else np.zeros(0)
        state = State(*shared.value)
        rows, losses = float(len(y)), []

        def gradient() -> tuple[float, np.ndarray, float]:
            # a step's batch: the next stretch of the task's rows, whose order is a hash of them
            own = slice(None) if batch is None or len(y) <= batch else np.arange(state.step * batch, (state.step + 1) * batch) % len(y)
            loss, g = loss_and_gradient(shaped(state.weights, like), x[own], y[own])
            return loss, g, float(len(y[own]))

        while len(losses) < steps:
            if local == 1:
                loss, g, n = gradient()
                total = together(np.concatenate([[loss, n], g]))
                losses.append(total[0] / max(total[1], 1.0))
                state.update(total[2:] / max(total[1], 1.0), rate, decay)
                continue
            seen = []
            for _ in range(min(local, steps - len(losses))):
                loss, g, n = gradient()
                seen.append(loss / max(n, 1.0))
                state.update(g / max(n, 1.0), rate, decay)
            k = len(seen)
            total = together(np.concatenate([[rows], rows * np.array(seen), rows * state.weights, rows * state.m, rows * state.v]))
            losses += (total[1 : k + 1] / total[0]).tolist()
            state.weights, state.m, state.v = np.split(total[k + 1 :] / total[0], 3)
        if task.partitionId() == 0:
            yield pa.record_batch([pa.array([v.tobytes()]) for v in (state.weights, state.m, state.v)] + [pa.array([state.step]), pa.array([losses], pa.list_(pa.float64()))],
                                  names=["weights", "m", "v", "step", "losses"])

    return run


@dataclass
class Network:
    """A fitted network; like ``regression.Candidate``, with the loss of every
    training step and the dev Spearman after every round."""

    scaler: StandardScalerModel
    params: Params
    losses: list[float] = field(default_factory=list)
    dev: list[float | None] = field(default_factory=list)
    name: str = "network"
    reg_param: float | None = None
    converged: bool = True

    def transform(self, df: DataFrame, vec: str = "features", out: str = "prediction") -> DataFrame:
        from turnscore.operators.regression import features

        return _predicted(self.scaler.transform(features(df, vec)), self.params, out).drop("_vec", "_scaled")


def _predicted(scaled: DataFrame, params: Params, out: str) -> DataFrame:
    shared = scaled.sparkSession.sparkContext.broadcast(params)

    @F.pandas_udf("double")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(forward(shared.value, np.stack(x.to_numpy())) if len(x) else np.zeros(0))

    return scaled.withColumn(out, apply(vector_to_array("_scaled")))


def fit_network(
    train: DataFrame, dev: DataFrame, hidden: Sequence[int] = (64, 64), label: str = "label", vec: str = "features", rounds: int = 20, steps: int = 50,
    batch: int | None = None, rate: float = 0.01, decay: float = 0.0, patience: int = 3, seed: int = 0, shares: int | None = None,
    local: int = 10,
) -> Network:
    """Trains until dev Spearman has not risen for ``patience`` rounds of
    ``steps`` steps. ``batch``: rows per task and step (all by default);
    ``local``: steps between two exchanges. Rows
    without a label don't train; a dev set without a defined Spearman (constant
    labels) is judged by the training loss."""
    from turnscore.operators.regression import features

    spark = train.sparkSession
    has = F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double"))
    data = features(train.where(has), vec)
    if data.isEmpty():
        raise ValueError("no labelled training rows")
    scaler = StandardScaler(inputCol="_vec", outputCol="_scaled", withMean=True, withStd=True).fit(data)
    shares = shares or spark.sparkContext.defaultParallelism
    spread = scaler.transform(data).select(F.col(label).cast("double").alias("_label"), vector_to_array("_scaled").alias("_x"))
    rows, seen = written(spread.withColumn("_h", F.xxhash64("_x", "_label")), mean=F.avg("_label"))
    n_inputs = len(scaler.mean)
    params = init_params(n_inputs, hidden, seed)
    params[-1][1][:] = seen["mean"]
    state = State(flat(params), np.zeros(sum(w.size + b.size for w, b in params)), np.zeros(sum(w.size + b.size for w, b in params)))
    judged = scaler.transform(features(dev.where(has), vec)).select(F.col(label).cast("double").alias("gold"), "_scaled")
    judged, _ = written(judged)
    own = rows.repartition(shares, "_h").sortWithinPartitions("_h").select("_x", "_label")
    best, best_value, since, losses, values = flat(params), -np.inf, 0, [], []
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((state.weights, state.m, state.v, state.step))
        done = own.mapInArrow(_round(shared, params, steps, batch, rate, decay, local), "weights binary, m binary, v binary, step long, losses array<double>", barrier=True).collect()[0]  # one task answers; a barrier job runs whole
        state = State(*[np.frombuffer(done[k], np.float64) for k in ("weights", "m", "v")], done["step"])
        losses += done["losses"]
        scored = _predicted(judged, shaped(state.weights, params), "score").select(F.lit("dev").alias("g"), "gold", "score")
        found = correlations(scored, ["g"]).first()
        values.append(found["spearman"] if found else None)
        value = values[-1] if values[-1] is not None else -losses[-1]
        if value > best_value + 1e-6:
            best, best_value, since = state.weights, value, 0
        else:
            since += 1
            if since >= patience:
                break
    return Network(scaler, shaped(best, params), losses, values, converged=since >= patience)
