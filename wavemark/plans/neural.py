"""Mixture-density recurrent forecasters, trained data-parallel and applied by Spark.

A model is a small dictionary of arrays: an LSTM of one or more layers over the lookback and linear
heads for the mixture's logits, means and raw spreads; the joint model adds a head for the regime,
whose probabilities the forecast heads see too.

An epoch is one barrier stage. All rows are dealt anew in random order over the stage's tasks, which
stream their rows. An epoch has rows / ``batch_size`` steps, each of which needs the weights of the one
before, and an ``allGather`` takes about a second at any size. So small batches are dealt in runs: a
task takes the steps of its run, one after another, and hands the weights on to the next task, with one
exchange for each task. Large batches are dealt evenly over all tasks: in a step each task computes the
gradient of its part, all exchange these, and each takes the same AdamW step. Either way the number of
jobs does not depend on the rows, and neither data nor gradients go through the driver's program. If a
task is lost the stage starts again from the epoch's first weights.
"""

from __future__ import annotations

import base64
import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import numbered

LEAST_STD = 1e-3
#: Rows that are put in order together.
PART_ROWS = 1024
#: Rows of a batch that make a task worth its share of an exchange in each step.
TASK_ROWS = 1 << 14
#: Steps that make a task worth an exchange of its own, where tasks take their steps in turn.
TURN_STEPS = 256
Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class ModelConfig:
    n_channels: int
    horizon: int = 1
    hidden: int = 16
    components: int = 3
    n_regimes: int = 0
    layers: int = 1
    dropout: float = 0.0

    def check(self) -> None:
        if min(self.n_channels, self.horizon, self.hidden, self.components, self.layers) < 1 or self.n_regimes < 0:
            raise ValueError("sizes must be positive")
        if not 0 <= self.dropout < 1:
            raise ValueError("dropout must lie in [0, 1)")


@dataclass(frozen=True)
class TrainingConfig:
    """``batches`` cuts an epoch into so many parts, whatever the number of rows; without it a batch
    has ``batch_size`` rows. ``tasks`` share each batch; by default as many as the cluster runs at
    once, if each has TASK_ROWS rows of it at least, or else as many take whole batches in turn."""

    epochs: int = 5
    batch_size: int = 64
    batches: int | None = None
    tasks: int | None = None
    rate: float = 1e-2
    decay: float = 0.0
    clip: float = 1.0
    supervised: float = 0.0
    smoothness: float = 0.0
    seed: int = 0

    def check(self) -> None:
        if min(self.epochs, self.batch_size, 1 if self.batches is None else self.batches, 1 if self.tasks is None else self.tasks) < 1 or self.rate <= 0 or self.clip <= 0 or min(self.decay, self.supervised, self.smoothness) < 0:
            raise ValueError("epochs, batch_size, batches, tasks, rate and clip must be positive, weights not negative")


@dataclass
class Trained:
    config: ModelConfig
    weights: Weights
    train_loss: list[float] = field(default_factory=list)
    validation_loss: list[float] = field(default_factory=list)


def initial(config: ModelConfig, seed: int) -> Weights:
    config.check()
    rng, d, h = np.random.default_rng(seed), config.n_channels, config.hidden
    seen, out = h + config.n_regimes, config.horizon * config.components
    draw = lambda *shape: rng.uniform(-1, 1, shape) / np.sqrt(h)
    w = {f"{name}{k or ''}": draw(*shape) for k in range(config.layers) for name, shape in (("wx", (h if k else d, 4 * h)), ("wh", (h, 4 * h)), ("b", (4 * h,)))}
    w |= {"logit": draw(seen, out), "logit_b": draw(out), "mean": draw(seen, out * d), "mean_b": draw(out * d), "std": draw(seen, out * d), "std_b": draw(out * d)}
    return w | ({"regime": draw(h, config.n_regimes), "regime_b": draw(config.n_regimes)} if config.n_regimes else {})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _layer(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The hidden states of all steps (N, T, hidden), and what their gradient needs, by steps."""
    (n, steps, _), size = x.shape, wh.shape[0]
    half = np.full(4 * size, 0.5)  # a sigmoid is half a hyperbolic tangent of half its argument, and a half
    half[2 * size : 3 * size] = 1
    rest = 1 - half
    gates, wh = (x.transpose(1, 0, 2) @ wx + b) * half, wh * half
    h, cell, tanh = np.zeros((steps + 1, n, size)), np.zeros((steps + 1, n, size)), np.empty((steps, n, size))
    for t in range(steps):
        own = gates[t]
        own += h[t] @ wh
        np.tanh(own, out=own)
        own *= half
        own += rest
        i, f, g, o = (own[:, k * size : (k + 1) * size] for k in range(4))
        np.multiply(f, cell[t], out=cell[t + 1])
        cell[t + 1] += i * g
        np.tanh(cell[t + 1], out=tanh[t])
        np.multiply(o, tanh[t], out=h[t + 1])
    return h[1:].transpose(1, 0, 2), (h, cell, tanh, gates.reshape(steps, n, 4, size))


def _layer_gradient(x: np.ndarray, kept: tuple, d_out: np.ndarray, wx: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients by the layer's input, ``wx``, ``wh`` and ``b``."""
    h, cell, tanh, gates = kept
    steps, n, _, size = gates.shape
    i, f, g, o = (gates[:, :, k] for k in range(4))
    d = np.stack([g * i * (1 - i), cell[:-1] * f * (1 - f), i * (1 - g**2), tanh * o * (1 - o)], axis=2)
    through, dh, dc = o * (1 - tanh**2), np.zeros((n, size)), np.zeros((n, size))
    for t in range(steps - 1, -1, -1):
        dh += d_out[:, t]
        dc += dh * through[t]
        d[t, :, :3] *= dc[:, None]
        d[t, :, 3] *= dh
        dh = d[t].reshape(n, 4 * size) @ wh.T
        dc *= f[t]
    flat = d.reshape(steps * n, 4 * size)
    d_wx = x.transpose(1, 0, 2).reshape(steps * n, -1).T @ flat
    return (flat @ wx.T).reshape(steps, n, -1).transpose(1, 0, 2), d_wx, h[:-1].reshape(steps * n, size).T @ flat, flat.sum(axis=0)


def forward(c: ModelConfig, w: Weights, x: np.ndarray, *, override: np.ndarray | None = None, every_step: bool = False, rng: np.random.Generator | None = None) -> dict:
    """Windows (N, L, D) to the mixture's logits (N, H, M), means and stds (N, H, M, D), and the
    regime's logits and probabilities (N, K), after the last step; ``every_step``: after each, with
    an axis of steps behind N. ``override`` (of the regime logits' shape) takes their place.
    ``rng``: training, which drops states between layers."""
    inputs, kept, masks, states = [x], [], [], x
    for k in range(c.layers):
        states, own = _layer(states, *(w[f"{name}{k or ''}"] for name in ("wx", "wh", "b")))
        kept.append(own)
        if k < c.layers - 1:
            masks.append((rng.random(states.shape) >= c.dropout) / (1 - c.dropout) if rng is not None and c.dropout else np.ones(1))
            states = states * masks[-1]
            inputs.append(states)
    h = states if every_step else states[:, -1]
    regime = h @ w["regime"] + w["regime_b"] if c.n_regimes else np.zeros((*h.shape[:-1], 0))
    if override is not None:
        if override.shape != regime.shape:
            raise ValueError("the override must have the regime logits' shape")
        regime = override
    probs = _softmax(regime) if c.n_regimes else regime
    seen = np.concatenate([h, probs], axis=-1)
    shape = (*h.shape[:-1], c.horizon, c.components)
    raw = (seen @ w["std"] + w["std_b"]).reshape(*shape, c.n_channels)
    return {
        "inputs": inputs, "kept": kept, "masks": masks, "h": h, "regime_logits": regime, "probs": probs, "seen": seen, "raw": raw, "logits": (seen @ w["logit"] + w["logit_b"]).reshape(shape),
        "means": (seen @ w["mean"] + w["mean_b"]).reshape(*shape, c.n_channels), "stds": np.logaddexp(0, raw) + LEAST_STD,
    }


def regime_smoothness(logits: np.ndarray) -> float:
    """How much the regime's posterior changes from step to step: the divergence of each from the
    one before, summed over steps, a mean over the windows of logits (N, T, K); 0 for one step."""
    if logits.ndim != 3:
        raise ValueError("logits need axes of windows, steps and regimes")
    if logits.shape[1] < 2:
        return 0.0
    log_p = logits - np.logaddexp.reduce(logits, axis=-1, keepdims=True)
    return float((np.exp(log_p[:, 1:]) * (log_p[:, 1:] - log_p[:, :-1])).sum() / len(logits))


def loss_and_gradient(c: ModelConfig, w: Weights, x: np.ndarray, y: np.ndarray, labels: np.ndarray | None = None, supervised: float = 0.0, rng: np.random.Generator | None = None) -> tuple[float, Weights]:
    """The summed loss over the rows, and its gradient: the targets' (N, H, D) negative
    log-likelihood, and ``supervised`` times the regimes' cross-entropy. Smoothness of regimes
    along a window has no part: losses are taken after the last step, where it is 0. ``rng``: for
    dropout."""
    a = forward(c, w, x, rng=rng)
    z = (y[:, :, None] - a["means"]) / a["stds"]
    log_w = a["logits"] - np.logaddexp.reduce(a["logits"], axis=-1, keepdims=True)
    joint = log_w - 0.5 * (z**2 + 2 * np.log(a["stds"]) + np.log(2 * np.pi)).sum(axis=-1)
    row = np.logaddexp.reduce(joint, axis=-1)
    loss, scale = -row.mean(axis=1).sum(), 1 / c.horizon
    share = np.exp(joint - row[..., None])
    n = len(x)
    d_logit = (np.exp(log_w) - share).reshape(n, -1) * scale
    d_mean = (-share[..., None] * z / a["stds"]).reshape(n, -1) * scale
    d_std = (share[..., None] * (1 - z**2) / a["stds"] * _sigmoid(a["raw"])).reshape(n, -1) * scale
    g: Weights = {}
    d_seen = np.zeros_like(a["seen"])
    for name, d in (("logit", d_logit), ("mean", d_mean), ("std", d_std)):
        g[name], g[f"{name}_b"] = a["seen"].T @ d, d.sum(axis=0)
        d_seen += d @ w[name].T
    dh = d_seen[:, : c.hidden]
    if c.n_regimes:
        p, dp = a["probs"], d_seen[:, c.hidden :]
        d_regime = p * (dp - (dp * p).sum(axis=1, keepdims=True))
        if supervised and labels is not None:
            own = p[np.arange(n), labels]
            loss -= supervised * np.log(np.maximum(own, 1e-12)).sum()
            d_regime = d_regime + supervised * (p - np.eye(c.n_regimes)[labels])
        g["regime"], g["regime_b"] = a["h"].T @ d_regime, d_regime.sum(axis=0)
        dh = dh + d_regime @ w["regime"].T
    d_out = np.zeros((n, x.shape[1], c.hidden))
    d_out[:, -1] = dh
    for k in range(c.layers - 1, -1, -1):
        names = [f"{name}{k or ''}" for name in ("wx", "wh", "b")]
        d_out, *own = _layer_gradient(a["inputs"][k], a["kept"][k], d_out, w[names[0]], w[names[1]])
        g |= dict(zip(names, own, strict=True))
        if k:
            d_out = d_out * a["masks"][k - 1]
    return float(loss), g


Frame = pd.DataFrame | pa.RecordBatch


def _cut(frame: Frame, a: int, b: int) -> Frame:
    return frame.iloc[a:b] if isinstance(frame, pd.DataFrame) else frame.slice(a, b - a)


def _column(frame: Frame, c: str) -> np.ndarray:
    return frame[c].to_numpy() if isinstance(frame, pd.DataFrame) else frame[c].to_numpy(zero_copy_only=False)


def _arrays(frame: Frame) -> tuple[np.ndarray, np.ndarray]:
    """Windows (N, L, D) and targets (N, H, D) of a frame with rows."""

    def stack(c: str) -> np.ndarray:
        if isinstance(frame, pd.DataFrame):
            return np.stack([np.stack(v) for v in frame[c]]).astype(float)
        outer, inner = frame[c], frame[c].flatten()
        sizes = [pc.min_max(pc.list_value_length(x)) for x in (outer, inner)]
        if outer.null_count or inner.null_count or any(x["min"] != x["max"] for x in sizes):
            raise ValueError(f"all rows of {c} must have one shape")
        return inner.flatten().to_numpy(zero_copy_only=False).reshape(len(outer), sizes[0]["max"].as_py(), -1).astype(float, copy=False)

    return stack("window"), stack("target")


def _lists(x: np.ndarray) -> pa.Array:
    """An array's first axis as rows, the others as lists in lists."""
    if x.ndim == 1:
        return pa.array(x)
    flat = _lists(x.reshape(-1, *x.shape[2:]))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1])), flat)


def _loss(rows: DataFrame, model: Trained, training: TrainingConfig) -> tuple[float, int]:
    """The summed loss and the number of the rows."""
    shared = rows.sparkSession.sparkContext.broadcast((model.config, model.weights))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = shared.value
        loss, n = 0.0, 0
        for frame in frames:
            for a in range(0, len(frame), 256):
                part = _cut(frame, a, min(a + 256, len(frame)))
                x, y = _arrays(part)
                labels = _column(part, "regime_label") if training.supervised else None
                loss, n = loss + loss_and_gradient(own, w, x, y, labels, training.supervised)[0], n + len(part)
        yield pa.RecordBatch.from_pydict({"loss": [float(loss)], "n": [n]})

    parts = rows.select("window", "target", "regime_label").mapInArrow(run, "loss double, n long").toPandas()  # a row for each task
    return float(parts["loss"].sum()), int(parts["n"].sum())


def mean_loss(rows: DataFrame, model: Trained, training: TrainingConfig = TrainingConfig()) -> float:
    loss, n = _loss(rows, model, training)
    return loss / max(n, 1)


@dataclass
class Adam:
    """The model's weights and the moments of their gradients (by the weights' names in order) after
    ``step`` steps."""

    weights: Weights
    m: np.ndarray
    v: np.ndarray
    step: int = 0

    @classmethod
    def first(cls, weights: Weights) -> Adam:
        total = sum(x.size for x in weights.values())
        return cls(weights, np.zeros(total), np.zeros(total))

    def take(self, g: Weights, n: int, training: TrainingConfig) -> None:
        """A step along the summed gradient of ``n`` rows, clipped by its norm."""
        x, w = (np.concatenate([own[k].ravel() for k in sorted(self.weights)]) for own in (g, self.weights))
        x /= n
        x *= min(1.0, training.clip / max(np.sqrt(x @ x), 1e-12))
        self.step += 1
        self.m, self.v = 0.9 * self.m + 0.1 * x, 0.999 * self.v + 0.001 * x**2
        move = self.m / (1 - 0.9**self.step) / (np.sqrt(self.v / (1 - 0.999**self.step)) + 1e-8)
        self.weights = _split(w * (1 - training.rate * training.decay) - training.rate * move, self.weights)


def _split(flat: np.ndarray, like: Weights) -> Weights:
    """Arrays of the shapes of ``like`` from their numbers, by the names in order."""
    out, at = {}, 0
    for k in sorted(like):
        out[k], at = flat[at : at + like[k].size].reshape(like[k].shape), at + like[k].size
    return out


def _dealt(rows: DataFrame, n: int, tasks: int, training: TrainingConfig, epoch: int, key: str, run: int = 1) -> DataFrame:
    """The rows in an order of their own for each epoch: ``_place``, by which runs of ``run`` rows are
    dealt over ``tasks`` partitions one after another, in order."""
    order = F.xxhash64(key, F.lit(training.seed), F.lit(epoch))
    drawn = rows.withColumn("_order", order).withColumn("_bin", F.pmod("_order", F.lit(-(-n // PART_ROWS))))
    placed = numbered(drawn, ["_bin"], ["_order", key], "_place")
    own = F.pmod(F.floor(F.col("_place") / run), F.lit(tasks)).cast("int")
    return placed.select("window", "target", "regime_label", "_place").repartitionById(tasks, own).sortWithinPartitions("_place")


Part = tuple[np.ndarray, np.ndarray, np.ndarray]


def batches_of(frames: Iterable[Frame], size: int, count: int, first: int = 0) -> Iterator[list[Part]]:
    """For each of ``count`` batches of ``size`` places from the batch ``first`` on, the windows,
    targets and labels of its rows in ``frames``, which come in order; batches without any give an
    empty list."""
    frames, frame, at = iter(frames), None, 0
    for batch in range(first, first + count):
        parts: list[Part] = []
        while True:
            if frame is None or at == len(frame):
                frame, at = next(frames, None), 0
                if frame is None:
                    break
            stop = int(np.searchsorted(_column(frame, "_place"), (batch + 1) * size))
            for a in range(at, stop, 256):
                own = _cut(frame, a, min(a + 256, stop))
                parts.append((*_arrays(own), _column(own, "regime_label")))
            at = stop
            if at < len(frame):
                break
        yield parts


def batch_gradient(config: ModelConfig, weights: Weights, parts: list[Part], training: TrainingConfig, rng: np.random.Generator | None = None) -> np.ndarray:
    """Loss, number of rows and gradient (by the weights' names in order), summed over the parts."""
    total = np.zeros(2 + sum(x.size for x in weights.values()))
    for x, y, labels in parts:
        loss, g = loss_and_gradient(config, weights, x, y, labels if training.supervised else None, training.supervised, rng)
        total += np.concatenate([[loss, len(x)], *(g[k].ravel() for k in sorted(weights))])
    return total


def unpacked(total: np.ndarray, weights: Weights) -> tuple[float, int, Weights]:
    return float(total[0]), int(total[1]), _split(total[2:], weights)


def _packed(x: object) -> str:
    return base64.b64encode(pickle.dumps(x, 5)).decode()


def _unpacked(x: str) -> object:
    return pickle.loads(base64.b64decode(x))


def _epoch(dealt: DataFrame, state: Adam, config: ModelConfig, training: TrainingConfig, size: int, count: int, run: int | None = None) -> tuple[Adam, float]:
    """The state after one epoch of ``count`` batches, and their mean loss: one job. All tasks share
    each batch; with ``run``, so many batches in a row are one task's, and the next go on from there."""
    shared = dealt.sparkSession.sparkContext.broadcast(state)
    last = -(-count // run) - 1 if run else 0

    def steps(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        me, own, losses = context.partitionId(), pickle.loads(pickle.dumps(shared.value)), 0.0

        def take(batches: Iterator[list[Part]], part: int, gathered: Callable[[np.ndarray], np.ndarray], total: float) -> float:
            for parts in batches:
                rng = np.random.default_rng([training.seed, own.step, part]) if config.dropout else None
                loss, n, g = unpacked(gathered(batch_gradient(config, own.weights, parts, training, rng)), own.weights)
                total += loss / n
                own.take(g, n, training)
            return total

        if run is None:
            losses = take(batches_of(frames, size, count), me, lambda mine: np.sum([_unpacked(e) for e in context.allGather(_packed(mine))], axis=0), losses)
        else:
            for turn in range(last + 1):
                if turn == me:
                    losses = take(batches_of(frames, size, min(run, count - me * run), me * run), 0, lambda mine: mine, losses)
                if turn < last:
                    given = context.allGather(_packed((own, losses)) if turn == me else "")
                    if turn + 1 == me:
                        own, losses = _unpacked("".join(given))
        if me == last:
            yield pa.RecordBatch.from_pydict({"state": [pickle.dumps(own, 5)], "loss": [losses / count]})

    (made,) = dealt.mapInArrow(steps, "state binary, loss double", barrier=True).collect()
    shared.unpersist()
    return pickle.loads(made["state"]), made["loss"]


def train(windows: DataFrame, config: ModelConfig, training: TrainingConfig = TrainingConfig(), validation: DataFrame | None = None, key: str = "seq") -> Trained:
    """AdamW over shuffled batches; gradients are clipped by their norm. ``windows`` has ``window``,
    ``target``, ``regime_label`` and an integer ``key``, by which rows fall into batches anew in
    each epoch. An epoch takes rows / ``batch_size`` steps, one after another, which more tasks do
    not shorten; a larger batch does. Its stage needs the cores of all its tasks at once, and no
    dynamic allocation of executors; an exchange sends the model's numbers to each task.

    Without rows the model stays as it was drawn, and its losses are not numbers."""
    training.check()
    if training.supervised and config.n_regimes:
        worst = windows.agg(F.count_if(~F.coalesce(F.col("regime_label").between(0, config.n_regimes - 1), F.lit(False)))).first()[0]
        if worst:
            raise ValueError("regime labels must lie between 0 and n_regimes - 1")
    state, model = Adam.first(initial(config, training.seed)), Trained(config, {})
    rows = windows.select(key, "window", "target", "regime_label").cache()
    try:
        total = rows.count()
        size = training.batch_size if training.batches is None else max(1, -(-total // training.batches))
        count, cores = -(-total // size), windows.sparkSession.sparkContext.defaultParallelism
        tasks, run = training.tasks or min(cores, min(size, total) // TASK_ROWS), None
        if training.tasks is None and tasks < 2:
            run = max(-(-count // cores), TURN_STEPS)
            tasks = -(-count // run)
        for epoch in range(training.epochs):
            loss = float("nan")
            if total:
                dealt = _dealt(rows, total, tasks, training, epoch, key, run * size if run else 1)
                state, loss = _epoch(dealt, state, config, training, size, count, run)
            model.weights = state.weights
            model.train_loss.append(float(loss))
            if validation is not None:
                model.validation_loss.append(mean_loss(validation, model, training))
    finally:
        rows.unpersist()
    return model


def predict(windows: DataFrame, model: Trained, keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """A forecast row for each window and step: ``keep``, ``h``, ``observed``, ``weights``,
    ``means``, ``stds``, and ``probs`` (empty without regimes)."""
    shared = windows.sparkSession.sparkContext.broadcast((model.config, model.weights))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.select(*keep).schema.fields)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        config, w = shared.value
        for frame in frames:
            for a in range(0, len(frame), 256):
                part = _cut(frame, a, min(a + 256, len(frame)))
                x, y = _arrays(part)
                got, n = forward(config, w, x), len(part)
                weights = _softmax(got["logits"])
                for h in range(config.horizon):
                    made = {k: part[k] for k in keep} | {"h": pa.array(np.full(n, h, np.int32)), "observed": _lists(y[:, h]), "weights": _lists(weights[:, h])}
                    made |= {"means": _lists(got["means"][:, h]), "stds": _lists(got["stds"][:, h]), "probs": _lists(got["probs"])}
                    yield pa.RecordBatch.from_pydict(made)

    schema = f"{kinds}, h int, observed array<double>, weights array<double>, means array<array<double>>, stds array<array<double>>, probs array<double>"
    return windows.select(*keep, "window", "target").mapInArrow(run, schema)
