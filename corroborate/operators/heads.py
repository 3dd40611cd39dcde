"""Stance and strength heads fitted together, and a search over their settings.

Training is full-batch: one job a step. Each task adds up losses and gradients of its rows for all
models that are being trained, groups of tasks are added up on executors, and the driver takes a few
sums of the models' size and steps. Rows are written once, sorted inside their partitions, and sums are
taken in order, so a rerun on the same data and partitions gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.operators.lineage import checkpointed

#: Stance classes, and partitions that are added up in one task.
CLASSES, FAN_IN = 3, 64
#: Numbers before the gradients in a sum: weight, rows, cross entropy, squared error and hits of training rows, then of held-out rows.
LOSSES = 10


@dataclass(frozen=True)
class Settings:
    """How a pair of heads is trained. hidden 0: without a hidden layer. After `plateau` epochs without a
    lower held-out loss the rate is multiplied by `factor`; after `patience` training stops."""

    lr: float = 0.01
    weight_decay: float = 1e-4
    strength_weight: float = 0.5
    hidden: int = 16
    epochs: int = 30
    patience: int = 5
    plateau: int = 2
    factor: float = 0.5
    seed: int = 42


class Epoch(NamedTuple):
    epoch: int
    lr: float
    train_loss: float
    train_stance: float
    train_strength: float
    train_accuracy: float
    val_loss: float
    val_stance: float
    val_strength: float
    val_accuracy: float


def _shapes(size: int, hidden: int) -> list[tuple[int, ...]]:
    """Weights and biases of the stance head, then of the strength head."""
    head = lambda out: [(size, hidden), (hidden,), (hidden, out), (out,)] if hidden else [(size, out), (out,)]
    return head(CLASSES) + head(1)


def _split(flat: np.ndarray, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    return [flat[e - int(np.prod(s)) : e].reshape(s) for e, s in zip(ends, shapes, strict=True)]


def initial(size: int, settings: Settings) -> np.ndarray:
    """Weights drawn evenly within 1 / sqrt(inputs), biases 0."""
    rng = np.random.default_rng(settings.seed)
    return np.concatenate([(rng.uniform(-1, 1, s) / np.sqrt(s[0]) if len(s) == 2 else np.zeros(s)).ravel() for s in _shapes(size, settings.hidden)])


def _forward(x: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray | None]:
    if len(parts) == 2:
        return x @ parts[0] + parts[1], None
    hidden = np.maximum(x @ parts[0] + parts[1], 0)
    return hidden @ parts[2] + parts[3], hidden


def _backward(x: np.ndarray, hidden: np.ndarray | None, parts: list[np.ndarray], d: np.ndarray) -> list[np.ndarray]:
    if hidden is None:
        return [x.T @ d, d.sum(axis=0)]
    inner = (d @ parts[2].T) * (hidden > 0)
    return [x.T @ inner, inner.sum(axis=0), hidden.T @ d, d.sum(axis=0)]


def predict(x: np.ndarray, flat: np.ndarray, hidden: int) -> tuple[np.ndarray, np.ndarray]:
    """Stance probabilities (n, 3) and strengths (n,)."""
    parts = _split(flat, _shapes(x.shape[1], hidden))
    half = len(parts) // 2
    logits, _ = _forward(x, parts[:half])
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    out, _ = _forward(x, parts[half:])
    return e / e.sum(axis=1, keepdims=True), 1 / (1 + np.exp(-np.clip(out[:, 0], -500, 500)))


def sums(x: np.ndarray, stance: np.ndarray, strength: np.ndarray, held_out: np.ndarray, weights: np.ndarray, flat: np.ndarray, hidden: int) -> np.ndarray:
    """Losses of training and held-out rows (see LOSSES), and gradients: of the weighted cross entropy
    for the stance head, of the squared error for the strength head, added up over training rows."""
    parts = _split(flat, _shapes(x.shape[1], hidden))
    half = len(parts) // 2
    p, s = predict(x, flat, hidden)
    w = weights[stance]
    entropy = -np.log(np.maximum(p[np.arange(len(x)), stance], 1e-300)) * w
    error, hit = (s - strength) ** 2, p.argmax(axis=1) == stance
    losses = [float(v[side].sum()) for side in (~held_out, held_out) for v in (w, np.ones(len(x)), entropy, error, hit)]
    train = ~held_out
    x, p, w, stance, s, strength = x[train], p[train].copy(), w[train], stance[train], s[train], strength[train]
    p[np.arange(len(x)), stance] -= 1
    d_strength = (2 * (s - strength) * s * (1 - s))[:, None]
    grads = _backward(x, _forward(x, parts[:half])[1], parts[:half], p * w[:, None]) + _backward(x, _forward(x, parts[half:])[1], parts[half:], d_strength)
    return np.concatenate([losses, *(g.ravel() for g in grads)])


@dataclass
class Run:
    """A model in training: its numbers, Adam's moments, and what has been seen of it."""

    settings: Settings
    size: int
    flat: np.ndarray
    rate: float
    m: np.ndarray = field(init=False)
    v: np.ndarray = field(init=False)
    steps: int = 0
    best_loss: float = np.inf
    best_accuracy: float = -1.0
    best: np.ndarray | None = None
    waited: int = 0
    flat_for: int = 0
    history: list[Epoch] = field(default_factory=list)
    state: str = "running"

    def __post_init__(self) -> None:
        self.m, self.v = np.zeros_like(self.flat), np.zeros_like(self.flat)

    def seen(self, total: np.ndarray) -> None:
        """Take in the sums of one pass: judge the last step, and step again unless training is over."""
        o, losses = self.settings, total[:LOSSES]
        if self.steps:
            self._judge(losses)
        if self.state == "running" and self.steps < o.epochs:
            grad = total[LOSSES:].copy()
            half = sum(int(np.prod(s)) for s in _shapes(self.size, o.hidden)[: len(_shapes(self.size, o.hidden)) // 2])
            grad[:half] /= max(losses[0], 1e-300)
            grad[half:] *= o.strength_weight / max(losses[1], 1)
            self._step(grad + o.weight_decay * self.flat)

    def _judge(self, losses: np.ndarray) -> None:
        o = self.settings
        (t_ce, t_se, t_acc), (v_ce, v_se, v_acc) = ((x[2] / max(x[0], 1e-300), x[3] / max(x[1], 1), x[4] / max(x[1], 1)) for x in (losses[:5], losses[5:]))
        loss = v_ce + o.strength_weight * v_se
        self.history.append(Epoch(self.steps, self.rate, t_ce + o.strength_weight * t_se, t_ce, t_se, t_acc, loss, v_ce, v_se, v_acc))
        if v_acc >= self.best_accuracy:  # the model that is kept goes by accuracy, the end of training by loss
            self.best_accuracy, self.best = v_acc, self.flat.copy()
        if loss < self.best_loss:
            self.best_loss, self.waited, self.flat_for = loss, 0, 0
        else:
            self.waited, self.flat_for = self.waited + 1, self.flat_for + 1
        if self.flat_for > o.plateau:
            self.rate, self.flat_for = self.rate * o.factor, 0
        if self.waited >= o.patience:
            self.state = "stopped"
        elif self.steps >= o.epochs:
            self.state = "complete"

    def _step(self, grad: np.ndarray) -> None:
        self.steps += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad**2
        self.flat = self.flat - self.rate * (self.m / (1 - 0.9**self.steps)) / (np.sqrt(self.v / (1 - 0.999**self.steps)) + 1e-8)


def start(size: int, settings: Settings) -> Run:
    return Run(settings, size, initial(size, settings), settings.lr)


def training_rows(items: DataFrame, key: str, features: str | Column, stance: str | Column, strength: str | Column, held_out: Column, n: int | None = None) -> DataFrame:
    """(key, x, stance, strength, held_out), written, in n partitions by key and sorted inside.

    Rows without features, a stance of 0 to 2 or a strength are left out; so are rows of other lengths than most
    by an error where they are read: features have one length.
    """
    c = lambda v: F.col(v) if isinstance(v, str) else v
    rows = items.select(
        F.col(key).alias("key"), F.transform(c(features), lambda v: v.cast("double")).alias("x"), c(stance).cast("int").alias("stance"),
        c(strength).cast("double").alias("strength"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
    ).where("x is not null and stance between 0 and 2 and strength is not null")
    n = n or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(rows.repartition(n, "key").sortWithinPartitions("key", "stance", "strength", "x"))


def class_weights(rows: DataFrame) -> np.ndarray:
    """Rows / (classes x rows of the class) over the training rows; a class without rows counts as one."""
    counts = dict(rows.where("not held_out").groupBy("stance").count().collect())
    n = np.array([max(counts.get(k, 0), 1) for k in range(CLASSES)], float)
    return n.sum() / (CLASSES * n)


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _pass(rows: DataFrame, runs: list[Run], weights: np.ndarray) -> list[np.ndarray]:
    """The sums of every run over all rows: per task, then per FAN_IN tasks, then here, always in order."""
    models = [(r.flat, r.settings.hidden, r.size) for r in runs]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = [np.zeros(LOSSES + len(flat)) for flat, _, _ in models]
        for b in batches:
            if b.num_rows:
                stance, strength, held = (b.column(c).to_numpy(zero_copy_only=False) for c in ("stance", "strength", "held_out"))
                for k, (flat, hidden, size) in enumerate(models):
                    total[k] += sums(_matrix(b.column("x"), size), stance.astype(int), strength, held.astype(bool), weights, flat, hidden)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(models)), pa.int32()), pa.array([task] * len(models), pa.int32()), pa.array(total, pa.list_(pa.float64()))], ["run", "task", "total"])

    def added(group: pa.Table) -> pa.Table:
        ordered = group.sort_by("task")
        total = np.sum(np.array(ordered["total"].to_pylist()), axis=0)
        return pa.table({"run": ordered["run"][:1], "task": ordered["task"][:1], "total": pa.array([total], pa.list_(pa.float64()))})

    schema = "run int, task int, total array<double>"
    parts = rows.mapInArrow(each, schema).groupBy("run", F.floor(F.col("task") / FAN_IN).alias("part")).applyInArrow(added, schema).collect()
    out = [np.zeros(LOSSES + len(flat)) for flat, _, _ in models]
    for r in sorted(parts, key=lambda r: (r.run, r.task)):
        out[r.run] += np.array(r.total)
    return out


def advance(rows: DataFrame, runs: list[Run], weights: np.ndarray, upto: int | None = None) -> None:
    """Train the runs together, a pass over the rows for each step of all of them, until each has
    ended or been judged for `upto` epochs."""
    while active := [r for r in runs if r.state == "running" and (upto is None or len(r.history) < upto)]:
        for run, total in zip(active, _pass(rows, active, weights), strict=True):
            run.seen(total)


def fit_heads(rows: DataFrame, settings: Settings | None = None, weights: np.ndarray | None = None) -> Run:
    """Both heads fitted to training_rows with loss cross entropy + strength_weight x squared error.

    The run has the model of the best held-out accuracy (`best`) and a history of epochs. Without
    training rows ValueError is raised.
    """
    first = rows.select("x").first()
    if first is None:
        raise ValueError("no rows to train on")
    run = start(len(first.x), settings or Settings())
    advance(rows, [run], class_weights(rows) if weights is None else weights)
    return run


def history_table(spark: SparkSession, runs: dict[str, Run]) -> DataFrame:
    """(model, epoch, lr, losses and accuracies): one row an epoch."""
    rows = [(name, *e) for name, run in runs.items() for e in run.history]
    kinds = "model string, epoch int, lr double, " + ", ".join(f"{c} double" for c in Epoch._fields[2:])
    return spark.createDataFrame([(r[0], int(r[1]), *map(float, r[2:])) for r in rows], kinds)


def apply_heads(rows: DataFrame, run: Run, features: str = "x") -> DataFrame:
    """rows with p (stance probabilities), stance_pred and strength_pred; null where there are no features."""
    flat, hidden, size = run.best if run.best is not None else run.flat, run.settings.hidden, run.size
    at = rows.columns.index(features)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(at)
            ok = np.array(column.is_valid())
            p, s = predict(_matrix(column.filter(column.is_valid()), size).astype(float), flat, hidden) if ok.any() else (np.empty((0, CLASSES)), np.empty(0))
            where = np.cumsum(ok) - 1
            lists = [p[where[i]].tolist() if ok[i] else None for i in range(len(ok))]
            made = [pa.array(lists, pa.list_(pa.float64())), pa.array([int(np.argmax(x)) if x else None for x in lists], pa.int32()), pa.array([float(s[where[i]]) if ok[i] else None for i in range(len(ok))], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, "p", "stance_pred", "strength_pred"])

    out = rows.withColumns({"p": F.lit(None).cast("array<double>"), "stance_pred": F.lit(None).cast("int"), "strength_pred": F.lit(None).cast("double")}).schema
    return rows.mapInArrow(each, out)


@dataclass(frozen=True)
class Space:
    """What a search draws from: rate and decay evenly in their logarithms, the rest evenly."""

    lr: tuple[float, float] = (1e-3, 1e-1)
    weight_decay: tuple[float, float] = (1e-5, 1e-2)
    strength_weight: tuple[float, float] = (0.5, 5.0)
    hidden: tuple[int, ...] = (0, 8, 16)


def propose(space: Space, rng: np.random.Generator, base: Settings, near: list[Settings] | None = None) -> Settings:
    """A draw from the space; with `near` one of these moved by up to a tenth of the space's width."""
    log = lambda lo, hi, at: float(np.exp(np.clip(at, np.log(lo), np.log(hi))))
    if near:
        one, width = near[int(rng.integers(len(near)))], 0.1
        step = lambda lo, hi: rng.normal() * width * (np.log(hi) - np.log(lo))
        moved = float(np.clip(one.strength_weight + rng.normal() * width * (space.strength_weight[1] - space.strength_weight[0]), *space.strength_weight))
        return replace(one, lr=log(*space.lr, np.log(one.lr) + step(*space.lr)), weight_decay=log(*space.weight_decay, np.log(one.weight_decay) + step(*space.weight_decay)), strength_weight=moved)
    even = lambda lo, hi: rng.uniform(np.log(lo), np.log(hi))
    return replace(base, lr=log(*space.lr, even(*space.lr)), weight_decay=log(*space.weight_decay, even(*space.weight_decay)), strength_weight=float(rng.uniform(*space.strength_weight)), hidden=int(rng.choice(space.hidden)))


class Trial(NamedTuple):
    trial: int
    wave: int
    run: Run


def search(rows: DataFrame, n_trials: int = 30, waves: int = 3, space: Space | None = None, base: Settings | None = None, rungs: tuple[int, ...] = (3, 6, 12), seed: int = 42) -> list[Trial]:
    """n_trials settings, in waves. The first wave is drawn from the space, later ones near the best
    third so far. A wave's trials train together; at each rung (epochs) those whose interim held-out
    stance loss is above the median of all trials that reached it are pruned. The same seed, rows and
    partitions give the same trials. Without rows ValueError is raised.

    Trials are compared by their lowest held-out stance loss, since total losses of different
    strength weights can't be.
    """
    space, base, rng = space or Space(), base or Settings(epochs=20), np.random.default_rng(seed)
    first = rows.select("x").first()
    if first is None:
        raise ValueError("no rows to train on")
    weights, trials = class_weights(rows), []
    reached: dict[int, list[float]] = {r: [] for r in rungs}
    for wave in range(waves):
        n = (n_trials * (wave + 1)) // waves - len(trials)
        best = [t.run.settings for t in sorted(trials, key=lambda t: lowest(t.run))[: max(1, len(trials) // 3)]]
        mine = [Trial(len(trials) + i, wave, start(len(first.x), propose(space, rng, base, best if trials else None))) for i in range(n)]
        trials += mine
        for rung in rungs:
            advance(rows, [t.run for t in mine], weights, rung)
            there = [t for t in mine if len(t.run.history) >= rung]
            reached[rung] += [min(e.val_stance for e in t.run.history[:rung]) for t in there]
            for t in there:
                if t.run.state == "running" and min(e.val_stance for e in t.run.history[:rung]) > np.median(reached[rung]):
                    t.run.state = "pruned"
        advance(rows, [t.run for t in mine], weights)
    return trials


def lowest(run: Run) -> float:
    return min((e.val_stance for e in run.history), default=np.inf)


def trial_table(spark: SparkSession, trials: list[Trial]) -> DataFrame:
    """(trial, wave, lr, weight_decay, strength_weight, hidden, epochs, state, val_stance, is_best): pruned trials too."""
    best = min(trials, key=lambda t: (lowest(t.run), t.trial)).trial if trials else None
    rows = [(t.trial, t.wave, s.lr, s.weight_decay, s.strength_weight, s.hidden, len(t.run.history), t.run.state, float(lowest(t.run)), t.trial == best) for t in trials for s in (t.run.settings,)]
    return spark.createDataFrame(rows, "trial int, wave int, lr double, weight_decay double, strength_weight double, hidden int, epochs int, state string, val_stance double, is_best boolean")
