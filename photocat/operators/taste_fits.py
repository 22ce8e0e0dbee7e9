"""Many preference models at once: every pass over the votes gives the loss and the
slope of all of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Passes at most, steps that a model remembers, and the slope at which it is done.
PASSES, MEMORY, TOLERANCE = 200, 10, 1e-7
#: A step is taken if it gains this share of what its slope promises.
GAIN = 1e-4
#: Votes whose margins are computed at once.
ROWS = 4096


@dataclass(frozen=True)
class Model:
    """A penalty, and the fold that is left out (None: none)."""

    l2: float
    left_out: int | None = None


@dataclass
class Descent:
    """A limited-memory quasi-Newton descent (L-BFGS) that is told losses and slopes
    from outside: ``trial`` is where it wants to know them next."""

    trial: np.ndarray
    at: np.ndarray | None = None
    loss: float = np.inf
    slope: np.ndarray | None = None
    way: np.ndarray | None = None
    step: float = 1.0
    past: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    done: bool = False

    def tell(self, loss: float, slope: np.ndarray) -> None:
        if self.at is not None:
            if loss > self.loss + GAIN * self.step * float(self.slope @ self.way):
                self.step /= 2
                self.done = self.step < 1e-12
                self.trial = self.at + self.step * self.way
                return
            moved, turned = self.trial - self.at, slope - self.slope
            if float(moved @ turned) > 1e-16:
                self.past = [*self.past[-(MEMORY - 1) :], (moved, turned)]
        self.at, self.loss, self.slope = self.trial, loss, slope
        if np.abs(slope).max(initial=0) <= TOLERANCE:
            self.done = True
            return
        self.way = -self._shaped(slope)
        self.step = 1.0 if self.past else min(1.0, 1 / float(np.linalg.norm(slope)))
        self.trial = self.at + self.step * self.way

    def _shaped(self, slope: np.ndarray) -> np.ndarray:
        q, shares = slope.copy(), []
        for s, y in reversed(self.past):
            shares.append(float(s @ q) / float(s @ y))
            q -= shares[-1] * y
        if self.past:
            s, y = self.past[-1]
            q *= float(s @ y) / float(y @ y)
        for (s, y), a in zip(self.past, reversed(shares), strict=True):
            q += s * (a - float(y @ q) / float(s @ y))
        return q


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _used(fold: np.ndarray, models: list[Model]) -> np.ndarray:
    return np.stack([np.ones(len(fold), bool) if m.left_out is None else fold != m.left_out for m in models], axis=1)


def loss_sums(rows: DataFrame, models: list[Model], weights: np.ndarray) -> np.ndarray:
    """(models, 1 + dimension): the sums over (fold, d) of each model's losses and slopes.
    Each task sums its rows; the sums of tasks are added by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models), 1 + weights.shape[1]))
        for batch in batches:
            fold, d = batch.column("fold").to_numpy(zero_copy_only=False), _matrix(batch.column("d"))
            for lo in range(0, len(d), ROWS):
                x, used = d[lo : lo + ROWS], _used(fold[lo : lo + ROWS], models)
                margin = x @ weights.T
                total[:, 0] += (np.logaddexp(0, -margin) * used).sum(axis=0)
                total[:, 1:] -= (used / (1 + np.exp(np.clip(margin, -500, 500)))).T @ x
        m, i = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(m.ravel().astype(np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(total.ravel())], names=["m", "i", "x"])

    out = np.zeros((len(models), 1 + weights.shape[1]))
    for r in rows.select("fold", "d").mapInArrow(run, "m int, i int, x double").groupBy("m", "i").agg(F.sum("x").alias("x")).collect():  # models x dimension
        out[r["m"], r["i"]] = r["x"]
    return out


def fit_models(rows: DataFrame, models: list[Model], n_bad: int = 0) -> np.ndarray:
    """(models, dimension): the weights of each model, which minimise the mean loss of
    its votes (fold, d) and ``n_bad`` below-floor rows plus l2 |w|^2. As many passes
    as the slowest model takes, whatever their number. ``rows`` is read in each pass
    and should be a written table."""
    first = rows.select("d").first()
    if first is None:
        return np.zeros((len(models), 0))
    by_fold = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}  # a row for each fold
    n = np.array([sum(c for f, c in by_fold.items() if m.left_out is None or f != m.left_out) + n_bad for m in models])
    l2 = np.array([m.l2 for m in models])
    descents = [Descent(np.zeros(len(first["d"]))) for _ in models]
    for _ in range(PASSES):
        going = [i for i, d in enumerate(descents) if not d.done]
        if not going:
            break
        weights = np.stack([descents[i].trial for i in going])
        sums = loss_sums(rows, [models[i] for i in going], weights) / np.maximum(n[going], 1)[:, None]
        for i, w, s in zip(going, weights, sums, strict=True):
            descents[i].tell(s[0] + l2[i] * float(w @ w), s[1:] + 2 * l2[i] * w)
    return np.stack([d.at for d in descents])


def left_out_accuracy(rows: DataFrame, models: list[Model], weights: np.ndarray) -> np.ndarray:
    """The share of the votes of each model's left-out fold that it gets right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, asked = np.zeros(len(models), np.int64), np.zeros(len(models), np.int64)
        for batch in batches:
            test = ~_used(batch.column("fold").to_numpy(zero_copy_only=False), models)
            right += (test & (_matrix(batch.column("d")) @ weights.T > 0)).sum(axis=0)
            asked += test.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models), dtype=np.int32)), pa.array(right), pa.array(asked)], names=["m", "hits", "asked"])

    out = np.zeros(len(models))
    for r in rows.select("fold", "d").mapInArrow(run, "m int, hits long, asked long").groupBy("m").agg(F.sum("hits").alias("hits"), F.sum("asked").alias("asked")).collect():  # a row for each model
        out[r["m"]] = r["hits"] / r["asked"] if r["asked"] else 0.0
    return out
