"""Many logistic regressions at once: every fold, and every trial of shuffled labels, in one pass over the rows a step.

A fit is a pair of trial and fold; it learns from the rows outside its fold. Rows are sparse (``at``, ``x``) and are read as
Arrow's flat arrays; a task adds the losses and gradients of all fits up over its rows and emits them in blocks of numbers,
which are added by block, so what is shuffled grows with tasks, fits and features alone. The driver holds weights (fits x features) and moves all fits by L-BFGS, one job a step whatever the
number of fits; a fit that has settled or refused a step waits for the others.

Shuffled labels come from a hash of the row: in a trial the rows with the k smallest values are positive, k the number of
positives. The k-th value is found by counting digits, from the highest, so no trial's rows are ever put in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship

_U = np.uint64
DIGITS = 12
CHUNK = 4096
#: Numbers of all fits that are shuffled as one row.
BLOCK = 4096


def trial_hash(h: np.ndarray, trial: int, seed: int) -> np.ndarray:
    """52 bits from a row's hash and the trial."""
    x = h.astype(np.int64).view(_U) + _U(((trial + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return (x ^ (x >> _U(31))) >> _U(12)


def thresholds(rows: DataFrame, trials: int, k: int, seed: int) -> list[int]:
    """For each trial the value below or at which k rows lie; ``rows`` has h. Five jobs or fewer, whatever the rows."""
    ship(rows.sparkSession)
    low, left, bits = np.zeros(trials, np.int64), np.full(trials, k), 52
    while bits > 0:
        take = min(DIGITS, bits)
        bits -= take

        def count(frames: Iterator[pd.DataFrame], low=low.copy(), bits=bits, take=take) -> Iterator[pd.DataFrame]:
            total = np.zeros((trials, 1 << take), np.int64)
            for f in frames:
                h = f["h"].to_numpy()
                for t in range(trials):
                    v = trial_hash(h, t, seed).astype(np.int64)
                    v = v[(v >> (bits + take)) == (low[t] >> (bits + take))]
                    total[t] += np.bincount((v >> bits) & ((1 << take) - 1), minlength=1 << take)
            t, c = np.nonzero(total)
            yield pd.DataFrame({"t": t, "c": c, "n": total[t, c]})

        found = rows.select("h").mapInPandas(count, "t int, c int, n bigint").groupBy("t", "c").agg(F.sum("n").alias("n")).collect()
        total = np.zeros((trials, 1 << take), np.int64)
        for r in found:
            total[r.t, r.c] = r.n
        upto = np.cumsum(total, axis=1)
        cell = np.array([np.searchsorted(u, x) for u, x in zip(upto, left, strict=True)])
        left = left - np.where(cell > 0, upto[np.arange(trials), np.maximum(cell - 1, 0)], 0)
        low = low + (cell.astype(np.int64) << bits)
    return low.tolist()


@dataclass(frozen=True)
class Labels:
    """How rows are labelled: as they are, or in trials by thresholds of their hash."""

    cuts: tuple[int, ...] | None = None
    seed: int = 0

    @property
    def trials(self) -> int:
        return len(self.cuts) if self.cuts else 1

    def of(self, rows: pa.RecordBatch) -> np.ndarray:
        """Rows x trials of 0 and 1."""
        if self.cuts is None:
            return _numbers(rows["y"]).astype(float)[:, None]
        h = _numbers(rows["h"])
        return np.stack([(trial_hash(h, t, self.seed).astype(np.int64) <= c).astype(float) for t, c in enumerate(self.cuts)], axis=1)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


class Chunk:
    """Some rows as a matrix: dense where it is narrow, else as entries."""

    def __init__(self, rows: pa.RecordBatch, width: int):
        size = _numbers(pc.list_value_length(rows["at"]))
        self.n, self.width = rows.num_rows, width
        self.row = np.repeat(np.arange(self.n), size)
        self.col, self.val = _numbers(rows["at"].flatten()).astype(np.int64), _numbers(rows["x"].flatten()).astype(float)
        self.dense = None
        if width <= 256:
            self.dense = np.bincount(self.row * width + self.col, self.val, self.n * width).reshape(self.n, width)

    def times(self, w: np.ndarray) -> np.ndarray:
        """Rows x fits, of weights (fits x width)."""
        if self.dense is not None:
            return self.dense @ w.T
        return np.stack([np.bincount(self.row, self.val * f[self.col], self.n) for f in w], axis=1)

    def back(self, r: np.ndarray) -> np.ndarray:
        """Fits x width, of residuals (rows x fits)."""
        if self.dense is not None:
            return r.T @ self.dense
        return np.stack([np.bincount(self.col, self.val * c[self.row], self.width) for c in r.T])


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for f in batches:
        for a in range(0, f.num_rows, CHUNK):
            yield f.slice(a, CHUNK)


def _blocks(at: list[int], rows: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["block", "v"])


def _pass(w: np.ndarray, weight: np.ndarray, labels: Labels, folds: int):
    """(block, v): loss and gradient of every fit, one fit's after another's; ``weight`` (fits x 2) by class."""
    fits, width = w.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grad, loss = np.zeros((fits, width)), np.zeros(fits)
        for f in chunks(batches):
            m, fold = Chunk(f, width), _numbers(f["fold"])
            y = np.repeat(labels.of(f), folds, axis=1)
            z = m.times(w)
            s = np.where(y == 1, weight[:, 1], weight[:, 0]) * (fold[:, None] != np.tile(np.arange(folds), labels.trials))
            loss += (s * (np.logaddexp(0, z) - y * z)).sum(axis=0)
            grad += m.back(s * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y))
        flat = np.c_[loss, grad].ravel()
        cuts = range(0, len(flat), BLOCK)
        # Blocks without a number, as of a task without rows, add nothing.
        full = [k for k, a in enumerate(cuts) if flat[a : a + BLOCK].any()]
        yield _blocks(full, [flat[k * BLOCK : (k + 1) * BLOCK] for k in full])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by block of all rows of a task."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, v in zip(batch["block"].to_pylist(), batch["v"], strict=True):
            v = _numbers(v.values)
            total[k] = total[k] + v if k in total else v
    yield _blocks(list(total), list(total.values()))


def _summed(rows: DataFrame, run, size: int) -> np.ndarray:
    """What ``run`` gives for the rows of every task, in blocks, added up: ``size`` numbers."""
    kind = "block int, v array<double>"
    out = np.zeros(size)
    found = rows.mapInArrow(run, kind).repartition(min(-(-size // BLOCK), 8), "block").mapInArrow(_added, kind).toArrow()
    for k, v in zip(found["block"].to_pylist(), found["v"], strict=True):
        out[k * BLOCK : (k + 1) * BLOCK] = _numbers(v.values)
    return out


def class_counts(rows: DataFrame, labels: Labels, folds: int) -> np.ndarray:
    """Trials x folds x 2: rows of either class in each fold."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((labels.trials, folds, 2), np.int64)
        for f in chunks(batches):
            y, fold = labels.of(f).astype(int), _numbers(f["fold"]).astype(np.int64)
            for t in range(labels.trials):
                n[t] += np.bincount(2 * fold + y[:, t], minlength=2 * folds).reshape(folds, 2)
        t, k, c = (x.astype(np.int32) for x in np.nonzero(n))
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(k), pa.array(c), pa.array(n[t, k, c])], ["t", "fold", "c", "n"])

    out = np.zeros((labels.trials, folds, 2), np.int64)
    for r in _needed(rows, labels).mapInArrow(run, "t int, fold int, c int, n bigint").groupBy("t", "fold", "c").agg(F.sum("n").alias("n")).collect():
        out[r.t, r.fold, r.c] = r.n
    return out


def _needed(rows: DataFrame, labels: Labels, *more: str) -> DataFrame:
    """The columns that a pass reads."""
    return rows.select("fold", "y" if labels.cuts is None else "h", *more)


@dataclass
class Fits:
    """Weights (fits x features), which fits had both classes to learn from, and how many passes it took."""

    w: np.ndarray
    usable: np.ndarray
    passes: int
    converged: bool


def fit(rows: DataFrame, width: int, folds: int, labels: Labels = Labels(), l2: float = 1.0, free: int | None = None, most: int = 200, tolerance: float = 1e-9, scale: tuple[np.ndarray, np.ndarray] | None = None) -> Fits:
    """Balanced logistic regressions without each fold: sum of weighted log losses + l2/2 |w|^2.

    ``rows`` has at array<int>, x array<double>, fold int, y double, and h long for trials. A class's rows weigh n / (2 *
    its rows); the feature ``free`` isn't regularised. A fit whose training rows have one class is not usable and keeps
    zeros. ``tolerance`` is for the largest slope, relative to the rows. ``scale`` gives each fit means and deviations of
    the features before ``free``, the last one: it learns on scaled features, and its weights are turned back to fit x.
    """
    counts = class_counts(rows, labels, folds)
    train = counts.sum(axis=1, keepdims=True) - counts
    train = train.reshape(-1, 2)
    usable = (train > 0).all(axis=1)
    weight = np.where(usable[:, None], train.sum(axis=1, keepdims=True) / np.maximum(2.0 * train, 1), 0.0)
    ridge = np.full(width, l2)
    if free is not None:
        ridge[free] = 0.0
    size = np.maximum(train.sum(axis=1), 1).astype(float)

    def plain(w: np.ndarray) -> np.ndarray:
        """Weights on x as it is, from those on scaled features."""
        if scale is None:
            return w
        own = w[:, :-1] / scale[1]
        return np.c_[own, w[:, -1] - (own * scale[0]).sum(axis=1)]

    def turned(g: np.ndarray) -> np.ndarray:
        return g if scale is None else np.c_[(g[:, :-1] - g[:, -1:] * scale[0]) / scale[1], g[:, -1]]

    def at(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        loss, grad = (w * w * ridge).sum(axis=1) / 2, np.zeros_like(w)
        sums = _summed(_needed(rows, labels, "at", "x"), _pass(plain(w), weight, labels, folds), w.shape[0] * (width + 1)).reshape(-1, width + 1)
        loss, grad = loss + sums[:, 0], grad + sums[:, 1:]
        return loss / size, (turned(grad) + w * ridge) / size[:, None]

    movers = [_Mover(np.zeros(width)) for _ in range(len(train))]
    passes = 0
    while passes < most:
        passes += 1
        loss, grad = at(np.stack([m.x for m in movers]))
        for m, f, g, u in zip(movers, loss, grad, usable, strict=True):
            if u and not m.done:
                m.told(float(f), g, tolerance)
        if all(m.done or not u for m, u in zip(movers, usable, strict=True)):
            break
    return Fits(plain(np.stack([m.best for m in movers])), usable, passes, all(m.done or not u for m, u in zip(movers, usable, strict=True)))


class _Mover:
    """One fit's L-BFGS: where to look next (``x``), and the best place so far."""

    def __init__(self, x: np.ndarray, memory: int = 12):
        self.x, self.best, self.memory = x, x, memory
        self.f, self.g, self.pairs, self.done = None, None, [], False
        self.step, self.way = 1.0, None

    def told(self, f: float, g: np.ndarray, tolerance: float) -> None:
        """Loss and slope at ``x``."""
        if self.f is not None and f > self.f + 1e-4 * self.step * float(self.g @ self.way):
            if self.step < 1e-9 or abs(f - self.f) <= 1e-15 * abs(self.f):
                self.done = True
                return
            self.step *= 0.4
            self.x = self.best + self.step * self.way
            return
        if self.f is not None:
            s, y = self.x - self.best, g - self.g
            if s @ y > 1e-300:
                self.pairs = [*self.pairs, (s, y)][-self.memory :]
        self.best, self.f, self.g = self.x, f, g
        if np.abs(g).max() < tolerance:
            self.done = True
            return
        self.way, self.step = -self._turned(g), 1.0 if self.pairs else min(1.0, 1.0 / float(np.abs(g).sum()))
        self.x = self.best + self.step * self.way

    def _turned(self, g: np.ndarray) -> np.ndarray:
        q, kept = g.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            q, kept = q - a * y, [*kept, a]
        if self.pairs:
            s, y = self.pairs[-1]
            q = q * ((s @ y) / (y @ y))
        for (s, y), a in zip(self.pairs, reversed(kept), strict=True):
            q = q + s * (a - (y @ q) / (s @ y))
        return q


def scored(rows: DataFrame, fits: Fits, width: int, folds: int, labels: Labels = Labels()) -> DataFrame:
    """(trial, fold, positive, score): every row scored by the fit of its own fold, which hasn't seen it."""
    ship(rows.sparkSession)
    w, usable = fits.w.reshape(labels.trials, folds, width), fits.usable.reshape(labels.trials, folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in chunks(batches):
            m, fold, y = Chunk(f, width), _numbers(f["fold"]), labels.of(f)
            for t in range(labels.trials):
                z = np.zeros(f.num_rows)
                for k in np.unique(fold):
                    mine = fold == k
                    z[mine] = m.times(w[t, k][None])[mine, 0]
                ok = usable[t][fold]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(ok.sum(), t, np.int32)), pa.array(fold[ok].astype(np.int32)), pa.array(y[ok, t] == 1), pa.array(z[ok])], ["trial", "fold", "positive", "score"])

    return _needed(rows, labels, "at", "x").mapInArrow(run, "trial int, fold int, positive boolean, score double")
