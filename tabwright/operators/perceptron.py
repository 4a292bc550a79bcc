"""A perceptron with one hidden layer for regression: squared loss, gradients added up over packed blocks of rows.

Every pass computes loss and gradient of all models (those of the folds and of the split) at their trial points in one job:
tasks add up their blocks, the sums are merged in steps in a fixed order, and the driver holds only weights and
the last ``MEMORY`` steps of each model, whose size follows from features and hidden units. Steps are those of
the limited-memory quasi-Newton method with backtracking; a model stops when ``PATIENCE`` steps gained less than
``tolerance``. Inputs and target are standardised by the rows of each model's own training set.

Defined cases: a constant or empty feature adds nothing; without training rows, or with a constant target, the
prediction is the mean (0 without rows). Same rows, same weights: nothing is drawn but the seeded first weights.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from . import packed

SETS = "__sets"
MEMORY = 10
PATIENCE = 10
#: Rows whose hidden layer is computed at once.
SLICE = 1 << 9


@dataclass(frozen=True)
class Settings:
    hidden: int = 100
    penalty: float = 1e-4
    passes: int = 300
    tolerance: float = 1e-4
    seed: int = 42

    def train(self, df: DataFrame, features: list[str], sets: list[str], classes: int) -> list[Perceptron]:
        if classes:
            raise ValueError("this perceptron is for regression")
        return train(df, features, sets, self)

    def sized(self, facts) -> Settings:
        return Settings(self.hidden, self.penalty, facts.passes, self.tolerance, self.seed)


def _parts(theta: np.ndarray, width: int, hidden: int):
    a, b, c = width * hidden, (width + 1) * hidden, (width + 2) * hidden
    return theta[:a].reshape(width, hidden), theta[a:b], theta[b:c], theta[c]


def loss_sums(theta: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int) -> np.ndarray:
    """Half the sum of squared errors over standardised rows, then its gradient.

    Rows go by slices whose hidden layer stays in a core's cache; the constants are weights of a further input that is one.
    """
    width = x.shape[1]
    _, _, v, c = _parts(theta, width, hidden)
    inner = theta[: (width + 1) * hidden].reshape(width + 1, hidden)
    loss, slope, outer, last = 0.0, np.zeros((width + 1, hidden)), np.zeros(hidden), 0.0
    size = min(SLICE, len(x))
    # Whole arrays of zeros: against a single number, maxima are taken one by one. All are made once for all slices.
    room, nothing, above, every = np.empty((size, hidden)), np.zeros((size, hidden)), np.empty((size, hidden), bool), np.ones((size, width + 1))
    for at in range(0, len(x), SLICE):
        n = min(SLICE, len(x) - at)
        given, h, zero = every[:n], room[:n], nothing[:n]
        given[:, :width] = x[at : at + n]
        np.matmul(given, inner, out=h)
        np.maximum(h, zero, out=h)
        e = h @ v
        e += c
        e -= y[at : at + n]
        loss += 0.5 * (e @ e)
        outer += e @ h
        last += e.sum()
        np.copyto(h, np.greater(h, 0.0, out=above[:n]))
        slope += (given * e[:, None]).T @ h
    return np.concatenate([[loss], (slope * v).ravel(), outer, [last]])


@dataclass
class Perceptron:
    features: tuple[str, ...]
    hidden: int
    centre: np.ndarray  # of the features, then of the target
    scale: np.ndarray
    theta: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = _parts(self.theta, len(self.features), self.hidden)
        z = (x - self.centre[:-1]) / self.scale[:-1]
        return (np.maximum(z @ w + b, 0.0) @ v + c) * self.scale[-1] + self.centre[-1]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` (without other columns of these names) with ``prediction``."""
        return packed.with_prediction(df, self.features, self.predict)


@dataclass
class _Search:
    """The search of one model: ``point`` is the best so far, ``trial`` what the next pass looks at."""

    trial: np.ndarray
    point: np.ndarray | None = None
    loss: float = np.inf
    gradient: np.ndarray | None = None
    direction: np.ndarray | None = None
    step: float = 1.0
    moves: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    done: bool = False

    def seen(self, loss: float, gradient: np.ndarray, tolerance: float) -> None:
        if self.point is not None and not loss <= self.loss + 1e-4 * self.step * (self.direction @ self.gradient):
            self.step /= 2
            if self.step < 1e-8:
                self.done = not self.moves
                self.moves = []
                self._aim()
            self.trial = self.point + self.step * self.direction
            return
        if self.point is not None:
            move, bend = self.trial - self.point, gradient - self.gradient
            if move @ bend > 1e-12 * (bend @ bend):
                self.moves = [*self.moves, (move, bend)][-MEMORY:]
        self.point, self.loss, self.gradient = self.trial, loss, gradient
        self.losses.append(loss)
        stalled = len(self.losses) > PATIENCE and self.losses[-PATIENCE - 1] - loss < tolerance * max(loss, tolerance)
        self.done = stalled or not np.abs(gradient).max() > 1e-9
        self._aim()
        self.trial = self.point + self.step * self.direction

    def _aim(self) -> None:
        """Two loops over the remembered moves; without any, a short step down the gradient."""
        q, back = self.gradient.copy(), []
        for s, y in reversed(self.moves):
            a = (s @ q) / (s @ y)
            back.append(a)
            q -= a * y
        if self.moves:
            s, y = self.moves[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.moves, reversed(back)):
            q += s * (a - (y @ q) / (s @ y))
        self.direction = -q
        self.step = 1.0 if self.moves else min(1.0, 1.0 / max(np.linalg.norm(q), 1e-300))


def first_weights(width: int, s: Settings) -> np.ndarray:
    rng = np.random.default_rng(s.seed)
    inner, outer = (6 / (width + s.hidden)) ** 0.5, (6 / (s.hidden + 1)) ** 0.5
    return np.concatenate([rng.uniform(-inner, inner, (width + 1) * s.hidden), rng.uniform(-outer, outer, s.hidden + 1)])


def train(df: DataFrame, features: list[str], sets: list[str], s: Settings = Settings(), label: str = "label") -> list[Perceptron]:
    """A model for each training set, given as conditions on the rows; at most 32 sets."""
    names, width = tuple(features), len(features)
    bits = " + ".join(f"IF({c}, {1 << i}L, 0L)" for i, c in enumerate(sets))
    data = packed.pack(df.selectExpr("*", f"{bits} AS {SETS}"), features, label, SETS)
    parts = data.rdd.getNumPartitions()

    def sums(of: dict[int, Callable[[np.ndarray, np.ndarray], np.ndarray]], shift: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> dict[int, np.ndarray]:
        """For each model the sum of a function of its training rows, whose features ``shift`` has made once for all models."""

        def each(x, y, own) -> dict[int, np.ndarray]:
            out, x = {}, shift(x)
            for m, f in of.items():
                rows = np.flatnonzero(own >> np.uint32(m) & np.uint32(1))
                out[m] = f(x.take(rows, 0), y.take(rows))
            return out

        return packed.totals(data, width, each, parts)

    def moments(power: int, centre: np.ndarray):
        return lambda x, y: np.append(((np.column_stack([x, y]) - centre) ** power).sum(0), len(y))

    def whole(found: dict[int, np.ndarray], m: int) -> np.ndarray:
        t = found.get(m, np.zeros(width + 2))
        return t[:-1] / max(t[-1], 1)

    models = range(len(sets))
    means = sums({m: moments(1, np.zeros(width + 1)) for m in models})
    centre = {m: whole(means, m) for m in models}
    squares = sums({m: moments(2, centre[m]) for m in models})
    rows = {m: squares[m][-1] if m in squares else 0.0 for m in models}
    spread = {m: np.sqrt(whole(squares, m)) for m in models}
    # What is left of rounding in a constant column is no spread.
    scale = {m: np.where(spread[m] > 1e-12 * np.maximum(np.abs(centre[m]), 1e-300), spread[m], np.inf) for m in models}

    searches = {m: _Search(first_weights(width, s)) for m in models}
    weights = (width * s.hidden, (width + 1) * s.hidden, (width + 2) * s.hidden)
    for m, search in searches.items():
        if not rows[m] or not np.isfinite(scale[m][-1]):
            search.point, search.done = np.zeros_like(search.trial), True
            scale[m][-1] = 1.0

    # All models read rows that the first one's centre and scale have shifted; what is left of their own goes into the weights.
    base, unit = (centre[0][:-1], np.where(np.isfinite(scale[0][:-1]), scale[0][:-1], 1.0)) if sets else (np.zeros(width), np.ones(width))

    def at(theta: np.ndarray, c: np.ndarray, by: np.ndarray):
        move, ratio = (c[:-1] - base) / unit, (by[:-1] / unit)[:, None]
        own = theta.copy()
        inner = own[: weights[1]].reshape(width + 1, s.hidden)
        inner[:-1] /= ratio
        inner[-1] -= move @ inner[:-1]

        def f(x, y):
            out = loss_sums(own, x, (y - c[-1]) / by[-1], s.hidden)
            slope = out[1 : 1 + weights[1]].reshape(width + 1, s.hidden)
            slope[:-1] = (slope[:-1] - move[:, None] * slope[-1]) / ratio
            return out

        return f

    for _ in range(s.passes):
        active = [m for m, search in searches.items() if not search.done]
        if not active:
            break
        found = sums({m: at(searches[m].trial, centre[m], scale[m]) for m in active}, lambda x: (x - base) / unit)
        for m in active:
            search, t = searches[m], found[m] / rows[m]
            shrunk = search.trial.copy()
            shrunk[weights[0] : weights[1]] = shrunk[weights[2]] = 0  # no penalty on the constants
            search.seen(t[0] + 0.5 * s.penalty / rows[m] * (shrunk @ shrunk), t[1:] + s.penalty / rows[m] * shrunk, s.tolerance)
    return [Perceptron(names, s.hidden, centre[m], scale[m], searches[m].point if searches[m].point is not None else searches[m].trial) for m in models]
