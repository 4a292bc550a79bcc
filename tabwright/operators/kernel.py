"""Support vector machines with an RBF kernel by random Fourier features, for classes (hinge loss) and numbers (Huber loss).

Random cosine features, whose inner product approximates exp(-gamma * |x - y|^2), stand before a linear model. They are
computed from packed blocks (see ``packed``) in every pass and never stored: a pass makes them once for the models of all
classes and training sets, which look at their trial points together (see ``search``). Sums of a task are as large as
features times models, nothing grows with the rows.

The losses, penalties and scales are those of the library's linear machine and its linear regression: features are centred and scaled by
their deviation in each model's own rows; the penalty is on coefficients of the unscaled features for classes, of the scaled ones for numbers.
More than two classes are one machine each against all others, and the largest margin wins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame

from . import packed, search

SETS = "__sets"
#: Rows whose features are computed at once.
SLICE = 1 << 10
#: Residuals beyond this many scales count linearly.
EPSILON = 1.35


@dataclass(frozen=True)
class Settings:
    fourier: int = 64
    steps: int = 100
    tolerance: float = 1e-3
    seed: int = 42
    rows: int = 1  # the penalty is one over it
    spread: float = 0.0  # variance over all feature cells

    def train(self, df: DataFrame, features: list[str], sets: list[str], classes: int) -> list[Machine]:
        return train(df, features, sets, classes, self)

    def sized(self, facts) -> Settings:
        return replace(self, fourier=facts.fourier, rows=facts.rows, spread=facts.spread)


@dataclass
class Cosines:
    """The random features of a row."""

    weights: np.ndarray  # (columns, features)
    shifts: np.ndarray

    @classmethod
    def drawn(cls, width: int, s: Settings) -> Cosines:
        gamma = 1.0 / (width * s.spread) if s.spread > 0 else 1.0
        rng = np.random.default_rng(s.seed)
        weights = rng.normal(scale=math.sqrt(2 * gamma), size=(s.fourier, width))
        return cls(np.ascontiguousarray(weights.T), rng.uniform(0, 2 * math.pi, s.fourier))

    def of(self, x: np.ndarray) -> np.ndarray:
        out = x @ self.weights
        out += self.shifts
        np.cos(out, out=out)
        out *= math.sqrt(2.0 / len(self.shifts))
        return out


@dataclass
class Machine:
    features: tuple[str, ...]
    classes: int  # 0: regression
    cosines: Cosines
    coefficients: np.ndarray  # (features, outputs)
    constants: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for at in range(0, len(x), SLICE):
            m = self.cosines.of(x[at : at + SLICE]) @ self.coefficients + self.constants
            out[at : at + SLICE] = m.argmax(1) if m.shape[1] > 1 else m[:, 0] > 0 if self.classes else m[:, 0]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` (without other columns of these names) with ``prediction``."""
        return packed.with_prediction(df, self.features, self.predict)


def hinge(margins: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Losses and their slopes by margin; sides are 1 and -1."""
    loss = 1 - side * margins
    return np.maximum(loss, 0), np.where(loss > 0, -side, 0.0)


def huber(margins: np.ndarray, y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Losses and their slopes by margin and by scale."""
    e = (y - margins) / scale
    near = np.abs(e) <= EPSILON
    loss = 0.5 * scale * np.where(near, 1 + e * e, 1 + 2 * EPSILON * np.abs(e) - EPSILON**2)
    return loss, np.where(near, -e, -EPSILON * np.sign(e)), 0.5 * np.where(near, 1 - e * e, 1 - EPSILON**2)


def train(df: DataFrame, features: list[str], sets: list[str], classes: int, s: Settings, label: str = "label") -> list[Machine]:
    """A model for each training set, given as conditions on the rows; at most 32 sets. Feature values must be present."""
    names, width, outputs = tuple(features), len(features), classes if classes > 2 else 1
    bits = " + ".join(f"IF({c}, {1 << i}L, 0L)" for i, c in enumerate(sets))
    data = packed.pack(df.selectExpr("*", f"{bits} AS {SETS}"), features, label, SETS)
    cosines, n = Cosines.drawn(width, s), s.fourier
    models = [m for m in range(len(sets)) for _ in range(outputs)]  # the training set of each machine

    def slices(x: np.ndarray, y: np.ndarray, own: np.ndarray):
        for at in range(0, len(x), SLICE):
            yield cosines.of(x[at : at + SLICE]), y[at : at + SLICE], own[at : at + SLICE]

    def inside(own: np.ndarray, of: list[int]) -> np.ndarray:
        return (own[:, None] >> np.array(of, np.uint32) & np.uint32(1)).astype(np.float64)

    def moments(x, y, own) -> dict[int, np.ndarray]:
        total = np.zeros((2 * n + 1, len(sets)))
        for z, _, bits in slices(x, y, own):
            total += np.column_stack([z, z * z, np.ones(len(z))]).T @ inside(bits, range(len(sets)))
        return {0: total.ravel()}

    found = packed.totals(data, width, moments).get(0, np.zeros((2 * n + 1) * len(sets))).reshape(2 * n + 1, len(sets)).T
    rows = found[:, -1]
    if not rows.all():
        raise ValueError("a training set without rows")
    mean = found[:, :n] / rows[:, None]
    spread = np.sqrt(np.maximum(found[:, n : 2 * n] - rows[:, None] * mean**2, 0) / np.maximum(rows[:, None] - 1, 1))
    # What is left of rounding in a constant feature is no spread.
    inverse = np.where(spread > 1e-7 * math.sqrt(2.0 / n), 1 / np.maximum(spread, 1e-300), 0.0)

    def unscaled(k: int, theta: np.ndarray) -> tuple[np.ndarray, float]:
        w = theta[:n] * inverse[models[k]]
        return w, theta[n] - w @ mean[models[k]]

    def look(points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        at = list(points)
        w, c = (np.array(v) for v in zip(*(unscaled(k, points[k]) for k in at)))
        of, scales = [models[k] for k in at], np.array([points[k][-1] for k in at])
        kinds = np.array([k % outputs for k in at]) if outputs > 1 else np.ones(len(at))
        safe = np.where(scales > 0, scales, 1.0)  # what lies outside counts as infinite below

        def losses(x, y, own) -> dict[int, np.ndarray]:
            total = np.zeros((n + 3, len(at)))
            for z, label, bits in slices(x, y, own):
                margins, mine = z @ w.T + c, inside(bits, of)
                if classes:
                    loss, slope = hinge(margins, np.where(label[:, None] == kinds, 1.0, -1.0))
                    last = 0.0
                else:
                    loss, slope, last = huber(margins, label[:, None], safe)
                    last = (last * mine).sum(0)
                slope *= mine
                total[:n] += z.T @ slope
                total[n:] += np.stack([slope.sum(0), (loss * mine).sum(0), np.zeros(len(at)) + last])
            return {0: total.ravel()}

        sums = packed.totals(data, width, losses)[0].reshape(n + 3, len(at)).T
        out = {}
        for i, k in enumerate(at):
            g = sums[i] / rows[models[k]]
            theta, by = points[k], inverse[models[k]]
            weight = theta[:n] / s.rows * (by**2 if classes else 1.0)
            gradient = (g[:n] - g[n] * mean[models[k]]) * by + weight
            value = g[n + 1] + 0.5 * (theta[:n] @ weight)
            out[k] = (value, np.r_[gradient, g[n]]) if classes else (value if theta[-1] > 0 else math.inf, np.r_[gradient, g[n], g[n + 2]])
        return out

    if classes:
        searches = {k: search.orthants(np.zeros(n + 1), s.steps, s.tolerance) for k in range(len(models))}
    else:
        searches = {k: search.lbfgs(np.r_[np.ones(n), 1 + (mean[m] * inverse[m]).sum(), 1.0], s.steps, s.tolerance, unit=True, most=64) for k, m in enumerate(models)}
    ended = search.together(searches, look)
    pairs = [unscaled(k, ended[k]) for k in range(len(models))]
    group = lambda m: pairs[m * outputs : (m + 1) * outputs]
    return [Machine(names, classes, cosines, np.column_stack([w for w, _ in group(m)]), np.array([c for _, c in group(m)])) for m in range(len(sets))]
