"""Quasi-Newton searches that ask for a function instead of calling it, so that those of many models share passes over the rows.

A search is a generator: it yields the point it wants to know about, is sent (value, gradient), and returns the point it ends at.
Both follow the optimizers behind the library's learners (Breeze), so that equal sums take equal steps: limited memory, relative
tolerance over the last 20 values, and a second try without memory after a failed line search. ``lbfgs`` looks for steps
by cubic interpolation under the strong Wolfe conditions, ``orthants`` by backtracking inside the orthant of a point.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator
from functools import partial

import numpy as np

Search = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]
MEMORY, VALUES = 10, 20
ARMIJO, WOLFE = 1e-4, 0.9


class Failed(Exception):
    """No step was found."""


def descent(gradient: np.ndarray, moves: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Two loops over (step, change of the gradient), the latest first."""
    with np.errstate(divide="ignore", invalid="ignore"):  # what is not finite has failed
        return _descent(gradient, moves)


def _descent(gradient: np.ndarray, moves: list) -> np.ndarray:
    q, seen = gradient.copy(), []
    for s, y in moves:
        seen.append((s @ q) / (s @ y))
        q -= seen[-1] * y
    if moves:
        s, y = moves[0]
        if not s @ y >= 0:
            raise Failed
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(reversed(moves), reversed(seen)):
        q += s * (a - (y @ q) / (s @ y))
    if not np.isfinite(q).all():
        raise Failed
    return -q


def _between(l: tuple, r: tuple) -> float:
    """Where the cubic through two (t, value, slope) has its minimum, not too close to either."""
    d1 = l[2] + r[2] - 3 * (l[1] - r[1]) / (l[0] - r[0])
    root = d1 * d1 - l[2] * r[2]
    d2 = math.sqrt(root) if root >= 0 else math.nan
    bottom = r[2] - l[2] + 2 * d2
    t = r[0] - (r[0] - l[0]) * (r[2] + d2 - d1) / bottom if bottom else math.nan
    low, high = l[0] + 0.1 * (r[0] - l[0]), l[0] + 0.9 * (r[0] - l[0])
    return low if t < low else high if t > high else t


def _wolfe(x, value, gradient, direction, first: bool, unit: bool, most: int):
    """Strong Wolfe conditions: outwards by half, then into the bracket."""
    slope = gradient @ direction
    if slope > 0:
        raise Failed
    t, low = (1.0 if unit or not first else 1.0 / np.linalg.norm(direction)), (0.0, value, slope)

    def look(t):
        at = x + t * direction
        f, g = yield at
        return (t, f, g @ direction), at, g

    def zoom(low, high):
        for _ in range(most):
            c, at, g = yield from look(_between(high, low) if low[0] > high[0] else _between(low, high))
            if c[1] > value + ARMIJO * c[0] * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= WOLFE * abs(slope):
                    return c[0], at, c[1], g
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise Failed

    for i in range(most):
        c, at, g = yield from look(t)
        if not math.isfinite(c[1]):  # out of the domain
            t /= 2
            continue
        if c[1] > value + ARMIJO * t * slope or (c[1] >= low[1] and i > 0):
            return (yield from zoom(low, c))
        if abs(c[2]) <= WOLFE * abs(slope):
            return t, at, c[1], g
        if c[2] >= 0:
            return (yield from zoom(c, low))
        low, t = c, t * 1.5
    raise Failed


def _backtrack(x, value, gradient, direction, first: bool):
    """Steps inside the orthant of the point: those that cross a zero end there."""
    side = np.where(x != 0, np.sign(x), np.sign(-gradient))
    slope, shrink = gradient @ direction, 0.1 if first else 0.5
    t = (0.5 / np.linalg.norm(gradient) if first else 1.0) * shrink  # the longest step itself is never tried
    for _ in range(19):
        at = x + t * direction
        at = np.where(np.sign(at) == side, at, 0.0)
        f, g = yield at
        along, tried = g @ direction, t
        if f > value + t * ARMIJO * slope:
            t *= shrink
        elif along < WOLFE * slope:
            t *= 2.1
        elif along > -WOLFE * slope:
            t *= shrink
        else:
            break
        if not 1e-10 <= t <= 1e10:
            raise Failed
    return tried, at, f, g  # the last one is taken as it is: at a kink there may be no better


def _search(x: np.ndarray, steps: int, tolerance: float, line: Callable, aim: Callable, tiny: float) -> Search:
    value, gradient = yield x
    begin, values, moves, done, again = value, [math.inf], [], 0, False
    while done < steps and np.linalg.norm(gradient) > max(tolerance * abs(value), 1e-8):
        if len(values) >= 2 and abs(value - max(values)) <= tolerance * abs(begin):
            break
        try:
            t, at, f, g = yield from line(x, value, gradient, aim(gradient, moves), done == 0)
            if t * np.linalg.norm(gradient) < tiny:
                raise Failed
        except Failed:
            if again:
                break
            again, moves = True, []
            continue
        moves = [(at - x, g - gradient), *moves][:MEMORY]
        x, value, gradient, done, again = at, f, g, done + 1, False
        values = [*values, value][-VALUES:]
    return x


def lbfgs(x: np.ndarray, steps: int, tolerance: float, unit: bool = False, most: int = 10) -> Search:
    """``unit``: the first step is as long as the gradient."""
    return _search(x, steps, tolerance, partial(_wolfe, unit=unit, most=most), descent, 1e-10)


def _inside(gradient: np.ndarray, moves: list) -> np.ndarray:
    d = descent(gradient, moves)
    return np.where(d * gradient < 0, d, 0.0)


def orthants(x: np.ndarray, steps: int, tolerance: float) -> Search:
    return _search(x, steps, tolerance, _backtrack, _inside, 0.0)


def together(searches: dict[int, Search], look: Callable[[dict[int, np.ndarray]], dict[int, tuple[float, np.ndarray]]]) -> dict[int, np.ndarray]:
    """Run searches side by side: every pass looks at one point of each that has not ended."""
    wanted, ended = {k: next(s) for k, s in searches.items()}, {}
    while wanted:
        found = look(wanted)
        for k in list(wanted):
            try:
                wanted[k] = searches[k].send(found[k])
            except StopIteration as e:
                ended[k] = e.value
                del wanted[k]
    return ended
