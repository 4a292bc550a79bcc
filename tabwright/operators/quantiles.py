"""Exact order statistics and quantiles without sorting the table or gathering a column.

The built-in exact ``percentile`` merges every distinct value of a column in one task. Here each
wanted rank is first bracketed between two values estimated from a sample, then the rows below,
on and between the bracket are *counted*. The counts prove or refute the bracket, so the sample
decides only the speed. Brackets shrink until the few values inside one can be ranked. The driver
sees counts and bounds only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.kinds import quoted
from ..functions.missing import double_sql, literal_sql
from .moments import BaseStats, aggregate, base_stats

SKETCH_ACCURACY = 10_000
RANKABLE = 1_000_000
MIN_SAMPLE = 50_000
MAX_SAMPLE = 10_000_000
TARGETS_PER_JOB = 40
MAX_ROUNDS = 200


@dataclass
class _Target:
    """Two neighbouring 1-based ranks of one column and the bracket [lo, hi] around them."""

    column: str
    first: int
    last: int
    lo: float | int
    hi: float | int
    under: int = 0  # rows known to lie below lo
    inside: int = 0  # rows in [lo, hi]
    found: dict[int, float | int] = field(default_factory=dict)

    @property
    def done(self) -> bool:
        return self.first in self.found and self.last in self.found


def _batches(items: list, size: int):
    for i in range(0, len(items), size):
        yield items[i : i + size]


def _narrow(df: DataFrame, targets: list[_Target], turn: int) -> list[tuple]:
    """Propose a tighter bracket per target from a sample of the rows inside the current one."""
    largest = max(t.inside for t in targets)
    size = min(MAX_SAMPLE, max(MIN_SAMPLE, largest // 50))
    fraction = min(1.0, size / largest)
    fraction = fraction if fraction <= 0.5 else 1.0
    source = _only_open(df, targets, turn)
    source = source if fraction == 1.0 else source.sample(fraction=fraction, seed=11 + turn)
    aggs, spans = [], []
    for i, t in enumerate(targets):
        m = max(t.inside * fraction, 1.0)
        p0, p1 = (t.first - t.under - 0.5) / t.inside, (t.last - t.under - 0.5) / t.inside
        noise = 0.0 if fraction == 1.0 else 4.5 * math.sqrt(max(p0 * (1 - p0), 1.0 / m) / m)
        slack = noise + 2.0 / SKETCH_ACCURACY + 2.0 / m
        spans.append((max(0.0, p0 - slack), min(1.0, p1 + slack)))
        # The sketch works in DOUBLE: integers enter as distances from the bracket to stay exact.
        value = f"CAST({quoted(t.column)} {_shift_sql(t)} AS DOUBLE)"
        within = f"CASE WHEN {_inside_sql(t)} THEN {value} END"
        aggs.append(f"percentile_approx({within}, array({spans[-1][0]!r}D, {spans[-1][1]!r}D), {SKETCH_ACCURACY}) AS b{i}")
    row = aggregate(source, aggs).first()
    proposals = []
    for i, t in enumerate(targets):
        lo, hi = row[f"b{i}"] or (None, None)
        if lo is None:
            lo, hi = t.lo, t.hi
        elif isinstance(t.lo, int):
            start = t.lo if _shift_sql(t) else 0
            lo, hi = start + int(lo), start + int(hi)
        lo = t.lo if spans[i][0] <= 0 else min(max(lo, t.lo), t.hi)
        hi = t.hi if spans[i][1] >= 1 else max(min(hi, t.hi), lo)
        proposals.append((lo, hi))
    return proposals


def _shift_sql(t: _Target) -> str:
    """Subtraction of the bracket start, where it cannot overflow."""
    return f"- {literal_sql(t.lo)}" if isinstance(t.lo, int) and t.hi - t.lo < 2**62 else ""


def _halves(targets: list[_Target]) -> list[tuple]:
    """Cut brackets in the middle: slower than a sample, but certain to shrink them."""
    return [(t.lo, (t.lo + t.hi) // 2 if isinstance(t.lo, int) else t.lo + (t.hi - t.lo) / 2) for t in targets]


def _inside_sql(t: _Target) -> str:
    return f"({quoted(t.column)} BETWEEN {literal_sql(t.lo)} AND {literal_sql(t.hi)})"


def _only_open(df: DataFrame, targets: list[_Target], turn: int) -> DataFrame:
    """After the first round only rows inside a bracket matter: the filter reaches the scan."""
    return df.where(" OR ".join(dict.fromkeys(_inside_sql(t) for t in targets))) if turn else df


def _count(df: DataFrame, targets: list[_Target], proposals: list[tuple], turn: int) -> list[tuple]:
    """Rows (below lo, at lo, strictly inside, at hi) for each proposed bracket, in one aggregation."""
    # Targets in the same bracket share their thresholds: two plain counts per distinct threshold.
    points: dict[tuple, int] = {}
    aggs = []
    for t, ends in zip(targets, proposals):
        for v in ends:
            key = (t.column, t.lo, t.hi, v)
            if key in points:
                continue
            i = points[key] = len(points)
            c = quoted(t.column)
            here = f"{_inside_sql(t)} AND " if turn else ""
            aggs += [f"count_if({here}{c} < {literal_sql(v)}) AS a{i}", f"count_if({here}{c} <= {literal_sql(v)}) AS b{i}"]
    row = aggregate(_only_open(df, targets, turn), aggs).first()
    out = []
    for t, (lo, hi) in zip(targets, proposals):
        i, j = points[(t.column, t.lo, t.hi, lo)], points[(t.column, t.lo, t.hi, hi)]
        between = 0 if lo == hi else row[f"a{j}"] - row[f"b{i}"]
        at_hi = 0 if lo == hi else row[f"b{j}"] - row[f"a{j}"]
        out.append((t.under + row[f"a{i}"], row[f"b{i}"] - row[f"a{i}"], between, at_hi))
    return out


def _settle(t: _Target, lo, hi, counts: tuple):
    """Resolve ranks that fall on a bracket end and keep the part of the bracket still open.

    Returns a value that separates the two open ranks, if they lie on different sides of it.
    """
    below, at_lo, between, at_hi = counts
    upto_lo = below + at_lo
    upto_mid = upto_lo + between
    upto_hi = upto_mid + at_hi
    for r in (t.first, t.last):
        if below < r <= upto_lo:
            t.found[r] = lo
        elif upto_mid < r <= upto_hi:
            t.found[r] = hi
    if t.done:
        return None
    pending = [r for r in (t.first, t.last) if r not in t.found]
    a, b = pending[0], pending[-1]
    end = t.under + t.inside
    if b <= below:
        t.hi, t.inside = lo, upto_lo - t.under
    elif a > upto_hi:
        t.lo, t.under = hi, upto_hi - (at_lo if lo == hi else at_hi)
        t.inside = end - t.under
    elif a > upto_lo and b <= upto_mid:
        t.lo, t.hi, t.under, t.inside = lo, hi, below, upto_hi - below
    else:
        return lo if a <= below else hi
    return None


def _beside(df: DataFrame, t: _Target, value) -> None:
    """The neighbours of a value that no row holds: the last rank below it, the first above it."""
    c, v = quoted(t.column), literal_sql(value)
    row = aggregate(df, [f"max(CASE WHEN {c} < {v} THEN {c} END) AS a", f"min(CASE WHEN {c} > {v} THEN {c} END) AS b"]).first()
    t.found.setdefault(t.first, row["a"])
    t.found.setdefault(t.last, row["b"])


def _rank_interior(df: DataFrame, targets: list[_Target], bounds: dict[int, tuple]) -> None:
    """Rank the counted, bounded set of values strictly inside each bracket."""
    tagged, keep = [], []
    for i, t in enumerate(targets):
        lo, hi, _ = bounds[i]
        c = quoted(t.column)
        hit = f"({c} > {literal_sql(lo)} AND {c} < {literal_sql(hi)})"
        whole, real = (c, "CAST(NULL AS DOUBLE)") if isinstance(lo, int) else ("CAST(NULL AS BIGINT)", c)
        keep.append(hit)
        tagged.append(f"CASE WHEN {hit} THEN named_struct('t', {i}, 'whole', {whole}, 'real', {real}) END")
    values = (
        df.where(" OR ".join(keep))
        .selectExpr(f"explode(array_compact(array({', '.join(tagged)}))) AS v")
        .groupBy("v.t", "v.whole", "v.real")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy("t").orderBy("whole", "real").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.withColumn("upto", F.sum("n").over(order))
    wanted = []
    for i, t in enumerate(targets):
        base = bounds[i][2]
        wanted.append(f"(t = {i} AND upto >= {t.first - base} AND upto - n < {t.last - base})")
    for row in ranked.where(" OR ".join(wanted)).collect():
        t, base = targets[row["t"]], bounds[row["t"]][2]
        value = row["whole"] if row["whole"] is not None else row["real"]
        for r in (t.first, t.last):
            if row["upto"] - row["n"] < r - base <= row["upto"]:
                t.found[r] = value


def _solve(df: DataFrame, targets: list[_Target]) -> None:
    for t in targets:
        if t.lo == t.hi:
            t.found = {t.first: t.lo, t.last: t.lo}
    stalled = False
    for turn in range(MAX_ROUNDS):
        pending = [t for t in targets if not t.done]
        if not pending:
            return
        open_before = sum(t.inside for t in pending)
        ready: list[tuple[_Target, tuple]] = []
        for group in _batches(pending, TARGETS_PER_JOB):
            proposals = _halves(group) if stalled else _narrow(df, group, turn)
            for t, (lo, hi), counts in zip(group, proposals, _count(df, group, proposals, turn)):
                split = _settle(t, lo, hi, counts)
                if split is not None:
                    _beside(df, t, split)
                if not t.done and (t.lo, t.hi) == (lo, hi) and counts[2] <= RANKABLE:
                    ready.append((t, (lo, hi, counts[0] + counts[1])))
        for group in _batches(ready, TARGETS_PER_JOB):
            _rank_interior(df, [t for t, _ in group], {i: b for i, (_, b) in enumerate(group)})
        still = [t for t in pending if not t.done]
        stalled = bool(still) and len(still) == len(pending) and sum(t.inside for t in still) >= open_before
    raise RuntimeError("order statistics did not converge")


def order_statistics(
    df: DataFrame, wanted: dict[str, list[int]], bounds: dict[str, tuple], counts: dict[str, int]
) -> dict[str, dict[int, float | int]]:
    """Values at the given 1-based ranks among the present values of each column.

    ``df`` holds BIGINT or DOUBLE columns without NaN; ``bounds`` are their (min, max).
    """
    targets = [
        _Target(c, r, r, bounds[c][0], bounds[c][1], 0, counts[c]) for c, ranks in wanted.items() for r in ranks if counts[c]
    ]
    _solve(df, targets)
    out: dict[str, dict[int, float | int]] = {c: {} for c in wanted}
    for t in targets:
        out[t.column][t.first] = t.found[t.first]
    return out


def quantiles(
    df: DataFrame,
    wanted: dict[str, list[float]],
    base: BaseStats | None = None,
    exact: bool = True,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation between neighbours, as pandas computes them.

    ``exact=False`` takes one ``percentile_approx`` pass instead (rank error under 1/10,000).
    """
    names = list(wanted)
    if not names:
        return {}
    narrow = df.selectExpr(*[f"{double_sql(df, n)} AS {quoted(n)}" for n in names])
    if not exact:
        aggs = [
            f"percentile_approx({quoted(n)}, array({', '.join(repr(float(p)) for p in wanted[n])}), {SKETCH_ACCURACY}) AS q{i}"
            for i, n in enumerate(names)
        ]
        row = aggregate(narrow, aggs).first()
        return {n: list(row[f"q{i}"] or [None] * len(wanted[n])) for i, n in enumerate(names)}
    base = base or base_stats(df, names)
    targets: dict[tuple[str, float], _Target] = {}
    for n in names:
        b = base[n]
        if not b.n:
            continue
        for p in wanted[n]:
            h = (b.n - 1) * p
            targets[(n, p)] = _Target(n, math.floor(h) + 1, math.ceil(h) + 1, b.low, b.high, 0, b.n)
    _solve(narrow, list(targets.values()))
    out: dict[str, list[float | None]] = {}
    for n in names:
        values = []
        for p in wanted[n]:
            t = targets.get((n, p))
            if t is None:
                values.append(None)
                continue
            a, b = t.found[t.first], t.found[t.last]
            h = (base[n].n - 1) * p
            values.append(a if a == b else a + (b - a) * (h - math.floor(h)))
        out[n] = values
    return out


def quantile_rows(df: DataFrame, names: list[str], probabilities: list[float], exact: bool = True) -> DataFrame:
    """One row per column and probability: ``(column, probability, value)``."""
    found = quantiles(df, {n: probabilities for n in names}, exact=exact)
    rows = [(n, float(p), v) for n in names for p, v in zip(probabilities, found[n])]
    return df.sparkSession.createDataFrame(rows, "column string, probability double, value double")
