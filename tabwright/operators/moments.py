"""Per-column moments in two narrow aggregations.

Pass one (``base_stats``) brings back one row: counts, sums and extremes. Pass two sums powers of
the distance from those means. Plain sums compile to small generated code and stay accurate, where
the built-in ``skewness``/``kurtosis``/``corr`` over many columns compile to very large methods.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.missing import double_sql, literal_sql


@dataclass(frozen=True)
class Base:
    """Count of present values, mean and extremes of one numeric column (None when all missing)."""

    n: int
    mean: float | None
    low: float | None
    high: float | None

    @property
    def constant(self) -> bool:
        return self.low == self.high


@dataclass(frozen=True)
class BaseStats:
    rows: int
    columns: dict[str, Base]

    def __getitem__(self, name: str) -> Base:
        return self.columns[name]


def base_stats(df: DataFrame, names: list[str]) -> BaseStats:
    """One aggregation for all columns; the single result row is the only thing collected."""
    aggs = ["count(1) AS rows"]
    for i, name in enumerate(names):
        x = double_sql(df, name)
        aggs += [f"count({x}) AS n{i}", f"sum({x}) AS s{i}", f"min({x}) AS lo{i}", f"max({x}) AS hi{i}"]
    row = aggregate(df, aggs).first()
    cols = {}
    for i, name in enumerate(names):
        n = row[f"n{i}"]
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        mean = None if not n else (lo if lo == hi else row[f"s{i}"] / n)
        cols[name] = Base(n, mean, lo, hi)
    return BaseStats(row["rows"], cols)


def aggregate(df: DataFrame, expressions: list[str]) -> DataFrame:
    """One global aggregation given as SQL texts."""
    return df.agg(*[F.expr(e) for e in expressions])


def inline_rows(aggregated: DataFrame, structs: list[str]) -> DataFrame:
    """One row per ``named_struct`` text from a one-row aggregate, without a shuffle."""
    return aggregated.selectExpr(f"inline(array({', '.join(structs)}))")


def centred_sql(df: DataFrame, name: str, base: Base) -> str:
    return f"({double_sql(df, name)} - {literal_sql(float(base.mean or 0.0))})"


def power_sums(df: DataFrame, name: str, base: Base, tag: str, powers=(2, 3, 4)) -> list[str]:
    """Aggregates ``m{p}_{tag}``: sums of the p-th power of the centred value."""
    d = centred_sql(df, name, base)
    return [f"sum({' * '.join([d] * p)}) AS m{p}_{tag}" for p in powers]


def sample_std(m2: str, base: Base) -> str:
    if base.n < 2:
        return "CAST(NULL AS DOUBLE)"
    return "0.0D" if base.constant else f"sqrt({m2} / {literal_sql(float(base.n - 1))})"


def population_std(m2: str, base: Base) -> str:
    if base.n < 1:
        return "CAST(NULL AS DOUBLE)"
    return "0.0D" if base.constant else f"sqrt({m2} / {literal_sql(float(base.n))})"


def adjusted_skewness(m2: str, m3: str, base: Base) -> str:
    """Sample-adjusted skewness; 0 for a constant column, NULL under three values."""
    n = float(base.n)
    if n <= 2:
        return "CAST(NULL AS DOUBLE)"
    if base.constant:
        return "0.0D"
    scale = literal_sql((n * (n - 1)) ** 0.5 / (n - 2))
    return f"(try_divide({m3} / {n!r}D, pow({m2} / {n!r}D, 1.5D)) * {scale})"


def adjusted_kurtosis(m2: str, m4: str, base: Base) -> str:
    """Sample-adjusted excess kurtosis; 0 for a constant column, NULL under four values."""
    n = float(base.n)
    if n <= 3:
        return "CAST(NULL AS DOUBLE)"
    if base.constant:
        return "0.0D"
    g2 = f"(try_divide({m4} / {n!r}D, ({m2} / {n!r}D) * ({m2} / {n!r}D)) - 3.0D)"
    return f"(({g2} * {literal_sql(n + 1)} + 6.0D) * {literal_sql((n - 1) / ((n - 2) * (n - 3)))})"
