"""Cleaning steps as fitted plans.

``fit_*`` reads the table and returns a small immutable plan (column lists, fill values, bounds);
``plan.transform(df)`` is a pure lazy projection, so the same plan also cleans later batches or a
streaming DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import scalars
from ..functions.kinds import CATEGORICAL, NUMERIC, categorical_columns, col, kind_of, numeric_columns, quoted
from ..functions.missing import double_sql, literal_sql, missing_sql, present
from .frequencies import column_modes
from .moments import aggregate, base_stats, power_sums
from .profile import missing_counts
from .quantiles import quantiles

REPORT_SCHEMA = "step string, column string, metric string, value double, text string"


@dataclass(frozen=True)
class Plan:
    """A fitted step. ``entries`` are its report rows ``(step, column, metric, value, text)``."""

    entries: tuple = field(default=(), kw_only=True)

    def transform(self, df: DataFrame) -> DataFrame:
        return df

    def report(self, spark) -> DataFrame:
        return spark.createDataFrame(list(self.entries), REPORT_SCHEMA)


@dataclass(frozen=True)
class DropColumns(Plan):
    columns: tuple[str, ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.columns)


@dataclass(frozen=True)
class Deduplicate(Plan):
    def transform(self, df: DataFrame) -> DataFrame:
        return remove_duplicates(df)


@dataclass(frozen=True)
class FillMissing(Plan):
    """Replace missing cells; an integer column filled with a fraction becomes DOUBLE."""

    values: tuple[tuple[str, object], ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        fills = {}
        for name, value in self.values:
            dtype = df.schema[name].dataType
            if kind_of(dtype) == NUMERIC:
                whole = float(value).is_integer() and not isinstance(dtype, (T.FloatType, T.DoubleType))
                target = dtype if whole else T.DoubleType()
                fills[name] = F.coalesce(present(df, name).cast(target), F.lit(value).cast(target))
            else:
                fills[name] = F.coalesce(col(name), F.lit(value).cast(dtype))
        return df.withColumns(fills) if fills else df


@dataclass(frozen=True)
class CapOutliers(Plan):
    """Clamp columns into their bounds; missing stays missing."""

    bounds: tuple[tuple[str, float, float], ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        capped = {n: scalars.clip(present(df, n).cast("double"), lo, hi) for n, lo, hi in self.bounds}
        return df.withColumns(capped) if capped else df


@dataclass(frozen=True)
class NormalizeText(Plan):
    columns: tuple[str, ...] = ()
    lower: bool = True

    def transform(self, df: DataFrame) -> DataFrame:
        fixed = {}
        for name in self.columns:
            c = scalars.strip(col(name))
            fixed[name] = F.lower(c) if self.lower else c
        return df.withColumns(fixed) if fixed else df


@dataclass(frozen=True)
class CastText(Plan):
    """Turn text columns into numbers or timestamps; what does not parse becomes NULL."""

    casts: tuple[tuple[str, str], ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        fixed = {}
        for name, target in self.casts:
            if target == "bigint":
                fixed[name] = F.trim(scalars.strip(col(name))).try_cast("bigint")
            elif target == "double":
                fixed[name] = F.expr(scalars.number_sql(quoted(name)))
            else:
                fixed[name] = F.expr(scalars.datetime_sql(quoted(name)))
        return df.withColumns(fixed) if fixed else df


def remove_duplicates(df: DataFrame) -> DataFrame:
    """One copy of each row. Copies are combined before the shuffle, so a hot row stays cheap."""
    return df.dropDuplicates()


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def fit_drop_missing(df: DataFrame, threshold: float = 0.7) -> DropColumns:
    """Columns whose missing share is strictly above the threshold."""
    rows, missing = missing_counts(df)
    gone = tuple(c for c, m in missing.items() if rows and m / rows > threshold)
    return DropColumns(gone, entries=tuple(("drop_missing", c, "missing_share", missing[c] / rows, None) for c in gone))


def fit_impute_numeric(df: DataFrame, strategy: str = "median", exact: bool = True) -> FillMissing:
    """Median, mean or zero for numeric columns with gaps; an unknown strategy means median."""
    _, missing = missing_counts(df.select(*[col(c) for c in numeric_columns(df)]))
    gaps = [c for c, m in missing.items() if m]
    if strategy == "zero":
        values = {c: 0.0 for c in gaps}
    else:
        base = base_stats(df, gaps)
        if strategy == "mean":
            values = {c: base[c].mean for c in gaps}
        else:
            values = {c: q[0] for c, q in quantiles(df, {c: [0.5] for c in gaps}, base, exact).items()}
    filled = {c: v for c, v in values.items() if v is not None}
    entries = []
    for c, v in filled.items():
        entries += [("impute_numeric", c, "filled", float(missing[c]), None), ("impute_numeric", c, "value", round(v, 4), None)]
    return FillMissing(tuple(filled.items()), entries=tuple(entries))


def fit_impute_categorical(df: DataFrame, strategy: str = "mode", names: list[str] | None = None) -> FillMissing:
    """The most frequent text (ties: smallest), or the word Unknown."""
    names = categorical_columns(df) if names is None else names
    _, missing = missing_counts(df.select(*[col(c) for c in names])) if names else (0, {})
    gaps = [c for c in names if missing[c]]
    modes = column_modes(df, gaps) if strategy == "mode" else {}
    values, entries = [], []
    for c in gaps:
        value = modes.get(c, (None,))[0]
        if value is None and kind_of(df.schema[c].dataType) != CATEGORICAL:
            continue
        value = "Unknown" if value is None else value
        values.append((c, value))
        entries += [("impute_categorical", c, "filled", float(missing[c]), None), ("impute_categorical", c, "value", None, value)]
    return FillMissing(tuple(values), entries=tuple(entries))


def fit_cap_outliers(
    df: DataFrame,
    method: str = "iqr",
    factor: float = 1.5,
    min_present: int = 10,
    positive_iqr_only: bool = False,
    exact: bool = True,
) -> CapOutliers:
    """Bounds from the quartiles (``iqr``) or from mean and deviation (``zscore``)."""
    names = numeric_columns(df)
    base = base_stats(df, names)
    names = [n for n in names if base[n].n >= max(min_present, 1)]
    if not names:
        return CapOutliers()
    limits: dict[str, tuple[float, float]] = {}
    if method == "iqr":
        for n, (q1, q3) in quantiles(df, {n: [0.25, 0.75] for n in names}, base, exact).items():
            iqr = q3 - q1
            if iqr > 0 or not positive_iqr_only:
                limits[n] = (q1 - factor * iqr, q3 + factor * iqr)
    else:
        sums = aggregate(df, [s for i, n in enumerate(names) for s in power_sums(df, n, base[n], str(i), powers=(2,))]).first()
        for i, n in enumerate(names):
            b = base[n]
            if b.n > 1:
                std = (sums[f"m2_{i}"] / (b.n - 1)) ** 0.5
                limits[n] = (b.mean - factor * std, b.mean + factor * std)
    if not limits:
        return CapOutliers()
    aggs = []
    for i, (n, (lo, hi)) in enumerate(limits.items()):
        x = double_sql(df, n)
        aggs += [f"count_if({x} < {literal_sql(lo)}) AS lo{i}", f"count_if({x} > {literal_sql(hi)}) AS hi{i}"]
    row = aggregate(df, aggs).first()
    bounds, entries = [], []
    for i, (n, (lo, hi)) in enumerate(limits.items()):
        below, above = row[f"lo{i}"], row[f"hi{i}"]
        if below + above == 0:
            continue
        bounds.append((n, lo, hi))
        for metric, v in (("below", float(below)), ("above", float(above)), ("lower_bound", round(lo, 4)), ("upper_bound", round(hi, 4))):
            entries.append(("cap_outliers", n, metric, v, None))
    return CapOutliers(tuple(bounds), entries=tuple(entries))


def normalize_text(df: DataFrame, lower: bool = True) -> DataFrame:
    """Strip (and lower-case) every text column; NULL stays NULL."""
    return NormalizeText(tuple(categorical_columns(df)), lower).transform(df)


def fit_drop_constant(df: DataFrame) -> DropColumns:
    """Columns with at most one distinct present value, found with min and max only."""
    orderable = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]
    if not orderable:
        return DropColumns()
    aggs = []
    for i, n in enumerate(orderable):
        x = f"CASE WHEN NOT {missing_sql(df, n)} THEN {quoted(n)} END"
        aggs.append(f"min({x}) <=> max({x}) AS k{i}")
    row = aggregate(df, aggs).first()
    gone = tuple(n for i, n in enumerate(orderable) if row[f"k{i}"])
    return DropColumns(gone, entries=tuple(("drop_constant", c, "dropped", 1.0, None) for c in gone))


def fit_fix_dtypes(df: DataFrame, strict: bool = False) -> CastText:
    """Text columns to cast.

    Majority rule: more than half of the present values parse. Strict rule: all of them do.
    Numbers are tried first, then dates.
    """
    names = categorical_columns(df)
    if not names:
        return CastText()

    def enough(parsed: int, present_n: int) -> bool:
        return parsed == present_n if strict else parsed > 0.5 * present_n

    aggs = []
    for i, n in enumerate(names):
        c = quoted(n)
        aggs += [
            f"count({c}) AS n{i}",
            f"count({scalars.number_sql(c)}) AS num{i}",
            f"count_if({scalars.missing_number_sql(c)}) AS blank{i}",
            f"count_if({scalars.integer_sql(c)}) AS int{i}",
        ]
    row = aggregate(df, aggs).first()
    casts, rest = {}, []
    for i, n in enumerate(names):
        total, numbers, blanks, whole = row[f"n{i}"], row[f"num{i}"], row[f"blank{i}"], row[f"int{i}"]
        if enough(numbers + (blanks if strict else 0), total):
            casts[n] = "bigint" if total and whole == numbers else "double"
        else:
            rest.append((n, total))
    if rest:
        dates = aggregate(df, [f"count({scalars.datetime_sql(quoted(n))}) AS d{i}" for i, (n, _) in enumerate(rest)]).first()
        for i, (n, total) in enumerate(rest):
            if total and enough(dates[f"d{i}"], total):
                casts[n] = "timestamp"
    ordered = tuple((n, casts[n]) for n in names if n in casts)
    label = {"bigint": "numeric", "double": "numeric", "timestamp": "datetime"}
    return CastText(ordered, entries=tuple(("fix_dtypes", n, "cast", None, label[t]) for n, t in ordered))
