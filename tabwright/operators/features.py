"""Feature engineering as fitted plans (see ``clean`` for the fit/transform split)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.kinds import categorical_columns, col, datetime_columns, numeric_columns
from ..functions.missing import as_double
from .clean import DropColumns, FillMissing, Plan, fit_impute_numeric
from .correlation import collect_pairs
from .filters import all_positive
from .frequencies import freq_table, top_values
from .moments import aggregate, base_stats, power_sums
from .ordering import with_position

INLINE_LABELS = 64
BROADCAST_BYTES = 64 << 20
MISSING_LABEL = "nan"


@dataclass(frozen=True)
class LabelEncode(Plan):
    """Text to the rank of its value, from 0; missing is the label 'nan'.

    Few labels become a CASE lookup, more a broadcast table of checked size, very many a shuffled
    join whose ranks were computed by a distributed sort.
    """

    inline: tuple[tuple[str, tuple[str, ...]], ...] = ()
    tables: tuple[tuple[str, DataFrame, bool], ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        order = df.columns
        fixed = {}
        for name, labels in self.inline:
            found = F.array_position(F.array(*[F.lit(v) for v in labels]), F.coalesce(col(name), F.lit(MISSING_LABEL)))
            fixed[name] = F.when(found > 0, found - 1).cast("int")
        df = df.withColumns(fixed) if fixed else df
        for i, (name, table, small) in enumerate(self.tables):
            side = table.select(F.col("label").alias(f"__label{i}"), F.col("code").alias(f"__code{i}"))
            key = F.coalesce(col(name), F.lit(MISSING_LABEL)) == F.col(f"__label{i}")
            joined = df.join(F.broadcast(side) if small else side, key, "left")
            df = joined.withColumn(name, F.col(f"__code{i}").cast("int")).drop(f"__label{i}", f"__code{i}")
        return df.select(*[col(c) for c in order])


@dataclass(frozen=True)
class OneHot(Plan):
    """0/1 columns for all levels but the first; missing is all zeros; the source is dropped."""

    levels: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        for name, values in self.levels:
            new = {f"{name}_{v}": F.when(col(name) == F.lit(v), 1).otherwise(0) for v in values[1:]}
            df = (df.withColumns(new) if new else df).drop(name)
        return df


@dataclass(frozen=True)
class Products(Plan):
    pairs: tuple[tuple[str, str], ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        new = {f"{a}_x_{b}": as_double(df, a) * as_double(df, b) for a, b in self.pairs}
        return df.withColumns(new) if new else df


@dataclass(frozen=True)
class DateParts(Plan):
    columns: tuple[str, ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        for c in self.columns:
            # weekday counts from Monday = 0.
            df = df.withColumns({f"{c}_year": F.year(col(c)), f"{c}_month": F.month(col(c)), f"{c}_dayofweek": F.weekday(col(c))}).drop(c)
        return df


@dataclass(frozen=True)
class LogColumns(Plan):
    columns: tuple[str, ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        new = {f"{c}_log": F.log1p(as_double(df, c)) for c in self.columns}
        return df.withColumns(new) if new else df


@dataclass(frozen=True)
class StandardScale(Plan):
    """(x - mean) / population deviation; a constant column is divided by 1."""

    stats: tuple[tuple[str, float, float], ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        new = {n: (as_double(df, n) - F.lit(mean)) / F.lit(std or 1.0) for n, mean, std in self.stats}
        return df.withColumns(new) if new else df


def _labels(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.coalesce(col(name), F.lit(MISSING_LABEL)).alias("label")).distinct()


def fit_label_encode(df: DataFrame, names: list[str] | None = None) -> LabelEncode:
    names = categorical_columns(df) if names is None else names
    if not names:
        return LabelEncode()
    filled = df.select(*[F.coalesce(col(n), F.lit(MISSING_LABEL)).alias(n) for n in names])
    freq = freq_table(filled, names)
    # At most INLINE_LABELS + 1 rows per column reach the driver.
    ordered = Window.partitionBy("column").orderBy("value")
    few = freq.withColumn("r", F.row_number().over(ordered)).where(F.col("r") <= INLINE_LABELS + 1).select("column", "value").collect()
    seen: dict[str, list[str]] = {n: [] for n in names}
    for row in few:
        seen[row["column"]].append(row["value"])
    inline, tables, entries = [], [], []
    for n in names:
        if len(seen[n]) <= INLINE_LABELS:
            inline.append((n, tuple(sorted(seen[n], key=lambda v: v.encode()))))
            entries.append(("label_encode", n, "classes", float(len(seen[n])), None))
            continue
        ranked = with_position(_labels(df, n), ["label"], "code")
        size = ranked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("label")).alias("bytes")).first()
        classes = size["n"]
        tables.append((n, ranked, (size["bytes"] or 0) + 16 * classes <= BROADCAST_BYTES))
        entries.append(("label_encode", n, "classes", float(classes), None))
    return LabelEncode(tuple(inline), tuple(tables), entries=tuple(entries))


def fit_one_hot(df: DataFrame, max_cardinality: int = 20, names: list[str] | None = None) -> list[Plan]:
    """One-hot for columns with few levels, label codes for the rest."""
    names = categorical_columns(df) if names is None else names
    if not names:
        return []
    top = top_values(freq_table(df, names), max_cardinality + 1).select("column", "value").collect()
    found: dict[str, list[str]] = {n: [] for n in names}
    for row in top:
        found[row["column"]].append(row["value"])
    levels = [(n, tuple(sorted(found[n], key=lambda v: v.encode()))) for n in names if len(found[n]) <= max_cardinality]
    many = [n for n in names if len(found[n]) > max_cardinality]
    entries = tuple(("one_hot", n, "columns", float(max(len(v) - 1, 0)), None) for n, v in levels)
    plans: list[Plan] = [fit_label_encode(df, many)] if many else []
    return plans + ([OneHot(tuple(levels), entries=entries)] if levels else [])


def fit_encode(df: DataFrame, method: str = "label", max_cardinality: int = 20) -> list[Plan]:
    return fit_one_hot(df, max_cardinality) if method == "onehot" else [fit_label_encode(df)]


def fit_interactions(df: DataFrame, top_n: int = 3, exclude: list[str] = ()) -> Products:
    """Products of the most correlated numeric pairs, ties in column order."""
    names = [c for c in numeric_columns(df) if c not in exclude]
    pairs = sorted(collect_pairs(df, names), key=lambda p: -abs(p[2]))[:top_n]
    return Products(tuple((a, b) for a, b, _ in pairs), entries=tuple(("interactions", f"{a}_x_{b}", "r", abs(r), None) for a, b, r in pairs))


def fit_date_features(df: DataFrame) -> DateParts:
    names = datetime_columns(df)
    return DateParts(tuple(names), entries=tuple(("date_features", c, "parts", 3.0, None) for c in names))


def skewness_of(df: DataFrame, names: list[str]) -> dict[str, float | None]:
    """Adjusted skewness per column, on the driver."""
    if not names:
        return {}
    base = base_stats(df, names)
    row = aggregate(df, [s for i, n in enumerate(names) for s in power_sums(df, n, base[n], str(i), powers=(2, 3))]).first()
    out = {}
    for i, name in enumerate(names):
        b = base[name]
        if b.n <= 2:
            out[name] = None
        elif b.constant:
            out[name] = 0.0
        else:
            n, m2, m3 = b.n, row[f"m2_{i}"] / b.n, row[f"m3_{i}"] / b.n
            out[name] = (n * (n - 1)) ** 0.5 / (n - 2) * m3 / m2**1.5 if m2 else 0.0
    return out


def fit_log_transform(df: DataFrame, columns: list[str] | None = None, exclude: list[str] = (), always: bool = False) -> LogColumns:
    """log1p of strongly skewed (> 2), all-positive columns; named columns only need the sign.

    ``always``: named columns whatever their signs, so that the result's columns don't depend on the rows; missing
    values, and those up to -1, have no logarithm.
    """
    if columns is None:
        skew = skewness_of(df, [c for c in numeric_columns(df) if c not in exclude])
        columns = [c for c, s in skew.items() if s is not None and s > 2]
    columns = [c for c in columns if c in df.columns]
    positive = {} if always else all_positive(df, columns)
    chosen = tuple(c for c in columns if always or positive[c])
    return LogColumns(chosen, entries=tuple(("log_transform", f"{c}_log", "created", 1.0, None) for c in chosen))


def fit_drop_low_variance(df: DataFrame, threshold: float = 0.01, exclude: list[str] = ()) -> DropColumns:
    """Numeric columns whose sample variance is strictly below the threshold."""
    names = [c for c in numeric_columns(df) if c not in exclude]
    if not names:
        return DropColumns()
    base = base_stats(df, names)
    row = aggregate(df, [s for i, n in enumerate(names) for s in power_sums(df, n, base[n], str(i), powers=(2,))]).first()
    gone, entries = [], []
    for i, n in enumerate(names):
        if base[n].n < 2:
            continue
        variance = 0.0 if base[n].constant else row[f"m2_{i}"] / (base[n].n - 1)
        if variance < threshold:
            gone.append(n)
            entries.append(("drop_low_variance", n, "variance", variance, None))
    return DropColumns(tuple(gone), entries=tuple(entries))


def fit_drop_high_correlation(df: DataFrame, threshold: float = 0.95, exclude: list[str] = ()) -> DropColumns:
    """The later column of every pair above the threshold; a dropped column still drops others."""
    names = [c for c in numeric_columns(df) if c not in exclude]
    if len(names) < 2:
        return DropColumns()
    strong = [(a, b, r) for a, b, r in collect_pairs(df, names) if abs(r) > threshold]
    gone = {b for _, b, _ in strong}
    return DropColumns(
        tuple(c for c in names if c in gone), entries=tuple(("drop_high_correlation", b, "r", r, a) for a, b, r in strong)
    )


def fit_median_fill(df: DataFrame, exact: bool = True) -> FillMissing:
    return fit_impute_numeric(df, "median", exact)


def fit_standard_scale(df: DataFrame, names: list[str] | None = None) -> StandardScale:
    names = numeric_columns(df) if names is None else names
    if not names:
        return StandardScale()
    base = base_stats(df, names)
    row = aggregate(df, [s for i, n in enumerate(names) for s in power_sums(df, n, base[n], str(i), powers=(2,))]).first()
    stats = []
    for i, n in enumerate(names):
        b = base[n]
        if b.n:
            stats.append((n, b.mean, 0.0 if b.constant else (row[f"m2_{i}"] / b.n) ** 0.5))
    return StandardScale(tuple(stats))


def zero_fill(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    names = numeric_columns(df) if names is None else names
    return df.withColumns({n: F.coalesce(as_double(df, n), F.lit(0.0)) for n in names}) if names else df


def append_columns(df: DataFrame, new: dict) -> DataFrame:
    """Add computed columns to the same rows; no join is needed."""
    return df.withColumns(new)
