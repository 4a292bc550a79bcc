"""Row filters and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.kinds import col, require_columns
from ..functions.missing import double_sql, missing_sql, present
from ..functions.scalars import finite
from .frequencies import value_counts
from .moments import aggregate


def search_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows where any column, read as text, contains the search text; case is ignored."""
    atomic = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    if not atomic:
        return df.where(F.lit(False))
    needle = F.lower(F.lit(text))
    hits = [F.coalesce(F.contains(F.lower(col(c).cast("string")), needle), F.lit(False)) for c in atomic]
    return df.where(reduce(lambda a, b: a | b, hits))


def complete_cases(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows without NULL or NaN in any of the named columns."""
    require_columns(df, names)
    return df.where(" AND ".join(f"NOT {missing_sql(df, n)}" for n in names)) if names else df


def finite_rows(df: DataFrame, names: list[str]) -> DataFrame:
    require_columns(df, names)
    return df.where(reduce(lambda a, b: a & b, [finite(col(n).cast("double")) for n in names]))


def all_positive(df: DataFrame, names: list[str]) -> dict[str, bool]:
    """Per column: every value is above zero; a missing value counts against it."""
    if not names:
        return {}
    row = aggregate(df, [f"bool_and(coalesce({double_sql(df, n)} > 0, false)) AS p{i}" for i, n in enumerate(names)]).first()
    return {n: bool(row[f"p{i}"]) if row[f"p{i}"] is not None else True for i, n in enumerate(names)}


def rows_of_top_groups(df: DataFrame, name: str, k: int = 10) -> DataFrame:
    """Rows of the k most frequent groups; the k values become a pushed-down IN filter."""
    groups = [r["value"] for r in value_counts(df, name, k).select("value").collect()]
    return df.where(present(df, name).isin(groups)) if groups else df.where(F.lit(False))
