"""Column kinds: which columns count as numeric, text, datetime, boolean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC = "numeric"
CATEGORICAL = "categorical"
DATETIME = "datetime"
BOOLEAN = "bool"
OTHER = "other"

_KIND_BY_TYPE = (
    (T.NumericType, NUMERIC),
    (T.StringType, CATEGORICAL),
    (T.VarcharType, CATEGORICAL),
    (T.CharType, CATEGORICAL),
    (T.TimestampType, DATETIME),
    (T.TimestampNTZType, DATETIME),
    (T.DateType, DATETIME),
    (T.BooleanType, BOOLEAN),
)


def kind_of(dtype: T.DataType) -> str:
    """Booleans are never numeric; nested types are ``other`` and skipped by every auto-select."""
    for cls, kind in _KIND_BY_TYPE:
        if isinstance(dtype, cls):
            return kind
    return OTHER


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == kind]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of_kind(df, NUMERIC)


def categorical_columns(df: DataFrame) -> list[str]:
    return columns_of_kind(df, CATEGORICAL)


def datetime_columns(df: DataFrame) -> list[str]:
    return columns_of_kind(df, DATETIME)


def columns_by_kind(df: DataFrame) -> dict[str, list[str]]:
    """The numeric / categorical / datetime column lists of a table."""
    return {k: columns_of_kind(df, k) for k in (NUMERIC, CATEGORICAL, DATETIME)}


def select_kind(df: DataFrame, kind: str) -> DataFrame:
    return df.select(*[col(c) for c in columns_of_kind(df, kind)])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by exact name, safe for dots and backticks."""
    return F.col(quoted(name))


def require_columns(df: DataFrame, names) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"column(s) {absent} not found; available: {df.columns}")
