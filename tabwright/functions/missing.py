"""Missing values: SQL NULL plus floating-point NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .kinds import col, quoted


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL, so that NULL is the only missing marker."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.nanvl(col(name), F.lit(None))
    return col(name)


def is_missing(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()


def as_double(df: DataFrame, name: str) -> Column:
    """A numeric column as DOUBLE with missing as NULL: the input of every statistic.

    Casting first keeps integer and decimal arithmetic from overflowing under ANSI mode.
    """
    return present(df, name).cast("double")


def double_sql(df: DataFrame, name: str) -> str:
    """``as_double`` as SQL text.

    Aggregations over many columns are written as text: one parse is far cheaper for the driver
    than thousands of Column calls, and the plan is the same.
    """
    if isinstance(df.schema[name].dataType, T.DoubleType):
        return f"nanvl({quoted(name)}, CAST(NULL AS DOUBLE))"
    if isinstance(df.schema[name].dataType, T.FloatType):
        return f"nanvl(CAST({quoted(name)} AS DOUBLE), CAST(NULL AS DOUBLE))"
    return f"CAST({quoted(name)} AS DOUBLE)"


def missing_sql(df: DataFrame, name: str) -> str:
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return f"({quoted(name)} IS NULL OR isnan({quoted(name)}))"
    return f"({quoted(name)} IS NULL)"


def literal_sql(value) -> str:
    """A number or text as SQL text without loss."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"{value}L"
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            return f"double('{value}')"
        return f"{value!r}D"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"
