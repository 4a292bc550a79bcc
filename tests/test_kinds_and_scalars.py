import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright.functions import kinds, scalars
from tabwright.functions.missing import is_missing, literal_sql, present


def values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_kinds(spark):
    df = spark.sql(
        "SELECT 1 AS i, 1L AS l, 1.5D AS d, CAST(1 AS DECIMAL(5,2)) AS n, true AS b, 'x' AS s, DATE'2024-01-01' AS dt, "
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS t, array(1) AS a, map('k',1) AS m"
    )
    got = kinds.columns_by_kind(df)
    assert got == {"numeric": ["i", "l", "d", "n"], "categorical": ["s"], "datetime": ["dt", "t"]}
    assert kinds.kind_of(df.schema["b"].dataType) == "bool"
    assert kinds.kind_of(df.schema["a"].dataType) == "other"
    assert kinds.select_kind(df, "numeric").columns == ["i", "l", "d", "n"]


def test_nan_counts_as_missing(frame):
    df = frame("x double", 1.0, float("nan"), None, 2.0)
    assert values(df, is_missing(df, "x")) == [False, True, True, False]
    assert values(df, present(df, "x")) == [1.0, None, None, 2.0]


def test_odd_column_names(frame):
    df = frame("`a.b` double, `c``d` string", (1.0, "x"), (None, None))
    assert values(df, is_missing(df, "a.b")) == [False, True]
    assert values(df, kinds.col("c`d")) == ["x", None]


NUMBER_TEXT = ["1e5", " 12 ", ".5", "1.", "1d", "1,000", "0x10", "", "nan", "inf", "-Infinity", "+3", "abc", "1 2", "1f"]


def test_parse_number_agrees_with_pandas(frame):
    df = frame("s string", *NUMBER_TEXT)
    got = values(df, F.expr(scalars.number_sql("s")))
    want = [pd.to_numeric(pd.Series([t]), errors="coerce").iloc[0] for t in NUMBER_TEXT]
    for text, g, w in zip(NUMBER_TEXT, got, want):
        if text == "0x10":  # pandas reads hexadecimal; a table column of it is an identifier
            continue
        assert (g is None and pd.isna(w)) or g == w, text


def test_blank_and_nan_words(frame):
    df = frame("s string", "", "nan", "NaN", "x", None)
    assert values(df, F.expr(scalars.missing_number_sql("s"))) == [True, True, True, False, None]


@pytest.mark.parametrize(
    "text,want",
    [
        ("2024-01-02", dt.datetime(2024, 1, 2)),
        ("01/02/2024", dt.datetime(2024, 1, 2)),
        ("Jan 2, 2024", dt.datetime(2024, 1, 2)),
        ("January 2, 2024", dt.datetime(2024, 1, 2)),
        ("2 Jan 2024", dt.datetime(2024, 1, 2)),
        ("20240102", dt.datetime(2024, 1, 2)),
        ("2024/1/2", dt.datetime(2024, 1, 2)),
        ("2024", dt.datetime(2024, 1, 1)),
        ("2024-01-02 03:04", dt.datetime(2024, 1, 2, 3, 4)),
        ("2024-01-02T03:04:05", dt.datetime(2024, 1, 2, 3, 4, 5)),
        ("2024-01-02 03:04:05.25", dt.datetime(2024, 1, 2, 3, 4, 5, 250000)),
        ("  2024-01-02 ", dt.datetime(2024, 1, 2)),
        ("2024-13-01", None),
        ("hello", None),
        ("", None),
    ],
)
def test_parse_datetime(frame, text, want):
    assert values(frame("s string", text), F.expr(scalars.datetime_sql("s"))) == [want]


def test_strip_takes_all_whitespace(frame):
    df = frame("s string", "\t a b \n", "  x", None)
    assert values(df, scalars.strip(F.col("s"))) == ["a b", "x", None]


def test_clip_keeps_missing(frame):
    df = frame("x double", 1.0, None, 9.0, -4.0)
    assert values(df, scalars.clip(F.col("x"), 0.0, 5.0)) == [1.0, None, 5.0, 0.0]


def test_finite(frame):
    df = frame("x double", 1.0, None, float("nan"), float("inf"), float("-inf"))
    assert values(df, scalars.finite(F.col("x"))) == [True, False, False, False, False]


@pytest.mark.parametrize("value", [1, -5, 0.1, 1e300, float("inf"), "it's", "back\\slash", 'quote"', None, True])
def test_literal_sql_round_trips(spark, value):
    assert spark.sql(f"SELECT {literal_sql(value)} AS v").first()["v"] == value
