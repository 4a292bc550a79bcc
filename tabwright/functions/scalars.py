"""Scalar helpers whose pandas meaning differs from the nearest Spark function."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .missing import literal_sql

# What counts as a number in text, and the words read as infinity or missing.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INTEGER_PATTERN = r"^\s*[+-]?[0-9]{1,18}\s*$"
INFINITY_PATTERN = r"^[+-]?(?i:inf|infinity)$"
MISSING_NUMBER_PATTERN = r"^(|[+-]?(?i:nan))$"

# Accepted date shapes, each with the pattern that guards it.
DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{4}$", "yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}$", "yyyy-M-d H:m"),
    (r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}:\d{2}$", "yyyy-M-d H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}:\d{2}\.\d{1,6}$", "yyyy-M-d H:m:s.SSSSSS"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:m:s"),
)


# Every accepted date shape holds a four-digit year.
YEAR_PATTERN = r"[0-9]{4}"


def strip(c: Column) -> Column:
    """Remove all leading and trailing whitespace (SQL ``trim`` removes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, {literal_sql(r'^\s+|\s+$')}, '')"


def number_sql(c: str) -> str:
    """Text to DOUBLE; anything pandas would not read as a number becomes NULL (so does 'nan')."""
    bare = strip_sql(c)
    return (
        f"CASE WHEN {c} RLIKE {literal_sql(NUMBER_PATTERN)} THEN try_cast({bare} AS DOUBLE) "
        f"WHEN {bare} RLIKE {literal_sql(INFINITY_PATTERN)} THEN IF(startswith({bare}, '-'), double('-Infinity'), double('Infinity')) END"
    )


def missing_number_sql(c: str) -> str:
    """Blank and NaN words: not a number, yet no obstacle to reading the column as numbers."""
    return f"({strip_sql(c)} RLIKE {literal_sql(MISSING_NUMBER_PATTERN)})"


def integer_sql(c: str) -> str:
    return f"({c} RLIKE {literal_sql(INTEGER_PATTERN)})"


def datetime_sql(c: str) -> str:
    """Text to TIMESTAMP_NTZ by the first accepted shape; independent of row order."""
    bare = strip_sql(c)
    cases = []
    for pattern, fmt in DATE_FORMATS:
        subject = f"replace({bare}, 'T', ' ')" if ":" in fmt or fmt.endswith("H:m") else bare
        cases.append(f"WHEN {bare} RLIKE {literal_sql(pattern)} THEN CAST(try_to_timestamp({subject}, {literal_sql(fmt)}) AS TIMESTAMP_NTZ)")
    # One cheap look settles most text before the shapes are tried.
    return f"CASE WHEN NOT ({c} RLIKE {literal_sql(YEAR_PATTERN)}) THEN NULL {' '.join(cases)} END"


def clip(c: Column, lower, upper) -> Column:
    """Clamp into [lower, upper]; missing stays missing."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lower)), F.lit(upper)))


def finite(c: Column) -> Column:
    """True for a present, finite number."""
    inf = F.lit(float("inf"))
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf)
