"""Shared pieces of the query registry: inputs, rounding, and builders of checking SQL."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.kinds import col


@dataclass(frozen=True)
class Query:
    """A runnable query and, where ANSI SQL can say the same, the SQL that checks it."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# A table with duplicates, gaps, outliers, padding and mistyped text, derived from orders.
DIRTY = """
WITH base AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus, o_orderdate FROM {orders}),
dup AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE o_orderkey % 50 = 0)
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN o_totalprice*20 ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN '  ' || lower(o_orderpriority) || ' ' ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 10 < 8 THEN NULL ELSE o_custkey END AS sparse80,
  CASE WHEN o_orderkey % 20 < 19 THEN NULL ELSE o_custkey END AS sparse95,
  'K' AS const_col,
  CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR(20)) END AS num_text,
  CAST(o_custkey AS VARCHAR(20)) AS clean_num_text,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS date_text,
  o_orderstatus AS status, o_orderdate AS order_ts
FROM dup
"""
DIRTY_SQL = DIRTY.format(orders="orders")
DIRTY_NUMERIC = ["id", "price", "sparse80", "sparse95"]
DIRTY_TEXT = ["priority", "const_col", "num_text", "clean_num_text", "date_text", "status"]
DIRTY_COLUMNS = ["id", "price", "priority", "sparse80", "sparse95", "const_col", "num_text", "clean_num_text", "date_text", "status", "order_ts"]


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(DIRTY, orders=table(spark, sf, "orders"))


LINE_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def with_d(sql: str) -> str:
    """Checking SQL over the dirty table, named d."""
    return f"WITH d AS ({DIRTY_SQL}) {sql}" if not sql.lstrip().upper().startswith("WITH ") else f"WITH d AS ({DIRTY_SQL}), {sql.lstrip()[5:]}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, so that summation order cannot show in a comparison."""
    return df.select(
        *[F.round(col(f.name), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else col(f.name) for f in df.schema.fields]
    )


def union_all(parts) -> str:
    return "\nUNION ALL\n".join(parts)


# --- builders of checking SQL ---------------------------------------------------------------------


def sql_numeric_stats(src: str, names) -> str:
    return union_all(
        f"""SELECT '{c}' AS "column", round(avg({c}::DOUBLE),4) AS mean, round(quantile_cont({c}::DOUBLE,0.5),4) AS median,
round(stddev_samp({c}::DOUBLE),4) AS std, round(min({c})::DOUBLE,4) AS min, round(max({c})::DOUBLE,4) AS max,
round(skewness({c}::DOUBLE),4) AS skewness, round(kurtosis({c}::DOUBLE),4) AS kurtosis,
round(count(*) FILTER (WHERE {c}=0)*100.0::DOUBLE/count({c}),2) AS zeros_pct FROM {src}"""
        for c in names
    )


def sql_pairs(src: str, names) -> str:
    """(ord_a, ord_b, col_a, col_b, r) rows with a defined correlation."""
    parts = []
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            b = names[j]
            parts.append(f"SELECT {i} AS ord_a, {j} AS ord_b, '{a}' AS col_a, '{b}' AS col_b, corr({a}::DOUBLE,{b}::DOUBLE) AS r FROM {src}")
    return f"SELECT * FROM ({union_all(parts)}) WHERE r IS NOT NULL AND NOT isnan(r)"


def sql_freq(src: str, names) -> str:
    return union_all(f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}""" for c in names)


def sql_top(src: str, name: str, k: int) -> str:
    """(rank, value, count) of the k most frequent values."""
    return f"""SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, {name}) AS INTEGER) AS rank, {name} AS value, count(*) AS count
FROM {src} WHERE {name} IS NOT NULL GROUP BY {name} ORDER BY 1 LIMIT {k}"""


def sql_missing(src: str, names) -> str:
    return union_all(f"""SELECT {i} AS ord, '{c}' AS "column", count(*) AS n, count(*)-count({c}) AS m FROM {src}""" for i, c in enumerate(names))


def sql_hist(src: str, name: str, bins: int) -> str:
    """(bin, bin_start, bin_end, count) with empty bins; the column must not be constant."""
    return f"""SELECT CAST(g.b AS INTEGER) AS bin, round(m.lo + g.b*((m.hi-m.lo)/{bins}),6) AS bin_start,
round(CASE WHEN g.b={bins - 1} THEN m.hi ELSE m.lo + (g.b+1)*((m.hi-m.lo)/{bins}) END,6) AS bin_end, coalesce(h.n,0)::BIGINT AS count
FROM range({bins}) g(b) CROSS JOIN (SELECT min({name})::DOUBLE lo, max({name})::DOUBLE hi FROM {src}) m
LEFT JOIN (SELECT least(floor(({name}::DOUBLE-lo)/(hi-lo)*{bins}::DOUBLE),{bins - 1})::INTEGER b, count(*) n
FROM {src} CROSS JOIN (SELECT min({name})::DOUBLE lo, max({name})::DOUBLE hi FROM {src}) WHERE {name} IS NOT NULL GROUP BY 1) h ON h.b=g.b"""
