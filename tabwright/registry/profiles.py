"""Registered queries: profiles, reports, filters and ordering."""

from __future__ import annotations

from ..operators import correlation as corr, filters, frequencies as freq, ordering, profile
from ..functions.kinds import columns_by_kind
from .base import (
    DIRTY_COLUMNS, DIRTY_NUMERIC, DIRTY_TEXT, LINE_NUMERIC, Query, dirty, rounded, sql_freq, sql_missing, sql_numeric_stats, sql_pairs,
    sql_top, table, union_all, with_d,
)

KIND_OF = {**{c: "numeric" for c in DIRTY_NUMERIC}, **{c: "categorical" for c in DIRTY_TEXT}, "order_ts": "datetime"}
ALL_D = ", ".join(DIRTY_COLUMNS)
MISSING_CELLS = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in DIRTY_COLUMNS)
DUPLICATES = "(SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d))"
PART_NUMERIC = ["p_partkey", "p_size", "p_retailprice"]
PART_PLUS = PART_NUMERIC + ["gross", "discounted"]
PART_SQL = "(SELECT *, p_retailprice*1.1 AS gross, -1.0*p_size AS discounted FROM part)"
PLUS_NUMERIC = DIRTY_NUMERIC + ["gross", "reverse_id"]


def part_plus(spark, sf):
    return table(spark, sf, "part").selectExpr("*", "p_retailprice*1.1D AS gross", "-1.0D*p_size AS discounted")


def dirty_plus(spark, sf):
    return spark.sql("SELECT *, price*1.1D AS gross, -1.0D*id AS reverse_id FROM {d}", d=dirty(spark, sf))


def with_plus(sql: str) -> str:
    return with_d("WITH p AS (SELECT *, price*1.1::DOUBLE AS gross, -1.0::DOUBLE*id AS reverse_id FROM d) " + sql)


def _categorical_sql(src, names, k):
    return f"""WITH f AS ({sql_freq(src, names)}),
t AS (SELECT "column", count(*) AS u, sum(n) AS p, sum(length(value)*n) AS l FROM f GROUP BY 1),
r AS (SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM f)
SELECT r."column", t.u::BIGINT AS unique_count, round(t.u*100.0::DOUBLE/t.p,2) AS cardinality_pct, round(t.l::DOUBLE/t.p,1) AS avg_length,
r.rank::INTEGER AS rank, r.value, r.n::BIGINT AS count FROM r JOIN t ON r."column"=t."column" WHERE r.rank<={k}"""


def _describe_sql(src, names):
    return union_all(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}::DOUBLE),2) AS mean, round(stddev_samp({c}::DOUBLE),2) AS std,
round(min({c})::DOUBLE,2) AS min, round(quantile_cont({c}::DOUBLE,0.25),2) AS q25, round(quantile_cont({c}::DOUBLE,0.5),2) AS q50,
round(quantile_cont({c}::DOUBLE,0.75),2) AS q75, round(max({c})::DOUBLE,2) AS max FROM {src}"""
        for c in names
    )


def _entry(section, item, metric, value="NULL", text="NULL"):
    return f"SELECT '{section}' AS section, '{item}' AS item, '{metric}' AS metric, CAST({value} AS DOUBLE) AS value, CAST({text} AS VARCHAR) AS text"


def _report_head(src, names):
    cells = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in names)
    return [
        _entry("shape", "dataset", "rows", "count(*)") + f" FROM {src}",
        _entry("shape", "dataset", "columns", str(len(names))),
        _entry("missing", "dataset", "cells", f"sum({cells})") + f" FROM {src}",
        _entry("missing", "dataset", "pct", f"round(sum({cells})*100.0::DOUBLE/(count(*)*{len(names)}),1)") + f" FROM {src}",
    ]


def _local_report_sql():
    names = DIRTY_COLUMNS + ["gross", "reverse_id"]
    parts = _report_head("p", names)
    parts.append(
        f"""SELECT 'missing' AS section, "column" AS item, 'worst' AS metric, m::DOUBLE AS value, NULL AS text
FROM (SELECT * FROM ({sql_missing("p", names)}) WHERE m>0 ORDER BY m DESC, ord LIMIT 5)"""
    )
    parts.append(_entry("duplicates", "dataset", "rows", "(SELECT count(*) FROM p) - (SELECT count(*) FROM (SELECT DISTINCT * FROM p))"))
    for c in PLUS_NUMERIC[:8]:
        for metric, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            parts.append(_entry("numeric", c, metric, f"round({fn}({c}::DOUBLE),4)") + " FROM p")
    for c in DIRTY_TEXT:
        parts.append(_entry("categorical", c, "unique", f"count(DISTINCT {c})") + " FROM p")
        parts.append(_entry("categorical", c, "mode", "NULL", f"(SELECT value FROM ({sql_top('p', c, 1)}))"))
    parts.append(
        f"""SELECT 'correlation' AS section, col_a AS item, 'r' AS metric, round(r,3) AS value, col_b AS text
FROM (SELECT * FROM ({sql_pairs("p", PLUS_NUMERIC)}) WHERE abs(r)>0.5 ORDER BY abs(r) DESC, ord_a, ord_b LIMIT 5)"""
    )
    return with_plus(union_all(parts))


def _summary_sql():
    parts = _report_head("d", DIRTY_COLUMNS)
    parts += [_entry("columns", c, "position", str(i + 1)) for i, c in enumerate(DIRTY_COLUMNS)]
    parts += [_entry("kind", "numeric", "count", str(len(DIRTY_NUMERIC))), _entry("kind", "categorical", "count", str(len(DIRTY_TEXT)))]
    parts += [_entry("kind", c, "member", "NULL", "'numeric'") for c in DIRTY_NUMERIC] + [_entry("kind", c, "member", "NULL", "'categorical'") for c in DIRTY_TEXT]
    for c in DIRTY_NUMERIC:
        x = f"{c}::DOUBLE"
        stats = [("count", f"count({c})"), ("mean", f"round(avg({x}),2)"), ("std", f"round(stddev_samp({x}),2)"), ("min", f"round(min({x}),2)")]
        stats += [(f"q{p}", f"round(quantile_cont({x},0.{p}),2)") for p in (25, 50, 75)] + [("max", f"round(max({x}),2)")]
        parts += [_entry("stats", c, k, v) + " FROM d" for k, v in stats]
    for c in DIRTY_TEXT[:3]:
        parts.append(f"SELECT 'top_values' AS section, '{c}' AS item, 'rank ' || rank AS metric, count::DOUBLE AS value, value AS text FROM ({sql_top('d', c, 5)})")
    return with_d(union_all(parts))


def _column_profile_sql(c, kind):
    head = f"""'{c}' AS "column", '{kind}' AS kind, count({c}) AS non_null, count(*)-count({c}) AS missing,
round((count(*)-count({c}))*100.0::DOUBLE/count(*),1) AS missing_pct, count(DISTINCT {c}) AS "unique" """
    if kind == "numeric":
        x = f"{c}::DOUBLE"
        tail = f"""round(avg({x}),4) AS mean, round(stddev_samp({x}),4) AS std, round(min({x}),4) AS min, round(max({x}),4) AS max,
round(quantile_cont({x},0.5),4) AS median, NULL::VARCHAR AS top_value, NULL::BIGINT AS top_count"""
    else:
        tail = f"""NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS median,
(SELECT value FROM ({sql_top('d', c, 1)})) AS top_value, (SELECT count FROM ({sql_top('d', c, 1)})) AS top_count"""
    return with_d(f"SELECT {head}, {tail} FROM d")


def _kinds(spark, sf):
    """Column lists per kind with the table's row count."""
    df = dirty(spark, sf)
    lists = columns_by_kind(df)
    rows = [(k, i, c) for k, names in lists.items() for i, c in enumerate(names)]
    listed = spark.createDataFrame(rows, "kind string, position int, column string")
    return listed.join(profile.dtype_profile(df).select("column", "present"), "column").select("kind", "position", "column", "present")


# More columns than one generated method would hold, all correlated to some degree.
WIDE_NAMES = [f"c{i}" for i in range(24)]
WIDE = "SELECT " + ", ".join(f"l_quantity * {i % 7 + 1} + l_discount * {100 * (i % 5)} + l_extendedprice / {1000 + 400 * i} AS c{i}" for i in range(24)) + " FROM {line}"
WIDE_SQL = WIDE.format(line="lineitem")
# A large offset with a tiny spread, and a column with infinite values, which has no correlations.
OFFSET = "SELECT CAST(o_orderkey AS DOUBLE) AS x, CAST(1000000000 + o_orderkey % 2 AS DOUBLE) AS y, CAST(1000000 + o_custkey % 3 AS DOUBLE) AS z FROM {o}"
OFFSET_SQL = OFFSET.format(o="orders")
INFINITE = "SELECT o_totalprice AS x, CASE WHEN o_orderkey % 100 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE o_totalprice END AS w, CAST(o_custkey AS DOUBLE) AS y FROM {o}"
INFINITE_SQL = INFINITE.format(o="orders")

QUERIES = {
    "numeric_stats": Query(lambda s, d: profile.numeric_stats(table(s, d, "lineitem")), sql_numeric_stats("lineitem", LINE_NUMERIC)),
    "numeric_stats_with_gaps": Query(lambda s, d: profile.numeric_stats(dirty(s, d)), with_d(sql_numeric_stats("d", DIRTY_NUMERIC))),
    "table_shape": Query(lambda s, d: profile.shape(dirty(s, d)), with_d("SELECT count(*) AS rows, 11::INTEGER AS columns FROM d")),
    "dtype_profile": Query(
        lambda s, d: profile.dtype_profile(dirty(s, d)).select("column", "kind", "present"),
        with_d(union_all(f"""SELECT '{c}' AS "column", '{k}' AS kind, count({c}) AS present FROM d""" for c, k in KIND_OF.items())),
    ),
    "columns_by_kind": Query(
        _kinds,
        with_d(
            union_all(
                f"""SELECT '{k}' AS kind, {i}::INTEGER AS position, '{c}' AS "column", count({c}) AS present FROM d"""
                for k, names in (("numeric", DIRTY_NUMERIC), ("categorical", DIRTY_TEXT), ("datetime", ["order_ts"]))
                for i, c in enumerate(names)
            )
        ),
    ),
    "missing_profile": Query(
        lambda s, d: profile.missing_profile(dirty(s, d)),
        with_d(f"""SELECT "column", m::BIGINT AS missing_count, round(m*100.0::DOUBLE/n,2) AS missing_pct FROM ({sql_missing("d", DIRTY_COLUMNS)}) WHERE m>0"""),
    ),
    "missing_totals": Query(
        lambda s, d: profile.missing_totals(dirty(s, d)),
        with_d(
            f"""SELECT sum({MISSING_CELLS})::BIGINT AS total_missing_cells, (count(*)*11)::BIGINT AS total_cells,
round(sum({MISSING_CELLS})*100.0::DOUBLE/(count(*)*11),2) AS overall_missing_pct FROM d"""
        ),
    ),
    "duplicate_profile": Query(
        lambda s, d: profile.duplicate_profile(dirty(s, d)),
        with_d(
            f"""SELECT ({DUPLICATES})::BIGINT AS duplicate_rows, round(({DUPLICATES})*100.0::DOUBLE/(SELECT count(*) FROM d),2) AS duplicate_pct,
(SELECT count(*) FROM d)::BIGINT AS total_rows"""
        ),
    ),
    "categorical_stats": Query(
        lambda s, d: profile.categorical_stats(table(s, d, "orders")), _categorical_sql("orders", ["o_orderstatus", "o_orderpriority"], 5)
    ),
    "categorical_stats_with_gaps": Query(lambda s, d: profile.categorical_stats(dirty(s, d)), with_d(_categorical_sql("d", DIRTY_TEXT, 5))),
    "value_counts": Query(lambda s, d: freq.value_counts(table(s, d, "part"), "p_brand", 10), sql_top("part", "p_brand", 10)),
    "frequency_table": Query(
        lambda s, d: freq.freq_table(dirty(s, d), DIRTY_TEXT),
        with_d(f"""SELECT "column", value, n::BIGINT AS count FROM ({sql_freq("d", DIRTY_TEXT)})"""),
    ),
    "top_values_per_column": Query(
        lambda s, d: freq.top_values(freq.freq_table(dirty(s, d), DIRTY_TEXT), 5),
        with_d(
            f"""SELECT "column", rank::INTEGER AS rank, value, n::BIGINT AS count FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank
FROM ({sql_freq("d", DIRTY_TEXT)})) WHERE rank<=5"""
        ),
    ),
    "top_correlations": Query(
        lambda s, d: corr.top_correlations(part_plus(s, d)),
        f"""SELECT CAST(row_number() OVER (ORDER BY abs(round(r,4)) DESC, ord_a, ord_b) AS INTEGER) AS rank, col_a, col_b, round(r,4) AS correlation
FROM ({sql_pairs(PART_SQL, PART_PLUS)}) ORDER BY 1 LIMIT 10""",
    ),
    "correlation_wide": Query(
        lambda s, d: rounded(corr.correlation_pairs(s.sql(WIDE, line=table(s, d, "lineitem")))).select("col_a", "col_b", "r"),
        f"SELECT col_a, col_b, round(r,6) AS r FROM ({sql_pairs(f'({WIDE_SQL})', WIDE_NAMES)})",
    ),
    "correlation_offset": Query(
        lambda s, d: rounded(corr.correlation_pairs(s.sql(OFFSET, o=table(s, d, "orders")))).select("col_a", "col_b", "r"),
        f"SELECT col_a, col_b, round(r,6) AS r FROM ({sql_pairs(f'({OFFSET_SQL})', ['x', 'y', 'z'])})",
    ),
    "correlation_infinite": Query(
        lambda s, d: rounded(corr.correlation_pairs(s.sql(INFINITE, o=table(s, d, "orders")))).select("col_a", "col_b", "r"),
        f"SELECT col_a, col_b, round(r,6) AS r FROM ({sql_pairs(f'({INFINITE_SQL})', ['x', 'y'])})",
    ),
    "correlation_matrix": Query(
        lambda s, d: rounded(corr.correlation_matrix(table(s, d, "lineitem"))),
        f"""WITH c AS ({sql_pairs("lineitem", LINE_NUMERIC)}) SELECT col_a AS "row", col_b AS col, round(r,6) AS r FROM c
UNION ALL SELECT col_b, col_a, round(r,6) FROM c UNION ALL """
        + union_all(f"SELECT '{c}', '{c}', 1.0::DOUBLE" for c in LINE_NUMERIC),
    ),
    "correlation_insights": Query(
        lambda s, d: corr.correlation_insights(dirty_plus(s, d)),
        with_plus(
            f"""SELECT col_a, col_b, CASE WHEN r>0 THEN 'positively' ELSE 'negatively' END AS direction, round(r,3) AS correlation
FROM ({sql_pairs("p", PLUS_NUMERIC)}) WHERE abs(r)>0.7 ORDER BY ord_a, ord_b LIMIT 10"""
        ),
    ),
    "correlation_insights_by_strength": Query(
        lambda s, d: corr.correlation_insights(part_plus(s, d), 0.5, 5, by_strength=True).select("direction", "correlation"),
        f"""SELECT CASE WHEN r>0 THEN 'positively' ELSE 'negatively' END AS direction, round(r,3) AS correlation
FROM ({sql_pairs(PART_SQL, PART_PLUS)}) WHERE abs(r)>0.5 ORDER BY abs(r) DESC, ord_a, ord_b LIMIT 5""",
    ),
    "sample_rows": Query(
        lambda s, d: profile.sample_rows(table(s, d, "orders"), ["o_orderkey"], 5), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5"
    ),
    "describe": Query(lambda s, d: profile.describe(table(s, d, "lineitem")), _describe_sql("lineitem", LINE_NUMERIC[:6])),
    "column_profile": Query(lambda s, d: profile.column_profile(dirty(s, d), "price"), _column_profile_sql("price", "numeric")),
    "column_profile_text": Query(lambda s, d: profile.column_profile(dirty(s, d), "priority"), _column_profile_sql("priority", "categorical")),
    "quality_profile": Query(
        lambda s, d: profile.quality_profile(dirty(s, d)),
        with_d(
            f"""SELECT round((1.0::DOUBLE-sum({MISSING_CELLS})::DOUBLE/(count(*)*11))*100.0,4) AS completeness,
round((1.0::DOUBLE-({DUPLICATES})::DOUBLE/count(*))*100.0,4) AS uniqueness, round(100.0::DOUBLE*4/11,4) AS numeric_ratio FROM d"""
        ),
    ),
    "completeness": Query(
        lambda s, d: rounded(profile.completeness(dirty(s, d))),
        with_d(f"SELECT round((1.0::DOUBLE-sum({MISSING_CELLS})::DOUBLE/(count(*)*11))*100.0,6) AS completeness FROM d"),
    ),
    "dataset_summary": Query(lambda s, d: profile.dataset_summary(dirty(s, d)), _summary_sql()),
    "local_report": Query(lambda s, d: profile.local_report(dirty_plus(s, d)), _local_report_sql()),
    "cleaning_state": Query(
        lambda s, d: profile.cleaning_state(dirty(s, d)),
        with_d(
            f"""SELECT count(*) AS rows, 11::INTEGER AS columns, sum({MISSING_CELLS})::BIGINT AS missing_total,
round(sum({MISSING_CELLS})*100.0::DOUBLE/(count(*)*11),2) AS missing_pct, ({DUPLICATES})::BIGINT AS duplicates FROM d"""
        ),
    ),
    "feature_summary": Query(
        lambda s, d: profile.feature_summary(dirty(s, d)),
        with_d(f"SELECT 11::INTEGER AS total_features, 4::INTEGER AS numeric, 7::INTEGER AS non_numeric, '{ALL_D}' AS columns, count(*) AS rows FROM d"),
    ),
    "load_summary": Query(
        lambda s, d: profile.load_summary(dirty(s, d)),
        with_d(
            f"""SELECT count(*) AS rows, 11::INTEGER AS columns, sum({MISSING_CELLS})::BIGINT AS missing_cells,
round(sum({MISSING_CELLS})*100.0::DOUBLE/(count(*)*11),1) AS missing_pct, 4::INTEGER AS numeric_columns, 6::INTEGER AS categorical_columns,
1::INTEGER AS datetime_columns FROM d"""
        ),
    ),
    "table_search": Query(
        lambda s, d: filters.search_rows(table(s, d, "customer"), "MACH"),
        """SELECT * FROM customer WHERE lower(c_custkey::VARCHAR) LIKE '%mach%' OR lower(c_name) LIKE '%mach%' OR lower(c_nationkey::VARCHAR) LIKE '%mach%'
OR lower(c_acctbal::VARCHAR) LIKE '%mach%' OR lower(c_mktsegment) LIKE '%mach%'""",
    ),
    "complete_cases": Query(
        lambda s, d: filters.complete_cases(dirty(s, d), ["price", "priority"]), with_d("SELECT * FROM d WHERE price IS NOT NULL AND priority IS NOT NULL")
    ),
    "finite_rows": Query(
        lambda s, d: filters.finite_rows(table(s, d, "events").selectExpr("event_id", "CASE WHEN event_id % 5 = 0 THEN double('NaN') WHEN event_id % 7 = 0 THEN double('inf') ELSE value END AS value"), ["value"]),
        "SELECT event_id, value FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0",
    ),
    "positive_columns": Query(
        lambda s, d: s.createDataFrame(list(filters.all_positive(dirty(s, d).selectExpr("id", "price", "id + 1 AS next_id"), ["id", "price", "next_id"]).items()), "column string, positive boolean"),
        with_d(union_all(f"""SELECT '{c}' AS "column", bool_and(coalesce({e}>0,false)) AS positive FROM d""" for c, e in (("id", "id"), ("price", "price"), ("next_id", "id+1")))),
    ),
    "rows_of_top_groups": Query(
        lambda s, d: filters.rows_of_top_groups(table(s, d, "part"), "p_brand", 10).select("p_partkey", "p_brand"),
        f"SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT value FROM ({sql_top('part', 'p_brand', 10)}))",
    ),
    "sort_page": Query(
        lambda s, d: ordering.sort_page(dirty(s, d).dropDuplicates(), "price", ["id"], 100, ascending=False).select("id", "price"),
        with_d("SELECT id, price FROM (SELECT DISTINCT * FROM d) ORDER BY price DESC NULLS LAST, id LIMIT 100"),
    ),
    "display_page": Query(
        lambda s, d: ordering.is_truncated(table(s, d, "orders")),
        "SELECT count(*) AS total_rows, least(count(*),10000)::BIGINT AS shown_rows, count(*)>10000 AS is_truncated FROM orders",
    ),
    "row_positions": Query(
        lambda s, d: ordering.with_position(table(s, d, "events"), ["value", "event_id"], keep=["event_id"]),
        "SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS position FROM events",
    ),
}
