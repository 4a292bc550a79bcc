"""Registered queries: cleaning steps and recipes over the dirty table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import datetime_sql
from ..operators import clean as ops
from ..plans.recipes import clean
from .base import DIRTY_COLUMNS, DIRTY_NUMERIC, DIRTY_TEXT, Query, dirty, rounded, union_all, with_d


def _numbers(df):
    """The numeric columns of the dirty table as rounded doubles, with the row's id."""
    return rounded(df.selectExpr("CAST(id AS BIGINT) AS id", *[f"CAST({c} AS DOUBLE) AS {c}" for c in DIRTY_NUMERIC[1:]]), 4)


def _fill_sql(fn):
    fills = ", ".join(f"round(coalesce({c}::DOUBLE, (SELECT {fn(c)} FROM d)),4) AS {c}" for c in DIRTY_NUMERIC[1:])
    return with_d(f"SELECT id, {fills} FROM d")


def _mode(src, c):
    return f"(SELECT {c} FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


def _cap(c, lo, hi):
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}::DOUBLE, {lo}), {hi}) END"


def _iqr_ctes(src, names, factor=1.5):
    qs = ", ".join(f"quantile_cont({c}::DOUBLE,0.25) AS a_{c}, quantile_cont({c}::DOUBLE,0.75) AS b_{c}" for c in names)
    bounds = ", ".join(f"a_{c}-{factor}*(b_{c}-a_{c}) AS lo_{c}, b_{c}+{factor}*(b_{c}-a_{c}) AS hi_{c}, b_{c}-a_{c} AS iqr_{c}" for c in names)
    return f"q AS (SELECT {qs} FROM {src}), k AS (SELECT {bounds} FROM q)"


STRIP = "regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"


def _clip_report(plan, spark):
    return plan.report(spark).select("column", "metric", "value")


def _outlier_report_sql():
    parts = []
    for c in DIRTY_NUMERIC:
        x = f"{c}::DOUBLE"
        inner = f"(SELECT lo_{c} AS lo, hi_{c} AS hi, count(*) FILTER (WHERE {x}<lo_{c}) AS below, count(*) FILTER (WHERE {x}>hi_{c}) AS above FROM d CROSS JOIN k GROUP BY ALL)"
        for metric, v in (("below", "below::DOUBLE"), ("above", "above::DOUBLE"), ("lower_bound", "round(lo,4)"), ("upper_bound", "round(hi,4)")):
            parts.append(f"""SELECT '{c}' AS "column", '{metric}' AS metric, {v} AS value FROM {inner} WHERE below+above>0""")
    return with_d(f"WITH {_iqr_ctes('d', DIRTY_NUMERIC)} {union_all(parts)}")


def _agent_sql():
    t1 = f"""t0 AS (SELECT DISTINCT * FROM d), t1 AS (SELECT id, price, priority, const_col, TRY_CAST(num_text AS BIGINT) AS num_text,
clean_num_text::BIGINT AS clean_num_text, CAST(date_text AS TIMESTAMP) AS date_text, status, order_ts FROM t0)"""
    t2 = f"""t2 AS (SELECT id, coalesce(price, (SELECT quantile_cont(price,0.5) FROM t1)) AS price,
coalesce(priority, {_mode('t1', 'priority')}) AS priority, coalesce(num_text::DOUBLE, (SELECT quantile_cont(num_text::DOUBLE,0.5) FROM t1)) AS num_text,
clean_num_text, date_text, status, order_ts FROM t1)"""
    names = ["id", "price", "num_text", "clean_num_text"]
    capped = ", ".join(f"round({_cap(c, 'lo_' + c, 'hi_' + c)},4) AS {c}" for c in names)
    return with_d(f"WITH {t1}, {t2}, {_iqr_ctes('t2', names)} SELECT {capped}, priority, date_text, status, order_ts FROM t2 CROSS JOIN k")


def _basic_sql():
    fills = ", ".join(f"coalesce({c}::DOUBLE, (SELECT quantile_cont({c}::DOUBLE,0.5) FROM t0)) AS {c}" for c in ("price", "sparse80"))
    t1 = f"""t0 AS (SELECT DISTINCT * FROM d), t1 AS (SELECT id, {fills}, coalesce(priority, {_mode('t0', 'priority')}) AS priority, num_text,
clean_num_text::BIGINT AS clean_num_text, CAST(date_text AS TIMESTAMP) AS date_text, status, order_ts FROM t0)"""
    names = ["id", "price", "sparse80", "clean_num_text"]
    capped = ", ".join(f"round(CASE WHEN iqr_{c}>0 THEN {_cap(c, 'lo_' + c, 'hi_' + c)} ELSE {c}::DOUBLE END,4) AS {c}" for c in names)
    text = ", ".join(f"{STRIP.format(c=c)} AS {c}" for c in ("priority", "num_text", "status"))
    return with_d(f"WITH {t1}, {_iqr_ctes('t1', names)} SELECT {capped}, {text}, date_text, order_ts FROM t1 CROSS JOIN k")


def _as_doubles(df, names):
    return rounded(df.withColumns({n: F.col(n).cast("double") for n in names}), 4)


def _recipe(spark, sf, recipe, doubles):
    out = clean(dirty(spark, sf), recipe).data
    return _as_doubles(out, [c for c in doubles if c in out.columns])


def _recipe_report(spark, sf):
    """What the recipe removed and kept, as rows."""
    report = clean(dirty(spark, sf), "agent").report()
    return report.where("step IN ('before','duplicates','after','drop_missing','drop_constant')").select("step", "column", "metric", F.round("value", 4).alias("value"))


_D2 = "SELECT count(*)::DOUBLE FROM d"
_U2 = "SELECT count(*)::DOUBLE FROM u"

DATE_SHAPES = """SELECT id, CASE CAST(id % 7 AS INT)
 WHEN 0 THEN date_format(order_ts, 'yyyy-MM-dd') WHEN 1 THEN date_format(order_ts, 'MM/dd/yyyy') WHEN 2 THEN date_format(order_ts, 'yyyy/MM/dd')
 WHEN 3 THEN date_format(order_ts, 'MMM d, yyyy') WHEN 4 THEN date_format(order_ts, 'yyyyMMdd') WHEN 5 THEN date_format(order_ts, ' yyyy-MM-dd HH:mm:ss ')
 ELSE 'no date' END AS text FROM {d}"""

QUERIES = {
    "dedup": Query(lambda s, d: ops.remove_duplicates(dirty(s, d)), with_d("SELECT DISTINCT * FROM d")),
    "drop_missing_columns": Query(
        lambda s, d: ops.fit_drop_missing(dirty(s, d), 0.7).transform(dirty(s, d)),
        with_d(f"SELECT {', '.join(c for c in DIRTY_COLUMNS if not c.startswith('sparse'))} FROM d"),
    ),
    "drop_missing_columns_90": Query(
        lambda s, d: ops.fit_drop_missing(dirty(s, d), 0.9).transform(dirty(s, d)),
        with_d(f"SELECT {', '.join(c for c in DIRTY_COLUMNS if c != 'sparse95')} FROM d"),
    ),
    "impute_median": Query(
        lambda s, d: _numbers(ops.fit_impute_numeric(dirty(s, d), "median").transform(dirty(s, d))), _fill_sql(lambda c: f"quantile_cont({c}::DOUBLE,0.5)")
    ),
    "impute_mean": Query(lambda s, d: _numbers(ops.fit_impute_numeric(dirty(s, d), "mean").transform(dirty(s, d))), _fill_sql(lambda c: f"avg({c}::DOUBLE)")),
    "impute_zero": Query(lambda s, d: _numbers(ops.fit_impute_numeric(dirty(s, d), "zero").transform(dirty(s, d))), _fill_sql(lambda c: "min(0.0::DOUBLE)")),
    "impute_mode": Query(
        lambda s, d: ops.fit_impute_categorical(dirty(s, d), "mode").transform(dirty(s, d)).select("id", *DIRTY_TEXT),
        with_d(f"SELECT id, coalesce(priority, {_mode('d', 'priority')}) AS priority, {', '.join(DIRTY_TEXT[1:])} FROM d"),
    ),
    "impute_unknown": Query(
        lambda s, d: ops.fit_impute_categorical(dirty(s, d), "unknown").transform(dirty(s, d)).select("id", *DIRTY_TEXT),
        with_d(f"SELECT id, coalesce(priority, 'Unknown') AS priority, {', '.join(DIRTY_TEXT[1:])} FROM d"),
    ),
    "cap_iqr": Query(
        lambda s, d: _numbers(ops.fit_cap_outliers(dirty(s, d)).transform(dirty(s, d))),
        with_d(
            f"WITH {_iqr_ctes('d', DIRTY_NUMERIC[1:])} SELECT id, "
            + ", ".join(f"round({_cap(c, 'lo_' + c, 'hi_' + c)},4) AS {c}" for c in DIRTY_NUMERIC[1:])
            + " FROM d CROSS JOIN k"
        ),
    ),
    "cap_zscore": Query(
        lambda s, d: rounded(ops.fit_cap_outliers(dirty(s, d), method="zscore", factor=3.0).transform(dirty(s, d)).select("id", "price"), 3),
        with_d(
            f"WITH k AS (SELECT avg(price)-3.0*stddev_samp(price) AS lo, avg(price)+3.0*stddev_samp(price) AS hi FROM d) "
            f"SELECT id, round({_cap('price', 'lo', 'hi')},3) AS price FROM d CROSS JOIN k"
        ),
    ),
    "outlier_report": Query(lambda s, d: _clip_report(ops.fit_cap_outliers(dirty(s, d)), s), _outlier_report_sql()),
    "normalize_text": Query(
        lambda s, d: ops.normalize_text(dirty(s, d), lower=True).select("id", *DIRTY_TEXT),
        with_d(f"SELECT id, {', '.join(f'lower({STRIP.format(c=c)}) AS {c}' for c in DIRTY_TEXT)} FROM d"),
    ),
    "trim_text": Query(
        lambda s, d: ops.normalize_text(dirty(s, d), lower=False).select("id", *DIRTY_TEXT),
        with_d(f"SELECT id, {', '.join(f'{STRIP.format(c=c)} AS {c}' for c in DIRTY_TEXT)} FROM d"),
    ),
    "drop_constant": Query(
        lambda s, d: ops.fit_drop_constant(dirty(s, d)).transform(dirty(s, d)),
        with_d(f"SELECT {', '.join(c for c in DIRTY_COLUMNS if c != 'const_col')} FROM d"),
    ),
    "fix_dtypes_majority": Query(
        lambda s, d: ops.fit_fix_dtypes(dirty(s, d)).transform(dirty(s, d)).select("id", "priority", "num_text", "clean_num_text", "date_text"),
        with_d("SELECT id, priority, TRY_CAST(num_text AS BIGINT) AS num_text, clean_num_text::BIGINT AS clean_num_text, CAST(date_text AS TIMESTAMP) AS date_text FROM d"),
    ),
    "fix_dtypes_strict": Query(
        lambda s, d: ops.fit_fix_dtypes(dirty(s, d), strict=True).transform(dirty(s, d)).select("id", "priority", "num_text", "clean_num_text", "date_text"),
        with_d("SELECT id, priority, num_text, clean_num_text::BIGINT AS clean_num_text, CAST(date_text AS TIMESTAMP) AS date_text FROM d"),
    ),
    "parse_dates": Query(
        lambda s, d: s.sql(DATE_SHAPES, d=dirty(s, d)).select("id", F.expr(datetime_sql("text")).alias("parsed")),
        with_d("SELECT id, CASE WHEN id % 7 = 6 THEN NULL ELSE order_ts END AS parsed FROM d"),
    ),
    "clean_agent": Query(lambda s, d: _recipe(s, d, "agent", ["id", "price", "num_text", "clean_num_text"]), _agent_sql()),
    "clean_basic": Query(lambda s, d: _recipe(s, d, "basic", ["id", "price", "sparse80", "clean_num_text"]), _basic_sql()),
    "clean_report": Query(
        _recipe_report,
        with_d(
            f"""WITH u AS (SELECT DISTINCT * FROM d)
SELECT 'before' AS step, NULL AS "column", 'columns' AS metric, 11.0::DOUBLE AS value
UNION ALL SELECT 'before', NULL, 'rows', ({_D2}) UNION ALL SELECT 'duplicates', NULL, 'removed', ({_D2})-({_U2}) UNION ALL SELECT 'duplicates', NULL, 'rows', ({_U2})
UNION ALL SELECT 'drop_missing', 'sparse80', 'missing_share', round(1-count(sparse80)::DOUBLE/count(*),4) FROM u
UNION ALL SELECT 'drop_missing', 'sparse95', 'missing_share', round(1-count(sparse95)::DOUBLE/count(*),4) FROM u
UNION ALL SELECT 'drop_constant', 'const_col', 'dropped', 1.0 UNION ALL SELECT 'after', NULL, 'columns', 8.0"""
        ),
    ),
}
