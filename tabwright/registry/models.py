"""Registered queries: task detection, splits, folds, metrics, nearest neighbours and training."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts, folds, knn, metrics, models as ops
from ..operators.ordering import with_position
from .base import Query, rounded, sql_top, table, union_all



def _split_sql(src, key):
    p = folds.HASH_MODULUS
    x = f"(({key} % {p} + 42) % {p} * {folds.HASH_MULTIPLIER} % {p})"
    h = f"(({x} * {x} % {p}) * ({x} * {x} % {p}) % {p} * {x} % {p})"
    return f"SELECT *, row_number() OVER (ORDER BY {h}) <= ceil((SELECT count(*) FROM {src})*0.2) AS is_test FROM {src}"


SPLIT = _split_sql("orders", "o_orderkey")

def _strat_sql(label):
    return f"""WITH c AS (SELECT {label} AS s, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1),
p AS (SELECT s, n, sum(n) OVER (ORDER BY f) - n AS a, sum(n) OVER (ORDER BY f) AS b FROM c),
z AS (SELECT s, i, (b+4-i)//5-(a+4-i)//5 AS sz FROM p CROSS JOIN range(5) t(i)),
e AS (SELECT s, i, sum(sz) OVER (PARTITION BY s ORDER BY i) AS upto FROM z),
r AS (SELECT o_orderkey, {label} AS s, row_number() OVER (PARTITION BY {label} ORDER BY o_orderkey)-1 AS k FROM orders)
SELECT o_orderkey, count(*) FILTER (WHERE e.upto<=r.k)::INTEGER AS fold FROM r JOIN e ON e.s=r.s AND e.i<4 GROUP BY o_orderkey"""



# A rule that predicts the order status from the price, and a line for the part price.
GUESS = "CASE WHEN o_totalprice > 200000 THEN 'O' WHEN o_totalprice > 50000 THEN 'F' ELSE 'P' END"

_KIND = "list_position(['click','error','purchase','signup','view'], b.event_type)::DOUBLE"
_D2 = "(a.user_id-b.user_id)::DOUBLE*(a.user_id-b.user_id)::DOUBLE+(a.value-b.value)*(a.value-b.value)"
_D1 = "(a.user_id-b.user_id)::DOUBLE*(a.user_id-b.user_id)::DOUBLE"


def _near_sql(label, d2):
    """The five nearest training rows of every test row, by comparing all pairs."""
    return f"""WITH s AS ({_split_sql("events", "event_id")}), n AS (SELECT a.event_id AS query_id, b.event_id AS train_id, {label} AS label, {d2} AS d2,
row_number() OVER (PARTITION BY a.event_id ORDER BY {d2}, b.event_id) AS rank FROM s a JOIN s b ON a.is_test AND NOT b.is_test)"""


def _events(spark, sf):
    types = "array('click','error','purchase','signup','view')"
    return table(spark, sf, "events").selectExpr("event_id", "user_id", "value", f"CAST(array_position({types}, event_type) AS DOUBLE) AS kind")


def _neighbours(spark, sf):
    train, test = folds.train_test_split(_events(spark, sf), "event_id")
    near = knn.nearest(train, test, ["user_id", "value"], "event_id", "event_id", "kind")
    return rounded(near.select("query_id", "rank", "train_id", "distance2"), 6)


def _knn(spark, sf, features, label, task):
    train, test = folds.train_test_split(_events(spark, sf), "event_id")
    return rounded(knn.knn_predict(train, test, features, "event_id", "event_id", label, task), 6)


def _near_by(features):
    """The five nearest training orders of every test order."""

    def run(spark, sf):
        orders = table(spark, sf, "orders").selectExpr("o_orderkey", *[f"CAST({e} AS DOUBLE) AS {n}" for n, e in features.items()], "1.0D AS label")
        train, test = folds.train_test_split(orders, "o_orderkey")
        near = knn.nearest(train, test, list(features), "o_orderkey", "o_orderkey", "label")
        return rounded(near.select("query_id", "rank", "train_id", "distance2"), 6)

    d2 = "+".join(f"(a.{n}-b.{n})*(a.{n}-b.{n})" for n in features)
    cols = ", ".join(f"({e})::DOUBLE AS {n}" for n, e in features.items())
    sql = f"""WITH s AS (SELECT o_orderkey, is_test, {cols} FROM ({SPLIT})),
n AS (SELECT a.o_orderkey AS query_id, b.o_orderkey AS train_id, {d2} AS d2, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY {d2}, b.o_orderkey) AS rank FROM s a JOIN s b ON a.is_test AND NOT b.is_test)
SELECT query_id, rank::INTEGER AS rank, train_id, round(d2,6) AS distance2 FROM n WHERE rank<=5"""
    return Query(run, sql)


_VOTES = f"""{_near_sql(_KIND, _D2)}, v AS (SELECT query_id, label, count(*) AS c FROM n WHERE rank<=5 GROUP BY 1,2)
SELECT query_id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, label) AS r FROM v) WHERE r=1"""


def _orders(spark, sf):
    """Orders with a priority rank and the day, and the status as target."""
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey", "o_totalprice", "CAST(left(o_orderpriority,1) AS INT) AS priority_rank", "CAST(datediff(o_orderdate, DATE'1990-01-01') AS INT) AS day", "o_orderstatus"
    )


def _events_xy(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_id", "CAST(user_id AS DOUBLE) AS user_id", "CAST(hour(ts) AS DOUBLE) AS hour", "CAST(get_json_object(props, '$.k') AS DOUBLE) AS k", "value"
    )


def _lines(spark, sf):
    return table(spark, sf, "part").selectExpr("p_partkey", "CAST(p_size AS DOUBLE) AS p_size", "length(p_name) AS name_length", "p_retailprice")


def _page(spark, sf, names, folds_n=5, **sizes):
    out = ops.train_on_split(_orders(spark, sf), "o_orderstatus", "o_orderkey", names, folds=folds_n, **sizes)
    return out.drop("train_time")


def _reg(spark, sf, names, folds_n=3, **sizes):
    return ops.train_models(_events_xy(spark, sf), "value", "event_id", names, folds_n, **sizes)


_WF1 = f"""SELECT accuracy, f1_weighted, rows FROM (WITH g AS (SELECT o_orderstatus AS y, {GUESS} AS p FROM orders),
c AS (SELECT c, sum(s) AS s, sum(q) AS q, sum(tp) AS tp FROM (SELECT y AS c, 1 AS s, 0 AS q, CASE WHEN y=p THEN 1 ELSE 0 END AS tp FROM g UNION ALL SELECT p, 0, 1, 0 FROM g) GROUP BY 1)
SELECT round(sum(tp)::DOUBLE/sum(s),6) AS accuracy, round(sum(s*2.0*tp::DOUBLE/(s+q))/sum(s),6) AS f1_weighted, sum(s)::BIGINT AS rows FROM c)"""

def _plane(src, x, y, z, penalty=0.0, where="true"):
    """Intercept a and slopes b1, b2 of z over x and y with a ridge penalty on the summed squares, from covariances."""
    return f"""(SELECT mz - b1*mx - b2*my AS a, b1, b2 FROM (SELECT (cxz*vyy - cyz*vxy)/(vxx*vyy - vxy*vxy) AS b1, (cyz*vxx - cxz*vxy)/(vxx*vyy - vxy*vxy) AS b2, mx, my, mz
FROM (SELECT var_pop({x})*count(*)+{penalty} AS vxx, var_pop({y})*count(*)+{penalty} AS vyy, covar_pop({x},{y})*count(*) AS vxy, covar_pop({x},{z})*count(*) AS cxz, covar_pop({y},{z})*count(*) AS cyz,
avg({x}) AS mx, avg({y}) AS my, avg({z}) AS mz FROM {src} WHERE {where})))"""


_TWO = "(SELECT event_id, user_id::DOUBLE AS x, extract(hour FROM ts)::DOUBLE AS y, value AS z, (ntile({k}) OVER (ORDER BY event_id)-1)::INTEGER AS fold FROM events)"


def _cv_sql(model, k, penalty=0.0):
    """One result row of a linear model of two features, cross-validated in k blocks."""
    t = _TWO.format(k=k)
    folds_sql = union_all(
        f"""SELECT {i} AS fold, 1 - sum(pow(z - p.a - p.b1*x - p.b2*y, 2))/(var_pop(z)*count(*)) AS r2 FROM {t}, {_plane(t, "x", "y", "z", penalty, f"fold <> {i}")} p WHERE fold = {i}"""
        for i in range(k)
    )
    return f"""SELECT '{model}' AS model, 'regression' AS task_type, 'r2' AS metric, {', '.join(f'max(round(r2,4)) FILTER (WHERE fold = {i}) AS fold{i}' for i in range(k))}, round(avg(r2),4) AS mean_score, round(stddev_pop(r2),4) AS std_score,
2::INTEGER AS features_used, (SELECT count(*) FROM events)::BIGINT AS samples_used FROM ({folds_sql})"""


def _scores(results, k):
    """Result rows with one column for each fold's score."""
    each = [F.col("cv_scores")[i].alias(f"fold{i}") for i in range(k)]
    return results.select("model", "task_type", "metric", *each, "mean_score", "std_score", "features_used", "samples_used")


def _two_features(spark, sf, names, k):
    df = table(spark, sf, "events").selectExpr("event_id", "CAST(user_id AS DOUBLE) AS user_id", "CAST(hour(ts) AS DOUBLE) AS hour", "value")
    return ops.train_models(df, "value", "event_id", names, k)


#: Targets that follow from a number and a text.
_BANDS = "CASE WHEN o_totalprice > 300000 OR left(o_orderpriority, 1) = '1' THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END"
_SLOPE = "o_totalprice / 100000 + 0.5 * (length(o_orderpriority) - 8) * (length(o_orderpriority) - 8) / 4"


def _mixed(spark, sf, target):
    """Numbers, texts and gaps with a target that follows from them."""
    return table(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice", "o_orderpriority", "length(o_orderpriority) AS width", "IF(o_custkey % 7 = 0, NULL, o_custkey) AS customer", "o_orderstatus", f"{target} AS target")


def _learned(results, score, least):
    """What can be checked of trained models: which ones, none failed, scores on the held-out rows and in the folds."""
    return results.selectExpr("model", "task_type", "error IS NULL AS trained", f"coalesce({score} > {least}, false) AS learned", f"coalesce(cv_mean > {least}, false) AS folds_learned")


def _learned_sql(names, task):
    return union_all(f"SELECT '{n}' AS model, '{task}' AS task_type, true AS trained, true AS learned, true AS folds_learned" for n in names)


QUERIES = {
    "detect_task": Query(
        lambda s, d: ops.detect_task(table(s, d, "orders"), "o_orderstatus"),
        f"""SELECT 'task_type' AS metric, NULL::DOUBLE AS value, 'classification' AS text UNION ALL SELECT 'unique_values', count(DISTINCT o_orderstatus)::DOUBLE, NULL FROM orders
UNION ALL SELECT 'class ' || rank, count::DOUBLE, value FROM ({sql_top('orders', 'o_orderstatus', 5)})""",
    ),
    "detect_task_numeric": Query(
        lambda s, d: ops.detect_task(table(s, d, "events"), "value"),
        """SELECT 'task_type' AS metric, NULL::DOUBLE AS value, 'regression' AS text UNION ALL SELECT 'unique_values', count(DISTINCT value)::DOUBLE, NULL FROM events
UNION ALL SELECT 'mean', round(avg(value),4), NULL FROM events UNION ALL SELECT 'std', round(stddev_samp(value),4), NULL FROM events
UNION ALL SELECT 'min', round(min(value),4), NULL FROM events UNION ALL SELECT 'max', round(max(value),4), NULL FROM events""",
    ),
    "detect_task_simple": Query(
        lambda s, d: s.createDataFrame([(c, ops.task_of_simple(table(s, d, "lineitem"), c)) for c in ("l_linenumber", "l_quantity", "l_returnflag")], "column string, task_type string"),
        union_all(
            f"""SELECT '{c}' AS "column", CASE WHEN count(DISTINCT {c})>20 AND {n} THEN 'regression' ELSE 'classification' END AS task_type FROM lineitem"""
            for c, n in (("l_linenumber", "true"), ("l_quantity", "true"), ("l_returnflag", "false"))
        ),
    ),
    "train_test_split": Query(lambda s, d: folds.with_split(table(s, d, "orders"), "o_orderkey").select("o_orderkey", "is_test"), f"SELECT o_orderkey, is_test FROM ({SPLIT})"),
    "block_folds": Query(
        lambda s, d: folds.with_block_folds(table(s, d, "events"), "event_id", 7).select("event_id", "fold"),
        "SELECT event_id, (ntile(7) OVER (ORDER BY event_id)-1)::INTEGER AS fold FROM events",
    ),
    "block_folds_by_time": Query(
        lambda s, d: folds.with_block_folds(table(s, d, "events"), "ts", 5).groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts")),
        "SELECT fold, count(*) AS rows, min(ts) AS first_ts FROM (SELECT ts, (ntile(5) OVER (ORDER BY ts)-1)::INTEGER AS fold FROM events) GROUP BY 1",
    ),
    "stratified_folds": Query(lambda s, d: folds.with_stratified_folds(table(s, d, "orders"), "o_orderstatus", "o_orderkey", 5).select("o_orderkey", "fold"), _strat_sql("o_orderstatus")),
    "stratified_folds_many_classes": Query(
        lambda s, d: folds.with_stratified_folds(table(s, d, "orders").withColumn("c", F.col("o_custkey") % 1500), "c", "o_orderkey", 5).select("o_orderkey", "fold"),
        _strat_sql("(o_custkey % 1500)"),
    ),
    "positions_with_ties": Query(
        lambda s, d: with_position(table(s, d, "orders"), ["o_orderstatus"]).groupBy("o_orderstatus").agg(F.count_distinct("position").alias("rows"), F.min("position").alias("first"), F.max("position").alias("last")),
        """SELECT o_orderstatus, count(*) AS rows, (sum(count(*)) OVER (ORDER BY o_orderstatus) - count(*))::BIGINT AS first, (sum(count(*)) OVER (ORDER BY o_orderstatus) - 1)::BIGINT AS last FROM orders GROUP BY 1""",
    ),
    "classification_metrics": Query(
        lambda s, d: rounded(metrics.classification_metrics(table(s, d, "orders").selectExpr("o_orderstatus AS label", f"{GUESS} AS prediction"))), _WF1
    ),
    "confusion_table": Query(
        lambda s, d: metrics.confusion(table(s, d, "orders").selectExpr("o_orderstatus AS label", f"{GUESS} AS prediction"), "label", "prediction"),
        f"SELECT o_orderstatus AS label, {GUESS} AS prediction, count(*) AS n FROM orders GROUP BY 1,2",
    ),
    "regression_metrics": Query(
        lambda s, d: rounded(metrics.regression_metrics(table(s, d, "part").selectExpr("p_retailprice AS label", "900 + p_partkey*0.05 AS prediction")), 6),
        """SELECT round(1-sum(pow(y-p,2))/(var_pop(y)*count(*)),6) AS r2, round(sqrt(avg(pow(y-p,2))),6) AS rmse, count(*) AS rows
FROM (SELECT p_retailprice AS y, 900+p_partkey*0.05 AS p FROM part)""",
    ),
    "nearest_neighbours": Query(
        _neighbours,
        f"{_near_sql('b.value', _D2)} SELECT query_id, rank::INTEGER AS rank, train_id, round(d2,6) AS distance2 FROM n WHERE rank<=5",
    ),
    "knn_classify": Query(lambda s, d: _knn(s, d, ["user_id", "value"], "kind", "classification"), _VOTES),
    "knn_regress": Query(
        lambda s, d: _knn(s, d, ["user_id"], "value", "regression"),
        f"{_near_sql('b.value', _D1)} SELECT query_id, round(avg(label),6) AS prediction FROM n WHERE rank<=5 GROUP BY 1",
    ),
    # Half of all orders are one point; distances tie by the thousand.
    "knn_hot_cell": _near_by({"price": "CASE WHEN o_orderkey % 2 = 0 THEN 1000 ELSE o_totalprice END", "rank": "CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE o_custkey END"}),
    # Most orders lie close together, a few far out in the middle of nowhere.
    "knn_sparse_cells": _near_by({"price": "CASE WHEN o_orderkey % 100 = 7 THEN floor(o_totalprice) * 100 ELSE floor(o_totalprice) END", "cust": "CASE WHEN o_orderkey % 100 = 7 THEN o_custkey * 1000 ELSE o_custkey END"}),
    "knn_six_features": _near_by({"a": "o_totalprice", "b": "o_custkey", "c": "o_orderkey % 97", "d": "o_orderkey % 31", "e": "o_custkey % 13", "f": "length(o_orderpriority)"}),
    "linear_fit": Query(
        lambda s, d: rounded(ops.linear_coefficients(_lines(s, d), "p_retailprice", "p_partkey"), 5),
        f"""WITH p AS {_plane("part", "p_size", "length(p_name)", "p_retailprice")}
SELECT 'intercept' AS term, round(a,5) AS value FROM p UNION ALL SELECT 'p_size', round(b1,5) FROM p UNION ALL SELECT 'name_length', round(b2,5) FROM p""",
    ),
    "ridge": Query(
        lambda s, d: rounded(ops.linear_coefficients(_lines(s, d), "p_retailprice", "p_partkey", "ridge"), 4),
        f"""WITH p AS {_plane("part", "p_size", "length(p_name)", "p_retailprice", 1.0)}
SELECT 'intercept' AS term, round(a,4) AS value FROM p UNION ALL SELECT 'p_size', round(b1,4) FROM p UNION ALL SELECT 'name_length', round(b2,4) FROM p""",
    ),
    "lasso": Query(
        lambda s, d: rounded(ops.linear_coefficients(_lines(s, d).selectExpr("p_partkey AS id", "CAST(p_partkey AS DOUBLE) AS x", "p_partkey*2.0D + p_size AS y"), "y", "id", "lasso"), 3),
        """WITH m AS (SELECT p_partkey::DOUBLE AS x, p_partkey*2.0+p_size AS y FROM part), b AS (SELECT sign(covar_pop(y,x))*greatest(abs(covar_pop(y,x))-1.0,0)/var_pop(x) AS w, avg(y) AS my, avg(x) AS mx FROM m)
SELECT 'x' AS term, round(w,3) AS value FROM b UNION ALL SELECT 'intercept', round(my-w*mx,3) FROM b""",
    ),
    "cross_validate": Query(lambda s, d: _scores(_two_features(s, d, ["linear_regression", "ridge"], 5), 5), f"{_cv_sql('linear_regression', 5)} UNION ALL {_cv_sql('ridge', 5, 1.0)}"),
    "cross_validate_three_features": Query(lambda s, d: _reg(s, d, ["linear_regression"], 5)),
    "logistic": Query(lambda s, d: _page(s, d, ["logistic_regression"], 5)),
    "random_forest": Query(lambda s, d: _page(s, d, ["random_forest"], 5)),
    "random_forest_regression": Query(lambda s, d: _reg(s, d, ["random_forest"], 5)),
    "extra_trees": Query(lambda s, d: _page(s, d, ["extra_trees"])),
    "gbt": Query(lambda s, d: ops.train_on_split(_events_xy(s, d), "value", "event_id", ["xgboost", "lightgbm"]).drop("train_time")),
    "gbt_classify": Query(lambda s, d: _page(s, d, ["xgboost"])),
    "svm": Query(lambda s, d: _page(s, d, ["svm"])),
    "svr": Query(lambda s, d: _reg(s, d, ["svr"], 5)),
    "mlp": Query(lambda s, d: _page(s, d, ["mlp"])),
    # Page-style training on text and gaps: three classes, the largest of which has about half of the rows, and a curved number.
    "logistic_learns_bands": Query(
        lambda s, d: _learned(ops.train_on_split(_mixed(s, d, _BANDS), "target", "o_orderkey", ["logistic_regression"]), "accuracy", 0.7), _learned_sql(["logistic_regression"], "classification")
    ),
    "mlp_regress": Query(lambda s, d: _learned(ops.train_on_split(_mixed(s, d, _SLOPE), "target", "o_orderkey", ["mlp"]), "r2", 0.9), _learned_sql(["mlp"], "regression")),
    "knn_cross_validated": Query(lambda s, d: _reg(s, d, ["knn"], 5)),
    "model_ranking": Query(
        lambda s, d: ops.compare_models(_two_features(s, d, ["linear_regression", "ridge", "no_such_model"], 5)).select("rank", "model", "mean_score"),
        f"""SELECT (row_number() OVER (ORDER BY coalesce(mean_score, 0) DESC, model))::INTEGER AS rank, model, mean_score
FROM (SELECT model, mean_score FROM ({_cv_sql('linear_regression', 5)}) UNION ALL SELECT model, mean_score FROM ({_cv_sql('ridge', 5, 1.0)}) UNION ALL SELECT 'no_such_model', NULL)""",
    ),
    "model_ranking_all_linear": Query(lambda s, d: ops.compare_models(_reg(s, d, ["linear_regression", "ridge", "lasso", "no_such_model"], 5))),
    "model_comparison": Query(lambda s, d: charts.model_comparison(_page(s, d, ["logistic_regression", "no_such_model"]), "accuracy")),
    "model_results_export": Query(lambda s, d: ops.export_results(_page(s, d, ["logistic_regression", "no_such_model"]))),
    "feature_importance": Query(lambda s, d: ops.feature_importance(_lines(s, d), "p_retailprice", "p_partkey")),
    "feature_importance_linear": Query(
        lambda s, d: ops.feature_importance(_lines(s, d), "p_retailprice", "p_partkey", "linear_regression"),
        f"""WITH p AS {_plane("part", "p_size", "length(p_name)", "p_retailprice")}
SELECT 'linear_regression' AS model, 'p_size' AS feature, round(abs(b1),4) AS importance FROM p UNION ALL SELECT 'linear_regression', 'name_length', round(abs(b2),4) FROM p""",
    ),
    "explain_last_numeric": Query(lambda s, d: ops.explain_last_numeric(table(s, d, "lineitem"))),
}
