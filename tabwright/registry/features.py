"""Registered queries: feature engineering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ops
from .base import DIRTY_NUMERIC, DIRTY_TEXT, LINE_NUMERIC, Query, dirty, rounded, sql_pairs, table, with_d

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _apply(plans, df):
    for p in plans if isinstance(plans, list) else [plans]:
        df = p.transform(df)
    return df


def _label(c, src="d"):
    return f"CAST(dense_rank() OVER (ORDER BY coalesce({c},'nan'))-1 AS INTEGER) AS {c}"


def _one_hot(spark, sf):
    df = table(spark, sf, "orders")
    return _apply(ops.fit_one_hot(df), df)


def _encode_mixed(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return _apply(ops.fit_encode(df, "onehot"), df)


def _events_sq(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", "value", "value*value AS value_sq")


def _part_gross(spark, sf):
    return table(spark, sf, "part").selectExpr("p_name", "p_size", "p_retailprice", "p_retailprice*1.1D AS gross")


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

QUERIES = {
    "label_encode": Query(
        lambda s, d: ops.fit_label_encode(dirty(s, d)).transform(dirty(s, d)).select("id", *DIRTY_TEXT),
        with_d(f"SELECT id, {', '.join(_label(c) for c in DIRTY_TEXT)} FROM d"),
    ),
    "label_encode_many": Query(
        lambda s, d: ops.fit_label_encode(table(s, d, "customer")).transform(table(s, d, "customer")).select("c_custkey", "c_name", "c_mktsegment"),
        f"SELECT c_custkey, {_label('c_name')}, {_label('c_mktsegment')} FROM customer",
    ),
    "one_hot": Query(
        _one_hot,
        "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, "
        + ", ".join(f"""CAST(o_orderstatus='{v}' AS INTEGER) AS "o_orderstatus_{v}" """ for v in ("O", "P"))
        + ", "
        + ", ".join(f"""CAST(o_orderpriority='{v}' AS INTEGER) AS "o_orderpriority_{v}" """ for v in PRIORITIES[1:])
        + " FROM orders",
    ),
    "one_hot_mixed_cardinality": Query(
        _encode_mixed,
        f"SELECT p_partkey, {_label('p_brand')}, " + ", ".join(f"""CAST(p_type='{v}' AS INTEGER) AS "p_type_{v}" """ for v in TYPES[1:]) + " FROM part",
    ),
    "interactions": Query(
        lambda s, d: rounded(ops.fit_interactions(table(s, d, "part")).transform(table(s, d, "part")).select("p_partkey", "p_partkey_x_p_retailprice", "p_size_x_p_retailprice", "p_partkey_x_p_size"), 4),
        """SELECT p_partkey, round(p_partkey*p_retailprice,4) AS p_partkey_x_p_retailprice, round(p_size*p_retailprice,4) AS p_size_x_p_retailprice,
round(p_partkey::DOUBLE*p_size,4) AS p_partkey_x_p_size FROM part""",
    ),
    "interactions_without_target": Query(
        lambda s, d: rounded(ops.fit_interactions(table(s, d, "part"), exclude=["p_retailprice"]).transform(table(s, d, "part")), 4),
        "SELECT *, round(p_partkey::DOUBLE*p_size,4) AS p_partkey_x_p_size FROM part",
    ),
    "date_features": Query(
        lambda s, d: ops.fit_date_features(table(s, d, "orders")).transform(table(s, d, "orders")),
        """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year,
CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(isodow(o_orderdate)-1 AS INTEGER) AS o_orderdate_dayofweek FROM orders""",
    ),
    "log_transform": Query(
        # Small tables have no value of 0, larger ones do; the column is there in both.
        lambda s, d: rounded(ops.fit_log_transform(table(s, d, "events"), ["value", "event_id"], always=True).transform(table(s, d, "events")).select("event_id", "value_log")),
        "SELECT event_id, round(ln(1+value),6) AS value_log FROM events",
    ),
    "log_transform_auto": Query(
        lambda s, d: rounded(ops.fit_log_transform(_events_sq(s, d)).transform(_events_sq(s, d))),
        "SELECT event_id, round(value,6) AS value, round(value*value,6) AS value_sq, round(ln(1+value*value),6) AS value_sq_log FROM events",
    ),
    "drop_low_variance": Query(
        lambda s, d: ops.fit_drop_low_variance(table(s, d, "lineitem")).transform(table(s, d, "lineitem")),
        "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_shipdate FROM lineitem",
    ),
    "drop_high_corr": Query(
        lambda s, d: ops.fit_drop_high_correlation(_part_gross(s, d)).transform(_part_gross(s, d)),
        "SELECT p_name, p_size, p_retailprice FROM part",
    ),
    "drop_high_corr_report": Query(
        lambda s, d: rounded(ops.fit_drop_high_correlation(_part_gross(s, d)).report(s).select("column", "text", "value"), 4),
        f"""SELECT col_b AS "column", col_a AS text, round(r,4) AS value FROM ({sql_pairs("(SELECT *, p_retailprice*1.1 AS gross FROM part)", ["p_size", "p_retailprice", "gross"])}) WHERE abs(r)>0.95""",
    ),
    "standard_scale": Query(
        lambda s, d: rounded(ops.fit_standard_scale(table(s, d, "lineitem")).transform(table(s, d, "lineitem")).select(*LINE_NUMERIC), 5),
        "SELECT "
        + ", ".join(f"round(({c}-(SELECT avg({c}) FROM lineitem))/(SELECT stddev_pop({c}) FROM lineitem),5) AS {c}" for c in LINE_NUMERIC)
        + " FROM lineitem",
    ),
    "zero_fill": Query(
        lambda s, d: ops.zero_fill(dirty(s, d)).select(*DIRTY_NUMERIC),
        with_d("SELECT " + ", ".join(f"coalesce({c}::DOUBLE,0.0) AS {c}" for c in DIRTY_NUMERIC) + " FROM d"),
    ),
    "append_columns": Query(
        lambda s, d: ops.append_columns(table(s, d, "orders"), {"is_open": F.col("o_orderstatus") == "O"}),
        "SELECT *, o_orderstatus='O' AS is_open FROM orders",
    ),
}
