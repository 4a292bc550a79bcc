import datetime as dt
import math

import pandas as pd
import pytest

from tabwright.operators import clean, features
from tabwright.plans.recipes import clean as run_recipe


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_dedup_keeps_one_copy(frame):
    df = frame("x double, s string", (None, "a"), (None, "a"), (float("nan"), "a"), (float("nan"), "a"), (1.0, "b"))
    assert clean.remove_duplicates(df).count() == 3


def test_drop_missing_is_strict(frame):
    df = frame("a double, b double, k int", (1.0, None, 1), (None, None, 2), (None, float("nan"), 3), (2.0, None, 4))
    assert clean.fit_drop_missing(df, 0.5).columns == ("b",)
    assert clean.fit_drop_missing(df, 0.49).columns == ("a", "b")


def test_impute_numeric(frame):
    df = frame("x double, i int", (1.0, 1), (float("nan"), None), (None, 2), (4.0, 2))
    assert rows(clean.fit_impute_numeric(df).transform(df)) == [(1.0, 1), (2.5, 2), (2.5, 2), (4.0, 2)]
    fractional = clean.fit_impute_numeric(df, "mean").transform(df)
    assert dict(fractional.dtypes)["i"] == "double"
    assert rows(clean.fit_impute_numeric(df, "zero").transform(df))[1] == (0.0, 0)
    assert clean.fit_impute_numeric(df, "whatever").values == clean.fit_impute_numeric(df).values


def test_impute_categorical(frame):
    df = frame("s string, t string", ("b", None), ("a", None), ("b", None), ("a", None), (None, None))
    got = rows(clean.fit_impute_categorical(df).transform(df))
    assert got[-1] == ("a", "Unknown")
    assert rows(clean.fit_impute_categorical(df, "unknown").transform(df))[-1] == ("Unknown", "Unknown")


def test_cap_outliers_needs_ten_values(frame):
    few = frame("x double", *[1.0] * 8, 100.0)
    assert clean.fit_cap_outliers(few).bounds == ()
    many = frame("x double", *[float(i) for i in range(12)], 500.0, None)
    plan = clean.fit_cap_outliers(many)
    s = pd.Series([*range(12), 500.0])
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    assert plan.bounds[0][1:] == pytest.approx((q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))
    assert [r[0] for r in rows(plan.transform(many))][-2:] == [plan.bounds[0][2], None]


def test_zero_iqr_rule(frame):
    df = frame("x double", *[5.0] * 20, 9.0)
    assert clean.fit_cap_outliers(df, positive_iqr_only=True).bounds == ()
    assert clean.fit_cap_outliers(df).bounds == (("x", 5.0, 5.0),)


def test_normalize_text_keeps_null(frame):
    df = frame("s string", "\t A b\n", None)
    assert rows(clean.normalize_text(df)) == [("a b",), (None,)]
    assert rows(clean.normalize_text(df, lower=False)) == [("A b",), (None,)]


def test_drop_constant(frame):
    df = frame("a double, b string, c double, d int", (1.0, "x", None, 1), (1.0, None, None, 2), (float("nan"), "x", None, 3))
    assert clean.fit_drop_constant(df).columns == ("a", "b", "c")


def test_fix_dtypes_rules(frame):
    df = frame(
        "n string, m string, d string, e string, t string",
        ("1", "1", "2024-01-02", "1.5", "a"), ("2", "2", "01/03/2024", "", "b"), ("3", "x", "Jan 4, 2024", "nan", "c"), (None, "4", None, "2", "1"),
    )
    majority = dict(clean.fit_fix_dtypes(df).casts)
    assert majority == {"n": "bigint", "m": "bigint", "d": "timestamp"}  # half of e parses, which is not a majority
    strict = dict(clean.fit_fix_dtypes(df, strict=True).casts)
    assert strict == {"n": "bigint", "d": "timestamp", "e": "double"}
    fixed = rows(clean.fit_fix_dtypes(df).transform(df))
    assert fixed[2][:3] == (3, None, dt.datetime(2024, 1, 4))


def test_recipes_on_a_small_table(frame):
    df = frame("id int, x double, s string, k string", *[(i, float(i) if i % 3 else None, " v ", "K") for i in range(30)], (0, None, " v ", "K"))
    done = run_recipe(df, "agent")
    assert done.data.count() == 30 and done.data.columns == ["id", "x"]
    report = {(r["step"], r["metric"]): r["value"] for r in done.report().collect()}
    assert report[("before", "rows")] == 31.0 and report[("duplicates", "removed")] == 1.0
    basic = run_recipe(df, "basic", steps=("text",))
    assert basic.data.select("s").distinct().collect()[0]["s"] == "v"
    with pytest.raises(ValueError):
        run_recipe(df, "nope")


def test_basic_recipe_fills_dates_and_booleans(spark):
    df = spark.sql("SELECT * FROM VALUES (1, DATE'2024-01-01', true), (2, NULL, true), (3, DATE'2024-01-01', NULL), (4, DATE'2024-02-02', false) AS t(id, d, b)")
    got = rows(run_recipe(df, "basic", steps=("missing",)).data.orderBy("id"))
    assert got[1][1] == dt.date(2024, 1, 1) and got[2][2] is True


# --- features ------------------------------------------------------------------------------------


def test_label_encode_gives_missing_its_own_class(frame):
    df = frame("s string", "z", "a", None, "o", "a")
    assert [r[0] for r in rows(features.fit_label_encode(df).transform(df))] == [3, 0, 1, 2, 0]


@pytest.mark.parametrize("limit", [1 << 20, 1000])
def test_label_encode_of_many_values(spark, monkeypatch, limit):
    monkeypatch.setattr(features, "BROADCAST_BYTES", limit)
    df = spark.range(300).selectExpr("id", "concat('v', lpad(id, 4, '0')) AS s")
    plan = features.fit_label_encode(df)
    assert plan.tables and plan.tables[0][2] is (limit > 1000)
    assert all(i == c for i, c in rows(plan.transform(df)))


def test_one_hot(frame):
    df = frame("k int, s string, c string", (1, "b", "only"), (2, "a", "only"), (3, None, "only"), (4, "c", "only"))
    plan = features.fit_one_hot(df)
    out = df
    for p in plan:
        out = p.transform(out)
    assert out.columns == ["k", "s_b", "s_c"]
    assert rows(out.orderBy("k")) == [(1, 1, 0), (2, 0, 0), (3, 0, 0), (4, 0, 1)]
    assert features.fit_one_hot(df, max_cardinality=2)[0].inline[0][0] == "s"


def test_interactions_keep_the_target_out(frame):
    df = frame("a int, b int, y double", *[(i, 2 * i, float(i * i)) for i in range(1, 6)])
    assert features.fit_interactions(df, 3, exclude=["y"]).pairs == (("a", "b"),)
    assert rows(features.fit_interactions(df, 1, exclude=["y"]).transform(df))[1][-1] == 8.0


def test_date_features_start_weeks_on_monday(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 10:00:00' AS t")
    assert rows(features.fit_date_features(df).transform(df)) == [(2024, 1, 0)]


def test_log_transform_needs_positive_values(frame):
    df = frame("a double, b double", (1.0, 0.0), (1.0, 1.0), (1.0, 2.0), (500.0, 3.0))
    plan = features.fit_log_transform(df, ["a", "b", "zzz"])
    assert plan.columns == ("a",)
    assert rows(plan.transform(df))[3][-1] == pytest.approx(math.log(501))
    skew = features.skewness_of(df, ["a", "b"])
    assert skew["a"] == pytest.approx(pd.Series([1, 1, 1, 500.0]).skew()) and skew["b"] == pytest.approx(0.0)


def test_log_transform_of_named_columns_whatever_their_signs(frame):
    df = frame("a double, b double", (0.0, 1.0), (None, -1.0), (1.0, -2.0))
    plan = features.fit_log_transform(df, ["a", "b"], always=True)
    assert plan.columns == ("a", "b")
    assert [r[2:] for r in rows(plan.transform(df))] == [(0.0, pytest.approx(math.log(2))), (None, None), (pytest.approx(math.log(2)), None)]


def test_log_transform_query_with_a_value_of_zero(spark, tmp_path):
    from tabwright.registry.features import QUERIES

    spark.sql("SELECT id AS event_id, IF(id = 3, NULL, CAST(id AS DOUBLE)) AS value FROM range(5)").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(rows(QUERIES["log_transform"].run(spark, str(tmp_path))))
    assert got == [(i, None if i == 3 else pytest.approx(math.log1p(i), abs=1e-6)) for i in range(5)]


def test_low_variance_and_high_correlation(frame):
    df = frame("k int, a double, b double, c double, d double", *[(i, float(i), i * 2.0, i * 3.0 + (i % 2), 0.001 * (i % 2)) for i in range(10)])
    assert features.fit_drop_low_variance(df).columns == ("d",)
    assert features.fit_drop_low_variance(df, exclude=["d"]).columns == ()
    assert features.fit_drop_high_correlation(df, exclude=["k"]).columns == ("b", "c")


def test_standard_scale_handles_constants(frame):
    df = frame("a double, b double", (1.0, 7.0), (2.0, 7.0), (3.0, 7.0))
    got = rows(features.fit_standard_scale(df).transform(df))
    assert [r[0] for r in got] == pytest.approx([-1.224744871, 0.0, 1.224744871]) and [r[1] for r in got] == [0.0, 0.0, 0.0]
