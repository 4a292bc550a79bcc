"""Properties of the physical plans that keep the operators scalable."""

import pytest

from tabwright.operators import charts, clean, correlation, features, filters, folds, frequencies, profile
from tabwright.operators.ordering import with_position
from tabwright.registry.base import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lines(spark, sf):
    return table(spark, sf, "lineitem")


@pytest.fixture(scope="module")
def orders(spark, sf):
    return table(spark, sf, "orders")


def read_schema(df):
    text = plan(df)
    start = text.rindex("ReadSchema: ")
    return text[start : text.index("\n", start)] if "\n" in text[start:] else text[start:]


def test_scans_read_only_the_columns_they_need(lines):
    assert read_schema(charts.histogram(lines, "l_tax")).endswith("struct<l_tax:double>")
    assert "l_returnflag" not in read_schema(correlation.top_correlations(lines))
    assert "l_quantity" not in read_schema(profile.categorical_stats(lines))


def test_filters_reach_the_scan(orders):
    assert "PushedFilters: [In(o_orderpriority" in plan(filters.rows_of_top_groups(orders, "o_orderpriority", 3))
    assert "IsNotNull(o_orderstatus)" in plan(filters.complete_cases(orders, ["o_orderstatus"]))


def test_top_k_is_limited_below_the_shuffle(orders):
    text = plan(frequencies.top_values(frequencies.freq_table(orders, ["o_orderstatus", "o_orderpriority"]), 5))
    assert text.count("WindowGroupLimit") >= 2
    assert "TakeOrderedAndProject" in plan(frequencies.value_counts(orders, "o_orderpriority", 3))


def test_frequencies_combine_before_the_shuffle(orders):
    assert "partial_count" in plan(frequencies.freq_table(orders, ["o_orderstatus"]))
    assert plan(clean.remove_duplicates(orders)).count("HashAggregate(keys=") == 2


def test_fitted_steps_do_not_shuffle(orders):
    steps = [
        clean.fit_impute_numeric(orders), clean.fit_cap_outliers(orders), clean.fit_fix_dtypes(orders), features.fit_label_encode(orders),
        features.fit_date_features(orders), features.fit_standard_scale(orders, ["o_totalprice"]),
    ]
    df = orders
    for s in steps:
        df = s.transform(df)
    assert "Exchange" not in plan(df)
    for marked in (folds.with_split(orders, "o_orderkey"), folds.with_block_folds(orders, "o_orderkey")):
        assert "Exchange" not in plan(marked)


def test_no_pairwise_joins(lines):
    for df in (
        charts.grid(lines, "l_quantity", "l_tax", "l_discount", 10), charts.density(lines, "l_tax"), charts.overview(lines), profile.local_report(lines),
        charts.pair_panels(lines), charts.scatter_grid(lines, "l_tax", "l_discount"),
    ):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_a_constant_order_key_spreads_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = with_position(spark.range(20_000).selectExpr("id", "1 AS same"), ["same"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert placed.select("position").distinct().count() == 20_000
    assert len(placed.inputFiles()) > 1  # one file for each partition of the sorted copy


def test_stratified_folds_take_as_many_shuffles_for_any_number_of_classes(spark):
    def exchanges(classes):
        return plan(folds.with_stratified_folds(spark.range(3000).selectExpr("id", f"id % {classes} AS y"), "y", "id")).count("Exchange")

    assert exchanges(2) == exchanges(1500)
