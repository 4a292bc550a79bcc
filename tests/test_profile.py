import math

import numpy as np
import pandas as pd
import pytest

from tabwright.operators import correlation, frequencies, profile
from tabwright.operators import quantiles as q
from tabwright.operators.moments import base_stats


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=500), "b": rng.integers(0, 5, 500), "c": rng.exponential(size=500), "s": rng.choice(list("xyz"), 500)})
    pdf["d"] = pdf["a"] * 2 + rng.normal(size=500) * 0.1
    pdf.loc[::7, "a"] = np.nan
    pdf.loc[::11, "c"] = np.nan
    return pdf, spark.createDataFrame(pdf)


def by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def test_numeric_stats_agree_with_pandas(mixed):
    pdf, df = mixed
    got = by_column(profile.numeric_stats(df))
    for c in ("a", "b", "c", "d"):
        s = pdf[c].dropna()
        want = {
            "mean": s.mean(), "median": s.median(), "std": s.std(), "min": s.min(), "max": s.max(),
            "skewness": s.skew(), "kurtosis": s.kurtosis(), "zeros_pct": (s == 0).mean() * 100,
        }
        for k, w in want.items():
            assert got[c][k] == pytest.approx(w, abs=6e-3 if k == "zeros_pct" else 6e-5), (c, k)


def test_numeric_stats_edges(frame):
    one = by_column(profile.numeric_stats(frame("x double", 3.0)))["x"]
    assert (one["mean"], one["median"], one["std"], one["skewness"], one["kurtosis"]) == (3.0, 3.0, None, None, None)
    none = by_column(profile.numeric_stats(frame("x double", None, float("nan"))))["x"]
    assert none["mean"] is None and none["median"] is None and none["zeros_pct"] == 0.0
    flat = by_column(profile.numeric_stats(frame("x double", 0.1, 0.1, 0.1, 0.1, 0.1)))["x"]
    assert (flat["std"], flat["skewness"], flat["kurtosis"]) == (0.0, 0.0, 0.0)
    assert profile.numeric_stats(frame("s string", "a")).count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double, s string")
    assert profile.missing_profile(df).count() == 0
    assert profile.missing_totals(df).first().asDict() == {"total_missing_cells": 0, "total_cells": 0, "overall_missing_pct": None}
    assert profile.duplicate_profile(df).first().asDict() == {"duplicate_rows": 0, "duplicate_pct": 0.0, "total_rows": 0}
    assert profile.quality_profile(df).first().asDict() == {"completeness": 0.0, "uniqueness": 0.0, "numeric_ratio": 50.0}
    assert profile.completeness(df).first()[0] == 100.0
    assert profile.load_summary(df).first()["rows"] == 0
    assert profile.local_report(df).where("section = 'shape'").count() == 2
    assert profile.column_profile(df, "x").first()["non_null"] == 0


def test_duplicates_treat_null_and_nan_as_equal(frame):
    df = frame("x double, s string", (None, "a"), (None, "a"), (float("nan"), "b"), (float("nan"), "b"), (1.0, None), (1.0, None))
    assert profile.duplicate_profile(df).first()["duplicate_rows"] == 3


def test_correlations_are_pairwise_complete(mixed):
    pdf, df = mixed
    want = pdf[["a", "b", "c", "d"]].corr()
    pairs = correlation.collect_pairs(df)
    assert len(pairs) == 6
    for a, b, r in pairs:
        assert r == pytest.approx(want.loc[a, b], abs=1e-10)


def test_correlations_of_large_offsets_and_infinite_values(spark):
    df = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS x", "1e9D + (id % 2) AS y", "IF(id = 7, double('Infinity'), CAST(id AS DOUBLE)) AS z")
    pdf = df.toPandas()
    assert [(a, b) for a, b, _ in correlation.collect_pairs(df)] == [("x", "y")]
    assert correlation.collect_pairs(df)[0][2] == pytest.approx(pdf["x"].corr(pdf["y"] - 1e9), abs=1e-12)


def test_constant_column_has_no_correlation(frame):
    df = frame("a double, b double, c double", (1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (3.0, 5.0, 6.5))
    assert [(a, b) for a, b, _ in correlation.collect_pairs(df)] == [("a", "c")]
    # Constant only where both are present.
    gaps = frame("a double, b double", (1.0, 7.0), (2.0, 7.0), (None, 9.0), (3.0, None))
    assert correlation.collect_pairs(gaps) == []


def test_value_counts_break_ties_by_value(frame):
    df = frame("s string", "b", "a", "b", "a", "c", None)
    assert [(r["rank"], r["value"], r["count"]) for r in frequencies.value_counts(df, "s", 2).collect()] == [(1, "a", 2), (2, "b", 2)]
    assert frequencies.column_modes(df, ["s"]) == {"s": ("a", 5, 3)}


def test_column_profile_kinds_share_a_schema(frame):
    df = frame("x double, s string", (1.0, "b"), (2.0, "a"), (None, "a"))
    num, text = profile.column_profile(df, "x"), profile.column_profile(df, "s")
    assert num.schema.names == text.schema.names
    assert num.first()["median"] == 1.5 and num.first()["missing_pct"] == 33.3
    assert text.first()["top_value"] == "a" and text.first()["top_count"] == 2


def test_unknown_column_is_refused(frame):
    with pytest.raises(ValueError, match="available"):
        profile.column_profile(frame("x double", 1.0), "nope")


# --- exact quantiles ---------------------------------------------------------------------------


@pytest.fixture
def tight():
    """Small limits, so that sampling, several rounds and ranking all happen on little data."""
    saved = q.RANKABLE, q.MIN_SAMPLE, q.MAX_SAMPLE
    q.RANKABLE, q.MIN_SAMPLE, q.MAX_SAMPLE = 20, 100, 200
    yield
    q.RANKABLE, q.MIN_SAMPLE, q.MAX_SAMPLE = saved


PS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("shape", ["normal", "hot", "two_values", "heavy_tail", "integers"])
def test_quantiles_are_exact(spark, tight, shape):
    rng = np.random.default_rng(1)
    n = 5000
    x = {
        "normal": rng.normal(size=n),
        "hot": np.where(rng.random(n) < 0.4, 3.0, rng.normal(size=n) * 5),
        "two_values": rng.integers(0, 2, n).astype(float),
        "heavy_tail": np.exp(rng.normal(size=n) * 20),
        "integers": rng.integers(0, 10**12, n),
    }[shape]
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = q.quantiles(df, {"x": PS})["x"]
    np.testing.assert_allclose(got, np.quantile(x, PS), rtol=1e-12)


def test_quantiles_of_few_rows(frame):
    assert q.quantiles(frame("x double", 5.0), {"x": [0.5]}) == {"x": [5.0]}
    assert q.quantiles(frame("x double", 1.0, 2.0), {"x": [0.25, 0.5]}) == {"x": [1.25, 1.5]}
    assert q.quantiles(frame("x double", None), {"x": [0.5]}) == {"x": [None]}


def test_order_statistics_of_large_integers(spark):
    # Beyond 2**53 a DOUBLE cannot tell neighbours apart.
    base = 2**60
    df = spark.range(1000).selectExpr(f"id + {base}L AS k")
    got = q.order_statistics(df, {"k": [1, 500, 1000]}, {"k": (base, base + 999)}, {"k": 1000})
    assert got == {"k": {1: base, 500: base + 499, 1000: base + 999}}


def test_order_statistics_over_the_whole_integer_range(spark, tight):
    rng = np.random.default_rng(2)
    x = np.sort(rng.integers(-(2**63), 2**63 - 1, 3000))
    df = spark.createDataFrame(pd.DataFrame({"k": x}))
    ranks = [1, 2, 999, 1500, 3000]
    got = q.order_statistics(df, {"k": ranks}, {"k": (int(x[0]), int(x[-1]))}, {"k": 3000})
    assert got == {"k": {r: int(x[r - 1]) for r in ranks}}


def test_bisection_alone_converges(spark, tight, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.exp(rng.normal(size=2000))
    monkeypatch.setattr(q, "_narrow", lambda df, targets, turn: q._halves(targets))
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    np.testing.assert_allclose(q.quantiles(df, {"x": [0.3]})["x"], np.quantile(x, [0.3]), rtol=1e-12)


def test_approximate_quantiles_are_close(mixed):
    pdf, df = mixed
    assert q.quantiles(df, {"d": [0.5]}, exact=False)["d"][0] == pytest.approx(pdf["d"].median(), abs=0.05)


def test_base_stats_ignore_nan(frame):
    b = base_stats(frame("x double", 1.0, float("nan"), None, 3.0), ["x"])
    assert b.rows == 4 and b["x"].n == 2 and b["x"].mean == 2.0 and not math.isnan(b["x"].high)
