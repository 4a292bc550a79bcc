import numpy as np
import pandas as pd
import pytest

from tabwright.operators import charts, ordering


def rows(df):
    return [tuple(r) for r in df.collect()]


EDGES = [1.0, 2.0, 3.0, 4.0, 10.0, 11.0]


def test_histogram_edges(frame):
    got = sorted(rows(charts.histogram(frame("x double", *EDGES), "x", 3)))
    assert [r[3] for r in got] == list(np.histogram(EDGES, 3)[0])
    assert [r[1] for r in got] == pytest.approx(list(np.histogram(EDGES, 3)[1][:-1]))


def test_histogram_of_a_constant(frame):
    got = sorted(rows(charts.histogram(frame("x double", 2.0, 2.0, None), "x", 4)))
    assert [r[3] for r in got] == list(np.histogram([2.0, 2.0], 4)[0])


def test_histogram_of_nothing(frame):
    assert charts.histogram(frame("x double", None), "x").count() == 0


def test_auto_bins():
    assert [charts.auto_bins(n) for n in (5, 400, 10_000)] == [10, 20, 50]


def test_binned_agrees_with_cut(frame):
    df = frame("x double", *EDGES)
    want = pd.cut(pd.Series(EDGES), 3).value_counts().sort_index()
    got = sorted(rows(charts.binned_count(df, "x", 3)))
    assert [r[3] for r in got] == list(want)
    assert [r[1] for r in got] == pytest.approx([i.left for i in want.index], abs=1e-2)
    means = sorted(rows(charts.binned_mean(df, "x", "x", 3)))
    assert [(r[0], r[3]) for r in means] == [(1, 2.5), (3, 10.5)]


def test_cut_of_a_constant(frame):
    assert sum(r[3] for r in rows(charts.binned_count(frame("x double", 5.0, 5.0), "x", 4))) == 2


def test_box(frame):
    got = charts.box_stats(frame("x double", *[float(i) for i in range(1, 10)], 100.0, None)).first()
    s = pd.Series([*range(1, 10), 100.0])
    assert (got["q1"], got["median"], got["q3"]) == tuple(s.quantile([0.25, 0.5, 0.75]))
    assert (got["whisker_low"], got["whisker_high"], got["outliers"]) == (1.0, 9.0, 1)


def test_density_integrates_to_one(spark):
    x = np.random.default_rng(0).normal(size=2000)
    got = charts.density(spark.createDataFrame(pd.DataFrame({"x": x})), "x").toPandas().sort_values("point")
    h = x.std(ddof=1) * len(x) ** -0.2
    want = [np.exp(-0.5 * ((g - x) / h) ** 2).sum() / (len(x) * h * np.sqrt(2 * np.pi)) for g in got["x"]]
    np.testing.assert_allclose(got["density"], want, rtol=1e-9)
    assert np.trapezoid(got["density"], got["x"]) == pytest.approx(1.0, abs=0.01)


def test_density_of_too_little(frame):
    assert charts.density(frame("x double", 1.0), "x").count() == 0
    assert charts.density(frame("x double", 1.0, 1.0), "x").count() == 0


def test_waterfall(frame):
    got = rows(charts.waterfall(frame("s string", *"aaabbc"), "s"))
    assert [(v, n, s, e) for _, v, n, s, e in got] == [("a", 3, 0, 3), ("b", 2, 3, 5), ("c", 1, 5, 6)]


def test_bubble_sizes(frame):
    df = frame("x double, y double, z double", (1.0, 1.0, -2.0), (2.0, 2.0, None), (3.0, 3.0, 1.0), (None, 1.0, 1.0))
    assert [r[2] for r in rows(charts.bubble(df, "x", "y", "z"))] == [420.0, 20.0, 220.0]
    assert {r[2] for r in rows(charts.bubble(df, "x", "y"))} == {50.0}


def test_radar_needs_three_columns(frame):
    with pytest.raises(ValueError):
        charts.radar(frame("a double, b double", (1.0, 2.0)))
    got = {r["column"]: r["scaled"] for r in charts.radar(frame("a double, b double, c double", (1.0, 2.0, 5.0))).collect()}
    assert got == {"a": 0.0, "b": 0.25, "c": 1.0}


def test_grid_fills_empty_nodes_with_zero(frame):
    df = frame("x double, y double, z double", (0.0, 0.0, 4.0), (1.0, 1.0, 6.0), (1.0, 1.0, 8.0), (float("inf"), 0.0, 1.0))
    got = {(r["i"], r["j"]): (r["z"], r["count"]) for r in charts.grid(df, "x", "y", "z", 3).collect()}
    assert len(got) == 9 and got[(0, 0)] == (4.0, 1) and got[(2, 2)] == (7.0, 2) and got[(1, 1)] == (0.0, 0)


def test_non_numeric_axis_is_refused(frame):
    with pytest.raises(ValueError, match="numeric"):
        charts.histogram(frame("s string", "a"), "s")


def test_positions_cover_all_rows(spark):
    df = spark.range(5000).selectExpr("(id * 7919) % 5000 AS k", "'v' AS v")
    got = dict(rows(ordering.with_position(df, ["k"]).select("k", "position")))
    assert all(k == p for k, p in got.items()) and len(got) == 5000
    assert ordering.with_position(df.limit(0), ["k"]).count() == 0


def test_overviews_of_text_only_tables(frame):
    df = frame("s string", "a", "b", "a")
    assert {r["chart"] for r in charts.auto_charts(df).collect()} == {"bar"}
    assert charts.overview(df).count() == 2
