"""Kernel machines against the library's linear learners over the same random features."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import classification as mlc, regression as mlr
from pyspark.ml.feature import VectorAssembler

from tabwright.operators import kernel, packed

N = 300


@pytest.fixture(scope="module")
def both(spark):
    """(rows, rows with a vector of the random features, settings)."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(N, 2)) * [1, 2]
    pdf = pd.DataFrame({"id": np.arange(N), "a": x[:, 0], "b": x[:, 1], "fold": np.arange(N) % 3})
    pdf["two"] = (x[:, 0] ** 2 + x[:, 1] + rng.normal(size=N) * 0.3 > 1).astype(float)
    pdf["three"] = np.digitize(x[:, 0] + rng.normal(size=N) * 0.1, [-0.5, 0.5]).astype(float)
    pdf["y"] = 50 + 10 * np.sin(x[:, 0]) + x[:, 1] * 3 + rng.standard_t(2, N)
    s = kernel.Settings(fourier=8, rows=N, spread=2.0)
    z = kernel.Cosines.drawn(2, s).of(x)
    wide = pd.concat([pdf, pd.DataFrame(z, columns=[f"z{i}" for i in range(8)])], axis=1)
    return spark.createDataFrame(pdf), VectorAssembler(inputCols=[f"z{i}" for i in range(8)], outputCol="z").transform(spark.createDataFrame(wide)).cache(), s


@pytest.mark.parametrize("steps", [1, 3, 100])
def test_hinge_takes_the_library_s_steps(both, steps):
    df, wide, s = both
    fitted = kernel.train(df, ["a", "b"], ["true", "fold <> 1"], 2, replace(s, steps=steps), "two")
    for own, got in zip(("true", "fold <> 1"), fitted):
        want = mlc.LinearSVC(featuresCol="z", labelCol="two", maxIter=steps, tol=1e-3, regParam=1 / N, standardization=False).fit(wide.where(own))
        np.testing.assert_allclose(got.coefficients[:, 0], want.coefficients.toArray(), atol=1e-8)
        assert got.constants[0] == pytest.approx(want.intercept, abs=1e-8)


def test_three_classes_are_one_against_the_rest(both):
    df, wide, s = both
    base = mlc.LinearSVC(featuresCol="z", labelCol="three", maxIter=100, tol=1e-3, regParam=1 / N, standardization=False)
    want = mlc.OneVsRest(classifier=base, featuresCol="z", labelCol="three").fit(wide).transform(wide).select("id", "prediction")
    got = kernel.train(df, ["a", "b"], ["true"], 3, s, "three")[0].transform(df).select("id", "prediction")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("steps, tolerance", [(1, 1e-8), (4, 1e-8), (100, 1e-2)])
def test_huber_follows_the_library(both, steps, tolerance):
    df, wide, s = both
    want = mlr.LinearRegression(featuresCol="z", labelCol="y", loss="huber", maxIter=steps, tol=1e-3, regParam=1 / N).fit(wide)
    got = kernel.train(df, ["a", "b"], ["true"], 0, replace(s, steps=steps), "y")[0]
    p = np.array([r.prediction for r in want.transform(wide).orderBy("id").collect()])
    q = got.predict(df.orderBy("id").toPandas()[["a", "b"]].to_numpy())
    assert np.abs(p - q).mean() < tolerance * np.abs(p).max()


@pytest.mark.parametrize("classes, label", [(3, "three"), (0, "y")])
def test_blocks_do_not_matter_and_training_sets_share_passes(spark, both, monkeypatch, classes, label):
    df, _, s = both
    s, passes = replace(s, steps=6), []
    monkeypatch.setattr(packed, "totals", lambda *a, of=packed.totals, **k: passes.append(1) or of(*a, **k))
    alone = [kernel.train(df.coalesce(1), ["a", "b"], [f"fold <> {i}"], classes, s, label)[0] for i in range(3)]
    before = len(passes)
    monkeypatch.setattr(packed, "BLOCK", 17)
    monkeypatch.setattr(packed, "FAN_IN", 2)
    monkeypatch.setattr(kernel, "SLICE", 5)
    joint = kernel.train(df.repartition(5), ["a", "b"], [f"fold <> {i}" for i in range(3)], classes, s, label)
    assert len(passes) - before < 0.6 * before
    x = df.toPandas()[["a", "b"]].to_numpy()
    for one, other in zip(alone, joint):
        np.testing.assert_allclose(one.coefficients, other.coefficients, atol=1e-6)
        np.testing.assert_allclose(one.predict(x), other.predict(x), atol=1e-6)


def test_odd_tables(spark, both):
    df, _, s = both
    with pytest.raises(ValueError, match="without rows"):
        kernel.train(df, ["a"], ["true", "false"], 2, s, "two")
    flat = kernel.train(df.selectExpr("1.0D AS a", "2.0D AS b", "two"), ["a", "b"], ["true"], 2, replace(s, steps=2), "two")[0]
    assert not flat.coefficients.any()
    same = kernel.train(df.selectExpr("a", "3.0D AS label"), ["a"], ["true"], 0, replace(s, steps=15))[0]
    assert np.abs(same.predict(np.array([[0.0], [1.0]])) - 3).max() < 0.5
