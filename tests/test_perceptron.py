"""The regression perceptron against numeric gradients, one big block, and targets of known form."""

import numpy as np
import pandas as pd
import pytest

from tabwright.operators import models, packed, perceptron


def table(n=400, seed=4):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n) * 50 + 1000, "b": rng.uniform(-1, 1, n), "same": 3.3})
    pdf["y"] = 7 + pdf.b**2 * 4 + (pdf.a - 1000) / 50 * pdf.b
    pdf["fold"] = pdf.id % 3
    return pdf


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(20, 3)), rng.normal(size=20)
    theta = rng.normal(size=5 * 6 + 1)
    got = perceptron.loss_sums(theta, x, y, 6)
    for k in range(len(theta)):
        up, down = theta.copy(), theta.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        slope = (perceptron.loss_sums(up, x, y, 6)[0] - perceptron.loss_sums(down, x, y, 6)[0]) / 2e-6
        assert abs(slope - got[1 + k]) < 1e-4 * max(1, abs(slope))
    halves = perceptron.loss_sums(theta, x[:7], y[:7], 6) + perceptron.loss_sums(theta, x[7:], y[7:], 6)
    np.testing.assert_allclose(halves, got, rtol=1e-12)


def test_blocks_and_steps_of_adding_do_not_matter(spark, monkeypatch):
    pdf, s = table(), perceptron.Settings(hidden=8, passes=12)
    df = spark.createDataFrame(pdf)
    whole = perceptron.train(df.coalesce(1), ["a", "b"], ["fold <> 0", "true"], s, "y")
    monkeypatch.setattr(packed, "BLOCK", 17)
    monkeypatch.setattr(packed, "FAN_IN", 2)
    parts = perceptron.train(df.repartition(5), ["a", "b"], ["fold <> 0", "true"], s, "y")
    alone = perceptron.train(spark.createDataFrame(pdf[pdf.fold != 0]), ["a", "b"], ["true"], s, "y")
    x = pdf[["a", "b"]].to_numpy()
    for one, other in ((whole[0], parts[0]), (whole[1], parts[1]), (whole[0], alone[0])):
        np.testing.assert_allclose(one.predict(x), other.predict(x), rtol=1e-5, atol=1e-5)


def test_learns_a_closed_form(spark):
    pdf = table(1500)
    df = spark.createDataFrame(pdf)
    model = perceptron.train(df, ["a", "b", "same"], ["fold <> 0"], perceptron.Settings(), "y")[0]
    out = model.transform(df.where("fold = 0")).select("y", "prediction").toPandas()
    assert 1 - ((out.y - out.prediction) ** 2).sum() / ((out.y - out.y.mean()) ** 2).sum() > 0.97


def test_odd_tables(spark):
    pdf = table(30)
    pdf["flat"] = 5.0
    df = spark.createDataFrame(pdf)
    flat, none = perceptron.train(df, ["a", "same"], ["true", "false"], perceptron.Settings(hidden=3), "flat")
    assert np.allclose(flat.predict(pdf[["a", "same"]].to_numpy()), 5.0) and np.allclose(none.predict(np.ones((2, 2))), 0.0)
    only = perceptron.train(df, ["same"], ["true"], perceptron.Settings(hidden=3), "y")[0]
    assert np.allclose(only.predict(np.full((1, 1), 3.3)), pdf.y.mean(), atol=1e-3)
    empty = perceptron.train(df.where("id < 0"), ["a"], ["true"], perceptron.Settings(hidden=3), "y")[0]
    assert empty.transform(df.where("id < 0")).count() == 0


def test_in_cross_validation(spark):
    df = spark.createDataFrame(table(600)[["id", "a", "b", "y"]])
    r = models.train_models(df, "y", "id", ["mlp"], folds=3, passes=80).first()
    assert r.error is None and len(r.cv_scores) == 3 and r.mean_score > 0.7
    with pytest.raises(ValueError, match="neither"):
        models.feature_importance(df, "y", "id", "mlp", passes=2)


def test_hidden_layer_stays_small_and_sums_equal_those_of_single_rows():
    import tracemalloc

    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(1 << 15, 3)), rng.normal(size=1 << 15)
    theta = perceptron.first_weights(3, perceptron.Settings())
    tracemalloc.start()
    perceptron.loss_sums(theta, x, y, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20
    some = slice(0, perceptron.SLICE + 7)
    single = sum(perceptron.loss_sums(theta, x[i : i + 1], y[i : i + 1], 100) for i in range(some.stop))
    assert np.allclose(perceptron.loss_sums(theta, x[some], y[some], 100), single)
    assert not perceptron.loss_sums(theta, x[:0], y[:0], 100).any()


def test_models_share_rows_that_are_shifted_once(spark):
    """The first training set gives centre and scale; here a feature is constant in it, and far off in the others."""
    pdf = table(300)
    pdf["a"] = np.where(pdf.fold == 0, 1e6, pdf.a)
    df, s = spark.createDataFrame(pdf), perceptron.Settings(hidden=6, passes=8)
    joint = perceptron.train(df, ["a", "b"], ["fold = 0", "true", "fold <> 0"], s, "y")
    x = pdf[["a", "b"]].to_numpy()
    for one, own in zip(joint, ("fold = 0", "true", "fold <> 0")):
        alone = perceptron.train(df, ["a", "b"], [own], s, "y")[0]
        np.testing.assert_allclose(one.predict(x[pdf.fold > 0]), alone.predict(x[pdf.fold > 0]), rtol=1e-6, atol=1e-6)
