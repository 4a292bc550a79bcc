import numpy as np
import pandas as pd
import pytest

from tabwright.operators import folds, knn, metrics, models


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def linear(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) * [1.0, 3.0, 0.5]
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["y"] = 2 * pdf.a - pdf.b + 0.5 * pdf.c + 4 + rng.normal(size=400) * 0.1
    pdf["cls"] = np.where(pdf.a + pdf.b > 0, "up", "down")
    pdf["id"] = np.arange(400)
    return pdf, spark.createDataFrame(pdf)


def test_split_takes_the_exact_share(spark):
    df = spark.range(1003).toDF("id")
    train, test = folds.train_test_split(df, "id")
    assert (train.count(), test.count()) == (802, 201)
    again = folds.train_test_split(df, "id")[1]
    assert set(rows(test)) == set(rows(again))
    assert set(rows(folds.train_test_split(df, "id", seed=1)[1])) != set(rows(test))


def test_split_by_text_key(spark):
    df = spark.range(500).selectExpr("concat('k', id) AS k")
    assert folds.train_test_split(df, "k")[1].count() == 100


def test_block_folds_have_the_expected_sizes(spark):
    got = folds.with_block_folds(spark.range(23).toDF("id"), "id", 5).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in got] == [5, 5, 5, 4, 4]


def test_stratified_folds_balance_classes(spark):
    df = spark.range(103).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id < 50 THEN 'b' ELSE 'it''s' END AS y")
    got = folds.with_stratified_folds(df, "y", "id", 4).groupBy("y", "fold").count().toPandas()
    assert got["fold"].notna().all()
    for _, g in got.groupby("y"):
        assert len(g) == 4 and g["count"].max() - g["count"].min() <= 1
    assert got.groupby("fold")["count"].sum().tolist() == [26, 26, 26, 25]


def test_stratified_folds_with_repeated_keys_nulls_and_many_classes(spark):
    df = spark.range(6000).selectExpr("id DIV 3 AS k", "IF(id % 4000 = 7, NULL, id % 2500) AS y", "'x' AS fold")
    got = folds.with_stratified_folds(df, "y", "k", 3)
    assert got.columns == ["k", "y", "fold"] and got.count() == 6000
    sizes = got.groupBy("fold").count().toPandas()["count"]
    assert len(sizes) == 3 and sizes.max() - sizes.min() <= 1


def test_more_classes_than_any_literal_list_would_hold(spark):
    df = spark.range(13200).selectExpr("id", "CAST(id % 1100 AS STRING) AS y", "CAST(id % 1100 AS DOUBLE) AS x")
    row = models.train_models(df, "y", "id", ["knn"], folds=2).first()
    assert row["error"] is None and row["mean_score"] > 0.9


def test_split_of_keys_beyond_the_modulus(spark):
    df = spark.range(10).selectExpr("id % 2 + 2147483647 * (id DIV 2) AS k")
    assert folds.with_split(df, "k", 0.5).where("is_test").count() == 5


def test_classification_metrics_by_hand(frame):
    df = frame("label string, prediction string", ("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"))
    m = metrics.classification_metrics(df).first()
    assert m["accuracy"] == 0.5
    assert m["f1_weighted"] == pytest.approx((2 * 0.5 + 1 * (2 / 3) + 0) / 4)


def test_regression_metrics_by_hand(frame):
    df = frame("label double, prediction double", (1.0, 1.5), (2.0, 2.0), (3.0, 2.5))
    m = metrics.regression_metrics(df).first()
    assert m["r2"] == pytest.approx(1 - 0.5 / 2) and m["rmse"] == pytest.approx((0.5 / 3) ** 0.5)
    flat = frame("label double, prediction double", (1.0, 1.0), (1.0, 1.0))
    assert metrics.regression_metrics(flat).first()["r2"] == 1.0


def test_task_detection(spark):
    df = spark.range(1000).selectExpr("id", "id % 10 AS few", "id % 60 AS some", "CAST(id AS STRING) AS text", "id % 2 = 0 AS flag")
    assert [models.task_of(df, c) for c in df.columns] == ["regression", "classification", "regression", "classification", "classification"]
    assert [models.task_of_simple(df, c) for c in df.columns] == ["regression", "classification", "regression", "classification", "classification"]
    assert models.task_of(df.limit(20), "few") == "regression"
    with pytest.raises(ValueError, match="available"):
        models.task_of(df, "nope")
    assert models.default_target(df) == "flag" and models.default_target(df, numeric=True) == "some"


def solve(pdf, alpha):
    x = pdf[["a", "b", "c"]].to_numpy()
    xc, yc = x - x.mean(0), pdf.y - pdf.y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    return {"intercept": pdf.y.mean() - x.mean(0) @ w, **dict(zip("abc", w))}


@pytest.mark.parametrize("name,alpha", [("linear_regression", 0.0), ("ridge", 1.0)])
def test_closed_forms(linear, name, alpha):
    pdf, df = linear
    got = dict(rows(models.linear_coefficients(df.drop("cls"), "y", "id", name)))
    for k, w in solve(pdf, alpha).items():
        assert got[k] == pytest.approx(w, rel=1e-6)


def test_lasso_agrees_with_coordinate_descent(linear):
    pdf, df = linear
    x, y = pdf[["a", "b", "c"]].to_numpy(), pdf.y.to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.zeros(3)
    for _ in range(500):
        for j in range(3):
            r = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ r / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - 1.0, 0) / (xc[:, j] @ xc[:, j] / len(y))
    got = dict(rows(models.linear_coefficients(df.drop("cls"), "y", "id", "lasso")))
    assert [got[c] for c in "abc"] == pytest.approx(list(w), abs=1e-4)


@pytest.mark.parametrize("name", models.list_models("regression"))
def test_every_regressor_learns(linear, name):
    _, df = linear
    got = models.train_models(df.drop("cls"), "y", "id", [name], folds=2, trees=10, depth=5, rounds=10).first()
    assert got["error"] is None and len(got["cv_scores"]) == 2
    assert got["mean_score"] > (0.0 if name in ("lasso", "svr") else 0.5), got


@pytest.mark.parametrize("name", models.list_models("classification"))
def test_every_classifier_learns(linear, name):
    _, df = linear
    got = models.train_on_split(df.drop("y"), "cls", "id", [name], folds=0, trees=10, depth=5, rounds=5).first()
    assert got["error"] is None and got["accuracy"] > 0.8 and got["f1_score"] > 0.8, got


@pytest.mark.parametrize("name", ["svm", "xgboost", "logistic_regression", "mlp"])
def test_three_classes(spark, name):
    df = spark.range(300).selectExpr("id", "CAST(id % 3 AS DOUBLE) + rand(1) * 0.2 AS a", "rand(2) AS b", "element_at(array('x','y','z'), CAST(id % 3 AS INT) + 1) AS cls")
    got = models.train_on_split(df, "cls", "id", [name], folds=0, rounds=3).first()
    assert got["error"] is None and got["accuracy"] > 0.8


def test_ranking_keeps_failures(linear):
    _, df = linear
    results = models.train_models(df.drop("cls"), "y", "id", ["ridge", "nope", "linear_regression"], folds=2)
    ranked = models.compare_models(results).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3] and ranked[-1]["model"] == "nope" and "unknown model" in ranked[-1]["error"]
    assert models.export_results(results).count() == 3


def test_importance(linear):
    _, df = linear
    got = models.feature_importance(df.drop("cls"), "y", "id", trees=10, depth=5).collect()
    assert [r["feature"] for r in got][0] in ("a", "b") and sum(r["importance"] for r in got) == pytest.approx(1.0, abs=1e-3)
    logistic = models.feature_importance(df.drop("y"), "cls", "id", "logistic_regression").collect()
    assert {r["feature"] for r in logistic} == {"a", "b", "c"}
    with pytest.raises(ValueError, match="neither importances"):
        models.feature_importance(df.drop("cls"), "y", "id", "svr")


def test_no_numeric_features(frame):
    df = frame("id int, s string, y string", (1, "a", "p"), (2, "b", "q"))
    with pytest.raises(ValueError, match="numeric"):
        models.train_models(df, "y", "id", ["random_forest"])


@pytest.fixture
def small_cells():
    saved = knn.CELL_ROWS, knn.QUERY_ROWS
    knn.CELL_ROWS, knn.QUERY_ROWS = 40, 60
    yield
    knn.CELL_ROWS, knn.QUERY_ROWS = saved


def brute(train, test, dims, k):
    out = set()
    d = knn._squared(test[dims].to_numpy(float), train[dims].to_numpy(float))
    ids = train["id"].to_numpy()
    for i, q in enumerate(test["id"]):
        order = np.lexsort((ids, d[i]))[:k]
        out |= {(q, r + 1, ids[j]) for r, j in enumerate(order)}
    return out


@pytest.mark.parametrize("cell_rows", [40, 3])
def test_knn_is_exact_with_hot_points(spark, small_cells, cell_rows):
    knn.CELL_ROWS = cell_rows  # 3: fewer points in a cell than neighbours wanted
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(np.round(rng.normal(size=(900, 2)), 1), columns=["a", "b"])
    pdf.loc[:300, ["a", "b"]] = [0.5, 0.5]
    pdf["id"], pdf["y"] = np.arange(900), rng.integers(0, 3, 900)
    train, test = pdf[pdf.id % 3 > 0], pdf[pdf.id % 3 == 0]
    got = knn.nearest(spark.createDataFrame(train), spark.createDataFrame(test), ["a", "b"], "id", "id", "y")
    assert {(r["query_id"], r["rank"], r["train_id"]) for r in got.collect()} == brute(train, test, ["a", "b"], 5)


def test_knn_with_fewer_points_than_k(frame):
    train = frame("id int, x double, y double", (1, 0.0, 1.0), (2, 1.0, 2.0))
    test = frame("id int, x double", (9, 0.2))
    assert rows(knn.knn_predict(train, test, ["x"], "id", "id", "y", "regression")) == [(9, 1.5)]
    assert rows(knn.knn_predict(train, test, ["x"], "id", "id", "y", "classification")) == [(9, 1.0)]


def test_training_rows_of_one_file_are_dealt_over_tasks(spark, monkeypatch):
    df = spark.range(1000, numPartitions=1)
    assert models._dealt(df, 1000).rdd.getNumPartitions() == 1
    monkeypatch.setattr(models, "FEW_ROWS", 100)
    assert models._dealt(df, 1000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(models, "MANY_ROWS", 125)
    dealt = models._dealt(df, 1000)
    assert dealt.rdd.getNumPartitions() == 8 and sorted(r["id"] for r in dealt.collect()) == list(range(1000))
