"""Every registered query against its checking SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from check import table_of
from tabwright.registry import all_queries

QUERIES = all_queries()
# The SQL of these states facts of one scale only (which columns correlate, how many bins).
SCALE_BOUND = {"histogram_auto"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql and n not in SCALE_BOUND))
def test_matches_sql(name, spark, sf, con):
    q = QUERIES[name]
    df = q.run(spark, sf)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(q.sql)
    want = table_of([d[0] for d in res.description], res.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_names_are_unique_and_plain():
    assert len(QUERIES) > 100
    assert not [n for n in QUERIES if "pipeline" in n or n.startswith("op")]


@pytest.mark.parametrize("name", ["extra_trees", "gbt", "gbt_classify", "svm", "mlp", "model_comparison", "model_results_export", "logistic", "random_forest"])
def test_page_models_are_cross_validated_in_five_folds(name, spark, sf, monkeypatch):
    from tabwright.operators import models

    seen = []

    def record(df, target, key, names, task=None, folds=5, **rest):
        seen.append((folds, rest))
        return spark.createDataFrame([], models.SPLIT_SCHEMA)

    monkeypatch.setattr(models, "train_on_split", record)
    QUERIES[name].run(spark, sf)
    assert seen == [(5, {})]


def test_end_to_end_runs_leave_nothing_out(spark, sf, monkeypatch):
    from tabwright.plans import workflow

    seen = []

    def record(df, target, key, stages=None, **options):
        seen.append((df.columns, stages or list(workflow.STAGES), options))
        return workflow.WorkflowResult(True, df, {"profile": workflow.StageResult(df)})

    monkeypatch.setattr(workflow, "run_all", record)
    for name in ("end_to_end_stages", "end_to_end_report"):
        try:
            QUERIES[name].run(spark, sf)
        except AttributeError:  # a report of no stage
            pass
    (columns, stages, options), (_, reported, _) = seen
    assert "order_ts" in columns and options == {} and stages == list(workflow.STAGES)
    assert "feature_engineer" in reported
