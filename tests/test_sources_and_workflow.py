import json

import pandas as pd
import pytest

from tabwright.operators import features, filters, textops
from tabwright.operators.clean import Deduplicate, fit_impute_numeric
from tabwright.plans import workflow
from tabwright.session import materialize, shared_dir
from tabwright.sources import readers, writers
from tabwright.streaming.apply import apply_plans


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_csv_types_and_missing_texts(spark, tmp_path):
    p = tmp_path / "a.CSV"
    p.write_text('i,d,b,s,day\n1,1.5,True,"x ""q"", y",2024-01-02\n2,NA,False,n/a,2024-01-03\n,inf,True,z,\n')
    df = readers.load(spark, str(p))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "string"]
    want = pd.read_csv(p)
    got = df.toPandas()
    assert got["i"].isna().sum() == want["i"].isna().sum() == 1
    assert got["d"].isna().sum() == want["d"].isna().sum() == 1
    assert got["s"].tolist()[0] == want["s"].tolist()[0] == 'x "q", y'


def test_csv_with_schema_and_line_breaks(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('k,t\n1,"two\nlines"\n')
    assert rows(readers.load(spark, str(p), multiline=True)) == rows(readers.load(spark, str(p))) == [(1, "two\nlines")]
    assert rows(readers.read_csv(spark, str(p), schema="k int, t string")) == [(1, "two\nlines")]
    assert readers.read_csv(spark, str(p), schema="k string, t string", multiline=True).dtypes[0] == ("k", "string")


def test_json_shapes(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n')
    (tmp_path / "r.json").write_text('[\n {"a": 1, "b": "x"},\n {"a": 2, "b": "y"}\n]')
    (tmp_path / "bad.json").write_text("not json at all\n")
    assert rows(readers.load(spark, str(tmp_path / "l.json"))) == [(1, "x"), (2, "y")]
    assert rows(readers.load(spark, str(tmp_path / "r.json"))) == [(1, "x"), (2, "y")]
    with pytest.raises(ValueError, match="records"):
        readers.load(spark, str(tmp_path / "bad.json"))


def test_unknown_extension(spark):
    with pytest.raises(ValueError, match="supported"):
        readers.load(spark, "x.xlsx")


def test_feather_file_from_pandas(spark, tmp_path):
    import pyarrow as pa

    table = pa.Table.from_pandas(pd.DataFrame({"a": range(10), "s": pd.Categorical(list("xyxyxyxyxy")), "t": pd.date_range("2024-01-01", periods=10)}))
    path = str(tmp_path / "a.feather")
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, table.schema) as writer:
        writer.write_table(table, max_chunksize=4)
    df = readers.load(spark, path)
    assert df.rdd.getNumPartitions() == 3
    assert df.count() == 10 and df.dtypes == [("a", "bigint"), ("s", "string"), ("t", "timestamp_ntz")]
    assert readers.read_feather(spark, path, ["s"]).columns == ["s"]


def test_feather_writes_are_committed_whole(spark, frame, tmp_path):
    out = str(tmp_path / "o.feather")
    df = spark.range(100).repartition(4)
    writers.write_feather(df, out)
    with pytest.raises(FileExistsError):
        writers.write_feather(df, out)
    writers.write_feather(df, out, mode="ignore")
    assert readers.load(spark, out).count() == 100
    writers.write_feather(df, out, mode="append")
    assert readers.load(spark, "file://" + out).count() == 200
    writers.write_feather(spark.range(10).coalesce(1), out, mode="overwrite")
    assert sorted(r.id for r in readers.load(spark, out).collect()) == list(range(10))
    with pytest.raises(Exception):
        writers.write_feather(spark.range(10).selectExpr("IF(id = 7, raise_error('no'), id) AS id"), out, mode="overwrite")
    assert readers.load(spark, out).count() == 10
    assert not [p for p in (tmp_path / "o.feather").iterdir() if p.name.startswith("_")]
    writers.write_feather(frame("a int, s string"), out, mode="overwrite")
    assert readers.load(spark, out).dtypes == [("a", "int"), ("s", "string")] and readers.load(spark, out).count() == 0


def test_write_single_file(spark, frame, tmp_path):
    out = str(tmp_path / "o.csv")
    writers.write_csv(frame("a int, s string", (1, 'q"x'), (2, None)), out, single_file=True)
    assert len(list((tmp_path / "o.csv").glob("part-*"))) == 1
    assert sorted(rows(readers.load(spark, out)), key=str) == [(1, 'q"x'), (2, None)]


def test_materialize_reads_back_the_same(frame):
    df = frame("a int, s string", (1, "x"), (2, None))
    assert sorted(rows(materialize(df)), key=str) == sorted(rows(df), key=str)


class FakeSession:
    """Only what ``shared_dir`` looks at."""

    def __init__(self, folder, master="yarn"):
        self.settings = {"spark.checkpoint.dir": folder} if folder else {}
        self.conf = self.sparkContext = self
        self.master, self.applicationId = master, "app-1"

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_shared_dir_follows_the_setting():
    assert shared_dir(FakeSession("hdfs://c/tmp/")) == "hdfs://c/tmp"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(FakeSession(None))


# --- text helpers ----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,stage",
    [
        ("Please clean my table", "clean"), ("IMPUTE the gaps", "clean"), ("one-hot please", "feature_engineer"), ("which is the best model?", "model_select"),
        ("run all", "profile"), ("hello", "direct"), ("normalize, then clean the data", "clean"), ("", "direct"),
    ],
)
def test_routing(frame, text, stage):
    assert rows(textops.route_questions(frame("q string", text), "q"))[0][1] == stage


@pytest.mark.parametrize(
    "text,found",
    [
        ('{"a": 1}', '{"a": 1}'), ('  {"a": 1} ', '{"a": 1}'), ('Sure:\n```json\n{"a": {"b": "}"}}\n``` ok', '{"a": {"b": "}"}}'),
        ('{"a": 1} and {"b": 2}', None), ("no braces", None), ('{"a": 1', None), ('} {', None), ('{"a":1}] x [{"b":2}', None), ('{"a":1},{"b":2}', None), (None, None),
    ],
)
def test_json_recovery(frame, text, found):
    got = rows(textops.recover_json(frame("id int, t string", (1, text)), "t"))[0]
    assert got[2:] == (found, found is not None)
    if found:
        assert isinstance(json.loads(found), dict)


def test_action_defaults(frame):
    df = frame("t string", 'x {"thinking": "hm"} y', '{"action": {"tool": "get_shape"}}', "nothing")
    got = [(r["json_valid"], r["tool"], r["summary"]) for r in textops.recover_actions(df, "t").collect()]
    assert got == [(True, "FINISH", ""), (True, "get_shape", ""), (False, None, None)]


# --- filters ---------------------------------------------------------------------------------------


def test_search_ignores_case_and_null(frame):
    df = frame("a int, s string", (12, "Hello"), (3, None), (41, "x"))
    assert {r[0] for r in rows(filters.search_rows(df, "HEL"))} == {12}
    assert {r[0] for r in rows(filters.search_rows(df, "1"))} == {12, 41}
    assert filters.search_rows(df, "null").count() == 0


def test_complete_and_positive(frame):
    df = frame("a double, b double", (1.0, 2.0), (float("nan"), 1.0), (None, 1.0))
    assert filters.complete_cases(df, ["a", "b"]).count() == 1
    assert filters.all_positive(df, ["a", "b"]) == {"a": False, "b": True}


# --- workflow and streams ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def wide(spark):
    return spark.range(400).selectExpr(
        "id", "CAST(id % 40 AS DOUBLE) AS a", "IF(id % 9 = 0, NULL, rand(3) * 10) AS b", "element_at(array('p','q'), CAST(id % 2 AS INT) + 1) AS s",
        "CAST(id % 40 AS DOUBLE) * 3 + rand(4) AS y",
    )


def test_run_all_passes_the_table_on(wide):
    done = workflow.run_all(wide, "y", "id", models=["linear_regression", "ridge"], folds=2)
    assert done.success and list(done.stages) == list(workflow.STAGES)
    assert done.best_model in ("linear_regression", "ridge")
    assert "a_x_b" in done.data.columns and "y" in done.data.columns and "id" in done.data.columns
    assert dict(done.data.dtypes)["s"] == "int"
    assert workflow.summary(done).count() == 5
    assert workflow.combined_report(done).where("stage = 'clean'").count() > 0


def test_unknown_stage_is_skipped_and_failure_stops(wide):
    done = workflow.run_all(wide, "y", "id", stages=["nope", "profile"])
    assert done.success and done.skipped == ["nope"] and list(done.stages) == ["profile"]
    failed = workflow.run_all(wide, "absent", "id", stages=["model_select", "visualize"])
    assert not failed.success and list(failed.stages) == ["model_select"] and "absent" in failed.stages["model_select"].error
    assert workflow.run_stage("nope", wide).error


def test_single_stage_returns_the_table(wide):
    assert workflow.run_stage("clean", wide, "y", "id").data.where("b IS NULL").count() == 0


def test_stream_with_a_large_label_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(features, "BROADCAST_BYTES", 100)
    df = spark.range(200).selectExpr("id", "concat('v', lpad(id, 4, '0')) AS s")
    writers.write_parquet(df, str(tmp_path / "in"))
    stream = apply_plans(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), [features.fit_label_encode(df)])
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert all(r.id == r.s for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_workflow_names_the_trained_model_after_a_failed_one(spark):
    df = spark.range(60).selectExpr("id", "CAST(hash(id) AS DOUBLE) AS a", "CAST(hash(id, 7) AS DOUBLE) / 1e9 AS y")
    done = workflow.run_stage("model_select", df, "y", "id", models=["no_such_model", "ridge"], folds=3)
    assert done.error is None and done.best_model == "ridge"
    assert done.report.where("model = 'ridge'").first()["mean_score"] < 0


def test_stream_refuses_dedup(spark, frame, tmp_path):
    df = frame("x double", 1.0, None)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert apply_plans(stream, [fit_impute_numeric(df)]).isStreaming
    with pytest.raises(ValueError, match="state"):
        apply_plans(stream, [Deduplicate()])
