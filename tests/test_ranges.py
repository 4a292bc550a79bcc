"""Files whose records do not end with their lines, read in ranges of a few bytes and compared with plain parsers."""

import csv
import io
import json
import random

import pytest

from tabwright.sources import ranges, readers


@pytest.fixture
def tiny(spark):
    """Ranges of some bytes only, so that cells and records span several."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    for k, v in kept.items():
        spark.conf.set(k, v)


CELLS = ["", "x", "a,b", 'say "hi"', "two\nlines", '"', "\n", "\n\n", 'end"\n', "é\nü", ",\n,", "q" * 90, "r\ns" * 40, '""', "5 inch", "tab\there", "carriage\r\nreturn"]


def _csv(rows, ending="\n", sep=","):
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=sep, lineterminator=ending).writerows(rows)
    return out.getvalue()


def _read(spark, path, sep=","):
    return sorted((tuple(r) for r in readers._read_by_records(spark, str(path), sep, None).collect()), key=str)


@pytest.mark.parametrize("size, ending", [(60, "\n"), (150, "\r\n"), (1 << 20, "\r\n")])
def test_delimited_records_in_ranges(spark, tmp_path, tiny, size, ending):
    tiny(size)
    random.seed(size)
    rows = [["id", "name of\nit", "c"]] + [[f"k{k}", random.choice(CELLS), random.choice(CELLS)] for k in range(30)]
    (tmp_path / "a.csv").write_text(_csv(rows, ending), encoding="utf-8", newline="")
    df = readers._read_by_records(spark, str(tmp_path / "a.csv"), ",", None)
    assert df.columns == rows[0]
    want = [tuple(c if c != "" else None for c in r) for r in rows[1:]]
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(want, key=str)


def test_quotes_that_open_nothing(spark, tmp_path, tiny):
    tiny(20)
    text = 'id,size,note\n1,5" pipe,a\n2,"b\nc","d"\n\n3,6" pipe,"e, ""f""\n"\n   \n4,7",x'
    (tmp_path / "a.csv").write_text(text)
    assert _read(spark, tmp_path / "a.csv") == [("1", '5" pipe', "a"), ("2", "b\nc", "d"), ("3", '6" pipe', 'e, "f"\n'), ("4", '7"', "x")]


def test_folders_headers_and_degenerate_files(spark, tmp_path, tiny):
    tiny(30)
    folder = tmp_path / "t.tsv"
    folder.mkdir()
    for k in range(3):
        (folder / f"part-{k}.tsv").write_text(_csv([["a", "", "A"], [str(k), "x\ty", "p\nq"]], sep="\t"))
    df = readers._read_by_records(spark, str(folder), "\t", None)
    assert df.columns == ["a0", "_c1", "A2"] and sorted(tuple(r) for r in df.collect()) == [(str(k), "x\ty", "p\nq") for k in range(3)]
    (tmp_path / "h.csv").write_text("a,b\n")
    assert readers.read_csv(spark, str(tmp_path / "h.csv"), multiline=True).collect() == []
    (tmp_path / "e.csv").write_text("\n\n")
    assert readers.read_csv(spark, str(tmp_path / "e.csv"), multiline=True).columns == []
    typed = readers.read_csv(spark, str(folder), sep="\t", schema="a int, b string, c string", multiline=True)
    assert sorted(r.a for r in typed.collect()) == [0, 1, 2]


def test_one_file_is_many_tasks(spark, tmp_path, tiny):
    (tmp_path / "a.csv").write_text(_csv([["a", "b"]] + [[str(k), "x\ny" * 20] for k in range(400)]))
    tiny(2000)
    found = ranges.delimited_records(spark, str(tmp_path / "a.csv"), ",")
    assert found.count() == 401 and ranges.pieces(spark, str(tmp_path / "a.csv"), "\n").rdd.getNumPartitions() >= 8


VALUES = [None, 1, -2.5, True, "", "x", 'a"b', "back\\slash", "}", "{", "],[", "a,b", "\\", 'q\\"', "é\n", [1, [2]], [], {"x": "}"}, {"y": [1, {"z": ","}]}]


@pytest.mark.parametrize("size, indent", [(70, None), (150, 2)])
def test_json_arrays_in_ranges(spark, tmp_path, tiny, size, indent):
    tiny(size)
    random.seed(size)
    rows = [{"id": k, "v": random.choice(VALUES), "w": {"deep": random.choice(VALUES)}} for k in range(25)] + [{}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent))
    got = [json.loads(r.record) for r in ranges.json_array_records(spark, str(tmp_path / "a.json")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, rows))


@pytest.mark.parametrize("size, indent, labels", [(60, None, True), (150, 1, False)])
def test_json_columns_in_ranges(spark, tmp_path, tiny, size, indent, labels):
    tiny(size)
    random.seed(size)
    columns = {name: [random.choice(VALUES) for _ in range(12)] for name in ("b", "a,{", 'q"\\')}
    table = {k: {f"r,{i}": x for i, x in enumerate(v)} for k, v in columns.items()} if labels else columns
    (tmp_path / "a.json").write_text(json.dumps(table, indent=indent))
    lines, names = ranges.json_column_records(spark, str(tmp_path / "a.json"))
    assert [json.loads(n) for n in names] == list(columns)
    want = [{k: v[i] for k, v in columns.items()} for i in range(12)]
    assert sorted(str(dict(sorted(json.loads(r.record).items()))) for r in lines.collect()) == sorted(str(dict(sorted(w.items()))) for w in want)


def test_orientation_of_json(spark, tmp_path):
    files = {
        "lines": '{"a": 1, "b": {"c": 2}}\n{"a": 2, "b": {"c": 3}}\n',
        "nested lines": '{"b": {"c": 2}, "a": 1}\n{"b": {"c": 3}, "a": 2}\n',
        "array": '[\n {"a": 1, "b": {"c": 2}},\n {"a": 2, "b": {"c": 3}}\n]',
        "columns": '{"a": {"0": 1, "1": 2}, "b": {"0": {"c": 2}, "1": {"c": 3}}}',
        "lists": '{"a": [1, 2],\n "b": [{"c": 2}, {"c": 3}]}',
    }
    for name, text in files.items():
        path = tmp_path / f"{name}.json"
        path.write_text(text)
        assert sorted((r.a, r.b.c) for r in readers.load(spark, str(path)).collect()) == [(1, 2), (2, 3)], name
    (tmp_path / "x.json").write_text("no table")
    with pytest.raises(ValueError):
        readers.load(spark, str(tmp_path / "x.json"))


def test_a_file_of_several_json_arrays_on_lines_of_their_own(spark, tiny, tmp_path):
    rows = [{"a": i, "t": "]\n[{" * (i % 3)} for i in range(9)]
    (tmp_path / "x.json").write_text("\n".join(json.dumps(rows[i : i + 3]) for i in (0, 3, 6)) + "\n")
    tiny(25)
    got = sorted((tuple(r) for r in readers.read_json(spark, str(tmp_path / "x.json"), orient="records").select("a", "t").collect()))
    assert got == [(r["a"], r["t"]) for r in rows]


def test_ranges_grow_with_the_files_up_to_a_bound():
    from tabwright.registry import sources

    assert sources._range_size(200_000) == 1 << 15
    assert sources._range_size(1 << 30) == 1 << 24
    assert sources._range_size(6 << 30) == 1 << 25


def test_columns_in_several_files_and_arrays_of_few_records(spark, sf, monkeypatch):
    from tabwright.registry import sources

    monkeypatch.setattr(sources, "OBJECT", 60)
    monkeypatch.setattr(sources, "ARRAY", 16)
    for name, table, key in (("json_columns", "part", "p_partkey"), ("json_array_split", "documents", "doc_id")):
        got, want = sources.QUERIES[name].run(spark, sf), spark.read.parquet(f"{sf}/{table}.parquet")
        assert got.count() == want.count() and got.select(key).exceptAll(want.select(key)).count() == 0


def test_pruned_feather_has_as_many_files_as_the_scan_has_tasks(spark):
    from tabwright.registry import sources

    assert sources._files_of(spark.range(10, numPartitions=1)) == 4
    assert sources._files_of(spark.range(90, numPartitions=9)) == 9
