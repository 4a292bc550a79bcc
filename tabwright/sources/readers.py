"""Loading files by format or by extension."""

from __future__ import annotations

import csv
import io
import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.kinds import col, quoted
from ..functions.missing import literal_sql
from ..functions.scalars import INTEGER_PATTERN, NUMBER_PATTERN
from ..operators.moments import aggregate
from ..session import materialize, shared_dir
from . import arrow, ranges

# Cell texts that a delimited file uses for "missing".
NA_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _typed(raw: DataFrame) -> DataFrame:
    """Text cells to the narrowest of BIGINT, DOUBLE, BOOLEAN that fits every present cell.

    One aggregation decides for all columns. Dates stay text until a cleaning step repairs them.
    """
    na = ", ".join(literal_sql(t) for t in NA_TEXTS)
    cells = raw.select(*[F.expr(f"IF({quoted(c)} IN ({na}), NULL, {quoted(c)})").alias(c) for c in raw.columns])
    aggs = []
    for i, c in enumerate(raw.columns):
        q = quoted(c)
        aggs += [
            f"count({q}) AS n{i}",
            f"count_if({q} RLIKE {literal_sql(INTEGER_PATTERN)}) AS i{i}",
            f"count_if({q} RLIKE {literal_sql(NUMBER_PATTERN)} OR lower({q}) IN ('inf', '-inf', 'infinity', '-infinity')) AS d{i}",
            f"count_if({q} IN ('True', 'False', 'TRUE', 'FALSE', 'true', 'false')) AS b{i}",
        ]
    row = aggregate(cells, aggs).first()
    out = []
    for i, c in enumerate(raw.columns):
        n = row[f"n{i}"]
        if n and row[f"i{i}"] == n:
            out.append(F.trim(col(c)).cast("bigint").alias(c))
        elif n == row[f"d{i}"]:
            out.append(F.trim(col(c)).cast("double").alias(c))
        elif row[f"b{i}"] == n:
            out.append((F.lower(col(c)) == "true").alias(c))
        else:
            out.append(col(c))
    return cells.select(*out)


def has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell goes on in the next line: then some line has an odd number of quotes (doubled ones are even).

    One pass over the lines that stops early in each task; it decides how the file is read, whatever its size.
    """
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    return bool(spark.read.text(path).where(quotes % 2 == 1).head(1))


def _read_by_records(spark: SparkSession, path: str, sep: str, schema: T.StructType | str | None) -> DataFrame:
    """A delimited file with line breaks inside quotes, cut into records by many tasks (see ``ranges``); cells are texts unless a schema is given."""
    found = materialize(ranges.delimited_records(spark, path, sep).where(F.length(F.trim("record")) > 0), "records")
    at = F.struct("block", "number")
    firsts = found.groupBy("file").agg(F.min(at).alias("first"))  # the header of each file
    head = found.join(firsts, "file").where(at == F.col("first")).orderBy("file").select("record").first()
    if head is None:
        return spark.createDataFrame([], "x string").drop("x")
    names = next(csv.reader(io.StringIO(head["record"], newline=""), delimiter=sep))
    if schema is None:
        schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
    else:
        names = None
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    rows = found.join(firsts, "file").where(at > F.col("first"))
    cells = rows.select(F.from_csv("record", ddl, {"sep": sep, "escape": '"', "multiLine": "true"}).alias("r")).select("r.*")
    return cells if names is None else cells.toDF(*_unique(names))


def _unique(names: list[str]) -> list[str]:
    """Names of columns as Spark gives them: by position where empty, with the position behind repeated ones."""
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(lower[i]) > 1 else n for i, n in enumerate(names)]


def read_csv(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None, multiline: bool | None = None) -> DataFrame:
    """A delimited file with a header row, read by many tasks.

    Types are inferred in one aggregation unless a schema is given, and the usual texts for missing
    count as missing. Line breaks inside quotes are read as part of their cell: in files that have any, records are
    found first. ``multiline`` says so without looking.
    """
    if multiline is None:
        multiline = has_quoted_breaks(spark, path)
    if multiline:
        raw = _read_by_records(spark, path, sep, schema)
    else:
        reader = spark.read.option("header", True).option("sep", sep).option("escape", '"')
        raw = (reader.schema(schema) if schema is not None else reader.option("inferSchema", False)).csv(path)
    return _typed(raw) if raw.columns and schema is None else raw


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, sep="\t", **options)


def _orient(spark: SparkSession, path: str) -> str:
    """How a JSON file holds its table, from the text up to its first closing brace and from the lines that begin an object."""
    head = spark.read.option("lineSep", "}").text(path).select(F.ltrim(F.regexp_replace(F.substring("value", 1, 10_000), r"^\s+", "")).alias("v")).where("v <> ''").head(1)
    text = head[0]["v"] if head else "{"
    if text.startswith("["):
        return "records"
    if re.match(r'\{\s*"(?:[^"\\]|\\.)*"\s*:\s*[\[{]', text) and len(spark.read.text(path).where(r"value RLIKE '^\\s*\\{'").head(2)) < 2:
        return "columns"
    return "lines"


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, orient: str | None = None) -> DataFrame:
    """JSON Lines, arrays of records, or an object of columns (objects by row label, or arrays); all are read by many tasks.

    ``orient`` is lines, records or columns; without it the begin of the file decides. Arrays and columns become
    JSON Lines in the shared folder first. A cell that a column lacks is missing.
    """
    orient = orient or _orient(spark, path)
    names = None
    if orient != "lines":
        lines, names = ranges.json_column_records(spark, path) if orient == "columns" else (ranges.json_array_records(spark, path), None)
        path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
        lines.select("record").write.text(path)
    df = (spark.read.schema(schema) if schema is not None else spark.read).json(path)
    if df.columns == ["_corrupt_record"]:
        raise ValueError(f"{path}: neither JSON Lines nor an array of records nor an object of columns")
    return df.select(*[col(json.loads(n)) for n in names]) if names and schema is None else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_feather(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    arrow.register(spark)
    reader = spark.read.format(arrow.FORMAT)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(arrow.qualified(spark, path))


READERS = {".csv": read_csv, ".tsv": read_tsv, ".json": read_json, ".parquet": read_parquet, ".feather": read_feather}


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read a file by its extension (upper or lower case)."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in READERS:
        raise ValueError(f"unsupported format {suffix!r}; supported: {sorted(READERS)}")
    return READERS[suffix](spark, path, **options)
