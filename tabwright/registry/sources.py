"""Registered queries: files written and read back, text helpers, end-to-end runs, streams."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from ..operators import clean as clean_ops, features, textops
from ..operators.profile import load_summary
from ..plans import workflow
from ..session import materialize, shared_dir
from ..sources import readers, writers
from ..streaming.apply import apply_plans
from .base import Query, dirty, rounded, table, with_d

ORDERS = "SELECT * FROM orders"
ORDERS_TEXT_DATE = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders"


def _path(spark, suffix):
    return f"{shared_dir(spark)}/io-{uuid.uuid4().hex}{suffix}"


def _day_text(df):
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


def _round_trip(suffix, write, prepare=lambda df: df):
    def run(spark, sf):
        path = _path(spark, suffix)
        write(prepare(table(spark, sf, "orders")), path)
        return readers.load(spark, path)

    return run


def _json(spark, sf):
    path = _path(spark, ".json")
    writers.write_json(_day_text(table(spark, sf, "orders")), path)
    return readers.load(spark, path).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def _documents(suffix, write):
    """Texts with line breaks, quotes and separators."""

    def run(spark, sf):
        path = _path(spark, suffix)
        quoted = table(spark, sf, "documents").withColumn("text", F.concat(F.lit('say "'), F.col("text"), F.lit('",\tend\nof it')))
        write(quoted, path)
        return readers.load(spark, path)

    return run


_DOCUMENTS = """SELECT doc_id, 'say "' || text || '",' || chr(9) || 'end' || chr(10) || 'of it' AS text, lang, source, n_chars FROM documents"""


#: Bytes in a range at least and at most.
SMALL, LARGE = 1 << 15, 1 << 25
#: Records in a JSON array and rows in a JSON object of columns at most.
ARRAY, OBJECT = 1 << 10, 1 << 17


def _range_size(total):
    """Bytes in a range: a 64th of all, so that their number doesn't grow with a table until they are large enough for a task."""
    return min(max(SMALL, total // 64), LARGE)


@contextmanager
def _ranges(spark, path):
    """Files are read in ranges: more than 8 even at the smallest scale, of up to 32 MB at large ones."""
    size = _range_size(spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    kept = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, str(size))
    try:
        yield
    finally:
        for n, v in zip(names, kept):
            spark.conf.set(n, v)


def _csv_split(spark, sf):
    """Files whose cells hold line breaks, one for each partition of the table, read in ranges."""
    path = _path(spark, ".csv")
    quoted = table(spark, sf, "documents").withColumn("text", F.concat(F.lit('say "'), F.col("text"), F.lit('",\tend\nof it')))
    writers.write_csv(quoted, path)
    with _ranges(spark, path):
        return materialize(readers.load(spark, path), "read")


def _json_array(spark, sf):
    """Arrays of records, each on a single line and of a bounded number of neighbouring rows, read in ranges."""
    path = _path(spark, ".json")
    place = F.monotonically_increasing_id()
    rows = table(spark, sf, "documents").select((place / ARRAY).cast("long").alias("p"), F.to_json(F.struct("doc_id", "text", "lang", "source", "n_chars")).alias("r"))
    rows.groupBy("p").agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ", "), F.lit("]")).alias("value")).select("value").write.text(path)
    with _ranges(spark, path):
        return materialize(readers.read_json(spark, path, orient="records"), "read").select("doc_id", "text", "lang", "source", "n_chars")


def _json_columns(spark, sf):
    """A table as objects of columns, by row label, read in ranges: one file up to a bounded number of rows, then several with their own labels."""
    path = _path(spark, ".json")
    names = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    parts = table(spark, sf, "part")
    files = -(-parts.count() // OBJECT) or 1
    cell = lambda c: F.struct(F.lit(c).alias("c"), F.regexp_replace(F.to_json(F.struct(F.col(c).alias("x"))), r'^\{"x":|\}$', "").alias("v"))
    cells = parts.select(F.pmod(F.xxhash64("p_partkey"), F.lit(files)).alias("file"), F.col("p_partkey").alias("k"), F.explode(F.array(*[cell(c) for c in names])).alias("x"))
    columns = cells.groupBy("file", "x.c").agg(F.concat(F.lit('"'), F.first("x.c"), F.lit('": {'), F.array_join(F.collect_list(F.concat(F.lit('"'), "k", F.lit('": '), "x.v")), ", "), F.lit("}")).alias("v"))
    objects = columns.groupBy("file").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("v"), ", "), F.lit("}")).alias("value"))
    objects.write.partitionBy("file").text(path)
    with _ranges(spark, path):
        return materialize(readers.read_json(spark, path, orient="columns"), "read").select(*names)


def _feather_overwrite(spark, sf):
    path = _path(spark, ".feather")
    orders = table(spark, sf, "orders")
    writers.write_feather(orders.repartition(4), path)
    writers.write_feather(orders.where("o_orderkey % 3 = 0").coalesce(1), path, mode="overwrite")
    return readers.load(spark, path)


def _feather_empty(spark, sf):
    path = _path(spark, ".feather")
    writers.write_feather(table(spark, sf, "orders").where("o_orderkey IS NULL"), path)
    return readers.load(spark, path)


def _files_of(df):
    """Files for a table: four, or as many as its scan has tasks, so that none grows with the table."""
    return max(4, df.rdd.getNumPartitions())


def _feather_pruned(spark, sf):
    path = _path(spark, ".feather")
    lines = table(spark, sf, "lineitem")
    writers.write_feather(lines.repartition(_files_of(lines)), path)
    df = readers.read_feather(spark, path, ["l_returnflag", "l_quantity"])
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def _csv_summary(spark, sf):
    path = _path(spark, ".csv")
    writers.write_csv(dirty(spark, sf), path)
    return load_summary(readers.load(spark, path))


_WRAPPED = "CASE CAST(event_id % 4 AS INT) WHEN 0 THEN props WHEN 1 THEN 'Here you go: ' || props || ' - done.' WHEN 2 THEN 'no object' ELSE props || ' and ' || props END"
_WRAPPED_SQL = _WRAPPED.replace("CAST(event_id % 4 AS INT)", "event_id % 4")


def _noisy(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", f"{_WRAPPED} AS text")


_ROUTE_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{stage}'" for stage, words in textops.ROUTES
) + f" ELSE '{textops.DIRECT}' END"
_ASK = """CASE CAST(conv_id % 5 AS INT) WHEN 0 THEN 'Please CLEAN MY data: ' WHEN 1 THEN 'Train model on ' WHEN 2 THEN 'run all on ' WHEN 3 THEN 'one-hot and normalize ' ELSE '' END"""
_ASK_SQL = _ASK.replace("CAST(conv_id % 5 AS INT)", "conv_id % 5")


def _questions(spark, sf):
    return table(spark, sf, "conversations").selectExpr("conv_id", "turn", f"{_ASK} || text AS text")


def _workflow(spark, sf):
    return workflow.run_all(dirty(spark, sf), target="status", key="id")


def _stream(spark, sf):
    """Plans fitted on the batch table, then run over the same files as a stream."""
    batch = dirty(spark, sf).select("id", "price", "priority")
    source = _path(spark, "")
    writers.write_parquet(batch, source)
    fitted = [clean_ops.fit_impute_numeric(batch), clean_ops.fit_impute_categorical(batch)]
    filled = apply_plans(batch, fitted)
    plans = [*fitted, clean_ops.fit_cap_outliers(filled), clean_ops.NormalizeText(("priority",)), features.fit_log_transform(filled, ["price"])]
    stream = spark.readStream.schema(batch.schema).parquet(source)
    out, state = _path(spark, ""), _path(spark, "")
    query = apply_plans(stream, plans).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return rounded(spark.read.parquet(out), 4)


_STREAM_SQL = with_d(
    """WITH f AS (SELECT id, coalesce(price, (SELECT quantile_cont(price,0.5) FROM d)) AS price,
coalesce(priority, (SELECT priority FROM d WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)) AS priority FROM d),
q AS (SELECT quantile_cont(price,0.25) AS a, quantile_cont(price,0.75) AS b FROM f),
c AS (SELECT id, least(greatest(price, a-1.5*(b-a)), b+1.5*(b-a)) AS price, lower(trim(priority)) AS priority FROM f CROSS JOIN q)
SELECT id, round(price,4) AS price, priority, round(ln(1+price),4) AS price_log FROM c"""
)

QUERIES = {
    "csv_round_trip": Query(_round_trip(".csv", writers.write_csv, _day_text), ORDERS_TEXT_DATE),
    "tsv_round_trip": Query(_round_trip(".tsv", writers.write_tsv, _day_text), ORDERS_TEXT_DATE),
    "json_round_trip": Query(_json, ORDERS_TEXT_DATE),
    "parquet_round_trip": Query(_round_trip(".parquet", writers.write_parquet), ORDERS),
    "feather_round_trip": Query(_round_trip(".feather", writers.write_feather), ORDERS),
    "csv_multiline_round_trip": Query(_documents(".csv", writers.write_csv), _DOCUMENTS),
    "tsv_multiline_round_trip": Query(_documents(".tsv", writers.write_tsv), _DOCUMENTS),
    "csv_multiline_split": Query(_csv_split, _DOCUMENTS),
    "json_array_split": Query(_json_array, "SELECT doc_id, text, lang, source, n_chars FROM documents"),
    "json_columns": Query(_json_columns, "SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part"),
    "feather_overwrite": Query(_feather_overwrite, "SELECT * FROM orders WHERE o_orderkey % 3 = 0"),
    "feather_empty": Query(_feather_empty, "SELECT * FROM orders WHERE o_orderkey IS NULL"),
    "feather_pruned": Query(
        _feather_pruned, "SELECT l_returnflag, count(*) AS rows, round(sum(l_quantity),2) AS quantity FROM lineitem GROUP BY 1"
    ),
    "csv_load_summary": Query(
        _csv_summary,
        # Read back, '{n/a}' cells count as missing and the two all-number text columns become numbers.
        with_d(
            """SELECT count(*) AS rows, 11::INTEGER AS columns, m::BIGINT AS missing_cells, round(m*100.0::DOUBLE/(count(*)*11),1) AS missing_pct,
6::INTEGER AS numeric_columns, 5::INTEGER AS categorical_columns, 0::INTEGER AS datetime_columns
FROM (SELECT *, sum((CASE WHEN price IS NULL THEN 1 ELSE 0 END)+(CASE WHEN priority IS NULL THEN 1 ELSE 0 END)+(CASE WHEN sparse80 IS NULL THEN 1 ELSE 0 END)
+(CASE WHEN sparse95 IS NULL THEN 1 ELSE 0 END)+(CASE WHEN num_text='n/a' THEN 1 ELSE 0 END)) OVER () AS m FROM d) GROUP BY m"""
        ),
    ),
    "question_routing": Query(
        lambda s, d: textops.route_questions(_questions(s, d), "text").select("conv_id", "turn", "stage"),
        f"SELECT conv_id, turn, {_ROUTE_SQL} AS stage FROM (SELECT conv_id, turn, {_ASK_SQL} || text AS text FROM conversations)",
    ),
    "question_counts": Query(
        lambda s, d: textops.route_counts(table(s, d, "conversations"), "text"), f"SELECT {_ROUTE_SQL} AS stage, count(*) AS questions FROM conversations GROUP BY 1"
    ),
    "json_recovery": Query(
        lambda s, d: textops.recover_json(_noisy(s, d), "text").select("event_id", "json", "json_valid"),
        "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN props END AS json, event_id % 4 < 2 AS json_valid FROM events",
    ),
    "action_recovery": Query(
        lambda s, d: textops.recover_actions(
            table(s, d, "events").selectExpr("event_id", """'Sure. {"action": {"tool": "' || event_type || '", "arguments": ' || props || '}, "summary": "s"} ok' AS text"""), "text"
        ).select("event_id", "json_valid", "tool", F.get_json_object("arguments", "$.k").alias("k"), "summary"),
        """SELECT event_id, true AS json_valid, event_type AS tool, json_extract_string(props, '$.k') AS k, 's' AS summary FROM events""",
    ),
    "end_to_end_stages": Query(lambda s, d: workflow.summary(_workflow(s, d))),
    "end_to_end_report": Query(lambda s, d: workflow.combined_report(workflow.run_all(dirty(s, d), target="status", key="id", stages=["profile", "no_such_stage", "clean", "feature_engineer"]))),
    "stream_cleaning": Query(_stream, _STREAM_SQL),
}
