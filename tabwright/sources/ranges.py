"""Text files whose records do not end with their lines, read by many tasks.

A file is read as pieces between delimiters, which Spark splits by byte ranges. What a piece does to the state of a
parser (inside a quoted cell or not) is one of four functions of a two-valued state: to outside, to inside, keep, swap.
Functions compose, so each byte range is summed up on its own under both states in which it may begin; the summaries,
one small row for each range, are combined in order; and every piece then knows the state before it. Pieces
between two record starts are one record; only those at the end of a range meet others, in a group for each record.

A range is sorted in one task, as it is read; no file is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import materialize

RANGE = ["file", "block"]
OUT, IN, KEEP, SWAP = "out", "in", "keep", "swap"


def pieces(spark: SparkSession, path, delimiter: str) -> DataFrame:
    """(file, block, seq, value): the text between delimiters, with its byte range and its place in it."""
    text = spark.read.option("lineSep", delimiter).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")


def effect(from_out: Column, from_in: Column) -> Column:
    """The function of a piece that ends inside a quoted cell if ``from_out`` (begun outside) or ``from_in`` (begun inside)."""
    return F.when(from_out & from_in, F.lit(IN)).when(~from_out & ~from_in, F.lit(OUT)).when(from_in, F.lit(KEEP)).otherwise(F.lit(SWAP))


def with_states(df: DataFrame) -> DataFrame:
    """``df`` with (file, block, seq, effect) and ``if_out``, ``if_in``: whether a piece begins inside a quoted cell, for ranges that begin outside and inside."""
    before = Window.partitionBy(*RANGE).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*RANGE).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    swaps = F.sum((F.col("effect") == SWAP).cast("int"))
    marked = df.withColumn("__swaps", swaps.over(upto))
    # The last piece that ends in one state whatever came before; after it only swaps matter.
    fixed = F.last(F.when(F.col("effect").isin(OUT, IN), F.struct((F.col("effect") == IN).cast("int").alias("state"), F.col("__swaps").alias("swaps"))), ignorenulls=True).over(before)
    marked = marked.withColumn("__fixed", fixed).withColumn("__before", F.coalesce(F.lag("__swaps").over(Window.partitionBy(*RANGE).orderBy("seq")), F.lit(0)))
    state = lambda begin: F.coalesce(F.col("__fixed.state") + F.col("__before") - F.col("__fixed.swaps"), F.lit(begin) + F.col("__before")) % 2 == 1
    return marked.withColumns({"if_out": state(0), "if_in": state(1)}).drop("__swaps", "__fixed", "__before")


def begins(summaries: DataFrame) -> DataFrame:
    """(file, block, begins_in): the state in which each range begins, from (file, block, out_ends_in, in_ends_in): the state at its end for both."""
    own = effect(F.col("out_ends_in"), F.col("in_ends_in"))
    # One row for each range of a file.
    as_range = summaries.select("file", F.lit(0).alias("__all"), F.col("block").alias("seq"), own.alias("effect")).withColumnsRenamed({"__all": "block"})
    return with_states(as_range).select("file", F.col("seq").alias("block"), F.col("if_out").alias("begins_in"))


def records(df: DataFrame, glue: str) -> DataFrame:
    """(file, block, number, record): pieces (file, block, seq, value, if_out, if_in, out_ends, in_ends, starts_out, starts_in) put together.

    ``starts_*``: whether a record begins with the piece, ``*_ends``: whether it ends inside a quoted cell, both for ranges
    that begin outside and inside. A record is known by its range and its number in it.
    """
    order = Window.partitionBy(*RANGE).orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    count = lambda c: F.sum(F.col(c).cast("int")).over(upto)
    both = df.withColumns({"n_out": count("starts_out"), "n_in": count("starts_in"), "next_out": F.lead("starts_out").over(order), "next_in": F.lead("starts_in").over(order)})
    both = materialize(both.select(*RANGE, "seq", "value", *[f"{a}_{b}" for a in ("starts", "next", "n") for b in ("out", "in")], "out_ends", "in_ends"), "pieces")
    last = both.groupBy(*RANGE).agg(
        F.max_by("out_ends", "seq").alias("out_ends_in"), F.max_by("in_ends", "seq").alias("in_ends_in"), F.max("n_out").alias("m_out"), F.max("n_in").alias("m_in")
    )
    last = materialize(last, "ranges")
    known = last.join(begins(last), RANGE).select(*RANGE, "begins_in", F.when(F.col("begins_in"), F.col("m_in")).otherwise(F.col("m_out")).alias("m"))
    # What stands before the first start of a range goes on from the last record of a range before it.
    back = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    goes_on = F.last(F.when(F.col("m") > 0, F.struct("block", "m")), ignorenulls=True).over(back)
    known = materialize(known.withColumn("goes_on", goes_on), "ranges")
    pick = lambda c: F.when(F.col("begins_in"), F.col(f"{c}_in")).otherwise(F.col(f"{c}_out"))
    placed = both.join(known, RANGE).withColumns({"starts": pick("starts"), "next": pick("next"), "n": pick("n")})
    own = F.when(F.col("n") > 0, F.struct("block", F.col("n").alias("number"))).otherwise(F.struct(F.col("goes_on.block").alias("block"), F.col("goes_on.m").alias("number")))
    placed = placed.select("file", own.alias("of"), F.struct("block", "seq").alias("at"), "value", (F.col("starts") & F.coalesce("next", F.lit(False))).alias("whole")).where("of.block IS NOT NULL")
    alone = placed.where("whole").select("file", "of.block", "of.number", F.col("value").alias("record"))
    parts = placed.where("NOT whole").groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["value"]), glue)
    return alone.unionAll(parts.select("file", "of.block", "of.number", joined.alias("record")))


# --- delimited text --------------------------------------------------------------------------------------


def _cell_opens(line: Column, sep: str) -> Column:
    """Whether a line that begins outside a quoted cell ends inside one: then an opening quote is left when all whole quoted cells are cut out."""
    s = re.escape(sep)
    return F.regexp_replace(line, F.lit(rf'(^|{s})"(?:[^"]++|"")*+"(?!")'), F.lit("$1")).rlike(rf'(?:^|{s})"')


def delimited_records(spark: SparkSession, path, sep: str) -> DataFrame:
    """(file, block, number, record) of delimited files: lines, or several where a quoted cell goes on in the next line."""
    value = F.col("value")
    closed = F.regexp_replace(value, r'^(?:[^"]++|"")*+"(?!")', "x")  # behind the end of a cell there is no begin of one
    closes = value.rlike(r'^(?:[^"]++|"")*+"(?!")')
    lines = pieces(spark, path, "\n").withColumns({"__out": _cell_opens(value, sep), "__in": ~closes | _cell_opens(closed, sep)})
    lines = with_states(lines.withColumn("effect", effect(F.col("__out"), F.col("__in"))))
    ends = lambda begins_in: F.when(F.col(begins_in), F.col("__in")).otherwise(F.col("__out"))
    lines = lines.withColumns({"out_ends": ends("if_out"), "in_ends": ends("if_in"), "starts_out": ~F.col("if_out"), "starts_in": ~F.col("if_in")})
    found = records(lines, "\n")
    return found.withColumn("record", F.regexp_replace("record", "\r$", ""))


# --- JSON ------------------------------------------------------------------------------------------------

MARK = "\x01"
_STRING = r'"(?:[^"\\]++|\\.)*+"'


def _depth(text: Column) -> Column:
    """How many more brackets a text opens than it closes; strings must have been cut out."""
    return F.length(F.regexp_replace(text, r"[^\[{]", "")) - F.length(F.regexp_replace(text, r"[^\]}]", ""))


def _json_parts(spark: SparkSession, path, delimiter: str, done) -> DataFrame:
    """(file, block, number, record): the text of JSON files cut behind the delimiters at which ``done(depth)`` holds; those in strings don't count.

    A record that begins at a depth of 1 or less has ``MARK`` in front, which no JSON text holds.
    """
    value = F.col("value")
    bare = lambda text: F.regexp_replace(text, f"(?s){_STRING}", "")
    behind = r'(?s)^(?:[^"\\]++|\\.)*+"'
    closes = value.rlike(behind)
    df = pieces(spark, path, delimiter).withColumns({"__o": bare(value), "__i": bare(F.regexp_replace(value, behind, ""))})
    opens = lambda c: F.instr(c, '"') > 0
    df = df.withColumns({"__out": opens("__o"), "__in": ~closes | opens("__i")})
    own = lambda c: _depth(F.substring_index(c, '"', 1))
    # A bracket as delimiter closes unless it stands in a string.
    step = lambda c: (~F.col(c)).cast("int") if delimiter in "]}" else F.lit(0)
    df = df.withColumns({"d_out": own("__o") - step("__out"), "d_in": F.when(closes, own("__i")).otherwise(0) - step("__in")})
    df = with_states(df.select(*RANGE, "seq", "value", "__out", "__in", "d_out", "d_in", effect(F.col("__out"), F.col("__in")).alias("effect")))
    by = lambda begins_in, a, b: F.when(F.col(begins_in), F.col(a)).otherwise(F.col(b))
    order = Window.partitionBy(*RANGE).orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"e_{b}": F.sum(by(f"if_{b}", "d_in", "d_out")).over(upto) for b in ("out", "in")}
    df = df.withColumns({f"{b}_ends": by(f"if_{b}", "__in", "__out") for b in ("out", "in")} | sums)
    df = materialize(df.select(*RANGE, "seq", "value", "out_ends", "in_ends", "e_out", "e_in"), "json-pieces")
    last = df.groupBy(*RANGE).agg(*[F.max_by(a, "seq").alias(b) for a, b in (("out_ends", "out_ends_in"), ("in_ends", "in_ends_in"), ("e_out", "s_out"), ("e_in", "s_in"))])
    last = materialize(last, "json-ranges")
    known = last.join(begins(last), RANGE).withColumn("own", by("begins_in", "s_in", "s_out"))
    back = Window.partitionBy("file").orderBy("block")
    above = F.coalesce(F.sum("own").over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = materialize(known.select(*RANGE, "begins_in", above.alias("above")), "json-depths")
    depth = F.col("above") + by("begins_in", "e_in", "e_out")
    end = F.struct((done(depth) & ~by("begins_in", "in_ends", "out_ends")).alias("done"), depth.alias("depth"))
    df = df.join(known, RANGE).select(*RANGE, "seq", "value", end.alias("end"))
    ends = df.groupBy(*RANGE).agg(F.max_by("end", "seq").alias("end"))
    # The first piece of a file begins a record, as does one behind a cut.
    first = F.struct(F.lit(True).alias("done"), F.lit(0).cast("bigint").alias("depth"))
    ends = materialize(ends.select(*RANGE, F.coalesce(F.lag("end").over(back), first).alias("carried")), "json-ends")
    before = F.coalesce(F.lag("end").over(order), F.col("carried"))
    no = F.lit(False)
    flat = df.join(ends, RANGE).withColumn("before", before)
    marked = F.when(F.col("before.done") & (F.col("before.depth") <= 1), F.concat(F.lit(MARK), "value")).otherwise(F.col("value"))
    flat = flat.select(*RANGE, "seq", marked.alias("value"), no.alias("out_ends"), no.alias("in_ends"), F.col("before.done").alias("starts_out"), F.col("before.done").alias("starts_in"))
    return records(flat, delimiter)


def json_array_records(spark: SparkSession, path) -> DataFrame:
    """(record): the objects of JSON arrays of objects, each as one line."""
    found = _json_parts(spark, path, "}", lambda depth: depth == 1)
    # Brackets in front may end an array before this one, as a file may hold several.
    clean = F.regexp_replace("record", r"(?s)^[\x01\s\[\],]*", "")
    inner = F.concat(F.regexp_replace(clean, r"[\r\n]", " "), F.lit("}"))
    return found.where(~F.col("record").rlike(r"(?s)^[\x01\s\[\],]*$")).select(inner.alias("record"))


def json_column_records(spark: SparkSession, path) -> tuple[DataFrame, list[str]]:
    """(record) as one line each, and the names of the columns in order, for an object of columns: objects by row label, or arrays.

    Entries are cut at commas in any task; each knows the column it belongs to from the last one that begins before it.
    """
    found = materialize(_json_parts(spark, path, ",", lambda depth: depth <= 2), "json-entries")
    begin = rf"(?s)^\x01\s*\{{?\s*({_STRING})\s*:\s*([\[{{])"
    entry = F.regexp_replace("record", begin, "")
    name = F.nullif(F.regexp_extract("record", begin, 1), F.lit(""))
    marked = found.select("file", "block", "number", entry.alias("entry"), name.alias("name"), F.regexp_extract("record", begin, 2).alias("kind"))
    counts = marked.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("name").isNotNull(), F.struct("number", "name", "kind"))).alias("last"))
    back = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(back), F.lit(0))
    placed = counts.withColumn("before", before).withColumn("last", F.when(F.col("last").isNotNull(), F.struct((F.col("before") + F.col("last.number")).alias("at"), "last.name", "last.kind")))
    placed = materialize(placed.select("file", "block", "before", F.last("last", ignorenulls=True).over(back).alias("carried")), "json-columns")
    upto = Window.partitionBy("file", "block").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("name").isNotNull(), F.struct((F.col("before") + F.col("number")).alias("at"), "name", "kind")), ignorenulls=True).over(upto)
    each = marked.join(placed, ["file", "block"]).withColumn("of", F.coalesce(own, F.col("carried")))
    # Brackets that close the column (and the object) stand behind its last entry.
    bare = F.regexp_replace("entry", f"(?s){_STRING}", "")
    extra = -_depth(bare)
    text = F.rtrim(F.regexp_replace("entry", r"\s+$", ""))
    cut = F.when(extra > 0, F.regexp_replace(text, r"(?s)(?:\s*[\]}]){1,2}$", "")).otherwise(text)
    twice = F.when(extra == 1, F.regexp_replace(text, r"(?s)\s*[\]}]$", "")).otherwise(cut)
    key = rf"(?s)^\s*({_STRING})\s*:\s*"
    label = F.when(F.col("of.kind") == "{", F.regexp_extract("entry", key, 1)).otherwise((F.col("before") + F.col("number") - F.col("of.at")).cast("string"))
    value = F.when(F.col("of.kind") == "{", F.regexp_replace(twice, key, "")).otherwise(twice)
    cells = each.select("file", F.col("of.at").alias("at"), F.col("of.name").alias("name"), label.alias("label"), F.regexp_replace(value, r"[\r\n]", " ").alias("value")).where(F.length(F.trim("value")) > 0)
    cells = materialize(cells, "json-cells")
    names = [r["name"] for r in cells.groupBy("name").agg(F.min(F.struct("file", "at")).alias("at")).orderBy("at").collect()]
    lines = cells.groupBy("file", "label").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat("name", F.lit(":"), "value")), ","), F.lit("}")).alias("record"))
    return lines.select("record"), names
