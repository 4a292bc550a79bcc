"""Mixing sources to target weights, exact to the word.

1. Every document gets a key that is random but fixed (a hash of seed and id) and its size in words.
2. Documents are range-partitioned and sorted by (source, key), so a source with a third of all rows
   lies in many partitions.
3. Distributed prefix sums: sums of each (partition, source), then offsets over those few sums, then
   running sums inside each piece of a partition.
4. A source whose target is e times its size and a rest R is taken e times as a whole (epochs), then from
   its smallest key on until R words are reached; the document on the border gives just the words that
   are missing. What is kept of a source is one row: its epochs and its border.

Targets share all words by weight; a target stops at ``MAX_EPOCHS`` times its source's size and what is
above goes to the other sources by weight, until none is above. Sorted by (limit / weight) the stopped
sources are a prefix, so this is one running sum over one row for each source.

Defined cases: a null or empty text has size 0 and nothing is taken of it; null is a source of its own,
last in order; repeated rows (same id, source and size) that lie on the border share its words evenly; null
ids hash as text 'null'; an empty table gives an empty result; input columns named like an output are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

SPACES = r"[\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Sources (and pieces of partitions) whose rows are broadcast, of about 100 bytes each; beyond it they are joined by shuffle.
BROADCAST_ROWS = 100_000
OUT = ("size", "source_size", "target", "taken")


def word_count(text_col: str) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), SPACES), "")).cast("bigint")


def key_of(id_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """(__source, source_size, target) from (__source, source_size); one row for each source goes through one task."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.select("*", w.cast("bigint").alias("w")).withColumn("cap", most * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("__source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = ranked.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("rest"),
        F.sum("w").over(onward).alias("open"),
    ).withColumn("stopped", F.col("cap") * F.col("open") <= F.col("rest") * F.col("w"))
    done = level.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("cap"))).over(everything), F.lit(0))).alias("left"),
        F.sum(F.when(~F.col("stopped"), F.col("w"))).over(everything).alias("of"),
    )
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise((F.col("left") * F.col("w")).cast("double") / F.col("of"))
    return done.select("__source", "source_size", target.alias("target"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def keyed(df: DataFrame, id_col: str, source_col: str, text_col: str, seed: str) -> DataFrame:
    return df.select("*", F.col(source_col).alias("__source"), F.col(id_col).alias("__id"), key_of(id_col, seed).alias("__key"), word_count(text_col).alias("__size"))


def borders(keys: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """One row for each source of (__source, __id, __key, __size): size, target, epochs, and the border of the last epoch."""
    units = keys.groupBy("__source", "__key", "__id", "__size").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.col("n") * F.col("__size"))
    order = ["__source", "__key", "__id", "__size"]
    ranged = units.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("p", F.spark_partition_id()).withColumn("slot", F.monotonically_increasing_id()), "mix-order")
    pieces = ranged.groupBy("__source", "p").agg(F.sum("all").alias("piece"))
    pieces = pieces.withColumn("start", F.sum("piece").over(Window.partitionBy("__source").orderBy("p")) - F.col("piece"))
    pieces = materialize(pieces, "mix-pieces")
    sources = materialize(targets(pieces.groupBy("__source").agg(F.sum("piece").alias("source_size")), weights, most), "mix-targets")
    size, whole = F.col("source_size"), F.floor("target").cast("bigint")
    sources = sources.select("*", F.when(size > 0, F.expr("CAST(floor(target) AS BIGINT) div source_size")).otherwise(F.lit(0)).cast("bigint").alias("epochs"))
    sources = sources.withColumn("rest", whole - F.col("epochs") * size)
    # Only the pieces that hold a border, one for each source at most, are summed row by row.
    rests = _small(sources.select(F.col("__source").alias("s2"), "rest"))
    cut = pieces.join(rests, F.col("__source").eqNullSafe(F.col("s2"))).where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("piece")))
    cut = _small(cut.select(F.col("__source").alias("s1"), F.col("p").alias("p1"), "start", "rest"))
    placed = ranged.join(cut, F.col("__source").eqNullSafe(F.col("s1")) & (F.col("p") == F.col("p1")))
    upto = F.col("start") + F.sum("all").over(Window.partitionBy("__source", "p").orderBy("slot"))
    border = placed.withColumn("upto", upto).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("all") <= F.col("rest")))
    border = border.groupBy("__source").agg(
        F.min(F.struct(F.struct("__key", "__id", "__size").alias("at"), ((F.col("rest") - F.col("upto") + F.col("all")) / F.col("n")).cast("bigint").alias("words"))).alias("b")
    )
    return sources.join(border.select(F.col("__source").alias("s3"), "b"), F.col("__source").eqNullSafe(F.col("s3")), "left").select(
        "__source", "source_size", "target", "epochs", F.col("b.at").alias("border"), F.col("b.words").alias("words")
    )


def apply_borders(keys: DataFrame, cuts: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns with size, source_size, target and taken (words, epochs counted)."""
    cuts = materialize(cuts, "mix-cuts")
    c = _small(cuts.withColumnsRenamed({"__source": "s", "border": "__border", "words": "__words", "epochs": "__epochs", "source_size": "__all", "target": "__target"}))
    at = F.struct("__key", "__id", "__size")
    last = F.when(F.col("__border").isNull(), F.lit(0)).when(at < F.col("__border"), F.col("__size")).when(at == F.col("__border"), F.col("__words")).otherwise(F.lit(0))
    last = F.when(F.col("__size") == 0, F.lit(0)).otherwise(last)
    joined = keys.join(c, F.col("__source").eqNullSafe(F.col("s")), "left")
    return joined.select(*keep, F.col("__size").alias("size"), F.col("__all").alias("source_size"), F.col("__target").alias("target"), (F.col("__epochs") * F.col("__size") + last).cast("bigint").alias("taken"))


def mix(
    df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS, seed: str = SEED, keep: list[str] | None = None
) -> DataFrame:
    """The kept columns of each document with size, source_size, target and taken."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in OUT]
    keys = keyed(df, id_col, source_col, text_col, seed)
    small = materialize(keys.select("__source", "__id", "__key", "__size"), "mix-keys")
    cuts = borders(small, weights, most)
    own = keys.select(*keep, "__source", "__id", "__key", "__size")
    if keep == [id_col]:  # all that is asked for has been written already
        own = small.withColumn(id_col, F.col("__id"))
    return apply_borders(own, cuts, keep)


def write_out(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """One row for each time a document is taken. The one on the border holds only the words that are missing, joined by spaces."""
    words_of = (F.col("taken") - F.col("__copy") * F.col("size")).cast("int")
    copies = mixed.where(F.col("taken") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(0), F.expr("CAST(ceil(taken / size) AS INT) - 1"))))
    cut = F.array_join(F.slice(F.array_remove(F.split(F.col(text_col), SPACES), ""), F.lit(1), words_of), " ")
    return copies.withColumn(text_col, F.when(words_of < F.col("size"), cut).otherwise(F.col(text_col))).drop("__copy")
