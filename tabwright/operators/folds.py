"""Train/test split and cross-validation folds.

A split or a block fold is a range of the order key, so assigning it is a comparison with a few literal
cut values: no sort, no window and no shuffle of the table. The cut values are exact order statistics.
Stratified folds rank the rows of each class by one range partitioning of the table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.kinds import DATETIME, NUMERIC, kind_of, quoted, require_columns
from ..functions.missing import literal_sql
from ..session import materialize
from .moments import aggregate
from .quantiles import order_statistics

# A prime modulus and a multiplier near its golden section. The fifth power is a permutation of the
# residues (5 and the modulus minus 1 share no factor), so distinct keys below the modulus keep
# distinct hashes, and neighbouring keys land far apart.
HASH_MODULUS = 2147483647
HASH_MULTIPLIER = 1327217885


def key_sql(df: DataFrame, key: str) -> str:
    """The order key as BIGINT or DOUBLE text."""
    dtype = df.schema[key].dataType
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return f"CAST({quoted(key)} AS BIGINT)"
    if kind_of(dtype) == NUMERIC:
        return f"CAST({quoted(key)} AS DOUBLE)"
    if kind_of(dtype) == DATETIME:
        return f"unix_micros(CAST({quoted(key)} AS TIMESTAMP))"
    raise ValueError(f"order key {key!r} must be numeric or a timestamp")


def hash_sql(df: DataFrame, key: str, seed: int) -> str:
    """A shuffling hash of the row key as BIGINT text."""
    if isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        p = HASH_MODULUS
        x = f"((pmod(CAST({quoted(key)} AS BIGINT), {p}L) + {seed % p}L) % {p}L * {HASH_MULTIPLIER}L % {p}L)"
        square = f"({x} * {x} % {p}L)"
        # Keys beyond the modulus can share a residue; their low 32 bits then order them.
        return f"({square} * {square} % {p}L * {x} % {p}L * 4294967296L + pmod(CAST({quoted(key)} AS BIGINT), 4294967296L))"
    return f"xxhash64({quoted(key)}, {seed}L)"


def _extent(df: DataFrame, name: str) -> tuple[int, object, object]:
    row = aggregate(df, [f"count({quoted(name)}) AS n", f"min({quoted(name)}) AS lo", f"max({quoted(name)}) AS hi"]).first()
    return row["n"], row["lo"], row["hi"]


def with_split(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 42, name: str = "is_test") -> DataFrame:
    """Mark ceil(n * fraction) rows as test, shuffled by a hash of a unique key and reproducible."""
    require_columns(df, [key])
    h = hash_sql(df, key, seed)
    hashed = df.selectExpr(f"{h} AS h")
    n, lo, hi = _extent(hashed, "h")
    if not n:
        return df.withColumn(name, F.lit(False))
    rank = math.ceil(round(n * test_fraction, 9))
    if rank <= 0:
        return df.withColumn(name, F.lit(False))
    cut = order_statistics(hashed, {"h": [rank]}, {"h": (lo, hi)}, {"h": n})["h"][rank]
    return df.withColumn(name, F.expr(f"{h} <= {literal_sql(cut)}"))


def train_test_split(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    marked = with_split(df, key, test_fraction, seed, "__is_test")
    return marked.where("NOT __is_test").drop("__is_test"), marked.where("__is_test").drop("__is_test")


def _fold_sql(key: str, starts: list) -> str:
    """Fold number = how many fold starts lie at or before the row; a start of None is always passed."""
    terms = ["1" if s is None else f"CAST({key} > {literal_sql(s)} AS INT)" for s in starts]
    return " + ".join(terms) or "0"


def with_block_folds(df: DataFrame, key: str, folds: int = 5, name: str = "fold") -> DataFrame:
    """Contiguous, unshuffled folds over the key order; the first n mod k folds hold one row more."""
    k = key_sql(df, key)
    keyed = df.selectExpr(f"{k} AS k")
    n, lo, hi = _extent(keyed, "k")
    if not n:
        return df.withColumn(name, F.lit(0))
    ends, total = [], 0
    for i in range(folds - 1):
        total += n // folds + (1 if i < n % folds else 0)
        ends.append(total)
    found = order_statistics(keyed, {"k": sorted({e for e in ends if e > 0})}, {"k": (lo, hi)}, {"k": n})["k"]
    return df.withColumn(name, F.expr(_fold_sql(k, [found[e] if e > 0 else None for e in ends])))


def with_stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5, name: str = "fold") -> DataFrame:
    """Unshuffled stratified folds: each class is cut into blocks along the key order.

    Classes are laid end to end in order of first appearance; fold i of a class gets as many rows
    as that class has positions congruent to i modulo the fold count.

    One range partitioning by (class, key) for any number of classes, so a large class lies in many
    partitions; a row's rank in its class is its place in its partition plus the rows of the class before
    it, which are known from one small row for each class and partition. Rows of one class and key are
    in any order.
    """
    require_columns(df, [label, key])
    kept = df.columns
    rows = df.select("*", F.col(quoted(label)).alias("__class"), F.expr(key_sql(df, key)).alias("__order"))
    by = ["__class", "__order"]
    ranged = rows.repartitionByRange(*by, F.xxhash64(*[F.col(quoted(c)) for c in kept if not isinstance(df.schema[c].dataType, T.MapType)])).sortWithinPartitions(*by)
    saved = materialize(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__slot", F.monotonically_increasing_id()), "folds")
    pieces = saved.groupBy("__class", "__part").agg(F.count(F.lit(1)).alias("n"), F.min("__slot").alias("slot"), F.min("__order").alias("first"))
    pieces = materialize(pieces, "fold-pieces")
    # One row for each class goes through one task.
    classes = pieces.groupBy("__class").agg(F.sum("n").alias("size"), F.min("first").alias("first"))
    laid = Window.orderBy(F.col("first").asc_nulls_last(), F.col("__class").asc_nulls_last())
    classes = classes.withColumn("begin", F.sum("size").over(laid.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    before = F.sum("n").over(Window.partitionBy("__class").orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    classes = classes.select(F.col("__class").alias("c"), "size", "begin")
    found = pieces.withColumn("before", before).join(classes, F.col("__class").eqNullSafe(F.col("c")))
    found = found.select(F.col("__class").alias("__c"), F.col("__part").alias("__p"), "slot", "before", "begin", (F.col("begin") + F.col("size")).alias("stop"))
    placed = saved.join(found, F.col("__class").eqNullSafe(F.col("__c")) & (F.col("__part") == F.col("__p")))
    rank = F.col("before") + F.col("__slot") - F.col("slot")
    ends, upto = [], "0L"
    for i in range(folds - 1):
        upto += f" + (stop + {folds - 1 - i}) div {folds} - (begin + {folds - 1 - i}) div {folds}"
        ends.append(F.when(rank >= F.expr(upto), 1).otherwise(0))
    fold = F.lit(0)
    for e in ends:
        fold = fold + e
    return placed.select(*[F.col(quoted(c)) for c in kept if c != name], fold.cast("int").alias(name))


def class_index(df: DataFrame, label: str) -> DataFrame:
    """``(class, index)`` of every class that is present, in order of its value; one row for each class."""
    classes = df.select(F.col(quoted(label)).alias("class")).where("class IS NOT NULL").distinct()
    # One row for each class goes through one task.
    return classes.withColumn("index", (F.row_number().over(Window.orderBy("class")) - 1).cast("double"))
