"""Frequency tables: the shared base of modes, top-k lists, cardinalities and bar charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.kinds import col
from ..functions.missing import present


def value_table(df: DataFrame, names: list[str]) -> DataFrame:
    """Long form ``(column, value)`` of the named columns as text, missing values left out."""
    pairs = [F.struct(F.lit(n).alias("column"), present(df, n).cast("string").alias("value")) for n in names]
    return df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull())


def freq_table(df: DataFrame, names: list[str]) -> DataFrame:
    """``(column, value, count)`` for all named columns in one shuffle.

    Counts are combined before the shuffle, so a value held by a third of all rows costs one row
    per task.
    """
    return value_table(df, names).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def top_values(freq: DataFrame, k: int) -> DataFrame:
    """The k most frequent values per column, ties by value: ``(column, rank, value, count)``.

    Spark pushes the ``rank <= k`` limit below the shuffle, so each task sends at most k rows per
    column.
    """
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return (
        freq.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("column", F.col("rank").cast("int").alias("rank"), "value", "count")
    )


def value_counts(df: DataFrame, name: str, k: int | None = None) -> DataFrame:
    """Frequency of one column's values, most frequent first: ``(rank, value, count)``."""
    counts = df.where(present(df, name).isNotNull()).groupBy(col(name).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    if k is None:
        return counts.orderBy(F.desc("count"), F.asc("value"))
    # orderBy + limit plans as TakeOrderedAndProject, so the window below sees k rows at most.
    top = counts.orderBy(F.desc("count"), F.asc("value")).limit(k)
    order = Window.orderBy(F.desc("count"), F.asc("value"))
    return top.select(F.row_number().over(order).cast("int").alias("rank"), "value", "count")


def column_modes(df: DataFrame, names: list[str]) -> dict[str, tuple[str | None, int, int]]:
    """Per column ``(mode as text, present count, distinct count)``; ties take the smallest value.

    Collects one row per column.
    """
    if not names:
        return {}
    # min over (-count, value) picks the highest count and, on ties, the smallest value.
    rows = (
        freq_table(df, names)
        .groupBy("column")
        .agg(
            F.min(F.struct((-F.col("count")).alias("rank"), "value")).alias("best"),
            F.sum("count").alias("present"),
            F.count(F.lit(1)).alias("distinct"),
        )
        .select("column", F.col("best.value").alias("mode"), "present", "distinct")
        .collect()
    )
    found = {r["column"]: (r["mode"], r["present"], r["distinct"]) for r in rows}
    return {n: found.get(n, (None, 0, 0)) for n in names}
