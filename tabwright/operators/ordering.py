"""Row positions and bounded heads over an explicit order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.kinds import col, require_columns
from ..session import materialize

SLOT_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def with_position(df: DataFrame, order_by: list[str], name: str = "position", keep: list[str] | None = None) -> DataFrame:
    """0-based global row positions without a single-task window.

    Rows are range-partitioned and sorted, the partition sizes (one row per partition) give each
    partition its offset. A hash of the row splits equal keys over partitions: positions among rows that
    ``order_by`` does not tell apart are free. The sorted table is written once so that sizes and rows agree.
    """
    require_columns(df, order_by)
    keep = df.columns if keep is None else list(dict.fromkeys(keep))
    needed = list(dict.fromkeys([*keep, *order_by]))
    keys = [col(c) for c in order_by]
    spread = F.xxhash64(*[col(c) for c in needed if not isinstance(df.schema[c].dataType, T.MapType)])
    ranged = df.select(*[col(c) for c in needed]).repartitionByRange(*keys, spread).sortWithinPartitions(*keys, spread)
    saved = materialize(ranged.withColumn("__slot", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__slot", SLOT_BITS)
    sizes = saved.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    offsets, start = [], 0
    for row in sizes:
        offsets.append((row["p"], start))
        start += row["n"]
    if not offsets:
        return saved.select(*[col(c) for c in keep], F.lit(0).cast("bigint").alias(name))
    table = df.sparkSession.createDataFrame(offsets, "__p bigint, __start bigint")
    # One row per sort partition: bounded by the partition count.
    placed = saved.join(F.broadcast(table), part == F.col("__p"))
    at = F.col("__start") + F.col("__slot").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    return placed.select(*[col(c) for c in keep], at.alias(name))


def sort_rows(df: DataFrame, by: str, key: list[str], ascending: bool = True) -> DataFrame:
    """Interactive column sort; missing values last, ties by the key."""
    first = col(by).asc_nulls_last() if ascending else col(by).desc_nulls_last()
    return df.orderBy(first, *[col(k) for k in key])


def sort_page(df: DataFrame, by: str, key: list[str], page: int = 10_000, ascending: bool = True) -> DataFrame:
    """The first page of a sorted table (a top-k, not a full sort)."""
    return sort_rows(df, by, key, ascending).limit(page)


def is_truncated(df: DataFrame, page: int = 10_000) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.least("total_rows", F.lit(page)).cast("bigint").alias("shown_rows"), (F.col("total_rows") > page).alias("is_truncated")
    )
