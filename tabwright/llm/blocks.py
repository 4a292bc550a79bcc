"""Groups of any size as pairs of bounded blocks: tasks compare rows without emitting their pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def block_pairs(rows: DataFrame, key: str, node: str, block: int) -> DataFrame:
    """``rows`` of keys that occur twice or more, with (lo, hi, block): each row once for every pair of blocks of its key.

    A key's rows are dealt by hash over blocks of about ``block`` rows. (key, lo, hi) names a group of two
    blocks at most, in which every two rows of a key meet in one group, or in the groups of their own block.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(key, F.ceil(F.col("__n") / block).cast("int").alias("__blocks"))
    placed = rows.join(sizes, key).withColumn("block", F.pmod(F.xxhash64(node, key), F.col("__blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__other")
    return placed.select(*rows.columns, "block", other).select(*rows.columns, F.least("block", "__other").alias("lo"), F.greatest("block", "__other").alias("hi"), "block")


def sorted_groups(pairs: DataFrame, key: str) -> DataFrame:
    """The rows of each group behind each other."""
    keys = [key, "lo", "hi"]
    return pairs.select(*keys, *[c for c in pairs.columns if c not in keys]).repartition(*keys).sortWithinPartitions(*keys)


def runs(batches) -> Iterator[pa.Table]:
    """One table for each group; its first three columns name it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)])
        edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            own = tuple(key[:, a].tolist())
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = own
    if held:
        yield pa.Table.from_batches(held)
