"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosines, distributed components.

1. Only vectors of one label are compared. Equal vectors of a label become one node with a weight.
2. Each node gets signatures of random-hyperplane signs in several tables; nodes of one label meet in every
   bucket they share. The bits follow the logarithm of the number of nodes, so buckets keep their size, and
   the tables follow from ``MISS``: the chance that a pair exactly at the limit shares no bucket. A link is
   never reported without its exact cosine, in double precision.
3. Vectors and signatures are written once to the shared folder and mapped by the tasks; only ids are
   shuffled. A bucket is cut into blocks of about ``BLOCK`` nodes and every pair of blocks is a group of its
   own, so no task holds more than two blocks whatever the size of a bucket.
4. A pair counts in the first table in which its signatures agree, so one met in several tables adds to the
   number of links once. What leaves a task is, for each node, a sum of links and the link to the node above
   it in a spanning forest of the group's links: numbers proportional to nodes, not to pairs. The forests of
   all groups together connect what the links connect.

Defined cases: null vectors, empty or zero vectors, and vectors with null or non-finite components link
with nothing, nor do rows with a null label or a null id; vectors of different lengths don't link; repeated
rows (same id and vector) are one vector for the others; a limit met by rounding alone counts as met;
an empty table gives an empty result; further input columns are left out.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, ship_package
from . import hashstore
from .blocks import block_pairs, runs, sorted_groups
from .components import components
from .jaccard_join import node_shard
from .words import mix

LIMIT, MISS, BLOCK, SEED = 0.93, 1e-5, 512, 11
#: Nodes that an average bucket of one label would hold, if all nodes had that label.
BUCKET = 256
NODES_A_SHARD = 4096
NODE_TYPES = (np.int64, np.int64)


def tables_and_bits(nodes: int, limit: float) -> tuple[int, int]:
    bits = min(max(math.ceil(math.log2(max(nodes, 1) / BUCKET)), 6), 30)
    agree = (1 - math.acos(limit) / math.pi) ** bits
    return math.ceil(math.log(MISS) / math.log1p(-agree)), bits


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector scaled to a largest component of 1; None for those that link with nothing."""
    column = column.cast(pa.large_list(pa.float64()))
    flat, ends = column.values, column.offsets.to_numpy()
    bad = np.array(flat.is_null())
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    out: list[np.ndarray | None] = []
    for ok, a, b in zip(column.is_valid().to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
        v = values[a:b]
        if not ok or a == b or bad[a:b].any() or not np.isfinite(v).all() or not v.any():
            out.append(None)
        else:
            out.append(v / np.abs(v).max())
    return out


def _name(label: int, v: np.ndarray) -> int:
    bits = mix((v + 0.0).view(np.uint64) + mix(np.arange(len(v), dtype=np.uint64)))  # + 0.0: one zero
    return int(mix(np.append(bits, mix(np.array([label], np.int64).view(np.uint64))).sum(keepdims=True, dtype=np.uint64)).astype(np.int64)[0])


def name_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, node) with a null node for rows that link with nothing."""

    def run(batches):
        for batch in batches:
            ids, labels = batch.column(0), batch.column(2).to_pylist()
            each = zip(ids.is_valid().to_pylist(), _vectors(batch.column(1)), labels)
            node = pa.array([_name(k, v) if i and v is not None and k is not None else None for i, v, k in each], pa.int64())
            yield pa.record_batch([ids, batch.column(2), node], names=["id", "label", "node"])

    picked = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).cast("bigint").alias("label"))
    return picked.mapInArrow(run, "id long, label long, node long")


def write_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, store: str, parts: int, tables: int, bits: int) -> DataFrame:
    """Write every node's vector and signatures; (node, bucket, tab): the buckets of each node."""
    packed = pa.schema([("shard", pa.int64()), ("node", pa.int64()), ("label", pa.int64()), ("body", pa.binary())])

    def run(batches):
        for batch in batches:
            ids, labels = batch.column(0).is_valid().to_pylist(), batch.column(2).to_pylist()
            rows = [(_name(k, v), k, v.tobytes()) for i, v, k in zip(ids, _vectors(batch.column(1)), labels) if i and v is not None and k is not None]
            nodes = np.array([r[0] for r in rows], np.int64)
            yield pa.record_batch([pa.array(node_shard(nodes, parts)), pa.array(nodes), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], schema=packed)

    def write(table: pa.Table) -> pa.Table:
        nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
        labels, body = table.column("label").to_numpy()[first], table.column("body").to_pylist()
        vectors = [np.frombuffer(body[i]) for i in first]
        signs = np.zeros((len(nodes), tables), np.int64)
        for size in {len(v) for v in vectors}:
            own = np.array([i for i, v in enumerate(vectors) if len(v) == size])
            planes = np.random.Generator(np.random.PCG64([SEED, size])).standard_normal((size, tables * bits))
            side = (np.stack([vectors[i] for i in own]) @ planes > 0).reshape(len(own), tables, bits)
            signs[own] = side @ (1 << np.arange(bits))
        shard = table.column("shard")[0].as_py()
        ends = np.cumsum([len(v) for v in vectors])
        hashstore.write_shard(store, "vectors", shard, nodes, ends, np.concatenate(vectors))
        hashstore.write_shard(store, "signs", shard, nodes, signs.reshape(-1))
        sizes = np.array([len(v) for v in vectors], np.uint64)
        tab = np.tile(np.arange(tables), len(nodes))
        key = mix(mix(signs.reshape(-1).astype(np.uint64) + (tab.astype(np.uint64) << np.uint64(32))) + np.repeat(mix(labels.astype(np.uint64)) + mix(sizes), tables))
        return pa.table({"node": np.repeat(nodes, tables), "bucket": key.astype(np.int64), "tab": tab.astype(np.int32)})

    picked = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).cast("bigint").alias("label"))
    return picked.mapInArrow(run, "shard long, node long, label long, body binary").groupBy("shard").applyInArrow(write, "node long, bucket long, tab int")


def _read(store: str, parts: int, tables: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    vectors, signs = [None] * len(nodes), np.zeros((len(nodes), tables), np.int64)
    shard = node_shard(nodes, parts)
    for p in np.unique(shard).tolist():
        stored, ends, blob = hashstore.read_shard(store, "vectors", p, NODE_TYPES, np.float64)
        _, own_signs = hashstore.read_shard(store, "signs", p, NODE_TYPES[:1], np.int64)
        at = np.flatnonzero(shard == p)
        place = np.searchsorted(stored, nodes[at])
        signs[at] = own_signs.reshape(-1, tables)[place]
        for i, k in zip(at.tolist(), place.tolist()):
            vectors[i] = blob[(ends[k - 1] if k else 0) : ends[k]]
    return np.stack(vectors), signs


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes, the node above it in a spanning forest of the links (i, j); -1 for roots and nodes without links."""
    linked = np.zeros((n, n), bool)
    linked[i, j] = linked[j, i] = True
    above, left = np.full(n, -1), np.ones(n, bool)
    for root in np.unique(i).tolist():
        open_ = [root] if left[root] else []
        left[root] = False
        while open_:
            at = open_.pop()
            below = np.flatnonzero(linked[at] & left)
            above[below], left[below] = at, False
            open_ += below.tolist()
    return above


def count_links(pairs: DataFrame, store: str, parts: int, tables: int, limit: float) -> DataFrame:
    """(node, links, other): links first met in a pair of blocks, and the node above in a forest of them (null for a root)."""

    def one(run: pa.Table) -> pa.RecordBatch | None:
        lo, hi, tab = (run.column(c)[0].as_py() for c in ("lo", "hi", "tab"))
        block, nodes, w = (run.column(c).to_numpy() for c in ("block", "node", "w"))
        left = np.flatnonzero(block == lo)
        right = left if lo == hi else np.flatnonzero(block == hi)
        if len(left) * len(right) < 1 + (lo == hi):
            return None
        vectors, signs = _read(store, parts, tables, nodes)
        norm = np.sqrt((vectors * vectors).sum(1))
        hit = vectors[left] @ vectors[right].T >= limit * np.outer(norm[left], norm[right]) * (1 - 1e-15)
        if lo == hi:
            np.fill_diagonal(hit, False)
        i, j = np.nonzero(hit)
        if not len(i):
            return None
        new = ~(signs[left[i], :tab] == signs[right[j], :tab]).any(1)
        i, j = i[new], j[new]
        links = np.bincount(left[i], weights=w[right[j]], minlength=len(nodes))
        if lo != hi:
            links += np.bincount(right[j], weights=w[left[i]], minlength=len(nodes))
        above = forest(len(nodes), left[i], right[j])
        own = np.flatnonzero(links > 0)
        other = pa.array(nodes[above[own]], pa.int64(), mask=above[own] < 0)
        return pa.record_batch([pa.array(nodes[own]), pa.array(links[own].astype(np.int64)), other], names=["node", "links", "other"])

    def run(batches):
        for table in runs(batches):
            if (out := one(table)) is not None and out.num_rows:
                yield out

    return sorted_groups(pairs, "bucket").mapInArrow(run, "node long, links long, other long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", limit: float = LIMIT) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``df``."""
    spark = df.sparkSession
    ship_package(spark)
    rows = materialize(name_vectors(df, id_col, vector_col, label_col), "vectors")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.count_distinct("id").alias("w"), F.min("id").alias("least"))
    nodes = materialize(nodes, "nodes")
    n = nodes.count()
    tables, bits = tables_and_bits(n, limit)
    store, parts = hashstore.new_store(spark, "vectors"), 1 + n // NODES_A_SHARD
    buckets = materialize(write_vectors(df, id_col, vector_col, label_col, store, parts, tables, bits), "buckets")
    found = materialize(count_links(block_pairs(buckets.join(nodes.select("node", "w"), "node"), "bucket", "node", BLOCK), store, parts, tables, limit), "met")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found, "node", "other")
    placed = nodes.join(links, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialize(placed, "placed")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = placed.join(least, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    out = rows.join(of_node, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )
