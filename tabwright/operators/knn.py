"""Exact k nearest neighbours as a partitioned join, for tables of any size.

Training points are dealt over the leaves of a space-partition tree. It is built by repeated counting: each round counts
the points and extents of all leaves, and every leaf with more than ``CELL_ROWS`` points is cut at quantiles along its
widest axis, until none is left but leaves whose points are all the same. Of those only the ``k`` least ids can matter.
A round is two aggregations with one row for each leaf; nothing else reaches the driver, and a point finds its
leaf by descent, so neither the number of leaves nor a dense region slows the others down.

Every query first looks at its own leaf, which bounds its k-th distance; it is then sent only to leaves closer than that
bound, found by descent as well. Leaves and groups of queries have bounded size, so a hot leaf is many tasks. Inside a task
a leaf is split further in memory. At most k candidates of each leaf and query are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.kinds import col
from ..functions.missing import as_double
from ..session import materialize, ship_package

#: Points of a leaf at most (unless they are all the same), and slices that a leaf is cut into in one round.
CELL_ROWS, SLICES = 20_000, 16
#: Queries of a group.
QUERY_ROWS = 4_000
#: Points that give a bound where a leaf has too few.
REFERENCE_ROWS = 1_000
#: Points that are compared with a query at once inside a task; larger leaves are split in memory.
DENSE = 1_000
BLOCK = 2_000_000  # distances held at once inside a task


@dataclass
class Node:
    """A leaf, or a cut along ``axis``: values below ``cuts[i]`` (and not below the one before) go to child i."""

    axis: int = -1
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    first: int = 0  # node of the first child; the others follow


@dataclass
class Tree:
    """Boxes of space, cut again and again; a leaf is known by its node."""

    nodes: list[Node] = field(default_factory=lambda: [Node()])

    def cut(self, node: int, axis: int, cuts: np.ndarray) -> range:
        self.nodes[node] = Node(axis, cuts, len(self.nodes))
        self.nodes += [Node() for _ in range(len(cuts) + 1)]
        return range(self.nodes[node].first, len(self.nodes))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            k, rows = todo.pop()
            node = self.nodes[k]
            if node.axis < 0:
                out[rows] = k
                continue
            side = np.searchsorted(node.cuts, x[rows, node.axis], "right")
            order = np.argsort(side, kind="stable")
            edges = np.searchsorted(side[order], np.arange(len(node.cuts) + 2))
            todo += [(node.first + i, rows[order[a:b]]) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
        return out

    def within(self, x: np.ndarray, bound: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, points whose squared bound reaches its box). Distances to a box add up axis by axis on the way down."""
        # Boxes get a hair of slack so that rounding cannot hide an equal distance.
        limit = bound * (1 + 1e-9)
        todo = [(0, np.arange(len(x)), np.zeros_like(x))]
        while todo:
            k, rows, gaps = todo.pop()
            node = self.nodes[k]
            if node.axis < 0:
                yield k, rows
                continue
            own = x[rows, node.axis]
            edges = np.r_[-np.inf, node.cuts, np.inf]
            for i, (low, high) in enumerate(zip(edges, edges[1:])):
                gap = np.maximum(gaps[:, node.axis], np.maximum(np.maximum(low - own, own - high), 0.0))
                moved = gaps.copy()
                moved[:, node.axis] = gap
                near = (moved * moved).sum(1) <= limit[rows]
                if near.any():
                    todo.append((node.first + i, rows[near], moved[near]))


def build_tree(points: DataFrame, dims: list[str], rows: int | None = None) -> tuple[Tree, list[int]]:
    """A tree whose leaves have ``rows`` points at most, and the leaves with more, whose points are all the same."""
    rows = rows or CELL_ROWS
    tree, same, open_leaves = Tree(), [], [0]
    while open_leaves:
        leaf = _leaf_column(tree, dims)
        extents = [f(d).alias(f"{n}{i}") for i, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))]
        wanted = set(open_leaves)
        found = points.select(*dims, leaf.alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *extents).where(F.col("n") > rows).collect()
        cutting = {}
        for r in (r for r in found if r["leaf"] in wanted):
            low, high = (np.array([r[f"{n}{i}"] for i in range(len(dims))]) for n in ("lo", "hi"))
            with np.errstate(over="ignore", invalid="ignore"):
                spread = np.nan_to_num(high - low, nan=0.0, posinf=np.finfo(float).max)
            axis = int(spread.argmax())
            if spread[axis] > 0:
                cutting[r["leaf"]] = (axis, low[axis])
            else:
                same.append(r["leaf"])
        open_leaves = []
        if not cutting:
            break
        at = [(i + 1) / SLICES for i in range(SLICES - 1)]
        above = points.select(leaf.alias("leaf"), _axis_column(tree, dims, cutting).alias("v")).where("v IS NOT NULL").groupBy("leaf")
        for r in above.agg(F.min("v").alias("least"), F.percentile_approx("v", at, 1_000).alias("q")).collect():
            open_leaves += tree.cut(r["leaf"], cutting[r["leaf"]][0], np.unique([r["least"], *r["q"]]))
    return tree, same


def _matrix(columns) -> np.ndarray:
    return np.column_stack([c.to_numpy(float) for c in columns])


def _leaf_column(tree: Tree, dims: list[str]):
    @F.pandas_udf("long")
    def leaf_of(*columns: pd.Series) -> pd.Series:
        return pd.Series(tree.leaves(_matrix(columns)))

    return leaf_of(*dims)


def _axis_column(tree: Tree, dims: list[str], cutting: dict[int, tuple[int, float]]):
    """The coordinate along the axis of the leaf that is being cut, where it is above the least."""

    @F.pandas_udf("double")
    def value_of(*columns: pd.Series) -> pd.Series:
        x = _matrix(columns)
        leaves = tree.leaves(x)
        known = np.array(sorted(cutting))
        at = np.minimum(np.searchsorted(known, leaves), len(known) - 1)
        axis, low = (np.array([cutting[k][i] for k in known.tolist()]) for i in (0, 1))
        v = x[np.arange(len(x)), axis.astype(int)[at]]
        return pd.Series(v).where((known[at] == leaves) & (v > low[at]), None)

    return value_of(*dims)


def _squared(test: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Squared distances summed axis by axis, in column order."""
    out = np.zeros((len(test), len(train)))
    for a in range(test.shape[1]):
        diff = test[:, a, None] - train[None, :, a]
        out += diff * diff
    return out


def _nearest(test: np.ndarray, train: np.ndarray, ids: np.ndarray, k: int):
    """Per test row the k smallest (distance, id): arrays (row, distance, train index)."""
    rows, dists, picks = [], [], []
    step = max(1, BLOCK // max(1, len(train)))
    for s in range(0, len(test), step):
        d2 = _squared(test[s : s + step], train)
        if d2.shape[1] > k:
            keep = d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1 : k]
        else:
            keep = np.ones_like(d2, dtype=bool)
        r, c = np.nonzero(keep)
        order = np.lexsort((ids[c], d2[r, c], r))
        r, c = r[order], c[order]
        first = np.searchsorted(r, np.arange(len(d2)))
        top = np.arange(len(r)) - first[r] < k
        rows.append(r[top] + s)
        dists.append(d2[r[top], c[top]])
        picks.append(c[top])
    return np.concatenate(rows), np.concatenate(dists), np.concatenate(picks)


def _local(test: np.ndarray, train: np.ndarray, ids: np.ndarray, k: int):
    """``_nearest`` of a whole leaf: points far from a query are left out by a tree in memory."""
    if len(train) <= max(DENSE, 4 * k) or not len(test):
        return _nearest(test, train, ids, k)
    tree = Tree()
    todo = [(0, np.arange(len(train)))]
    cells: dict[int, np.ndarray] = {}
    while todo:
        node, rows = todo.pop()
        x = train[rows]
        spread = x.max(0) - x.min(0)
        axis = int(spread.argmax())
        if len(rows) <= max(DENSE, 4 * k) or not spread[axis] > 0:
            cells[node] = rows
            continue
        middle = np.partition(x[:, axis], len(rows) // 2)[len(rows) // 2]
        middle = middle if middle > x[:, axis].min() else x[x[:, axis] > middle, axis].min()
        a, b = tree.cut(node, axis, np.array([middle]))
        todo += [(a, rows[x[:, axis] < middle]), (b, rows[x[:, axis] >= middle])]
    bound = np.full(len(test), np.inf)
    home = tree.leaves(test)
    for leaf in np.unique(home).tolist():
        q, near = np.flatnonzero(home == leaf), train[cells[leaf]]
        if len(near) >= k:
            step = max(1, BLOCK // len(near))
            for s in range(0, len(q), step):
                bound[q[s : s + step]] = np.partition(_squared(test[q[s : s + step]], near), k - 1, axis=1)[:, k - 1]
    found = []
    for leaf, q in tree.within(test, bound):
        r, d, c = _nearest(test[q], train[cells[leaf]], ids[cells[leaf]], k)
        found.append((q[r], d, cells[leaf][c]))
    rows, dists, picks = (np.concatenate(f) for f in zip(*found))
    order = np.lexsort((ids[picks], dists, rows))
    rows, dists, picks = rows[order], dists[order], picks[order]
    top = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[top], dists[top], picks[top]


def _salts(queries: DataFrame) -> DataFrame:
    """(leaf, salts): groups of queries of a leaf, so that none exceeds QUERY_ROWS."""
    counted = queries.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    return materialize(counted.select("leaf", F.ceil(F.col("n") / QUERY_ROWS).cast("int").alias("salts")), "knn-salts")


def _grouped(queries: DataFrame, points: DataFrame, salts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spread a leaf's queries over its salts and give every salt a copy of the leaf's points."""
    hashed = F.pmod(F.xxhash64("query_id"), F.col("salts")).cast("int")
    q = queries.join(salts, "leaf").withColumn("salt", hashed).drop("salts")
    p = points.join(salts, "leaf").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return q, p


def nearest(train: DataFrame, test: DataFrame, features: list[str], train_id: str, test_id: str, label: str, k: int = 5) -> DataFrame:
    """``(query_id, rank, train_id, distance2, label)`` of the k nearest training rows per test row.

    Ties go to the smaller training id. Ids must be unique; rows need all features present.
    """
    ship_package(train.sparkSession)
    dims = [f"x{i}" for i in range(len(features))]
    vec = [as_double(train, f).alias(d) for f, d in zip(features, dims)]
    points = materialize(train.select(col(train_id).cast("bigint").alias("train_id"), col(label).cast("double").alias("label"), *vec), "knn")
    queries = test.select(col(test_id).cast("bigint").alias("query_id"), *[as_double(test, f).alias(d) for f, d in zip(features, dims)])
    reference = np.array(points.select(*dims).limit(max(REFERENCE_ROWS, k)).collect(), float).reshape(-1, len(dims))
    if not len(reference):
        return points.sparkSession.createDataFrame([], "query_id bigint, rank int, train_id bigint, distance2 double, label double")
    tree, same = build_tree(points, dims)
    points = points.withColumn("leaf", _leaf_column(tree, dims))
    if same:  # of identical points only the k with the least ids can be among anyone's nearest
        crowded = points.where(F.col("leaf").isin(same))
        first = Window.partitionBy("leaf").orderBy("train_id")
        kept = crowded.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= k).drop("__r")
        points = points.where(~F.col("leaf").isin(same)).unionByName(kept)
    points = materialize(points, "knn-leaves")
    schema = "query_id bigint, " + ", ".join(f"{d} double" for d in dims)

    def home_bound(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        x = q[dims].to_numpy(float)
        near = p[dims].to_numpy(float) if len(p) >= k else reference
        bound = np.full(len(x), np.inf)
        if len(x) and len(near) >= k:
            r, d, _ = _local(x, near, np.arange(len(near)), k)
            bound[r] = d  # the last of each query is its k-th
        return q[["query_id", *dims]].assign(bound=bound)

    def local_nearest(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"query_id": [], "train_id": [], "distance2": [], "label": []})
        ids = p["train_id"].to_numpy()
        r, d2, c = _local(q[dims].to_numpy(float), p[dims].to_numpy(float), ids, k)
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[r], "train_id": ids[c], "distance2": d2, "label": p["label"].to_numpy()[c]})

    def reach(batches):
        for b in batches:
            for leaf, rows in tree.within(b[dims].to_numpy(float), b["bound"].to_numpy(float)):
                yield b.iloc[rows][["query_id", *dims]].assign(leaf=leaf)

    if tree.nodes[0].axis < 0:
        reached = queries.withColumn("leaf", F.lit(0).cast("bigint"))
    else:
        home = materialize(queries.withColumn("leaf", _leaf_column(tree, dims)), "knn-queries")
        q, p = _grouped(home, points, _salts(home))
        bounded = q.groupBy("leaf", "salt").cogroup(p.groupBy("leaf", "salt")).applyInPandas(home_bound, schema + ", bound double")
        reached = bounded.mapInPandas(reach, schema + ", leaf bigint")
    reached = materialize(reached, "knn-reached")
    q, p = _grouped(reached, points, _salts(reached))
    found = q.groupBy("leaf", "salt").cogroup(p.groupBy("leaf", "salt")).applyInPandas(
        local_nearest, "query_id bigint, train_id bigint, distance2 double, label double"
    )
    # At most k rows per reached leaf and query meet here.
    order = Window.partitionBy("query_id").orderBy("distance2", "train_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "train_id", "distance2", "label"
    )


def knn_predict(
    train: DataFrame, test: DataFrame, features: list[str], train_id: str, test_id: str, label: str, task: str, k: int = 5
) -> DataFrame:
    """``(query_id, prediction)``: mean label, or majority label with ties to the smallest."""
    near = nearest(train, test, features, train_id, test_id, label, k)
    if task == "regression":
        return near.groupBy("query_id").agg(F.avg("label").alias("prediction"))
    votes = near.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("query_id").agg(F.min(F.struct((-F.col("n")).alias("r"), "label")).alias("best"))
    return best.select("query_id", F.col("best.label").alias("prediction"))
