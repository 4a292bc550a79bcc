"""Extremely randomised trees: each node cuts at the best of a few features, each at one random place.

All trees of all training sets (the folds of a cross-validation and the final model) grow level by level in the same two
passes over packed blocks (see ``packed``). The first finds the extent of every feature in every open node; with it, one
threshold for each candidate feature is drawn evenly between the extremes. The second adds up, for each candidate, the
classes (or the count, sum and squares of numbers) of the rows on its left; the best decrease of impurity wins. Trees
are dealt over groups; a group's sums meet in one task, which also draws and decides, so the driver gets the chosen cuts
only. Nothing is drawn from the rows: every row of a training set is in every tree.

Draws are a hash of (seed, tree, node, feature), so a pass that runs again draws the same, and equal settings give
equal trees. Candidates are the first features in a random order that are not constant in the node: the root of their
number for classes, all of them for numbers. Where that root is one, the draw is the cut, and what lies on both sides is
added up by the first pass of the next level. A node is a leaf at ``depth``, when it is pure, or when all its features
are constant. Equal decreases go to the candidate that was drawn first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .packed import new_folder, pack, read_file, reduce_by_slot, unpack, with_prediction, write_file

#: Trees whose sums meet in one task.
TREES_AT_ONCE = 20
SETS = "__sets"
PARTIAL = pa.schema([("slot", pa.int64()), ("part", pa.int64()), ("data", pa.binary())])


@dataclass(frozen=True)
class Settings:
    trees: int = 100
    depth: int = 10
    seed: int = 42

    def train(self, df: DataFrame, features: list[str], sets: list[str], classes: int) -> list[Forest]:
        return train(df, features, sets, classes, self)

    def sized(self, facts) -> Settings:
        return Settings(facts.trees, facts.depth, self.seed)


class Tree:
    """Nodes as arrays that grow together; ``feature`` is -1 at a leaf, ``sums`` are those of its rows. Values up to the cut go left."""

    def __init__(self, sums: np.ndarray):
        self.feature, self.cut, self.left = np.array([-1]), np.zeros(1), np.zeros(1, np.int64)
        self.sums = sums[None, :]
        self.gain = np.zeros(1)
        self.depth = 0

    def split(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """Cut some nodes at once; the new nodes, left and right in turn."""
        n = len(self.feature)
        self.depth += 1  # nodes of one level are cut at once
        self.feature[nodes], self.cut[nodes], self.gain[nodes] = feature, cut, gain
        self.left[nodes] = n + 2 * np.arange(len(nodes))
        children = np.stack([left, self.sums[nodes] - left], 1).reshape(-1, self.sums.shape[1])
        self.feature, self.cut = np.r_[self.feature, np.full(len(children), -1)], np.r_[self.cut, np.zeros(len(children))]
        self.left, self.gain = np.r_[self.left, np.zeros(len(children), np.int64)], np.r_[self.gain, np.zeros(len(children))]
        self.sums = np.concatenate([self.sums, children])
        return np.arange(n, n + len(children))

    def without_sums(self) -> Tree:
        """What is needed to find leaves."""
        out = Tree(np.zeros(0))
        out.feature, out.cut, out.left, out.depth = self.feature, self.cut, self.left, self.depth
        return out

    def fill(self, nodes: np.ndarray, sums: np.ndarray, classes: int) -> None:
        """The sums of nodes whose parents were cut before anything was added up, and the gains of the parents; left and right in turn."""
        self.sums[nodes] = sums
        cut = np.flatnonzero(np.isin(self.left, nodes[::2]) & (self.feature >= 0))
        below = impurity(self.sums[self.left[cut]], classes) + impurity(self.sums[self.left[cut] + 1], classes)
        self.gain[cut] = np.maximum(impurity(self.sums[cut], classes) - below, 0)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row; ``x`` holds the features as rows, contiguous. All rows go down together, those in a leaf stay there."""
        n, inner = x.shape[1], self.feature >= 0
        node, column, values = np.zeros(n, np.intp), np.arange(n), x.reshape(-1)
        if not n or not inner.any():
            return node
        begin, cut = np.where(inner, self.feature, 0) * n, np.where(inner, self.cut, np.inf)
        left = np.where(inner, self.left, np.arange(len(inner)))
        for _ in range(self.depth):
            right = values.take(begin.take(node) + column) > cut.take(node)
            node = left.take(node)
            node += right
        return node


@dataclass
class Forest:
    features: tuple[str, ...]
    classes: int  # 0: regression
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The class with the largest mean share over the trees, or the mean of their means."""
        total, by_feature = 0, np.ascontiguousarray(x.T)
        for t in self.trees:
            s = t.sums[t.leaf_of(by_feature)]
            total = total + (s / s.sum(1, keepdims=True) if self.classes else s[:, 1] / s[:, 0])
        return total.argmax(1).astype(np.float64) if self.classes else total / len(self.trees)

    def importances(self) -> np.ndarray:
        """Mean share of each feature in the decrease of impurity of a tree."""
        out = np.zeros(len(self.features))
        for t in self.trees:
            own = np.bincount(t.feature[t.feature >= 0], t.gain[t.feature >= 0], len(out))
            out += own / own.sum() if own.sum() else 0
        return out / out.sum() if out.sum() else out

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` (without other columns of these names) with ``prediction``."""
        return with_prediction(df, self.features, self.predict)


def draw(*keys) -> np.ndarray:
    """A number in [0, 1) for each combination of integer keys (arrays broadcast)."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in keys:
            h = (h ^ np.asarray(k).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(32))
    return (h >> np.uint64(11)).astype(np.float64) / 2.0**53


def candidates(seed: int, tree: int, nodes: np.ndarray, low: np.ndarray, high: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature or -1, threshold) of the candidates of each node, in the order in which they were drawn."""
    f = np.arange(low.shape[1])[None, :]
    varies = low < high
    order = np.argsort(np.where(varies, draw(seed, tree, nodes[:, None], f, 1), 2.0), axis=1, kind="stable")[:, :most]
    u = draw(seed, tree, nodes[:, None], f, 2)
    cut = low + u * (high - low)
    cut = np.where(cut >= high, low, cut)
    row = np.arange(len(nodes))[:, None]
    return np.where(varies[row, order], order, -1), cut[row, order]


def impurity(sums: np.ndarray, classes: int) -> np.ndarray:
    """Rows times Gini impurity, or the sum of squares around the mean."""
    if classes:
        n = sums.sum(-1)
        return n - (sums**2).sum(-1) / np.maximum(n, 1)
    return sums[..., 2] - sums[..., 1] ** 2 / np.maximum(sums[..., 0], 1)


def weights(y: np.ndarray, classes: int) -> np.ndarray:
    """What is added up for each row: its class, or one, the number and its square."""
    return (y[:, None] == np.arange(classes)).astype(np.float64) if classes else np.column_stack([np.ones_like(y), y, y * y])


def train(df: DataFrame, features: list[str], sets: list[str], classes: int, s: Settings, label: str = "label") -> list[Forest]:
    """A forest for each training set, given as SQL conditions on ``df`` (32 at most); all grow side by side.

    ``classes``: 0 for regression, else labels are 0 to classes - 1. Feature values must be present.
    """
    names, width = tuple(features), len(features)
    width_sums = classes or 3
    most = max(1, int(math.sqrt(width))) if classes else width
    data = pack(df.withColumn(SETS, F.expr(" + ".join(f"IF({c}, {1 << i}L, 0L)" for i, c in enumerate(sets)))), features, label, SETS)
    parts = data.rdd.getNumPartitions()
    alone = bool(classes) and most == 1  # the only candidate of a node is its cut
    folder = new_folder(df.sparkSession, "extra-trees")
    total = len(sets) * s.trees
    grown: list[Tree | None] = [None] * total
    opened = [np.array([0])] * total
    groups = [range(at, min(at + TREES_AT_ONCE, total)) for at in range(0, total, TREES_AT_ONCE)]

    def places(tree: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a training set that lie in open nodes of a tree, and which of them."""
        if grown[tree] is None:
            return np.arange(x.shape[1]), np.zeros(x.shape[1], np.intp)
        place = np.full(len(grown[tree].feature), -1)
        place[opened[tree]] = np.arange(len(opened[tree]))
        place = place.take(grown[tree].leaf_of(x))
        rows = np.flatnonzero(place >= 0)
        return rows, place if len(rows) == len(place) else place[rows]

    def over_blocks(shape, start, add):
        """A task's partial results: for each group the arrays of its trees, one behind the other."""

        def run(batches):
            held: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                for _, x, y, own in unpack(batch, width):
                    w, of_set = weights(y, classes).T, {}
                    for slot, trees in enumerate(groups):
                        if not any(len(opened[t]) for t in trees):
                            continue
                        if slot not in held:
                            held[slot] = [np.full((len(opened[t]), *shape), start) for t in trees]
                        for t, out in zip(trees, held[slot]):
                            if not len(opened[t]):
                                continue
                            if (m := t // s.trees) not in of_set:
                                rows = np.flatnonzero(own >> np.uint32(m) & np.uint32(1))
                                of_set[m] = np.ascontiguousarray(x[rows].T), np.ascontiguousarray(w[:, rows])
                            add(slot, t, out, *of_set[m], *places(t, of_set[m][0]))
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([{"slot": k, "part": part, "data": np.concatenate(v).tobytes()} for k, v in held.items()], PARTIAL)

        return data.mapInArrow(run, "slot long, part long, data binary")

    def sums_at(place: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(place, one, n) for one in w], 1)

    def extents(slot, tree, out, x, w, rows, place):
        """Sums of the rows, then the largest negative and the largest value of each feature."""
        if not len(rows):
            return
        every = len(rows) == x.shape[1]
        met = np.flatnonzero(np.bincount(place, minlength=len(out)))
        out[met, :width_sums] = np.where(np.isneginf(out[met, :width_sums]), 0, out[met, :width_sums]) + sums_at(place, w if every else w[:, rows], len(out))[met]
        both = np.full((2 * width, len(out)), -np.inf)
        for f in range(width):
            values = x[f] if every else x[f].take(rows)
            np.maximum.at(both[f], place, -values)
            np.maximum.at(both[width + f], place, values)
        out[:, width_sums:] = np.maximum(out[:, width_sums:], both.T)

    def merge_extents(data: list[bytes]) -> bytes:
        a = np.stack([np.frombuffer(d, np.float64).reshape(-1, width_sums + 2 * width) for d in data])
        sums = np.where(np.isneginf(a[..., :width_sums]), 0, a[..., :width_sums]).sum(0)
        return np.concatenate([sums, a[..., width_sums:].max(0)], 1).tobytes()

    def split_trees(slot: int, rows: np.ndarray):
        at = 0
        for t in groups[slot]:
            yield t, rows[at : at + len(opened[t])]
            at += len(opened[t])

    def choose(level: int, slot: int, data: bytes) -> bytes:
        """Draw the candidates of each open node and leave them for the second pass; the sums of the nodes."""
        rows = np.frombuffer(data, np.float64).reshape(-1, width_sums + 2 * width)
        drawn = []
        for t, own in split_trees(slot, rows):
            f, cut = candidates(s.seed, t % s.trees, opened[t], -own[:, width_sums : width_sums + width], own[:, width_sums + width :], most)
            pure = impurity(own[:, :width_sums], classes) <= 1e-12
            drawn.append(np.stack([np.where(pure[:, None], -1, f), cut], 2))
        if alone:
            return np.concatenate([rows[:, :width_sums], np.concatenate(drawn)[:, 0]], 1).tobytes()
        write_file(folder, f"c-{level}-{slot}", np.concatenate(drawn).tobytes())
        return np.ascontiguousarray(rows[:, :width_sums]).tobytes()

    def grow_alone(level: int) -> None:
        """The sums of all open nodes, with them the gains of the cuts above; then the next cuts, but for the last level."""
        found = reduce_by_slot(over_blocks((width_sums + 2 * width,), -np.inf, extents), parts, merge_extents, lambda slot, d: choose(level, slot, d))
        for slot, d in found.items():
            for t, own in list(split_trees(slot, np.frombuffer(d, np.float64).reshape(-1, width_sums + 2))):
                if not len(own):
                    continue
                sums = own[:, :width_sums]
                if level == 0:
                    grown[t] = Tree(sums[0])
                else:
                    grown[t].fill(opened[t], sums, classes)
                cut = own[:, width_sums] >= 0 if level < s.depth else np.zeros(len(own), bool)
                own = own[cut]
                nothing = np.zeros(len(own))
                opened[t] = grown[t].split(opened[t][cut], own[:, -2].astype(np.int64), own[:, -1], own[:, :width_sums], nothing) if len(own) else np.zeros(0, np.int64)

    def grow(level: int) -> None:
        found = reduce_by_slot(over_blocks((width_sums + 2 * width,), -np.inf, extents), parts, merge_extents, lambda slot, d: choose(level, slot, d))
        if level == 0:
            for slot, d in found.items():
                for t, own in split_trees(slot, np.frombuffer(d, np.float64).reshape(-1, width_sums)):
                    grown[t] = Tree(own[0])
        drawn: dict[int, np.ndarray] = {}

        def of_slot(slot: int) -> np.ndarray:
            if slot not in drawn:
                drawn[slot] = np.frombuffer(read_file(folder, f"c-{level}-{slot}"), np.float64).reshape(-1, most, 2)
            return drawn[slot]

        begin = {t: sum(len(opened[o]) for o in trees if o < t) for trees in groups for t in trees}

        def lefts(slot, tree, out, x, w, rows, place):
            own, values = of_slot(slot)[begin[tree] : begin[tree] + len(out)], x.reshape(-1)
            for j in range(most):
                f = own[:, j, 0].astype(np.intp)
                left = values.take((np.maximum(f, 0) * x.shape[1]).take(place) + rows) <= own[:, j, 1].take(place)
                left &= (f >= 0).take(place)
                out[:, j] += sums_at(place[left], w[:, rows[left]], len(out))

        def merge_lefts(data: list[bytes]) -> bytes:
            return sum(np.frombuffer(d, np.float64) for d in data).tobytes()

        def decide(slot: int, data: bytes) -> bytes:
            left = np.frombuffer(data, np.float64).reshape(-1, most, width_sums)
            out = []
            for (t, own), (_, c) in zip(split_trees(slot, left), split_trees(slot, of_slot(slot))):
                whole = grown[t].sums[opened[t]][:, None, :]
                gain = np.where(c[..., 0] >= 0, impurity(whole, classes) - impurity(own, classes) - impurity(whole - own, classes), -np.inf)
                # Rounding must not decide between cuts of the same rows.
                j = (gain >= gain.max(1, keepdims=True) - 1e-9 * impurity(whole, classes)).argmax(1)
                r = np.arange(len(j))
                out.append(np.column_stack([c[r, j, 0], c[r, j, 1], np.maximum(gain[r, j], 0), own[r, j]]))
            return np.concatenate(out).tobytes()

        found = reduce_by_slot(over_blocks((most, width_sums), 0.0, lefts), parts, merge_lefts, decide)
        for slot in range(len(groups)):
            rows = np.frombuffer(found.get(slot, b""), np.float64).reshape(-1, 3 + width_sums)
            for t, own in list(split_trees(slot, rows)):
                cut = own[:, 0] >= 0 if len(own) else np.zeros(0, bool)
                own = own[cut] if len(own) else own
                opened[t] = grown[t].split(opened[t][cut], own[:, 0].astype(np.int64), own[:, 1], own[:, 3:], own[:, 2]) if len(own) else np.zeros(0, np.int64)

    for level in range(s.depth + (alone and s.depth > 0)):
        if not any(len(o) for o in opened):
            break
        (grow_alone if alone else grow)(level)
    return [Forest(names, classes, [t for t in grown[m * s.trees : (m + 1) * s.trees] if t is not None]) for m in range(len(sets))]
