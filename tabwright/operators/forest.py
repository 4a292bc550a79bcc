"""Random forests for classes and numbers: bootstrapped trees that cut binned features, grown level by level for many training sets at once.

1. Features are cut into 32 bins at most: between all values where there are few, else at quantiles of all rows.
2. Rows with the same bins, label and training sets become one row with their number. Every row is in it, so nothing is
   lost; with few features and classes the table shrinks to what the bins can tell apart, and else stays as it is. The rows are
   dealt by hash into parts, each a file in the shared folder (see ``packed``).
3. A pass for each level: a task takes one part and some trees, and adds up the classes of its rows (or their number and
   their labels) for each open node, candidate feature and bin. A tree's sums of all parts meet in one task, which finds the best cut of each node; where one part
   holds all rows, its task does. The driver gets the chosen cuts.

Labels that are numbers are all different as a rule, so rows of the same bins stay apart: each has its own draws. A task draws them
once for a tree of all training sets and adds up rows of the same bins before they go down the trees, where that makes them fewer.

Bootstrap: a row is in a tree as often as a Poisson draw of mean 1 says, so n equal rows are together in it as often as one of
mean n says. Draws are a hash of (seed, tree, row), not of its place: a pass that runs again, or another
number of tasks, draws the same. Candidates of a node are a random choice of features, the root of their number rounded up, a third
of it for numbers. Cuts have to lower the Gini impurity or the variance; equal decreases go to the candidate that was drawn first, then to the lowest
bin. A node is a leaf at ``depth`` or when it is pure; sibling leaves of the same class become one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.kinds import col
from ..functions.missing import as_double
from ..session import materialize, ship_package
from .extra_trees import PARTIAL, SETS, Forest, Tree, draw, impurity as impurity_of
from .packed import add_arrays, new_folder, read_file, reduce_by_slot, write_file

BINS = 32
#: Merged rows in a part, and numbers in the sums of trees that meet in one task (a single tree may have more).
PART_ROWS, SUMS = 1 << 17, 1 << 18
#: Rows in a part where labels are numbers: the more, the more of them have the same bins.
NUMBER_ROWS = 1 << 20
#: Rows that go down a tree at once.
SLICE = 1 << 15
#: Means up to this are drawn from tables.
SMALL = 10


@dataclass(frozen=True)
class Settings:
    trees: int = 100
    depth: int = 10
    seed: int = 42

    def train(self, df: DataFrame, features: list[str], sets: list[str], classes: int) -> list[Forest]:
        return train(df, features, sets, classes, self)

    def sized(self, facts) -> Settings:
        return Settings(facts.trees, facts.depth, self.seed)


def bin_cuts(df: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Ascending cut values of each feature, never its largest value; values up to a cut are below it."""
    at = [(i + 1) / BINS for i in range(BINS - 1)]
    parts = [(F.percentile_approx(col(c), at, 10_000), F.max(col(c)), F.approx_count_distinct(col(c))) for c in features]
    row = df.select(*[x.alias(f"{k}{i}") for i, p in enumerate(parts) for k, x in zip("qmd", p)]).first()
    out = []
    for i, c in enumerate(features):
        values = row[f"q{i}"] or []
        if row[f"d{i}"] <= 2 * BINS:
            few = [r[0] for r in df.select(col(c)).distinct().limit(BINS + 1).collect()]
            values = few if len(few) <= BINS else values
        out.append(np.array(sorted({v for v in values if v < row[f"m{i}"]}), np.float64))
    return out


_TABLES = np.stack([np.cumsum([math.exp(-m + k * math.log(m) - math.lgamma(k + 1)) for k in range(64)]) for m in range(1, SMALL + 1)])
_LOG_FACTORIAL = np.cumsum(np.log(np.maximum(np.arange(1024), 1)))


def log_factorial(k: np.ndarray) -> np.ndarray:
    big = np.maximum(k, 1024.0)
    return np.where(k < 1024, _LOG_FACTORIAL[np.minimum(k, 1023).astype(np.int64)], big * np.log(big) - big + 0.5 * np.log(2 * np.pi * big) + 1 / (12 * big) - 1 / (360 * big**3))


def poisson(mean: np.ndarray, *keys) -> np.ndarray:
    """A Poisson draw for each mean (positive integers) and its keys: by tables, or by transformed rejection (Hoermann 1993)."""
    out, u = np.zeros(len(mean)), draw(*keys, 0)
    if len(mean) and (mean == 1).all():
        return np.searchsorted(_TABLES[0], u, "right").astype(np.float64)
    for m in range(1, SMALL + 1):
        rows = np.flatnonzero(mean == m)
        out[rows] = np.searchsorted(_TABLES[m - 1], u[rows], "right")
    left, step = np.flatnonzero(mean > SMALL), 0
    keys = [np.broadcast_to(k, len(mean)) for k in keys]
    while len(left):
        lam, own = mean[left].astype(np.float64), [k[left] for k in keys]
        b = 0.931 + 2.53 * np.sqrt(lam)
        a = -0.059 + 0.02483 * b
        x, v = draw(*own, 1, step) - 0.5, np.maximum(draw(*own, 2, step), 1e-300)
        near = np.maximum(0.5 - np.abs(x), 1e-300)
        k = np.floor((2 * a / near + b) * x + lam + 0.43)
        good = (near >= 0.07) & (v <= 0.9277 - 3.6224 / (b - 2))
        maybe = (k >= 0) & ((near >= 0.013) | (v <= near)) & ~good
        below = np.log(v) + np.log(1.1239 + 1.1328 / (b - 3.4)) - np.log(a / near**2 + b)
        good |= maybe & (below <= -lam + k * np.log(lam) - log_factorial(np.maximum(k, 0)))
        out[left[good]] = k[good]
        left, step = left[~good], step + 1
    return out


def impurity(sums: np.ndarray, classes: int) -> np.ndarray:
    """Rows times Gini impurity; for (rows, sum of labels) the squares around the mean but for the sum of all squares, which no cut changes."""
    return impurity_of(sums, classes) if classes else -(sums[..., 1] ** 2) / np.maximum(sums[..., 0], 1)


def label_scale(df: DataFrame, label: str) -> tuple[float, float]:
    """Centre and deviation of a number (1 where it has none): trees see it scaled, so that nothing is lost to rounding."""
    row = df.select(F.avg(as_double(df, label)).alias("a"), F.stddev_pop(as_double(df, label)).alias("s")).first()
    spread = row["s"] if row["s"] and math.isfinite(row["s"]) else 1.0
    return (row["a"] if row["a"] is not None and math.isfinite(row["a"]) else 0.0), spread


def merged_rows(df: DataFrame, features: list[str], label: str, sets: list[str], cuts: list[np.ndarray], scale: tuple[float, float] | None = None) -> DataFrame:
    """(x, y, sets, n): bins as bytes, class (or number, scaled), training sets as bits, and the number of such rows."""
    ship_package(df.sparkSession)
    width = len(features)

    def run(batches):
        for batch in batches:
            x = np.stack([np.searchsorted(c, batch.column(i).to_numpy()) for i, c in enumerate(cuts)], 1).astype(np.uint8)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
            yield pa.record_batch([packed, batch.column(width), batch.column(width + 1)], names=["x", "y", "sets"])

    bits = F.expr(" + ".join(f"IF({c}, {1 << i}L, 0L)" for i, c in enumerate(sets)))
    y = (as_double(df, label) - F.lit(scale[0])) / F.lit(scale[1]) if scale else col(label).cast("long")
    rows = df.select(*[as_double(df, c).alias(c) for c in features], y.alias(label), bits.alias(SETS))
    binned = rows.mapInArrow(run, f"x binary, y {'double' if scale else 'long'}, sets long").where("sets <> 0")
    return materialize(binned.groupBy("x", "y", "sets").agg(F.count(F.lit(1)).alias("n")), "merged")


def write_parts(rows: DataFrame, folder: str, most: int | None = None) -> int:
    """Write the merged rows in parts of bounded size; the number of parts. Labels that are numbers are kept by their bits."""
    parts = max(1, -(-rows.count() // (most or PART_ROWS)))

    def write(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        arrays = [a.view(np.int64) if a.dtype == np.float64 else a.astype(np.int64) for a in (table.column(c).to_numpy() for c in ("key", "y", "sets", "n"))]
        arrays, x = np.stack(arrays), table.column("x").to_pylist()
        if most and len(x[0]):  # rows of the same bins stand together
            order = np.argsort(np.frombuffer(b"".join(x), np.dtype((np.void, len(x[0])))), kind="stable")
            arrays, x = arrays[:, order], [x[i] for i in order.tolist()]
        write_file(folder, f"part-{part}", arrays.tobytes() + b"".join(x))
        return pa.table({"part": [part]})

    key = F.xxhash64("x", "y", "sets")
    dealt = rows.select("x", "y", "sets", "n", key.alias("key"), F.pmod(F.xxhash64(key), F.lit(parts)).alias("part"))
    dealt.groupBy("part").applyInArrow(write, "part long").collect()
    return parts


def read_part(folder: str, part: int, width: int) -> tuple[np.ndarray, ...]:
    """(x with features as rows, key, y, sets, n) of a part; one that got no rows has no file."""
    data = read_file(folder, f"part-{part}") or b""
    n = len(data) // (32 + width)
    key, y, own, count = np.frombuffer(data, np.int64, 4 * n).reshape(4, n)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=32 * n).reshape(n, width).T), key, y, own, count


@dataclass
class _Points:
    """The rows of a part whose labels are numbers, in order of their bins, and the different bins among them if those are much fewer."""

    x: np.ndarray
    key: np.ndarray
    y: np.ndarray
    own: np.ndarray
    count: np.ndarray
    cell: np.ndarray | None = None
    drawn: tuple[int, np.ndarray, np.ndarray] | None = None

    @classmethod
    def of(cls, x: np.ndarray, key: np.ndarray, y: np.ndarray, own: np.ndarray, count: np.ndarray) -> _Points:
        y, kinds = y.view(np.float64), np.unique(own)
        if len(key):
            new = np.r_[True, (x[:, 1:] != x[:, :-1]).any(0)]
            if 2 * new.sum() * len(kinds) <= len(key):
                return cls(np.ascontiguousarray(x[:, new]), key, y, kinds, count, (np.cumsum(new) - 1) * len(kinds) + np.searchsorted(kinds, own))
        return cls(x, key, y, own, count)

    def sums(self, s: Settings, tree: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x, how often, sum of labels) of what the m-th training set has drawn for a tree; the draws of all sets are the same."""
        if self.drawn is None or self.drawn[0] != tree:
            w = poisson(self.count, s.seed, tree, self.key)
            drawn = [w, w * self.y]
            if self.cell is not None:
                drawn = [np.bincount(self.cell, d, self.x.shape[1] * len(self.own)).reshape(-1, len(self.own)) for d in drawn]
            self.drawn = (tree, *drawn)
        mine = (self.own >> m & 1).astype(np.float64)
        _, w, wy = self.drawn
        w, wy = (w @ mine, wy @ mine) if self.cell is not None else (w * mine, wy)
        rows = np.flatnonzero(w)
        return self.x[:, rows], w[rows], wy[rows]


def candidates(seed: int, tree: int, nodes: np.ndarray, width: int, most: int) -> np.ndarray:
    """The features that each node may cut, in the order in which they were drawn."""
    return np.argsort(draw(seed, tree, nodes[:, None], np.arange(width)[None, :], 1), axis=1, kind="stable")[:, :most]


def best_cuts(hist: np.ndarray, features: np.ndarray, classes: int) -> np.ndarray:
    """(gain, feature, bin, sums on the left, sums of the node) of each node, from (node, candidate, bin, class); no cut has gain 0."""
    left = hist.cumsum(2)
    whole = left[:, :1, -1:]
    gain = impurity(whole, classes) - impurity(left, classes) - impurity(whole - left, classes)
    if not classes:  # a side without rows is no cut, whatever rounding leaves of the sums
        gain = np.where((left[..., 0] > 0) & (left[..., 0] < whole[..., 0]), gain, 0.0)
    size = whole[:, 0, 0].sum(1) if classes else whole[:, 0, 0, 0]
    gain = gain.reshape(len(hist), -1)
    # Rounding must not decide between cuts of the same rows.
    at = (gain >= gain.max(1, keepdims=True) - 1e-9 * size[:, None]).argmax(1)
    rows, (which, cut) = np.arange(len(hist)), np.divmod(at, hist.shape[2])
    gain = np.where(gain[rows, at] > 1e-9 * size, gain[rows, at], 0.0)
    return np.column_stack([gain, features[rows, which], cut, left[rows, which, cut], whole[:, 0, 0]])


def pruned(t: Tree) -> Tree:
    """Sibling leaves of the same class become one: their parent."""
    kind = t.sums.argmax(1)
    for n in np.flatnonzero(t.feature >= 0)[::-1].tolist():  # children stand behind their parents
        a = int(t.left[n])
        if t.feature[a] < 0 and t.feature[a + 1] < 0 and kind[a] == kind[a + 1]:
            t.feature[n] = -1
    return t


def train(df: DataFrame, features: list[str], sets: list[str], classes: int, s: Settings, label: str = "label") -> list[Forest]:
    """A forest for each training set, given as SQL conditions on ``df`` (32 at most); all grow side by side.

    ``classes``: 0 for regression, else labels are 0 to classes - 1. Feature values must be present.
    """
    spark, names, width = df.sparkSession, tuple(features), len(features)
    most = width if s.trees == 1 else math.ceil(math.sqrt(width)) if classes else math.ceil(width / 3)
    width_sums = classes or 2
    cuts = bin_cuts(df, features)
    bins = max(len(c) for c in cuts) + 1
    folder = new_folder(spark, "forest")
    scale = None if classes else label_scale(df, label)
    parts = write_parts(merged_rows(df, features, label, sets, cuts, scale), folder, None if classes else NUMBER_ROWS)
    total = len(sets) * s.trees
    # Trees with the same draws stand side by side where they are drawn once.
    order = range(total) if classes else sorted(range(total), key=lambda t: (t % s.trees, t))
    grown: list[Tree | None] = [None] * total
    opened = [np.array([0])] * total

    def level() -> dict[int, np.ndarray]:
        """The best cuts of all open nodes, by tree."""
        slots: list[list[int]] = []
        size = SUMS
        for t in (t for t in order if len(opened[t])):
            if size + (more := len(opened[t]) * most * bins * width_sums) > SUMS:
                slots.append([])
                size = 0
            slots[-1].append(t)
            size += more
        teams = min(len(slots), -(-3 * spark.sparkContext.defaultParallelism // parts))
        # Tasks get what they need to find a row's node, nothing of the sums.
        shape = {t: g.without_sums() for t, g in enumerate(grown) if g is not None and len(opened[t])}

        def add(t: int, x, key, y, count) -> np.ndarray:
            w = poisson(count, s.seed, t % s.trees, key)
            rows = np.flatnonzero(w)
            if t in shape:
                place = np.full(len(shape[t].feature), -1)
                place[opened[t]] = np.arange(len(opened[t]))
                place = place.take(shape[t].leaf_of(x))
                rows = rows[place[rows] >= 0]
                place = place[rows]
            else:
                place = np.zeros(len(rows), np.intp)
            of, w, kind, n = candidates(s.seed, t % s.trees, opened[t], width, most), w[rows], y[rows], len(opened[t])
            out = np.empty((n, most, bins, classes))
            for j in range(most):
                b = x[of[:, j].take(place), rows].astype(np.int64)
                out[:, j] = np.bincount((place * bins + b) * classes + kind, w, n * bins * classes).reshape(n, bins, classes)
            return out

        def add_numbers(t: int, x, w, wy) -> np.ndarray:
            of, n = candidates(s.seed, t % s.trees, opened[t], width, most), len(opened[t])
            out = np.zeros((2, most, n * bins))
            if t in shape:
                open_at = np.full(len(shape[t].feature), -1)
                open_at[opened[t]] = np.arange(n)
            for at in range(0, len(w), SLICE):
                part, own, sums = np.ascontiguousarray(x[:, at : at + SLICE]), w[at : at + SLICE], wy[at : at + SLICE]
                place, rows = np.zeros(len(own), np.intp), np.arange(len(own))
                if t in shape:
                    place = open_at.take(shape[t].leaf_of(part))
                    if len(rows := np.flatnonzero(place >= 0)) < len(place):
                        place, own, sums = place.take(rows), own.take(rows), sums.take(rows)
                values = part.reshape(-1)
                for j in range(most):
                    b = place * bins + values.take((of[:, j] * part.shape[1]).take(place) + rows)
                    out[0, j] += np.bincount(b, own, n * bins)
                    out[1, j] += np.bincount(b, sums, n * bins)
            return np.ascontiguousarray(out.reshape(2, most, n, bins).transpose(2, 1, 3, 0))

        def decide(slot: int, data: bytes) -> bytes:
            every, at, out = np.frombuffer(data, np.float64).reshape(-1, most, bins, width_sums), 0, []
            for t in slots[slot]:
                n = len(opened[t])
                out.append(best_cuts(every[at : at + n], candidates(s.seed, t % s.trees, opened[t], width, most), classes))
                at += n
            return np.concatenate(out).tobytes()

        def run(batches):
            for task in (i for batch in batches for i in batch.column(0).to_pylist()):
                part, team = task % parts, task // parts
                x, key, y, own, count = read_part(folder, part, width)
                of_set: dict[int, tuple] = {}
                points = None if classes else _Points.of(x, key, y, own, count)
                for slot in range(team, len(slots), teams):
                    sums = []
                    for t in slots[slot]:
                        if points:
                            sums.append(add_numbers(t, *points.sums(s, t % s.trees, t // s.trees)).tobytes())
                            continue
                        if (m := t // s.trees) not in of_set:
                            rows = np.flatnonzero(own >> m & 1)
                            of_set = {m: (np.ascontiguousarray(x[:, rows]), key[rows], y[rows], count[rows])}  # trees come set by set
                        sums.append(add(t, *of_set[m]).tobytes())
                    data = b"".join(sums)
                    yield pa.RecordBatch.from_pylist([{"slot": slot, "part": part, "data": decide(slot, data) if parts == 1 else data}], PARTIAL)

        tasks = spark.range(0, parts * teams, 1, parts * teams).mapInArrow(run, "slot long, part long, data binary")
        found = {r.slot: bytes(r.data) for r in tasks.collect()} if parts == 1 else reduce_by_slot(tasks, parts, add_arrays, decide)
        out = {}
        for slot, trees in enumerate(slots):
            rows = np.frombuffer(found[slot], np.float64).reshape(-1, 3 + 2 * width_sums)
            out |= zip(trees, np.split(rows, np.cumsum([len(opened[t]) for t in trees])[:-1]))
        return out

    for depth in range(max(s.depth, 1)):
        if not any(len(o) for o in opened):
            break
        for t, own in level().items():
            if grown[t] is None:
                grown[t] = Tree(own[0, 3 + width_sums :])
            good = (own[:, 0] > 0) & (s.depth > 0)
            own, nodes = own[good], opened[t][good]
            new = grown[t].split(nodes, own[:, 1].astype(np.int64), own[:, 2], own[:, 3 : 3 + width_sums], own[:, 0]) if len(own) else np.zeros(0, np.int64)
            opened[t] = new[impurity(grown[t].sums[new], classes) > 1e-9] if classes else new[grown[t].sums[new, 0] > 1]
    for t in grown:
        inner = np.flatnonzero(t.feature >= 0)
        t.cut[inner] = [cuts[f][int(b)] for f, b in zip(t.feature[inner], t.cut[inner])]
        if not classes:
            t.sums = np.column_stack([t.sums[:, 0], t.sums[:, 1] * scale[1] + t.sums[:, 0] * scale[0]])
    out = [Forest(names, classes, [pruned(t) if classes else t for t in grown[m * s.trees : (m + 1) * s.trees] if t.sums[0].any()]) for m in range(len(sets))]
    if not all(f.trees for f in out):
        raise ValueError("a training set without rows")
    return out
