"""Exact similarity join on word shingles with filters under several global token orders.

A set of s shingles that is similar enough to another shares, under any global order of all shingles,
at least one of its first ``s - ceil(t s) + 1`` shingles with it. Candidates have to share such a prefix
under every one of ``ORDERS`` orders before they are verified. All orders put rare shingles first (by their
number of documents), and differ in how equally rare ones are ranked. So a passage that stands in very many
documents is in nobody's prefix unless the document is little else.

1. Shingles of all documents are counted (see ``count_shingles``). Those of one document only come first in
   every order, so a text with a seventh of its shingles to itself has no prefix to share and is done.
2. Each document's set gets a 64-bit name; equal sets become one node (copies are never paired).
3. Prefixes under the first order are joined by shingle. Only shingles with two nodes or more go on.
4. The shared part of the sets of the nodes that are left is written as sorted arrays to the shared folder.
   Tasks that verify map them from there, so a pair is two ids and no set is shuffled.
5. Pairs. In a list of nodes with a common prefix shingle, first each node meets one node chosen by hash
   (``STARS`` rounds with other choices): this joins groups of many near copies with about one pair for a node.
   Then all pairs of a list that are not yet in one component are compared inside tasks, in blocks of bounded
   size (see ``blocks``), so no component is missed and no pairs are emitted but links.
6. Connected components of the links, distributed.

Defined cases: null or empty texts (or texts of spaces) have the empty set and link with nothing; a text
shorter than a shingle is one shingle of all its words; repeated rows and rows of one id with different
texts are documents of their own (with their sets as nodes), under the least id of their component; a null
id links with nothing and has a null component; an empty
table gives an empty result; input columns named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, ship_package
from . import hashstore
from .arrowmap import add_columns
from .blocks import block_pairs, runs, sorted_groups
from .components import components
from .ngram_lm import PACKED, combine
from .words import mix, ngrams, release, slices, words

SHINGLE, PERCENT, ORDERS, STARS = 4, 85, 3, 2
#: Shingles of a block.
BLOCK = 1 << 21
#: Sets in a shard, and nodes in a block of a list.
SETS_A_SHARD, BLOCK_NODES = 4096, 2048
COUNT_TYPES = (np.uint64, np.uint32)
#: Bit of a rank for shingles of two documents or more.
SHARED = np.uint64(1) << np.uint64(63)
SET_TYPES = (np.int64, np.int64, np.int64)
_SALT = [np.uint64(x) for x in (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D)]


def text_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, bounds = words(data, offsets)
    grams = ngrams(h, n)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(ngrams(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def prefix_length(size: int, percent: int) -> int:
    """Shingles of which a similar set shares at least one."""
    return size + (-percent * size // 100) + 1


COUNTED = pa.schema([("shard", pa.int64()), *((c, pa.binary()) for c in ("gaps", "wide", "at", "counts"))])


def pack_counts(held: list[np.ndarray], shards: int) -> pa.RecordBatch:
    """The distinct shingles of a block and how many of its sets hold them, packed for each shard. Empties ``held``, and sorts in place:
    all workers of an executor do this at once, beside its heap."""
    keys = np.concatenate(held)
    held.clear()
    keys >>= np.uint64(33 - (shards - 1).bit_length())  # as cut_hash
    keys.sort()
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    counts = np.full(len(first), len(keys), np.uint32)
    counts[:-1] = first[1:]
    counts -= first.astype(np.uint32)
    keys = keys[first]
    del first
    edges = np.searchsorted(keys, np.arange(shards + 1, dtype=np.uint64) << np.uint64(31)).tolist()
    rows = []
    for s, (a, b) in enumerate(zip(edges, edges[1:])):
        if a < b:
            gaps, m = np.diff(keys[a:b] & np.uint64(2**31 - 1), prepend=np.uint64(0)), counts[a:b]
            wide, at = gaps >= 65535, np.flatnonzero(m > 1)
            parts = (np.where(wide, 65535, gaps).astype(np.uint16), gaps[wide].astype(np.uint32), at.astype(np.uint32), m[at])
            rows.append(dict(zip(COUNTED.names, (s, *(p.tobytes() for p in parts)))))
    return pa.RecordBatch.from_pylist(rows, COUNTED)


def count_shingles(docs: DataFrame, text_col: str, n: int, store: str, shards: int) -> None:
    """Write the shingles of two documents or more, with their number of documents.

    For an order, a hash cut to 31 bits for each shard does: two shingles that fall together only look more
    frequent. What is shuffled are the sorted hashes of a block as gaps, two bytes for nearly each.
    """
    sql = "shard long, gaps binary, wide binary, at binary, counts binary"

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                sets = text_sets(data, offsets, n)
                held += sets
                size += sum(map(len, sets))
                del sets
                if size >= BLOCK:
                    yield pack_counts(held, shards)
                    size = 0
        if held:
            yield pack_counts(held, shards)
        release()

    def write(table: pa.Table) -> pa.Table:
        keys, counts = [], []
        for row in table.to_pylist():
            gaps = np.frombuffer(row["gaps"], np.uint16).astype(np.uint64)
            gaps[gaps == 65535] = np.frombuffer(row["wide"], np.uint32)
            c = np.ones(len(gaps), np.int64)
            c[np.frombuffer(row["at"], np.uint32)] = np.frombuffer(row["counts"], np.uint32)
            keys.append(np.cumsum(gaps).astype(np.uint32))
            counts.append(c)
        k, c = combine(np.concatenate(keys), np.concatenate(counts))
        shard, again = table.column("shard")[0].as_py(), c > 1
        hashstore.write_shard(store, "shared", shard, k[again].astype(np.uint64) + (np.uint64(shard) << np.uint64(31)), np.minimum(c[again], 2**32 - 1).astype(np.uint32))
        return pa.table({"shard": [shard], "n": [int(again.sum())]})

    docs.select(text_col).mapInArrow(count, sql).groupBy("shard").applyInArrow(write, "shard long, n long").agg(F.sum("n")).collect()


def cut_hash(h: np.ndarray, shards: int) -> np.ndarray:
    """The high bits of hashes: the shard (of a power of two), then 31 bits."""
    return h >> np.uint64(33 - (shards - 1).bit_length())


def ranks(sets: list[np.ndarray], store: str, shards: int, orders) -> list[list[np.ndarray]]:
    """For each order, the rank of each shingle of each set: by number of documents, then by a hash that differs by order.

    The highest bit tells the shingles that other documents have too.
    """
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    distinct, back = np.unique(cut_hash(every, shards), return_inverse=True)
    _, (count,) = hashstore.find(store, "shared", (distinct >> np.uint64(31)).astype(np.int64), distinct, COUNT_TYPES)
    count = count[back.reshape(-1)].astype(np.uint64)
    edges = np.cumsum([len(s) for s in sets])[:-1]
    out = []
    for k in orders:
        h = mix(every + _SALT[k])
        often = SHARED | (np.minimum(count, np.uint64(2**23 - 1)) << np.uint64(40)) | (h >> np.uint64(24))
        out.append(np.split(np.where(count > 0, often, h >> np.uint64(1)), edges))
    return out


def _prefix(shingles: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of the prefix that other documents have too; most texts have none."""
    k = prefix_length(len(shingles), percent)
    own = np.argpartition(rank, k - 1)[:k] if k < len(shingles) else np.arange(len(shingles))
    return shingles[own[rank[own] >= SHARED]]


def set_name(shingles: np.ndarray) -> int:
    """64 bits that name a set."""
    both = np.array([mix(shingles).sum(dtype=np.uint64), mix(shingles ^ _SALT[1]).sum(dtype=np.uint64)])
    return int(mix(both[:1] * np.uint64(0x9E3779B97F4A7C15) + both[1:]).astype(np.int64)[0])


def sketch_documents(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, store: str, shards: int) -> DataFrame:
    """(id, n_shingles, node, prefix): the size and name of the set and its prefix under the first order."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        sizes, names, prefixes = [], [], []
        for _, _, data, offsets in slices(batch.column(batch.schema.get_field_index(text_col))):
            sets = text_sets(data, offsets, n)
            for s, r in zip(sets, ranks(sets, store, shards, [0])[0]):
                sizes.append(len(s))
                names.append(set_name(s))
                prefixes.append(_prefix(s, r, percent).tobytes() if len(s) else b"")
        return [pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(prefixes, pa.binary())]

    return add_columns(docs, {"n_shingles": "long", "node": "long", "prefix": "binary"}, run, text_col, [id_col])


def explode_prefixes(nodes: DataFrame) -> DataFrame:
    """(token, node, size) from (node, size, prefix)."""

    def run(batches):
        for batch in batches:
            raw = batch.column(2).to_pylist()
            lengths = np.array([len(r) // 8 for r in raw], np.int64)
            tokens = np.frombuffer(b"".join(raw), np.int64)
            yield pa.record_batch(
                [pa.array(tokens), pa.array(np.repeat(batch.column(0).to_numpy(), lengths)), pa.array(np.repeat(batch.column(1).to_numpy(), lengths))], names=["token", "node", "size"]
            )

    return nodes.select("node", "size", "prefix").mapInArrow(run, "token long, node long, size long")


def node_shard(nodes: np.ndarray, shards: int) -> np.ndarray:
    return (mix(nodes.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def write_ids(ids: DataFrame, store: str, shards: int) -> None:
    """Write the ids of one column as sorted keys."""

    def pack(batches):
        for batch in batches:
            keys = np.sort(mix(batch.column(0).to_numpy().astype(np.uint64)))
            rows = [{"shard": s, "keys": k.tobytes(), "counts": b""} for s, (k,) in hashstore.split(hashstore.by_range(keys, shards), keys)]
            yield pa.RecordBatch.from_pylist(rows, PACKED)

    def write(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys = np.unique(np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64))
        hashstore.write_shard(store, "wanted", shard, keys)
        return pa.table({"shard": [shard], "n": [len(keys)]})

    ids.mapInArrow(pack, "shard long, keys binary, counts binary").groupBy("shard").applyInArrow(write, "shard long, n long").agg(F.sum("n")).collect()


def _body(shingles: np.ndarray, by_order: list[np.ndarray], percent: int) -> bytes:
    """Lengths of the prefixes, the prefixes, and the shingles that other documents have too (only these can be in common)."""
    prefixes = [np.sort(_prefix(shingles, r, percent)) for r in by_order]
    return np.concatenate([np.array([len(p) for p in prefixes], np.uint64), *prefixes, shingles[by_order[0] >= SHARED]]).tobytes()


def write_sets(docs: DataFrame, n: int, percent: int, store: str, shards: int, parts: int) -> None:
    """Write, for each wanted row of (id, text), its prefixes and the shared part of its set, by the name of the set."""
    packed = pa.schema([("shard", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("body", pa.binary())])

    def run(batches):
        for batch in batches:
            keys = mix(batch.column(0).to_numpy().astype(np.uint64))
            place, _ = hashstore.find(store, "wanted", hashstore.by_range(keys, shards), keys, COUNT_TYPES[:1])
            batch = batch.filter(pa.array(place >= 0))
            for _, _, data, offsets in slices(batch.column(1)):
                sets = text_sets(data, offsets, n)
                by_order = ranks(sets, store, shards, range(ORDERS))
                body = [_body(s, [r[i] for r in by_order], percent) for i, s in enumerate(sets)]
                nodes = np.array([set_name(s) for s in sets], np.int64)
                yield pa.record_batch([pa.array(node_shard(nodes, parts)), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array(body, pa.binary())], schema=packed)

    def write(table: pa.Table) -> pa.Table:
        nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)  # the same name is the same set
        size = table.column("size").to_numpy()[first]
        body = table.column("body").to_pylist()
        kept = [body[i] for i in first]
        ends = np.cumsum([len(b) // 8 for b in kept])
        shard = table.column("shard")[0].as_py()
        hashstore.write_shard(store, "sets", shard, nodes, size, ends, np.frombuffer(b"".join(kept), np.uint64))
        return pa.table({"shard": [shard], "n": [len(nodes)]})

    docs.mapInArrow(run, "shard long, node long, size long, body binary").groupBy("shard").applyInArrow(write, "shard long, n long").agg(F.sum("n")).collect()


def _load(store: str, parts: int, node: int, remembered: dict) -> list:
    """[size of the set, prefixes under all orders..., its shingles that others have] of a node."""
    if node not in remembered:
        if len(remembered) > 3 * BLOCK_NODES:
            remembered.clear()
        nodes, size, ends, blob = hashstore.read_shard(store, "sets", int(node_shard(np.array([node]), parts)[0]), SET_TYPES, np.uint64)
        k = int(np.searchsorted(nodes, node))
        if k == len(nodes) or nodes[k] != node:
            raise RuntimeError(f"no set was written for node {node}")
        body = np.asarray(blob[int(ends[k - 1]) if k else 0 : int(ends[k])])
        edges = np.cumsum([ORDERS, *body[:ORDERS].astype(np.int64).tolist()])
        remembered[node] = [int(size[k]), *np.split(body, edges)[1:]]
    return remembered[node]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def verify(pairs: DataFrame, store: str, parts: int, percent: int) -> DataFrame:
    """The rows of (x, y) whose sets are similar enough. Pairs have to share a prefix under every order first."""

    def run(batches):
        remembered: dict = {}
        for batch in batches:
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            hit = np.zeros(len(x), bool)
            for i, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
                n, *p, s = _load(store, parts, a, remembered)
                m, *q, t = _load(store, parts, b, remembered)
                if all(_common(u, v) for u, v in zip(p, q)):
                    both = _common(s, t)
                    hit[i] = 100 * both >= percent * (n + m - both)
            yield batch.filter(pa.array(hit))

    return pairs.select("x", "y").mapInArrow(run, "x long, y long")


def _fits(percent: int):
    return F.least("size", "size_y") * 100 >= F.greatest("size", "size_y") * percent


def _placed(lists: DataFrame, found: DataFrame) -> DataFrame:
    return lists.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def star_pairs(lists: DataFrame, choice: int | None, percent: int) -> DataFrame:
    """(x, y): each node of a list with one node of it, the least (names are hashes) or another, unless they are in one component already."""
    by = F.col("node") if choice is None else F.xxhash64("node", F.lit(choice))
    pick = F.min(F.struct(by.alias("h"), F.col("node").alias("y"), F.col("size").alias("size_y"), F.col("component").alias("of_y")))
    chosen = lists.groupBy("token").agg(pick.alias("p")).select("token", "p.y", "p.size_y", "p.of_y")
    return lists.join(chosen, "token").where((F.col("component") != F.col("of_y")) & _fits(percent)).select(F.col("node").alias("x"), "y").distinct()


def verify_rest(lists: DataFrame, store: str, parts: int, percent: int) -> DataFrame:
    """(x, y): links between different components of a list, at most one for each two components and group.

    All pairs are compared inside the tasks, block by block, and none is emitted but links. A pair is
    verified in the list of its first common prefix shingle only.
    """
    mixed = lists.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("token")
    groups = sorted_groups(block_pairs(lists.join(mixed, "token"), "token", "node", BLOCK_NODES), "token")

    def links(table: pa.Table, remembered: dict):
        token = np.int64(table.column("token")[0].as_py()).astype(np.uint64)
        lo, hi = (table.column(c)[0].as_py() for c in ("lo", "hi"))
        block, nodes, sizes, of = (table.column(c).to_numpy() for c in ("block", "node", "size", "component"))
        root = {c: c for c in of.tolist()}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        right = np.flatnonzero(block == hi)
        if not len(right):
            return
        prefixes = [_load(store, parts, int(nodes[j]), remembered)[1] for j in right.tolist()]
        shingles, owner = np.concatenate(prefixes), np.repeat(right, [len(p) for p in prefixes])
        for i in np.flatnonzero(block == lo).tolist():
            n, own, *p, s = _load(store, parts, int(nodes[i]), remembered)
            at = np.searchsorted(own, shingles)
            at[at == len(own)] = 0
            common = np.flatnonzero(own[at] == shingles)
            first = common[np.r_[True, owner[common][1:] != owner[common][:-1]]]  # of each node, as prefixes are sorted
            other = owner[first[shingles[first] == token]]
            other = other[(of[other] != of[i]) & (np.minimum(sizes[other], sizes[i]) * 100 >= np.maximum(sizes[other], sizes[i]) * percent)]
            for j in (other[other > i] if lo == hi else other).tolist():
                a, b = find(int(of[i])), find(int(of[j]))
                if a == b:
                    continue
                m, _, *q, t = _load(store, parts, int(nodes[j]), remembered)
                if all(_common(u, v) for u, v in zip(p, q)):
                    both = _common(s, t)
                    if 100 * both >= percent * (n + m - both):
                        root[a] = b
                        yield int(nodes[i]), int(nodes[j])

    def run(batches):
        remembered: dict = {}
        for table in runs(batches):
            found = list(links(table, remembered))
            if found:
                yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["x", "y"])

    return groups.mapInArrow(run, "x long, y long")


def join_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id) for each row of ``df``."""
    spark = df.sparkSession
    ship_package(spark)
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    store = hashstore.new_store(spark, "shingles")
    shards = max(1, docs.rdd.getNumPartitions())  # follows the bytes of the input
    shards = 1 << (shards - 1).bit_length()
    count_shingles(docs, "text", shingle, store, shards)
    rows = materialize(sketch_documents(docs, "id", "text", shingle, percent, store, shards), "sets")
    usable = rows.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    nodes = usable.groupBy("node").agg(F.min("id").alias("least"), F.first("n_shingles").alias("size"), F.first("prefix").alias("prefix"))
    nodes = materialize(nodes, "nodes")
    tokens = explode_prefixes(nodes)
    shared = tokens.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("token")
    lists = materialize(tokens.join(shared, "token"), "lists")
    wanted = materialize(lists.select("node").distinct().join(nodes.select("node", "least"), "node"), "wanted")
    write_ids(wanted.select("least"), store, shards)
    parts = 1 + wanted.count() // SETS_A_SHARD
    write_sets(docs.where(F.col("id").isNotNull()), shingle, percent, store, shards, parts)
    similar = lambda pairs: materialize(verify(pairs, store, parts, percent), "similar")
    links = similar(star_pairs(lists.withColumn("component", F.col("node")), None, percent))
    for step in range(1, STARS):
        # Labels that are surely of one component are enough to leave pairs out.
        near = links.select(F.col("x").alias("node"), "y").unionAll(links.select("y", "x")).groupBy("node").agg(F.least(F.min("y"), F.col("node")).alias("component"))
        links = links.unionAll(similar(star_pairs(_placed(lists, near), step, percent)))
    found = materialize(components(links, "x", "y"), "found")
    rest = materialize(verify_rest(_placed(lists, found), store, parts, percent), "similar")
    if rest.head(1):
        found = materialize(components(found.select(F.col("node").alias("x"), F.col("component").alias("y")).unionAll(rest), "x", "y"), "found")
    placed = nodes.select("node", "least").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = materialize(placed.join(least, "component").select("node", "component_id"), "components")
    out = rows.where(F.col("n_shingles") > 0).select("id", "n_shingles", "node").join(of_node, "node", "left")
    out = out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    empty = rows.where(F.col("n_shingles") == 0).select("id", "n_shingles", F.col("id").alias("component_id"))
    return out.unionAll(empty).withColumnRenamed("id", id_col)
