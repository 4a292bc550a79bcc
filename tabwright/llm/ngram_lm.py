"""An interpolated modified Kneser-Ney language model, counted by Spark and memory-mapped for scoring.

The model is of order two: p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) p(w), and p(w) is built the
same way from continuation counts (the distinct words before w) over a uniform base with one unknown word.
With three words nearly every n-gram of this kind of text is seen once, and the counts alone would need
several times the input on disk.

Counting. Tasks hash words with numpy, count blocks of some million tokens on the spot and pass on packed
sorted arrays, one row for each shard, so a frequent word or pair costs one entry for each block however
often it occurs. Words are sharded by hash range; the place of a word in the sorted whole is its id, which
makes a pair one exact 64-bit integer. Pairs are sharded by their first word, and a first word with more
than ``SPLIT`` tokens is spread over as many more shards. A third step gathers, for each word id, how many
continuations it has once, twice and more often and how many words it follows.

Scoring. Every worker maps the sorted arrays from the shared folder (see ``hashstore``) and finds the
distinct words and pairs of some megabytes of text by binary search; nothing is broadcast or shuffled.

Defined cases: a null text counts as empty (its end is still a token); a null id is learned from; without
any text to learn from every token has probability 1; repeated rows count as often as they are there; an
empty table gives an empty result. Where counts of counts are too few for a discount, 0.5, 1 and 1.5 stand
in. Up to 2^32 - 3 distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ship_package
from . import hashstore
from .arrowmap import add_columns
from .words import mix, slices, words

#: Tokens a task counts before it passes its counts on.
BLOCK = 1 << 21
#: Tokens that go to one shard of pairs, and tokens of a first word beyond which it is spread.
SHARD_TOKENS, SPLIT = 1 << 22, 1 << 18
END = np.uint64(0x9AE16A3B2F90404F)
WORD_TYPES = (np.uint64, np.uint64)
PAIR_TYPES = (np.uint64, np.float32)
ID_TYPES = (np.float32,) * 4
PACKED = pa.schema([("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


@dataclass(frozen=True)
class Model:
    store: str
    word_shards: int
    first_id: tuple[int, ...]  # of each word shard
    pair_shards: int
    n_words: int  # distinct tokens, the end included
    tokens: int
    texts: int
    pair_discount: tuple[float, float, float]
    word_discount: tuple[float, float, float]
    word_total: float  # distinct pairs
    word_left: float  # probability left for the uniform base

    @property
    def ids(self) -> int:
        """Word ids and one for the begin of a text."""
        return self.n_words + 1


def combine(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    k = keys[order]
    edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[edge], np.add.reduceat(counts[order], edge)


def learned(id_col: str, folds: int = 10) -> Column:
    """Rows that the model learns from: all but one residue of a hash of the id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) != 0, F.lit(True))


def _blocks(batches, column: int = 0) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Lists of (word hashes, bounds) with about BLOCK tokens each."""
    held, size = [], 0
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(column)):
            h, bounds = words(data, offsets)
            held.append((h, bounds))
            size += len(h) + len(bounds)
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _packed(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((keys, shard))
    rows = [{"shard": s, "keys": k.tobytes(), "counts": c.tobytes()} for s, (k, c) in hashstore.split(shard[order], keys[order], counts[order])]
    return pa.RecordBatch.from_pylist(rows, PACKED)


def _unpacked(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _count_words(texts: DataFrame, store: str, shards: int) -> DataFrame:
    def count(batches):
        for block in _blocks(batches):
            ends = sum(len(b) - 1 for _, b in block)
            keys, n = np.unique(np.concatenate([h for h, _ in block]), return_counts=True)
            keys, n = combine(np.append(keys, END), np.append(n, ends).astype(np.uint64))
            yield _packed(hashstore.by_range(keys, shards), keys, n)

    def write(table: pa.Table) -> pa.Table:
        keys, n = combine(_unpacked(table, "keys", np.uint64), _unpacked(table, "counts", np.uint64))
        shard = table.column("shard")[0].as_py()
        hashstore.write_shard(store, "words", shard, keys, n)
        ends = n[keys == END].sum()
        return pa.table({"shard": [shard], "n": [len(keys)], "tokens": [int(n.sum())], "texts": [int(ends)]})

    packed = texts.mapInArrow(count, "shard long, keys binary, counts binary")
    return packed.groupBy("shard").applyInArrow(write, "shard long, n long, tokens long, texts long")


def word_ids(model: Model, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct ids with -1 for unknown words, their counts, for each word the place among the distinct)."""
    distinct, back = np.unique(h, return_inverse=True)
    shard = hashstore.by_range(distinct, model.word_shards)
    place, (n,) = hashstore.find(model.store, "words", shard, distinct, WORD_TYPES)
    return np.where(place >= 0, place + np.array(model.first_id, np.int64)[shard], -1), n, back


@dataclass
class Tokens:
    """The tokens of some texts, ends included, with what stands before each."""

    ids: np.ndarray
    counts: np.ndarray
    before: np.ndarray
    before_counts: np.ndarray
    starts: np.ndarray  # of each text


def tokens(model: Model, h: np.ndarray, bounds: np.ndarray) -> Tokens:
    texts = len(bounds) - 1
    distinct, n, back = word_ids(model, np.append(h, END))
    back = back.reshape(-1)
    per_text = np.repeat(np.arange(texts), np.diff(bounds))
    at = np.arange(len(h)) + per_text
    place = np.empty(len(h) + texts, np.int64)
    place[at] = back[:-1]
    place[bounds[1:] + np.arange(texts)] = back[-1]
    ids, counts = distinct[place], n[place]
    starts = bounds[:-1] + np.arange(texts)
    before, before_counts = np.empty_like(ids), np.empty_like(counts)
    before[1:], before_counts[1:] = ids[:-1], counts[:-1]
    before[starts], before_counts[starts] = model.n_words, model.texts
    return Tokens(ids, counts, before, before_counts, starts)


def pair_shard(model: Model, before: np.ndarray, before_counts: np.ndarray, after: np.ndarray) -> np.ndarray:
    spread = np.uint64(1) + before_counts // np.uint64(SPLIT)
    s = np.uint64(model.pair_shards)
    return ((mix(before.astype(np.uint64)) % s + mix(after.astype(np.uint64) + np.uint64(7)) % spread) % s).astype(np.int64)


def _pair_keys(model: Model, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return before.astype(np.uint64) * np.uint64(model.ids) + after.astype(np.uint64)


def _count_pairs(texts: DataFrame, model: Model) -> DataFrame:
    """(shard, keys, counts) of word pairs."""

    def count(batches):
        for block in _blocks(batches):
            keys, spread = [], []
            for h, bounds in block:
                t = tokens(model, h, bounds)
                keys.append(_pair_keys(model, t.before, t.ids))
                spread.append(t.before_counts)
            every = np.concatenate(keys)
            distinct, first, n = np.unique(every, return_index=True, return_counts=True)
            before, after = distinct // np.uint64(model.ids), distinct % np.uint64(model.ids)
            yield _packed(pair_shard(model, before, np.concatenate(spread)[first], after), distinct, n.astype(np.uint32))

    return texts.mapInArrow(count, "shard long, keys binary, counts binary")


STATS = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("ids", pa.binary()), ("n", pa.binary())])


def _write_pairs(packed: DataFrame, model: Model) -> DataFrame:
    """Write the pair shards; (part, kind, ids, n): kinds 0 to 2 are the pairs seen once, twice and more often of a first word, 3 the
    distinct pairs of a second word; part -1 holds the counts of counts."""

    def write(table: pa.Table) -> pa.Table:
        keys, n = combine(_unpacked(table, "keys", np.uint64), _unpacked(table, "counts", np.uint32).astype(np.uint64))
        hashstore.write_shard(model.store, "pairs", table.column("shard")[0].as_py(), keys, n.astype(np.float32))
        before, after = keys // np.uint64(model.ids), keys % np.uint64(model.ids)
        rows = [{"part": -1, "kind": 0, "ids": b"", "n": np.array([(n == k).sum() for k in (1, 2, 3, 4)], np.float64).tobytes()}]
        for kind, ids in ((0, before[n == 1]), (1, before[n == 2]), (2, before[n > 2]), (3, after)):
            distinct, m = np.unique(ids, return_counts=True)
            for part, (i, c) in hashstore.split(id_part(model, distinct), distinct, m.astype(np.uint32)):
                rows.append({"part": part, "kind": kind, "ids": i.astype(np.uint32).tobytes(), "n": c.tobytes()})
        return pa.Table.from_pylist(rows, STATS)

    return packed.groupBy("shard").applyInArrow(write, "part long, kind int, ids binary, n binary")


def id_part(model: Model, ids: np.ndarray) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(model.word_shards) // np.uint64(model.ids)).astype(np.int64)


def _part_start(model: Model, part: int) -> int:
    return -(-part * model.ids // model.word_shards)


def _write_ids(stats: DataFrame, model: Model) -> DataFrame:
    """Write the four numbers of every word id; (part, total, c1..c4): distinct pairs and counts of continuation counts."""

    def write(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part < 0:
            c = np.frombuffer(b"".join(table.column("n").to_pylist()), np.float64).reshape(-1, 4).sum(0)
            total = 0.0
        else:
            start, stop = _part_start(model, part), _part_start(model, part + 1)
            out = np.zeros((4, stop - start))
            for kind, ids, n in zip(table.column("kind").to_pylist(), table.column("ids").to_pylist(), table.column("n").to_pylist()):
                out[kind][np.frombuffer(ids, np.uint32).astype(np.int64) - start] += np.frombuffer(n, np.uint32)
            hashstore.write_shard(model.store, "ids", part, *out.astype(np.float32))
            total, c = out[3].sum(), [(out[3] == k).sum() for k in (1, 2, 3, 4)]
        return pa.table({"part": pa.array([part], pa.int64()), "total": [float(total)], **{f"c{k + 1}": [float(c[k])] for k in range(4)}})

    return stats.groupBy("part").applyInArrow(write, "part long, total double, c1 double, c2 double, c3 double, c4 double")


def discounts(c: list[float]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts one to four."""
    y = c[0] / (c[0] + 2 * c[1]) if c[0] and c[1] else 0.0
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * c[k] / c[k - 1] if y and c[k - 1] else 0.0
        out.append(d if 0 < d < k else k / 2)
    return tuple(out)


def fit(texts: DataFrame, text_col: str = "text") -> Model:
    """Learn from every row of ``texts``; three jobs, of which two read the texts."""
    spark = texts.sparkSession
    ship_package(spark)
    texts = texts.select(text_col)
    store = hashstore.new_store(spark, "lm")
    shards = max(1, texts.rdd.getNumPartitions())  # follows the bytes of the input
    sizes = {r["shard"]: r for r in _count_words(texts, store, shards).collect()}  # one row for each shard
    n = [sizes[s]["n"] if s in sizes else 0 for s in range(shards)]
    total = sum(r["tokens"] for r in sizes.values())
    first = tuple(int(x) for x in np.cumsum([0, *n[:-1]]))
    model = Model(store, shards, first, 1 + total // SHARD_TOKENS, sum(n), total, sum(r["texts"] for r in sizes.values()), (0,) * 3, (0,) * 3, 0.0, 1.0)
    if model.ids >= 1 << 32:
        raise OverflowError("more than 2^32 - 3 distinct words")
    if not total:
        return model
    rows = {r["part"]: r for r in _write_ids(_write_pairs(_count_pairs(texts, model), model), model).collect()}
    of_pairs = [rows[-1][f"c{k}"] for k in (1, 2, 3, 4)]
    of_words = [sum(r[f"c{k}"] for p, r in rows.items() if p >= 0) for k in (1, 2, 3, 4)]
    pairs = sum(r["total"] for r in rows.values())
    d = discounts(of_words)
    left = (d[0] * of_words[0] + d[1] * of_words[1] + d[2] * (model.n_words - of_words[0] - of_words[1])) / pairs
    return Model(**{**model.__dict__, "pair_discount": discounts(of_pairs), "word_discount": d, "word_total": pairs, "word_left": left})


def _of_ids(model: Model, ids: np.ndarray) -> list[np.ndarray]:
    """The four numbers of word ids; 0 for unknown words."""
    out = [np.zeros(len(ids)) for _ in range(4)]
    part = np.where(ids < 0, -1, id_part(model, np.maximum(ids, 0)))
    order = np.argsort(part, kind="stable")
    for p, (own,) in hashstore.split(part[order], order):
        if p >= 0:
            for o, stored in zip(out, hashstore.read_shard(model.store, "ids", p, ID_TYPES)):
                if len(stored):
                    o[own] = stored[ids[own] - _part_start(model, p)]
    return out


def _discounted(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(n - np.where(n == 1, d[0], np.where(n == 2, d[1], d[2])), 0)


def log_probabilities(model: Model, t: Tokens) -> np.ndarray:
    """log10 p(token | token before)."""
    if not model.tokens:
        return np.zeros(len(t.ids))
    known, back = np.unique(np.r_[t.ids, t.before], return_inverse=True)
    numbers = _of_ids(model, known)
    at, at_before = back.reshape(-1)[: len(t.ids)], back.reshape(-1)[len(t.ids) :]
    follows = numbers[3][at]
    p = np.where(follows > 0, _discounted(follows, model.word_discount), 0) / model.word_total + model.word_left / (model.n_words + 1)
    context = np.flatnonzero(t.before_counts > 0)
    both = context[t.ids[context] >= 0]
    keys, first, of = np.unique(_pair_keys(model, t.before[both], t.ids[both]), return_index=True, return_inverse=True)
    shard = pair_shard(model, t.before[both][first], t.before_counts[both][first], t.ids[both][first])
    _, (n,) = hashstore.find(model.store, "pairs", shard, keys, PAIR_TYPES)
    seen = np.zeros(len(p))
    n = n.astype(np.float64)
    seen[both] = np.where(n > 0, _discounted(n, model.pair_discount), 0)[of.reshape(-1)]
    once, twice, more = (x[at_before[context]] for x in numbers[:3])
    d = model.pair_discount
    left = d[0] * once + d[1] * twice + d[2] * more
    p[context] = (seen[context] + left * p[context]) / t.before_counts[context].astype(np.float64)
    return np.log10(p)


def score(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with n_tokens, n_known, base_score (smoothed single words) and score (this model), both log10 of the whole text."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for _, _, data, offsets in slices(batch.column(batch.schema.get_field_index(text_col))):
            h, bounds = words(data, offsets)
            t = tokens(model, h, bounds)
            base = np.log10((t.counts.astype(np.float64) + 0.1) / (model.tokens + 0.1 * (model.n_words + 1)))
            add = lambda x: np.add.reduceat(x, t.starts)  # noqa: E731, B023  every text has a token, its end
            out.append((np.diff(bounds) + 1, add((t.counts > 0).astype(np.int64)), add(base), add(log_probabilities(model, t))))
        if not out:
            return [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.float64())]
        return [pa.array(np.concatenate(c)) for c in zip(*out)]

    return add_columns(df, {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double"}, run, text_col, keep)
