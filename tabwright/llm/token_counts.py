"""Token counts of whole texts without materialising ids.

1. The distinct pre-tokens of all texts are gathered (each task first drops its own repeats).
2. The pieces of every distinct pre-token are counted once.
3. The counts become a table of sorted hashes in the shared folder (see ``hashstore``). Its size follows
   the vocabulary of the corpus, so it is not broadcast.
4. Each text is joined to it through its own pre-token frequencies: the distinct pre-tokens of some
   megabytes of text are looked up together and the counts are summed for each text.

No row of (text, pre-token) is shuffled. Pre-tokens are told apart by 64 bits of hash.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); special strings inside a text count as one
token; repeated rows stay; an empty table stays empty; input columns named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship_package
from . import hashstore
from .arrowmap import add_columns, row_ranges
from .bpe import load
from .words import hash_texts

#: Distinct pre-tokens a task holds before it passes them on; bounds memory, not results.
HELD = 300_000
TYPES = (np.uint64, np.uint32)


def distinct_pretokens(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(piece) of all texts, each once."""
    ship_package(df.sparkSession)

    def run(batches):
        held: set[str] = set()
        for batch in batches:
            column = batch.column(0)
            for first, stop in row_ranges(column):
                tokenizer = load(path)
                held.update(*(tokenizer.pretokens(t) for t in column.slice(first, stop - first).to_pylist() if t))
                if len(held) >= HELD:
                    yield pa.record_batch([pa.array(sorted(held), pa.string())], names=["piece"])
                    held = set()
        yield pa.record_batch([pa.array(sorted(held), pa.string())], names=["piece"])

    return df.select(text_col).mapInArrow(run, "piece string").distinct()


def count_pieces(pieces: DataFrame, path: str, shards: int) -> DataFrame:
    """(shard, keys, counts): packed hashes and token counts of distinct pre-tokens."""

    def run(batches):
        for batch in batches:
            tokenizer = load(path)
            texts = batch.column(0).to_pylist()
            n = np.array([len(i) // 4 for i in tokenizer.ids_of(texts)], np.uint32)
            h = hash_texts(batch.column(0))
            order = np.argsort(h)
            rows = [(s, k.tobytes(), c.tobytes()) for s, (k, c) in hashstore.split(hashstore.by_range(h[order], shards), h[order], n[order])]
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "keys", "counts"), r)) for r in rows], SHARDS)

    return pieces.mapInArrow(run, "shard long, keys binary, counts binary")


SHARDS = pa.schema([("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def write_counts(packed: DataFrame, store: str) -> DataFrame:
    """Write each shard as sorted arrays; (shard, n)."""

    def run(table: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64)
        n = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32)
        order = np.argsort(h)
        shard = table.column("shard")[0].as_py()
        hashstore.write_shard(store, "pieces", shard, h[order], n[order])
        return pa.table({"shard": [shard], "n": [len(h)]})

    return packed.groupBy("shard").applyInArrow(run, "shard long, n long")


def count_tokens(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``n_tokens`` (long) of each whole text."""
    spark = df.sparkSession
    store = hashstore.new_store(spark, "pieces")
    shards = max(1, df.rdd.getNumPartitions())  # follows the bytes of the input
    write_counts(count_pieces(distinct_pretokens(df, path, text_col), path, shards), store).agg(F.sum("n")).collect()

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        tokenizer = load(path)
        pieces = [tokenizer.pretokens(t) if t else [] for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
        distinct = list(set().union(*pieces))
        h = hash_texts(pa.array(distinct, pa.string()))
        place, (n,) = hashstore.find(store, "pieces", hashstore.by_range(h, shards), h, TYPES)
        if (place < 0).any():
            raise RuntimeError("a pre-token has no count: the texts changed between two passes")
        get = dict(zip(distinct, n.tolist())).__getitem__
        return [pa.array([sum(map(get, p)) for p in pieces], pa.int64())]

    return add_columns(df, {"n_tokens": "long"}, run, text_col, keep)
