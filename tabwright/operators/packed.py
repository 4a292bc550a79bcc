"""Training rows as packed blocks, and small files of state that tasks leave in the shared folder.

Learners that pass over the same rows many times read blocks: one row of a Parquet table holds some ten thousand
training rows as arrays. A block keeps its number for good, so a task can find what an earlier pass has left for it,
on whatever executor it runs. Files appear by renaming and depend on their input only: a task that runs again
after a lost executor puts the same file in place.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..functions.kinds import col
from ..functions.missing import as_double
from ..session import materialize, shared_dir, ship_package

#: Rows in a block at most.
BLOCK = 1 << 15
#: Partial results that are added up in one task at most; beyond it they are added up in steps.
FAN_IN = 32


def pack(df: DataFrame, features: list[str], label: str, sets: str, encode: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(block, rows, x, y, sets): feature matrices (float64, or what ``encode`` makes of them), labels, and the training sets of each row as bits."""
    ship_package(df.sparkSession)
    width = len(features)

    def block(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        columns = [t.column(i).to_numpy() for i in range(width + 2)]
        x = np.column_stack(columns[:width]) if width else np.zeros((len(columns[0]), 0))
        x = np.ascontiguousarray(encode(x) if encode else x)
        arrays = [pa.array([number]), pa.array([len(x)]), *(pa.array([a.tobytes()], pa.binary()) for a in (x, columns[width], columns[width + 1].astype(np.uint32)))]
        return pa.record_batch(arrays, names=["block", "rows", "x", "y", "sets"])

    def run(batches):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if size + part.num_rows > BLOCK:
                    yield block(number, held)
                    number, held, size = number + 1, [], 0
                held.append(part)
                size += part.num_rows
        if size:
            yield block(number, held)

    # Dealt evenly, so that a table of one small file is not one task; the rows that a learner reads are few columns.
    spread = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(*[as_double(df, c).alias(c) for c in features], col(label).cast("double").alias(label), col(sets).cast("long").alias(sets)).repartition(spread)
    return materialize(rows.mapInArrow(run, "block long, rows long, x binary, y binary, sets binary"), "blocks")


def unpack(batch: pa.RecordBatch, width: int, dtype=np.float64):
    """(number, x, y, sets) of each block in a batch of packed rows."""
    for number, rows, x, y, sets in zip(*(batch.column(i).to_pylist() for i in range(5))):
        yield number, np.frombuffer(x, dtype).reshape(rows, width), np.frombuffer(y, np.float64), np.frombuffer(sets, np.uint32)


def with_prediction(df: DataFrame, features: tuple[str, ...], predict: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``df`` (without other columns of these names) with ``prediction``, made from matrices of the features."""
    ship_package(df.sparkSession)
    kept = [c for c in df.columns if c not in ("features", "prediction")]
    given = df.select(*[col(c) for c in kept], *[as_double(df, c).alias(f"__x{i}") for i, c in enumerate(features)])
    width = len(kept)

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(width + i).to_numpy(zero_copy_only=False) for i in range(len(features))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(predict(x), pa.float64())], names=[*kept, "prediction"])

    return given.mapInArrow(run, given.select(*[col(c) for c in kept]).schema.add("prediction", "double"))


def reduce_by_slot(partials: DataFrame, parts: int, merge: Callable[[list[bytes]], bytes], finish: Callable[[int, bytes], bytes]) -> dict[int, bytes]:
    """``finish`` of the merged partial results (slot, part, data) of each slot, by slot. Partial results are merged in order of their part, ``FAN_IN`` at most at a time."""

    def merged(table: pa.Table) -> list[bytes]:
        order = np.argsort(table.column("part").to_numpy(), kind="stable")
        data = table.column("data").to_pylist()
        return [data[i] for i in order]

    def some(table: pa.Table) -> pa.Table:
        slot, part = table.column("slot")[0].as_py(), table.column("part")[0].as_py() // FAN_IN
        return pa.table({"slot": [slot], "part": pa.array([part], pa.int64()), "data": pa.array([merge(merged(table))], pa.binary())})

    def last(table: pa.Table) -> pa.Table:
        slot = table.column("slot")[0].as_py()
        return pa.table({"slot": [slot], "data": pa.array([finish(slot, merge(merged(table)))], pa.binary())})

    while parts > FAN_IN:
        partials = partials.groupBy("slot", (partials.part / FAN_IN).cast("long").alias("group")).applyInArrow(some, "slot long, part long, data binary")
        parts = -(-parts // FAN_IN)
    return {r.slot: bytes(r.data) for r in partials.groupBy("slot").applyInArrow(last, "slot long, data binary").collect()}


def totals(data: DataFrame, width: int, of: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[int, np.ndarray]], parts: int | None = None) -> dict[int, np.ndarray]:
    """The sums by slot over all blocks of what ``of`` makes of (x, y, sets); a task sends one array for each slot."""
    parts = data.rdd.getNumPartitions() if parts is None else parts

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x, y, own in unpack(batch, width):
                for slot, part in of(x, y, own).items():
                    total[slot] = total[slot] + part if slot in total else part
        if total:
            at = TaskContext.get().partitionId()
            yield pa.record_batch([pa.array(list(total)), pa.array([at] * len(total)), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["slot", "part", "data"])

    partials = data.mapInArrow(run, "slot long, part long, data binary")
    if parts <= FAN_IN:  # what the last step would add up in one task: a shuffle less for each pass
        by_slot: dict[int, list[bytes]] = {}
        for r in sorted(partials.collect(), key=lambda r: (r.slot, r.part)):
            by_slot.setdefault(r.slot, []).append(bytes(r.data))
        found = {k: add_arrays(d) for k, d in by_slot.items()}
    else:
        found = reduce_by_slot(partials, parts, add_arrays, lambda slot, d: d)
    return {k: np.frombuffer(d, np.float64) for k, d in found.items()}


def add_arrays(data: list[bytes]) -> bytes:
    """The sum of float64 arrays of one shape."""
    total = np.frombuffer(data[0], np.float64).copy()
    for d in data[1:]:
        total += np.frombuffer(d, np.float64)
    return total.tobytes()


def new_folder(spark, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _local(path: str) -> str | None:
    u = urlparse(path)
    return u.path if u.scheme in ("", "file") else None


def write_file(folder: str, name: str, data: bytes) -> None:
    temporary = f"{name}.{uuid.uuid4().hex}.part"
    if (root := _local(folder)) is not None:
        os.makedirs(root, exist_ok=True)
        with open(f"{root}/{temporary}", "wb") as f:
            f.write(data)
        os.replace(f"{root}/{temporary}", f"{root}/{name}")
        return
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{temporary}") as f:
        f.write(data)
    fs.move(f"{root}/{temporary}", f"{root}/{name}")


def read_file(folder: str, name: str) -> bytes | None:
    """The content of a file, None where there is none."""
    if (root := _local(folder)) is not None:
        if not os.path.exists(f"{root}/{name}"):
            return None
        with open(f"{root}/{name}", "rb") as f:
            return f.read()
    fs, root = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_file(f"{root}/{name}") as f:
        return f.read()


def drop_file(folder: str, name: str) -> None:
    """Remove a file that no later pass reads; one that is gone already is no error."""
    if (root := _local(folder)) is not None:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(f"{root}/{name}")
        return
    fs, root = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound:
        fs.delete_file(f"{root}/{name}")
