"""Small helpers for the operators whose tasks run numpy on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from ..session import ship_package
from .words import SLICE, release, slices


def row_ranges(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of a text or binary column with about ``limit`` bytes each (one row at least)."""
    for first, stop, _, _ in slices(column.cast(pa.large_binary()).cast(pa.large_string(), safe=False) if pa.types.is_binary(column.type) else column, limit):
        yield first, stop


def add_columns(df: DataFrame, added: dict[str, str], fn: Callable[[pa.RecordBatch], list[pa.Array]], weigh: str, keep: list[str] | None = None, limit: int = SLICE, done: Callable[[], None] | None = None) -> DataFrame:
    """``df`` with the columns that ``fn`` makes of each batch; they replace input columns of the same name.

    ``weigh`` names the column whose bytes bound a batch, ``keep`` the input columns to pass on (all if
    None). A batch holds about ``limit`` bytes of that column, however many rows the session puts into one.
    ``done`` is called when a task ends: its worker lives on beside the heap that later stages need.
    """
    ship_package(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in added and (keep is None or f.name in keep)]
    given = df.columns
    schema = T.StructType(kept + [T.StructField(n, T._parse_datatype_string(t)) for n, t in added.items()])
    names = [f.name for f in kept]
    wanted = pa.schema([pa.field(n, {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[t]) for n, t in added.items()])

    def run(batches):
        try:
            for batch in batches:
                for first, stop in row_ranges(batch.column(given.index(weigh)), limit):
                    part = batch.slice(first, stop - first)
                    made = [a.cast(f.type) for a, f in zip(fn(part), wanted)]
                    old = [part.column(given.index(n)) for n in names]
                    yield pa.RecordBatch.from_arrays(old + made, names=names + wanted.names)
        finally:
            if done:
                done()
            release()

    return df.mapInArrow(run, schema)
