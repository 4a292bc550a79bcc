"""Feather (Arrow IPC) files as a Spark data source: one input partition per record batch, committed writes."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..session import ship_package

FORMAT = "feather"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark itself would use for it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def exists(path: str) -> bool:
    from pyarrow import fs

    system, base = _filesystem(path)
    return system.get_file_info(base).type != fs.FileType.NotFound


def _files(path: str) -> list[str]:
    """The path itself, or the data files under it."""
    from pyarrow import fs

    system, base = _filesystem(path)
    info = system.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(base)] if path.endswith(base) else ""
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    shown = lambda p: not any(part.startswith(("_", ".")) for part in p[len(base) :].split("/"))
    names = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith((".feather", ".arrow")) and shown(f.path))
    return [prefix + n for n in names]


def _open(path: str):
    import pyarrow as pa

    system, base = _filesystem(path)
    return pa.ipc.open_file(system.open_input_file(base))


def _plain(field):
    """The field as Spark knows it: decoded dictionaries, plain strings, microseconds."""
    import pyarrow as pa

    kind = field.type.value_type if pa.types.is_dictionary(field.type) else field.type
    if pa.types.is_large_string(kind):
        kind = pa.string()
    return pa.field(field.name, pa.timestamp("us", kind.tz) if pa.types.is_timestamp(kind) else kind)


class BatchPartition(InputPartition):
    def __init__(self, path: str, batch: int):
        self.path = path
        self.batch = batch


class FeatherReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path = path
        self.columns = columns

    def partitions(self):
        files = _files(self.path)
        # Footers only: the data stays where it is.
        with ThreadPoolExecutor(16) as pool:
            batches = list(pool.map(lambda f: _open(f).num_record_batches, files))
        return [BatchPartition(f, i) for f, n in zip(files, batches) for i in range(n)]

    def read(self, partition):
        import pyarrow as pa

        if partition is None or not hasattr(partition, "path"):
            return
        source = _open(partition.path)
        table = pa.Table.from_batches([source.get_batch(partition.batch)]).select(self.columns)
        yield from table.cast(pa.schema([_plain(f) for f in table.schema]), safe=False).to_batches()


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class FeatherWriter(DataSourceArrowWriter):
    """Tasks write to a hidden folder of the job; the commit moves what succeeded into place."""

    def __init__(self, path: str, schema, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite
        self.job = uuid.uuid4().hex
        # Made here, not by tasks: one that still runs when the job is given up must not bring the folder back.
        system, base = _filesystem(path)
        system.create_dir(f"{base}/_{self.job}", recursive=True)

    def write(self, iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        system, base = _filesystem(self.path)
        writer = sink = name = None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if writer is None:
                name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.feather"
                sink = system.open_output_stream(f"{base}/_{self.job}/{name}")
                writer = pa.ipc.new_file(sink, batch.schema)
            writer.write_batch(batch)
        if writer is not None:
            writer.close()
            sink.close()
        return Written(name)

    def commit(self, messages):
        import pyarrow as pa
        from pyarrow import fs

        system, base = _filesystem(self.path)
        old = []
        if self.overwrite and exists(self.path):
            prefix = self.path[: len(self.path) - len(base)]
            old = [f[len(prefix) :] for f in _files(self.path)]
        new = [m.file for m in messages if m is not None and m.file]
        system.create_dir(base, recursive=True)
        if not new and (self.overwrite or not _files(self.path)):
            with system.open_output_stream(f"{base}/part-00000-{self.job}.feather") as sink, pa.ipc.new_file(sink, to_arrow_schema(self.schema)):
                pass
        for name in new:
            system.move(f"{base}/_{self.job}/{name}", f"{base}/{name}")
        for name in old:
            system.delete_file(name)
        self._clean(system, base, fs)

    def abort(self, messages):
        from pyarrow import fs

        self._clean(*_filesystem(self.path), fs)

    def _clean(self, system, base, fs) -> None:
        if system.get_file_info(f"{base}/_{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/_{self.job}")


class FeatherSource(DataSource):
    """``spark.read.format("feather").load(path)``; option ``columns`` (comma-separated) prunes."""

    @classmethod
    def name(cls):
        return FORMAT

    def _columns(self) -> list[str] | None:
        wanted = self.options.get("columns")
        return [c.strip() for c in wanted.split(",")] if wanted else None

    def schema(self):
        import pyarrow as pa

        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no .feather or .arrow file under {self.options['path']}")
        found = _open(files[0]).schema
        fields = [_plain(f) for f in found]
        wanted = self._columns()
        if wanted:
            fields = [f for name in wanted for f in fields if f.name == name]
        return from_arrow_schema(pa.schema(fields), prefer_timestamp_ntz=True)

    def writer(self, schema, overwrite: bool):
        return FeatherWriter(self.options["path"], schema, overwrite)

    def reader(self, schema):
        return FeatherReader(self.options["path"], [f.name for f in schema.fields])


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(FeatherSource)
