"""Folders that historians, OPC servers and recorders export Parquet files to, as a Spark data source in batch and as a stream.

    spark.dataSource.register(Export)
    spark.read.format("klaxon-export").option("path", folder).option("kind", "process_samples").load()
    spark.readStream.format("klaxon-export") ...

A file is a partition; files in a stream are taken in the order of their names, so an exporter names them by time. A file is read batch by
batch; columns that it lacks are null, and others are left out. The folder is listed and read through pyarrow, so its file system must be one that
pyarrow reaches on the driver and on all executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .. import schema

KINDS = {"process_samples": schema.SAMPLES, "alarms": schema.ALARMS}


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _listed(folder: str) -> list[str]:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")))


def _rows(folder: str, path: str, columns: pa.Schema) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    store = fs.FileSystem.from_uri(folder)[0] if "://" in folder else fs.LocalFileSystem()
    with store.open_input_file(path) as f:
        file = pq.ParquetFile(f)
        known = [c for c in columns.names if c in file.schema_arrow.names]
        for batch in file.iter_batches(10_000, columns=known):
            yield pa.RecordBatch.from_arrays([batch.column(c.name).cast(c.type) if c.name in known else pa.nulls(batch.num_rows, c.type) for c in columns], schema=columns)


class _Reader(DataSourceReader):
    def __init__(self, folder: str, columns: pa.Schema):
        self.folder, self.columns = folder, columns

    def partitions(self) -> list[InputPartition]:
        return [File(p) for p in _listed(self.folder)] or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from _rows(self.folder, partition.path, self.columns)


class _Stream(DataSourceStreamReader):
    """An offset is the name of the last file taken."""

    def __init__(self, folder: str, columns: pa.Schema, most: int):
        self.folder, self.columns, self.most, self.last = folder, columns, most, ""

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        new = [p for p in _listed(self.folder) if p > self.last][: self.most]
        self.last = new[-1] if new else self.last
        return {"after": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = max(self.last, end["after"])  # after a restart, what the checkpoint has is taken already
        return [File(p) for p in _listed(self.folder) if start["after"] < p <= end["after"]]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return _rows(self.folder, partition.path, self.columns)

    def commit(self, end: dict) -> None:
        pass


class Export(DataSource):
    """Options: path; kind (process_samples or alarms); maxFiles of a stream's batch (100)."""

    @classmethod
    def name(cls) -> str:
        return "klaxon-export"

    def schema(self) -> str:
        return KINDS[self.options["kind"]]

    def reader(self, schema) -> DataSourceReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        return _Reader(self.options["path"], to_arrow_schema(schema))

    def streamReader(self, schema) -> DataSourceStreamReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        return _Stream(self.options["path"], to_arrow_schema(schema), int(self.options.get("maxfiles", self.options.get("maxFiles", 100))))
