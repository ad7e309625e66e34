"""What a source offers, and where tables for a while go."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Protocol

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


class _Made(threading.local):
    """Scratch folders that this thread of the driver made and still owns."""

    def __init__(self):
        self.folders: list[str] = []


_made = _Made()


@contextmanager
def scratch() -> Iterator[None]:
    """What scratch_folder() and written() make inside, in this thread, is deleted at the end, also after an error. Results that read it must have
    been taken or written elsewhere by then. Blocks can be nested, and other threads keep theirs."""
    mark = len(_made.folders)
    try:
        yield
    finally:
        gone = _made.folders[mark:]
        del _made.folders[mark:]
        for folder in gone:
            store, path = fs.FileSystem.from_uri(folder)
            if store.get_file_info(path).type != fs.FileType.NotFound:
                store.delete_dir(path)


def scratch_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share; in local mode a temporary one will do."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='klaxon-')}"
    folder = f"{shared.rstrip('/')}/klaxon-core-{uuid.uuid4().hex}"
    _made.folders.append(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """df as a table in a scratch folder, read back: several uses of it cost one computation, and its plan ends there. It goes at the end
    of the scratch() block around it; without one, who owns the shared folder clears it."""
    folder = scratch_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class DataSource(Protocol):
    def process_samples(self) -> DataFrame: ...

    def alarm_events(self) -> DataFrame: ...


class Historian:
    """Plant historians and OPC servers are reached through the files that they export, in batch or as a stream; without a folder there is
    nothing to read."""

    def __init__(self, spark, samples: str | None = None, alarms: str | None = None):
        self.spark, self.folders = spark, {"process_samples": samples, "alarms": alarms}

    def _of(self, kind: str, reader) -> DataFrame:
        from .export import Export

        if not self.folders[kind]:
            raise NotImplementedError(f"name the folder that the historian exports {kind} to")
        self.spark.dataSource.register(Export)
        return reader.format(Export.name()).option("path", self.folders[kind]).option("kind", kind).load()

    def process_samples(self) -> DataFrame:
        return self._of("process_samples", self.spark.read)

    def alarm_events(self) -> DataFrame:
        return self._of("alarms", self.spark.read)

    def sample_stream(self) -> DataFrame:
        return self._of("process_samples", self.spark.readStream)

    def alarm_stream(self) -> DataFrame:
        return self._of("alarms", self.spark.readStream)
