"""What the operators of this subpackage share: reading tables, scratch tables in the shared folder (which cut lineage), samples."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode; on a
    cluster that is an error, as executors could not read each other's files there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='klaxon-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class _Made(threading.local):
    """Scratch folders that this thread of the driver made and that still exist: runs in other threads don't delete them."""

    def __init__(self):
        self.folders: list[str] = []

    def __getitem__(self, at):
        return self.folders[at]


_made = _Made()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    folder = f"{shared_dir(spark)}/klaxon-{uuid.uuid4().hex}"
    _made.folders.append(folder)
    return f"{folder}/{name}"


def save(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again. This cuts its lineage, and unlike a checkpoint works df out once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """What free() takes."""
    return len(_made.folders)


def free(mark: int = 0, upto: int | None = None) -> None:
    """Deletes the scratch folders made from one mark to another (to now). Results that read them must have been written elsewhere:
    operators return plans over scratch tables, so only their caller knows when those can go."""
    gone = _made.folders[mark:upto]
    del _made.folders[mark:upto]
    for folder in gone:
        store, base = fs.FileSystem.from_uri(folder)
        if store.get_file_info(base).type != fs.FileType.NotFound:
            store.delete_dir(base)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def slices(batch, column: str, most_bytes: int = 8 << 20):
    """An Arrow batch in runs of rows whose column holds about most_bytes, so that Python holds little at a time."""
    rows = max(1, int(most_bytes / max(1, batch.column(column).nbytes / max(1, batch.num_rows))))
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def sample_of(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows of df, those of lowest hash of `key`. A count gives the hash below which little more than `most` rows are
    expected, so that tasks send about that many in all, and not that many each, to where they are sorted."""
    n, hashed = df.count(), F.xxhash64(key)
    if n > most:
        share = min(1.0, (1.1 * most + 1_000) / n)
        df = df.where(hashed <= F.lit(int(-(2**63) + share * (2**64 - 2**11))))
    return df.orderBy(hashed, *sorted(df.columns)).limit(most)


#: A key that more than one row in HOT_SHARE has is hot; there are fewer than HOT_SHARE of them.
HOT_SHARE = 5_000


def join_by_key(rows: DataFrame, table: DataFrame, key: str, table_key: str, weight: str, total: float) -> DataFrame:
    """rows joined with `table`, which has one row for each key, under another name; `weight` is how many of the `total` rows have it. The
    few keys that are hot go by broadcast, so their rows stay where they are; all other keys are joined by a shuffle."""
    table = save(table, "by-key")
    hot = F.broadcast(table.where(F.col(weight) * HOT_SHARE > total))
    cold = table.where(F.col(weight) * HOT_SHARE <= total)
    same = F.col(key) == F.col(table_key)
    return rows.join(hot, same).unionByName(rows.join(hot.select(table_key), same, "left_anti").join(cold, same))
