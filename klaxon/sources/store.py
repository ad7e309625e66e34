"""Tables as Parquet below one folder, by committed batches: alarms, episodes, samples, confirmations, incidents, and key-value metadata."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .. import schema

TABLES = {"process_samples": schema.SAMPLES, "alarms": schema.ALARMS, "episodes": schema.EPISODES, "kb_confirmations": schema.CONFIRMATIONS, "incidents": schema.INCIDENTS, "incident_alarms": schema.INCIDENT_ALARMS, "candidates": schema.CANDIDATES, "accuracy_parts": schema.ACCURACY_PARTS, "dataset_meta": schema.META}
DAY = {"process_samples": "ts", "alarms": "ts", "episodes": "start_ts"}
COMMITS = "version long, batch string, tables array<string>, replaces boolean"


class Batch:
    """Rows for one or more tables that become visible together, when the batch is committed. Each table's rows go to a folder of the batch;
    a job that dies leaves folders that no read looks at, and a batch of the same name overwrites them. A batch whose name is committed already
    writes nothing (`done`), so a caller that runs again with the same name, such as foreachBatch with its epoch, adds no rows twice."""

    def __init__(self, store: ParquetStore, name: str | None, replaces: bool):
        self.store, self.name, self.replaces, self.tables = store, name or uuid.uuid4().hex, replaces, []
        self.done = name is not None and any(c["batch"] == name for c in store.commits())

    def append(self, df: DataFrame, table: str) -> None:
        """Missing columns are null, others are left out. A table at most once a batch."""
        if self.done:
            return
        if table in self.tables:
            raise ValueError(f"{table} is in this batch already")
        out, path = self.store.shaped(df, table), self.store.path(table, self.name)
        if table in DAY:
            out = out.withColumn("day", F.to_date(DAY[table]))
            # One file or a few for each day and not one from each task; a heavy day is split.
            out.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(path)
        else:
            out.write.mode("overwrite").parquet(path)
        self.tables.append(table)

    def set_meta(self, **values: str) -> None:
        self.append(self.store.spark.createDataFrame([(k, str(v)) for k, v in values.items()], schema.META).coalesce(1), "dataset_meta")

    def __enter__(self) -> Batch:
        return self

    def __exit__(self, failed, *_) -> None:
        if failed is None and not self.done and (self.tables or self.replaces):
            version = max((c["version"] for c in self.store.commits()), default=0) + 1
            # One row in one file, which its writer's commit makes visible as a whole.
            self.store.spark.createDataFrame([(version, self.name, self.tables, self.replaces)], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.store.folder}/commits")


class ParquetStore:
    """What a read sees are the committed batches from the last one that replaces all before it; commits are one row for each batch, and
    compact() makes one of them. Batches that append can be written side by side, one that replaces wants no other writer. Tables with times are
    laid out by day, and a read between two times looks into the days between them alone."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, table: str, batch: str) -> str:
        return f"{self.folder}/{table}/batch={batch}"

    def batch(self, name: str | None = None, replaces: bool = False) -> Batch:
        return Batch(self, name, replaces)

    def commits(self) -> list:
        """All commits, oldest first."""
        try:
            return self.spark.read.schema(COMMITS).parquet(f"{self.folder}/commits").orderBy("version", "batch").collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []

    def visible(self) -> list:
        found = self.commits()
        return found[max((k for k, c in enumerate(found) if c["replaces"]), default=0) :]

    def shaped(self, df: DataFrame, table: str) -> DataFrame:
        fields = self.spark.createDataFrame([], TABLES[table]).schema
        return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))

    def append(self, df: DataFrame, table: str) -> None:
        with self.batch() as batch:
            batch.append(df, table)

    def append_rows(self, rows: list[tuple], table: str) -> None:
        """Objects of one writer; none, nothing is written."""
        if rows:
            self.append(self.spark.createDataFrame(rows, TABLES[table]), table)

    def reset(self) -> None:
        """Empties all tables at once."""
        with self.batch(replaces=True):
            pass

    def _stored(self, table: str, batches: list[str]) -> DataFrame:
        fields = self.spark.createDataFrame([], TABLES[table]).schema.add("batch", "string")
        fields = fields.add("day", "date") if table in DAY else fields
        if not batches:
            return self.spark.createDataFrame([], fields)
        return self.spark.read.schema(fields).option("basePath", f"{self.folder}/{table}").parquet(*(self.path(table, b) for b in batches))

    def read(self, table: str, start: str | None = None, end: str | None = None) -> DataFrame:
        """A table; empty if it was never written. Files of older shape give nulls for columns they lack. Of a table with times, `start` and
        `end` (inclusive) choose the rows between them, and the days that are read."""
        rows = self._stored(table, [c["batch"] for c in self.visible() if table in c["tables"]])
        for bound, keep in ((start, lambda c, b: c >= b), (end, lambda c, b: c <= b)):
            if bound is not None:
                at = F.lit(bound).cast("timestamp_ntz")
                rows = rows.where(keep(F.col("day"), at.cast("date")) & keep(F.col(DAY[table]), at))
        return rows.select(*(f.name for f in self.spark.createDataFrame([], TABLES[table]).schema))

    def set_meta(self, **values: str) -> None:
        with self.batch() as batch:
            batch.set_meta(**values)

    def meta(self) -> dict[str, str]:
        """Of each key the value of the newest batch."""
        batches = [c["batch"] for c in self.visible() if "dataset_meta" in c["tables"]]
        place = {b: k for k, b in enumerate(batches)}
        rows = self._stored("dataset_meta", batches).select("batch", "key", "value").collect()
        return {r["key"]: r["value"] for r in sorted(rows, key=lambda r: place[r["batch"]])}

    def compact(self) -> None:
        """One batch in place of all visible ones, with the newest metadata."""
        now, meta = self.visible(), self.meta()
        with self.batch(replaces=True) as batch:
            for table in TABLES:
                if table != "dataset_meta" and any(table in c["tables"] for c in now):
                    batch.append(self.read(table), table)
            if meta:
                batch.set_meta(**meta)

    def sql(self, text: str, start: str | None = None, end: str | None = None) -> DataFrame:
        """A query over the tables by name, those with times between `start` and `end`."""
        for table in TABLES:
            self.read(table, *((start, end) if table in DAY else ())).createOrReplaceTempView(table)
        return self.spark.sql(text)


def read_truth(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """Ground truth of synthetic data, from JSON; none of real data."""
    if kind == "real":
        return None
    return spark.read.schema("incident_id string, scenario string, root_cause string, root_tag string").json(path)


def to_json(one_row: DataFrame) -> dict:
    """A row of structs and arrays as plain values."""
    found = one_row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()
    return json.loads(found["j"]) if found else {}
