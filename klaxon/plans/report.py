"""The text report, and ingestion of a log or of the synthetic plant into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import rootcause
from ..sources.alarm_log import AlarmLog
from ..sources.store import ParquetStore, read_truth
from ..sources.synthetic import SyntheticPlant
from .service import Service


def ingest_log(spark: SparkSession, store: ParquetStore, path: str, **kw) -> int:
    """Replaces the store's tables by those of a log, all at once; returns how many rows were rejected."""
    log = AlarmLog.read(spark, path, **kw)
    with store.batch(replaces=True) as batch:
        batch.append(log.alarm_events(), "alarms")
        batch.append(log.episodes, "episodes")
        rejected = log.rejected().first()["rejected"]
        batch.set_meta(source=path, kind="real", rejected=rejected)
    return rejected


def ingest_synthetic(spark: SparkSession, store: ParquetStore, **kw) -> SyntheticPlant:
    """Replaces the store's tables by those of a synthetic plant, whose causes go to a JSON file beside them."""
    plant = SyntheticPlant(spark, **kw)
    with store.batch(replaces=True) as batch:
        truth = f"{store.folder}/truth/{batch.name}"
        plant.ground_truth().write.json(truth)
        batch.append(plant.process_samples(), "process_samples")
        batch.append(plant.alarm_events(), "alarms")
        batch.set_meta(source="synthetic generator", kind="synthetic", truth=truth)
    return plant


def truth_of(store: ParquetStore) -> DataFrame | None:
    """The known causes of the store's incidents; none of real data."""
    meta = store.meta()
    return read_truth(store.spark, meta["truth"], meta.get("kind", "synthetic")) if "truth" in meta else None


def report(service: Service, truth: DataFrame | None = None, top: int = 10) -> str:
    """Sections of the analysis as text."""
    parts = [("Bad actors", service.bad_actors(top)), ("Chattering", service.chattering(top)), ("Floods", service.floods().orderBy("window_start").limit(top)), ("Co-occurrence", service.co_occurrence(top)), ("Sequences", service.sequences()), ("Incidents", service.incident_list(top)), ("Root cause", service.root_cause(3).orderBy("incident_id", "rank"))]
    if truth is not None:
        parts.append(("Validation", rootcause.validate(service.ranked, truth)))
    return "\n".join(f"== {name}\n{as_text(df, top)}" for name, df in parts)


def as_text(df, rows: int, width: int = 60) -> str:
    """The first rows as a table of text."""
    lines = [df.columns, *([str(v) for v in r] for r in df.take(rows))]
    lines = [[c if len(c) <= width else c[: width - 1] + "…" for c in line] for line in lines]
    sizes = [max(map(len, column)) for column in zip(*lines, strict=True)]
    return "\n".join("  ".join(c.ljust(n) for c, n in zip(line, sizes, strict=True)).rstrip() for line in lines) + "\n"


def dump(service: Service, path: str) -> None:
    """The dashboard's payload as one JSON file on the driver, written piece by piece."""
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(service.payload_text())
