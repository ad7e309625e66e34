"""Accuracy by day, kept up to date as confirmations come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.knowledge import accuracy_of_parts, accuracy_parts
from ..sources.store import ParquetStore


def fold_accuracy(confirmations: DataFrame, store: ParquetStore, checkpoint: str, name: str = "accuracy") -> StreamingQuery:
    """Adds each batch's sums by day and method to the store, once: a batch that runs again after a crash finds its name committed. The candidates
    are those of the store when the batch comes."""

    def add(rows: DataFrame, epoch: int) -> None:
        with store.batch(f"{name}-{epoch}") as batch:
            batch.append(accuracy_parts(rows, store.read("candidates").withColumnRenamed("tag", "candidate_tag")), "accuracy_parts")

    return confirmations.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accuracy(store: ParquetStore) -> DataFrame:
    """As knowledge.accuracy_by_day() of all confirmations that have been folded, from a row for each day, method and batch."""
    return accuracy_of_parts(store.read("accuracy_parts"))


def confirmed_so_far(store: ParquetStore) -> DataFrame:
    """One row: how many folded confirmations there are, and how many had the first candidate right."""
    return store.read("accuracy_parts").agg(F.coalesce(F.sum("total_count"), F.lit(0)).alias("confirmations"), F.coalesce(F.sum("correct_count"), F.lit(0)).alias("top1_correct"))
