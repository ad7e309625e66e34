"""The alarm-transaction log, a CSV export of 15 columns."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alarms import classify_type, map_priority, strip, zone_of
from ..operators.prepare import alarm_events, episodes
from .csv_scan import read_records

COLUMNS = "DateTime ProcessID AssetID AlarmSeverityName State TransactionMessage Stage AlarmClassName Year Month Day DayOfWeek Season Hour ProcessedMessage".split()
NULLS = ["", "NA", "N/A", "NaN", "nan", "NULL", "null", "None", "n/a", "#N/A", "<NA>"]
KNOWN = ["N2A", "A2A", "A2N"]


def read_raw(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> DataFrame:
    """All columns as strings, with `seq`: the rows' order, by file name and place in the file. Quoted fields may hold doubled quotes and line
    ends, and a large file is still read by many tasks."""
    return read_records(spark, path, COLUMNS, encoding)


def typed(raw: DataFrame, pattern: str = "d-M-yyyy H:mm") -> DataFrame:
    """Every row of raw (COLUMNS and seq), projected; ts is null where the time can't be read."""
    col = lambda c: F.when(~F.col(c).isin(NULLS), F.col(c))
    message = strip(F.coalesce(col("ProcessedMessage"), col("TransactionMessage"), F.lit("")))
    rows = raw.select(
        F.try_to_timestamp(F.col("DateTime"), F.lit(pattern)).cast("timestamp_ntz").alias("ts"), "seq",
        strip(F.coalesce(col("AssetID"), F.lit("UNKNOWN-ASSET"))).alias("tag"), F.upper(strip(F.coalesce("State", F.lit("")))).alias("transition"),
        message.alias("message"), F.coalesce(strip(col("AlarmSeverityName")), F.lit("")).alias("severity"),
        F.coalesce(strip(col("AlarmClassName")), F.lit("")).alias("alarm_class"), F.coalesce(col("Stage"), F.lit("Unknown")).alias("stage"),
    )
    rows = rows.withColumn("level", classify_type(F.col("message")))
    return rows.withColumns({"priority": map_priority(F.col("severity"), F.col("alarm_class"), F.col("level")), "zone": zone_of(F.col("tag")), "description": F.substring("message", 1, 120)})


class AlarmLog:
    """Transitions, events and episodes of a log; `start` and `end` are inclusive."""

    def __init__(self, raw: DataFrame, *, start: str | None = None, end: str | None = None, pattern: str = "d-M-yyyy H:mm"):
        self.all = typed(raw, pattern)
        self.inside = F.col("ts").isNotNull()
        if start:
            self.inside &= F.col("ts") >= F.lit(start).cast("timestamp_ntz")
        if end:
            self.inside &= F.col("ts") <= F.lit(end).cast("timestamp_ntz")
        self.transitions = self.all.where(self.inside & F.col("transition").isin(KNOWN))

    @classmethod
    def read(cls, spark: SparkSession, path: str | list[str], **kw) -> AlarmLog:
        return cls(read_raw(spark, path), **kw)

    def rejected(self) -> DataFrame:
        """One row: rows whose time can't be read, and those between `start` and `end` whose transition can't be."""
        return self.all.agg(F.count_if(F.col("ts").isNull() | (self.inside & ~F.col("transition").isin(KNOWN))).alias("rejected"))

    @cached_property
    def episodes(self) -> DataFrame:
        return episodes(self.transitions)

    def alarm_events(self) -> DataFrame:
        nothing = F.lit(None)
        return alarm_events(self.transitions).withColumns({"value": nothing.cast("double"), "incident_id": nothing.cast("string")})

    def process_samples(self) -> DataFrame:
        from ..schema import SAMPLES

        return self.all.sparkSession.createDataFrame([], SAMPLES)
