"""A synthetic plant with known root causes, made by Spark from a seed: the same rows for the same arguments, in any partitioning. Draws
are hashes of what they are drawn for, so no generator's state is carried."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema

START = "TIMESTAMP_NTZ'2025-01-01 00:00:00'"


class SyntheticPlant:
    def __init__(self, spark: SparkSession, *, days: int = 14, sample_seconds: int = 60, incidents_per_day: float = 1.4, seed: int = 7):
        self.spark, self.days, self.sample_seconds, self.seed = spark, days, sample_seconds, seed
        self.n = int(days * incidents_per_day)

    def draw(self, what: str, *of: str) -> Column:
        """Uniform in [0, 1)."""
        return F.pmod(F.xxhash64(F.lit(f"{self.seed}|{what}"), *of), F.lit(1 << 30)) / float(1 << 30)

    def _between(self, lo: int, hi: int, what: str, *of: str) -> Column:
        return (F.floor(self.draw(what, *of) * (hi - lo + 1)) + lo).cast("int")

    def _later(self, ts: Column, seconds: Column) -> Column:
        return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))

    def incidents(self) -> DataFrame:
        """incident_id, scenario, root_cause, chain, t0."""
        plans = self.spark.createDataFrame([(k, *s) for k, s in enumerate(schema.SCENARIOS)], "k int, scenario string, root_cause string, chain array<struct<tag:string,level:string,delay_min:double>>")
        rows = self.spark.range(self.n).withColumn("k", self._between(0, len(schema.SCENARIOS) - 1, "scenario", "id"))
        minute = self._between(30, self.days * 1440 - 60, "t0", "id")
        rows = rows.join(F.broadcast(plans), "k")  # as many rows as there are scenarios
        return rows.select(F.format_string("INC-%03d", "id").alias("incident_id"), "scenario", "root_cause", "chain", self._later(F.expr(START), minute * 60).alias("t0"))

    def ground_truth(self) -> DataFrame:
        """incident_id, scenario, root_cause, t0, root_tag (the first tag of the chain)."""
        return self.incidents().select("incident_id", "scenario", "root_cause", "t0", F.col("chain")[0]["tag"].alias("root_tag"))

    def process_samples(self) -> DataFrame:
        tags = self.spark.createDataFrame([t[:1] + t[2:4] for t in schema.PLANT_TAGS], "tag string, setpoint double, noise double")
        steps = self.spark.range(self.days * 86_400 // self.sample_seconds).crossJoin(F.broadcast(tags))  # ten tags
        minute = F.col("id") * self.sample_seconds / 60
        wave = F.sin((minute + F.pmod(F.crc32(F.col("tag")), F.lit(100))) / 180)
        gauss = F.sqrt(-2 * F.log(1 - self.draw("g1", "id", "tag"))) * F.cos(2 * math.pi * self.draw("g2", "id", "tag"))
        value = F.col("setpoint") + 0.4 * F.col("noise") * wave + F.col("noise") * gauss
        return steps.select(self._later(F.expr(START), F.col("id") * self.sample_seconds).alias("ts"), "tag", F.bround(value, 3).alias("value"))

    def _with_clear(self, raised: DataFrame, seconds: Column) -> DataFrame:
        both = raised.withColumn("clear_ts", self._later(F.col("ts"), seconds))
        states = F.explode(F.array(F.struct(F.lit("ACTIVE").alias("state"), F.col("ts").alias("at")), F.struct(F.lit("CLEARED").alias("state"), F.col("clear_ts").alias("at"))))
        return both.select("*", states.alias("s")).select(F.col("s.at").alias("ts"), "tag", "level", "priority", F.col("s.state").alias("state"), "value", "incident_id")

    def alarm_events(self) -> DataFrame:
        limits = self.spark.createDataFrame([(t[0], level, limit, t[3], schema.LEVEL_PRIORITY[level]) for t in schema.PLANT_TAGS for level, limit in t[4].items()], "tag string, level string, limit double, noise double, priority string")
        steps = self.incidents().select("incident_id", "t0", F.posexplode("chain").alias("k", "c")).select("incident_id", "t0", "k", "c.*")
        side = F.when(F.col("level").isin("HI", "HIHI"), 1.0).otherwise(-1.0)
        value = F.bround(F.col("limit") + side * F.col("noise") * (1 + 1.5 * self.draw("past", "incident_id", "k")), 3)
        chain = steps.join(F.broadcast(limits), ["tag", "level"]).select(self._later(F.col("t0"), F.col("delay_min") * 60).alias("ts"), "tag", "level", "priority", value.alias("value"), "incident_id", "k")
        chain = self._with_clear(chain, 60 * self._between(3, 12, "clear", "incident_id", "k"))
        tag = next(t for t in schema.PLANT_TAGS if t[0] == schema.CHATTERING_TAG)
        burst = self.spark.range(self.days).select("id", F.explode(F.sequence(F.lit(0), self._between(20, 45, "burst", "id") - 1)).alias("j"))
        at = F.col("id") * 86_400 + 3_600 * self._between(2, 20, "hour", "id") + F.col("j") * self._between(20, 90, "every", "id", "j")
        nothing = F.lit(None).cast("string")
        burst = burst.select(self._later(F.expr(START), at).alias("ts"), F.lit(tag[0]).alias("tag"), F.lit("LO").alias("level"), F.lit("LOW").alias("priority"), F.lit(tag[4]["LO"] - tag[3]).alias("value"), nothing.alias("incident_id"), "id", "j")
        rows = chain.unionByName(self._with_clear(burst, self._between(5, 25, "off", "id", "j")))
        seq = F.xxhash64("ts", "tag", "level", "state", "incident_id")
        return rows.withColumns({"seq": seq, "description": nothing, "zone": nothing})
