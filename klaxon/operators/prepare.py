"""Preparation: episodes from transitions, aligned samples, outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.alarms import floor_to, minutes
from ..sources.base import written
from .sessions import neighbours


def _with_neighbours(tx: DataFrame) -> DataFrame:
    rows = neighbours(tx, ["tag", "level"], {"transition": F.col("transition"), "ts": F.col("ts")})
    raises = F.col("transition").isin("N2A", "A2A")
    # Whether an episode is open depends on the row before alone: it is after a raise.
    implicit = (F.col("transition") == "A2N") & F.coalesce(F.col("prev.transition") == "A2N", F.lit(True))
    return rows.withColumns({"raises": raises, "implicit": implicit})


def alarm_events(tx: DataFrame) -> DataFrame:
    """ACTIVE and CLEARED events from N2A, A2A, A2N transitions. A clear without a raise gives both. `part` orders the two."""
    rows = _with_neighbours(tx)
    both = F.when(F.col("implicit"), F.array(F.lit("ACTIVE"), F.lit("CLEARED"))).when(F.col("raises"), F.array(F.lit("ACTIVE"))).otherwise(F.array(F.lit("CLEARED")))
    return rows.select("ts", "seq", "tag", "level", "priority", "zone", "description", F.posexplode(both).alias("part", "state"))


def episodes(tx: DataFrame) -> DataFrame:
    """One row for each raise that is closed by a clear or another raise, or still standing, and for each clear without a raise. A raise
    from normal over an open episode replaces it."""
    rows = _with_neighbours(tx)
    rows = rows.where((F.col("raises") & F.coalesce(F.col("next.transition") != "N2A", F.lit(True))) | F.col("implicit"))
    standing = F.col("raises") & F.col("next").isNull()
    rows = rows.select("tag", "level", "priority", "zone", "description", F.col("ts").alias("start_ts"), F.when(F.col("implicit"), F.col("ts")).otherwise(F.col("next.ts")).alias("end_ts"), "implicit", standing.alias("standing"))
    return rows.select("tag", "level", "priority", "zone", "description", "start_ts", "end_ts", F.when(~F.col("implicit") & ~F.col("standing"), minutes("start_ts", "end_ts")).alias("duration_min"), "implicit", "standing")


def align_tags(samples: DataFrame, width_min: int = 1, limit: int = 3) -> DataFrame:
    """ts, tag, value on the grid that all tags share: means by cell, gaps filled on the line between neighbours for their first
    `limit` cells, ends held for as many; what is not filled is null. The grid spans the stream; a cell is made for each tag. A known
    cell fills those after it, at most `limit`; the empty grid is made by tag and run of 1,000 cells, so no task holds a tag's whole span."""
    cells = samples.groupBy(floor_to("ts", width_min).alias("ts"), "tag").agg(F.avg("value").alias("value"))
    place = F.expr(f"timestampdiff(MINUTE, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div {width_min}")
    cells = cells.where("ts IS NOT NULL").select("tag", "ts", place.alias("i"), F.lit(0).alias("seq"), "value")
    span = cells.agg(F.min("i").alias("lo"), F.max("i").alias("hi"))  # one row
    runs = cells.select("tag").distinct().join(F.broadcast(span)).select("tag", "lo", "hi", F.explode(F.expr("sequence(lo div 1000, hi div 1000)")).alias("run"))
    grid = runs.repartition("tag", "run").select("tag", F.explode(F.expr("sequence(greatest(lo, run * 1000), least(hi, run * 1000 + 999))")).alias("i"))
    known = neighbours(cells.where("value IS NOT NULL"), ["tag"], {"i": F.col("i"), "value": F.col("value")}, width_min * 60_000_000 * 1000)
    upto = F.least(F.col("i") + limit, F.coalesce(F.col("next.i") - 1, F.col("i") + limit))
    known = known.select("tag", F.col("i").alias("from"), "value", "next", F.explode(F.sequence("i", upto)).alias("i"))
    line = F.col("value") + F.coalesce((F.col("next.value") - F.col("value")) * (F.col("i") - F.col("from")) / (F.col("next.i") - F.col("from")), F.lit(0.0))
    filled = known.select("tag", "i", F.when(F.col("i") == F.col("from"), F.col("value")).otherwise(line).alias("value"))
    ts = F.expr(f"timestampadd(MINUTE, cast(i * {width_min} AS int), TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return grid.join(filled, ["tag", "i"], "left").select(ts.alias("ts"), "tag", "value")


def pivot_tags(aligned: DataFrame, tags: list[str]) -> DataFrame:
    """One column for each of the tags."""
    return aligned.groupBy("ts").pivot("tag", tags).agg(F.first("value"))


def medians(df: DataFrame, key: str, value: str, pieces: int = 200) -> DataFrame:
    """key, median: exact, and the mean of the two middle values of an even number. Approximate quantiles cut a key's distinct values into
    pieces, whose counts tell the one or two that hold the middle; only those are sorted, so no task holds a key's values. The cuts depend on the order in
    which partial results arrive, so they are written once: pieces counted by some cuts and sorted by others would give a neighbour of the median."""
    known = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    cuts = written(known.groupBy("k").agg(F.percentile_approx("v", [n / pieces for n in range(1, pieces)], 10_000).alias("cuts"), F.count("*").alias("total")))
    counts = known.groupBy("k", "v").agg(F.count("*").alias("n")).join(cuts, "k").withColumn("piece", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    sizes = counts.groupBy("k", "piece", "total").agg(F.sum("n").alias("m"))
    before = F.sum("m").over(Window.partitionBy("k").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    middle = sizes.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") <= high) & (F.col("before") + F.col("m") > low)).select("k", "piece", "before")
    inside = Window.partitionBy("k", "piece").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.join(middle, ["k", "piece"]).withColumn("upto", F.col("before") + F.sum("n").over(inside))
    at = lambda place: F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("n") <= place), F.col("v")))
    return rows.groupBy("k").agg((0.5 * at(low) + 0.5 * at(high)).alias("median")).withColumnRenamed("k", key)


def flag_outliers(samples: DataFrame, z: float = 4.0) -> DataFrame:
    """samples with `outlier`: farther from the tag's median than z scaled median deviations. Medians are aggregates joined back, so a tag's
    rows are not gathered in a window or a buffer."""
    rows = samples.join(medians(samples, "tag", "value").withColumnRenamed("median", "med"), "tag", "left")
    off = F.abs(F.col("value") - F.col("med"))
    mad = medians(rows.select("tag", off.alias("off")), "tag", "off").withColumnRenamed("median", "mad")
    scale = F.coalesce(F.nullif("mad", F.lit(0.0)), F.lit(1e-9))
    return rows.join(mad, "tag", "left").withColumn("outlier", off / (1.4826 * scale) > z).drop("med", "mad")
