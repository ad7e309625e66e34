"""Bad actors, chattering, floods, co-occurrence, pre-incident sequences. Ties go by key, so results are whole orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.alarms import active, floor_to, micros, severity, step
from .sessions import HOUR, gap_sessions, positions


def bad_actors(alarms: DataFrame, top: int | None = 10) -> DataFrame:
    """tag, alarm_count, pct, cum_pct, worst_priority, top_level. cum_pct adds up rounded shares, most alarms first. A share that doesn't round to 0
    is over 0.05 %, so fewer than 2,000 tags have one, and only those are added up in order; the sum of all of them is every other tag's."""
    by_level = active(alarms).groupBy("tag", "level").agg(F.count("*").alias("n"), F.max_by("priority", F.struct(severity(F.col("priority")), "priority")).alias("p"))
    worst = F.max_by("p", F.struct(severity(F.col("p")), "p")).alias("worst_priority")
    level = F.min(F.struct((-F.col("n")).alias("down"), "level"))["level"].alias("top_level")
    counts = by_level.groupBy("tag").agg(F.sum("n").alias("alarm_count"), worst, level)
    total = counts.agg(F.sum("alarm_count").alias("total"))
    counts = counts.crossJoin(F.broadcast(total)).withColumn("pct", F.bround(100 * F.col("alarm_count") / F.col("total"), 1))
    # Each tag without a share is a partition of its own.
    w = Window.partitionBy("_rest").orderBy(F.desc("alarm_count"), "tag").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("_rest", F.when(F.col("pct") == 0, F.col("tag"))).withColumn("_upto", F.sum("pct").over(w))
    whole = counts.agg(F.sum("pct").alias("_whole"))
    out = upto.crossJoin(F.broadcast(whole)).withColumn("cum_pct", F.bround(F.when(F.col("pct") == 0, F.col("_whole")).otherwise(F.col("_upto")), 1)).select("tag", "alarm_count", "pct", "cum_pct", "worst_priority", "top_level")
    return out if top is None else out.orderBy(F.desc("alarm_count"), "tag").limit(top)


def chattering(alarms: DataFrame, window_s: int = 60, min_repeats: int = 3, top: int | None = 25, bucket_s: int | None = None) -> DataFrame:
    """tag, level, activations, chattering_events, chatter_pct. An event chatters if at least min_repeats of its kind, itself
    included, lie in the window_s from it on. A kind's events are cut into buckets of time; those within window_s of a bucket's start are
    shown to the bucket before as well, so no task holds all of a chattering source."""
    width, reach = (bucket_s or max(7 * 86_400, 50 * window_s)) * 1_000_000, window_s * 1_000_000
    rows = active(alarms).select("tag", "level", micros("ts").alias("us"))
    bucket = F.floor(F.col("us") / width)
    shown = F.explode(F.when(F.col("us") - bucket * width <= reach, F.array(bucket, bucket - 1)).otherwise(F.array(bucket)))
    rows = rows.select("tag", "level", "us", bucket.alias("own"), shown.alias("bucket"))
    w = Window.partitionBy("tag", "level", "bucket").orderBy("us")
    # The frame also counts earlier rows of the same instant; row_number - rank is how many.
    ahead = F.count("*").over(w.rangeBetween(0, reach)) - (F.row_number().over(w) - F.rank().over(w))
    rows = rows.withColumn("ahead", ahead).where("own = bucket")
    out = rows.groupBy("tag", "level").agg(F.count("*").alias("activations"), F.count_if(F.col("ahead") >= min_repeats).alias("chattering_events"))
    out = out.where((F.col("chattering_events") > 0) & (F.col("activations") >= min_repeats)).withColumn("chatter_pct", F.bround(100 * F.col("chattering_events") / F.col("activations"), 1))
    return out if top is None else out.orderBy(F.desc("chattering_events"), "tag", "level").limit(top)


def alarm_floods(alarms: DataFrame, window_min: int = 10, threshold: int = 10) -> DataFrame:
    """window_start, alarm_count, top_priority of the windows with more than `threshold` alarms."""
    by = active(alarms).where("ts IS NOT NULL").groupBy(floor_to("ts", window_min).alias("window_start"), "priority").agg(F.count("tag").alias("n"), F.count("*").alias("rows"))
    key = F.struct("rows", severity(F.col("priority")), F.col("priority"))
    out = by.groupBy("window_start").agg(F.sum("n").alias("alarm_count"), F.coalesce(F.max_by("priority", F.when(F.col("priority").isNotNull(), key)), F.lit("-")).alias("top_priority"))
    return out.where(F.col("alarm_count") > threshold)


def co_occurrence(alarms: DataFrame, window_min: int = 15, min_pairs: int = 3, max_neighbours: int = 40, top: int | None = 40) -> DataFrame:
    """tag_a, tag_b, co_occurrences: unequal tags of events at most window_min and max_neighbours places apart. The order of the stream is
    cut into blocks of max_neighbours places, and a block meets itself and the next: an equi-join of bounded fan-out."""
    rows = positions(active(alarms).select("ts", "seq", "tag")).select(F.col("pos"), "tag", micros("ts").alias("us"), F.floor(F.col("pos") / max_neighbours).alias("blk"))
    left = rows.select(F.col("pos").alias("i"), F.col("tag").alias("a"), F.col("us").alias("from_us"), F.explode(F.array("blk", F.col("blk") + 1)).alias("blk"))
    met = left.join(rows, "blk").where((F.col("pos") > F.col("i")) & (F.col("pos") - F.col("i") <= max_neighbours) & (F.col("us") - F.col("from_us") <= window_min * 60_000_000) & (F.col("a") != F.col("tag")))
    out = met.groupBy(F.least("a", "tag").alias("tag_a"), F.greatest("a", "tag").alias("tag_b")).agg(F.count("*").alias("co_occurrences")).where(F.col("co_occurrences") >= min_pairs)
    return out if top is None else out.orderBy(F.desc("co_occurrences"), "tag_a", "tag_b").limit(top)


def pre_incident_sequences(alarms: DataFrame, top: int | None = 8, gap_min: int = 30, depth: int = 5, anchor: str = "CRITICAL") -> DataFrame:
    """sequence, occurrences: the last `depth` steps, repeats in a row left out, up to the last anchor alarm of each session. A session's
    rows are cut at every day, so a stream without a silence is not one task's work, and each day gives its last `depth` steps."""
    rows = gap_sessions(active(alarms).select("ts", "seq", "tag", "level", "priority"), gap_min)
    last = rows.where(F.col("priority") == anchor).groupBy("session").agg(F.max(F.struct("ts", "seq")).alias("cut"))
    rows = rows.join(last, "session").where(F.struct("ts", "seq") <= F.col("cut")).withColumn("step", step())
    steps = rows.select("session", "ts", "seq", "step", F.floor(micros("ts") / (24 * HOUR)).alias("day"))
    for part in (["session", "day"], ["session"]):
        in_order, back = (Window.partitionBy(*part).orderBy(*order) for order in (("ts", "seq"), (F.desc("ts"), F.desc("seq"))))
        # A day's first kept step that equals the last of the day before goes: it repeats it, or, where steps between the two were cut, the
        # other stands in its place, so the sequence reads the same.
        steps = steps.withColumn("before", F.lag("step").over(in_order)).where("before IS NULL OR before <> step")
        steps = steps.withColumn("k", F.row_number().over(back)).where(F.col("k") <= depth).select("session", "ts", "seq", "step")
    kept = steps.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "step"))).alias("s")).where("size(s) >= 2")
    out = kept.groupBy(F.array_join(F.transform("s", lambda x: x["step"]), " -> ").alias("sequence")).agg(F.count("*").alias("occurrences"))
    return out if top is None else out.orderBy(F.desc("occurrences"), "sequence").limit(top)
