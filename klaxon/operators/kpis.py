"""EEMUA-191 key figures. Windows without alarms are never made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import schema
from ..functions.alarms import active, floor_to, minutes, priority_of, severity, verdict
from ..sources.base import written
from .analysis import bad_actors


def _per_window(alarms: DataFrame, window_min: int) -> DataFrame:
    return active(alarms).where("ts IS NOT NULL").groupBy(floor_to("ts", window_min).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))


def _rate(per: DataFrame, window_min: int) -> DataFrame:
    """alarm_rate of windows (n, lo, hi)."""
    one = per.agg(
        F.sum("n").alias("total"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.avg("n").alias("mean"), F.max("n").alias("peak"), F.count("*").alias("windows"), F.count_if(F.col("n") > schema.MANAGEABLE_PEAK).alias("flood")
    )
    rate = F.col("total") / F.greatest(minutes("lo", "hi") / window_min, F.lit(1.0))
    return one.where("total > 0").select(
        F.lit(window_min).alias("window_min"),
        F.bround(rate, 2).alias("avg_per_window"),
        F.bround("mean", 2).alias("avg_per_window_when_active"),
        F.col("peak").alias("peak_per_window"),
        F.col("windows").alias("active_windows"),
        F.col("flood").alias("flood_windows"),
        F.bround(100 * F.col("flood") / F.col("windows"), 1).alias("flood_share_of_active_pct"),
        verdict(rate).alias("eemua_verdict"),
        F.lit(schema.TARGET_RATE).alias("target_per_window"),
    )


def alarm_rate(alarms: DataFrame, window_min: int = 10) -> DataFrame:
    """One row (none without alarms): means, peak and floods over the windows that have alarms."""
    return _rate(_per_window(alarms, window_min), window_min)


def _mix(counts: DataFrame) -> DataFrame:
    """priority_distribution of counts (priority, n)."""
    total = counts.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1)).alias("total"))
    targets = counts.sparkSession.createDataFrame(list(schema.TARGET_MIX.items()), "priority string, target_pct double")
    share = 100 * F.coalesce("n", F.lit(0)) / F.col("total")
    return targets.join(counts, "priority", "left").crossJoin(F.broadcast(total)).select(
        "priority", F.coalesce("n", F.lit(0)).alias("alarm_count"), F.bround(share, 1).alias("pct"), "target_pct", F.bround(share - F.col("target_pct"), 1).alias("delta_pct")
    )


def priority_distribution(alarms: DataFrame) -> DataFrame:
    """The four priorities against their targets; the total has unknown priorities but not null ones."""
    return _mix(active(alarms).where("priority IS NOT NULL").groupBy("priority").agg(F.count("*").alias("n")))


def _zones(per: DataFrame, top: int | None) -> DataFrame:
    """zone_load of counts (zone, w, n)."""
    out = per.groupBy("zone").agg(F.sum("n").alias("alarm_count"), F.max("n").alias("peak_per_window"), F.count("*").alias("active_windows"))
    out = out.withColumn("over_manageable_peak", F.col("peak_per_window") > schema.MANAGEABLE_PEAK)
    return out if top is None else out.orderBy(F.desc("alarm_count"), "zone").limit(top)


def zone_load(alarms: DataFrame, window_min: int = 10, top: int | None = 10) -> DataFrame:
    per = active(alarms).where("zone IS NOT NULL AND ts IS NOT NULL").groupBy("zone", floor_to("ts", window_min).alias("w")).agg(F.count("*").alias("n"))
    return _zones(per, top)


def _standing(standing: DataFrame, as_of: DataFrame, top: int | None, hours: float) -> DataFrame:
    days = F.bround(minutes("start_ts", "as_of") / 1440, 1)
    out = standing.crossJoin(F.broadcast(as_of)).withColumn("days_standing", days).where(F.col("days_standing") >= hours / 24)
    out = out.select("tag", "level", "priority", "start_ts", "days_standing", "description")
    return out if top is None else out.orderBy(F.desc("days_standing"), "start_ts", "tag", "level").limit(top)


def standing_alarms(episodes: DataFrame, top: int | None = 15, hours: float = schema.STANDING_HOURS) -> DataFrame:
    """Episodes never closed; days are counted to the last start of any, and rounded before they are compared."""
    return _standing(episodes.where("standing"), episodes.agg(F.max("start_ts").alias("as_of")), top, hours)


def quantiles(counts: DataFrame, at: dict[str, float], pieces: int = 200) -> DataFrame:
    """One row: exact quantiles, between two values on the line between them, of numbers `v` that occur `n` times each. Approximate quantiles cut
    the distinct numbers into pieces, whose counts tell the few that hold the places asked for; only those are sorted. No buffer holds the
    numbers, and the passes over `counts` are three whatever is asked."""
    # Written once, as they depend on the order in which partial results arrive: all uses must see the same pieces.
    cuts = written(counts.agg(F.percentile_approx("v", [k / pieces for k in range(1, pieces)], 10_000).alias("cuts"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")))
    placed = counts.crossJoin(F.broadcast(cuts)).withColumn("piece", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    sizes = placed.groupBy("piece").agg(F.sum("n").alias("m"), F.first("total").alias("total"))  # at most as many rows as pieces
    sizes = sizes.withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy("total").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = {k: p * (F.col("total") - 1) for k, p in at.items()}
    holds = F.lit(False)
    for p in place.values():
        holds |= (F.col("before") <= F.ceil(p)) & (F.col("before") + F.col("m") > F.floor(p))
    inside = Window.partitionBy("piece").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.join(F.broadcast(sizes.where(holds).select("piece", "before")), "piece").withColumn("upto", F.col("before") + F.sum("n").over(inside))
    value = lambda k: F.max(F.when((F.col("upto") > k) & (F.col("upto") - F.col("n") <= k), F.col("v")))
    both = [value(edge(p)).alias(f"{k}_{edge.__name__}") for k, p in place.items() for edge in (F.floor, F.ceil)]
    one = rows.agg(F.max("total").alias("total"), *both)
    return one.select(*(((1 - (place[k] - F.floor(place[k]))) * F.col(f"{k}_floor") + (place[k] - F.floor(place[k])) * F.col(f"{k}_ceil")).alias(k) for k in at))


def _clear_times(per: DataFrame) -> DataFrame:
    """time_to_clear of counts (duration_min, n)."""
    d, n = F.col("duration_min"), F.col("n")
    timed = F.coalesce(F.sum(F.when(d.isNotNull(), n)), F.lit(0))
    share = lambda test: F.bround(100 * F.sum(F.when(test, n).otherwise(F.when(d.isNotNull(), 0))) / F.nullif(timed, F.lit(0)), 1)
    plain = per.agg(timed.alias("timed_episodes"), F.coalesce(F.sum(F.when(d.isNull(), n)), F.lit(0)).alias("untimed_episodes"), share(d > 1440).alias("over_24h_pct"), share(d < 1).alias("under_60s_pct"))
    found = quantiles(per.where(d.isNotNull()).groupBy(d.alias("v")).agg(F.sum("n").alias("n")), {"median_min": 0.5, "p90_min": 0.9})
    return plain.crossJoin(found).select("timed_episodes", "untimed_episodes", F.bround("median_min", 1).alias("median_min"), F.bround("p90_min", 1).alias("p90_min"), "over_24h_pct", "under_60s_pct")


def time_to_clear(episodes: DataFrame) -> DataFrame:
    """One row; only episodes whose raise and clear are both known are timed. The episodes are worked out once, as counts of durations."""
    return _clear_times(written(episodes.groupBy("duration_min").agg(F.count("*").alias("n"))))


def summary_kpis(alarms: DataFrame, episodes: DataFrame | None = None, top: int = 15) -> DataFrame:
    """All figures in one row of structs and arrays. Alarms are read once, for counts by window, zone and priority; episodes once, for counts of durations
    and the standing ones (at most one for each tag and level); all figures come from those two tables."""
    listed = lambda df, name, *order: F.array_sort(F.collect_list(F.struct(*order, *(c for c in df.columns if c not in order)))).alias(name)
    per = written(active(alarms).groupBy(F.when(F.col("ts").isNotNull(), floor_to("ts", 10)).alias("w"), "zone", "priority").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")))
    sums = F.sum("n").alias("n")
    mix = _mix(per.where("priority IS NOT NULL").groupBy("priority").agg(sums))
    high = F.bround(F.sum(F.when(F.col("priority").isin("CRITICAL", "HIGH"), F.col("pct"))), 1).alias("high_priority_share_pct")
    out = _rate(per.where("w IS NOT NULL").groupBy("w").agg(sums, F.min("lo").alias("lo"), F.max("hi").alias("hi")), 10).agg(F.first(F.struct("*")).alias("rate"))
    out = out.crossJoin(mix.agg(listed(mix, "priority_mix", "target_pct"), high)).withColumn("high_priority_target_pct", F.lit(schema.TARGET_MIX["CRITICAL"] + schema.TARGET_MIX["HIGH"]))
    if episodes is not None:
        own = F.when(F.col("standing"), F.struct("tag", "level", "priority", "start_ts", "description"))
        per_e = written(episodes.groupBy("duration_min", own.alias("own")).agg(F.count("*").alias("n"), F.max("start_ts").alias("last")))
        stands = per_e.where("own IS NOT NULL").select("own.*", F.explode(F.expr("sequence(1L, n)")).alias("copy")).drop("copy")
        lasting = _standing(stands, per_e.agg(F.max("last").alias("as_of")), top, schema.STANDING_HOURS)
        out = out.crossJoin(_clear_times(per_e.select("duration_min", "n")).select(F.struct("*").alias("time_to_clear")))
        out = out.crossJoin(per_e.agg(F.coalesce(F.sum(F.when(F.col("own").isNotNull(), F.col("n"))), F.lit(0)).alias("standing_alarm_count"))).crossJoin(lasting.agg(listed(lasting, "standing_alarms", "start_ts")))
    zones = _zones(per.where("zone IS NOT NULL AND w IS NOT NULL").groupBy("zone", "w").agg(sums), 10)
    return out.crossJoin(zones.agg(listed(zones, "zone_load", "zone")))


def summary(alarms: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row: totals, sources, the worst source and its share, floods, range, counts by priority."""
    a = active(alarms)
    by = a.where("priority IS NOT NULL").groupBy("priority").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("priority", "n")))).alias("by_priority"))
    one = a.agg(F.count("*").alias("total_alarms"), F.count_distinct("tag").alias("sources"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"))
    worst = bad_actors(alarms, 1).agg(F.first("tag").alias("bad_actor_tag"), F.coalesce(F.first("pct"), F.lit(0.0)).alias("bad_actor_share"))
    floods = _per_window(alarms, 10).agg(F.count_if(F.col("n") > schema.MANAGEABLE_PEAK).alias("flood_windows"))
    return one.crossJoin(by).crossJoin(incidents.agg(F.count("*").alias("incidents"))).crossJoin(worst).crossJoin(floods)


def tags_status(alarms: DataFrame, top: int | None = 60) -> DataFrame:
    out = active(alarms).groupBy("tag").agg(F.count("*").alias("alarm_count"), priority_of(F.max(severity(F.col("priority")))).alias("worst_priority"), F.max("ts").alias("last_ts"))
    return out if top is None else out.orderBy(F.desc("alarm_count"), "tag").limit(top)
