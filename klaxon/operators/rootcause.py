"""Incidents, initiation rates, ranked candidates, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import schema
from ..functions.alarms import active, lookup, minutes, plain_number, severity, signature, whole_percent
from .sessions import gap_sessions, numbered

PRIOR_STRENGTH = 5.0


def segment_incidents(alarms: DataFrame, gap_min: float = 15, min_alarms: int = 3, min_tags: int = 2, priorities: tuple[str, ...] = ("CRITICAL", "HIGH")) -> DataFrame:
    """The ACTIVE alarms with incident_id, INC-00000 and on in time order; null outside of qualifying sessions."""
    rows = gap_sessions(active(alarms).drop("incident_id"), gap_min, buckets=True)
    # Rows meet their session's number by session and bucket of time: one session can hold half of all alarms.
    parts = rows.groupBy("session", "_bucket", "tag").agg(F.count("*").alias("n"), F.max(F.col("priority").isin(*priorities)).alias("sig"))
    stats = parts.groupBy("session").agg(F.sum("n").alias("n"), F.count_distinct("tag").alias("tags"), F.max("sig").alias("sig"))
    ok = numbered(stats.where((F.col("n") >= min_alarms) & (F.col("tags") >= min_tags) & F.col("sig")).select("session"), "session")
    ok = ok.select("session", F.format_string("INC-%05d", "number").alias("incident_id"))
    named = parts.select("session", "_bucket").distinct().join(ok, "session")
    return rows.join(named, ["session", "_bucket"], "left").drop("session", "_bucket")


def labelled(alarms: DataFrame, **segment) -> DataFrame:
    """ACTIVE alarms of incidents: those given, if any alarm has one, else those found."""
    if "incident_id" in alarms.columns:
        given = active(alarms).where("incident_id IS NOT NULL")
        if not given.isEmpty():
            return given
    return segment_incidents(alarms, **segment).where("incident_id IS NOT NULL")


def stable_ids(rows: DataFrame) -> DataFrame:
    """Labelled alarms with incident_id from the time of the incident's first alarm. Incidents of one stream lie apart in time, so the ids are unique, and
    earlier or later data, which renumber INC-00000 and on, leave them as they are."""
    # Rows meet their new id by incident and day, as one incident can hold half of all alarms.
    days = rows.groupBy("incident_id", F.to_date("ts").alias("_day")).agg(F.min("ts").alias("_first"))
    first = days.groupBy("incident_id").agg(F.min("_first").alias("_first"))
    named = first.select("incident_id", F.date_format("_first", "'INC-'yyyyMMdd'T'HHmmssSSSSSS").alias("_stable"))
    by_day = days.select(F.col("incident_id").alias("_of"), F.col("_day").alias("_on")).join(named.withColumnRenamed("incident_id", "_of"), "_of")
    met = (F.col("incident_id") == F.col("_of")) & F.to_date("ts").eqNullSafe(F.col("_on"))
    return rows.join(by_day, met).withColumn("incident_id", F.col("_stable")).drop("_stable", "_of", "_on")


def known_incidents(found: DataFrame, known: DataFrame) -> DataFrame:
    """incident_id, known_id: incidents of `found` (incident_id, start_ts, end_ts) that share time with one of `known` (incident_id, started_at, ended_at);
    of several the earliest. Intervals meet by the days that they touch."""
    days = lambda a, b: F.explode(F.sequence(F.to_date(a), F.to_date(b))).alias("day")
    new = found.select("incident_id", "start_ts", "end_ts", days("start_ts", "end_ts"))
    old = known.select(F.col("incident_id").alias("known_id"), "started_at", "ended_at", days("started_at", "ended_at"))
    met = new.join(old, "day").where((F.col("start_ts") <= F.col("ended_at")) & (F.col("started_at") <= F.col("end_ts")))
    return met.groupBy("incident_id").agg(F.min_by("known_id", F.struct("started_at", "known_id")).alias("known_id"))


def incidents(rows: DataFrame) -> DataFrame:
    """One row for each incident of labelled alarms."""
    worst = F.min_by(F.struct("priority", "zone"), F.struct(-severity(F.col("priority")), "ts", "seq")).alias("worst")
    out = rows.groupBy("incident_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("alarm_count"), F.count_distinct("tag").alias("tags"), worst)
    return out.select("incident_id", "start_ts", "end_ts", "alarm_count", "tags", F.col("worst.priority").alias("top_priority"), F.col("worst.zone").alias("zone"), F.bround(minutes("start_ts", "end_ts"), 1).alias("duration_min"))


def _firsts(rows: DataFrame) -> DataFrame:
    """The first alarm of each (incident, tag), with the incident's bounds over those."""
    first = rows.groupBy("incident_id", "tag").agg(F.min_by(F.struct("ts", "level", "priority"), F.struct("ts", "seq")).alias("f"))
    first = first.select("incident_id", "tag", F.col("f.ts").alias("first_ts"), F.col("f.level").alias("level"), F.col("f.priority").alias("priority"))
    bounds = first.groupBy("incident_id").agg(F.min("first_ts").alias("t0"), F.max("first_ts").alias("t1"))
    return first.join(bounds, "incident_id")


def _rates(first: DataFrame) -> DataFrame:
    rates = first.groupBy("tag").agg(F.count("*").alias("appearances"), F.count_if(F.col("first_ts") == F.col("t0")).alias("initiations"))
    base = rates.agg((F.sum("initiations") / F.greatest(F.sum("appearances"), F.lit(1))).alias("base"))
    smoothed = (F.col("initiations") + PRIOR_STRENGTH * F.col("base")) / (F.col("appearances") + PRIOR_STRENGTH)
    return rates.crossJoin(F.broadcast(base)).select("tag", "appearances", "initiations", F.bround(F.col("initiations") / F.col("appearances"), 3).alias("initiation_rate"), F.bround(smoothed, 3).alias("initiation_rate_smoothed"))


def initiation_rates(rows: DataFrame) -> DataFrame:
    """How often a tag opens an incident that it appears in; all tags tied at an incident's first instant open it."""
    return _rates(_firsts(rows))


def rank_candidates(rows: DataFrame, top_per_incident: int = 6) -> DataFrame:
    """Tags of each incident by confidence, first alarm, name. The window holds a row for each tag of an incident."""
    first = _firsts(rows)
    ranked = first.join(_rates(first), "tag", "left")
    span = F.expr("timestampdiff(MICROSECOND, t0, t1)")
    lead = F.expr("timestampdiff(MICROSECOND, t0, first_ts)")
    share = F.when(span > 0, 1 - lead / span).otherwise(1.0)
    ranked = ranked.withColumns({"lead_min": F.bround(lead / 6e7, 1), "confidence": F.bround(0.6 * F.col("initiation_rate_smoothed") + 0.4 * share, 3)})
    w = Window.partitionBy("incident_id").orderBy(F.desc("confidence"), "first_ts", "tag")
    fired = F.when(F.col("lead_min") == 0, "first").otherwise(F.concat(plain_number(F.col("lead_min")), F.lit(" min into the incident")))
    text = F.concat(F.lit("fired "), fired, F.lit("; opens "), whole_percent(F.col("initiation_rate")), F.lit(" of the "), F.col("appearances").cast("string"), F.lit(" incidents it appears in"))
    return (
        ranked.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= top_per_incident)
        .select("incident_id", "rank", "tag", "level", "priority", "first_ts", "lead_min", "initiation_rate", "confidence", text.alias("explanation"), lookup(F.col("level"), schema.CAUSE_HINTS).alias("hint"))
    )


def cause_hints(ranked: DataFrame) -> DataFrame:
    """tag, hint of the first candidates; the last incident of a tag counts."""
    hint = F.coalesce(F.nullif("hint", F.lit("")), F.concat(F.lit("Investigate "), F.col("tag")))
    return ranked.where("rank = 1").groupBy("tag").agg(F.max_by(hint, "incident_id").alias("hint"))


def largest(found: DataFrame, top: int = 40) -> DataFrame:
    return found.orderBy(F.desc("alarm_count"), "incident_id").limit(top)


def of_largest(ranked: DataFrame, found: DataFrame, top: int = 40) -> DataFrame:
    return ranked.join(largest(found, top).select("incident_id"), "incident_id", "left_semi")


def signatures(ranked: DataFrame, found: DataFrame) -> DataFrame:
    """incident_id, root_tag, alarm_types, zone, signature, from the ranked rows."""
    out = ranked.groupBy("incident_id").agg(F.min_by("tag", "rank").alias("root_tag"), F.array_sort(F.collect_set("level")).alias("alarm_types"))
    out = out.join(found.select("incident_id", "zone"), "incident_id", "left")
    return out.withColumn("signature", signature(F.col("root_tag"), F.col("alarm_types"), F.col("zone")))


def validate(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """incidents, top1_correct, accuracy of the first candidates against truth (incident_id, root_tag)."""
    top = ranked.where("rank = 1").join(truth.select("incident_id", F.col("root_tag").alias("true_tag")), "incident_id", "left")
    hit = F.count_if(F.col("tag") == F.col("true_tag"))
    return top.agg(F.count("*").alias("incidents"), hit.alias("top1_correct"), F.coalesce(F.bround(hit / F.nullif(F.count("*"), F.lit(0)), 3), F.lit(0.0)).alias("accuracy"))
