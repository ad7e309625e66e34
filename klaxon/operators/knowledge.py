"""Operator-confirmed history: confirmations, matching, recommendations, and the views over candidates and confirmations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import schema
from ..functions.alarms import lookup, signature
from .sessions import gathered, places

ZONE_BONUS = 0.15


def confirmation(signatures: DataFrame, ranked: DataFrame, *, cause: str | None = None, action: str = "", operator: str = "operator", correct: bool | None = None, at: str | None = None, confirmed_tag: str | None = None) -> DataFrame:
    """Rows for the history, one for each incident of `signatures`. The cause is the given one, else the first candidate's hint, else to
    investigate it. Whether the first pick was right is given, or it is compared with confirmed_tag (the first pick itself if null)."""
    top = ranked.where("rank = 1").select("incident_id", F.col("tag").alias("_top"), "hint")
    hint = F.coalesce(F.nullif("hint", F.lit("")), F.concat(F.lit("Investigate "), F.col("root_tag")))
    when = F.lit(at).cast("timestamp_ntz") if at else F.current_timestamp().cast("timestamp_ntz")
    right = F.lit(correct) if correct is not None else (F.col("_top") == F.coalesce(F.lit(confirmed_tag), F.col("_top")))
    return signatures.join(top, "incident_id").select(
        F.substring(F.sha1(F.concat_ws("|", "incident_id", when.cast("string"))), 1, 16).alias("id"),
        signature(F.col("root_tag"), F.col("alarm_types"), F.col("zone")).alias("signature"),
        "incident_id", "root_tag", "alarm_types", "zone",
        (F.lit(cause) if cause else hint).alias("confirmed_cause"),
        F.lit(action).alias("action_taken"), F.lit(operator).alias("operator"), right.alias("engine_top_pick_correct"), when.alias("confirmed_at"),
    )


def count_signature(history: DataFrame, key: str) -> DataFrame:
    return history.where(F.col("signature") == key).agg(F.count("*").alias("n"))


def match(signatures: DataFrame, history: DataFrame, min_overlap: float = 0.5) -> DataFrame:
    """The best confirmed case of each incident: same root tag, types that overlap by min_overlap, a bonus for the same zone (null equals
    null); of equal scores the newest. What is compared are shapes (root tag, types, zone): of the history the newest case of each,
    of the incidents each once. So a common root tag costs pairs of its shapes, and not of its incidents and confirmations."""
    kinds = F.array_join(F.array_sort(F.array_distinct("alarm_types")), "\x1f").alias("kinds")
    case = F.struct("confirmed_at", "id", "signature", "confirmed_cause", "action_taken", "operator")
    past = history.groupBy("root_tag", kinds, "zone").agg(F.max(case).alias("case"), F.first("alarm_types").alias("past_types"))
    past = past.select(F.col("root_tag").alias("past_tag"), F.col("zone").alias("past_zone"), "past_types", "case")
    shapes = signatures.groupBy("root_tag", kinds, "zone").agg(F.first("alarm_types").alias("alarm_types"))
    both = shapes.join(past, F.col("root_tag") == F.col("past_tag"))
    union = F.size(F.array_union("alarm_types", "past_types"))
    overlap = F.when(union > 0, F.size(F.array_intersect("alarm_types", "past_types")) / union).otherwise(0.0)
    both = both.withColumn("jaccard", overlap).where((F.col("jaccard") >= min_overlap) & (F.col("jaccard") > 0))
    both = both.withColumn("score", F.col("jaccard") + F.when(F.col("zone").eqNullSafe(F.col("past_zone")), ZONE_BONUS).otherwise(0.0))
    best = both.groupBy("root_tag", "kinds", "zone").agg(F.max(F.struct("score", "case")).alias("b"))
    seen = history.groupBy(F.col("signature").alias("seen_signature")).agg(F.count("*").alias("times_seen"))
    best = best.select(F.col("root_tag").alias("best_tag"), F.col("kinds").alias("best_kinds"), F.col("zone").alias("best_zone"), "b.score", "b.case.*").join(seen, F.col("signature") == F.col("seen_signature")).drop("signature")
    met = (F.col("root_tag") == F.col("best_tag")) & (F.col("kinds") == F.col("best_kinds")) & F.col("zone").eqNullSafe(F.col("best_zone"))
    return signatures.select("incident_id", "root_tag", kinds, "zone").join(best, met).select(
        "incident_id", "confirmed_cause", "action_taken", "operator", "confirmed_at", "times_seen", F.bround("score", 2).alias("match_strength")
    )


def newest(history: DataFrame, top: int | None = 100) -> DataFrame:
    return history if top is None else history.orderBy(F.desc("confirmed_at"), "id").limit(top)


def engine_accuracy(history: DataFrame) -> DataFrame:
    hits = F.count_if("engine_top_pick_correct")
    return history.agg(F.count("*").alias("confirmations"), hits.alias("top1_correct"), F.bround(hits / F.nullif(F.count("*"), F.lit(0)), 3).alias("accuracy"))


def stats(history: DataFrame) -> DataFrame:
    per = history.where("signature IS NOT NULL").groupBy("signature").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct_signatures"), F.count_if(F.col("n") > 1).alias("recurring"))


def recommend(ranked: DataFrame, *, chattering: DataFrame | None = None, co_occurrence: DataFrame | None = None, matches: DataFrame | None = None, standing: DataFrame | None = None, zones: DataFrame | None = None) -> DataFrame:
    """incident_id, place, priority, action, why, tags, source. The rules, in order: a confirmed case, the playbook, a chattering lead, partners
    that fire with it, and, if `standing` (tag, zone) and `zones` (incident_id, zone) are given, alarms that stand in its zone."""
    top = ranked.where("rank = 1").select("incident_id", "tag", "level", "explanation")
    spark_null = F.lit(None)
    if matches is not None:
        top = top.join(matches.select("incident_id", "confirmed_cause", "action_taken", "operator", "confirmed_at", "times_seen"), "incident_id", "left")
    else:
        top = top.withColumns({"confirmed_cause": spark_null.cast("string"), "action_taken": spark_null.cast("string"), "operator": spark_null.cast("string"), "confirmed_at": spark_null.cast("timestamp_ntz"), "times_seen": spark_null.cast("long")})
    if chattering is not None:
        first = chattering.groupBy("tag").agg(F.min_by("chatter_pct", F.struct((-F.col("chattering_events")).alias("d"), "level")).alias("chatter_pct"))
        top = top.join(first, "tag", "left")
    else:
        top = top.withColumn("chatter_pct", spark_null.cast("double"))
    if co_occurrence is not None:
        sides = co_occurrence.select(F.col("tag_a").alias("tag"), F.col("tag_b").alias("other"), "co_occurrences", "tag_a", "tag_b").unionByName(co_occurrence.select(F.col("tag_b").alias("tag"), F.col("tag_a").alias("other"), "co_occurrences", "tag_a", "tag_b"))
        w = Window.partitionBy("tag").orderBy(F.desc("co_occurrences"), "tag_a", "tag_b")
        strongest = sides.withColumn("k", F.row_number().over(w)).where("k <= 3").groupBy("tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "other"))), lambda x: x["other"]).alias("partners"))
        top = top.join(strongest, "tag", "left")
    else:
        top = top.withColumn("partners", spark_null.cast("array<string>"))
    if standing is not None and zones is not None:
        masks = standing.where("zone IS NOT NULL").groupBy("zone").agg(F.slice(F.array_sort(F.collect_set("tag")), 1, 2).alias("masks"))
        top = top.join(zones.select("incident_id", "zone"), "incident_id", "left").join(masks, "zone", "left")
    else:
        top = top.withColumns({"zone": spark_null.cast("string"), "masks": spark_null.cast("array<string>")})
    tag, known = F.col("tag"), F.col("times_seen").isNotNull()
    nonempty = lambda c: F.nullif(F.col(c), F.lit(""))
    rule = lambda on, priority, action, why, tags, source: F.when(on, F.struct(priority.alias("priority"), action.alias("action"), why.alias("why"), tags.alias("tags"), F.lit(source).alias("source")))
    says = lambda key, *between: F.concat(*(x for pair in zip(map(F.lit, schema.SAYS[key]), [*between, F.lit("")], strict=False) for x in pair))
    resolved = F.coalesce(says("resolved", nonempty("operator"), F.substring(F.col("confirmed_at").cast("string"), 1, 10)), F.lit("."))
    playbook = F.coalesce(lookup(F.col("level"), schema.ACTIONS), F.lit(schema.ACTIONS["GENERAL"]))
    rules = F.array(
        rule(known, F.lit(1), F.coalesce(nonempty("action_taken"), nonempty("confirmed_cause"), says("apply", tag)), F.concat(says("confirmed", F.col("times_seen").cast("string")), resolved), F.array(tag), "knowledge base"),
        rule(F.lit(True), F.when(known, 2).otherwise(1), F.concat(says("inspect", tag), playbook), F.coalesce(nonempty("explanation"), lookup(F.col("level"), schema.CAUSE_HINTS), says("ranked")), F.array(tag), "root-cause + playbook"),
        rule(F.col("chatter_pct").isNotNull(), F.lit(2), says("widen", tag), F.concat(tag, says("chatters", F.format_string("%.1f", "chatter_pct"))), F.array(tag), "chattering analysis"),
        rule(F.col("partners").isNotNull(), F.lit(3), says("check", F.array_join(F.slice("partners", 1, 2), ", "), tag), says("partners"), F.col("partners"), "co-occurrence"),
        rule(F.col("masks").isNotNull(), F.lit(3), says("clear", F.col("zone")), says("masks"), F.col("masks"), "standing alarms"),
    )
    out = top.select("incident_id", F.posexplode(rules).alias("ordinal", "r")).where("r IS NOT NULL").select("incident_id", "ordinal", "r.*")
    # At most five rows an incident: of equal actions the first by priority and rule.
    out = out.withColumn("k", F.row_number().over(Window.partitionBy("incident_id", "action").orderBy("priority", "ordinal"))).where("k = 1")
    place = F.row_number().over(Window.partitionBy("incident_id").orderBy("priority", "ordinal"))
    return out.select("incident_id", place.alias("place"), "priority", "action", "why", "tags", "source")


def answers(recommended: DataFrame, signatures: DataFrame, matches: DataFrame) -> DataFrame:
    """One row for each incident: incident_id, signature (root_tag, alarm_types, zone), known_case, recommendations (at most five)."""
    listed = recommended.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("place", "priority", "action", "why", "tags", "source"))).alias("recommendations"))
    known = matches.select("incident_id", F.lit(True).alias("known"))
    shape = F.struct("root_tag", "alarm_types", "zone").alias("signature")
    return listed.join(signatures.select("incident_id", shape), "incident_id", "left").join(known, "incident_id", "left").select("incident_id", "signature", F.coalesce("known", F.lit(False)).alias("known_case"), "recommendations")


def incident_tables(rows: DataFrame, ranked: DataFrame, found: DataFrame, unit: str | None = None) -> dict[str, DataFrame]:
    """The rows that a newly found set of incidents adds to the tables incidents, incident_alarms and candidates."""
    return {
        "incidents": found.select("incident_id", F.col("start_ts").alias("started_at"), F.col("end_ts").alias("ended_at"), F.lit(unit).cast("string").alias("unit"), "alarm_count", F.lit("open").alias("status")),
        "incident_alarms": places(rows, "incident_id", "sequence_rank").select("incident_id", "tag", "description", "priority", F.col("ts").alias("occurred_at"), "sequence_rank"),
        "candidates": candidates_table(ranked).withColumnRenamed("candidate_tag", "tag"),
    }


def with_json_types(history: DataFrame) -> DataFrame:
    """history with alarm_types as JSON text, as it is exported."""
    return history.withColumn("alarm_types", F.to_json("alarm_types"))


def candidates_table(ranked: DataFrame, method: str = "initiation-rate") -> DataFrame:
    """The ranked rows as a candidates table, with the method that made them."""
    return ranked.select("incident_id", "rank", F.col("tag").alias("candidate_tag"), "confidence", "explanation", F.lit(method).alias("method"))


def accuracy_parts(history: DataFrame, candidates: DataFrame) -> DataFrame:
    """day, method, correct_count, total_count of confirmations joined with the first candidates."""
    both = history.join(candidates.where("rank = 1").select("incident_id", "method"), "incident_id")
    day = F.date_trunc("day", "confirmed_at").cast("timestamp_ntz")
    return both.groupBy(day.alias("day"), "method").agg(F.count_if("engine_top_pick_correct").alias("correct_count"), F.count("*").alias("total_count"))


def accuracy_of_parts(parts: DataFrame) -> DataFrame:
    """day, method, correct_count, total_count, accuracy_pct of sums that add up."""
    right, total = F.sum("correct_count"), F.sum("total_count")
    return parts.groupBy("day", "method").agg(right.alias("correct_count"), total.alias("total_count"), F.bround(100.0 * right / F.nullif(total, F.lit(0)), 1).alias("accuracy_pct"))


def accuracy_by_day(history: DataFrame, candidates: DataFrame) -> DataFrame:
    """day, method, correct_count, total_count, accuracy_pct of confirmations joined with the first candidates."""
    parts = accuracy_parts(history, candidates)
    return parts.withColumn("accuracy_pct", F.bround(100.0 * F.col("correct_count") / F.nullif("total_count", F.lit(0)), 1))


def recent_accuracy(by_day: DataFrame, days: int = 30, now: str | None = None) -> DataFrame:
    today = F.lit(now).cast("timestamp_ntz") if now else F.current_timestamp().cast("timestamp_ntz")
    return by_day.where(F.col("day") >= today - F.expr(f"INTERVAL {days} DAYS"))


def incident_status(found: DataFrame, history: DataFrame) -> DataFrame:
    """incidents with status: confirmed once there is a confirmation, else open."""
    done = history.select("incident_id").distinct().withColumn("_done", F.lit(True))
    return found.join(done, "incident_id", "left").withColumn("status", F.when(F.col("_done"), "confirmed").otherwise("open")).drop("_done")


def incident_detail(found: DataFrame, rows: DataFrame, ranked: DataFrame, history: DataFrame, alarm: Column | None = None) -> DataFrame:
    """incidents with arrays of their alarms, candidates and confirmations. An incident's rows are gathered, so ask for few, and of long
    incidents only for what is needed of an alarm: `alarm`, by default a struct of ts, seq, tag, level and priority."""
    nest = lambda df, name, order: df.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in df.columns if c not in (*order, "incident_id"))))).alias(name))
    some = found.select("incident_id")
    pick = lambda df, *columns: df.select("incident_id", *columns).join(some, "incident_id", "left_semi")
    item = F.struct("ts", "seq", "tag", "level", "priority") if alarm is None else alarm
    out = found.join(gathered(pick(rows, "ts", "seq", "tag", "level", "priority"), "incident_id", item, "alarms"), "incident_id", "left")
    out = out.join(nest(pick(ranked, "rank", "tag", "confidence"), "candidates", ["rank"]), "incident_id", "left")
    return out.join(nest(pick(history, "confirmed_at", "id", "confirmed_cause"), "confirmations", ["confirmed_at", "id"]), "incident_id", "left")
