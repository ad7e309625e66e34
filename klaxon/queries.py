"""The driver's queries over `events`, seen as an alarm log, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions.alarms import classify_type, map_priority, zone_of
from .operators import analysis, knowledge, kpis, prepare, rootcause
from .sources import alarm_log as log_source
from .sources.alarm_log import AlarmLog
from .sources.base import Historian, scratch_folder, written
from .sources.store import ParquetStore
from .sources.synthetic import SyntheticPlant

GAP = 5


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as alarms and transitions of one frame. The minute is the log's resolution."""
    e = F.col("event_type")
    return events(spark, sf_dir).select(
        F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("seq"),
        F.format_string("U-%03d", F.col("user_id") % 20).alias("tag"), F.upper(e).alias("level"),
        F.when(e == "error", "CRITICAL").when(e == "purchase", "HIGH").when(e == "signup", "MEDIUM").otherwise("LOW").alias("priority"),
        F.when(F.col("event_id") % 4 == 3, "CLEARED").otherwise("ACTIVE").alias("state"), "value",
        F.concat(F.lit("Z-"), (F.col("user_id") % 7).cast("string")).alias("zone"),
        F.when(F.col("event_id") % 5 == 0, "N2A").when(F.col("event_id") % 5 == 1, "A2A").otherwise("A2N").alias("transition"), e.alias("description"),
    )


_AL = """
al AS (SELECT date_trunc('minute', ts)::TIMESTAMP AS ts, event_id AS seq, printf('U-%03d', user_id % 20) AS tag, upper(event_type) AS level,
  CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'signup' THEN 'MEDIUM' ELSE 'LOW' END AS priority,
  CASE WHEN event_id % 4 = 3 THEN 'CLEARED' ELSE 'ACTIVE' END AS state, value, 'Z-' || (user_id % 7) AS zone,
  CASE event_id % 5 WHEN 0 THEN 'N2A' WHEN 1 THEN 'A2A' ELSE 'A2N' END AS transition, event_type AS description FROM events),
a AS (SELECT *, CASE priority WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS sev FROM al WHERE state = 'ACTIVE')"""


def _floor(minutes: int) -> str:
    return f"to_timestamp(epoch_us(ts) // {minutes * 60_000_000} * {minutes * 60}) AT TIME ZONE 'UTC'"


_EP = """
n AS (SELECT *, lag(transition) OVER w AS p, lead(transition) OVER w AS nx, lead(ts) OVER w AS nts FROM al WINDOW w AS (PARTITION BY tag, level ORDER BY ts, seq)),
m AS (SELECT *, transition IN ('N2A', 'A2A') AS raises, transition = 'A2N' AND coalesce(p = 'A2N', true) AS implicit FROM n),
ep AS (SELECT tag, level, priority, zone, description, ts AS start_ts, CASE WHEN implicit THEN ts ELSE nts END AS end_ts,
  CASE WHEN implicit OR nx IS NULL THEN NULL ELSE (epoch_us(nts) - epoch_us(ts)) / 6e7 END AS duration_min, implicit, raises AND nx IS NULL AS standing
  FROM m WHERE (raises AND coalesce(nx <> 'N2A', true)) OR implicit)"""


def _sessions(minutes: int) -> str:
    return f"""
s AS (SELECT *, sum(brk) OVER (ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS ep FROM (
  SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, seq) > {minutes * 60_000_000} THEN 1 ELSE 0 END AS brk FROM a))"""


_INC = f"""{_AL}, {_sessions(GAP)},
ids AS (SELECT ep, printf('INC-%05d', row_number() OVER (ORDER BY ep) - 1) AS incident_id FROM s GROUP BY ep
  HAVING count(*) >= 3 AND count(DISTINCT tag) >= 2 AND bool_or(priority IN ('CRITICAL', 'HIGH'))),
lab AS (SELECT s.*, incident_id FROM s JOIN ids USING (ep)),
inc AS (SELECT incident_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS alarm_count, count(DISTINCT tag) AS tags,
  arg_min(priority, row(-sev, ts, seq)) AS top_priority, arg_min(zone, row(-sev, ts, seq)) AS zone, round_even((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7, 1) AS duration_min FROM lab GROUP BY 1)"""
_RATES = f"""{_INC},
f0 AS (SELECT incident_id, tag, min(ts) AS first_ts, arg_min(level, row(ts, seq)) AS level, arg_min(priority, row(ts, seq)) AS priority FROM lab GROUP BY 1, 2),
f AS (SELECT *, min(first_ts) OVER (PARTITION BY incident_id) AS t0, max(first_ts) OVER (PARTITION BY incident_id) AS t1 FROM f0),
r0 AS (SELECT tag, count(*) AS appearances, count(*) FILTER (first_ts = t0) AS initiations FROM f GROUP BY tag),
rates AS (SELECT *, round_even(initiations / appearances, 3) AS initiation_rate,
  round_even((initiations + 5.0::DOUBLE * (SELECT sum(initiations)::BIGINT / sum(appearances)::BIGINT FROM r0)) / (appearances + 5.0::DOUBLE), 3) AS initiation_rate_smoothed FROM r0)"""
_RANKED = f"""{_RATES},
c AS (SELECT f.*, appearances, initiation_rate, epoch_us(first_ts) - epoch_us(t0) AS lead_us, epoch_us(t1) - epoch_us(t0) AS span, initiation_rate_smoothed AS sm FROM f JOIN rates USING (tag)),
d AS (SELECT *, round_even(lead_us / 6e7, 1) AS lead_min, round_even(0.6::DOUBLE * sm + 0.4::DOUBLE * CASE WHEN span > 0 THEN 1 - lead_us / span ELSE 1 END, 3) AS confidence FROM c),
ranked AS (SELECT incident_id, row_number() OVER (PARTITION BY incident_id ORDER BY confidence DESC, first_ts, tag)::INTEGER AS rank, tag, level, priority, first_ts, lead_min, initiation_rate, confidence,
  'fired ' || CASE WHEN lead_min = 0 THEN 'first' ELSE regexp_replace(printf('%.1f', lead_min), '\\.0$', '') || ' min into the incident' END || '; opens ' ||
  round_even(initiation_rate * 100, 0)::INTEGER || '% of the ' || appearances || ' incidents it appears in' AS explanation, NULL::VARCHAR AS hint FROM d QUALIFY rank <= 6)"""
_SIG = f"""{_RANKED},
sig0 AS (SELECT incident_id, arg_min(tag, rank) AS root_tag, list_sort(list(DISTINCT level)) AS alarm_types FROM ranked GROUP BY 1),
sig AS (SELECT sig0.*, zone, substr(sha1(root_tag || '|' || array_to_string(alarm_types, ',') || '|' || coalesce(zone, '')), 1, 16) AS signature FROM sig0 LEFT JOIN inc USING (incident_id))"""
_KB = f"""{_SIG},
kb AS (SELECT substr(sha1(incident_id), 1, 16) AS id, signature, incident_id, root_tag, alarm_types, sig.zone, 'Investigate ' || root_tag AS confirmed_cause,
  CASE WHEN num % 3 = 0 THEN 'Reset ' || root_tag ELSE '' END AS action_taken, 'op-' || (num % 3) AS operator, num % 4 <> 2 AS engine_top_pick_correct, start_ts AS confirmed_at
  FROM (SELECT *, substr(incident_id, 5)::BIGINT AS num FROM sig) sig JOIN (SELECT incident_id, start_ts FROM inc) USING (incident_id) WHERE num % 2 = 0),
seen AS (SELECT signature, count(*) AS times_seen FROM kb GROUP BY 1),
mt0 AS (SELECT sig.incident_id, kb.*, len(list_intersect(sig.alarm_types, kb.alarm_types)) / len(list_distinct(list_concat(sig.alarm_types, kb.alarm_types))) AS jac, sig.zone IS NOT DISTINCT FROM kb.zone AS same FROM sig JOIN kb ON sig.root_tag = kb.root_tag),
mt AS (SELECT incident_id, confirmed_cause, action_taken, operator, confirmed_at, times_seen, round_even(score, 2) AS match_strength FROM
  (SELECT *, jac + CASE WHEN same THEN 0.15::DOUBLE ELSE 0 END AS score FROM mt0 WHERE jac >= 0.5) JOIN seen USING (signature) QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY score DESC, confirmed_at DESC, id DESC) = 1)"""


def _chatter(seconds: int) -> str:
    return f"""
ch0 AS (SELECT tag, level, count(*) OVER (PARTITION BY tag, level ORDER BY epoch_us(ts) RANGE BETWEEN CURRENT ROW AND {seconds * 1_000_000} FOLLOWING)
  - (row_number() OVER (PARTITION BY tag, level ORDER BY ts, seq) - rank() OVER (PARTITION BY tag, level ORDER BY ts)) AS ahead FROM a),
chat AS (SELECT tag, level, count(*) AS activations, count(*) FILTER (ahead >= 3) AS chattering_events, round_even(100 * count(*) FILTER (ahead >= 3) / count(*), 1) AS chatter_pct FROM ch0 GROUP BY 1, 2 HAVING count(*) FILTER (ahead >= 3) > 0)"""


_PAIRS = """
o AS (SELECT *, row_number() OVER (ORDER BY ts, seq) AS i FROM a),
pairs AS (SELECT least(x.tag, y.tag) AS tag_a, greatest(x.tag, y.tag) AS tag_b, count(*) AS co_occurrences FROM o x JOIN o y
  ON y.i > x.i AND y.i <= x.i + 40 AND x.tag <> y.tag AND epoch_us(y.ts) - epoch_us(x.ts) <= 900000000 GROUP BY 1, 2 HAVING count(*) >= 3)"""

_MESSAGES = ["Gas leak zone 2", "Water leak", "Pump TRIP ALARM", "Panel trouble", "Door open", "Device offline", "BACnet error 12", "Space temp dev", "Set point moved", "High discharge temp", "Temp too low", "RA temp dev", "Supply fan stop", "Chiller start", "Point in manual mode", "Meter reading", "Battery test", "Extra temp", "plain text", ""]
_SEVERITIES = ["1 - High", "2 - Medium", "3 - Low", "Central Battery System-Medium", "x"]
_CLASSES = ["LifeSafety", "HVAC-High", "Other", ""]
_ASSETS = ["1-JK1-JK1-00-D.01-AC", "A-B", "", "X", "2-K-L-07", "-"]


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def _sql_text(value: str) -> str:
    """A literal; tabs and line ends are written by their codes."""
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


def _sql_pick(values: list[str], index: str) -> str:
    return f"[{', '.join(map(_sql_text, values))}][{index} % {len(values)} + 1]"


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as rows of the CSV export."""
    i, u = F.col("event_id"), F.col("user_id")
    made = {
        "DateTime": F.when(i % 50 == 0, "bad").otherwise(F.date_format("ts", "dd-MM-yyyy HH:mm")), "AssetID": F.nullif(_pick(_ASSETS, u), F.lit("-")),
        "AlarmSeverityName": _pick(_SEVERITIES, u), "State": _pick([" n2a", "A2A ", "A2N", "?"], i), "TransactionMessage": F.lit("fallback error"),
        "Stage": F.lit(None).cast("string"), "AlarmClassName": _pick(_CLASSES, i), "ProcessedMessage": F.nullif(_pick(_MESSAGES, i), F.lit("")),
    }
    return events(spark, sf_dir).select(i.alias("seq"), *(c.alias(k) for k, c in made.items()))


def _sql_type(m: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({m}), '{p}') THEN '{code}'" for code, p in schema.TYPE_PATTERNS) + " ELSE 'GENERAL' END"


_RAW = f"""
raw AS (SELECT event_id AS seq, CASE WHEN event_id % 50 = 0 THEN NULL ELSE date_trunc('minute', ts)::TIMESTAMP END AS ts, coalesce(nullif(nullif({_sql_pick(_ASSETS, "user_id")}, '-'), ''), 'UNKNOWN-ASSET') AS tag,
  trim(upper({_sql_pick([" n2a", "A2A ", "A2N", "?"], "event_id")})) AS transition, coalesce(nullif({_sql_pick(_MESSAGES, "event_id")}, ''), 'fallback error') AS message,
  {_sql_pick(_SEVERITIES, "user_id")} AS severity, {_sql_pick(_CLASSES, "event_id")} AS alarm_class FROM events),
lv AS (SELECT *, {_sql_type("message")} AS level FROM raw),
log AS (SELECT ts, seq, tag, transition, message, severity, alarm_class, 'Unknown' AS stage, level,
  CASE WHEN lower(alarm_class) = 'lifesafety' OR level IN ('GAS', 'TRIP', 'FIRE_SUPERVISORY') THEN 'CRITICAL'
    WHEN lower(severity) = '1 - high' THEN 'HIGH' WHEN lower(severity) IN ('2 - medium', 'central battery system-medium') THEN 'MEDIUM' WHEN lower(severity) = '3 - low' THEN 'LOW'
    WHEN lower(alarm_class) LIKE '%-high' THEN 'HIGH' ELSE 'LOW' END AS priority,
  CASE WHEN len(string_split(tag, '-')) >= 4 THEN string_split(tag, '-')[2] || '-' || string_split(tag, '-')[4] ELSE string_split(tag, '-')[1] END AS zone, substr(message, 1, 120) AS description
  FROM lv)"""

_made: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def keep(f):
        _made[f.__name__] = (f, sql)
        return f

    return keep


def _labelled(spark, sf_dir, a: DataFrame | None = None):
    return rootcause.segment_incidents(alarms(spark, sf_dir) if a is None else a, GAP).where("incident_id IS NOT NULL")


def _ranked(spark, sf_dir, a: DataFrame | None = None):
    """Labelled alarms, candidates and incidents. Several parts of a query build on the first, which is written as a table once: kept in
    the cache instead, its plan would be part of every plan over it."""
    rows = written(_labelled(spark, sf_dir, a))
    return rows, rootcause.rank_candidates(rows), rootcause.incidents(rows)


def _history(spark, sf_dir):
    """Confirmations of every second incident, from the incidents themselves."""
    rows, ranked, found = _ranked(spark, sf_dir)
    ranked, found = written(ranked), written(found)
    sig = written(rootcause.signatures(ranked, found))
    num = F.substring("incident_id", 5, 20).cast("long")
    kb = sig.join(found.select("incident_id", "start_ts"), "incident_id").where(num % 2 == 0).select(
        F.substring(F.sha1("incident_id"), 1, 16).alias("id"), "signature", "incident_id", "root_tag", "alarm_types", "zone", F.concat(F.lit("Investigate "), F.col("root_tag")).alias("confirmed_cause"),
        F.when(num % 3 == 0, F.concat(F.lit("Reset "), F.col("root_tag"))).otherwise("").alias("action_taken"), F.concat(F.lit("op-"), (num % 3).cast("string")).alias("operator"), (num % 4 != 2).alias("engine_top_pick_correct"), F.col("start_ts").alias("confirmed_at"),
    )
    return rows, ranked, found, sig, kb


@query(f"WITH {_AL} SELECT tag, alarm_count, pct, round_even(sum(pct) OVER (ORDER BY alarm_count DESC, tag ROWS UNBOUNDED PRECEDING), 1) AS cum_pct, worst_priority, top_level FROM (SELECT tag, count(*) AS alarm_count, round_even(100 * count(*) / sum(count(*)) OVER ()::BIGINT, 1) AS pct, arg_max(priority, row(sev, priority)) AS worst_priority FROM a GROUP BY tag) JOIN (SELECT tag, level AS top_level FROM (SELECT tag, level, count(*) AS n FROM a GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY tag ORDER BY n DESC, level) = 1) USING (tag) ORDER BY alarm_count DESC, tag LIMIT 10")
def bad_actors(spark, sf_dir):
    return analysis.bad_actors(alarms(spark, sf_dir))


@query(f"WITH {_AL}, {_chatter(3600)} SELECT * FROM chat ORDER BY chattering_events DESC, tag, level LIMIT 25")
def chattering(spark, sf_dir):
    return analysis.chattering(alarms(spark, sf_dir), 3600)


@query(f"WITH {_AL}, p AS (SELECT {_floor(60)} AS window_start, priority, sev, count(*) AS n FROM a GROUP BY 1, 2, 3) SELECT window_start, sum(n)::BIGINT AS alarm_count, arg_max(priority, row(n, sev, priority)) AS top_priority FROM p GROUP BY 1 HAVING sum(n) > 10")
def alarm_floods(spark, sf_dir):
    return analysis.alarm_floods(alarms(spark, sf_dir), 60, 10)


@query(f"WITH {_AL}, {_PAIRS} SELECT * FROM pairs ORDER BY co_occurrences DESC, tag_a, tag_b LIMIT 40")
def co_occurrence(spark, sf_dir):
    return analysis.co_occurrence(alarms(spark, sf_dir))


@query(f"""WITH {_AL}, {_sessions(3)}, u AS (SELECT *, max(CASE WHEN priority = 'CRITICAL' THEN row(ts, seq) END) OVER (PARTITION BY ep) AS cut FROM s),
st AS (SELECT *, tag || ':' || level AS step, lag(tag || ':' || level) OVER (PARTITION BY ep ORDER BY ts, seq) AS before FROM u WHERE cut IS NOT NULL AND row(ts, seq) <= cut),
k AS (SELECT * FROM st WHERE before IS NULL OR before <> step QUALIFY row_number() OVER (PARTITION BY ep ORDER BY ts DESC, seq DESC) <= 5),
q AS (SELECT string_agg(step, ' -> ' ORDER BY ts, seq) AS sequence FROM k GROUP BY ep HAVING count(*) >= 2) SELECT sequence, count(*) AS occurrences FROM q GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")
def pre_incident_sequences(spark, sf_dir):
    return analysis.pre_incident_sequences(alarms(spark, sf_dir), gap_min=3)


@query(f"""WITH {_AL}, w AS (SELECT {_floor(10)} AS w, count(*) AS n FROM a GROUP BY 1), t AS (SELECT count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7 / 10, 1.0) AS rate FROM a)
SELECT 10 AS window_min, round_even(rate, 2) AS avg_per_window, round_even(avg(n), 2) AS avg_per_window_when_active, max(n) AS peak_per_window, count(*) AS active_windows, count(*) FILTER (n > 10) AS flood_windows, round_even(100 * count(*) FILTER (n > 10) / count(*), 1) AS flood_share_of_active_pct,
CASE WHEN rate <= 1 THEN 'within EEMUA target' WHEN rate <= 10 THEN 'above target, still manageable' ELSE 'unacceptable per EEMUA-191' END AS eemua_verdict, 1.0::DOUBLE AS target_per_window FROM w, t GROUP BY rate""")
def alarm_rate(spark, sf_dir):
    return kpis.alarm_rate(alarms(spark, sf_dir))


_MIX = """mix AS (SELECT priority, count(a.seq) AS alarm_count, round_even(100 * count(a.seq) / (SELECT count(*) FROM a), 1) AS pct, target_pct, round_even(100 * count(a.seq) / (SELECT count(*) FROM a) - target_pct, 1) AS delta_pct
FROM (VALUES ('CRITICAL', 1.0::DOUBLE), ('HIGH', 4.0::DOUBLE), ('MEDIUM', 15.0::DOUBLE), ('LOW', 80.0::DOUBLE)) t(priority, target_pct) LEFT JOIN a USING (priority) GROUP BY 1, 4)"""


@query(f"WITH {_AL}, {_MIX} SELECT * FROM mix")
def priority_distribution(spark, sf_dir):
    return kpis.priority_distribution(alarms(spark, sf_dir))


_ZONES = f"z AS (SELECT zone, sum(n)::BIGINT AS alarm_count, max(n) AS peak_per_window, count(*) AS active_windows, max(n) > 10 AS over_manageable_peak FROM (SELECT zone, {_floor(10)} AS w, count(*) AS n FROM a GROUP BY 1, 2) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)"


@query(f"WITH {_AL}, {_ZONES} SELECT * FROM z")
def zone_load(spark, sf_dir):
    return kpis.zone_load(alarms(spark, sf_dir))


_STANDING = "sa AS (SELECT tag, level, priority, start_ts, round_even((epoch_us((SELECT max(start_ts) FROM ep)) - epoch_us(start_ts)) / 6e7 / 1440, 1) AS days_standing, description FROM ep WHERE standing)"


@query(f"WITH {_AL}, {_EP}, {_STANDING} SELECT * FROM sa WHERE days_standing >= 0.01 ORDER BY days_standing DESC, start_ts, tag, level LIMIT 15")
def standing_alarms(spark, sf_dir):
    return kpis.standing_alarms(prepare.episodes(alarms(spark, sf_dir)), hours=0.24)


_TTC = "SELECT count(duration_min) AS timed_episodes, count(*) - count(duration_min) AS untimed_episodes, round_even(quantile_cont(duration_min, 0.5), 1) AS median_min, round_even(quantile_cont(duration_min, 0.9), 1) AS p90_min, round_even(100 * avg((duration_min > 1440)::INT), 1) AS over_24h_pct, round_even(100 * avg((duration_min < 1)::INT), 1) AS under_60s_pct FROM ep"


@query(f"WITH {_AL}, {_EP} {_TTC}")
def time_to_clear(spark, sf_dir):
    return kpis.time_to_clear(prepare.episodes(alarms(spark, sf_dir)))


@query(f"""WITH {_AL}, {_EP}, {_MIX}, {_ZONES}, t AS ({_TTC}), w AS (SELECT count(*) AS n FROM a GROUP BY {_floor(10)})
SELECT (SELECT max(n) FROM w) AS peak, round_even((SELECT sum(pct) FROM mix WHERE priority IN ('CRITICAL', 'HIGH')), 1) AS high_priority_share_pct, 5.0::DOUBLE AS high_priority_target_pct, t.median_min, (SELECT count(*) FROM ep WHERE standing) AS standing_alarm_count, (SELECT count(*) FROM z)::INTEGER AS zones, 4::INTEGER AS priorities FROM t""")
def summary_kpis(spark, sf_dir):
    a = alarms(spark, sf_dir)
    out = kpis.summary_kpis(a, prepare.episodes(a))
    return out.select(F.col("rate.peak_per_window").alias("peak"), "high_priority_share_pct", "high_priority_target_pct", "time_to_clear.median_min", "standing_alarm_count", F.size("zone_load").alias("zones"), F.size("priority_mix").alias("priorities"))


@query(f"""WITH {_INC}, b AS (SELECT tag, count(*) AS n FROM a GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1), w AS (SELECT count(*) AS n FROM a GROUP BY {_floor(10)})
SELECT count(*) AS total_alarms, count(DISTINCT tag) AS sources, min(ts) AS from_ts, max(ts) AS to_ts, count(*) FILTER (priority = 'CRITICAL') AS critical, count(*) FILTER (priority = 'LOW') AS low, (SELECT count(*) FROM inc) AS incidents, (SELECT tag FROM b) AS bad_actor_tag, round_even(100 * (SELECT n FROM b) / count(*), 1) AS bad_actor_share, (SELECT count(*) FROM w WHERE n > 10) AS flood_windows FROM a""")
def summary(spark, sf_dir):
    a = alarms(spark, sf_dir)
    found = rootcause.incidents(rootcause.segment_incidents(a, GAP).where("incident_id IS NOT NULL"))
    out = kpis.summary(a, found)
    return out.select("total_alarms", "sources", "from_ts", "to_ts", F.col("by_priority")["CRITICAL"].alias("critical"), F.col("by_priority")["LOW"].alias("low"), "incidents", "bad_actor_tag", "bad_actor_share", "flood_windows")


@query(f"WITH {_AL} SELECT tag, count(*) AS alarm_count, arg_max(priority, sev) AS worst_priority, max(ts) AS last_ts FROM a GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60")
def tags_status(spark, sf_dir):
    return kpis.tags_status(alarms(spark, sf_dir))


@query(f"WITH {_AL}, {_EP} SELECT * FROM ep")
def episodes(spark, sf_dir):
    return prepare.episodes(alarms(spark, sf_dir))


@query(f"WITH {_AL}, {_EP} SELECT ts, seq, tag, level, priority, zone, description, 0 AS part, CASE WHEN implicit OR raises THEN 'ACTIVE' ELSE 'CLEARED' END AS state FROM m UNION ALL SELECT ts, seq, tag, level, priority, zone, description, 1, 'CLEARED' FROM m WHERE implicit")
def alarm_events(spark, sf_dir):
    return prepare.alarm_events(alarms(spark, sf_dir))


@query(f"WITH {_INC} SELECT a.seq, a.ts, a.tag, lab.incident_id FROM a LEFT JOIN lab USING (seq)")
def segment_incidents(spark, sf_dir):
    return rootcause.segment_incidents(alarms(spark, sf_dir), GAP).select("seq", "ts", "tag", "incident_id")


@query(f"WITH {_INC} SELECT * FROM inc")
def incidents(spark, sf_dir):
    return rootcause.incidents(_labelled(spark, sf_dir))


@query(f"WITH {_INC} SELECT * FROM inc ORDER BY alarm_count DESC, incident_id LIMIT 40")
def incident_list(spark, sf_dir):
    return rootcause.largest(rootcause.incidents(_labelled(spark, sf_dir)))


@query(f"WITH {_RATES} SELECT tag, appearances, initiations, initiation_rate, initiation_rate_smoothed FROM rates")
def initiation_rates(spark, sf_dir):
    return rootcause.initiation_rates(_labelled(spark, sf_dir))


@query(f"WITH {_RANKED} SELECT * FROM ranked")
def rank_candidates(spark, sf_dir):
    return _ranked(spark, sf_dir)[1]


@query(f"WITH {_RANKED} SELECT tag, arg_max('Investigate ' || tag, incident_id) AS hint FROM ranked WHERE rank = 1 GROUP BY 1")
def cause_hints(spark, sf_dir):
    return rootcause.cause_hints(_ranked(spark, sf_dir)[1])


@query(f"WITH {_RANKED} SELECT * FROM ranked WHERE incident_id IN (SELECT incident_id FROM inc ORDER BY alarm_count DESC, incident_id LIMIT 40)")
def root_cause_top(spark, sf_dir):
    _, ranked, found = _ranked(spark, sf_dir)
    return rootcause.of_largest(ranked, found)


@query(f"WITH {_SIG} SELECT incident_id, root_tag, array_to_string(alarm_types, ',') AS alarm_types, zone, signature FROM sig")
def incident_signatures(spark, sf_dir):
    _, ranked, found = _ranked(spark, sf_dir)
    return rootcause.signatures(ranked, found).withColumn("alarm_types", F.array_join("alarm_types", ","))


@query(f"WITH {_RANKED}, tr AS (SELECT incident_id, arg_min(tag, row(ts, seq)) AS t FROM lab GROUP BY 1) SELECT count(*) AS incidents, count(*) FILTER (tag = t) AS top1_correct, round_even(count(*) FILTER (tag = t) / count(*), 3) AS accuracy FROM ranked LEFT JOIN tr USING (incident_id) WHERE rank = 1")
def validate(spark, sf_dir):
    rows, ranked, _ = _ranked(spark, sf_dir)
    return rootcause.validate(ranked, rows.groupBy("incident_id").agg(F.min_by("tag", F.struct("ts", "seq")).alias("root_tag")))


def _days(spark, sf_dir) -> int:
    return events(spark, sf_dir).agg(F.count_distinct(F.to_date("ts"))).first()[0]


@query(None)
def validate_synthetic(spark, sf_dir):
    """The synthetic plant's known causes, found again over as many days as the log has."""
    plant = SyntheticPlant(spark, days=max(1, _days(spark, sf_dir)))
    return rootcause.validate(rootcause.rank_candidates(rootcause.labelled(plant.alarm_events())), plant.ground_truth())


@query("SELECT tag, (SELECT count(DISTINCT ts::DATE) FROM events) * 1440 AS n FROM (VALUES " + ", ".join(f"('{t[0]}')" for t in schema.PLANT_TAGS) + ") t(tag)")
def synthetic_samples(spark, sf_dir):
    """Samples of the plant's tags, a minute apart, over as many days as the log has."""
    return SyntheticPlant(spark, days=_days(spark, sf_dir)).process_samples().groupBy("tag").agg(F.count("value").alias("n"))


@query("SELECT event_type AS tag, count(*) AS n, round_even(sum(value), 2) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def historian_samples(spark, sf_dir):
    """`events` exported as samples to a folder, and read from there as a historian's."""
    folder = scratch_folder(spark)
    events(spark, sf_dir).select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("tag"), "value").repartition(4).write.parquet(folder)
    return Historian(spark, samples=folder).process_samples().groupBy("tag").agg(F.count("*").alias("n"), F.bround(F.sum("value"), 2).alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"WITH {_AL} SELECT tag, level, count(*) AS n FROM a GROUP BY ALL")
def historian_alarms(spark, sf_dir):
    """Alarms exported to a folder without some columns, and read from there."""
    folder = scratch_folder(spark)
    alarms(spark, sf_dir).select("ts", "seq", "tag", "level", "state", "transition").repartition(4).write.parquet(folder)
    return Historian(spark, alarms=folder).alarm_events().where("state = 'ACTIVE' AND zone IS NULL").groupBy("tag", "level").agg(F.count("*").alias("n"))


@query(f"WITH {_KB} SELECT * REPLACE (array_to_string(alarm_types, ',') AS alarm_types) FROM kb ORDER BY confirmed_at DESC, id LIMIT 100")
def kb_confirmations(spark, sf_dir):
    return knowledge.newest(_history(spark, sf_dir)[4]).withColumn("alarm_types", F.array_join("alarm_types", ","))


@query(f"WITH {_KB} SELECT * FROM mt")
def kb_match(spark, sf_dir):
    _, _, _, sig, kb = _history(spark, sf_dir)
    return knowledge.match(sig, kb)


@query(f"WITH {_KB} SELECT count(*) AS total, count(DISTINCT signature) AS distinct_signatures, (SELECT count(*) FROM seen WHERE times_seen > 1) AS recurring FROM kb")
def kb_stats(spark, sf_dir):
    return knowledge.stats(_history(spark, sf_dir)[4])


@query(f"WITH {_KB} SELECT count(*) AS confirmations, count(*) FILTER (engine_top_pick_correct) AS top1_correct, round_even(count(*) FILTER (engine_top_pick_correct) / count(*), 3) AS accuracy FROM kb")
def engine_accuracy(spark, sf_dir):
    return knowledge.engine_accuracy(_history(spark, sf_dir)[4])


@query(f"WITH {_KB} SELECT date_trunc('day', confirmed_at)::TIMESTAMP AS day, 'initiation-rate' AS method, count(*) FILTER (engine_top_pick_correct) AS correct_count, count(*) AS total_count, round_even(100.0::DOUBLE * count(*) FILTER (engine_top_pick_correct) / count(*), 1) AS accuracy_pct FROM kb JOIN (SELECT incident_id FROM ranked WHERE rank = 1) USING (incident_id) GROUP BY 1")
def accuracy_by_day(spark, sf_dir):
    _, ranked, _, _, kb = _history(spark, sf_dir)
    return knowledge.accuracy_by_day(kb, knowledge.candidates_table(ranked))


@query(f"WITH {_KB} SELECT incident_id, alarm_count, CASE WHEN incident_id IN (SELECT incident_id FROM kb) THEN 'confirmed' ELSE 'open' END AS status FROM inc")
def incident_status(spark, sf_dir):
    _, _, found, _, kb = _history(spark, sf_dir)
    return knowledge.incident_status(found, kb).select("incident_id", "alarm_count", "status")


@query(f"""WITH {_KB}, top AS (SELECT incident_id FROM inc ORDER BY alarm_count DESC, incident_id LIMIT 40)
SELECT incident_id, (SELECT string_agg(seq, ',' ORDER BY ts, seq) FROM lab WHERE lab.incident_id = top.incident_id) AS alarms, (SELECT string_agg(tag, ',' ORDER BY rank) FROM ranked WHERE ranked.incident_id = top.incident_id) AS candidates, (SELECT string_agg(id, ',') FROM kb WHERE kb.incident_id = top.incident_id) AS confirmations FROM top""")
def incident_detail(spark, sf_dir):
    rows, ranked, found, _, kb = _history(spark, sf_dir)
    out = knowledge.incident_detail(rootcause.largest(found), rows, ranked, kb, alarm=F.col("seq"))
    listed = lambda c, f: F.array_join(F.transform(c, lambda x: x[f].cast("string")), ",").alias(c)
    return out.select("incident_id", F.array_join(F.col("alarms").cast("array<string>"), ",").alias("alarms"), listed("candidates", "tag"), listed("confirmations", "id"))


@query(f"""WITH {_KB}, {_chatter(3600)}, {_PAIRS}, ids12 AS (SELECT incident_id FROM inc ORDER BY alarm_count DESC, incident_id LIMIT 12), c60 AS (SELECT * FROM chat ORDER BY chattering_events DESC, tag, level LIMIT 60), p60 AS (SELECT * FROM pairs ORDER BY co_occurrences DESC, tag_a, tag_b LIMIT 60),
one AS (SELECT tag, arg_min(chatter_pct, row(-chattering_events, level)) AS chatter_pct FROM c60 GROUP BY 1),
sides AS (SELECT tag_a AS tag, tag_b AS other, * FROM p60 UNION ALL SELECT tag_b, tag_a, * FROM p60),
part AS (SELECT tag, list(other ORDER BY co_occurrences DESC, tag_a, tag_b) AS partners FROM (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY tag ORDER BY co_occurrences DESC, tag_a, tag_b) <= 3) GROUP BY 1),
t AS (SELECT r.incident_id, r.tag, r.level, r.explanation, mt.confirmed_cause, mt.action_taken, mt.operator, mt.confirmed_at, mt.times_seen, one.chatter_pct, part.partners FROM ranked r JOIN ids12 USING (incident_id) LEFT JOIN mt USING (incident_id) LEFT JOIN one ON one.tag = r.tag LEFT JOIN part ON part.tag = r.tag WHERE r.rank = 1),
rec AS (SELECT incident_id, 0 AS ordinal, 1 AS priority, coalesce(nullif(action_taken, ''), nullif(confirmed_cause, '')) AS action, 'This failure signature has been confirmed ' || times_seen || '× before; last resolved by ' || operator || ' on ' || strftime(confirmed_at, '%Y-%m-%d') || '.' AS why, tag AS tags, 'knowledge base' AS source FROM t WHERE times_seen IS NOT NULL
UNION ALL SELECT incident_id, 1, CASE WHEN times_seen IS NULL THEN 1 ELSE 2 END, 'Inspect ' || tag || ' first — {schema.ACTIONS["GENERAL"]}', explanation, tag, 'root-cause + playbook' FROM t
UNION ALL SELECT incident_id, 2, 2, 'Widen the deadband / add on-delay on ' || tag || ' before chasing a process cause.', tag || ' chatters (' || printf('%.1f', chatter_pct) || '% of its activations repeat within 60 s) — the alarm load here is an instrument-tuning problem, not a plant upset.', tag, 'chattering analysis' FROM t WHERE chatter_pct IS NOT NULL
UNION ALL SELECT incident_id, 3, 3, 'Check ' || array_to_string(partners[1:2], ', ') || ' in the same sweep — they alarm together with ' || tag || '.', 'These sources co-fire with the lead candidate, so they likely share a cause or a common feed.', array_to_string(partners, ','), 'co-occurrence' FROM t WHERE partners IS NOT NULL)
SELECT incident_id, row_number() OVER (PARTITION BY incident_id ORDER BY priority, ordinal)::INTEGER AS place, priority, action, why, tags, source FROM rec""")
def recommendations(spark, sf_dir):
    _, ranked, found, sig, kb = _history(spark, sf_dir)
    a, some = alarms(spark, sf_dir), rootcause.largest(found, 12).select("incident_id")
    pick = lambda df: df.join(some, "incident_id", "left_semi")
    out = knowledge.recommend(pick(ranked), chattering=analysis.chattering(a, 3600, top=60), co_occurrence=analysis.co_occurrence(a, top=60), matches=knowledge.match(pick(sig), kb))
    return out.withColumn("tags", F.array_join("tags", ","))


@query("""WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1), d AS (SELECT e.*, med FROM events e JOIN m USING (event_type)), k AS (SELECT event_type, median(abs(value - med)) AS mad FROM d GROUP BY 1)
SELECT event_id, event_type AS tag, value FROM d JOIN k USING (event_type) WHERE abs(value - med) / (1.4826 * coalesce(nullif(mad, 0), 1e-9)) > 2.5""")
def flag_outliers(spark, sf_dir):
    s = events(spark, sf_dir).select("event_id", "ts", F.col("event_type").alias("tag"), "value")
    return prepare.flag_outliers(s, 2.5).where("outlier").select("event_id", "tag", "value")


@query(f"""WITH c AS (SELECT {_floor(60)} AS ts, event_type AS tag, avg(value) AS value FROM events GROUP BY 1, 2), g AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 60 MINUTE)) AS ts FROM c),
f AS (SELECT g.ts, t.tag, value, epoch_us(g.ts) // 3600000000 AS i FROM g CROSS JOIN (SELECT DISTINCT tag FROM c) t LEFT JOIN c ON c.ts = g.ts AND c.tag = t.tag),
n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi, last_value(value IGNORE NULLS) OVER p AS pv, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER q AS ni, first_value(value IGNORE NULLS) OVER q AS nv FROM f
WINDOW p AS (PARTITION BY tag ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY tag ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT ts, tag, round_even(coalesce(value, CASE WHEN i - pi <= 3 THEN pv + coalesce((nv - pv) * (i - pi) / (ni - pi), 0) END), 6) AS value FROM n""")
def align_tags(spark, sf_dir):
    s = events(spark, sf_dir).select("ts", F.col("event_type").alias("tag"), "value")
    return prepare.align_tags(s, 60).withColumn("value", F.bround("value", 6))


@query(f"WITH {_RAW} SELECT * FROM log WHERE ts IS NOT NULL AND transition <> '?'")
def alarm_log(spark, sf_dir):
    return AlarmLog(raw_log(spark, sf_dir)).transitions


@query(f"WITH {_RAW} SELECT count(*) AS rejected FROM log WHERE ts IS NULL OR transition = '?'")
def rejected_rows(spark, sf_dir):
    return AlarmLog(raw_log(spark, sf_dir)).rejected()


@query(f"WITH {_RAW} SELECT level, count(*) AS n FROM log GROUP BY 1")
def classify_types(spark, sf_dir):
    m = F.coalesce("ProcessedMessage", "TransactionMessage")
    return raw_log(spark, sf_dir).groupBy(classify_type(m).alias("level")).agg(F.count("*").alias("n"))


@query(f"WITH {_RAW} SELECT priority, zone, count(*) AS n FROM log GROUP BY 1, 2")
def priorities_and_zones(spark, sf_dir):
    m = F.coalesce("ProcessedMessage", "TransactionMessage")
    asset = F.coalesce(F.nullif("AssetID", F.lit("")), F.lit("UNKNOWN-ASSET"))
    return raw_log(spark, sf_dir).groupBy(map_priority(F.col("AlarmSeverityName"), F.col("AlarmClassName"), classify_type(m)).alias("priority"), zone_of(asset).alias("zone")).agg(F.count("*").alias("n"))


_CSV_MESSAGES = ['He said "fan, on" now', "two\nlines", "plain, comma", " Gas leak\t", ""]
_CSV_ASSETS = [" A-B ", "1-JK1-JK1-00-D.01-AC", "X\t"]


@query(f"""WITH r AS (SELECT CASE WHEN event_id % 50 = 0 THEN NULL ELSE date_trunc('minute', ts)::TIMESTAMP END AS ts, trim({_sql_pick(_CSV_ASSETS, "user_id")}, ' ' || chr(9)) AS tag, trim(upper({_sql_pick([" n2a", "A2A ", "A2N", "?"], "event_id")})) AS transition,
  coalesce(nullif(trim({_sql_pick(_CSV_MESSAGES, "event_id")}, ' ' || chr(9)), ''), 'fallback error') AS message, {_sql_pick(_SEVERITIES, "user_id")} AS severity FROM events),
t AS (SELECT *, {_sql_type("message")} AS level FROM r)
SELECT ts, tag, transition, message, level, CASE WHEN level = 'GAS' THEN 'CRITICAL' WHEN lower(severity) = '1 - high' THEN 'HIGH' WHEN lower(severity) IN ('2 - medium', 'central battery system-medium') THEN 'MEDIUM' ELSE 'LOW' END AS priority,
  CASE WHEN len(string_split(tag, '-')) >= 4 THEN string_split(tag, '-')[2] || '-' || string_split(tag, '-')[4] ELSE string_split(tag, '-')[1] END AS zone FROM t WHERE ts IS NOT NULL AND transition <> '?'""")
def csv_log(spark, sf_dir):
    """A CSV export with quotes, commas and line ends in its fields, written and read again."""
    i, u, folder = F.col("event_id"), F.col("user_id"), scratch_folder(spark)
    made = {
        "DateTime": F.when(i % 50 == 0, "bad").otherwise(F.date_format("ts", "dd-MM-yyyy HH:mm")), "AssetID": _pick(_CSV_ASSETS, u), "AlarmSeverityName": _pick(_SEVERITIES, u),
        "State": _pick([" n2a", "A2A ", "A2N", "?"], i), "TransactionMessage": F.lit("fallback error"), "ProcessedMessage": _pick(_CSV_MESSAGES, i),
    }
    columns = [made.get(c, F.lit("")).alias(c) for c in log_source.COLUMNS]
    events(spark, sf_dir).select(*columns).write.csv(folder, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return AlarmLog.read(spark, folder).transitions.select("ts", "tag", "transition", "message", "level", "priority", "zone")


_EPISODES_OF_LOG = _EP.replace("FROM al WINDOW", "FROM (SELECT * FROM log WHERE ts IS NOT NULL AND transition <> '?') WINDOW")


@query(f"WITH {_RAW}, {_EPISODES_OF_LOG} SELECT tag, level, priority, zone, start_ts, end_ts, duration_min, implicit, standing FROM ep")
def csv_episodes(spark, sf_dir):
    """Episodes of a log of several files: the order of rows of one minute is that of the files' names and of the places in them."""
    folder, made = scratch_folder(spark), raw_log(spark, sf_dir)
    columns = [(F.col(c) if c in made.columns else F.lit("")).alias(c) for c in log_source.COLUMNS]
    made.repartitionByRange(6, "seq").sortWithinPartitions("seq").select(*columns).write.csv(folder, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return AlarmLog.read(spark, folder).episodes.select("tag", "level", "priority", "zone", "start_ts", "end_ts", "duration_min", "implicit", "standing")


@query(f"WITH {_RAW} SELECT count(*) FILTER (ts IS NULL OR (ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-09' AND transition = '?')) AS rejected FROM log")
def rejected_in_a_window(spark, sf_dir):
    return AlarmLog(raw_log(spark, sf_dir), start="2024-01-05 00:00:00", end="2024-01-09 00:00:00").rejected()


@query(f"WITH {_AL} SELECT ts, seq, tag, level, priority, state, value, zone FROM al UNION ALL SELECT ts + INTERVAL 1 DAY, seq, tag, level, NULL, state, NULL, zone FROM al WHERE seq % 7 = 0")
def store_round_trip(spark, sf_dir):
    """Two appends, the second without some columns, read back by SQL."""
    store, a = ParquetStore(spark, scratch_folder(spark)), alarms(spark, sf_dir)
    store.append(a, "alarms")
    store.append(a.where("seq % 7 = 0").select((F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), "seq", "tag", "level", "state", "zone"), "alarms")
    return store.sql("SELECT ts, seq, tag, level, priority, state, value, zone FROM alarms")


@query(f"WITH {_AL} SELECT ts, seq, tag, level FROM al WHERE ts >= TIMESTAMP '2024-01-08 12:30:00' AND ts <= TIMESTAMP '2024-01-11 00:00:00'")
def store_time_range(spark, sf_dir):
    """A read between two times, which looks into the days between them alone."""
    store = ParquetStore(spark, scratch_folder(spark))
    store.append(alarms(spark, sf_dir), "alarms")
    return store.read("alarms", "2024-01-08 12:30:00", "2024-01-11 00:00:00").select("ts", "seq", "tag", "level")


@query(f"WITH {_AL} SELECT tag, count(*) AS n, count(priority) AS with_priority FROM al GROUP BY 1")
def store_batches(spark, sf_dir):
    """What a read sees after a reset, a batch that failed between its tables, a batch run twice, and a compaction."""
    store, a = ParquetStore(spark, scratch_folder(spark)), alarms(spark, sf_dir)
    store.append(a, "alarms")
    store.reset()
    try:
        with store.batch("half") as batch:
            batch.append(a, "alarms")
            raise InterruptedError
    except InterruptedError:
        pass
    for name, keep in (("half", "seq % 2 = 0"), ("half", "seq % 2 = 0"), ("rest", "seq % 2 = 1")):
        with store.batch(name) as batch:
            batch.append(a.where(keep), "alarms")
    store.compact()
    return store.read("alarms").groupBy("tag").agg(F.count("*").alias("n"), F.count("priority").alias("with_priority"))


@query(f"""WITH {_AL}, g AS (SELECT 'G' || (seq % 97) AS incident_id, * FROM a WHERE seq % 3 = 0)
SELECT incident_id, count(*) AS alarm_count, count(DISTINCT tag) AS tags, min(ts) AS start_ts, max(ts) AS end_ts FROM g GROUP BY 1""")
def labelled_given(spark, sf_dir):
    """Alarms that bring their incidents along keep them."""
    given = alarms(spark, sf_dir).withColumn("incident_id", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("G"), (F.col("seq") % 97).cast("string"))))
    return rootcause.incidents(rootcause.labelled(given)).select("incident_id", "alarm_count", "tags", "start_ts", "end_ts")


@query(f"""WITH {_SIG}, done AS (SELECT substr(sha1(incident_id || '|2024-02-01 00:00:00'), 1, 16) AS id, signature, incident_id, root_tag, 'Investigate ' || root_tag AS confirmed_cause, 'Reset' AS action_taken, 'op' AS operator, root_tag = 'U-003' AS engine_top_pick_correct FROM sig)
SELECT *, count(*) OVER (PARTITION BY signature) AS times_seen FROM done""")
def confirm_and_count(spark, sf_dir):
    """Every incident confirmed, the first pick compared with one tag; how often each signature is then in the history."""
    _, ranked, found = _ranked(spark, sf_dir)
    rows = knowledge.confirmation(rootcause.signatures(ranked, found), ranked, action="Reset", operator="op", at="2024-02-01 00:00:00", confirmed_tag="U-003")
    seen = rows.groupBy("signature").agg(F.count("*").alias("times_seen"))
    return rows.join(seen, "signature").select("id", "signature", "incident_id", "root_tag", "confirmed_cause", "action_taken", "operator", "engine_top_pick_correct", "times_seen")


@query(f"WITH {_KB} SELECT date_trunc('day', confirmed_at)::TIMESTAMP AS day, count(*) AS total_count FROM kb JOIN (SELECT incident_id FROM ranked WHERE rank = 1) USING (incident_id) GROUP BY 1 HAVING date_trunc('day', confirmed_at)::TIMESTAMP >= TIMESTAMP '2024-01-10'")
def recent_accuracy(spark, sf_dir):
    _, ranked, _, _, kb = _history(spark, sf_dir)
    return knowledge.recent_accuracy(knowledge.accuracy_by_day(kb, knowledge.candidates_table(ranked)), 10, "2024-01-20 00:00:00").select("day", "total_count")


_TYPES = {"ERROR": "COMMS_FAULT", "PURCHASE": "FAN", "SIGNUP": "OFFLINE", "VIEW": "METER"}


def _typed(a: DataFrame) -> DataFrame:
    """The adapter's levels as real alarm types; clicks have a type that no table knows."""
    out = F.lit("UNKNOWN")
    for level, kind in _TYPES.items():
        out = F.when(F.col("level") == level, kind).otherwise(out)
    return a.withColumn("level", out)


def _sql_case(column: str, table: dict, other: str) -> str:
    return f"CASE {column} " + " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in table.items()) + f" ELSE {other} END"


_TYPED = _RANKED.replace("upper(event_type) AS level", _sql_case("upper(event_type)", _TYPES, "'UNKNOWN'") + " AS level")
_HINTS = {k: schema.CAUSE_HINTS[k] for k in _TYPES.values()}


@query(f"WITH {_TYPED} SELECT incident_id, rank, tag, level, {_sql_case('level', _HINTS, 'NULL')} AS hint FROM ranked")
def hints_by_type(spark, sf_dir):
    return _ranked(spark, sf_dir, _typed(alarms(spark, sf_dir)))[1].select("incident_id", "rank", "tag", "level", "hint")


@query(f"WITH {_TYPED} SELECT tag, arg_max({_sql_case('level', _HINTS, chr(39) + 'Investigate ' + chr(39) + ' || tag')}, incident_id) AS hint FROM ranked WHERE rank = 1 GROUP BY 1")
def cause_hints_by_type(spark, sf_dir):
    return rootcause.cause_hints(_ranked(spark, sf_dir, _typed(alarms(spark, sf_dir)))[1])


_MASKED = f"{_TYPED}, {_EP.replace('n AS (', 'nn AS (').replace('FROM n)', 'FROM nn)')}"


@query(f"""WITH {_MASKED}, k AS (SELECT zone, list_sort(list(DISTINCT tag))[1:2] AS masks FROM ep WHERE standing GROUP BY 1)
SELECT incident_id, 1 AS place, 1 AS priority, 'Inspect ' || tag || ' first — ' || {_sql_case('level', {k: schema.ACTIONS[k] for k in _TYPES.values()}, "'" + schema.ACTIONS["GENERAL"] + "'")} AS action, tag AS tags, 'root-cause + playbook' AS source FROM ranked WHERE rank = 1
UNION ALL SELECT incident_id, 2, 3, 'Clear or rationalise the standing alarm(s) in ' || inc.zone || ' — they mask new events.', array_to_string(masks, ','), 'standing alarms' FROM inc JOIN k ON k.zone = inc.zone""")
def recommendations_by_type(spark, sf_dir):
    """The playbook's answer to each alarm type, and alarms that stand in the incident's zone."""
    a = _typed(alarms(spark, sf_dir))
    _, ranked, found = _ranked(spark, sf_dir, a)
    standing = prepare.episodes(a).where("standing").select("tag", "zone")
    out = knowledge.recommend(ranked, standing=standing, zones=found)
    return out.select("incident_id", "place", "priority", "action", F.array_join("tags", ",").alias("tags"), "source")


@query(f"""WITH {_AL}, {_EP}, {_MIX}, {_ZONES}, {_STANDING}, s AS (SELECT * FROM sa WHERE days_standing >= 1 ORDER BY days_standing DESC, start_ts, tag, level LIMIT 15)
SELECT (SELECT string_agg(priority || ' ' || alarm_count || ' ' || printf('%.1f', pct) || ' ' || printf('%.1f', delta_pct), ', ' ORDER BY target_pct) FROM mix) AS priority_mix,
  (SELECT string_agg(zone || ' ' || alarm_count || ' ' || peak_per_window || ' ' || active_windows, ', ' ORDER BY zone) FROM z) AS zone_load,
  coalesce((SELECT string_agg(tag || ' ' || level || ' ' || printf('%.1f', days_standing), ', ' ORDER BY start_ts, tag, level) FROM s), '') AS standing_alarms""")
def summary_lists(spark, sf_dir):
    """What the lists of the key figures hold."""
    a = alarms(spark, sf_dir)
    number = lambda x: F.format_string("%.1f", x)
    text = lambda name, f: F.array_join(F.transform(name, f), ", ").alias(name)
    return kpis.summary_kpis(a, prepare.episodes(a)).select(
        text("priority_mix", lambda x: F.concat_ws(" ", x["priority"], x["alarm_count"].cast("string"), number(x["pct"]), number(x["delta_pct"]))),
        text("zone_load", lambda x: F.concat_ws(" ", x["zone"], x["alarm_count"].cast("string"), x["peak_per_window"].cast("string"), x["active_windows"].cast("string"))),
        text("standing_alarms", lambda x: F.concat_ws(" ", x["tag"], x["level"], number(x["days_standing"]))),
    )


@query(f"WITH {_INC} SELECT incident_id, start_ts AS started_at, alarm_count, (SELECT count(*) FROM lab WHERE lab.incident_id = inc.incident_id) AS alarms, 'open' AS status FROM inc")
def recorded_incidents(spark, sf_dir):
    """Incidents, their alarms and candidates as appended to the store's tables and read back."""
    rows, ranked, found = _ranked(spark, sf_dir)
    store = ParquetStore(spark, scratch_folder(spark))
    for name, table in knowledge.incident_tables(rows, ranked, found).items():
        store.append(table, name)
    counts = store.read("incident_alarms").groupBy("incident_id").agg(F.count("*").alias("alarms"))
    return store.read("incidents").join(counts, "incident_id").select("incident_id", "started_at", "alarm_count", "alarms", "status")


_LATER = _INC.replace("FROM events)", "FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00')")


@query(f"""WITH old AS (WITH {_LATER} SELECT * FROM inc), new AS (WITH {_INC} SELECT * FROM inc),
two AS (SELECT * FROM old UNION ALL SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.start_ts <= new.end_ts AND new.start_ts <= old.end_ts))
SELECT 'INC-' || strftime(start_ts, '%Y%m%dT%H%M%S%f') AS incident_id, start_ts AS started_at, end_ts AS ended_at, alarm_count, alarm_count AS alarms, 'open' AS status FROM two""")
def recorded_after_earlier_days(spark, sf_dir):
    """Incidents recorded from the later days of the log, then from all of it, twice: known ones keep their ids, none is recorded again."""
    from .plans.service import Service

    store, a = ParquetStore(spark, scratch_folder(spark)), alarms(spark, sf_dir)
    for part in (a.where("ts >= TIMESTAMP_NTZ'2024-01-10 00:00:00'"), a.where("ts < TIMESTAMP_NTZ'2024-01-10 00:00:00'"), None):
        if part is not None:
            store.append(part, "alarms")
        service = Service(store, gap_min=GAP)
        service.record_incidents()
        service.refresh()
    counts = store.read("incident_alarms").groupBy("incident_id").agg(F.count("*").alias("alarms"))
    return store.read("incidents").join(counts, "incident_id").select("incident_id", "started_at", "ended_at", "alarm_count", "alarms", "status")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _made.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _made.items() if sql}
