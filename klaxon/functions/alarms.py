"""Classification, priorities, zones, time and text, as expressions. Rounding is half-even throughout (bround)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema

#: Fixed value: what counts as white space at the ends of a text.
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def lookup(key: Column, table: dict) -> Column:
    """The value of key in a small fixed table, or null."""
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def classify_type(message: Column) -> Column:
    """The code of the first pattern that the lower-case message matches, else GENERAL."""
    low, out = F.lower(message), None
    for code, pattern in schema.TYPE_PATTERNS:
        out = F.when(low.rlike(pattern), code) if out is None else out.when(low.rlike(pattern), code)
    return out.otherwise("GENERAL")


def map_priority(severity: Column, alarm_class: Column, alarm_type: Column) -> Column:
    cls, sev = F.lower(strip(F.coalesce(alarm_class, F.lit("")))), F.lower(strip(F.coalesce(severity, F.lit(""))))
    return (
        F.when(cls.isin(schema.SAFETY_CLASSES) | F.coalesce(alarm_type, F.lit("")).isin(schema.SAFETY_TYPES), "CRITICAL")
        .when(sev.isin(list(schema.SEVERITY_PRIORITY)), lookup(sev, schema.SEVERITY_PRIORITY))
        .when(cls.endswith("-high"), "HIGH")
        .otherwise("LOW")
    )


def zone_of(asset: Column) -> Column:
    """Block and floor of a structured asset id; its first part if it has fewer than four; UNASSIGNED if blank."""
    parts = F.split(asset, "-")
    return F.when(strip(F.coalesce(asset, F.lit(""))) == "", "UNASSIGNED").when(F.size(parts) >= 4, F.concat_ws("-", parts[1], parts[3])).otherwise(parts[0])


def severity(priority: Column) -> Column:
    return F.coalesce(lookup(priority, schema.PRIORITY_RANK), F.lit(0))


def priority_of(rank: Column) -> Column:
    return F.coalesce(lookup(rank, {v: k for k, v in schema.PRIORITY_RANK.items()}), F.lit("LOW"))


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp column, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {ts})")


def minutes(start: str, end: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {start}, {end}) / 6e7D")


def floor_to(ts: str, width_min: int) -> Column:
    """The start of the tumbling window that holds ts; windows are counted from 1970."""
    return F.window(F.col(ts), f"{width_min} minutes")["start"]


def verdict(rate: Column) -> Column:
    return F.when(rate <= schema.TARGET_RATE, "within EEMUA target").when(rate <= schema.MANAGEABLE_PEAK, "above target, still manageable").otherwise("unacceptable per EEMUA-191")


def step(tag: str = "tag", level: str = "level") -> Column:
    return F.concat_ws(":", tag, level)


def signature(root_tag: Column, alarm_types: Column, zone: Column) -> Column:
    """16 hex digits that name an incident's shape: root tag, sorted distinct types, zone."""
    return F.substring(F.sha1(F.concat_ws("|", root_tag, F.array_join(F.array_sort(F.array_distinct(alarm_types)), ","), F.coalesce(zone, F.lit("")))), 1, 16)


def whole_percent(share: Column) -> Column:
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def plain_number(x: Column) -> Column:
    """A number of one decimal without a trailing .0."""
    return F.regexp_replace(F.format_string("%.1f", x), r"\.0$", "")


def active(alarms):
    return alarms.where("state = 'ACTIVE'")
