"""Order over the whole stream without a window that has no key: time is cut into buckets, the window runs inside each bucket, and
what crosses a bucket's edge comes from a table of one row for each bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.alarms import micros
from ..sources.base import written

HOUR = 3_600_000_000
#: Rows of a bucket above which it is cut into PIECES, if it is among the MOST largest; inputs of fewer bytes have no such bucket.
SPLIT, PIECES, MOST, SMALL = 1_000_000, 256, 10_000, 64 << 20


def _bucketed(df: DataFrame, width: int, keys: list[str] | None = None) -> DataFrame:
    """df with `_us`, and `_bucket`: a number that grows with (ts, seq), by `width` of time. A bucket (of each of the keys) that has more than SPLIT rows is
    cut at quantiles of (ts, seq), so an hour with half of all alarms, or one minute of it, is the work of many tasks. The rows that are cut
    are found by one count of the buckets, which small inputs are spared."""
    rows = df.withColumn("_us", micros("ts")).withColumn("_at", F.floor(F.col("_us") / width))
    whole = rows.withColumn("_bucket", F.col("_at") * PIECES).drop("_at")
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL:
        return whole
    by = [*(keys or []), "_at"]
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("seq").alias("_lo"), F.max("seq").alias("_hi"))
    found = sizes.agg(F.max("_n").alias("largest"), F.sum("_n").alias("total")).first()
    if (found["largest"] or 0) <= SPLIT:
        return whole
    hot = sizes.where(F.col("_n") > max(SPLIT, found["total"] / MOST)).select(*(F.col(c).alias(f"_h{k}") for k, c in enumerate(by)), "_lo", "_hi")
    same = F.lit(True)
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_h{k}"))
    # Microseconds into the bucket, and as their fraction the place of seq in its range: a number that never falls along (ts, seq).
    place = (F.col("_us") - F.col("_at") * width) + (F.col("seq") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1)
    # Written once, as they depend on the order in which partial results arrive: all uses must see the same buckets.
    cuts = written(rows.join(F.broadcast(hot), same).groupBy(*(f"_h{k}" for k in range(len(by))), "_lo", "_hi").agg(F.percentile_approx(place, [k / PIECES for k in range(1, PIECES)], 10_000).alias("_cuts")))
    piece = F.coalesce(F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda c: c < place))), F.lit(0))
    cut = rows.join(F.broadcast(cuts), same, "left").withColumn("_bucket", F.col("_at") * PIECES + piece)  # fewer than MOST rows
    return cut.drop("_at", "_lo", "_hi", "_cuts", *(f"_h{k}" for k in range(len(by))))


def gap_sessions(df: DataFrame, gap_min: float, width: int = HOUR, buckets: bool = False) -> DataFrame:
    """df (ts, seq, ...) with `session`, numbered from 0 in time order: a silence of more than gap_min begins another. What is
    numbered in one task is one row for each hour that has rows. With `buckets` the rows keep their `_bucket`, for joins that leave a long
    session in many tasks."""
    rows = _bucketed(df, width)
    inside = Window.partitionBy("_bucket").orderBy("ts", "seq")
    silent = lambda since: F.coalesce((F.col("_us") - since > gap_min * 60_000_000).cast("int"), F.lit(0))
    rows = rows.withColumn("_begins", silent(F.lag("_us").over(inside)))
    edges = rows.groupBy("_bucket").agg(F.min("_us").alias("_us"), F.max("_us").alias("_last"), F.sum("_begins").alias("_n"))
    in_order = Window.orderBy("_bucket")
    # What begins with a bucket's first row, and all that began in the buckets before.
    edges = edges.withColumn("_edge", silent(F.lag("_last").over(in_order)))
    before = F.sum(F.col("_n") + F.col("_edge")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.select("_bucket", (F.coalesce(before, F.lit(0)) + F.col("_edge")).alias("_offset"))
    running = F.sum("_begins").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("session", running).join(edges, "_bucket").withColumn("session", F.col("session") + F.col("_offset")).drop("_us", "_begins", "_offset", *([] if buckets else ["_bucket"]))


def positions(df: DataFrame, width: int = HOUR) -> DataFrame:
    """df with `pos`, its place in the whole order by (ts, seq), from 0."""
    rows = _bucketed(df, width)
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy("ts", "seq")
    return rows.join(sizes, "_bucket").withColumn("pos", F.col("_offset") + F.row_number().over(inside) - 1).drop("_us", "_bucket", "_offset")


def places(df: DataFrame, key: str, name: str, width: int = HOUR) -> DataFrame:
    """df with column `name`, a row's place from 1 in the order of (ts, seq) of its key. A key's rows are cut into buckets of time, so a key
    with half of all rows is the work of many tasks."""
    rows = _bucketed(df, width, [key])
    sizes = rows.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_of")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_key", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(key, "_bucket").orderBy("ts", "seq")
    met = F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_of"))
    return rows.withColumn("_k", F.row_number().over(inside)).join(sizes, met).withColumn(name, F.col("_offset") + F.col("_k")).drop("_us", "_bucket", "_key", "_of", "_offset", "_k")


def gathered(df: DataFrame, key: str, item: Column, name: str, width: int = HOUR) -> DataFrame:
    """One row for each key with the array `name`: the items of its rows in the order of (ts, seq). Rows are sorted bucket by bucket of time, and only items
    travel from there to the key's row, so a key with half of all rows is sorted by many tasks."""
    rows = _bucketed(df, width, [key])
    in_order = lambda *columns: F.array_sort(F.collect_list(F.struct(*columns)))
    pieces = rows.groupBy(key, "_bucket").agg(F.transform(in_order("ts", "seq", item.alias("_item")), lambda x: x["_item"]).alias("_piece"))
    return pieces.groupBy(key).agg(F.flatten(F.transform(in_order("_bucket", "_piece"), lambda x: x["_piece"])).alias(name))


def numbered(df: DataFrame, key: str, block: int = 10_000) -> DataFrame:
    """df with `number`, from 0 in the order of its unique whole-number column `key`. Numbers inside a block of keys, and one row for each
    block in one task."""
    rows = df.withColumn("_block", F.floor(F.col(key) / block))
    sizes = rows.groupBy("_block").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_block").orderBy(key)
    return rows.join(sizes, "_block").withColumn("number", F.col("_offset") + F.row_number().over(inside) - 1).drop("_block", "_offset")


def neighbours(df: DataFrame, keys: list[str], columns: dict[str, Column], width: int = 24 * 30 * HOUR) -> DataFrame:
    """df with structs `prev` and `next` of `columns`, of the rows before and after in the order of (ts, seq) for each key. A key's
    rows are cut at every `width` of time, so a source that makes half of all alarms is not one task's work."""
    rows = _bucketed(df, width, keys).withColumn("_own", F.struct(*(c.alias(k) for k, c in columns.items())))
    part = [*keys, "_bucket"]
    order = F.struct("ts", "seq")
    edges = rows.groupBy(*part).agg(F.min_by("_own", order).alias("_first"), F.max_by("_own", order).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    edges = edges.select(*part, F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after"))
    edges = edges.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(part)), "_before", "_after")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(part)]
    inside = Window.partitionBy(*part).orderBy("ts", "seq")
    rows = rows.withColumns({"_p": F.lag("_own").over(inside), "_n": F.lead("_own").over(inside)})
    met = same[0]
    for c in same[1:]:
        met = met & c
    rows = rows.join(edges, met).withColumns({"prev": F.coalesce("_p", "_before"), "next": F.coalesce("_n", "_after")})
    return rows.drop("_us", "_bucket", "_own", "_p", "_n", "_before", "_after", *(f"_k{i}" for i in range(len(part))))
