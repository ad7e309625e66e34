"""Fixed virtual slots: rows hash into thousands of slots, bytes are summed by slot, and a versioned slot-to-shard map, a table in a
folder, is read and edited when shards must be made even or a shard is added. DataFrame and SQL functions only.

The slot of a row is the hash of its text, so equal texts, however many, stay in one shard. A group of copies that holds more than an
even shard makes its shard that much larger; with `split_above` the caller can choose even shards over whole groups: texts whose
copies fill more than that share of an even shard are then dealt over the slots by their ids.

Defined results: a null text counts no bytes and has the checksum of no bytes; a very long text is a row like others, so one that is
larger than an even shard makes its shard larger; null ids are rows like others; equal rows are kept, each with a place of its own (which
of them has which is open); an empty table gives an empty result. Only the id and text columns are looked at, so columns of any other
name may be present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import save, scratch_path, text_or_empty

SLOTS = 4096
#: Parts of a slot that are numbered apart, so that no task numbers a whole slot.
CELLS = 32
MAP = "vslot bigint, bytes bigint, shard int, version int"


def slot_bytes(rows: DataFrame) -> DataFrame:
    """vslot, bytes for every slot that has rows: SLOTS rows at most, whatever the input."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"))


def first_map(slots: DataFrame, shards: int) -> DataFrame:
    """Version 0 of the map: slots are dealt in turn."""
    return slots.select("vslot", "bytes", F.lit(0).alias("version"), (F.col("vslot") % shards).cast("int").alias("shard"))


def edit_map(slot_map: DataFrame, shards: int, slack: float = 0.002) -> DataFrame:
    """The next version of a map, for so many shards. Slots are met in falling size; one stays in its shard if that shard then
    holds no more than an even part, else it moves to the shard that holds least. The fold runs over one row with SLOTS
    entries at most, so its work doesn't depend on the input."""
    entry = "struct(-bytes AS down, vslot, bytes, shard, version)"
    state = f"struct(array_repeat(0D, {shards}) AS held, cast(array() AS array<struct<vslot:bigint,bytes:bigint,version:int,shard:int>>) AS done)"
    even = f"(aggregate(entries, 0D, (a, e) -> a + e.bytes) / {shards} * (1 + {slack}))"
    least = "cast(array_position(s.held, array_min(s.held)) - 1 AS int)"
    pick = f"if(e.shard < {shards} AND get(s.held, e.shard) + e.bytes <= even, e.shard, {least})"
    # The chosen shard is found by an inner transform over one value, so that it is not worked out anew for each use.
    step = f"""(s, e) -> transform(array({pick}), p -> struct(
        transform(s.held, (h, i) -> if(i = p, h + e.bytes, h)) AS held,
        array_append(s.done, named_struct('vslot', cast(e.vslot AS bigint), 'bytes', cast(e.bytes AS bigint), 'version', e.version + 1, 'shard', p)) AS done))[0]"""
    return (
        slot_map.agg(F.expr(f"array_sort(collect_list({entry}))").alias("entries"))
        .withColumn("even", F.expr(even))
        .select(F.expr(f"inline(aggregate(entries, {state}, {step}).done)"))
    )


def save_version(slot_map: DataFrame, folder: str) -> None:
    """Adds a version to the stored map. Versions are never rewritten."""
    for (version,) in slot_map.select("version").distinct().collect():  # one, or none if there are no slots
        slot_map.select("vslot", "bytes", "shard").coalesce(1).write.parquet(f"{folder}/version={version}")


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version of the stored map, the newest by default; empty if none is stored."""
    from pyspark.errors import AnalysisException

    try:
        stored = spark.read.schema(MAP).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MAP)
    newest = stored.agg(F.max("version")).first()[0] if version is None else version
    return stored.where(F.col("version") == F.lit(newest))


def rebalance(spark: SparkSession, slots: DataFrame, shards: int, folder: str) -> DataFrame:
    """Stores the next version of the map for the slots' present bytes, and returns it as read back. Slots that the stored map knows
    start from their shard, new ones are dealt in turn; without a stored map that deal is version 0."""
    known = read_map(spark, folder)
    if known.isEmpty():
        save_version(first_map(slots, shards), folder)
        known = read_map(spark, folder)
    version = known.agg(F.max("version")).first()[0] or 0
    now = known.select("vslot", "shard").join(slots, "vslot", "full").select(
        "vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.lit(version).alias("version"), F.coalesce("shard", (F.col("vslot") % shards).cast("int")).alias("shard")
    )
    save_version(save(edit_map(now, shards), "slot-map"), folder)
    return read_map(spark, folder)


def _slot_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS))


def assign(docs: DataFrame, shards: int = 8, *, id_column: str = "doc_id", text_column: str = "text", folder: str | None = None, split_above: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, map). rows: id, size, text_crc32, vslot, shard, slot (its place in the shard, from 0 without gaps).
    map: vslot, bytes, shard, version: the version that placed them, stored in `folder` (of the scratch space by default), whose
    newest version it continues."""
    spark = docs.sparkSession
    text = text_or_empty(text_column)
    rows = save(
        docs.select(
            F.col(id_column).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("text_key"),
            F.pmod(F.monotonically_increasing_id(), F.lit(CELLS)).alias("deal"),  # parts equal rows; fixed, as it is written here
        ),
        "sizes",
    )
    vslot = _slot_of(F.col("text_key"))
    if split_above is not None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        # Such texts are fewer than shards / split_above.
        heavy = rows.groupBy("text_key").agg(F.sum("size").alias("b")).where(F.col("b") > split_above * total / shards).select("text_key", F.lit(True).alias("is_heavy"))
        rows = rows.join(F.broadcast(heavy), "text_key", "left")
        vslot = F.when(F.col("is_heavy"), _slot_of(F.struct("doc_id", "text_key", "deal"))).otherwise(vslot)
    rows = rows.withColumn("vslot", vslot).withColumn("cell", F.pmod(F.xxhash64("doc_id", "size", "deal"), F.lit(CELLS)))
    cells = save(rows.groupBy("vslot", "cell").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "cells")  # SLOTS * CELLS rows at most
    placing = rebalance(spark, slot_bytes(cells), shards, folder or scratch_path(spark, "slot-map"))
    before = Window.partitionBy("shard").orderBy("vslot", "cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.join(F.broadcast(placing.select("vslot", "shard")), "vslot").select("vslot", "cell", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("vslot", "cell").orderBy("doc_id", "text_key")) - 1
    # Both sides of this join are dealt and sorted by its keys, so only the small one is shuffled for it.
    placed = rows.withColumn("place", place).join(starts.hint("merge"), ["vslot", "cell"])
    return placed.select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot")), placing


def add_shard(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of a map after one more shard: the slots that move all go to the new shard, whose number is `shards`. Slots
    leave each old shard in rising order of a hash until about 1 / (shards + 1) of its bytes have left."""
    w = Window.partitionBy("shard").orderBy(F.xxhash64("vslot"), "vslot")
    left, whole = F.sum("bytes").over(w), F.sum("bytes").over(Window.partitionBy("shard"))
    return slot_map.withColumn("goes", left * (shards + 1) <= whole).select(
        "vslot", "bytes", (F.col("version") + 1).alias("version"), F.when(F.col("goes"), F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard")
    )


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The digest of assign() under the law `bytes`: the bytes of the shards are as near equal as whole groups of equal texts let them be."""
    rows, _ = assign(docs, shards)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
