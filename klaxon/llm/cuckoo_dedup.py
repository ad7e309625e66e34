"""Exact dedup over an index of live digests: cuckoo filters, one for each shard of the digests, beside the stored keys.

Texts are equal when they are so after every character of [\\x20\\x09-\\x0D] is deleted; their digest is the SHA-256 of what is left. A shard's
task reads its filter, its stored keys and the digests that arrive (folded by digest where they are read, so a group of copies sends one
row from each task). A digest that the filter doesn't hold is new: its fingerprint goes into the filter and its key into the store. A hit is verified
against the stored keys of its bucket, which are kept in the order of their buckets, so a false hit costs a look and never a row.
When no place is found for a fingerprint, the filter is made twice as large from the stored keys. The number of shards follows the number of
live digests, so a task holds about PER_SHARD keys of 65 bytes whatever the size of the index. A version of the index is whole once its
row is in the table of versions; a job that dies before leaves the version before it.

Defined results: a null text counts as empty, and empty texts are equal to one another and to texts of white space alone; the row with the most code points in the
original text stays, of ties the smallest doc_id (nulls last), of rows that repeat id and text one; very long texts are digested whole;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import join_by_key, save, scratch_path, text_or_empty

#: Fingerprints of a bucket; rounds of moves before the filter is made larger; live digests of a shard; rows folded at once.
SLOTS, ROUNDS, PER_SHARD, FOLD = 4, 200, 50_000, 50_000
#: A digest in four words, the rows that have it, and the row of it that stays.
ENTRY = np.dtype([("w0", "<u8"), ("w1", "<u8"), ("w2", "<u8"), ("w3", "<u8"), ("n", "<i8"), ("chars", "<i8"), ("null", "u1"), ("id", "<i8"), ("place", "<i8")])
WORDS = ("w0", "w1", "w2", "w3")
SCHEMA = "shard int, kind int, data binary"
FILTER, STORED, ARRIVING = 0, 1, 2


class CuckooFilter:
    """16-bit fingerprints (never 0) in buckets of SLOTS. A key's bucket is given by its highest bits, so that keys in order are in the
    order of their buckets, and doubling the buckets keeps it; its other bucket follows from the bucket and the fingerprint."""

    def __init__(self, bits: int):
        self.bits, self.table = bits, np.zeros((1 << bits, SLOTS), np.uint16)

    def fingerprints(self, keys: np.ndarray) -> np.ndarray:
        low = (keys & np.uint64(0xFFFF)).astype(np.uint16)
        return np.where(low == 0, np.uint16(1), low)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)

    def other(self, buckets: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return buckets ^ ((prints.astype(np.int64) * 0x5BD1E995 >> 7) & ((1 << self.bits) - 1))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        prints, home = self.fingerprints(keys), self.home(keys)
        return ((self.table[home] == prints[:, None]) | (self.table[self.other(home, prints)] == prints[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Whether all keys found a place. Each round puts what fits into its bucket; what doesn't fit goes to its other bucket, after the
        first round taking the place of a fingerprint there, which moves instead."""
        prints, at = self.fingerprints(keys), self.home(keys)
        for turn in range(ROUNDS):
            order = np.argsort(at, kind="stable")
            prints, at = prints[order], at[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            used = self.table[at] != 0
            fits = rank < SLOTS - used.sum(axis=1)
            slot = np.argsort(used[fits], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
            self.table[at[fits], slot] = prints[fits]
            prints, at = prints[~fits], at[~fits]
            if not len(at):
                return True
            if turn:
                _, first = np.unique(at, return_index=True)
                moved = self.table[at[first], turn % SLOTS].copy()
                self.table[at[first], turn % SLOTS] = prints[first]
                prints[first] = moved
            at = self.other(at, prints)
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Of keys that were inserted: one fingerprint each."""
        prints, home = self.fingerprints(keys), self.home(keys)
        for p, *both in zip(prints, home, self.other(home, prints), strict=True):
            for b in both:
                found = np.flatnonzero(self.table[b] == p)
                if len(found):
                    self.table[b, found[0]] = 0
                    break


def folded(e: np.ndarray) -> np.ndarray:
    """One entry for each digest: the rows added up, the row that stays."""
    if not len(e):
        return e
    e = e[np.lexsort((e["place"], e["id"], e["null"], -e["chars"], *(e[w] for w in reversed(WORDS))))]
    new = np.concatenate([[True], np.any([e[w][1:] != e[w][:-1] for w in WORDS], axis=0)])
    starts = np.flatnonzero(new)
    out = e[starts].copy()
    out["n"] = np.add.reduceat(e["n"], starts)
    return out


class Shard:
    """The filter and the stored keys, in the order of their buckets."""

    def __init__(self, stored: np.ndarray, filter_: CuckooFilter | None = None):
        self.stored, self.filter = stored[np.argsort(stored["w0"], kind="stable")], filter_
        if filter_ is None:
            self.resize(4)

    def resize(self, bits: int) -> None:
        """A filter of at least so many bits, made from the stored keys, of which it can hold 0.9 of its places."""
        bits = max(bits, int(np.ceil(np.log2(max(1, len(self.stored)) / (0.9 * SLOTS)))))
        self.filter = CuckooFilter(bits)
        while not self.filter.insert(self.stored["w0"]):
            bits += 1
            self.filter = CuckooFilter(bits)

    def find(self, e: np.ndarray) -> np.ndarray:
        """Places of e's digests among the stored keys; -1 of those that aren't there."""
        at = np.full(len(e), -1)
        hits = np.flatnonzero(self.filter.holds(e["w0"]))
        look = np.searchsorted(self.stored["w0"], e["w0"][hits])
        while len(hits):
            inside = look < len(self.stored)
            hits, look = hits[inside], look[inside]
            same = self.stored["w0"][look] == e["w0"][hits]
            hits, look = hits[same], look[same]
            equal = np.all([self.stored[w][look] == e[w][hits] for w in WORDS[1:]], axis=0)
            at[hits[equal]] = look[equal]
            hits, look = hits[~equal], look[~equal] + 1
        return at

    def insert(self, e: np.ndarray) -> None:
        """Of folded entries."""
        at = self.find(e)
        known, fresh = at >= 0, e[at < 0]
        old, new = self.stored[at[known]], e[known]
        better, tied = np.zeros(len(new), bool), np.ones(len(new), bool)
        for column, sign in (("chars", -1), ("null", 1), ("id", 1), ("place", 1)):
            a, b = (new[column], old[column]) if sign > 0 else (old[column], new[column])
            better |= tied & (a < b)
            tied &= a == b
        kept = np.where(better, new, old)
        kept["n"] = old["n"] + new["n"]
        self.stored[at[known]] = kept
        self.stored = np.insert(self.stored, np.searchsorted(self.stored["w0"], fresh["w0"]), fresh)
        # Overflow: more keys than places, or no place found in ROUNDS moves.
        if len(self.stored) > self.filter.table.size or not self.filter.insert(fresh["w0"]):
            self.resize(self.filter.bits + 1)

    def delete(self, e: np.ndarray) -> None:
        at = self.find(e)
        at = at[at >= 0]
        self.filter.delete(self.stored["w0"][at])
        self.stored = np.delete(self.stored, at)


def _batch(shards: list[int], kind: int, data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([kind] * len(shards), pa.int32()), pa.array(data, pa.binary())], ["shard", "kind", "data"])


def _dealt(e: np.ndarray, kind: int, shards: int) -> pa.RecordBatch:
    """Entries as one row for each shard."""
    shard = (e["w1"] & np.uint64(shards - 1)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    e, shard = e[order], shard[order]
    starts = np.flatnonzero(np.diff(shard, prepend=-1))
    return _batch(shard[starts].tolist(), kind, [x.tobytes() for x in np.split(e, starts[1:])])


def _pack(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = [], 0
        for batch in batches:
            e = np.zeros(batch.num_rows, ENTRY)
            words = np.frombuffer(b"".join(batch.column("digest").to_pylist()), ">u8").reshape(-1, 4)
            for k, w in enumerate(WORDS):
                e[w] = words[:, k]
            ids = batch.column("doc_id")
            e["n"], e["null"] = 1, ids.is_null().to_numpy(zero_copy_only=False)
            e["id"], e["chars"], e["place"] = ids.fill_null(0).to_numpy(), batch.column("chars").to_numpy(), batch.column("place").to_numpy()
            kept.append(e)
            rows += len(e)
            if rows > FOLD:
                one = folded(np.concatenate(kept))
                kept, rows = [one], len(one)
                if rows > FOLD // 2:
                    yield _dealt(one, ARRIVING, shards)
                    kept, rows = [], 0
        if rows:
            yield _dealt(folded(np.concatenate(kept)), ARRIVING, shards)

    return run


def _redeal(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                yield _dealt(np.frombuffer(data, ENTRY), STORED, shards)

    return run


def _work(mode: str):
    """Over the rows of whole shards, each with its filter first, then the stored keys, then what arrives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, filter_, shard, stored, arriving, size = None, None, None, [], [], 0

        def meet() -> Iterator[pa.RecordBatch]:
            nonlocal shard, arriving, size
            if shard is None:
                shard = Shard(np.concatenate([*stored, np.zeros(0, ENTRY)]), filter_)
            e = folded(np.concatenate([*arriving, np.zeros(0, ENTRY)]))
            arriving, size = [], 0
            if mode == "ask":
                found = shard.find(e)
                found = shard.stored[found[found >= 0]]
                yield from (_batch([at], STORED, [found[k : k + FOLD].tobytes()]) for k in range(0, len(found), FOLD))
            elif mode == "delete":
                shard.delete(e)
            else:
                shard.insert(e)

        def close() -> Iterator[pa.RecordBatch]:
            yield from meet()
            if mode != "ask" and len(shard.stored):
                yield _batch([at], FILTER, [bytes([shard.filter.bits]) + shard.filter.table.tobytes()])
                for k in range(0, len(shard.stored), FOLD):
                    yield _batch([at], STORED, [shard.stored[k : k + FOLD].tobytes()])

        for batch in batches:
            for k in range(batch.num_rows):
                number, kind, data = (batch.column(i)[k].as_py() for i in range(3))
                if number != at:
                    if at is not None:
                        yield from close()
                    at, filter_, shard, stored, arriving, size = number, None, None, [], [], 0
                if kind == FILTER:
                    filter_ = CuckooFilter(data[0])
                    filter_.table = np.frombuffer(data, np.uint16, offset=1).reshape(-1, SLOTS).copy()
                elif kind == STORED:
                    stored.append(np.frombuffer(data, ENTRY))
                else:
                    arriving.append(np.frombuffer(data, ENTRY))
                    size += len(arriving[-1])
                    if size > FOLD:
                        yield from meet()
        if at is not None:
            yield from close()

    return run


def digests(docs: DataFrame) -> DataFrame:
    """place, doc_id, chars, digest of every row, as a table: a row's place stays what it is when tasks run again."""
    text = text_or_empty()
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("chars"), F.unhex(F.sha2(bare, 256)).alias("digest"))
    return save(rows, "digests")


class CuckooIndex:
    """Live digests in a folder that all executors share, by version. One writer at a time."""

    VERSIONS = "version long, shards int, live long"

    def __init__(self, spark: SparkSession, folder: str, per_shard: int = PER_SHARD):
        self.spark, self.folder, self.per_shard = spark, folder.rstrip("/"), per_shard

    def state(self) -> tuple[int, int, int]:
        """version, shards and live digests; zeros of a new index."""
        try:
            found = self.spark.read.schema(self.VERSIONS).parquet(f"{self.folder}/versions").agg(F.max(F.struct("version", "shards", "live")).alias("v")).first()["v"]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = None
        return tuple(found) if found else (0, 1, 0)

    def _table(self, version: int) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/version={version}")

    def _met(self, rows: DataFrame, mode: str, shards: int) -> DataFrame:
        version, had, _ = self.state()
        stored = self._table(version)
        if shards != had:  # the stored keys are dealt anew, and filters made from them
            stored = stored.where(F.col("kind") == STORED).mapInArrow(_redeal(shards), SCHEMA)
        both = stored.unionByName(rows.select("digest", "chars", "doc_id", "place").mapInArrow(_pack(shards), SCHEMA))
        return both.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_work(mode), SCHEMA)

    def _change(self, rows: DataFrame, mode: str) -> None:
        version, had, live = self.state()
        most = live + (rows.count() if mode == "insert" else 0)
        shards = max(had, 1 << max(0, int(np.ceil(np.log2(max(1, most) / self.per_shard)))))
        self._met(rows, mode, shards).write.mode("overwrite").parquet(f"{self.folder}/version={version + 1}")
        sizes = self._table(version + 1).where(F.col("kind") == STORED).agg(F.coalesce(F.sum(F.length("data")), F.lit(0)).alias("n")).first()["n"]
        self.spark.createDataFrame([(version + 1, shards, sizes // ENTRY.itemsize)], self.VERSIONS).coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")

    def insert(self, rows: DataFrame) -> None:
        """Adds the rows of digests() to the live ones."""
        self._change(rows, "insert")

    def delete(self, rows: DataFrame) -> None:
        """Takes the digests of these rows out of the index, with all rows that they stood for."""
        self._change(rows, "delete")

    def _entries(self, packed: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column("data").to_pylist():
                    e = np.frombuffer(data, ENTRY)
                    words = np.stack([e[w] for w in WORDS], axis=1).astype(">u8").tobytes()
                    ids = pa.array(e["id"], pa.int64(), mask=e["null"] > 0)
                    names = ["key", "group_size", "keep_id", "keep_place"]
                    yield pa.RecordBatch.from_arrays([pa.array([words[k : k + 32] for k in range(0, len(words), 32)], pa.binary()), pa.array(e["n"]), ids, pa.array(e["place"])], names)

        return packed.where(F.col("kind") == STORED).select("data").mapInArrow(run, "key binary, group_size long, keep_id long, keep_place long")

    def live(self) -> DataFrame:
        """key (digest), group_size, keep_id, keep_place of every live digest."""
        return self._entries(self._table(self.state()[0]))

    def ask(self, rows: DataFrame) -> DataFrame:
        """As live(), of those digests of the rows that are live."""
        return self._entries(self._met(rows, "ask", self.state()[1]))


def exact_duplicates(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, from an index of all of them (a new one, unless `folder` has one)."""
    rows = digests(docs)
    index = CuckooIndex(docs.sparkSession, folder or scratch_path(docs.sparkSession, "cuckoo"))
    index.insert(rows)
    found = join_by_key(rows, index.live(), "digest", "key", "group_size", rows.count())
    return found.select("doc_id", "keep_id", "group_size", (F.col("place") == F.col("keep_place")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
