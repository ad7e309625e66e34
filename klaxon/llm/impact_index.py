"""Ranked lexical search over a bit-sliced impact index.

Documents are dealt into blocks where they are read, and indexed there. A block's postings of a term are one row of the index: the places of its documents in the
block, and their shares (the document's part of an impact, a whole number) as bit slices, one bitmap for each bit. A term's weight comes from all documents, so a
search counts it and multiplies the shares by it; then it deals the rows of the items' terms out by block and chunk of items, and a task adds
their slices into the items' sums by carry arithmetic on whole words, for all documents of the block at once, and finds the best K from the most significant slice down.
What a task holds is one term's row and CHUNK sums; the items themselves are never in one place, and a block gives at most K rows for each item.

Terms are the maximal runs of characters that are neither ASCII white space, control nor punctuation; only A-Z are lower-cased. With N documents
that have terms, L terms in all, n terms of a document, df documents of a term and tf of it in one: m = 25 + (75 n N) div L,
share = (10**9 tf) div (1000 tf + 8 m), weight = floor(1000 ln((2 N + 2) / (2 df + 1))). A score is the sum of weight * share over an item's terms, repeats included.

Defined results: a null or empty text has no terms, so it is never found and, as an item, finds nothing; ties go by ascending doc_id, nulls
last, then by place; repeated rows are documents of their own; items that repeat id and text are one, those that share an id alone are ranked apart; very long texts are read whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import save, slices, text_or_empty

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Each byte of UTF-8 as a term has it, or as a space: what ends a term is always one byte.
FOLD = bytes(k + 32 if 65 <= k <= 90 else k if k > 127 or chr(k).isalnum() else 32 for k in range(256))
#: Documents of a block at most, and code points after which it is closed; items of a chunk; results of an item; bits of a share, which is below 10**6.
BLOCK, BLOCK_CHARS, CHUNK, K, BITS = 65_536, 24_000_000, 32, 10, 20
INDEX = "block string, term string, df long, docs binary, slices binary"


def shares(tf: np.ndarray, n: np.ndarray, filled: int, total: int) -> np.ndarray:
    """A document's share for a term that it holds tf times among its n terms."""
    m = 25 + 75 * n * filled // max(1, total)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An array of bytes: values in pieces that end at the given places."""
    offsets = np.concatenate([[0], ends]).astype(np.int32) * values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def sliced(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Bit slices of the numbers of each piece: a row of BITS bytes for every eight numbers, in which byte k has bit k of the eight."""
    sizes = np.diff(ends, prepend=0)
    bytes_ = -(-sizes // 8)
    last = np.cumsum(bytes_)
    wide = np.zeros(8 * int(bytes_.sum()), np.int64)
    wide[np.arange(len(values)) + np.repeat(8 * (last - bytes_) - (ends - sizes), sizes)] = values
    planes = np.stack([np.packbits((wide >> k & 1).astype(np.uint8)) for k in range(BITS)], axis=1)
    return cut(planes, last)


def terms_of(text: str) -> list[bytes]:
    """The matches of TERM, lower-cased, in UTF-8."""
    return text.encode().translate(FOLD).split()


def totals(docs: DataFrame) -> tuple[int, int]:
    """N, the documents that have terms, and L, their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(terms_of(t)) for part in slices(batch, "text") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in n)], pa.int64()), pa.array([sum(n)], pa.int64())], ["filled", "total"])

    n = docs.select(text_or_empty().alias("text")).mapInArrow(run, "filled long, total long")
    found = n.agg(F.coalesce(F.sum("filled"), F.lit(0)).alias("N"), F.coalesce(F.sum("total"), F.lit(0)).alias("L")).first()
    return found["N"], found["L"]


def build(docs: DataFrame, block: int = BLOCK, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, int]:
    """The index, as a table, and N. A row for each block and term: how many documents of the block hold it, their places in the block
    (2 bytes each) and the bit slices of their shares. A row without a term has the block's doc_ids (8 bytes each) and a mask of nulls."""
    filled, total = totals(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        terms, tfs, sizes, ids, nulls, chars, k = [], [], [], [], [], 0, 0
        fields = ["block", "term", "df", "docs", "slices"]

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal chars, k
            name = f"{TaskContext.get().partitionId()}-{k}"
            n = np.array(sizes, np.int64)
            doc = np.repeat(np.arange(len(terms)), [len(x) for x in terms])
            term = np.concatenate([*terms, np.zeros(0, np.int64)])
            order = np.argsort(term, kind="stable")
            term, doc, tf = term[order], doc[order], np.concatenate([*tfs, np.zeros(0, np.int64)])[order]
            share, ends, names = shares(tf, n[doc], filled, total), np.cumsum(np.bincount(term, minlength=len(numbers))), [t.decode() for t in numbers]
            for at in range(0, len(names), 20_000):  # terms are numbered from 0, so the k-th piece is that of the k-th name
                some = ends[at : at + 20_000]
                low, high = ends[at - 1] if at else 0, some[-1]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(names[at : at + 20_000]), pa.array(np.diff(some, prepend=low)), cut(doc[low:high].astype("<u2"), some - low), sliced(share[low:high], some - low)], fields)
            own = [pa.array([x.tobytes()], pa.binary()) for x in (np.array(ids, "<i8"), np.array(nulls, "u1"))]
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([None], pa.string()), pa.array([0], pa.int64()), *own], fields)
            for x in (numbers, terms, tfs, sizes, ids, nulls):
                x.clear()
            chars, k = 0, k + 1

        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    found = Counter(terms_of(text))
                    terms.append(np.fromiter((numbers.setdefault(t, len(numbers)) for t in found), np.int64, len(found)))
                    tfs.append(np.fromiter(found.values(), np.int64, len(found)))
                    sizes.append(found.total())
                    ids.append(doc_id or 0)
                    nulls.append(doc_id is None)
                    chars += len(text)
                    if len(ids) == block or chars > block_chars:
                        yield from close()
        if ids:
            yield from close()

    return save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, INDEX), "impacts"), filled


def added(total: np.ndarray, words: np.ndarray, addend: np.ndarray) -> None:
    """Adds slices to the slices `total` in the given words of its bitmaps: a full adder over the bits, then the carry upwards."""
    carry = np.zeros(len(words), np.uint64)
    for s in range(len(total)):
        x = total[s, words]
        if s < len(addend):
            y = addend[s]
            half = x ^ y
            total[s, words], carry = half ^ carry, (x & y) | (carry & half)
        elif carry.any():
            total[s, words], carry = x ^ carry, x & carry
        else:
            return


def best(total: np.ndarray, k: int, doc_ids: np.ndarray, nulls: np.ndarray) -> list[tuple[int, int]]:
    """(place, score) of the k highest sums above 0, of ties at the last one those of lowest (null, doc_id, place)."""
    sure, open_ = np.zeros_like(total[0]), np.bitwise_or.reduce(total, axis=0)
    count = lambda x: int(np.bitwise_count(x).sum())
    for s in reversed(range(len(total))):
        with_bit = open_ & total[s]
        if count(sure | with_bit) > k:
            open_ = with_bit
        else:
            sure, open_ = sure | with_bit, open_ & ~total[s]
    places = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    ties = places(open_)
    ties = ties[np.lexsort((ties, doc_ids[ties], nulls[ties]))][: k - count(sure)]
    found = np.concatenate([places(sure), ties])
    bits = (total[:, found >> 6] >> (found & 63).astype(np.uint64)) & np.uint64(1)
    scores = (bits.astype(np.int64) << np.arange(len(total))[:, None]).sum(axis=0)
    return list(zip(found.tolist(), scores.tolist(), strict=True))


def expanded(docs: bytes, slices_: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A term's places, the words of the block's bitmaps that they lie in, and its shares as whole numbers."""
    places = np.frombuffer(docs, "<u2").astype(np.int64)
    bits = np.unpackbits(np.frombuffer(slices_, np.uint8).reshape(-1, BITS).T, axis=1)[:, : len(places)]
    return places, np.unique(places >> 6), (bits.astype(np.int64) << np.arange(BITS)[:, None]).sum(axis=0)


def weighted(places: np.ndarray, words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Numbers at places as bit slices over words."""
    wide = np.zeros(len(words) * 64, np.int64)
    wide[np.searchsorted(words, places >> 6) * 64 + (places & 63)] = values
    bits = wide >> np.arange(int(values.max()).bit_length())[:, None] & 1
    return np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)


def search(index: DataFrame, filled: int, items: DataFrame, k: int = K, chunk: int = CHUNK) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents."""
    text = F.translate(text_or_empty(), UPPER, LOWER)
    own = items.select(F.col("item_id").alias("item_id"), F.sha2(text_or_empty(), 256).alias("key"), text.alias("text")).distinct()
    found = own.select("item_id", "key", F.explode(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).alias("term"))
    found = save(found.groupBy("item_id", "key", "term").agg(F.count("*").alias("times")), "items")
    df = index.select("term", "df").join(found.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(filled) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    # Chunks of about `chunk` items by hash, so none of them needs a number.
    chunks = max(1, own.count() // chunk)
    of = F.pmod(F.xxhash64("item_id", "key"), F.lit(chunks))
    uses = found.join(df, "term").select("term", of.alias("chunk"), F.struct("item_id", "key", (F.col("times") * weight).alias("weight")).alias("use")).where("use.weight > 0")
    uses = save(uses.groupBy("term", "chunk").agg(F.collect_list("use").alias("uses")), "uses")
    met = index.where("term IS NOT NULL").join(uses, "term").select("block", "chunk", F.lit(1).alias("kind"), "docs", "slices", "uses")
    # Each block meets each chunk of items.
    heads = index.where("term IS NULL").withColumn("chunk", F.explode(F.expr(f"sequence(0L, {chunks - 1}L)")))
    none = F.lit(None).cast(met.schema["uses"].dataType)
    heads = heads.select("block", "chunk", F.lit(0).alias("kind"), "docs", "slices", none.alias("uses"))
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, nulls, sums, out = None, None, None, {}, []

        def close() -> None:
            for (item, key), total in sums.items():
                out.extend((item, key, None if nulls[p] else int(ids[p]), score) for p, score in best(total, k, ids, nulls))

        def made() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (arrow, pa.string(), pa.int64(), pa.int64()), strict=True)], ["item_id", "key", "doc_id", "score"])

        for batch in batches:
            arrow = batch.schema.field("uses").type.value_type.field("item_id").type
            for j in range(batch.num_rows):
                block, part, head, docs, planes, used = (batch.column(c)[j].as_py() for c in range(6))
                if (block, part) != at:
                    close()
                    at, sums = (block, part), {}
                if head == 0:
                    ids, nulls = np.frombuffer(docs, "<i8"), np.frombuffer(planes, "u1")
                    continue
                places, words, share = expanded(docs, planes)
                made_for: dict[int, np.ndarray] = {}
                for use in used:
                    if (w := use["weight"]) not in made_for:
                        made_for[w] = weighted(places, words, w * share)
                    key = (use["item_id"], use["key"])
                    if key not in sums:
                        sums[key] = np.zeros((63, -(-len(ids) // 64)), np.uint64)
                    added(sums[key], words, made_for[w])
            if len(out) > 5_000:
                yield made()
                out.clear()
        close()
        if out:
            yield made()

    tops = met.unionByName(heads).repartition("block", "chunk").sortWithinPartitions("block", "chunk", "kind").mapInArrow(run, f"item_id {kind}, key string, doc_id long, score long")
    # Spark keeps the first k rows of each item in every task before it deals them out, so an item's window holds k rows of each.
    rank = F.row_number().over(Window.partitionBy("item_id", "key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return tops.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the K best documents of each item."""
    return search(*build(docs), items)
