"""Alignment of two tokenizers' tokens over a corpus, by segments that are worked out once.

A text, with a space before it, is cut before each run of white space that begins with a space. No token of either vocabulary lies across such a cut,
which is checked when the files are read: the byte-level tokenizer's pre-tokens end before such a run after any character, and after a character that any
piece of the other tokenizer has before an inner space there is no cut. So a segment's tokens are the same in every text, and each cut ends a
token of both. Segments are numbered within blocks of texts where they are read; distinct segments are tokenised and aligned once for the
corpus, counts of id pairs are sums over them, and each block gets its own distinct segments back to compose its texts in order. What is
shuffled are a block's distinct segments and its texts' segment numbers, never a row for each word; a task holds one block's.
Counts of id pairs go to all tasks only if there are few enough of them (PAIRS), else they are joined.

Defined results: a null or empty text, and one whose tokens' bytes differ from it (it holds U+2581, or something that the normaliser
changes), has no tokens: zeros and ''; such texts add nothing to the counts. Repeated rows count as often as they stand; null ids are kept; a text without a cut is one segment and is
worked out by one task; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import join_by_key, save, slices, text_or_empty

BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Code points of a block; segments of a batch; id pairs that a task holds at most (17 bytes each).
BLOCK_CHARS, BATCH, PAIRS = 24_000_000, 10_000, 2_000_000
SPACE = "▁"
_loaded: dict = {}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(BYTE_FILE), public_tokenizers.path(PIECE_FILE)


def byte_letters() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable bytes as themselves, the others by the order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the lengths in bytes of their tokens, and the pattern of the cuts."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_path), sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        with open(byte_path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(map(letters.__getitem__, token))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        if sum(map(self.b.is_byte, range(len(pieces)))) != 256:
            raise ValueError("pieces without all bytes can't spell every text")
        inner = {p[k - 1] for p in pieces for k in range(1, len(p)) if p[k] in (SPACE, " ")} - {SPACE, " "}
        odd = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] in "ZC" and unicodedata.category(c) in ("Zs", "Zl", "Zp", "Cc", "Cf") and not c.isspace()]
        pre = self.a.pre_tokenizer.pre_tokenize_str
        inner |= {c for c in (*odd, *"a1.") if not any(start == 2 + len("a") - 1 for _, (start, _) in pre(f"a{c} b"))}
        self.cuts = re.compile(f" (?<=[^\\s{''.join(map(re.escape, sorted(inner)))}] )")
        self.lone = self.b.piece_to_id(SPACE)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))

    def spells(self, text: str) -> bool:
        """Whether the pieces of the text spell it: with all bytes among the pieces, whether the normaliser keeps it."""
        return bool(text) and self.b.normalize(text).replace(SPACE, " ") == " " + text

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizers of segments that are given without their first space."""
        a = [x.ids for x in self.a.encode_batch([" " + s for s in segments], add_special_tokens=False)]
        b = [x if s else [self.lone] for s, x in zip(segments, self.b.encode(segments, num_threads=1), strict=True)]
        return a, b


def tokenizers(byte_path: str, piece_path: str) -> Pair:
    """Read once in each worker."""
    if (byte_path, piece_path) not in _loaded:
        _loaded[byte_path, piece_path] = Pair(byte_path, piece_path)
    return _loaded[byte_path, piece_path]


def align(pair: Pair, segments: list[str]) -> tuple[dict[str, np.ndarray], list[np.ndarray], list[str]]:
    """Of segments: counts (n_a, n_b, n_groups, n_links), the linked ids (offsets, a, b) and the groups as text. All segments stand in one
    line of bytes, in which both tokenizers' tokens end together at each segment's end."""
    a, b = pair.encode(segments)
    na, nb = (np.array([len(x) for x in y]) for y in (a, b))
    a, b = (np.array([i for x in y for i in x], np.int64) for y in (a, b))
    end_a, end_b = np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b])
    cut_a, cut_b = np.cumsum(na), np.cumsum(nb)
    if not np.array_equal(end_a[cut_a - 1], end_b[cut_b - 1]) or b"".join(map(pair.a_bytes.__getitem__, a)) != b"".join(map(pair.b_bytes.__getitem__, b)):
        raise ValueError("the tokenizers spell a segment differently")
    start_a, start_b = end_a - pair.a_sizes[a], end_b - pair.b_sizes[b]
    # The tokens of B that overlap each token of A.
    low, high = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    n = high - low
    linked_a = np.repeat(np.arange(len(a)), n)
    linked_b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    both = np.intersect1d(end_a, end_b)
    upto_a, upto_b = np.searchsorted(end_a, both, "right"), np.searchsorted(end_b, both, "right")
    text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
    groups, i, j = [], 0, 0
    for p, q in zip(upto_a.tolist(), upto_b.tolist(), strict=True):
        groups.append(",".join(text_a[i:p]) + "|" + ",".join(text_b[j:q]))
        i, j = p, q
    ends = np.searchsorted(both, end_a[cut_a - 1], "right")
    links = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], cut_a])]
    counts = {"n_a": na, "n_b": nb, "n_groups": np.diff(ends, prepend=0), "n_links": np.diff(links)}
    begins = np.concatenate([[0], ends[:-1]])
    return counts, [links, a[linked_a], b[linked_b]], [";".join(groups[p:q]) for p, q in zip(begins.tolist(), ends.tolist(), strict=True)]


def packed(*columns: np.ndarray) -> bytes:
    """Whole numbers, deflated; the bytes of a number lie apart, since most of the high ones are 0."""
    return zlib.compress(b"".join(np.ascontiguousarray(c, dtype=f"<i{c.dtype.itemsize}").view(np.uint8).reshape(-1, c.dtype.itemsize).T.tobytes() for c in columns), 1)


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    n, at, out = len(raw) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k)[:, 0])
        at += n * size
    return out


def segment(docs: DataFrame, paths: tuple[str, str], block_chars: int = BLOCK_CHARS) -> DataFrame:
    """By blocks of texts: rows with `place` are the block's distinct segments (how often they occur, text), the others its documents (numbers of their
    segments in order; null without tokens)."""
    fields = ["block", "place", "n", "text", "doc_id", "parts"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary()]

    def rows(count: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f], t) if f in columns else pa.nulls(count, t) for f, t in zip(fields, types, strict=True)], fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(*paths)
        numbers: dict[str, int] = {}
        seen, chars, k = np.zeros(0, np.int32), 0, TaskContext.get().partitionId() << 32

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal seen, chars, k
            texts = list(numbers)
            for at in range(0, len(texts), BATCH):
                some = texts[at : at + BATCH]
                yield rows(len(some), block=[k] * len(some), place=range(at, at + len(some)), n=seen[at : at + len(some)], text=some)
            numbers.clear()
            seen, chars, k = np.zeros(0, np.int32), 0, k + 1

        for batch in batches:
            for part in slices(batch, "text"):
                kept = []
                for text in part.column("text").to_pylist():
                    if not pair.spells(text):
                        kept.append(None)
                        continue
                    segments = pair.cuts.split(text)
                    at = np.fromiter((numbers.setdefault(s, len(numbers)) for s in segments), np.int32, len(segments))
                    if len(numbers) > len(seen):
                        seen = np.concatenate([seen, np.zeros(2 * len(numbers), np.int32)])
                    np.add.at(seen, at, 1)
                    kept.append(packed(at))
                    chars += len(text)
                yield rows(len(kept), block=[k] * len(kept), doc_id=part.column("doc_id"), parts=kept)
                if chars > block_chars:
                    yield from close()
        yield from close()

    schema = "block long, place int, n int, text string, doc_id long, parts binary"
    return save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema), "segments")


def aligned(segments: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Each distinct segment of the corpus: id, n (occurrences), counts, linked ids (a, b), groups, and where it stands (blocks, places). A
    segment whose rows are spread over two batches gives two rows, which changes no sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = tokenizers(*paths), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                starts = [k for k in range(len(texts)) if not k or texts[k] != texts[k - 1]]
                counts, (links, a, b), groups = align(pair, [texts[k] for k in starts])
                n = np.add.reduceat(part.column("n").to_numpy().astype(np.int64), starts)
                lists = [pa.ListArray.from_arrays(pa.array(links, pa.int32()), pa.array(x, pa.int32())) for x in (a, b)]
                ends = pa.array([*starts, len(texts)], pa.int32())
                where = [pa.ListArray.from_arrays(ends, part.column(c)) for c in ("block", "place")]
                ids = pa.array(np.arange(number, number + len(starts)))
                number += len(starts)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), *(pa.array(x, pa.int32()) for x in counts.values()), *lists, pa.array(groups), *where], ["id", "n", *counts, "a", "b", "groups", "blocks", "places"])

    rows = segments.where("place IS NOT NULL").select("text", "n", "block", "place").repartition("text").sortWithinPartitions("text")
    return save(rows.mapInArrow(run, "id long, n long, n_a int, n_b int, n_groups int, n_links int, a array<int>, b array<int>, groups string, blocks array<long>, places array<int>"), "aligned")


def pair_counts(distinct: DataFrame) -> DataFrame:
    """pair (a * 2**32 + b), count (links of the corpus), best (whether no other pair of b has more), rows (segments' links)."""
    linked = distinct.select("n", F.explode(F.arrays_zip("a", "b")).alias("l")).select("n", "l.a", "l.b")
    counts = linked.groupBy("a", "b").agg(F.sum("n").alias("count"), F.count("*").alias("rows"))
    best = F.col("count") == F.max("count").over(Window.partitionBy("b"))  # as many rows as A has ids at most
    return save(counts.select((F.col("a").cast("long") * 2**32 + F.col("b")).alias("pair"), "count", best.alias("best"), "rows"), "pairs")


def with_sums(distinct: DataFrame, counts: DataFrame, most: int = PAIRS) -> DataFrame:
    """distinct with n_best and count_sum. Up to `most` id pairs are looked up in each task; more are joined."""
    if counts.count() > most:
        links = distinct.select("id", F.explode(F.arrays_zip("a", "b")).alias("l")).select("id", (F.col("l.a").cast("long") * 2**32 + F.col("l.b")).alias("of"))
        total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
        met = join_by_key(links, counts, "of", "pair", "rows", total)
        sums = met.groupBy("id").agg(F.count_if("best").cast("int").alias("n_best"), F.sum("count").alias("count_sum"))
        return distinct.drop("a", "b").join(sums, "id")
    table = counts.select("pair", "count", "best").orderBy("pair").toArrow()
    known = counts.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "count", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, count, best = known.value
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            at = np.searchsorted(pairs, (a.flatten().to_numpy().astype(np.int64) << 32) + b.flatten().to_numpy())
            starts = a.offsets.to_numpy()[:-1] - a.offsets[0].as_py()  # a segment has a link at least
            sums = [pa.array(np.add.reduceat(x[at].astype(np.int64), starts), t) if batch.num_rows else pa.array([], t) for x, t in ((best, pa.int32()), (count, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *sums], [*kept, "n_best", "count_sum"])

    kept = ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "blocks", "places"]
    return distinct.select(*kept, "a", "b").mapInArrow(run, "id long, n_a int, n_b int, n_groups int, n_links int, groups string, blocks array<long>, places array<int>, n_best int, count_sum long")


NUMBERS = {"n_a": "i4", "n_b": "i4", "n_groups": "i4", "n_links": "i4", "n_best": "i4", "count_sum": "i8"}


def back(distinct: DataFrame) -> DataFrame:
    """The segments of each block, many in a row: block, kind 0, numbers, groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, places = batch.column("blocks"), batch.column("places")
            row = np.repeat(np.arange(batch.num_rows), np.diff(blocks.offsets.to_numpy()))
            block, place = blocks.flatten().to_numpy(), places.flatten().to_numpy()
            order = np.argsort(block, kind="stable")
            row, block, place = row[order], block[order], place[order]
            values, groups = [batch.column(c).to_numpy() for c in NUMBERS], batch.column("groups").to_pylist()
            starts = np.flatnonzero(np.diff(block, prepend=-1))
            numbers, texts = [], []
            for at, own in zip(np.split(place, starts[1:]), np.split(row, starts[1:]), strict=True):
                numbers.append(packed(at, *(v[own] for v in values)))
                texts.append(zlib.compress("\n".join([groups[k] for k in own.tolist()]).encode(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array([0] * len(starts), pa.int32()), pa.array(numbers, pa.binary()), pa.array(texts, pa.binary())], ["block", "kind", "data", "groups"])

    return distinct.select(*NUMBERS, "groups", "blocks", "places").mapInArrow(run, "block long, kind int, data binary, groups binary")


def align_documents(docs: DataFrame, paths: tuple[str, str] | None = None, block_chars: int = BLOCK_CHARS, pairs: int = PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    paths = paths or default_paths()
    segments = segment(docs, paths, block_chars)
    distinct = aligned(segments, paths)
    known = back(with_sums(distinct, pair_counts(distinct), pairs)).withColumn("doc_id", F.lit(None).cast("long"))
    texts = segments.where("place IS NULL").select("block", F.lit(1).alias("kind"), F.col("parts").alias("data"), F.lit(None).cast("binary").alias("groups"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, table, text = None, [], None, []
        for batch in batches:
            ids, out, digests = [], [], []
            for k in range(batch.num_rows):
                block, kind, data, groups = (batch.column(c)[k].as_py() for c in range(4))
                if block != at:
                    at, found, table, text = block, [], None, []
                if kind == 0:  # a block's segments come first
                    found.append(unpacked(data, "<i4", *(f"<{t}" for t in NUMBERS.values())))
                    text += zlib.decompress(groups).decode().split("\n")
                    continue
                ids.append(batch.column("doc_id")[k].as_py())
                if data is None:
                    out.append(np.zeros(len(NUMBERS), np.int64))
                    digests.append("")
                    continue
                if table is None:
                    order = np.argsort(np.concatenate([x[0] for x in found]))
                    table = np.concatenate([np.stack([c.astype(np.int64) for c in x[1:]], axis=1) for x in found])[order]
                    text = [text[j] for j in order.tolist()]
                parts = unpacked(data, "<i4")[0]
                out.append(table[parts].sum(axis=0))
                digests.append(hashlib.sha256(";".join(map(text.__getitem__, parts.tolist())).encode()).hexdigest())
            values = np.array(out, np.int64).reshape(-1, len(NUMBERS))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(values[:, j]) for j in range(len(NUMBERS))), pa.array(digests, pa.string())], ["doc_id", *NUMBERS, "groups_sha256"])

    both = known.unionByName(texts).repartition("block").sortWithinPartitions("block", "kind")
    return both.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
