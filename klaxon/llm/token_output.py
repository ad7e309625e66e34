"""Token ids as Simple-8b words: each 64-bit word has a 4-bit selector and packs as many ids as fit in equal fields of the other
60 bits. Ids lie in blocks of BLOCK; every file has a table of block offsets, so blocks are decoded apart, and all blocks of a
file at once, a word of each in every step.

A file: the magic, then little-endian unsigned 64-bit integers: ids, blocks, documents; the offset of each block in words (and
the number of words); words of escaped ids; the packed words; the document table, doc_id (signed) and number of ids for each document.
An id of 2**60 or more can't be packed: its place holds 0, and the escapes list its place and value.

Files are written in ascending doc_id order by range partitions; Spark's commit of their list makes a file count, so tasks that ran
twice or were lost leave at most files that nothing refers to. Defined results: a null text counts as empty; null ids come first and
are read back as null; rows that tie on doc_id and text are equal, and repeated rows are kept; a very long text is encoded whole, in one task;
the strings of the tokenizer's added tokens are those tokens, as the library has it; an empty table gives no files and an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import save, scratch_path, slices, text_or_empty

MAGIC = b"KLX8B\x00\x00\x01"
BLOCK = 1024
#: Ids of a word and bits of an id, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_limits = np.array([(1 << int(b)) - 1 for b in BITS], dtype=np.uint64)
_needs = np.searchsorted(_limits, np.arange(1 << 16, dtype=np.uint64)).astype(np.uint8)
TOKENIZER, END_ID = "word_bpe_49k.json", 2
#: The most tasks that read files; up to it, one a file.
MOST_READERS = 20_000


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, offset of each block in words and at last their number, escapes as place and value)."""
    ids = np.asarray(ids, dtype=np.uint64)
    big = np.flatnonzero(ids >> np.uint64(60))
    escapes = np.stack([big.astype(np.uint64), ids[big]], axis=1) if len(big) else np.zeros((0, 2), np.uint64)
    if len(big):
        ids = ids.copy()
        ids[big] = 0
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64), escapes
    # The least selector whose fields hold each id; rising selectors have wider fields and fewer of them.
    need = _needs[ids] if ids.max() < len(_needs) else np.searchsorted(_limits, ids).astype(np.uint8)
    padded = np.zeros(blocks * BLOCK + 60, np.uint8)
    padded[:n] = need
    best = np.full(blocks * BLOCK, 13, np.uint8)
    for s in range(12, -1, -1):  # a word holds COUNTS[s] ids from here if none of them needs more
        width, span, most = int(COUNTS[s]), 1, padded
        while span * 2 <= width:
            most, span = np.maximum(most[: len(most) - span], most[span:]), span * 2
        most = np.maximum(most[: len(best)], most[width - span : width - span + len(best)])
        fits = most <= s
        if not fits.any():
            break
        best[fits] = s
    # Every block takes its next word in each step.
    at, ends = np.arange(blocks) * BLOCK, np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    begins = np.zeros(blocks * BLOCK, bool)
    while len(at):
        begins[at] = True
        at = at + COUNTS[best[at]]
        live = at < ends
        at, ends = at[live], ends[live]
    starts = np.flatnonzero(begins)
    selectors = best[starts]
    words = selectors.astype(np.uint64) << np.uint64(60)
    # A block's last word may run into the next block: it then holds that block's own ids, which fit, as `best` looked at them.
    full = np.zeros(blocks * BLOCK + 60, np.uint64)
    full[:n] = ids
    for s in np.flatnonzero(np.bincount(selectors)):
        mine = np.flatnonzero(selectors == s)
        place, packed = starts[mine], np.zeros(len(mine), np.uint64)
        for j in range(int(COUNTS[s])):
            packed |= full[place + j] << np.uint64(j * int(BITS[s]))
        words[mine] |= packed
    offsets = np.searchsorted(starts, np.arange(blocks + 1) * BLOCK).astype(np.uint64)
    return words, offsets, escapes


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """All ids. Words are grouped by selector and their fields unpacked at once; a word's first place is the sum of the counts
    before it in its block."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    before = np.cumsum(counts) - counts
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets).astype(np.int64))
    starts = before - before[offsets[:-1].astype(np.int64)][block] + block * BLOCK
    out = np.zeros((len(offsets) - 1) * BLOCK + 60, np.uint64)
    for s in np.flatnonzero(np.bincount(selector)):
        mine = np.flatnonzero(selector == s)
        place, held = starts[mine], words[mine]
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(int(COUNTS[s])):
            out[place + j] = (held >> np.uint64(j * int(BITS[s]))) & mask
    out = out[:n]
    if len(escapes):
        out[escapes[:, 0].astype(np.int64)] = escapes[:, 1]
    return out


def file_bytes(ids: np.ndarray, doc_ids: np.ndarray, has_id: np.ndarray, lengths: np.ndarray) -> bytes:
    words, offsets, escapes = pack(ids)
    head = np.array([len(ids), len(offsets) - 1, len(doc_ids), len(escapes)], dtype="<u8")
    table = np.stack([doc_ids.astype("<i8").view("<u8"), lengths.astype("<u8") << np.uint64(1) | has_id.astype("<u8")], axis=1)
    return b"".join([MAGIC, *(x.astype("<u8").tobytes() for x in (head, offsets, escapes, words, table))])


def read_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, doc_ids, has_id, lengths)."""
    if data[:8] != MAGIC:
        raise ValueError("no file of this format")
    body = np.frombuffer(data, dtype="<u8", offset=8)
    n, blocks, docs, escaped = map(int, body[:4])
    offsets, at = body[4 : 5 + blocks], 5 + blocks
    escapes, at = body[at : at + 2 * escaped].reshape(-1, 2), at + 2 * escaped
    words, at = body[at : at + int(offsets[-1])], at + int(offsets[-1])
    table = body[at : at + 2 * docs].reshape(-1, 2)
    return unpack(words, offsets, escapes, n), table[:, 0].copy().view("<i8"), (table[:, 1] & np.uint64(1)).astype(bool), (table[:, 1] >> np.uint64(1)).astype(np.int64)


class WordIds(dict):
    """Ids of words by the tokenizers library, each worked out once while the table holds it. The tokenizer drops white space and
    parts letters and digits from the marks after them, so a text can be parted there: into what white space parts, and in that, letters
    and digits from ASCII marks (but the apostrophe) that end it. Once there are more than `most` words, those that were met
    once are dropped, and all if most were met more often."""

    part = re.compile(r"[^\W_]+(?=[!-&(-/:-@\[-`{-~]*(?:[ \t\n\r]|\Z))|[^ \t\n\r]+")
    marks = re.compile(r"[!-&(-/:-@\[-`{-~]+")

    def __init__(self, path: str, most: int = 600_000):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.most = most
        added = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile(f"({'|'.join(map(re.escape, added))})") if added else None
        vocabulary = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.ids = np.zeros(1 << 17, np.uint16 if len(self.ends_word) <= 1 << 16 else np.uint32)
        self.used = 0
        self.waiting: list[str] = []
        self.first, self.size, self.seen = (np.zeros(1 << 16, np.int32) for _ in range(3))

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.waiting.append(word)
        return n

    def prune(self) -> None:
        n = len(self)
        keep = np.flatnonzero(self.seen[:n] > 1)
        if len(keep) > self.most // 2:
            keep = keep[:0]
        words = list(self)
        words = [words[k] for k in keep.tolist()]
        sizes, first = self.size[keep], self.first[keep]
        self.clear()
        self.update(zip(words, range(len(words)), strict=True))
        ids = self._gather(first, sizes)
        self.ids[: len(ids)], self.used = ids, len(ids)
        self.size[: len(keep)], self.first[: len(keep)], self.seen[: len(keep)] = sizes, np.cumsum(sizes) - sizes, 1

    def _gather(self, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ends = np.cumsum(sizes, dtype=np.int64)
        return self.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)]

    def _encode(self, plain: list[str], other: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each word has). Each of `plain` is one pre-token, which ends with the one id of it that ends a word: all are
        encoded as one text and parted there, if the numbers agree."""
        parts = []
        if plain:
            ids = np.array(self.library.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, dtype=self.ids.dtype)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(plain) and ends[-1] == len(ids):
                parts.append((ids, np.diff(ends, prepend=0)))
            else:
                parts.append(self._encode([], plain))
        found = [e.ids for e in self.library.encode_batch_fast(other, add_special_tokens=False)] if other else []
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        parts.append((np.fromiter((i for x in found for i in x), self.ids.dtype, int(sizes.sum())), sizes))
        return tuple(np.concatenate([p[k] for p in parts]) for k in (0, 1))

    def settle(self) -> None:
        """Encodes the words that were met for the first time."""
        if not self.waiting:
            return
        n, begun = len(self), len(self) - len(self.waiting)
        is_plain = np.fromiter((w.isalpha() or self.marks.fullmatch(w) is not None for w in self.waiting), bool, len(self.waiting))
        plain = [w for w, x in zip(self.waiting, is_plain.tolist(), strict=True) if x]
        ids, sizes = self._encode(plain, [w for w, x in zip(self.waiting, is_plain.tolist(), strict=True) if not x])
        order = begun + np.concatenate([np.flatnonzero(is_plain), np.flatnonzero(~is_plain)])
        while n > len(self.first):
            self.first, self.size, self.seen = (np.resize(x, 2 * len(x)) for x in (self.first, self.size, self.seen))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.first[order], self.size[order], self.seen[begun:n] = self.used + np.cumsum(sizes) - sizes, sizes, 0
        self.used += len(ids)
        self.waiting = []

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; how many each has)."""
        if len(self) > self.most:
            self.prune()
        get, words = self.__getitem__, []

        def find(text: str) -> list[str]:
            low = text.lower()
            # The tokenizer composes (NFC), then lowers letter by letter; where that is what str.lower() did, lower texts share words.
            if "\u03a3" not in text and is_normalized("NFC", text) and is_normalized("NFC", low) and not (self.added and self.added.search(low)):
                text = low
            return self.part.findall(text)

        for text in texts:
            if self.added and self.added.search(text):
                # The library cuts a text at its added tokens first; each is one id, and what is between is a text of its own.
                parts = [w for k, x in enumerate(self.added.split(text)) for w in ([x] if k % 2 else find(x))]
            else:
                parts = find(text)
            words.append(np.fromiter(map(get, parts), np.int32, len(parts)))
        self.settle()
        counts = np.fromiter(map(len, words), np.int64, len(words))
        every = np.concatenate(words) if words else np.zeros(0, np.int32)
        np.add(self.seen[: len(self)], np.bincount(every, minlength=len(self)), out=self.seen[: len(self)], casting="unsafe")
        sizes = self.size[every]
        ids = self._gather(self.first[every], sizes)
        upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[np.cumsum(counts)]
        return np.insert(ids, upto, end_id), np.diff(upto, prepend=0) + 1


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def write(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, *, file_ids: int = 4_000_000) -> DataFrame:
    """Sorts the texts by doc_id over range partitions, and in the same pass encodes them and writes the files; returns their list:
    part, file_no, path, n_ids, n_docs, n_bytes, folder. (part, file_no) is in doc_id order."""
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    folder = scratch_path(spark, "token-ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]  # the second parts rows of one id, if there are very many

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, no, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            ids, doc_ids, lengths = (np.concatenate([x[k] for x in held]) for k in (0, 1, 3))
            data = file_bytes(ids, doc_ids, np.concatenate([x[2] for x in held]), lengths)
            path = f"part-{part:06d}-{no:06d}-{uuid.uuid4().hex}.s8b"
            with store.open_output_stream(f"{base}/{path}", compression=None) as f:
                f.write(data)
            values = {"part": part, "file_no": no, "path": path, "n_ids": len(ids), "n_docs": len(lengths), "n_bytes": len(data)}
            return pa.RecordBatch.from_pylist([values], schema=_files)

        for batch in batches:
            for rows in slices(batch, "text", 2 << 20):
                ids, lengths = word_ids(tokenizer).encode(rows.column("text").to_pylist(), end_id)
                column = rows.column("doc_id")
                held.append((ids, column.fill_null(0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False), lengths))
                size += len(ids)
                if size >= file_ids:
                    yield flush()
                    held, size, no = [], 0, no + 1
        if held:
            yield flush()

    files = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, "part int, file_no int, path string, n_ids long, n_docs long, n_bytes long")
    return save(files.withColumn("folder", F.lit(folder)), "token-files")


_files = pa.schema([("part", pa.int32()), ("file_no", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("n_bytes", pa.int64())])


def starts(files: DataFrame) -> DataFrame:
    """files with `start`, the ids of all files before. Sums by part first: what one task numbers is a row for each partition of
    the writer, and a part's files are numbered apart."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return files.join(parts, "part").withColumn("start", F.col("part_start") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))


def read_back(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                store, base = fs.FileSystem.from_uri(row["folder"])
                with store.open_input_file(f"{base}/{row['path']}") as f:
                    ids, doc_ids, has_id, lengths = read_file(f.read())
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64(), mask=~has_id), pa.array(row["start"] + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    parts = max(1, min(MOST_READERS, files.count()))
    listed = starts(files).select("folder", "path", "start")
    return listed.repartition(parts, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_of_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return read_back(write(docs, tokenizer))
