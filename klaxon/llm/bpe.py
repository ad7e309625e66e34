"""Byte-level BPE by ranks, as overlapping chunks: a long text is cut into chunks that overlap, each chunk is pre-tokenised on
its own, neighbours are stitched where their pre-token boundaries meet again, and the pieces between stitches are encoded in
parallel. Decoding joins the bytes of the ids.

Why stitching is right: the pattern looks ahead but never back, so from a true boundary on, matching gives true boundaries.
The first chunk begins at one; where a chunk has a boundary in common with its (true) left neighbour, all its later ones are
true too. The last matches before a chunk's end, which more text could change, are not counted. Where two chunks don't meet
within the overlap, both become one piece, and pre-tokenisation inside the piece finds its boundaries from its true start.

Defined results: a null text counts as empty and has no tokens; null ids and repeated rows are kept, and rows that tie on id and text are
equal; a text of one chunk is encoded where it is, a longer one chunk by chunk, its ids being joined in one task; from a seam that fails
on, a text is one piece (512 code points without a common boundary, as in a run of one kind of character); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import slices, text_or_empty

#: Code points of a chunk before the overlap, and of the overlap.
CHUNK, OVERLAP = 32_768, 512
RANKS = "byte_bpe_multi_50k.tiktoken"

_loaded: dict = {}


def encoder(ranks_path: str, pattern: str):
    """(tiktoken encoding, pattern, bytes of each id), read once in each worker."""
    if (ranks_path, pattern) not in _loaded:
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[ranks_path, pattern] = (
            tiktoken.Encoding("klaxon", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}),
            regex.compile(pattern),
            {v: k for k, v in ranks.items()},
        )
    return _loaded[ranks_path, pattern]


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def _ids(text: str, ranks_path: str, pattern: str) -> np.ndarray:
    """The ids of a piece that begins and ends at true boundaries. Lone surrogates can't occur in Spark's strings."""
    return np.array(encoder(ranks_path, pattern)[0].encode_ordinary(text), dtype="<u4")


def decode(ids: np.ndarray, ranks_path: str, pattern: str) -> bytes:
    return b"".join(map(encoder(ranks_path, pattern)[2].__getitem__, ids.tolist()))


def encode_short(df: DataFrame, ranks_path: str, pattern: str, keep_ids: bool) -> DataFrame:
    """Texts of one chunk: encoded where they are, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = [_ids(t, ranks_path, pattern) for t in part.column("text").to_pylist()]
                yield _rows(part.column("doc_id"), out, ranks_path, pattern, keep_ids)

    return df.select("doc_id", "text").mapInArrow(run, _schema(keep_ids))


def _schema(keep_ids: bool) -> str:
    return "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids


def _rows(doc_ids, out: list[np.ndarray], ranks_path: str, pattern: str, keep_ids: bool) -> pa.RecordBatch:
    columns = {
        "doc_id": pa.array(doc_ids, pa.int64()),
        "n_tokens": pa.array([len(x) for x in out], pa.int64()),
        "ids_sha256": pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in out], pa.string()),
        "decoded_sha256": pa.array([hashlib.sha256(decode(x, ranks_path, pattern)).hexdigest() for x in out], pa.string()),
    }
    if keep_ids:
        columns["ids"] = pa.array([x.tobytes() for x in out], pa.binary())
    return pa.RecordBatch.from_pydict(columns)


def boundaries(text: str, pattern: str, ranks_path: str, last: bool) -> np.ndarray:
    """Where pre-tokens begin. Text that no match covers is no pre-token, as in tiktoken. If text goes on after this chunk, the
    last two matches are not counted: the text after them could change them."""
    found = [m.start() for m in encoder(ranks_path, pattern)[1].finditer(text)]
    return np.array(found if last else found[:-2], dtype=np.int64)


def encode_long(df: DataFrame, ranks_path: str, pattern: str, keep_ids: bool, chunk: int, overlap: int) -> DataFrame:
    """Texts of several chunks. Rows are keyed by content (id and text), so a task that runs again gives the same keys; equal
    rows are encoded once and counted."""
    whole = df.groupBy("doc_id", F.sha2("text", 256).alias("key")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    n = F.ceil(F.length("text") / chunk)
    chunks = whole.select("doc_id", "key", "copies", "text", n.alias("n"), F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("no"))
    chunks = chunks.select(
        "doc_id", "key", "copies", "n", "no", (F.col("no") * chunk).cast("long").alias("at"),
        F.expr(f"substring(text, no * {chunk} + 1, {chunk + overlap})").alias("text"),
    ).repartition("key", "no")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                d = part.to_pydict()
                heads, tails = [], []
                for text, no, count, at in zip(d["text"], d["no"], d["n"], d["at"], strict=True):
                    b = boundaries(text, pattern, ranks_path, no == count - 1) + at
                    heads.append(b[b < at + overlap].tolist() if no else [0])
                    tails.append(b[b >= at + chunk].tolist())
                yield pa.RecordBatch.from_pydict(d | {"heads": heads, "tails": tails}, schema=_arrow_chunks)

    by_text = Window.partitionBy("doc_id", "key").orderBy("no")
    marked = chunks.mapInArrow(bounds, "doc_id long, key string, copies long, n long, no int, at long, text string, heads array<long>, tails array<long>")
    # null: no common boundary. Then neither this chunk nor any later one of its text is known to be true, and all go on in one piece.
    met = F.when(F.col("no") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("heads", F.lag("tails").over(by_text))))
    cuts = marked.withColumn("met", met.cast("long")).withColumn("true", F.min(F.col("met").isNotNull()).over(by_text))
    cuts = cuts.withColumn("begins", F.when(F.col("true"), F.col("met"))).withColumn("ends", F.lead("begins").over(by_text))
    start = F.coalesce("begins", "at")
    end = F.coalesce("ends", F.when(F.col("no") < F.col("n") - 1, F.col("at") + chunk).otherwise(F.col("at") + F.length("text")))
    parts = cuts.select(
        "doc_id", "key", "copies", F.count("begins").over(by_text).alias("piece"), "no",
        F.substring("text", (start - F.col("at") + 1).cast("int"), (end - start).cast("int")).alias("text"),
    )
    pieces = parts.groupBy("doc_id", "key", "copies", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"]), "").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [_ids(t, ranks_path, pattern).tobytes() for t in part.column("text").to_pylist()]
                names = ["doc_id", "key", "copies", "piece"]
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in names), pa.array(ids, pa.binary())], [*names, "ids"])

    coded = pieces.mapInArrow(encode, "doc_id long, key string, copies long, piece long, ids binary")
    texts = coded.groupBy("doc_id", "key", "copies").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("pieces"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "pieces"):
                out, doc_ids = [], []
                for doc_id, copies, pieces_ in zip(part.column("doc_id").to_pylist(), part.column("copies").to_pylist(), part.column("pieces").to_pylist(), strict=True):
                    out += [np.frombuffer(b"".join(x["ids"] for x in pieces_), dtype="<u4")] * copies
                    doc_ids += [doc_id] * copies
                yield _rows(doc_ids, out, ranks_path, pattern, keep_ids)

    return texts.mapInArrow(join, _schema(keep_ids))


_arrow_chunks = pa.schema(
    [("doc_id", pa.int64()), ("key", pa.string()), ("copies", pa.int64()), ("n", pa.int64()), ("no", pa.int32()), ("at", pa.int64()), ("text", pa.string()), ("heads", pa.list_(pa.int64())), ("tails", pa.list_(pa.int64()))]
)


def encode_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, *, keep_ids: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids as little-endian unsigned 32-bit integers."""
    path, found = default_ranks() if ranks_path is None else (ranks_path, pattern)
    pattern = pattern or found
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    is_long = F.length("text") > chunk
    return encode_short(df.where(~is_long), path, pattern, keep_ids).unionByName(encode_long(df.where(is_long), path, pattern, keep_ids, chunk, overlap))
