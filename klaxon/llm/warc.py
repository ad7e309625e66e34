"""WARC archives with an index written first-hand: offset, length, URL and digest of every record. Reading selects records in the
index and turns their sorted byte ranges into few reads.

Each record is a gzip member of its own, as WARC readers expect. Writers are the partitions of one Spark job; the index rows they
return name the files they wrote, and only the committed index counts. A task that ran twice leaves a file that nothing names.

Every record's id names the place where it is written (file and offset), so no two are the same; a revisit names its response by URL and
page id.

Records with equal payloads of at least MIN_REVISIT bytes: the one with the largest page_id is the response, the others revisit it
and carry no payload. Defined results: a null html is an empty payload; null page ids come before all others, so such a row is a
response only where its payload has no other; rows that repeat the largest page_id are responses each; a null URL is written as an
empty one; a very long html is one record, held whole in memory while it is written or read; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, scratch_path, slices

MIN_REVISIT = 1000
#: Bytes of a file after which the next begins; of a read; of a gap between ranges that a read may take along.
FILE_BYTES, READ_BYTES, GAP_BYTES = 256 << 20, 8 << 20, 64 << 10
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long, path string, folder string, offset long, length long"


#: Parts of a digest's rows that are joined apart, and the most tasks that read archives.
DEAL, MOST_READERS = 16, 20_000


def typed(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """pages with digest, payload_bytes, record_type, refers_to, refers_url. Which rows are revisits is worked out over ids and digests
    alone, a common digest in parts; payloads are dealt by page and digest, so copies of one payload spread."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html")).withColumns(
        {"payload_bytes": F.octet_length("html").cast("long"), "digest": F.sha1("html")}
    )
    slim = save(rows.select("page_id", "url", "digest", "payload_bytes"), "digests").where(F.col("payload_bytes") >= min_revisit)
    last = slim.groupBy("digest").agg(F.max("page_id").alias("last_id"), F.max_by("url", F.struct("page_id", "url")).alias("last_url"), F.count("*").alias("n")).where("n > 1")
    last = last.select("digest", "last_id", "last_url", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEAL - 1).cast("long"))).alias("deal"))
    dealt = slim.select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(DEAL)).alias("deal")).distinct()
    again = dealt.join(last, ["digest", "deal"]).where(~F.col("page_id").eqNullSafe(F.col("last_id")))
    again = again.select(F.col("digest").alias("again"), F.col("page_id").alias("again_id"), "last_id", "last_url")
    rows = rows.join(again, (F.col("digest") == F.col("again")) & F.col("page_id").eqNullSafe(F.col("again_id")), "left")
    revisits = F.col("again").isNotNull()
    return rows.select(
        "page_id", "url", "html", "payload_bytes", "digest", F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.col("last_id").alias("refers_to"), F.col("last_url").alias("refers_url")
    )


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(row: dict, place: str) -> bytes:
    """The bytes of a record that is written at `place`."""
    payload = b"" if row["record_type"] == "revisit" else row["html"].encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(row['url'])}",
        f"WARC-Payload-Digest: sha1:{row['digest']}",
        f"X-Payload-Bytes: {row['payload_bytes']}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload)}",
    ]
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    if row["refers_to"] is not None:
        head.append(f"WARC-Refers-To-Target-URI: {_line(row['refers_url'])}")
        head.append(f"WARC-Refers-To-Date: {DATE}")
        head.append(f"X-Refers-To-Page: {row['refers_to']}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame) -> DataFrame:
    """Writes the archives; returns their index."""
    folder = scratch_path(pages.sparkSession, "warc")
    names = [x.split()[0] for x in INDEX.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            for part in slices(batch, "html"):
                rows = []
                for row in part.to_pylist():
                    if out is None or at > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    data = _member(record(row, f"{name}:{at}"))
                    out.write(data)
                    rows.append([row[k] for k in names[:6]] + [name, folder, at, len(data)])
                    at += len(data)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()], strict=True)], _order)
        if out is not None:
            out.close()

    _order = ["page_id", "url", "digest", "payload_bytes", "record_type", "refers_to", "path", "folder", "offset", "length"]
    assert _order == names and len(types) == len(names)
    return save(typed(pages).select("html", "refers_url", *names[:6]).mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload of the records that the index lists, read
    from the archives. Ranges of a file are sorted and read together while gaps are small. Bytes of a file are dealt out
    by stretches of it, so a large file is read by several tasks, as many as there are READ_BYTES to read (MOST_READERS at most)."""

    def ranges(rows: Iterator[dict]) -> Iterator[list[dict]]:
        run: list[dict] = []
        for r in rows:
            if run and (r["path"] != run[-1]["path"] or r["folder"] != run[-1]["folder"] or r["offset"] - (run[-1]["offset"] + run[-1]["length"]) > GAP_BYTES or r["offset"] + r["length"] - run[0]["offset"] > READ_BYTES):
                yield run
                run = []
            run.append(r)
        if run:
            yield run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        rows = (r for b in batches for r in b.to_pylist())
        for run in ranges(rows):
            store, base = fs.FileSystem.from_uri(run[0]["folder"])
            first = run[0]["offset"]
            with store.open_input_file(f"{base}/{run[0]['path']}") as f:
                data = f.read_at(run[-1]["offset"] + run[-1]["length"] - first, first)
            out = []
            for r in run:
                headers, payload = parse(zlib.decompress(data[r["offset"] - first : r["offset"] - first + r["length"]], 31))
                revisit = headers["WARC-Type"] == "revisit"
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"{r['path']}: the payload at {r['offset']} is damaged")
                page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page")
                size = int(headers["X-Payload-Bytes"]) if revisit else len(payload)
                out.append((page and int(page), headers["WARC-Target-URI"], headers["WARC-Type"], refers and int(refers), size, digest, payload))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()], strict=True)], ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    stretch = F.floor(F.col("offset") / READ_BYTES)
    total = index.agg(F.sum("length")).first()[0] or 0
    parts = max(1, min(MOST_READERS, -(-total // READ_BYTES)))
    chosen = index.select("folder", "path", "offset", "length").repartition(parts, "folder", "path", stretch).sortWithinPartitions("folder", "path", "offset")
    return chosen.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes all pages and reads all records back."""
    return read_records(write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
