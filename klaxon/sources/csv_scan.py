"""A parallel scan of CSV files whose quoted fields may hold line ends.

Spark cuts files into blocks and reads their lines; whether a line begins inside a field depends on all quotes before it. So a first pass works
out, for each block, how reading it changes the state "inside a quoted field", from either state: it keeps it, swaps it, or ends in one state whatever came
before. A prefix scan over blocks, one row for each, gives the state that each block begins in. In the second pass every task cuts its own
blocks at true record ends; a record that runs over blocks is put together from its pieces, and those are looked for only where a block begins
inside a field. No line is shuffled.

A quote opens a field only where a field begins, and a doubled quote inside is a quote. Records end with \\n or \\r\\n. `seq` follows file name, then
byte offset: it is unique and grows along a file, and files go by their names' order, whatever the sizes that Spark packs them by. What the
driver and each task hold is an entry for each block (128 MB of input by default). The blocks are those of the first pass: if they are cut
otherwise when the second runs, it stops.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Bits of a byte offset in `seq`; the file's number stands above them.
OFFSET_BITS = 43
#: Pieces of records: whole, the beginning, what goes on, the end.
WHOLE, BEGIN, MIDDLE, END = range(4)


def ends_inside(line: bytes, inside: bool, comma: bytes = b",") -> bool:
    """Whether a field is open at the end of a line that begins inside one, or with a new record."""
    at = 0
    while True:
        if not inside and line[at : at + 1] == b'"':
            inside, at = True, at + 1
        if inside:
            at = line.find(b'"', at)
            while at >= 0 and line[at + 1 : at + 2] == b'"':
                at = line.find(b'"', at + 2)
            if at < 0:
                return True
            inside = False
        at = line.find(comma, at)
        if at < 0:
            return False
        at += 1


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The bytes of each line, with its file and block."""
    raw = spark.read.text(path, lineSep="\n")
    return raw.select(F.col("value").cast("binary").alias("line"), F.is_valid_utf8("value").alias("valid"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, list[bytes]]]:
    """The lines of a batch by block."""
    files, starts, lines = (batch.column(c).to_pylist() for c in ("file", "start", "line"))
    k = 0
    for j in range(1, len(lines) + 1):
        if j == len(lines) or starts[j] != starts[k] or files[j] != files[k]:
            yield files[k], starts[k], lines[k:j]
            k = j


def block_states(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, start, inside (whether the block begins in a field), open (whether it ends in one), valid (UTF-8): a row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ends, valid = None, [False, True], True

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": at[0], "start": at[1], "out": ends[0], "in": ends[1], "valid": valid}])

        for batch in batches:
            flags, k = batch.column("valid").to_pylist(), 0
            for file, start, lines in _runs(batch):
                if (file, start) != at:
                    if at is not None:
                        yield row()
                    at, ends, valid = (file, start), [False, True], True
                valid &= all(flags[k : k + len(lines)])
                k += len(lines)
                for line in lines:
                    if b'"' in line:  # other lines change neither state
                        ends = [ends_inside(line, e) for e in ends] if ends[0] != ends[1] else [ends_inside(line, ends[0])] * 2
        if at is not None:
            yield row()

    per = _lines(spark, path).mapInArrow(run, "file string, start long, out boolean, in boolean, valid boolean")
    # A block that ends alike from both states fixes the state; after the last such block it only swaps.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("swaps", F.coalesce(F.sum((F.col("out") & ~F.col("in")).cast("int")).over(before), F.lit(0)))
    fixed = F.last(F.when(F.col("out") == F.col("in"), F.struct("out", "swaps")), ignorenulls=True).over(before)
    parity = (F.coalesce(fixed["out"].cast("int"), F.lit(0)) + F.col("swaps") - F.coalesce(fixed["swaps"], F.lit(0))) % 2
    inside = parity == 1
    return per.select("file", "start", inside.alias("inside"), F.when(inside, F.col("in")).otherwise(F.col("out")).alias("open"), "valid")


def _pieces(spark: SparkSession, path: str | list[str], blocks: dict[str, tuple[int, dict[int, bool]]], columns: list[str], whole: bool) -> DataFrame:
    """seq, record, part: whole records, or the pieces of those that run over blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base, number, inside, continued, open_, seqs, records, parts = None, 0, 0, False, False, [], [], [], []

        def put(part: int) -> None:
            nonlocal number, open_
            record, open_ = b"\n".join(open_), []
            first = at[1] == 0 and number == 0 and part in (WHOLE, BEGIN)
            if first:
                names = next(csv.reader([record.decode("utf-8-sig", "replace").rstrip("\r")]), [])
                if [n.strip().lower() for n in names] != [c.lower() for c in columns]:
                    raise ValueError(f"{at[0]} begins with {names}")
            elif (part == WHOLE) == whole:
                seqs.append(base + number)
                records.append(record)
                parts.append(part)
            number += 1

        for batch in batches:
            for file, start, lines in _runs(batch):
                if (file, start) != at:
                    if open_:
                        put(MIDDLE if continued else BEGIN)
                    if start not in blocks.get(file, (0, {}))[1]:
                        raise ValueError(f"{file} is cut otherwise than in the first pass, at {start}")
                    at, number = (file, start), 0
                    index, states = blocks[file]
                    base, inside = (index << OFFSET_BITS) + start, states[start]
                    continued = inside
                for line in lines:
                    open_.append(line)
                    inside = ends_inside(line, inside) if b'"' in line else inside
                    if not inside:
                        put(END if continued else WHOLE)
                        continued = False
            if len(seqs):
                yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(records, pa.binary()), pa.array(parts, pa.int32())], ["seq", "record", "part"])
                seqs, records, parts = [], [], []
        if open_:
            put(MIDDLE if continued else BEGIN)
        if seqs:
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(records, pa.binary()), pa.array(parts, pa.int32())], ["seq", "record", "part"])

    return _lines(spark, path).select("line", "file", "start").mapInArrow(run, "seq long, record binary, part int")


def read_records(spark: SparkSession, path: str | list[str], columns: list[str], encoding: str | None = None) -> DataFrame:
    """seq and the columns as strings, of files that begin with a header of these names. Without an encoding it is UTF-8, or Latin-1 if any
    line isn't valid in UTF-8. Records of white space alone are left out; missing fields are null; an unclosed field runs to the file's end."""
    found = block_states(spark, path).collect()  # a row for each block
    blocks: dict[str, tuple[int, dict[int, bool]]] = {f: (k, {}) for k, f in enumerate(sorted({r["file"] for r in found}))}
    for r in found:
        blocks[r["file"]][1][r["start"]] = r["inside"]
    encoding = encoding or ("UTF-8" if all(r["valid"] for r in found) else "ISO-8859-1")
    rows = _pieces(spark, path, blocks, columns, True).select("seq", "record")
    if any(r["open"] for r in found):
        # Few rows: at most two for each block. A record's pieces are numbered by how many began so far.
        pieces = _pieces(spark, path, blocks, columns, False).withColumn("file", F.shiftright("seq", OFFSET_BITS))
        pieces = pieces.withColumn("of", F.count_if(F.col("part") == BEGIN).over(Window.partitionBy("file").orderBy("seq")))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.hex("record").alias("h")))), lambda x: x["h"])
        rows = rows.unionByName(pieces.groupBy("file", "of").agg(F.min("seq").alias("seq"), F.unhex(F.array_join(listed, "0A")).alias("record")).select("seq", "record"))
    text = F.regexp_replace(F.decode("record", encoding), "^\\ufeff|\\r$", "")
    rows = rows.select("seq", text.alias("text")).where(F.trim(F.translate("text", "\r\n\t", "   ")) != "")
    schema = ", ".join(f"`{c}` string" for c in columns)
    parsed = F.from_csv("text", schema, {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    return rows.select("seq", parsed.alias("r")).select("seq", "r.*")
