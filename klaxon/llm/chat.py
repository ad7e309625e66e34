"""Chat formatting with a grammar round trip: every turn is rendered, the rendering is parsed again by a deterministic parser, the
recovered turn is compared with its source, and conflicting text is escaped until both are identical.

    conversation := turn*
    turn         := "[INST] " text " [/INST]" | "<s> " text " </s>" | "<<SYS>> " text " <</SYS>>" | "<<ROLE " name ">> " text " <</ROLE>>"

for the roles user, assistant, system and any other, whose name is percent-encoded. A control string in a text has a tilde put
before it, before any tildes that it follows already; the parser takes one away. A text is rendered as it is first; only if
the parser then returns something else is it escaped.

A conversation is rendered and read back turn by turn, in runs of rows sorted by conversation and turn: memory holds a part of
a conversation (PART_TURNS turns), never all of one. Long conversations give several parts, which concatenated are its rendering.
The digest of a conversation is a running hash over its turns in order, so one conversation, or all rows of a null id, is the work of one
task in time, though not in memory; a very long text is rendered and parsed whole.

Defined results: null texts and roles count as empty, a null turn comes first, turns that tie are sorted by role and text,
repeated rows are turns of their own, rows of a null conversation id form one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Turns of a part. A part's characters are bounded by PART_CHARS and one turn.
PART_TURNS, PART_CHARS = 1_000, 4_000_000
#: What begins and ends a turn of each role.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
CONTROL = re.compile(r"(~*)(\[INST\]|\[/INST\]|</?s>|<</?SYS>>|<<ROLE [^<>]*>>|<</ROLE>>)")
ENDS = {"[INST]": ("user", "[/INST]"), "<s>": ("assistant", "</s>"), "<<SYS>>": ("system", "<</SYS>>")}


def marks(role: str) -> tuple[str, str]:
    return MARKS.get(role) or (f"<<ROLE {quote(role, safe='')}>> ", " <</ROLE>>")


def escape(text: str) -> str:
    return CONTROL.sub(r"~\1\2", text)


class Conflict(ValueError):
    """The rendering doesn't follow the grammar."""


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the still escaped text) of every turn."""
    turns, at, n = [], 0, len(rendered)
    while at < n:
        m = CONTROL.match(rendered, at)
        if not m or m[1]:
            raise Conflict(f"no turn begins at {at}")
        if m[2].startswith("<<ROLE "):
            role, end = unquote(m[2][7:-2]), "<</ROLE>>"
        elif m[2] in ENDS:
            role, end = ENDS[m[2]]
        else:
            raise Conflict(f"a turn ends at {at} before it began")
        begin = m.end() + 1
        text, upto = [], begin
        if rendered[m.end() : begin] != " ":
            raise Conflict(f"no space at {m.end()}")
        for c in CONTROL.finditer(rendered, begin - 1):
            if c[1]:
                text += [rendered[upto : c.start()], c[0][1:]]
                upto = c.end()
            elif c[2] == end and c.start() > begin - 1 and c.start() - 1 >= upto and rendered[c.start() - 1] == " ":
                text.append(rendered[upto : c.start() - 1])
                turns.append((role, "".join(text), begin, c.start() - 1))
                at = c.end()
                break
            else:
                raise Conflict(f"a control string stands inside a turn at {c.start()}")
        else:
            raise Conflict("the last turn doesn't end")
    return turns


def render(role: str, text: str) -> str:
    """A turn, escaped only as far as its round trip asks for."""
    begin, end = marks(role)
    for inner in (text, escape(text)):
        try:
            if [t[:2] for t in parse(begin + inner + end)] == [(role, text)]:
                return begin + inner + end
        except Conflict:
            pass
    raise Conflict("the escaped text is not recovered")  # can't be: escaped text holds no bare control string


def _sorted(rows: DataFrame) -> DataFrame:
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, part (from 0), formatted, n_turns; the rows of a conversation follow each other in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, turns, chars, none = None, 0, [], 0, True

        def row():
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([part], pa.int64()), pa.array(["".join(turns)], pa.string()), pa.array([len(turns)], pa.int64())], ["conv_id", "part", "formatted", "n_turns"])

        for batch in batches:
            for piece in slices(batch, "text"):
                for c, role, text in zip(piece.column("conv_id").to_pylist(), piece.column("role").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    if none or c != conv or len(turns) == PART_TURNS or chars > PART_CHARS:
                        if not none:
                            yield row()
                        conv, part, turns, chars, none = c, 0 if none or c != conv else part + 1, [], 0, False
                    turns.append(render(role, text))
                    chars += len(turns[-1])
        if not none:
            yield row()

    return _sorted(rows).mapInArrow(run, "conv_id long, part long, formatted string, n_turns long")


def read_back(formatted: DataFrame) -> DataFrame:
    """The digest of each conversation, from what format_conversations() gave, in the order it gave it."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, none = None, True
        n = loss = chars = 0
        all_turns, lost = hashlib.sha256(), hashlib.sha256()
        done: list[tuple] = []
        for batch in batches:
            for piece in slices(batch, "formatted"):
                for c, part, text in zip(piece.column("conv_id").to_pylist(), piece.column("part").to_pylist(), piece.column("formatted").to_pylist(), strict=True):
                    if part == 0:
                        if not none:
                            done.append((conv, n, all_turns.hexdigest(), loss, lost.hexdigest(), chars))
                        conv, none, n, loss, chars, all_turns, lost = c, False, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                    chars += len(text)
                    for role, said, _, _ in parse(text):
                        n += 1
                        all_turns.update(f"{role}\n{said}\n".encode())
                        if role == "assistant":
                            loss += len(said)
                            lost.update(said.encode())
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names)
                    done = []
        if not none:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((conv, n, all_turns.hexdigest(), loss, lost.hexdigest(), chars), types, strict=True)], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the contract adds.
EXTRA = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def format_and_read_back(rows: DataFrame) -> DataFrame:
    extra = rows.sparkSession.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.select("conv_id", "turn", "role", "text").unionByName(extra)))
