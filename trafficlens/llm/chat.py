r"""Chat formatting whose output is read back by a deterministic parser.

Grammar of a formatted conversation::

    conversation = turn*
    turn  = "[INST]" text "[/INST]"                     user
          | "<s>" text "</s>"                           assistant
          | "<<SYS>>" text "<</SYS>>"                   system
          | "[ROLE]" text "[/ROLE]" text "[/TURN]"      any other role
    text  = ( "\" any | any but "\" and control strings )*

A text is first written as it is. The rendered turn is parsed and compared with the source; where
it differs, the conflicting text is escaped (backslashes and control strings), and, should that
not do, every bracket; a turn is only put out when the parser gives back what went in. As a
turn is parsed without looking at its neighbours, a conversation is as good as its turns, and
it is written as a stream: no task holds a conversation as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks around the text of each known role.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ROLE_OPEN, ROLE_CLOSE, TURN_CLOSE = "[ROLE]", "[/ROLE]", "[/TURN]"
CONTROL = "|".join(re.escape(x) for x in ("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", ROLE_OPEN, ROLE_CLOSE, TURN_CLOSE))
_TOKEN = re.compile(rf"\\.|\\$|{CONTROL}", re.DOTALL)
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_OPENERS = {opener: role for role, (opener, _) in MARKS.items()}
#: Ever stronger escapes: none, backslashes and control strings, all brackets too.
ESCAPES = (None, re.compile(rf"\\|{CONTROL}"), re.compile(r"[\\<\[]"))
LOSS_ROLE = "assistant"
TURN_SCHEMA = "conv_id long, position long, rendered string, loss_start int, loss_end int, escape int"


class Turn(NamedTuple):
    role: str
    text: str
    start: int  # of the text as rendered
    end: int


def unescape(rendered: str) -> str:
    return _UNESCAPE.sub(r"\1", rendered)


def _until(rendered: str, at: int, closer: str) -> tuple[int, int]:
    """Where the text from ``at`` ends, and where its closing mark ends."""
    for found in _TOKEN.finditer(rendered, at):
        if found[0][0] != "\\":
            if found[0] != closer:
                raise ValueError(f"{found[0]} in a text")
            return found.start(), found.end()
        if len(found[0]) < 2:
            break
    raise ValueError(f"no {closer}")


def parse(rendered: str) -> list[Turn]:
    """The turns of a formatted text; ValueError if the grammar doesn't hold."""
    turns: list[Turn] = []
    at = 0
    while at < len(rendered):
        opener = next((o for o in (*_OPENERS, ROLE_OPEN) if rendered.startswith(o, at)), None)
        if opener is None:
            raise ValueError("no turn begins here")
        start = at + len(opener)
        role, closer = _OPENERS.get(opener, ""), TURN_CLOSE
        if opener == ROLE_OPEN:
            end, after = _until(rendered, start, ROLE_CLOSE)
            role, start = unescape(rendered[start:end]), after
        else:
            closer = MARKS[role][1]
        end, at = _until(rendered, start, closer)
        turns.append(Turn(role, unescape(rendered[start:end]), start, end))
    return turns


def render(role: str, text: str, escape: int = 0) -> str:
    pattern = ESCAPES[escape]
    safe = (lambda x: x) if pattern is None else (lambda x: pattern.sub(r"\\\g<0>", x))
    if role in MARKS:
        opener, closer = MARKS[role]
        return f"{opener}{safe(text)}{closer}"
    return f"{ROLE_OPEN}{safe(role)}{ROLE_CLOSE}{safe(text)}{TURN_CLOSE}"


def format_turn(role: str, text: str) -> tuple[str, Turn, int]:
    """The rendered turn with the weakest escape that the parser reads back to the same, and what it reads."""
    for escape in range(len(ESCAPES)):
        rendered = render(role, text, escape)
        try:
            turns = parse(rendered)
        except ValueError:
            continue
        if len(turns) == 1 and turns[0][:2] == (role, text):
            return rendered, turns[0], escape
    raise ValueError("a turn could not be written reversibly")


def format_turns(conversations: DataFrame) -> DataFrame:
    """Formatted turns in order, one row each, with the loss mask's span in the turn's rendered text.

    Rows of a conversation are ordered by turn, then role, then text, nulls first, so ties and repeated rows
    have a defined place and all of them stay. A null text or role is empty; rows with a
    null conv_id are one conversation. Other columns are not read. No rows give no rows. The
    rows of a conversation are next to each other, in order, in one partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = run  # no id is like it
        position = 0
        for batch in batches:
            rows = []
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                position = position + 1 if conv_id == last else 0
                last = conv_id
                role, text = role or "", text or ""
                rendered, turn, escape = format_turn(role, text)
                learned = role == LOSS_ROLE
                rows.append((conv_id, position, rendered, turn.start if learned else None, turn.end if learned else None, escape))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in TURN_SCHEMA.split(", ")])

    ordered = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, TURN_SCHEMA)


class _Reader:
    """Running digests of a conversation that is read back turn by turn."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, rendered: str, start: int | None, end: int | None) -> None:
        for turn in parse(rendered):
            self.turns += 1
            self.all.update(f"{turn.role}\n{turn.text}\n".encode())
        if start is not None:
            learned = unescape(rendered[start:end])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())
        self.chars += len(rendered)

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, parsed from the output of :func:`format_turns`."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last = None, None
        for batch in batches:
            rows = []
            for conv_id, position, rendered, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if reader is None or position == 0:
                    if reader is not None:
                        rows.append((last, *reader.row()))
                    reader, last = _Reader(), conv_id
                reader.add(rendered, start, end)
            yield batch_of(rows)
        if reader is not None:
            yield batch_of([(last, *reader.row())])

    return formatted.select("conv_id", "position", "rendered", "loss_start", "loss_end").mapInArrow(run, schema)


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and number -1, whose texts hold the template's own marks."""
    probe = conversations.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
