"""Chat formatting by a finite-state machine over roles and a declarative template.

Turns of a conversation stream through in order; the machine checks each role against the template's
transitions and emits text segments, each with a flag that says whether it counts for the loss.
Rows are shuffled once by conversation and sorted by the engine, which spills; the machine holds one
turn at a time, so a conversation of any length needs no more memory than its longest turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toponexus.llm.storage import small_batches

SEGMENT_SCHEMA = "conv_id long, turn_no long, part string, segment string, loss boolean, valid boolean, last boolean"
DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


@dataclass(frozen=True)
class Template:
    """Markers, roles whose text counts for the loss, and the roles that may follow each role.

    Inside a text an opening ``<|`` is kept apart from a marker by a backslash between its two signs;
    texts that already hold backslashes there get one more, so that the way back is unique. A role
    escapes backslashes and line ends.
    """

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>"
    after_turn: str = "\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    #: Roles that may come after a role; "" stands for the beginning, and "." for the end.
    transitions: dict[str, frozenset[str]] = field(
        default_factory=lambda: {
            "": frozenset({"system", "user"}),
            "system": frozenset({"user"}),
            "user": frozenset({"assistant"}),
            "assistant": frozenset({"user", "."}),
        }
    )

    def escape(self, text: str) -> str:
        return re.sub(r"<(\\*)\|", r"<\1\\|", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"<(\\*)\\\|", r"<\1|", text)

    def escape_role(self, role: str) -> str:
        return self.escape(role.replace("\\", "\\\\").replace("\n", "\\n"))

    def unescape_role(self, role: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.unescape(role))

    def allows(self, before: str, role: str) -> bool:
        return role in self.transitions.get(before, frozenset())


def _segments(template: Template, batch_chars: int = 1 << 22):
    names = [x.split()[0] for x in SEGMENT_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        held: tuple | None = None  # a turn waits until it is known whether another follows
        state, number = "", 0

        def emit(turn: tuple, last: bool) -> int:
            conv, role, text, no, allowed = turn
            allowed = allowed and (not last or template.allows(role, "."))
            out.append((conv, no, "head", f"{template.start}{template.escape_role(role)}{template.after_role}", False, allowed, False))
            out.append((conv, no, "text", template.escape(text), role in template.loss_roles, allowed, False))
            out.append((conv, no, "tail", f"{template.end}{template.after_turn}", False, allowed, last))
            return len(text) + 64

        def release() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out.clear()
            return batch

        for batch in batches:
            for conv, role, text in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "role", "text")), strict=True):
                role, text = role or "", text or ""
                if held is not None and held[0] != conv:
                    size += emit(held, True)
                    held = None
                elif held is not None:
                    size += emit(held, False)
                if held is None:
                    state, number = "", 0
                held = (conv, role, text, number, template.allows(state, role))
                state, number = role, number + 1
                if size > batch_chars:
                    yield release()
                    size = 0
        if held is not None:
            emit(held, True)
        if out:
            yield release()

    return run


def segments(turns: DataFrame, template: Template | None = None, partitions: int | None = None) -> DataFrame:
    """Segments of all conversations of rows (conv_id, turn, role, text), in order within a conversation.

    Returns conv_id, turn_no (from 0), part (head, text or tail), segment, loss, valid (whether the
    turn's role may follow the role before, and for a last turn whether it may end there) and last.
    Turns that break the order are formatted like any other. Null role or text counts as empty; rows
    with a null conv_id are one conversation; null turns come first, and equal turns in the order of
    role and text, so repeated rows stay. An empty table gives an empty result. Other columns are
    not read.
    """
    rows = small_batches(turns).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    count = partitions or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(count, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.mapInArrow(_segments(template or Template()), SEGMENT_SCHEMA)


class _Reading:
    """Reads one formatted conversation back, segment by segment."""

    def __init__(self, template: Template, conv_id):
        self.template, self.conv_id = template, conv_id
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.count = self.loss_chars = self.chars = 0
        self.valid = True

    def add(self, part: str, segment: str, loss: bool, valid: bool) -> None:
        t = self.template
        self.chars += len(segment)
        self.valid &= valid
        if part == "head":
            if not (segment.startswith(t.start) and segment.endswith(t.after_role)):
                raise ValueError("a turn does not begin with its marker")
            role = segment[len(t.start) : len(segment) - len(t.after_role)]
            self.turns.update(f"{t.unescape_role(role)}\n".encode())
            self.count += 1
        elif part == "text":
            if "<|" in segment:
                raise ValueError("a control string was not escaped")
            text = t.unescape(segment).encode()
            self.turns.update(text + b"\n")
            if loss:
                self.loss.update(text)
                self.loss_chars += len(text.decode())
        elif segment != f"{t.end}{t.after_turn}":
            raise ValueError("a turn does not end with its marker")

    def row(self) -> tuple:
        return self.conv_id, self.count, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid


def _read_back(template: Template):
    names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Reading | None = None
        for batch in batches:
            done = []
            for conv, part, segment, loss, valid, last in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "part", "segment", "loss", "valid", "last")), strict=True):
                now = now or _Reading(template, conv)
                now.add(part, segment, loss, valid)
                if last:
                    done.append(now.row())
                    now = None
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    return run


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """A row per conversation, read back from the rows of ``segments`` as they come, without an exchange."""
    return formatted.mapInArrow(_read_back(template or Template()), DIGEST_SCHEMA)
