"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

Conversations are streams: rows are dealt by conversation, sorted by turn, and a Python
worker holds one turn at a time, so even a huge conversation needs no memory to speak of.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The state before the first turn; no role is None, as a null role is the empty one.
START = None


@dataclass(frozen=True)
class Template:
    """What is written around a turn, what may follow what, and whose texts carry loss.

    Inside texts (and roles) the mark character is doubled wherever it occurs, so control strings, which
    all begin with the mark and another character, can be told apart: undoubling gives the text back.
    """

    mark: str = "<"
    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>\n"
    loss_roles: frozenset = frozenset({"assistant"})
    #: From the last role (or the start) to the roles that may come next.
    order: dict = field(default_factory=lambda: {START: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}})
    ends: frozenset = frozenset({"assistant"})

    def escape(self, text: str) -> str:
        return text.replace(self.mark, self.mark * 2)

    def unescape(self, text: str) -> str:
        return text.replace(self.mark * 2, self.mark)


class Machine:
    """Follows the roles of one conversation and says at which turns the order is broken."""

    def __init__(self, template: Template):
        self.template, self.state, self.errors = template, START, 0

    def step(self, role: str | None) -> bool:
        role = role or ""
        ok = role in self.template.order.get(self.state, ())
        self.errors += not ok
        self.state = role
        return ok

    def complete(self) -> bool:
        return not self.errors and self.state in self.template.ends


def dealt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), a conversation's rows in one partition in order of turn (ties: role, text; nulls first)."""
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def segments(conversations: DataFrame, template: Template = Template(), most: int = 2_000) -> DataFrame:  # noqa: B008
    """conv_id, place (of the turn, from 0), turn, seg (0 opening with the role, 1 text, 2 closing), text, loss, valid: the formatted conversation in pieces.

    Only texts of the template's loss roles carry loss.  valid tells whether the turn may follow the
    ones before it; turns out of order are formatted all the same.  Null texts are empty, a null role
    is the empty role, rows with a null conv_id form one conversation, repeated rows are turns of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "place", "turn", "seg", "text", "loss", "valid"]
        types = [None, pa.int64(), None, pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
        now, machine, started, place = None, Machine(template), False, 0
        for batch in batches:
            types[0], types[2] = batch.schema.field(0).type, batch.schema.field(1).type
            for i in range(0, batch.num_rows, most):
                out: list[list] = [[] for _ in names]
                for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.slice(i, most).columns), strict=True):
                    if not started or conv != now:
                        now, machine, started, place = conv, Machine(template), True, 0
                    ok, loss = machine.step(role), role in template.loss_roles
                    parts = [(template.opening + template.escape(role or "") + template.after_role, False), (template.escape(text), loss), (template.closing, False)]
                    for seg, (part, masked) in enumerate(parts):
                        for column, x in zip(out, (conv, place, turn, seg, part, masked, ok), strict=True):
                            column.append(x)
                    place += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    rows = dealt(conversations)
    kind = {x.name: x.dataType.simpleString() for x in rows.schema.fields}
    return rows.mapInArrow(run, f"conv_id {kind['conv_id']}, place long, turn {kind['turn']}, seg int, text string, loss boolean, valid boolean")


class Reader:
    """Reads formatted text back, piece by piece, into turns and loss text, and follows the roles that it reads."""

    def __init__(self, template: Template):
        self.template, self.machine = template, Machine(template)
        self.turns, self.loss_chars, self.chars = 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()
        self.role: str | None = None
        self.body: str | None = None

    def feed(self, text: str, loss: bool):
        t = self.template
        self.chars += len(text)
        if self.role is None:
            if not (text.startswith(t.opening) and text.endswith(t.after_role)):
                raise ValueError(f"a turn does not begin with {t.opening}: {text[:50]!r}")
            self.role = t.unescape(text[len(t.opening) : len(text) - len(t.after_role)])
            self.machine.step(self.role)
        elif self.body is None:
            if t.mark in text.replace(t.mark * 2, ""):
                raise ValueError("a control string in a text")
            self.body = t.unescape(text)
            if loss:
                self.loss_chars += len(self.body)
                self.masked.update(self.body.encode())
        else:
            if text != t.closing:
                raise ValueError(f"a turn does not end with {t.closing!r}: {text[:50]!r}")
            self.turns += 1
            for x in (self.role, "\n", self.body, "\n"):
                self.all.update(x.encode())
            self.role = self.body = None

    def close(self):
        if self.role is not None:
            raise ValueError("the last turn has no end")


_READ = {"n_turns": "long", "turns_sha256": "string", "loss_chars": "long", "loss_sha256": "string", "formatted_chars": "long", "n_errors": "long", "complete": "boolean"}


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """A row per conversation of segments(), from the roles, texts and loss flags of its pieces alone, whatever order they are in:
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_errors (turns whose role may not follow the one
    before), complete (no errors, and the last role may end a conversation).

    Raises for pieces that the template cannot have made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *_READ]
        arrow = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        now, reader, kind = None, None, None

        def row(conv, r):
            r.close()
            values = [conv, r.turns, r.all.hexdigest(), r.loss_chars, r.masked.hexdigest(), r.chars, r.machine.errors, r.machine.complete()]
            return [pa.array([v], t) for v, t in zip(values, [kind, *(arrow[t] for t in _READ.values())], strict=True)]

        for batch in batches:
            kind = batch.schema.field(0).type
            done = []
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss")), strict=True):
                if reader is None or conv != now:
                    if reader is not None:
                        done.append(row(now, reader))
                    now, reader = conv, Reader(template)
                reader.feed(text, loss)
            if done:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*done, strict=True)], names)
        if reader is not None:
            yield pa.RecordBatch.from_arrays(row(now, reader), names)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    rows = formatted.select("conv_id", "place", "seg", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "place", "seg")
    return rows.select("conv_id", "text", "loss").mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{k} {v}" for k, v in _READ.items()))
