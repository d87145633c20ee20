"""Chat formatting that survives a grammar round trip.

A turn is ``### role: text</turn>`` and a line feed.  The text stands as it is if a deterministic
parser recovers it; otherwise the turn is marked as escaped (a backslash takes the place of the
space after the colon), every backslash is doubled and every control string gets one in front.
Rendered turns are parsed again and compared with their source before they are returned.

Turns are formatted one by one, so a conversation of any length needs no more memory than a turn;
a conversation's text is its turns' texts in order.  Order: turn, then role, then text (nulls
first).  Null roles and texts are empty.  Repeated turns are all kept.  Any string may be a role.
Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textvane.llm.common import columns_as, tasks_for

OPEN, CLOSE = "### ", "</turn>"
CONTROLS = (OPEN, CLOSE)
PLAIN, ESCAPED = " ", "\\"
ANSWERING = "assistant"


class Malformed(ValueError):
    """The text is not in the grammar."""


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for control in CONTROLS:
        text = text.replace(control, "\\" + control)
    return text


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace(":", "\\:")


def render(role: str, text: str, mark: str) -> tuple[str, int, int]:
    """(formatted turn, start and end of the text in it)."""
    head = f"{OPEN}{escape_role(role)}:{mark}"
    body = text if mark == PLAIN else escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def _read_role(source: str, at: int) -> tuple[str, int]:
    out = []
    while at < len(source) and source[at] != ":":
        at += source[at] == "\\"
        out.append(source[at : at + 1])
        at += 1
    if at >= len(source):
        raise Malformed("a role without end")
    return "".join(out), at + 1


def _next_control(source: str, at: int) -> tuple[int, str]:
    found = [(place, control) for control in CONTROLS if (place := source.find(control, at)) >= 0]
    if not found:
        raise Malformed("a turn without end")
    return min(found)


def _read_escaped(source: str, at: int) -> tuple[str, int]:
    out = []
    while True:
        place, control = _next_control(source, at)
        slash = source.find("\\", at, place)
        if slash < 0:
            if control != CLOSE:
                raise Malformed("a turn inside a turn")
            out.append(source[at:place])
            return "".join(out), place
        out.append(source[at:slash])
        at = slash + 1
        literal = next((x for x in ("\\", *CONTROLS) if source.startswith(x, at)), None)
        if literal is None:
            raise Malformed("an escape of nothing")
        out.append(literal)
        at += len(literal)


def parse(source: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn; start and end are places in ``source``."""
    turns, at = [], 0
    while at < len(source):
        if not source.startswith(OPEN, at):
            raise Malformed("text between turns")
        role, at = _read_role(source, at + len(OPEN))
        mark, at = source[at : at + 1], at + 1
        if mark == PLAIN:
            end, control = _next_control(source, at)
            if control != CLOSE:
                raise Malformed("a turn inside a turn")
            text = source[at:end]
        elif mark == ESCAPED:
            text, end = _read_escaped(source, at)
        else:
            raise Malformed("an unknown mark")
        if not source.startswith(CLOSE + "\n", end):
            raise Malformed("a turn without line end")
        turns.append((role, text, at, end))
        at = end + len(CLOSE) + 1
    return turns


def formatted_turn(role: str, text: str) -> tuple[str, int, int]:
    """The first rendering that the parser reads back as it was."""
    for mark in (PLAIN, ESCAPED):
        out, start, end = render(role, text, mark)
        try:
            if parse(out) == [(role, text, start, end)]:
                return out, start, end
        except Malformed:
            pass
    raise Malformed(f"no rendering of {role!r} survives")


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> the same keys, ``formatted`` and the loss span in it.

    The span [loss_start, loss_end) covers the (escaped) text of assistant turns; null for others.
    """
    own = columns_as(turns, conv_id="conv_id", turn="turn", role="role", text="text")
    schema = f"conv_id {own.schema['conv_id'].dataType.simpleString()}, turn {own.schema['turn'].dataType.simpleString()}"
    names = ["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = ([x or "" for x in batch.column(i).to_pylist()] for i in (2, 3))
            found = [formatted_turn(r, t) for r, t in zip(roles, texts)]
            learnt = [r == ANSWERING for r in roles]
            arrays = [
                *batch.columns,
                pa.array([x[0] for x in found], pa.string()),
                pa.array([x[1] if y else None for x, y in zip(found, learnt)], pa.int64()),
                pa.array([x[2] if y else None for x, y in zip(found, learnt)], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return own.mapInArrow(run, f"{schema}, role string, text string, formatted string, loss_start long, loss_end long")


class _Digest:
    """What is read back from one conversation, turn by turn."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss, self.size = conv, 0, 0, 0
        self.said, self.learnt = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int | None, end: int | None) -> None:
        self.size += len(formatted)
        for role, text, _, _ in parse(formatted):
            self.turns += 1
            self.said.update(f"{role}\n{text}\n".encode())
        if start is not None:
            span = formatted[start:end]
            text = span if formatted[start - 1] == PLAIN else _read_escaped(span + CLOSE, 0)[0]
            self.loss += len(text)
            self.learnt.update(text.encode())

    def row(self) -> dict:
        return {
            "conv_id": self.conv,
            "n_turns": self.turns,
            "turns_sha256": self.said.hexdigest(),
            "loss_chars": self.loss,
            "loss_sha256": self.learnt.hexdigest(),
            "formatted_chars": self.size,
        }


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest of each conversation, parsed from its formatted turns in order.

    A conversation is streamed in sorted order through one task, as its digest needs.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    dealt = formatted.repartition(tasks_for(formatted), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for batch in batches:
            done = []
            columns = [batch.column(i) for i in range(4)]
            for conv, text, start, end in zip(*(c.to_pylist() for c in columns)):
                if now is None or now.conv != conv:
                    done += [now.row()] if now else []
                    now = _Digest(conv)
                now.add(text, start, end)
            if done:
                yield pa.RecordBatch.from_pylist(done, out)
        if now:
            yield pa.RecordBatch.from_pylist([now.row()], out)

    integer = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    out = pa.schema(
        [("conv_id", integer), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
         ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )
    return dealt.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, schema)
