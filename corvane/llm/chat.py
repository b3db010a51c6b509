"""Chat formatting that is checked by a grammar round trip.

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "[INST] " role "\\n" body " [/INST]"      for roles other than assistant
                  | "<s>" role "\\n" body "</s>"              for the assistant

where role and body hold none of the control strings. A turn is first rendered as it is and
reparsed; if the parser doesn't give the same role and text back, its content is escaped and the
turn is rendered again, until it does. Escaping puts a mark (U+241B and 1) behind the first
character of each control string and writes U+241B itself as U+241B and 0 (and a line break in a role
as U+241B and 2); reading removes them.

The formatted text of a conversation is the concatenation of its turns in order, so a conversation
of any length stays a run of rows, each with its place; rendering and checking need no shuffle. Only
digests, which run over all turns in order, bring a conversation together, as a sorted stream.

Defined results: a null role or text is empty; turns are ordered by turn (nulls first), then role,
then text; repeated rows are turns of their own; a null conv_id is a conversation of its own; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parallelism

ASSISTANT = "assistant"
ESC = "␛"
CONTROL = ("[INST]", "[/INST]", "<s>", "</s>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(f"{ESC}([012])")
_MEANS = {"0": ESC, "1": "", "2": "\n"}
_TURN = re.compile(r"(\[INST\] |<s>)")


class ParseError(ValueError):
    pass


def escape(content: str) -> str:
    content = content.replace(ESC, ESC + "0")
    return _CONTROL.sub(lambda m: m[0][0] + ESC + "1" + m[0][1:], content)


def escape_line(content: str) -> str:
    return escape(content).replace("\n", ESC + "2")


def unescape(content: str) -> str:
    return _ESCAPED.sub(lambda m: _MEANS[m[1]], content)


def frame(role: str, body: str) -> str:
    return f"<s>{role}\n{body}</s>" if role == ASSISTANT else f"[INST] {role}\n{body} [/INST]"


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start and end of the body) of each turn, by one pass from left to right."""
    at = 0
    while at < len(formatted):
        opened = _TURN.match(formatted, at)
        if not opened:
            raise ParseError(f"no turn starts at {at}")
        closed = _CONTROL.search(formatted, opened.end())
        want = "</s>" if opened[0] == "<s>" else "[/INST]"
        if not closed or closed[0] != want:
            raise ParseError(f"the turn at {at} isn't closed by {want}")
        end = closed.start() - (want == "[/INST]")
        line = formatted.find("\n", opened.end(), end)
        if line < 0 or (want == "[/INST]" and formatted[end] != " "):
            raise ParseError(f"the turn at {at} has no role or end")
        role = unescape(formatted[opened.end() : line])
        if (role == ASSISTANT) != (want == "</s>"):
            raise ParseError(f"the turn at {at} is marked for another role")
        yield role, unescape(formatted[line + 1 : end]), line + 1, end
        at = closed.end()


def render(role: str, text: str) -> str:
    """The turn in the grammar above; content is escaped only where the plain form reads back otherwise."""
    for write_role, write_text in ((str, str), (str, escape), (escape_line, escape)):
        form = frame(write_role(role), write_text(text))
        try:
            if [(r, t) for r, t, _, _ in parse(form)] == [(role, text)]:
                return form
        except ParseError:
            pass
    raise ValueError(f"a turn of role {role!r} doesn't read back")


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        role, text = b.column("role").to_pylist(), b.column("text").to_pylist()
        out = [render(r or "", t or "") for r, t in zip(role, text, strict=True)]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("conv_id", "turn", "role", "text")], pa.array(out, pa.string())], ["conv_id", "turn", "role", "text", "formatted"])


def format_turns(turns: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text, formatted), each checked by parsing it again."""
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return rows.mapInArrow(_render, "conv_id long, turn long, role string, text string, formatted string")


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str) -> None:
        self.chars += len(formatted)
        for role, text, _, _ in parse(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == ASSISTANT:
                self.loss.update(text.encode())
                self.loss_chars += len(text)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, open_, out = None, None, []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        out.clear()
        return batch

    for b in batches:
        for conv, text in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(), strict=True):
            if open_ is None or conv != key:
                if open_ is not None:
                    out.append((key, *open_.row()))
                key, open_ = conv, _Digest()
            open_.add(text)
        if len(out) >= 1000:
            yield flush()
    if open_ is not None:
        out.append((key, *open_.row()))
    if out:
        yield flush()


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from ``formatted``: digests of its turns and of its loss mask.

    One task streams a conversation's rows in order (a running hash allows nothing else) and holds
    a batch of them at a time, however long the conversation is.
    """
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    one = formatted.repartition(parallelism(formatted.sparkSession), "conv_id").sortWithinPartitions(*order)
    return one.select("conv_id", "formatted").mapInArrow(_digest, DIGEST)
