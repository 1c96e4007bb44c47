"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, then the reply, and only the reply trainable.  What follows the last
reply would appear in no example; one more, without a trainable span, holds the
whole conversation then, so that the output always gives the input back.

A turn is written ``<|turn|>role\\ntext<|end|>\\n``.  Inside roles and texts a
backslash is doubled and a control string (of this template or of common
others) gets a backslash after its first character; ``unescape`` undoes both.

A conversation is read in order of turn (then role and text, for ties), in one
pass over rows sorted by conversation: a long one costs memory for its text
once, since its examples are prefixes of one buffer.

Edge cases: a NULL text or role is empty; NULL conversation ids form one
conversation; a NULL turn comes first; a repeated row is a turn like any other;
a conversation without an assistant turn has no trainable text; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

OPEN, END = "<|turn|>", "<|end|>"
CONTROL = re.compile(r"<\||<<\/?SYS>>|<\/?s>|\[\/?INST\]|<(?:start|end)_of_turn>|<\/?(?:bos|eos|pad|unk)>")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(OPEN) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted example."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


@dataclass
class Example:
    """``buffer[:end]``; trainable is ``buffer[loss_start:loss_end]``."""

    buffer: str
    end: int
    loss_start: int
    loss_end: int

    @property
    def text(self) -> str:
        return self.buffer[: self.end]


def expand(turns: list[tuple[str, str]]) -> list[Example]:
    """The examples of one conversation."""
    parts, marks, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        head = f"{OPEN}{escape(role)}\n" if "\n" not in role else OPEN + escape(role).replace("\n", "\\n") + "\n"
        end = at + len(head) + len(body) + len(END) + 1
        if role == "assistant":
            marks.append((end, at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at = end
    if not marks or marks[-1][0] < at:
        marks.append((at, at, at))
    buffer = "".join(parts)
    return [Example(buffer, *m) for m in marks]


def _sorted(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = df.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    now, turns = None, []
    for b in batches:
        for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            if turns and conv != now:
                yield now, turns
                turns = []
            now = conv
            turns.append((role, text))
    if turns:
        yield now, turns


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def chat_examples(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end): the training examples; offsets in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((c, i, e.text, e.loss_start, e.loss_end) for c, turns in _conversations(batches) for i, e in enumerate(expand(turns)))
        yield from _batches(rows, ["conv_id", "example", "text", "loss_start", "loss_end"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()])

    return _sorted(df, conv, turn, role, text).transform(in_arrow, run, "conv_id long, example long, text string, loss_start long, loss_end long")


def digest(examples: list[Example]) -> tuple[int, str, int, str, int]:
    """What the examples of one conversation give back when they are read."""
    turns, loss, n = parse(examples[-1].text), hashlib.sha256(), 0
    for e in examples:
        said = unescape(e.buffer[e.loss_start : e.loss_end])
        loss.update(said.encode())
        n += len(said)
    whole = hashlib.sha256()
    for r, t in turns:
        whole.update(f"{r}\n{t}\n".encode())
    return len(turns), whole.hexdigest(), n, loss.hexdigest(), sum(e.end for e in examples)


def chat_digests(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per conversation, read back from its formatted examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((c, *digest(expand(turns))) for c, turns in _conversations(batches))
        yield from _batches(rows, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])

    return _sorted(df, conv, turn, role, text).transform(in_arrow, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
