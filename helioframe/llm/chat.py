"""Conversations to training text, one example per assistant turn.

Template: each turn is ``### <Role>: `` + text + `` </turn>\\n``. A text may hold the control strings
themselves (``###`` or ``</turn>``), or a backslash before them, so a backslash is put before every
backslash, before ``### `` and before ``</turn>``; ``unescape`` takes exactly these away again. After
escaping, a turn mark can only be one that the template wrote.

Prefix-target expansion: every assistant turn becomes an example of its own, whose context is all turns
before it and whose loss mask covers that reply alone. A conversation that does not end with an assistant
turn has one more example without a loss, so that no turn is lost. An example is stored whole: its
context, its own text, and where in it the loss lies. Stored text thus grows with the square of a conversation's
turns, by what an expansion is; the contexts of neighbouring examples lie next to each other, so files compress them well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.llm.text import ready
from helioframe.session import persist_table

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", " </turn>\n"
TRAINED = "assistant"
EXAMPLES = "conv_id bigint, example bigint, first_turn bigint, turns bigint, context_chars bigint, text string, loss_start bigint, loss_end bigint"

_NAMES = [c.split()[0] for c in EXAMPLES.split(", ")]
_TYPES = [pa.string() if c.endswith("string") else pa.int64() for c in EXAMPLES.split(", ")]
_ESCAPED = re.compile(r"\\(\\|### |</turn>)")
BATCH_CHARS = 1 << 22


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace(OPEN, "\\" + OPEN).replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as the template writes it, and where its text lies."""
    head = f"{OPEN}{escape(role).replace(':', chr(92) + ':')}{AFTER_ROLE}"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*?) </turn>\n", re.DOTALL)


def parse_turns(text: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    at = 0
    while at < len(text):
        found = _TURN.match(text, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        yield unescape(found[1].replace("\\:", ":")), unescape(found[2])
        at = found.end()


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Examples of all conversations; stored.

    Turns are taken by number, equal or null numbers by role and text, null numbers first. Null roles and texts
    are empty. Repeated rows are turns like others; a null conversation id is a conversation; other columns are
    not read; an empty table gives no examples. ``text`` is the context, the first ``context_chars`` characters, and the
    example's own turns; the loss lies between ``loss_start`` and ``loss_end`` of it. One conversation is read by one task
    as a sorted stream, a turn at a time; the task holds its formatted text.
    """
    ready(rows.sparkSession)
    picked = rows.select(
        F.col(f"`{conv}`").cast("bigint").alias("conv_id"), F.col(f"`{turn}`").cast("bigint").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    streams = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size, begun, conv_id = 0, False, None
        number = turns = first = context = 0
        whole = ""

        for batch in batches:
            for new_id, _, who, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or new_id != conv_id:
                    if turns > first:
                        out.append((conv_id, number, first, turns - first, context, whole, None, None))
                    begun, conv_id, number, turns, first, context, whole = True, new_id, 0, 0, 0, 0, ""
                piece, start, end = format_turn(who, content)
                before, whole, turns = len(whole), whole + piece, turns + 1
                if who == TRAINED:
                    out.append((conv_id, number, first, turns - first, context, whole, before + start, before + end))
                    number, first, context, size = number + 1, turns, len(whole), size + len(whole)
                if size > BATCH_CHARS:
                    yield _batch(out)
                    out, size = [], 0
        if turns > first:
            out.append((conv_id, number, first, turns - first, context, whole, None, None))
        if out:
            yield _batch(out)

    return persist_table(streams.mapInArrow(step, EXAMPLES), "chat-examples")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def digests(examples: DataFrame) -> DataFrame:
    """What the stored examples hold, per conversation, read back by parsing them.

    ``turns_sha256`` is over role, newline, text, newline of each turn, ``loss_sha256`` over all text under a
    loss mask, both unescaped; ``formatted_chars`` is the length of the formatted conversation.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    streams = examples.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    position = {n: examples.columns.index(n) for n in ("conv_id", "context_chars", "text", "loss_start", "loss_end", "turns")}

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        types = [pa.string() if c.endswith("string") else pa.int64() for c in schema.split(", ")]
        begun, conv_id, n, chars, loss_chars, all_turns, loss = False, None, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        so_far = ""
        for batch in batches:
            out = []
            for new_id, context, text, start, end, turns in zip(*(batch.column(i).to_pylist() for i in position.values()), strict=True):
                if not begun or new_id != conv_id:
                    if begun:
                        out.append((conv_id, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    begun, conv_id, n, chars, loss_chars, all_turns, loss, so_far = True, new_id, 0, 0, 0, hashlib.sha256(), hashlib.sha256(), ""
                if context != chars or not text.startswith(so_far):
                    raise ValueError(f"conversation {conv_id}: an example's context is not the text before it")
                count = 0
                for role, content in parse_turns(text[context:]):
                    all_turns.update(f"{role}\n{content}\n".encode())
                    count += 1
                if count != turns:
                    raise ValueError(f"conversation {conv_id}: {count} turns instead of {turns}")
                if start is not None:
                    trained = unescape(text[start:end])
                    loss.update(trained.encode())
                    loss_chars += len(trained)
                n, chars, so_far = n + count, len(text), text
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if begun:
            row = (conv_id, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    return streams.mapInArrow(step, schema)


def example_text(examples: DataFrame) -> DataFrame:
    """Each example's whole text and the loss mask in it.

    A null conversation id is a conversation; examples without a reply have a null loss; no examples give no rows. Other
    columns of ``examples`` are not read.
    """
    return examples.select("conv_id", "example", "text", "loss_start", "loss_end")
