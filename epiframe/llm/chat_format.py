"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, and only its reply trainable.  Turns after the last assistant turn (or
a conversation without one) give one more example without a trainable span, so
that nothing of a conversation is lost.

A turn is written ``<s>[ROLE]role[/ROLE]text</s>``.  Inside roles and texts a
backslash goes before each backslash and each control string, so the format can
be read back exactly; see :func:`read_turns`.

Rows are dealt by conversation and sorted by (turn, role, text), nulls first;
a task streams them and holds one conversation's text so far, never a group of
rows.  The examples of a conversation of T turns hold T/2 prefixes of it: that
product is what the method asks for.  Null texts and roles are empty strings;
rows without a conversation id form one conversation; repeated rows are turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.llm.staging import map_arrow

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
ASSISTANT = "assistant"
_CONTROL = "|".join(re.escape(c) for c in CONTROLS)
_ESCAPE = re.compile(rf"\\|{_CONTROL}")
_UNESCAPE = re.compile(rf"\\(\\|{_CONTROL})")
_TOKEN = re.compile(rf"\\(?:\\|{_CONTROL})|({_CONTROL})")
_BATCH_CHARS = 4_000_000


def escape(text: str) -> str:
    """``text`` without live control strings."""
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    """The inverse of :func:`escape`."""
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The written turn and where its text begins and ends in it."""
    head, body = f"<s>[ROLE]{escape(role)}[/ROLE]", escape(text)
    return head + body + "</s>", len(head), len(head) + len(body)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of an example."""
    role, begin = "", 0
    for m in _TOKEN.finditer(formatted):
        mark = m[1]
        if mark in ("<s>", "[ROLE]"):
            begin = m.end()
        elif mark == "[/ROLE]":
            role, begin = unescape(formatted[begin : m.start()]), m.end()
        elif mark == "</s>":
            yield role, unescape(formatted[begin : m.start()])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0
    now, parts, length, replies, pending = object(), [], 0, 0, False

    def flush() -> pa.RecordBatch:
        nonlocal rows, size
        out = [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]
        rows, size = [], 0
        return pa.RecordBatch.from_arrays(out, names=["conv_id", "example", "formatted", "loss_start", "loss_end"])

    def example(begin, end) -> None:
        nonlocal parts, size
        whole = "".join(parts)
        parts = [whole]
        rows.append((now, replies, whole, begin, end))
        size += len(whole)

    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if conv != now:
                if pending:
                    example(None, None)
                now, parts, length, replies, pending = conv, [], 0, 0, False
            turn, begin, end = format_turn(role or "", text or "")
            parts.append(turn)
            pending = role != ASSISTANT
            if not pending:
                example(length + begin, length + end)
                replies += 1
            length += len(turn)
            if size > _BATCH_CHARS:
                yield flush()
    if pending:
        example(None, None)
    if rows:
        yield flush()


def expand(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end): code-point span of the trainable reply, null for the example of trailing turns."""
    c = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), F.col(turn_col).alias("turn"))
    dealt = c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return map_arrow(dealt, _expand, "conv_id long, example long, formatted string, loss_start long, loss_end long")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    now, last, chars, loss_chars, loss = object(), None, 0, 0, hashlib.sha256()

    def close() -> None:
        digest, n = hashlib.sha256(), 0
        for role, text in read_turns(last):
            digest.update(f"{role}\n{text}\n".encode())
            n += 1
        out.append((now, n, digest.hexdigest(), loss_chars, loss.hexdigest(), chars))

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        done = [pa.array(list(c), t) for c, t in zip(zip(*out), kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays(done, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        for conv, formatted, begin, end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
            if conv != now:
                if last is not None:
                    close()
                now, chars, loss_chars, loss = conv, 0, 0, hashlib.sha256()
            last = formatted
            chars += len(formatted)
            if begin is not None:
                reply = unescape(formatted[begin:end])
                loss_chars += len(reply)
                loss.update(reply.encode())
        if out:
            yield flush()
    if last is not None:
        close()
        yield flush()


def read_back(examples: DataFrame) -> DataFrame:
    """Digest of each conversation, parsed from its examples as :func:`expand` wrote them (one after the other in a task)."""
    return map_arrow(examples, _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
