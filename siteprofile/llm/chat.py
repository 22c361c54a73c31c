"""Chat formatting by event-sourced reconstruction."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

EVENTS = "conv_id long, message long, seq long, kind string, role string, text string"
FORMATTED = "conv_id long, seq long, message long, role string, formatted string, loss_start long, loss_end long"

_CONTROL = re.compile(r"\\|#{3,}|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """The text without the template's control strings; unescape() gives it back."""
    return _CONTROL.sub(lambda m: "<\\/turn>" if m[0] == "</turn>" else "".join("\\" + c for c in m[0]), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str, assistant: str = "assistant") -> tuple[str, int, int]:
    """A turn in the template, and the span (code points, end exclusive) that the loss covers: the text of the assistant's turns, else empty."""
    head, body = f"### {escape(role).replace(':', chr(92) + ':')}: ", escape(text)
    start, end = (len(head), len(head) + len(body)) if role == assistant else (0, 0)
    return f"{head}{body}</turn>\n", start, end


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    out, at = [], 0
    while at < len(formatted):
        # A turn ends at the first control string that no backslash breaks up, so plain searching finds it.
        colon = re.compile(r"(?:[^:\\]|\\.)*", re.DOTALL).match(formatted, at + 4).end()
        end = formatted.index("</turn>\n", colon)
        out.append((unescape(formatted[at + 4 : colon]), unescape(formatted[colon + 2 : end])))
        at = end + 8
    return out


def events_of(conversations: DataFrame) -> DataFrame:
    """Finished conversations as a log: each row starts a message."""
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("message"), F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), F.col("role").cast("string"), F.col("text").cast("string"))


def reconstruct(events: DataFrame) -> DataFrame:
    """conv_id, seq, message, role and text of each final message.

    events are a log with the columns of EVENTS. By conversation and message, in the order of seq, they are folded: kind
    message starts a message with a first text; delta adds to its text; edit replaces it; regenerate empties it for the
    deltas that follow; delete removes it. A message stands at the seq of its start. The log is dealt by conversation and
    message, so a conversation with a third of all events is folded in many tasks, and a task holds one message at a time.

    Null text counts as empty, null role as an empty role; null conv_id, message or seq are values of their own and come
    first. Ties in seq: by kind (message first), role and text. Rows alike are events of their own: two starts are two
    messages. Events without a start (the log begins late) make a message at the first of them. Unknown kinds raise an error. Empty table: no rows. Other
    columns are not read.
    """
    bound_batches(events.sparkSession)
    order = F.when(F.col("kind") == "message", 0).otherwise(1)
    log = events.select("conv_id", "message", "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), order.alias("_o"))
    dealt = log.repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "_o", "kind", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, current = None, None

        def full(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["conv_id", "seq", "message", "role", "text"])

        def close() -> list:
            return [(current[0], current[1], current[2], current[3], "".join(current[4]))] if current else []

        for batch in batches:
            done, size = [], 0
            for conv, message, seq, kind, role, text in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                fresh = (conv, message) != key
                if fresh or kind == "message":
                    done += close()
                    key, current = (conv, message), None
                if kind == "delete":
                    current = None
                    continue
                if current is None:
                    current = [conv, seq, message, role, []]
                if kind in ("message", "delta"):
                    current[4].append(text)
                elif kind == "edit":
                    current[4] = [text]
                elif kind == "regenerate":
                    current[4] = []
                else:
                    raise ValueError(f"unknown kind of event: {kind}")
                size += len(text)
                if size > 1 << 22:
                    yield full(done)
                    done, size = [], 0
            if done:
                yield full(done)
        if current:
            yield full(close())

    return dealt.mapInArrow(run, "conv_id long, seq long, message long, role string, text string")


def format_events(events: DataFrame, assistant: str = "assistant") -> DataFrame:
    """The final messages in the template: conv_id, seq, message, role, formatted, loss_start and loss_end (in code points of formatted).

    The pieces of a conversation in the order of seq, role, formatted make up its formatted text. Edge cases as in
    reconstruct().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                some = batch.slice(low, 1000)
                made = [render(r, t, assistant) for r, t in zip(some.column(3).to_pylist(), some.column(4).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(4)), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], ["conv_id", "seq", "message", "role", "formatted", "loss_start", "loss_end"])

    return reconstruct(events).mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted pieces alone: n_turns, turns_sha256 (role, newline, text, newline per turn), loss_chars, loss_sha256 and formatted_chars. The pieces stream by; only running digests are held."""
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "role", "formatted").select("conv_id", "formatted", "loss_start", "loss_end")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        key, state = (), None

        def close() -> list:
            return [(key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])] if state else []

        for batch in batches:
            done = []
            for conv, piece, low, high in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (conv,) != key:
                    done += close()
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                loss = unescape(piece[low:high])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(piece)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in close()], t) for i, t in enumerate(types)], names)

    return dealt.mapInArrow(run, schema)
