"""Chat formatting from event logs.

A conversation is a log of events. Deltas append to a message, an edit replaces its text, a regeneration starts it over,
a deletion takes it out. Events are dealt by conversation and message, sorted by sequence number and folded in one pass
that holds one message at a time; messages are rendered on their own, with control strings escaped reversibly; a
conversation is then the run of its rendered messages in order, so neither step holds a conversation as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm import common

# The template. A turn is "### Role: text </turn>\n"; only these strings control it.
OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
LOSS_ROLE = "assistant"
KEY = ["conv_id", "message", "branch"]
MESSAGES = "conv_id long, message long, branch long, role string, text string"


def escaped(text: Column) -> Column:
    """A backslash before each backslash, ``#`` and ``</`` slash; colons only matter in roles. No control string survives."""
    return F.regexp_replace(text, r"[\\#]|(?<=<)/", r"\\$0")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, branch, role, text) from events (conv_id, message, branch, seq, kind, role, text).

    ``kind`` is start, delta, edit, regenerate or delete; another kind or none counts as delta. Text is appended by start
    and delta, set by edit, set to the event's own text by regenerate. The first role that is not null holds. Null texts
    are empty; equal sequence numbers are taken in the order start, regenerate, edit, delta, delete, then by text. Null
    ids stay null and sort first. ``branch`` tells apart messages of one number. Messages that end deleted are left out.
    """
    rank = F.when(F.col("kind") == "start", 0).when(F.col("kind") == "regenerate", 1).when(F.col("kind") == "edit", 2).when(F.col("kind") == "delete", 4).otherwise(3)
    rows = events.select(
        *(common.id_key(F.col(c)).alias(c) for c in KEY), common.id_key(F.col("seq")).alias("seq"),
        rank.alias("rank"), "role", F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.repartition(*KEY).sortWithinPartitions(*KEY, "seq", "rank", "text", "role")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, role, parts = None, None, None  # the open message; no parts: it is deleted
        for batch in batches:
            done: list[tuple] = []
            for *own, rank, new_role, text in zip(*(batch[c].to_pylist() for c in (*KEY, "rank", "role", "text")), strict=True):
                if key != own:
                    if key is not None and parts is not None:
                        done.append((*key, role, "".join(parts)))
                    key, role, parts = own, None, []
                role = new_role if role is None else role
                if rank == 4:
                    parts = None
                elif rank in (1, 2):
                    parts = [text]
                elif parts is not None:
                    parts.append(text)
            yield table(done)
        if key is not None and parts is not None:
            yield table([(*key, role, "".join(parts))])

    def table(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*done, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*KEY, "role", "text"])

    return rows.mapInArrow(fold, MESSAGES)


def turn_events(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Finished turns as events: each row starts a message. Rows of one turn are branches of it, by role and text."""
    rows = turns.select(turns[conv_col].cast("long").alias("conv_id"), turns[turn_col].cast("long").alias("message"), turns[role_col].alias("role"), turns[text_col].alias("text"))
    branch = F.row_number().over(Window.partitionBy("conv_id", "message").orderBy("role", "text")).cast("long")
    return rows.select("conv_id", "message", branch.alias("branch"), F.lit(0).cast("long").alias("seq"), F.lit("start").alias("kind"), "role", "text")


def rendered(messages: DataFrame) -> DataFrame:
    """Adds ``segment``, the turn as it stands in the output, and ``loss_from`` and ``loss_to``, code points in the segment.

    The loss mask covers the text of assistant turns and nothing of the markers. A null role is an empty one.
    """
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(OPEN), F.regexp_replace(escaped(role), ":", r"\\:"), F.lit(COLON))
    body = escaped(F.coalesce("text", F.lit("")))
    loss = role == LOSS_ROLE
    return messages.withColumns({
        "segment": F.concat(head, body, F.lit(CLOSE)),
        "loss_from": F.when(loss, F.length(head)),
        "loss_to": F.when(loss, F.length(head) + F.length(body)),
    })


def parsed(segment: str) -> tuple[str, str]:
    """(role, text) of a rendered turn."""
    if not segment.startswith(OPEN) or not segment.endswith(CLOSE):
        raise ValueError("not a rendered turn")
    head = re.match(r"((?:\\.|[^\\:])*): ", segment[len(OPEN) :], re.DOTALL)
    if head is None:
        raise ValueError("a turn without a role")
    return unescaped(head[1]), unescaped(segment[len(OPEN) + head.end() : -len(CLOSE)])


def split_turns(text: str) -> list[str]:
    """The turns of a formatted conversation; no text inside can hold the closing marker."""
    return [x + CLOSE for x in text.split(CLOSE)[:-1]]


def conversations(segments: DataFrame, max_chars: int = 1 << 20) -> DataFrame:
    """(conv_id, chunk, text, loss array): formatted conversations in order, cut at turns into chunks of about ``max_chars``.

    ``loss`` has the spans of the mask in code points of the chunk. The longest conversation needs no more memory than a chunk.
    """
    rows = segments.repartition("conv_id").sortWithinPartitions(*KEY).select("conv_id", "segment", "loss_from", "loss_to")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, chunk, parts, size, spans = None, 0, [], 0, []
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))]

        def table(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "chunk", "text", "loss"])

        for batch in batches:
            done = []
            for own, segment, first, end in zip(*(batch[c].to_pylist() for c in ("conv_id", "segment", "loss_from", "loss_to")), strict=True):
                if parts and (own != conv or size + len(segment) > max_chars):
                    done.append((conv, chunk, "".join(parts), spans))
                    parts, size, spans, chunk = [], 0, [], chunk + 1
                if own != conv:
                    conv, chunk = own, 0
                if first is not None:
                    spans.append({"first": size + first, "end": size + end})
                parts.append(segment)
                size += len(segment)
            yield table(done)
        if parts:
            yield table([(conv, chunk, "".join(parts), spans)])

    return rows.mapInArrow(join, "conv_id long, chunk long, text string, loss array<struct<first: bigint, end: bigint>>")


def format_events(events: DataFrame, max_chars: int = 1 << 20) -> DataFrame:
    """Formatted conversations of an event log, messages by number, then branch. An empty log gives no conversation."""
    return conversations(rendered(fold_events(events)), max_chars).withColumn("conv_id", common.public_id(F.col("conv_id")))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all derived from texts and spans.

    Digests need the turns in order, so a conversation streams through one task; it holds a chunk at a time.
    """
    rows = formatted.select(common.id_key(F.col("conv_id")).alias("conv_id"), "chunk", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def table(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        conv, state = None, None
        result = lambda: (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        for batch in batches:
            done = []
            for own, text, loss in zip(*(batch[c].to_pylist() for c in ("conv_id", "text", "loss")), strict=True):
                if own != conv:
                    if state is not None:
                        done.append(result())
                    conv, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for segment in split_turns(text):
                    role, said = parsed(segment)
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    learned = unescaped(text[span["first"] : span["end"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
            yield table(done)
        if state is not None:
            yield table([result()])

    out = rows.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumn("conv_id", common.public_id(F.col("conv_id")))
