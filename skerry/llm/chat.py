"""Conversations as training text, assembled column by column.

Turns are written as ``<s>[ROLE] text </s>``.  Every ``<``, ``[`` and backslash of a role or text, and every ``]``
of a role, gets a backslash after it, so no control string can occur inside one, and taking those backslashes away
gives the text back.  A batch of turns is laid out by numpy: the lengths of all segments, their running sums, and one
scatter of headers, bodies and footers into a single buffer that becomes the Arrow column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.words import buffers

OPEN, MIDDLE, CLOSE = b"<s>[", b"] ", b" </s>"
MARKED = np.array([chr(b) in "<[\\" for b in range(256)])
MARKED_ROLE = np.array([chr(b) in "<[\\]" for b in range(256)])
TRAINED_ROLE = "assistant"
#: Bytes after which a conversation is continued in a further part.
PART_BYTES = 1 << 24
UNESCAPE, UNESCAPE_ROLE = re.compile(rb"([<\[\\])\\"), re.compile(rb"([<\[\\\]])\\")
TURN = re.compile(rb"<s>\[((?:[^\]<\[\\]|[<\[\\\]]\\)*)\] ((?:[^<\[\\]|[<\[\\]\\)*) </s>", re.S)


def escape(data: np.ndarray, bounds: np.ndarray, marked: np.ndarray = MARKED) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) with a backslash after each marked byte."""
    times = marked[data].astype(np.int64) + 1
    ends = np.concatenate(([0], np.cumsum(times)))
    out = np.full(ends[-1], ord("\\"), np.uint8)
    out[ends[:-1]] = data
    return out, ends[bounds]


def unescape(data: bytes) -> bytes:
    return UNESCAPE.sub(rb"\1", data)


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(formatted, starts, ends): conversation i is turns ``first[i]`` to ``first[i + 1]``; starts and ends are
    the bytes of each turn's text inside its conversation's formatted bytes.
    """
    n = len(roles)
    role, role_at = escape(*buffers(roles), MARKED_ROLE)
    body, body_at = escape(*buffers(texts))
    sources = np.concatenate((np.frombuffer(OPEN + MIDDLE + CLOSE, np.uint8), role, body))
    fixed = np.cumsum([0, len(OPEN), len(MIDDLE), len(CLOSE)])
    begin = np.stack(
        (
            np.full(n, fixed[0]),
            fixed[3] + role_at[:-1],
            np.full(n, fixed[1]),
            fixed[3] + len(role) + body_at[:-1],
            np.full(n, fixed[2]),
        ),
        axis=1,
    ).ravel()
    length = np.stack(
        (
            np.full(n, len(OPEN)),
            np.diff(role_at),
            np.full(n, len(MIDDLE)),
            np.diff(body_at),
            np.full(n, len(CLOSE)),
        ),
        axis=1,
    ).ravel()
    offset = np.concatenate(([0], np.cumsum(length)))
    gather = np.repeat(begin - offset[:-1], length) + np.arange(offset[-1])
    out = sources[gather]
    turn_at = offset[::5]
    text_start, text_end = offset[3::5], offset[4::5]
    conversation = np.repeat(turn_at[first[:-1]], np.diff(first))
    formatted = pa.Array.from_buffers(
        pa.large_string(), len(first) - 1, [None, pa.py_buffer(turn_at[first].astype(np.int64)), pa.py_buffer(out)]
    )
    return formatted, text_start - conversation, text_end - conversation


FORMATTED = (
    "conv_id long, part int, last boolean, formatted string, loss_starts array<long>, loss_ends array<long>"
)


def _rows(ids, parts, lasts, roles: pa.Array, texts: pa.Array, first: np.ndarray) -> pa.RecordBatch:
    formatted, starts, ends = assemble(roles, texts, first)
    trained = np.array([r == TRAINED_ROLE for r in roles.to_pylist()], bool)
    counts = np.add.reduceat(trained, first[:-1]) if len(first) > 1 else np.zeros(0, np.int64)
    at = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array(parts, pa.int32()),
            pa.array(lasts, pa.bool_()),
            formatted.cast(pa.string()),
            pa.ListArray.from_arrays(at, pa.array(starts[trained], pa.int64())),
            pa.ListArray.from_arrays(at, pa.array(ends[trained], pa.int64())),
        ],
        names=["conv_id", "part", "last", "formatted", "loss_starts", "loss_ends"],
    )


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns sorted by conversation; the last conversation of a batch waits for the next batch."""
    held: pa.Table | None = None
    part = 0
    for batch in batches:
        turns = pa.Table.from_batches([batch])
        turns = turns if held is None else pa.concat_tables([held, turns]).combine_chunks()
        ids = turns.column("conv_id").to_pylist()
        if not ids:
            continue
        first = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
        if len(first) > 2:
            done = turns.slice(0, first[-2]).combine_chunks()
            n = len(first) - 2
            yield _rows(
                [ids[i] for i in first[:-2]],
                [part, *[0] * (n - 1)],
                [True] * n,
                done.column("role").combine_chunks(),
                done.column("text").combine_chunks(),
                np.array(first[:-1]),
            )
            part = 0
        held = turns.slice(first[-2])
        open_id = ids[-1]
        if held.nbytes > PART_BYTES and held.num_rows > 1:
            # the newest turn stays, so that the part that ends the conversation has a turn
            done, held = held.slice(0, held.num_rows - 1), held.slice(held.num_rows - 1)
            yield _rows(
                [open_id],
                [part],
                [False],
                done.column("role").combine_chunks(),
                done.column("text").combine_chunks(),
                np.array([0, done.num_rows]),
            )
            part += 1
    if held is not None:
        yield _rows(
            [open_id],
            [part],
            [True],
            held.column("role").combine_chunks(),
            held.column("text").combine_chunks(),
            np.array([0, held.num_rows]),
        )


def format_chats(turns: DataFrame) -> DataFrame:
    """Formatted conversations and the byte spans of trained (assistant) texts in them.

    Rows are ordered by turn inside their conversation (null turns first, ties by role and text); null role or
    text counts as empty; turns without ``conv_id`` form one conversation whose id is null.  One row per
    conversation; a conversation beyond ``PART_BYTES`` goes on in further parts, so no task holds more than a
    part, a batch and a turn; the part that ends it has ``last`` set.  Extra columns are not carried.  An empty table gives no rows.
    """
    cols = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return (
        cols.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInArrow(_format, FORMATTED)
    )


def read_turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of the turns of formatted bytes."""
    return [(UNESCAPE_ROLE.sub(rb"\1", r), unescape(t)) for r, t in TURN.findall(formatted)]


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of a conversation follow each other; digests are fed part by part."""
    fresh = lambda: [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
    state, out = fresh(), []
    for batch in batches:
        for row in batch.to_pylist():
            data = row["formatted"].encode()
            for role, text in read_turns(data):
                state[0] += 1
                state[1].update(role + b"\n" + text + b"\n")
            for a, b in zip(row["loss_starts"], row["loss_ends"], strict=True):
                text = unescape(data[a:b])
                state[2] += len(text.decode())
                state[3].update(text)
            state[4] += len(row["formatted"])
            if row["last"]:
                out.append((row["conv_id"], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                state = fresh()
        if out:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )
            out = []


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted text says, read back from it alone (in the partitions that ``format_chats`` made)."""
    return formatted.mapInArrow(_digest, DIGESTS)
