"""Chat formatting: turns assembled as bytes of one Arrow buffer, with loss spans, and read back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import shared

#: A turn: ``### role:``, a line break, the escaped text, a line break, ``</turn>``, a line break.
OPEN, COLON, CLOSE = "### ", ":\n", "\n</turn>\n"
#: Strings that get a backslash before them inside a text (a backslash itself is doubled first).
CONTROL = ("###", "</turn>")
FORMATTED = "conv_id long, part int, formatted string, n_turns int, loss_starts array<int>, loss_ends array<int>"
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(texts: pa.Array) -> pa.Array:
    """Control strings get a backslash; after it ``</turn>`` never follows a line break."""
    out = pc.replace_substring(texts, "\\", "\\\\")
    for control in CONTROL:
        out = pc.replace_substring(out, control, "\\" + control)
    return out


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def escape_role(roles: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role) if "\\" in role else role


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer: its bytes, where turns begin (and the end), where their texts begin and end.

    Lengths of the five segments of every turn give their places by one running sum;
    each kind of segment is then copied by scatter indices.
    """
    parts = [np.frombuffer(OPEN.encode(), np.uint8), shared.flat(escape_role(roles)), np.frombuffer(COLON.encode(), np.uint8), shared.flat(escape(texts)), np.frombuffer(CLOSE.encode(), np.uint8)]
    n = len(roles)
    lengths = np.empty((n, len(parts)), np.int64)
    for k, part in enumerate(parts):
        lengths[:, k] = np.diff(part[1]) if isinstance(part, tuple) else len(part)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, part in enumerate(parts):
        if isinstance(part, tuple):
            data, at = part
            out[np.arange(len(data)) + np.repeat(starts[:, k] - at[:-1], lengths[:, k])] = data
        else:
            out[starts[:, k, None] + np.arange(len(part))] = part
    return out, np.append(starts[:, 0], len(out)), starts[:, 3], ends[:, 3]


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Conversations as text with loss spans, from ``conv_id``, ``turn``, ``role``, ``text``.

    Turns stand by ``turn``, then ``role``, then ``text`` (nulls first); repeated rows stay;
    null roles and texts are empty; rows without ``conv_id`` are one conversation; other columns are not read. A row is
    a conversation, or one of its consecutive parts (``part`` 0, 1, ...) where it is longer
    than a piece of a few MB, so no conversation is held whole. Spans are in characters of
    ``formatted`` and cover the escaped texts of ``trained_role``. Parts of a conversation
    follow each other in one partition.
    """
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = object(), 0
        for batch in batches:
            for b in shared.pieces(batch, 2, 4 << 20):
                roles, texts = (pc.fill_null(b.column(k), "") for k in (1, 2))
                data, turn_at, text_at, text_end = assemble(roles, texts)
                ids = b.column(0).to_pylist()
                heads = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1])]
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
                trained = np.flatnonzero(pc.equal(roles, trained_role).to_numpy(zero_copy_only=False))
                owner = np.searchsorted(heads, trained, "right") - 1
                base = chars[turn_at[heads]][owner] if len(trained) else np.zeros(0, np.int64)
                spans = np.searchsorted(owner, np.arange(len(heads) + 1)).astype(np.int32)
                first, last = ((chars[at[trained]] - base).astype(np.int32) for at in (text_at, text_end))
                bounds = turn_at[[*heads, len(ids)]].astype(np.int32)
                text = pa.StringArray.from_buffers(len(heads), pa.py_buffer(bounds), pa.py_buffer(data))
                part = part + 1 if ids[0] == before else 0
                numbers = np.zeros(len(heads), np.int32)
                numbers[0] = part
                before, part = ids[-1], part if len(heads) == 1 else 0
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(heads)), pa.array(numbers), text, pa.array(np.diff([*heads, len(ids)]).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(spans), pa.array(first)), pa.ListArray.from_arrays(pa.array(spans), pa.array(last)),
                    ],
                    ["conv_id", "part", "formatted", "n_turns", "loss_starts", "loss_ends"],
                )

    return rows.mapInArrow(run, FORMATTED)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation or part."""
    out = []
    for turn in formatted.split(CLOSE)[:-1]:
        role, _, text = turn[len(OPEN) :].partition(COLON)
        out.append((unescape_role(role), unescape(text)))
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of turns and of the text under the loss mask, read back from ``format_conversations``.

    Reads the parts of a conversation one after another in the partition that holds them
    and keeps hash states only.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        done: list[list] = []

        def rows() -> pa.RecordBatch:
            columns = list(zip(*((s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]) for s in done))) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        for b in batches:
            for conv, text, starts, ends in zip(*(b.column(k).to_pylist() for k in (0, 2, 4, 5))):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for a, e in zip(starts, ends):
                    said = unescape(text[a:e])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            yield rows()
        if state is not None:
            done.append(state)
        yield rows()

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return digests(format_conversations(turns.unionByName(own)))
