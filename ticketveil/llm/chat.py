"""Conversations as training text, assembled column by column, and read back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

# The template: a turn is <|role|>, a line feed, its text, </s> and a line feed.
OPEN, CLOSE, END = b"<|", b"|>\n", b"</s>\n"
#: Bytes that control strings start with, and the escape itself; each is written as a backslash and a letter.
#: So neither ``<`` nor ``[`` stands in an escaped text, and no control string either.
ESCAPES = {b"\\": b"\\", b"<": b"l", b"[": b"b", b"|": b"p"}
_LETTER = np.zeros(256, np.uint8)
for _byte, _letter in ESCAPES.items():
    _LETTER[ord(_byte)] = ord(_letter)
_BYTE = {letter: byte for byte, letter in ESCAPES.items()}
_ESCAPED = re.compile(rb"\\(.)", re.S)
_TURN = re.compile(rb"<\|([^|]*)\|>\n([^<]*)</s>\n")


def unescape(content: bytes) -> bytes:
    return _ESCAPED.sub(lambda m: _BYTE[m[1]], content)


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and its offsets into them."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets.astype(np.int64) - offsets[0]


def escaped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All segments with their special bytes doubled up, in one pass over the buffer."""
    letters = _LETTER[data]
    special = letters > 0
    shift = np.concatenate(([0], np.cumsum(special)))
    out = np.empty(len(data) + int(shift[-1]), np.uint8)
    at = np.arange(len(data)) + shift[1:]
    out[at] = np.where(special, letters, data)
    out[at[special] - 1] = ord("\\")
    return out, offsets + shift[offsets]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(buffer, turn offsets, content spans)``: one buffer with header, escaped text and end of each turn.

    The lengths of all segments give cumulative offsets; each source buffer is copied by scatter indices.
    """
    n = len(texts)
    names, name_at = escaped(*_buffer(roles))
    content, content_at = escaped(*_buffer(texts))
    fixed = [np.frombuffer(x, np.uint8) for x in (OPEN, CLOSE, END)]
    lengths = np.empty((n, 5), np.int64)
    lengths[:, [0, 2, 4]] = [len(x) for x in fixed]
    lengths[:, 1], lengths[:, 3] = np.diff(name_at), np.diff(content_at)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for column, segment in ((0, fixed[0]), (2, fixed[1]), (4, fixed[2])):
        out[starts[:, column, None] + np.arange(len(segment))] = segment
    for column, source, source_at in ((1, names, name_at), (3, content, content_at)):
        shift = np.repeat(starts[:, column] - source_at[:-1], lengths[:, column])
        out[np.arange(len(source)) + shift] = source
    return out, np.concatenate(([0], ends[:, -1])), np.stack((starts[:, 3], ends[:, 3]), 1)


def _column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over a buffer that is already filled."""
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)


def _codes(values: pa.Array) -> np.ndarray:
    """Equal values, null too, have equal numbers."""
    encoded = values.dictionary_encode(null_encoding="encode")
    return encoded.indices.to_numpy(zero_copy_only=False)


def _formatted(batch: pa.RecordBatch, loss_role: bytes) -> pa.RecordBatch:
    """Whole conversations, their rows one after the other. Columns: conversation, role, text."""
    conv = _codes(batch.column(0))
    first = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
    data, turn_at, content = assemble(batch.column(1), batch.column(2))
    conv_at = np.concatenate((turn_at[first], turn_at[-1:]))
    loss = np.array([r == loss_role for r in batch.column(1).to_pylist()], bool)
    of = np.searchsorted(first, np.arange(len(conv)), "right") - 1
    spans = content - conv_at[of][:, None]
    masked = pa.StructArray.from_arrays(
        [pa.array(spans[loss, 0]), pa.array(spans[loss, 1])], names=["start", "end"]
    )
    masked_at = np.concatenate(([0], np.cumsum(np.bincount(of[loss], minlength=len(first))))).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(pa.array(first)),
            _column(data, conv_at),
            pa.ListArray.from_arrays(pa.array(masked_at), masked),
            pa.array(np.diff(np.concatenate((first, [len(conv)])))),
        ],
        names=["conv", "formatted", "loss", "n_turns"],
    )


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """``(conv, formatted, loss, n_turns)``: one row per conversation.

    ``formatted`` has the turns in order of ``turn`` (nulls first; ties by role and text) as UTF-8 bytes;
    ``loss`` are the byte ranges of the texts of ``loss_role``. Null roles and texts count as empty ones, a
    null conversation is one of its own, repeated rows are turns each. Other columns are not read.
    A task reads its conversations as a sorted stream and holds whole ones of about a batch at a
    time; a conversation has to fit in a value, that is in 2 GB.
    """
    kind = turns.schema[conv].dataType.simpleString()
    rows = turns.select(
        F.col(conv).alias("conv"), utf8(role).alias("role"), utf8(text).alias("text"), F.col(turn).alias("turn")
    )
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartition(parts, "conv").sortWithinPartitions("conv", "turn", "role", "text").drop("turn")
    wanted = loss_role.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _codes(batch.column(0))
            last = int(np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))[-1])
            if held and batch.column(0)[0] != held[-1].column(0)[-1]:
                yield _formatted(_one(held), wanted)
                held = []
            if last:
                yield _formatted(_one([*held, batch.slice(0, last)]), wanted)
                held = []
            held.append(batch.slice(last))
        if held:
            yield _formatted(_one(held), wanted)

    schema = f"conv {kind}, formatted binary, loss array<struct<start: long, end: long>>, n_turns long"
    return sorted_.mapInArrow(run, schema).withColumnRenamed("conv", conv)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """Role and text of each turn."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the formatted conversations say: ``(conv, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars)``. Turns are parsed from the text, the loss text is taken by its ranges; both unescaped."""
    kind = formatted.schema[conv].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content, loss in zip(batch.column(1), batch.column(2)):
                whole = content.as_py()
                turns = parse(whole)
                masked = b"".join(unescape(whole[s["start"] : s["end"]]) for s in loss.as_py())
                said = b"".join(b"%s\n%s\n" % t for t in turns)
                rows.append(
                    (
                        len(turns),
                        hashlib.sha256(said).hexdigest(),
                        len(masked.decode()),
                        hashlib.sha256(masked).hexdigest(),
                        len(whole.decode()),
                    )
                )
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["conv", *names])

    schema = f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    rows = formatted.select(F.col(conv).alias("conv"), "formatted", "loss").mapInArrow(run, schema)
    return rows.withColumnRenamed("conv", conv)
