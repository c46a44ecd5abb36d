"""Fill-in-the-middle texts, put together by a secondary sort of bounded pieces."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Units (a run of ASCII letters, or any other code point) of a piece at most; bytes of a piece at most.
UNITS, PIECE = 4096, 1 << 15
#: Bytes of a text that are looked at together.
BLOCK = 1 << 20
#: Segments in the order of the output: marker before each, and its place in the text.
ORDERS = {"plain": ((b"", 0),), "psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def unit_starts(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Of each block of the UTF-8 text, its first byte and the places where a unit starts."""
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data), BLOCK):
        block = data[at : at + BLOCK]
        letter = _LETTER[block]
        start = (block & 0xC0) != 0x80
        start[1:] &= ~(letter[1:] & letter[:-1])
        if at and letter[0] and _LETTER[data[at - 1]]:
            start[0] = False
        yield at, np.flatnonzero(start) + at


def _characters(text: memoryview) -> int:
    data = np.frombuffer(text, np.uint8)
    return sum(int(np.count_nonzero((data[at : at + BLOCK] & 0xC0) != 0x80)) for at in range(0, len(data), BLOCK))


def plan(text: bytes, id: str) -> tuple[int, str, int, int]:
    """Units of the text, its form, and the bytes before the middle and before the suffix."""
    n = sum(len(starts) for _, starts in unit_starts(text))
    digest = hashlib.sha256(f"1:{id}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[i : i + 4]) for i in (0, 4, 8, 12))
    if not text or h3 % 100 >= 90 or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", 0, 0
    cuts, seen, places = sorted((h1 % (n + 1), h2 % (n + 1))), 0, [len(text)] * 2
    for _, starts in unit_starts(text):
        for k, cut in enumerate(cuts):
            if seen <= cut < seen + len(starts):
                places[k] = int(starts[cut - seen])
        seen += len(starts)
    return n, "spm" if h4 % 100 < 20 else "psm", *places


def cut(text: bytes, form: str, middle: int, suffix: int) -> Iterator[bytes]:
    """The output as pieces, in order. A piece holds whole units, up to ``UNITS``, or is part of a longer one."""
    bounds = {0: (0, middle), 1: (middle, suffix), 2: (suffix, len(text))}
    if form == "plain":
        bounds = {0: (0, len(text))}
    whole = len(text) <= PIECE
    stops = [] if whole else _stops(text)
    for marker, place in ORDERS[form]:
        a, b = bounds[place]
        inner = [] if whole else [x for x in stops if a < x < b]
        edges = [a, *inner, b]
        for k, (x, y) in enumerate(zip(edges, edges[1:])):
            for z in range(x, max(y, x + 1), PIECE):
                yield (marker if k == 0 and z == x else b"") + text[z : min(z + PIECE, y)]


def _stops(text: bytes) -> list[int]:
    found, seen = [], 0
    for _, starts in unit_starts(text):
        found += starts[-seen % UNITS :: UNITS].tolist()
        seen += len(starts)
    return found


#: Names for the key of a row and for a piece; ``copies`` counts equal rows, in the first piece only.
PIECES = "k long, g long, id {id}, form string, n long, prefix_chars long, middle_chars long, copies long, pos int, piece binary"


def pieces(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The outputs of all rows as ``(k, g, id, form, n, prefix_chars, middle_chars, copies, pos, piece)``.

    The pieces of a row in the order of ``pos`` are its output. ``k, g`` are 128 bits of hash of id and text, so rows
    that share an id stay apart; equal rows are one, counted for each batch in ``copies`` (zero in later pieces).
    Null text is empty. A null id takes the place of no digits in the hash that the cuts come from.
    """
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(id).cast("string").alias("s"), utf8(text).alias("t"))
    hashed = rows.select(F.xxhash64("s", "t").alias("k"), F.xxhash64(F.lit(1), "s", "t").alias("g"), "id", "s", "t")
    schema = PIECES.format(id=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, copies, first = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), {}, {}
            for i, key in enumerate(keys):
                copies[key] = copies.get(key, 0) + 1
                first.setdefault(key, i)
            out, size = [], 0
            for key, i in first.items():
                text = batch.column(4)[i].as_py()
                n, form, middle, suffix = plan(text, batch.column(3)[i].as_py() or "")
                view = memoryview(text)
                sizes = (None, None) if form == "plain" else (_characters(view[:middle]), _characters(view[middle:suffix]))
                for pos, piece in enumerate(cut(text, form, middle, suffix)):
                    out.append((i, form, n, *sizes, 0 if pos else copies[key], pos, piece))
                    size += len(piece)
                    if size >= 4 * BLOCK:
                        yield _batch(batch, out)
                        out, size = [], 0
            if out:
                yield _batch(batch, out)

    def _batch(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        at, form, n, a, b, copies, pos, piece = map(list, zip(*out))
        longs = [pa.array(x, pa.int64()) for x in (n, a, b, copies)]
        own = [batch.column(c).take(pa.array(at)) for c in range(3)]
        columns = [*own, pa.array(form), *longs, pa.array(pos, pa.int32()), pa.array(piece, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PIECES.split(", ")])

    return hashed.mapInArrow(run, schema)


class _Found:
    """Which bytes of an output, given piece by piece, lie in which segment."""

    def __init__(self, form: str):
        self.order, self.at, self.held = ORDERS[form], -1 if form != "plain" else 0, b""
        self.place = self.order[0][1] if form == "plain" else None

    def feed(self, piece: bytes, last: bool) -> Iterator[tuple[int, bytes]]:
        data = self.held + piece
        while self.at + 1 < len(self.order):
            marker, place = self.order[self.at + 1]
            i = data.find(marker)
            if i < 0:
                break
            if self.place is not None and i:
                yield self.place, data[:i]
            data, self.at, self.place = data[i + len(marker) :], self.at + 1, place
        keep = 0 if last or self.at + 1 == len(self.order) else min(len(PREFIX) - 1, len(data))
        if len(data) > keep and self.place is not None:
            yield self.place, data[: len(data) - keep]
        self.held = data[len(data) - keep :]


def digests(docs: DataFrame, id: str = "doc_id", text: str = "text", outputs: bool = False) -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)``, one row per row of ``docs``.

    The pieces are dealt by document and sorted within partitions by their place in the output, so a task reads each
    output as a stream and holds a piece of it at a time. The markers found in that stream tell each stretch's place in the
    text; the stretches are sorted again by it, within the same partitions, and read once more. ``outputs`` adds
    ``output`` itself, for which each output has to fit in a row.

    Null text is empty and plain. Equal rows are put together once and given back as often as they came. No other
    column of ``docs`` is read.
    """
    kind = docs.schema[id].dataType.simpleString()
    cut_up = pieces(docs, id, text).repartition("k", "g")
    info = f"k long, g long, id {kind}, form string, n long, prefix_chars long, middle_chars long, copies long"
    carried = [c.split()[0] for c in info.split(", ")]
    put = cut_up.sortWithinPartitions("k", "g", "pos").mapInArrow(_put_together, f"{info}, place int, pos int, piece binary")
    back = put.sortWithinPartitions("k", "g", "place", "pos").mapInArrow(
        _restore(outputs), f"{info}, output_sha256 binary, restored_sha256 binary, output binary"
    )
    copies = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    hexes = [F.lower(F.hex(c)).alias(c) for c in ("output_sha256", "restored_sha256")]
    rows = back.select(*carried[2:7], *hexes, *([F.col("output").cast("string").alias("output")] if outputs else []), copies)
    return rows.drop("col").withColumnRenamed("id", id)


def _groups(batches: Iterator[pa.RecordBatch], key: int = 2) -> Iterator[tuple[pa.RecordBatch, int, bool, tuple]]:
    """Each row with its batch, whether it opens a group of equal first columns, and that key."""
    before = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in range(key))))
        for i, now in enumerate(keys):
            yield batch, i, now != before, now
            before = now


class _Rows:
    """Rows of ``carried`` columns taken from batches, with own columns beside them."""

    def __init__(self, names: list[str], kinds: list[pa.DataType]):
        self.names, self.kinds, self.rows, self.size = names, kinds, [], 0

    def add(self, head: list, *own, size: int = 64):
        self.rows.append((*head, *own))
        self.size += size

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        kinds = [*(f.type for f in list(schema)[:8]), *self.kinds]
        columns = [pa.array(list(c), t) for c, t in zip(zip(*self.rows), kinds)]
        names = [*schema.names[:8], *self.names]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays(columns, names=names)


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams outputs: their pieces again, each with its place in the text, then a row of place -1 with the digest."""
    out = _Rows(["place", "pos", "piece"], [pa.int32(), pa.int32(), pa.binary()])
    head = held = digest = found = schema = None
    copies, pos, seen = 0, 0, -1

    def close(last: bytes):
        digest.update(last)
        put(last, True)
        out.add([*head[:7], copies], -1, 0, digest.digest())

    def put(piece: bytes, last: bool):
        nonlocal pos
        for place, stretch in found.feed(piece, last):
            out.add([*head[:2], None, None, None, None, None, 0], place, pos, stretch, size=len(stretch) + 64)
            pos += 1

    for batch, i, opens, _ in _groups(batches):
        schema = batch.schema
        piece, at, count = batch.column(9)[i].as_py(), batch.column(8)[i].as_py(), batch.column(7)[i].as_py()
        if opens:
            if head is not None:
                close(held)
            head = [batch.column(c)[i].as_py() for c in range(8)]
            held, digest, found, copies, pos, seen = piece, hashlib.sha256(), _Found(head[3]), count, 0, 0
        elif at == seen:  # the same piece of an equal row
            copies += count
        else:
            digest.update(held)
            put(held, False)
            held, seen = piece, at
        if out.size >= BLOCK:
            yield out.batch(schema)
    if head is not None:
        close(held)
        yield out.batch(schema)


def _restore(outputs: bool):
    """Streams texts out of stretches in the order of the text; the row with the output's digest comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(["output_sha256", "restored_sha256", "output"], [pa.binary()] * 3)
        head = digest = own = schema = None
        kept: list[tuple[int, bytes]] = []

        def close():
            output = _assembled(kept, head[3]) if outputs else None
            out.add(head, own, digest.digest(), output, size=64 + len(output or b""))

        for batch, i, opens, _ in _groups(batches):
            schema = batch.schema
            piece = batch.column(10)[i].as_py()
            if opens:
                if head is not None:
                    close()
                head, digest, own, kept = [batch.column(c)[i].as_py() for c in range(8)], hashlib.sha256(), piece, []
            else:
                digest.update(piece)
                if outputs:
                    kept.append((batch.column(8)[i].as_py(), piece))
            if out.size >= BLOCK:
                yield out.batch(schema)
        if head is not None:
            close()
            yield out.batch(schema)

    return run


def _assembled(kept: list[tuple[int, bytes]], form: str) -> bytes:
    parts = {place: b"".join(p for at, p in kept if at == place) for place in range(3)}
    return b"".join(marker + parts[place] for marker, place in ORDERS[form])


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``digests`` with the whole ``output`` of each row, for outputs that fit in a row."""
    return digests(docs, id, text, outputs=True)
