"""Byte-level BPE by a sentencepiece model that is written out from a rank vocabulary."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

#: Largest vocabulary file that is broadcast, in bytes.
MAX_VOCABULARY = 64 << 20
#: Bytes of text segments and their ids that a worker remembers before it starts anew; what one of them takes
#: besides its own, and the characters of the longest that is remembered.
MEMORY, ENTRY, LONGEST = 40 << 20, 200, 256
#: A space that is neither the first white space of a run nor the one before a visible character.
_INNER_SPACE = regex.compile(r"\s \s|\s \Z")


def _letters() -> list[str]:
    """A visible character for each byte: itself if it is visible Latin-1, else one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


_LETTERS = _letters()
_TO_LETTERS = {b: c for b, c in enumerate(_LETTERS)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: an integer, a 32-bit float or a length-delimited value."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    with open(path, "rb") as f:
        content = f.read(MAX_VOCABULARY + 1)
    if len(content) > MAX_VOCABULARY:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY} bytes")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model: piece 0 is unknown, then the tokens in order of rank, each byte as its
    letter, scored by the negative rank, with identity normalisation and no added space."""
    unknown, normal, bpe = 2, 1, 2
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        name = "".join(map(_TO_LETTERS.get, token)).encode()
        pieces.append(_field(1, _field(1, name) + _field(2, float(-rank)) + _field(3, normal)))
    trainer = _field(3, bpe) + _field(4, len(pieces))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Tokenizer:
    """Encodes and decodes by ranks; each match of the pattern is merged by itself."""

    def __init__(self, ranks: dict[bytes, int], model: bytes, pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        tokens = sorted(ranks.items(), key=lambda x: x[1])
        self.rank_of = [0, *(rank for _, rank in tokens)]
        self.token_of = {rank: token for token, rank in tokens}
        self.known: dict[str, bytes] = {}
        self.held = 0  # bytes in ``known``

    def _merge(self, token: str) -> list[int]:
        """A whole token of the vocabulary is itself; all else is merged by the model."""
        content = token.encode()
        if (rank := self.ranks.get(content)) is not None:
            return [rank]
        letters = content.decode("latin-1").translate(_TO_LETTERS)
        return [self.rank_of[i] for i in self.model.encode(letters)]

    def _segment(self, segment: str) -> bytes:
        ids = [i for token in self.pattern.findall(segment) for i in self._merge(token)]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(segment) <= LONGEST:  # long ones hardly recur
            if self.held >= MEMORY:
                self.known.clear()
                self.held = 0
            self.known[segment] = packed
            self.held += 4 * len(segment) + len(packed) + ENTRY
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        No token goes from a visible character on to white space, and of a run of white space the
        last space goes to what follows. So the text may be cut before its spaces, if no space
        stands within such a run, and the pieces, most of which recur, be encoded by themselves.
        """
        if _INNER_SPACE.search(text):
            ids = [i for token in self.pattern.findall(text) for i in self._merge(token)]
            return struct.pack(f"<{len(ids)}I", *ids)
        known, parts = self.known, text.split(" ")
        out = []
        for segment in (parts[0], *(" " + p for p in parts[1:])):
            packed = known.get(segment)
            out.append(self._segment(segment) if packed is None else packed)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token_of.__getitem__, ids.tolist()))


_open: dict[str, Tokenizer] = {}


def _tokenizer(shared) -> Tokenizer:
    """One tokenizer for a worker and vocabulary."""
    key, ranks, model, pattern = shared.value
    if key not in _open:
        _open.clear()
        _open[key] = Tokenizer(ranks, model, pattern)
    return _open[key]


def _shared(docs: DataFrame, path: str, pattern: str):
    """The vocabulary, read once by the driver; its size is checked."""
    ranks = read_ranks(path)
    model = model_bytes(ranks)
    key = hashlib.sha256(model + pattern.encode()).hexdigest()
    return docs.sparkSession.sparkContext.broadcast((key, ranks, model, pattern))


def _id_lists(packed: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids`` (array of int), the tokens of the whole text, to ``docs`` without a shuffle.

    ``path`` is a rank file, read once by the driver and broadcast (its size is checked). Null and empty
    texts have no tokens. A column of the same name is replaced.
    """
    shared = _shared(docs, path, pattern)
    rest = [c for c in docs.columns if c != ids]
    flat = docs.select(*rest, utf8(text).alias("__utf8"))
    names = [f"c{i}" for i in range(len(flat.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared)
        for batch in batches:
            packed = [tokenizer.encode(str(t.as_py(), "utf-8", "replace")) for t in batch.columns[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _id_lists(packed)], names=[*names[:-1], "ids"])

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, flat.schema.fields[:-1]))
    return flat.toDF(*names).mapInArrow(run, f"{schema}{', ' if rest else ''}ids array<int>").toDF(*rest, ids)


def decode(encoded: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded`` (binary), the bytes of the tokens in ``ids``. Null ids count as none; ids that
    the vocabulary lacks end the job with an error."""
    ranks = read_ranks(path)
    shared = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})
    rest = [c for c in encoded.columns if c != decoded]
    names = [f"c{i}" for i in range(len(rest))]
    at = rest.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for batch in batches:
            out = [b"".join(map(token, x.values.to_pylist() if x.is_valid else ())) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "decoded"])

    flat = encoded.select(*rest).toDF(*names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema)
    return flat.mapInArrow(run, f"{schema}, decoded binary").toDF(*rest, decoded)


def round_trip(
    docs: DataFrame, path: str, pattern: str, id: str = "doc_id", text: str = "text", keep_ids: bool = False
) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` per row, and with ``keep_ids`` the ``ids`` (array of int).

    Encodes the texts and decodes the ids in one pass, and gives SHA-256 of the ids (little-endian
    unsigned 32-bit integers) and of the decoded bytes. Null and empty texts have no tokens.
    """
    shared = _shared(docs, path, pattern)
    kind = docs.schema[id].dataType.simpleString()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared)
        for batch in batches:
            packed = [tokenizer.encode(str(t.as_py(), "utf-8", "replace")) for t in batch.column(1)]
            decoded = [tokenizer.decode(np.frombuffer(p, "<u4")) for p in packed]
            columns = [
                batch.column(0),
                pa.array([len(p) // 4 for p in packed], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns + [_id_lists(packed)] * keep_ids, names=names)

    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    rows = docs.select(F.col(id).alias("id"), utf8(text).alias("t")).mapInArrow(run, schema)
    return rows.withColumnRenamed("id", id)
