"""Benchmark passages in documents, found with a suffix automaton over the items' words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8, word_spans, words

WINDOW = 10
#: Words of the items in one automaton. Items beyond it go into further automata, which a task
#: builds one after the other; its memory is bounded whatever the number of items.
BLOCK_WORDS = 50_000
#: Bytes of text that a task holds as words while it goes through the blocks, if no single text is longer.
HELD_BYTES = 8 << 20
_KEPT_AUTOMATA = 2


class Automaton:
    """Generalised suffix automaton of word sequences ``items [(item id, words)]``."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [(name, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for name, ws in items if ws]
        for _, sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        #: By state: the items that have its window; (words, item) of items shorter than a window.
        self.has: dict[int, set[str]] = {}
        self.whole: dict[int, list[tuple[int, str]]] = {}
        self.least = window
        pairs = set()
        for name, sequence in sequences:
            pairs.update(a * len(self.ids) + b for a, b in zip(sequence, sequence[1:]))
            state = 0
            for n, word in enumerate(sequence, 1):
                state = self.next[state][word]
                if n >= window:
                    self.has.setdefault(self.of_window(state), set()).add(name)
            if len(sequence) < window:
                self.whole.setdefault(state, []).append((len(sequence), name))
                self.least = min(self.least, len(sequence))
        self.pairs = np.array(sorted(pairs), np.int64)

    def _extend(self, last: int, word: int) -> int:
        arcs, link, length = self.next, self.link, self.length
        if word in arcs[last]:
            q = arcs[last][word]
            return q if length[q] == length[last] + 1 else self._split(last, word, q)
        new = len(arcs)
        arcs.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and word not in arcs[p]:
            arcs[p][word] = new
            p = link[p]
        if p >= 0:
            q = arcs[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word: int, q: int) -> int:
        arcs, link = self.next, self.link
        clone = len(arcs)
        arcs.append(dict(arcs[q]))
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and arcs[p].get(word) == q:
            arcs[p][word] = clone
            p = link[p]
        return clone

    def of_window(self, state: int) -> int:
        """The state of the last ``window`` words of a match that ends in ``state``."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def stretches(self, tokens: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Word ids, and the stretches whose neighbouring words all stand so in some item. No match
        goes beyond one, so the automaton starts anew at each."""
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))
        if not len(ids) or not self.ids:
            return ids, []
        known = ids >= 0
        pair = ids[:-1] * len(self.ids) + ids[1:]
        joined = known[:-1] & known[1:]
        if len(self.pairs):
            at = np.flatnonzero(joined)
            where = np.searchsorted(self.pairs, pair[at])
            joined[at] = self.pairs[np.minimum(where, len(self.pairs) - 1)] == pair[at]
        else:
            joined[:] = False
        starts = np.flatnonzero(known & ~np.concatenate(([False], joined)))
        ends = np.flatnonzero(known & ~np.concatenate((joined, [False]))) + 1
        long = ends - starts >= self.least
        return ids, list(zip(starts[long].tolist(), ends[long].tolist()))

    def matches(self, tokens: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, word after the last, items) of each place of a window."""
        ids, found = self.stretches(tokens)
        arcs, link, length, window, whole = self.next, self.link, self.length, self.window, self.whole
        for start, end in found:
            state = size = 0
            for at, word in enumerate(ids[start:end].tolist(), start + 1):
                while state and word not in arcs[state]:
                    state = link[state]
                    size = length[state]
                if word in arcs[state]:
                    state, size = arcs[state][word], size + 1
                if size >= window:
                    yield at - window, at, self.has[self.of_window(state)]
                p = state
                while whole and p > 0:
                    for n, name in whole.get(p, ()):
                        if n <= size:
                            yield at - n, at, {name}
                    p = link[p]


def _blocks(items: DataFrame, id: str, text: str, window: int, block_words: int) -> Iterator[list]:
    """Items in blocks of bounded size, read row by row; an item longer than a block is cut into
    pieces that overlap by a window less one word, so that no window is lost."""
    block, size = [], 0
    for name, content in items.select(F.coalesce(F.col(id).cast("string"), F.lit("")), utf8(text)).toLocalIterator():
        tokens = words(bytes(content))
        step = max(1, block_words - window + 1)
        for at in range(0, max(1, len(tokens) - window + 1), step):
            piece = tokens[at : at + block_words] if len(tokens) > block_words else tokens
            if block and size + len(piece) > block_words:
                yield block
                block, size = [], 0
            block.append((name, piece))
            size += len(piece)
            if len(tokens) <= block_words:
                break
    if block:
        yield block


_built: dict[tuple, Automaton] = {}


def _automaton(block, window: int) -> Automaton:
    """The automaton of a broadcast block; a worker keeps the last few."""
    key = (block.value[0], window)
    if key not in _built:
        while len(_built) >= _KEPT_AUTOMATA:
            del _built[next(iter(_built))]
        _built[key] = Automaton(block.value[1], window)
    return _built[key]


def _held(contents: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, in groups of about ``HELD_BYTES``."""
    group, size = [], 0
    for content in contents:
        if group and size + len(content) > HELD_BYTES:
            yield group
            group, size = [], 0
        group.append(content)
        size += len(content)
    if group:
        yield group


def _hits(documents: list[list[bytes]], blocks: list, window: int) -> list[tuple[list[tuple[int, int]], set[str]]]:
    """For the words of each document the merged ranges of hit words, and the items. All documents
    go through a block before the next one is built."""
    names: list[set[str]] = [set() for _ in documents]
    edges: dict[int, np.ndarray] = {}
    for block in blocks:
        machine = _automaton(block, window)
        for i, tokens in enumerate(documents):
            for start, end, items in machine.matches(tokens):
                if i not in edges:
                    edges[i] = np.zeros(len(tokens) + 1, np.int64)
                edges[i][start] += 1
                edges[i][end] -= 1
                names[i] |= items
    return [(_ranges(edges[i]) if i in edges else [], found) for i, found in enumerate(names)]


def _ranges(edges: np.ndarray) -> list[tuple[int, int]]:
    """Where the running sum of ``edges`` is positive."""
    change = np.diff(np.concatenate(([0], np.cumsum(edges[:-1]) > 0, [0])).astype(np.int8))
    return list(zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()))


def _without(content: bytes, spans: list[tuple[int, int]]) -> bytes:
    places, kept, at = word_spans(content), [], 0
    for a, b in spans:
        kept.append(content[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, content[at:]])


def _cleaned(contents: list[bytes], blocks: list, window: int, most: float) -> tuple[list[bytes], list[float]]:
    """The texts without their hit spans, again until none is left, and the covered shares before."""
    texts, covered, todo = list(contents), [0.0] * len(contents), range(len(contents))
    first = True
    while todo:
        documents, again = [words(texts[i]) for i in todo], []
        for i, tokens, (spans, _) in zip(todo, documents, _hits(documents, blocks, window)):
            if spans and first:
                covered[i] = sum(b - a for a, b in spans) / len(tokens)
            if spans and covered[i] <= most:
                texts[i] = _without(texts[i], spans)
                again.append(i)
        todo, first = again, False
    return texts, covered


def _broadcast(items: DataFrame, id: str, text: str, window: int, block_words: int) -> list:
    """Blocks hold ``block_words`` words each; the driver reads and broadcasts them one by one."""
    sc, found = items.sparkSession.sparkContext, []
    for block in _blocks(items, id, text, window, block_words):
        found.append(sc.broadcast((hashlib.sha256(repr(block).encode()).hexdigest(), block)))
    return found


def contamination(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``(id, n_words, n_hit, items, spans)`` per row of ``docs``, in one pass without a shuffle.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one
    window. ``spans`` are merged ranges of hit words, ``items`` the ids of the items with windows
    there, sorted as strings; an item without an id has an empty one. Null and empty texts have no words; repeated rows are judged each;
    without items nothing is hit. Other columns are not read.
    """
    blocks = _broadcast(items, item_id, item_text, window, block_words)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, hit, names, ranges = [], [], [], []
            for group in _held(batch.column(1).to_pylist()):
                documents = [words(content) for content in group]
                for tokens, (spans, found) in zip(documents, _hits(documents, blocks, window)):
                    total.append(len(tokens))
                    hit.append(sum(b - a for a, b in spans))
                    names.append(sorted(found))
                    ranges.append([{"start": a, "end": b} for a, b in spans])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [pa.array(total, pa.int64()), pa.array(hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(ranges, span)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_words", "n_hit", "items", "spans"])

    schema = f"id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
    rows = docs.select(F.col(id).alias("id"), utf8(text).alias("t")).mapInArrow(run, schema)
    return rows.withColumnRenamed("id", id)


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows of ``docs`` without benchmark passages, all columns kept.

    Matches of ``window`` words and more are cut out of the text, again until none is left; a
    document with more than ``max_coverage`` of its words hit is dropped. Texts without a match,
    null ones too, stay as they are; in others ``n_chars``, if there is one, is counted anew.
    """
    blocks = _broadcast(items, item_id, item_text, window, block_words)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, texts, keep = batch.column(at).cast(pa.binary()).to_pylist(), [], []
            for group in _held([content or b"" for content in before]):
                cleaned, covered = _cleaned(group, blocks, window, max_coverage)
                texts += cleaned
                keep += [share <= max_coverage for share in covered]
            texts = [None if a is None else b for a, b in zip(before, texts)]
            columns = [*batch.columns, pa.array([a != b for a, b in zip(before, texts)], pa.bool_())]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            out = pa.RecordBatch.from_arrays(columns, names=[*names, "changed"])
            yield out.filter(pa.array(keep, pa.bool_()))

    flat = docs.toDF(*names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema) + ", changed boolean"
    rows = flat.mapInArrow(run, schema).toDF(*docs.columns, "__changed")
    if "n_chars" in docs.columns:
        counted = F.length(text).cast(docs.schema["n_chars"].dataType)
        rows = rows.withColumn("n_chars", F.when(F.col("__changed"), counted).otherwise(F.col("n_chars")))
    return rows.drop("__changed")
